"""Removal of repeated and nearly repeated lines by a deletion-neighbourhood join, in SQL functions alone.

Two lines within one edit share a variant: one of them with a character deleted, or itself. A line is
dropped if an earlier line, by document id and place, equals it or is within one edit.

Equal lines are first counted as one. Of two different lines within one edit, all but one of the parts that
they are cut into are equal, so only lines that share all but one of 2 parts with another, and then all but
one of PARTS, emit their variants. Of each
variant and place of deletion only the earliest line is kept: lines with both in common differ
in that one character, and the line that equals the variant is one deletion away. So no
group of similar lines is ever expanded into pairs, however large it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm._common import dropped, released, written

#: Lines of fewer characters stay; those of at least NEAR are also compared within one edit.
SHORT, NEAR = 10, 16
#: Parts of the second comparison.
PARTS = 16


def _key(line: Column) -> Column:
    """What is compared of a line: it without blanks at its ends."""
    return F.btrim(line, F.lit(" \t\r"))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # null ids come last; rows alike in id and text are told apart by nothing and treated alike
    return rows.withColumn("ord", F.coalesce("doc_id", F.lit((1 << 63) - 1))).withColumn("th", F.xxhash64("text"))


def _lines(rows: DataFrame) -> DataFrame:
    out = rows.where(F.col("text").isNotNull()).select("ord", "th", F.posexplode(F.split("text", "\n", -1)).alias("pos", "raw"))
    return out.select("ord", "th", "pos", _key(F.col("raw")).alias("line")).where(F.length("line") >= SHORT)


def _digest(line: str) -> list[Column]:
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), F.col(line)).alias("h2")]


def _halves() -> list[Column]:
    """Hashes of the first and the second half of the line, cut for its length ``n`` and for one less; null for a short line.

    The same comparison as :func:`_frames` in two parts, where what is left is the other half. Written out,
    as functions of each line are compiled, and lambdas over an array are not.
    """
    cuts = ["left(line, n div 2)", "right(line, n - n div 2)", "left(line, (n - 1) div 2)", "right(line, n - 1 - (n - 1) div 2)"]
    cuts = [c.replace("n div 2", "cast(n div 2 AS int)").replace("(n - 1) div 2", "cast((n - 1) div 2 AS int)") for c in cuts]
    sides = [(0, 0), (0, 1), (1, 0), (1, 1)]
    # a half is the same for both lines if one cut is by the length of the shorter: so the length that is cut for counts
    return [F.when(F.col("n") >= NEAR, F.xxhash64(F.col("n") - less, F.lit(side), F.expr(c))).alias(f"half{k}") for k, ((less, side), c) in enumerate(zip(sides, cuts, strict=True))]


def _frames(parts: int) -> Column:
    """The line less each of its parts, cut for both lengths that the shorter of two lines one edit apart can have.

    An array of structs: key, a hash of what is left; lo and hi, between which the one edit then is.
    """
    n, line = F.length("line"), F.col("line")

    def frame(r: Column, j: Column) -> Column:
        head, upto = F.floor(j * r / parts).cast("int"), F.floor((j + 1) * r / parts).cast("int")
        left = F.xxhash64(r, j, F.substr(line, F.lit(1), head), F.substr(line, n - (r - upto) + 1, r - upto))
        return F.struct(left.alias("key"), (head + 1).alias("lo"), F.least(upto + 1, n).alias("hi"))

    cut = F.sequence(F.lit(0), F.lit(parts - 1))
    return F.flatten(F.transform(F.array(n, n - 1), lambda r: F.transform(cut, lambda j: frame(r, j))))


def _sharing(keys: DataFrame) -> DataFrame:
    """The h1 of rows (h1, key) that share a key with another h1."""
    shared = written(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo <> hi"))
    two = shared.where("n = 2").select(F.explode(F.array("lo", "hi")).alias("h1"))
    more = keys.join(shared.where("n > 2").select("key"), "key").select("h1")
    out = written(two.unionByName(more).distinct())
    dropped(shared)
    return out


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(ord, th, gone): for each row that loses lines, the places of these, from 0."""
    rows = _rows(docs, id_col, text_col)
    lines = _lines(rows)
    place = F.struct("ord", "th", "pos")
    # all that later steps need of most lines: texts are cut into lines once more only for lines that share a half
    known = written(lines.withColumn("n", F.length("line")).select("ord", "th", "pos", *_digest("line"), *_halves()))
    halves = [c for c in known.columns if c.startswith("half")]
    distinct = written(known.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"), *(F.first(c).alias(c) for c in halves)))
    asked = _sharing(distinct.select("h1", F.explode(F.array(*halves)).alias("key")).where("key IS NOT NULL"))
    texts = lines.where(F.length("line") >= NEAR).select(F.xxhash64("line").alias("h1"), "line", place.alias("at")).join(asked, "h1")
    texts = written(texts.groupBy("h1", "line").agg(F.min("at").alias("at")))
    cut = [texts]
    # only characters in a part whose rest another line shares are deleted
    frames = texts.select("h1", F.explode(_frames(PARTS)).alias("x")).select("h1", "x.*")
    shared = frames.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b").select("key")
    close = frames.join(shared, "key").groupBy("h1").agg(F.array_distinct(F.flatten(F.collect_set(F.sequence("lo", "hi")))).alias("places"))
    texts = written(texts.join(close, "h1"))
    cut.append(texts)
    less = lambda i: F.concat(F.substr("line", F.lit(1), i - 1), F.substr("line", i + 1))
    variants = texts.select("h1", "at", F.explode(F.transform("places", lambda i: F.struct(i.alias("i"), F.xxhash64(less(i)).alias("v")))).alias("x")).select("h1", "at", "x.i", "x.v")
    # the line that has one character else at the same place
    least = variants.groupBy("v", "i").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("at", "h1")).alias("m")).where("n > 1").select("v", "i", "m")
    swapped = variants.join(least, ["v", "i"]).where(F.col("m.at") < F.col("at")).select("h1", "m")
    # the line that lacks a character of the other, either being the earlier
    own = texts.select(F.col("h1").alias("v"), F.col("at").alias("own_at"))
    longer = variants.join(own, "v")
    lacking = longer.where(F.col("own_at") < F.col("at")).select("h1", F.struct(F.col("own_at").alias("at"), F.col("v").alias("h1")).alias("m"))
    having = longer.where(F.col("own_at") > F.col("at")).groupBy("v").agg(F.min(F.struct("at", "h1")).alias("m")).select(F.col("v").alias("h1"), "m")
    found = swapped.unionByName(lacking).unionByName(having).groupBy("h1").agg(F.min("m").alias("m"))
    sides = found.join(texts.select("h1", "line"), "h1").select("h1", "line", F.col("m.h1").alias("of"))
    sides = sides.join(texts.select(F.col("h1").alias("of"), F.col("line").alias("kept")), "of")
    near = sides.where(F.levenshtein("line", "kept") == 1).select(*_digest("line")).distinct()

    marked = distinct.join(near.withColumn("gone", F.lit(True)), ["h1", "h2"], "left").where("n > 1 OR gone").select("h1", "h2", "first", "gone")
    hits = known.select("h1", "h2", place.alias("at")).join(marked, ["h1", "h2"]).where(F.coalesce("gone", F.lit(False)) | (F.col("at") != F.col("first")))
    gone = written(hits.select("at.ord", "at.th", "at.pos").groupBy("ord", "th").agg(F.collect_set("pos").alias("gone")))
    released(docs.sparkSession, known, distinct, asked, *cut)
    return gone


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of each row, with ``text`` less its dropped lines, and n_lines and n_dropped.

    Lines end at line feeds and are compared without the blanks at their ends; those of
    fewer than SHORT characters always stay, those of fewer than NEAR go only if an earlier line equals
    them. Null texts stay null and have no lines; an empty text has one. The earliest line is by
    ascending id (null ids last), the text's hash at equal ids, and place; rows alike in id and
    text count as one document and are treated alike. A column of the names added is replaced. An empty
    table gives no rows.
    """
    gone = dropped_lines(docs, id_col, text_col).select(F.col("ord").alias("_ord"), F.col("th").alias("_th"), F.col("gone").alias("_gone"))
    rest = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "_ord", "_th", "_gone", "_lines")]
    rows = docs.select(*rest, F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("_ord"), F.xxhash64(text_col).alias("_th")).join(gone, ["_ord", "_th"], "left")
    # a column of its own, as an expression inside a lambda is evaluated for each element
    rows = rows.withColumn("_lines", F.split(F.col(text_col), "\n", -1))
    lines = F.col("_lines")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_gone")), lambda i: F.get(lines, i))
    text = F.when(F.col("_gone").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    n = F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long")
    return rows.select(
        *[text.alias(c) if c == text_col else F.col(c) for c in rest], n.alias("n_lines"), F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_dropped")
    )


def without_emptied(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`dedup_lines` less the rows that lost lines and hold nothing but blanks since; rows that were blank before stay."""
    out = dedup_lines(docs, id_col, text_col)
    return out.where((F.col("n_dropped") == 0) | F.col(text_col).rlike(r"\S"))
