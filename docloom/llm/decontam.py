"""Benchmark decontamination by template canonicalisation, in SQL functions alone.

Numbers, names and units become typed placeholders, in documents as in benchmark items, so that
a question with other values has the same template. There are two templates, each with its own words:

* ``plain``: only numbers and units are placeholders, letter case and white space don't count;
* ``named``: runs of capitalised words, at the start of a sentence too, are one placeholder each as well.

Windows of WORDS template words are joined by hash. Windows with fewer than ANCHORS words that are no placeholders are
not: tables of figures are alike everywhere. Such windows are joined by their values, and found along the
alignments (the same distance between the places) that the others give. An item and a document are laid against
each other along every alignment found; the values behind the placeholders must then map one to one, or only windows
without placeholders count. A document is contaminated by an item if it holds at least SHARE of its windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm._common import written

WORDS, SHARE, ANCHORS = 5, 0.8, 2
#: A benchmark of at most so many windows is broadcast; a larger one is joined by shuffling.
BROADCAST_WINDOWS = 200_000
#: Unit words that count as such right after a number.
UNITS = (
    "mm cm m km in ft yd mi mg g kg t lb oz ml cl l s sec min h hr hrs ms kb mb gb tb w kw mw v hz khz mhz ghz "
    "second seconds minute minutes hour hours day days week weeks month months year years "
    "meter meters metre metres kilometer kilometers kilometre kilometres mile miles foot feet inch inches "
    "gram grams kilogram kilograms pound pounds liter liters litre litres percent dollar dollars euro euros cent cents degrees"
).split()
_NAME, _UNIT, _JOINT = "\u0001", "\u0002", "\u0003"
_LETTER = r"\p{L}\p{N}"
#: Parts of a number; a unit behind a number; a capitalised word before another; the start of a capitalised word.
_NUMBER = r"([0-9])[.,:/](?=[0-9])"
_AFTER = rf"([0-9])[\s-]*((?i:{'|'.join(sorted(UNITS, key=lambda u: (-len(u), u)))}))(?![{_LETTER}])"
_RUN = rf"(?<![{_LETTER}{_NAME}{_UNIT}])(\p{{Lu}}\p{{Ll}}\p{{L}}*)\s+(?=\p{{Lu}}\p{{Ll}})"
_CAPITAL = rf"(?<![{_LETTER}{_JOINT}{_UNIT}])(?=\p{{Lu}}\p{{Ll}})"
SPLIT = rf"[^{_LETTER}{_NAME}{_UNIT}{_JOINT}]+"
TEMPLATES = ("plain", "named")


def marked_words(text: Column, named: bool) -> Column:
    """The words of a text, in lower case; units and names begin with a mark, numbers with a digit."""
    text = F.translate(text, _NAME + _UNIT + _JOINT, "   ")
    figures = F.regexp_replace(F.regexp_replace(text, _NUMBER, "$1"), _AFTER, f"$1 {_UNIT}$2")
    text = F.when(text.rlike("[0-9]"), figures).otherwise(text)
    if named:
        text = F.regexp_replace(F.regexp_replace(text, _RUN, f"$1{_JOINT}"), _CAPITAL, _NAME)
    return F.array_remove(F.split(F.lower(text), SPLIT), "")


def is_slot(word: Column) -> Column:
    return word < ":"  # marks and digits sort before it, letters after


def template(word: Column) -> Column:
    """The placeholder for a value, the word itself for any other."""
    return F.when(~is_slot(word), word).when(word < _UNIT, F.lit("\u0001name")).when(word < _JOINT, F.lit("\u0002unit")).otherwise(F.lit("0number"))


def _windows(df: DataFrame, keys: list[str], words: int) -> DataFrame:
    """keys, kind, at, weak, h for ``plain`` and ``named``, arrays of marked words: each window's place and hash.

    Windows are rows of as many columns, so that all work on them is compiled. Those of the two templates have different hashes.
    """
    shifted = lambda c: F.arrays_zip(*(F.slice(c, k + 1, F.greatest(F.size(c) - (words - 1), F.lit(0))).alias(f"w{k}") for k in range(words)))
    w = [F.col(f"w{k}") for k in range(words)]
    parts = []
    for kind, name in enumerate(TEMPLATES):
        # no filter on the number of words: it would be pushed below, and the words made twice
        rows = df.select(*keys, F.posexplode(shifted(F.col(name)))).select(*keys, F.col("pos").alias("at"), "col.*")
        slots = sum((F.when(is_slot(x), 1).otherwise(0) for x in w), F.lit(0))
        rows = rows.withColumn("weak", slots > words - ANCHORS)
        hashed = F.when(F.col("weak"), F.xxhash64(F.lit(2), *w)).otherwise(F.xxhash64(F.lit(kind), *(template(x) for x in w)))
        rows = rows.select(*keys, F.lit(kind).alias("kind"), "at", "weak", hashed.alias("h"))
        # what a weak window of names holds is in the plain template, too
        parts.append(rows if kind == 0 else rows.where(~F.col("weak")))
    return parts[0].unionByName(parts[1])


def _words(df: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    return df.where(F.col(text_col).isNotNull()).select(*keys, *(marked_words(F.col(text_col), name == "named").alias(name) for name in TEMPLATES))


def _laid(item: str, doc: str, shift: Column, words: int) -> tuple[Column, Column]:
    """Along one alignment: the item's windows found (their places), and the distinct pairs of values in them."""
    i, d = F.col(item), F.col(doc)
    same = F.transform(i, lambda x, k: F.coalesce(template(x) == template(F.get(d, k + shift)), F.lit(False)))
    last = F.size(i) - words
    full = F.transform(F.array(same), lambda e: F.filter(F.sequence(F.lit(0), last), lambda b: F.forall(F.slice(e, b + 1, words), lambda x: x)))[0]
    covered = F.transform(F.array(full), lambda f: F.array_distinct(F.flatten(F.transform(f, lambda b: F.sequence(b, b + (words - 1))))))[0]
    held = F.filter(covered, lambda k: is_slot(F.get(i, k)))
    return full, F.array_distinct(F.transform(held, lambda k: F.struct(F.get(i, k).alias("x"), F.get(d, k + shift).alias("y"))))


def contaminated(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, th, item_id, matched, windows, changed for each document and item of whose windows it holds ``share``.

    ``matched`` counts the item's windows found, ``windows`` all of them; ``changed`` tells that a value differs.
    They are of the plain template if that suffices, else of the named one. Along one alignment the values of a document
    and an item must correspond one to one; if they don't, only windows without placeholders count there.

    Null texts, and texts and items of fewer words than a window, match nothing. Documents alike in
    id and text (``th`` is the text's hash) are one; null ids are ids like any other, so a document without an id
    shows up with a null. Items alike in id and text are one item; of different texts under one id each is looked
    for, and the best found counts. Other columns are ignored; an empty table on either side gives no rows.
    """
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).withColumn("ih", F.xxhash64("text"))
    items = written(_words(items, ["item_id", "ih"], "text").dropDuplicates(["item_id", "ih"]))
    wins = written(_windows(items, ["item_id", "ih"], words))
    small = wins.count() <= BROADCAST_WINDOWS
    sized = (lambda df: F.broadcast(df)) if small else (lambda df: df)
    # windows that an item holds several times are one row, with their places
    right = wins.groupBy("kind", "weak", "h", "item_id", "ih").agg(F.collect_list("at").alias("bs")).withColumnRenamed("kind", "b_kind").withColumnRenamed("weak", "b_weak")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("th", F.xxhash64("text"))
    pair = ["doc_id", "th", "item_id", "ih"]
    hits = _windows(_words(rows, ["doc_id", "th"], "text"), ["doc_id", "th"], words).join(sized(right.withColumnRenamed("h", "bh")), F.col("h") == F.col("bh"))
    hits = written(hits.select(*pair, "kind", "weak", "h", "at", "bs"))
    # a weak window is known by its values alone; others vote for the alignments that their places allow
    weak = hits.where("weak").select(*pair, "h", "bs").groupBy(*pair, "h").agg(F.first("bs").alias("bs"))
    weak = weak.groupBy(*pair).agg(F.flatten(F.collect_list("bs")).alias("valued"), F.lit(None).cast("array<int>").alias("a0"), F.lit(None).cast("array<int>").alias("a1"), F.sum(F.size("bs")).alias("n"))
    lines = hits.where("NOT weak").select(*pair, "kind", F.explode(F.transform("bs", lambda b: F.col("at") - b)).alias("shift")).groupBy(*pair, "kind", "shift").agg(F.count(F.lit(1)).alias("n"))
    lines = lines.groupBy(*pair).agg(
        F.lit(None).cast("array<int>").alias("valued"), *(F.collect_list(F.when(F.col("kind") == k, F.col("shift"))).alias(f"a{k}") for k in (0, 1)), F.sum("n").alias("n")
    )
    none = F.array().cast("array<int>")
    found = lines.unionByName(weak).groupBy(*pair).agg(*(F.coalesce(F.first(c, ignorenulls=True), none).alias(c) for c in ("valued", "a0", "a1")), F.sum("n").alias("n"))
    # an item's weak windows can come with the alignments, all its others are hits
    soft = wins.groupBy("item_id", "ih").agg(F.count(F.when(F.col("weak"), 1)).alias("soft"))
    shape = items.join(soft, ["item_id", "ih"]).select("item_id", "ih", F.col("plain").alias("i0"), F.col("named").alias("i1"), "soft")
    least = F.least(*(F.when(F.size(c) >= words, F.ceil((F.size(c) - (words - 1)) * share)) for c in ("i0", "i1")))
    names = F.size(F.filter("i1", is_slot)) * words
    found = written(found.join(sized(shape), ["item_id", "ih"]).where(F.col("n") + F.col("soft") + names >= least))
    sides = _words(rows.join(found.select("doc_id", "th").distinct().withColumnRenamed("doc_id", "_d").withColumnRenamed("th", "_t"), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t")), "left_semi").dropDuplicates(["doc_id", "th"]), ["doc_id", "th"], "text")
    sides = sides.select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), F.col("plain").alias("d0"), F.col("named").alias("d1"))
    full = found.join(sides, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t")))
    for k in (0, 1):

        def line(s: Column) -> Column:
            found_here, pairs = _laid(f"i{k}", f"d{k}", s, words)  # noqa: B023
            return F.struct(found_here.alias("full"), pairs.alias("pairs"))

        full = full.withColumn(f"l{k}", F.when(F.size(f"i{k}") >= words, F.transform(F.array_distinct(f"a{k}"), line)))
        one = lambda p, side: F.size(F.array_distinct(F.transform(p, lambda q: q[side]))) == F.size(p)
        fits = lambda x: one(x["pairs"], "x") & one(x["pairs"], "y")
        free = lambda x: F.filter(x["full"], lambda b: F.forall(F.slice(f"i{k}", b + 1, words), lambda y: ~is_slot(y)))  # noqa: E731, B023
        held = F.flatten(F.transform(f"l{k}", lambda x: F.when(fits(x), x["full"]).otherwise(free(x))))
        full = full.withColumn(f"m{k}", F.size(F.array_union(held, F.col("valued")) if k == 0 else F.array_distinct(held)).cast("long"))
        full = full.withColumn(f"c{k}", F.exists(f"l{k}", lambda x: fits(x) & F.exists(x["pairs"], lambda p: p["x"] != p["y"])))
        full = full.withColumn(f"w{k}", (F.size(f"i{k}") - (words - 1)).cast("long"))
    enough = lambda k: F.coalesce((F.col(f"w{k}") > 0) & (F.col(f"m{k}") >= F.ceil(F.col(f"w{k}") * share)), F.lit(False))
    either = lambda c, to: F.when(enough(0), F.col(f"{c}0")).otherwise(F.col(f"{c}1")).alias(to)
    out = full.where(enough(0) | enough(1)).select("doc_id", "th", "item_id", F.struct(either("m", "matched"), either("w", "windows"), F.coalesce(either("c", "changed"), F.lit(False)).alias("changed")).alias("x"))
    return out.groupBy("doc_id", "th", "item_id").agg(F.max("x").alias("x")).select("doc_id", "th", "item_id", "x.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that :func:`contaminated` does not report."""
    bad = contaminated(docs, benchmark, words, share, id_col, text_col).select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).distinct()
    return docs.join(bad, F.col(id_col).cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(text_col) == F.col("_th")), "left_anti")
