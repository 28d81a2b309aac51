"""Markdown headings and the sections they open.

Two ways lead to the same table (keys, level, title, start_line, end_line): :func:`sections`
works on lines with SQL functions and knows ATX and setext headings outside fences and indented
code; :func:`parsed_sections` runs a block parser over each document and also sees
headings in block quotes and lists and skips HTML blocks.

Sections are flat: each ends where the next heading starts, whatever the levels are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators.lines import line_count

ATX = r"^ {0,3}(#{1,6})(?:[ \t]+|$)"
ATX_CLOSE = r"(?:^|[ \t]+)#+[ \t]*$"
FENCE = r"^ {0,3}(```+|~~~+)"
UNDERLINE = r"^ {0,3}(=+|-+)[ \t]*$"
INLINE = r"[*_`]+"


def heading_title(line: Column) -> Column:
    """The text of an ATX heading: closing marks go, marks of emphasis and code part words as the parser's events do."""
    bare = F.regexp_replace(F.regexp_replace(line, ATX, ""), ATX_CLOSE, "")
    return T.collapse(F.regexp_replace(bare, INLINE, " "))


def with_ends(starts: DataFrame, keys: list[str], last_line: str = "total_lines") -> DataFrame:
    """Adds end_line: the line before the next heading, or the document's last line, and never before the start."""
    w = Window.partitionBy(*keys).orderBy("start_line")
    end = F.coalesce(F.lead("start_line").over(w) - 1, F.col(last_line))
    return starts.withColumn("end_line", F.greatest(end, F.col("start_line")))


def sections(docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """Sections by SQL functions. Blank or null documents have none."""
    text = F.col(text_col)
    lines = docs.where(text.isNotNull() & ~T.is_blank(text)).select(*keys, line_count(text).alias("total_lines"), F.posexplode(F.split(text, "\r?\n", -1)).alias("n", "line"))
    w = Window.partitionBy(*keys).orderBy("n")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    is_fence = F.col("line").rlike(FENCE)
    lines = lines.withColumn("fence", is_fence).withColumn("fenced", (F.coalesce(F.sum(is_fence.cast("int")).over(before), F.lit(0)) % 2 == 1) | is_fence)
    level = F.when(~F.col("fenced") & F.col("line").rlike(ATX), F.length(F.regexp_extract("line", ATX, 1)))
    lines = lines.withColumn("level", level)
    plain = ~F.col("fenced") & F.col("level").isNull() & ~T.is_blank(F.col("line")) & ~F.col("line").rlike(r"^ {0,3}([>]|[-+*][ \t]|\d{1,9}[.)][ \t])")
    lines = lines.withColumn("rule", plain & F.col("line").rlike(UNDERLINE)).withColumn("words", plain & ~F.col("line").rlike(UNDERLINE))
    # the paragraph above an underline: lines of words back to the last other line
    opens = F.coalesce(F.max(F.when(~F.col("words"), F.col("n"))).over(before), F.lit(-1)) + 1
    lines = lines.withColumn("from", opens).withColumn("above", F.lag("words").over(w))
    para = Window.partitionBy(*keys, "from", "words").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    atx = lines.where("level IS NOT NULL").select(*keys, "total_lines", "level", heading_title(F.col("line")).alias("title"), (F.col("n") + 1).cast("int").alias("start_line"))
    ruled = lines.where("rule AND above").select(*keys, "total_lines", "from", F.when(F.col("line").rlike("="), 1).otherwise(2).alias("level"))
    paras = lines.where("words").groupBy(*keys, "from").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), " ").alias("title"))
    setext = ruled.join(paras, [*keys, "from"]).where(~F.col("title").rlike(r"^(?: {4}|\t)"))
    setext = setext.select(*keys, "total_lines", "level", T.collapse(F.regexp_replace("title", INLINE, " ")).alias("title"), (F.col("from") + 1).cast("int").alias("start_line"))
    return with_ends(atx.unionByName(setext), keys).select(*keys, "level", "title", "start_line", F.col("end_line").cast("int").alias("end_line"))


_ATX, _FENCE, _UNDERLINE = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*))?$"), re.compile(r" {0,3}(`{3,}|~{3,})(.*)$"), re.compile(r" {0,3}(=+|-+)[ \t]*$")
_QUOTE, _ITEM = re.compile(r" {0,3}> ?"), re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])( +|\t|$)")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_HTML = re.compile(r" {0,3}<(?:(!--)|(script|pre|style|textarea)\b|/?[a-z][a-z0-9-]*[\s/>]|/?[a-z][a-z0-9-]*$|[?!])", re.IGNORECASE)
_LINK = re.compile(r"!?\[([^\[\]]*)\](?:\([^()]*\)|\[[^\[\]]*\])?")
_SPAN, _ESCAPE, _TAG = re.compile(r"(`+)(.+?)\1(?!`)"), re.compile(r"\\([!-/:-@\[-`{-~])"), re.compile(r"(</?[A-Za-z][^<>]*>)")


def heading_text(raw: str) -> str:
    """The text of a heading's inline content, a blank between its parts."""
    raw = _SPAN.sub(lambda m: " " + m[2].replace("*", "\x00").replace("_", "\x01") + " ", raw)
    raw = _ESCAPE.sub(lambda m: {"*": "\x00", "_": "\x01"}.get(m[1], m[1]), raw)
    raw = _TAG.sub(r" \1 ", _LINK.sub(r" \1 ", raw))
    raw = re.sub(r"\*+|(?<!\w)_+(?=\S)|(?<=\S)_+(?!\w)", " ", raw)
    return " ".join(raw.replace("\x00", "*").replace("\x01", "_").split())


def headings(text: str) -> list[tuple[int, str, int]]:
    """(level, title, line) of the headings of a CommonMark document, in order.

    Containers are peeled off a line at a time: the block quotes and list items that are open and that the line
    continues. What is left is read as a heading, fence, HTML, code or paragraph line.
    """
    out: list[tuple[int, str, int]] = []
    para: list[str] = []
    para_at, para_in = 0, ()
    fence: tuple[str, int, tuple] | None = None
    html: str | None = None
    open_: list[tuple[str, int]] = []
    lines = text.split("\n")
    for n, line in enumerate(lines, 1):
        rest = line.rstrip("\r").expandtabs(4)
        kept: list[tuple[str, int]] = []
        for kind, width in open_:
            if kind == "quote" and (m := _QUOTE.match(rest)):
                rest = rest[m.end() :]
            elif kind == "item" and (not rest.strip() or rest.startswith(" " * width)):
                rest = rest[width:] if rest.strip() else ""
            else:
                break
            kept.append((kind, width))
        lazy = len(kept) < len(open_)
        if fence is not None:
            if len(kept) < len(fence[2]):
                fence = None
            else:
                m = _FENCE.match(rest)
                if m and m[1][0] == fence[0] and len(m[1]) >= fence[1] and not m[2].strip():
                    fence = None
                continue
        if html is not None:
            if (html == "blank" and not rest.strip()) or (html != "blank" and html in rest.lower()):
                html = None
            continue
        new = False
        while rest.strip() and not rest.startswith("    "):
            if m := _QUOTE.match(rest):
                kept.append(("quote", 0))
            elif not _RULE.match(rest) and not (_UNDERLINE.match(rest) and para and tuple(kept) == para_in) and (m := _ITEM.match(rest)) and not (
                para and not new and not lazy and (not rest[m.end() :].strip() or (m[2][0].isdigit() and m[2][:-1] != "1"))
            ):
                pad = m.end() if 0 < len(m[3]) <= 4 and rest[m.end() :].strip() else m.end(2) + 1
                kept.append(("item", pad))
                m = re.match(r".{%d}" % min(pad, len(rest)), rest)
            else:
                break
            rest, new = rest[m.end() :], True
        if new:
            para = []
        if not rest.strip():
            para, open_ = [], kept
            continue
        if para and lazy and not new and not (_ATX.match(rest) or _FENCE.match(rest) or _RULE.match(rest) or _HTML.match(rest)):
            if not _UNDERLINE.match(rest) or "=" in rest:
                para.append(rest)  # a paragraph goes on without its containers' marks
                continue
        open_ = kept
        if rest.startswith("    "):
            if para:
                para.append(rest)
            continue
        if m := _ATX.match(rest):
            body = re.sub(r"(?:^|[ \t]+)#+[ \t]*$", "", m[2] or "")
            out.append((len(m[1]), heading_text(body), n))
            para = []
        elif (m := _FENCE.match(rest)) and not (m[1][0] == "`" and "`" in m[2]):
            fence, para = (m[1][0], len(m[1]), tuple(kept)), []
        elif para and tuple(kept) == para_in and (m := _UNDERLINE.match(rest)):
            out.append((1 if m[1][0] == "=" else 2, heading_text(" ".join(para)), para_at))
            para = []
        elif _RULE.match(rest):
            para = []
        elif (m := _HTML.match(rest)) and not (para and not (m[1] or m[2])):
            ends = "-->" if m[1] else f"</{m[2].lower()}" if m[2] else "blank"
            html, para = (None if ends != "blank" and ends in rest.lower() else ends), []
        else:
            if not para:
                para_at, para_in = n, tuple(kept)
            para.append(rest)
    return out


def section_rows(text: str) -> list[tuple[int, str, int, int]]:
    """(level, title, start_line, end_line) of a document's sections."""
    if not text or not text.strip():
        return []
    total = text.count("\n") + (not text.endswith("\n"))
    found = sorted(headings(text), key=lambda h: h[2])
    ends = [h[2] - 1 for h in found[1:]] + [total]
    return [(level, title, at, max(end, at)) for (level, title, at), end in zip(found, ends, strict=False)]


def parsed_sections(docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """Sections by the block parser, a row at a time: no shuffle."""
    schema = "array<struct<level: int, title: string, start_line: int, end_line: int>>"

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = ("level", "title", "start_line", "end_line")
        for texts in batches:
            yield pd.Series([[dict(zip(names, r, strict=True)) for r in section_rows(t)] if isinstance(t, str) else [] for t in texts], dtype=object)

    parse = F.pandas_udf(run, schema)
    return docs.select(*keys, F.explode(parse(F.col(text_col))).alias("s")).select(*keys, "s.level", "s.title", "s.start_line", "s.end_line")
