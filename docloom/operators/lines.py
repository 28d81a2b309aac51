"""Lines of text documents and byte offsets.

Line numbers are 1-based, offsets count UTF-8 bytes. A line feed at the end of a text adds no line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def line_count(text: Column) -> Column:
    """Lines of a text: 0 for the empty one."""
    n = F.size(F.split(text, "\n", -1)) - F.endswith(text, F.lit("\n")).cast("int")
    return F.when(text == "", F.lit(0)).otherwise(n)


def line_starts(text: Column) -> Column:
    """Byte offsets at which lines start: 0, then behind every line feed."""
    parts = F.split(text, "\n", -1)
    start = F.struct(F.array(F.lit(0).cast("long")).alias("at"), F.lit(0).cast("long").alias("end"))

    def step(s: Column, p: Column) -> Column:
        end = s["end"] + F.octet_length(p) + 1
        return F.struct(F.concat(s["at"], F.array(end)).alias("at"), end.alias("end"))

    return F.aggregate(F.slice(parts, F.lit(1), F.size(parts) - 1), start, step)["at"]


def line_of(starts: Column, offset: Column, length: Column) -> Column:
    """The line that holds a byte offset; the text's length itself is allowed, anything beyond gives null."""
    found = F.size(F.filter(starts, lambda s: s <= offset))
    # a start at the very end, behind a last line feed, opens no line
    real = F.size(F.filter(starts, lambda s: s < length))
    return F.when((offset >= 0) & (offset <= length), F.greatest(F.least(found, real), F.lit(1)))


def line_span(starts: Column, start: Column, end: Column, length: Column) -> Column:
    """Struct (first, last) of the lines of a byte range; an empty range is on one line, a reversed one gives null."""
    last = F.when(start == end, start).otherwise(F.least(end, length) - 1)
    both = F.struct(line_of(starts, start, length).alias("first"), line_of(starts, last, length).alias("last"))
    return F.when((start <= end) & both["first"].isNotNull(), both)


def explode_lines(docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """keys, line_number, content: a row for each line."""
    parts = F.split(F.col(text_col), "\n", -1)
    return docs.select(*keys, F.posexplode(F.slice(parts, F.lit(1), line_count(F.col(text_col)))).alias("n", "content")).select(*keys, (F.col("n") + 1).alias("line_number"), "content")


def exploded_starts(docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """keys, line_number, byte_start, next_start: a row for each line, for joins on offsets.

    Works from the lines' own lengths with one running sum a document; other than
    :func:`line_starts` its cost is linear in a document's lines.
    """
    from pyspark.sql import Window

    lines = docs.select(*keys, F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("n", "content"))
    w = Window.partitionBy(*keys).orderBy("n")
    end = F.sum(F.octet_length("content").cast("long") + 1).over(w)
    out = lines.select(*keys, (F.col("n") + 1).alias("line_number"), (end - F.octet_length("content") - 1).alias("byte_start"), end.alias("next_start"))
    return out
