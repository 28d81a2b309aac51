"""The row-wise operators over streams: they keep no state, so a stream is a batch after another.

Summaries and line attribution read a document or a file's row alone. Aggregates over a whole history
(reports, prompts) are run per batch by ``foreachBatch``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from docloom.config import SummaryConfig
from docloom.operators import markdown, summarize


def summaries(documents: DataFrame, model_bytes: int = 5, config: SummaryConfig = SummaryConfig(), id_col: str = "doc_id", text_col: str = "text", model=None) -> DataFrame:
    """A stream of documents becomes a stream of summaries."""
    return summarize.summarize(documents, model_bytes, config, id_col, text_col, model)


def sections(documents: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """A stream of Markdown files becomes a stream of their sections."""
    return markdown.parsed_sections(documents, keys, text_col)


def each_batch(stream: DataFrame, plan: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """A writer that runs a batch plan (such as a report) on every batch and hands the result with the batch's number to the sink,
    which should write it under that number: a batch that is run again then replaces itself."""
    return stream.writeStream.foreachBatch(lambda df, number: sink(plan(df), number))
