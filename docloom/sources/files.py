"""Text tables in files: documents by path, tab-separated records, JSON lines."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as T


def working_tree(spark: SparkSession, repo: str, pattern: str = "*.{md,markdown}") -> DataFrame:
    """repo, path (relative), text, valid: the files of a working tree; ``valid`` is false where a file isn't UTF-8.

    Files and folders whose names begin with a dot or an underscore are passed over, as by all of Spark's file sources.
    """
    root = repo.strip().rstrip("/")
    root = root if "://" in root else os.path.abspath(root)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return files.select(F.lit(root).alias("repo"), F.col("path").substr(F.instr("path", root) + F.lit(len(root) + 1), F.length("path")).alias("path"), text.alias("text"), text.isNotNull().alias("valid"))


def touched_files(added: DataFrame) -> DataFrame:
    """repo, path, text, valid: the current files of the distinct (repo, path) of ``added``, read where the rows are.

    A path is taken as it is, whatever its folders are called; ``repo`` must lie on storage that all executors reach. ``valid``
    is false, and the text null, where a file is missing, unreadable or no UTF-8.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts: list[str | None] = []
            for repo, path in zip(pdf["repo"], pdf["path"], strict=True):
                try:
                    with open(os.path.join(repo, path), "rb") as f:
                        texts.append(f.read().decode("utf-8"))
                except (OSError, UnicodeDecodeError):
                    texts.append(None)
            yield pd.DataFrame({"repo": pdf["repo"], "path": pdf["path"], "text": texts, "valid": [t is not None for t in texts]})

    return added.select("repo", "path").distinct().mapInPandas(run, "repo string, path string, text string, valid boolean")


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """source_id, text of ``id<TAB>text`` lines, split at the first tab; blank lines are passed over, ``valid`` is false for lines without a tab."""
    lines = spark.read.text(path).where(~T.is_blank(F.col("value")))
    parts = F.split("value", "\t", 2)
    return lines.select(F.get(parts, F.lit(0)).alias("source_id"), F.get(parts, F.lit(1)).alias("text"), (F.size(parts) == 2).alias("valid"))


def write_jsonl(df: DataFrame, path: str) -> None:
    """A JSON object a line."""
    df.write.json(path)


def write_summaries(summaries: DataFrame, path: str) -> None:
    """source_id, extracted_sentences, synthesized_summary of :func:`docloom.operators.summarize.summarize`, as JSON lines."""
    write_jsonl(summaries.select(F.col("doc_id").alias("source_id"), "extracted_sentences", "synthesized_summary"), path)
