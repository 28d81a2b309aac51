"""Text synthesis: a deterministic stand-in as an expression, or any callable behind a pandas UDF."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions import text as T

INVALID, FAILED = "INVALID_INPUT", "MODEL_INFERENCE_ERROR"


def mock_status(prompt: Column) -> Column:
    """Null for a prompt that the stand-in answers: blank ones are invalid, and the word ``raise`` is an error."""
    return F.when(prompt.isNull() | T.is_blank(prompt), F.lit(INVALID)).when(T.ascii_lower(T.trim(prompt)) == "raise", F.lit(FAILED))


def mock(prompt: Column, model_bytes: int | Column) -> Column:
    """``[mock-bytes:N]`` and the trimmed prompt; null where :func:`mock_status` isn't."""
    n = model_bytes if isinstance(model_bytes, Column) else F.lit(model_bytes)
    return F.when(mock_status(prompt).isNull(), F.concat(F.lit("[mock-bytes:"), n.cast("string"), F.lit("] "), T.trim(prompt)))


def synthesizer(model: Callable[[str], str]) -> Callable[[Column], Column]:
    """A function of a prompt column that gives struct (text, error). The model is sent to the executors and called once a row."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for prompts in batches:
            out = []
            for p in prompts:
                if not isinstance(p, str) or not p.strip():
                    out.append((None, INVALID))
                    continue
                try:
                    out.append((model(p), None))
                except Exception as e:  # a model's failure is a row's status
                    out.append((None, f"{FAILED}: {e}"))
            yield pd.DataFrame(out, columns=["text", "error"])

    return F.pandas_udf(run, "struct<text: string, error: string>")


def joined_sentences(sentences: Column) -> Column:
    """The non-blank sentences, trimmed, on lines of their own; null if there are none."""
    kept = F.filter(F.transform(sentences, T.trim), lambda s: s != "")
    return F.when(F.size(kept) > 0, F.array_join(kept, "\n"))
