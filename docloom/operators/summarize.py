"""Hybrid summaries: the highest ranking sentences in document order, and a text synthesized from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.config import SummaryConfig
from docloom.functions import text as T
from docloom.operators import synthesis
from docloom.operators.lexrank import ranked, selected

# The prompt's text.
INTRO = "以下の重要文をもとに90文字程度の要約を出力してください。文体は敬体でまとめてください。\n"
ORIGINAL = "\n原文:\n"
OK, BLANK, NOT_CONVERGED, NO_CANDIDATES = "OK", "INVALID_INPUT", "NOT_CONVERGED", "NO_CANDIDATES"


def synthesis_prompt(sentences: Column, original: Column) -> Column:
    numbered = F.transform(sentences, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s, F.lit("\n")))
    return F.concat(F.lit(INTRO), F.array_join(numbered, ""), F.lit(ORIGINAL), T.trim(original))


def extract(docs: DataFrame, config: SummaryConfig = SummaryConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, status, extracted, iterations: the chosen sentences in document order, as an array of (position, text).

    A document without a sentence to rank falls back to its first sentence that isn't noise. A blank
    one, one whose scores don't converge and one without any sentence get a status other than OK.
    """
    trimmed = docs.select(F.col(id_col).alias("doc_id"), T.trim(F.col(text_col)).alias("text"))
    rows = ranked(trimmed, config)
    take = lambda x: F.struct(F.get(F.col("nodes"), x["k"])["position"].alias("position"), F.get(F.col("nodes"), x["k"])["text"].alias("text"))
    rows = rows.withColumn("chosen", F.sort_array(F.transform(selected(F.col("order"), config), take)))
    fallback = T.fallback_sentence(F.col("text"))
    rows = rows.withColumn("fallback", F.when(F.size("chosen") == 0, fallback))
    status = (
        F.when(F.col("text").isNull() | T.is_blank(F.col("text")), F.lit(BLANK))
        .when(~F.col("result.converged"), F.lit(NOT_CONVERGED))
        .when((F.size("chosen") == 0) & F.col("fallback").isNull(), F.lit(NO_CANDIDATES))
        .otherwise(F.lit(OK))
    )
    none = F.array().cast("array<struct<position: int, text: string>>")
    kept = F.when(F.size("chosen") > 0, F.col("chosen")).when(F.col("fallback").isNotNull(), F.array("fallback")).otherwise(none)
    return rows.select("doc_id", "text", status.alias("status"), F.when(status == OK, kept).otherwise(none).alias("extracted"), F.col("result.iterations").alias("iterations"))


def summarize(docs: DataFrame, model_bytes: int = 5, config: SummaryConfig = SummaryConfig(), id_col: str = "doc_id", text_col: str = "text", model=None) -> DataFrame:
    """doc_id, status, extracted_sentences, prompt, synthesized_summary. ``model``: of :func:`synthesis.synthesizer`; the stand-in without one."""
    rows = extract(docs, config, id_col, text_col)
    sentences = F.transform("extracted", lambda x: x["text"])
    rows = rows.select("doc_id", "status", sentences.alias("extracted_sentences"), F.when(F.col("status") == OK, synthesis_prompt(sentences, F.col("text"))).alias("prompt"))
    if model is None:
        failed = synthesis.mock_status(F.col("prompt"))
        return rows.select(
            "doc_id", F.when((F.col("status") == OK) & failed.isNotNull(), failed).otherwise(F.col("status")).alias("status"), "extracted_sentences", "prompt",
            synthesis.mock(F.col("prompt"), model_bytes).alias("synthesized_summary"),
        )
    rows = rows.withColumn("_out", model(F.col("prompt")))
    return rows.select(
        "doc_id", F.when((F.col("status") == OK) & F.col("_out.error").isNotNull(), F.col("_out.error")).otherwise(F.col("status")).alias("status"),
        "extracted_sentences", "prompt", F.col("_out.text").alias("synthesized_summary"),
    )
