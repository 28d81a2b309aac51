"""Activity reports and prompts from tables of additions and contextual changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import changes as C
from docloom.operators import synthesis

# The texts of reports and prompts.
MAX_LINES = 10
ROLE = "You are an AI assistant that reviews Git markdown changes and produces actionable insights.\n"
TASK = "Summarize the following contextualized changes. Focus on intent, potential impact, and highlight any documentation or testing gaps.\n\n"
GUIDANCE = "Additional Analyst Guidance:\n"
SYNTHESIZED, FALLBACK = "SYNTHESIZED", "FALLBACK"
INFERENCE_FAILED = "AIモデルでの推論（合成）中にエラーが発生しました"
INVALID_PROMPT = "無効な入力が指定されました: "


def diff_section(path: Column, lines: Column, n_lines: Column) -> Column:
    """A file's part of the report; ``lines`` holds the first MAX_LINES at least, ``n_lines`` counts all."""
    shown = F.transform(F.slice(lines, 1, MAX_LINES), lambda x: F.concat(F.lit("  +"), x["line_number"].cast("string"), F.lit(" "), x["content"]))
    more = F.concat(F.lit("  ... (+"), (n_lines - MAX_LINES).cast("string"), F.lit(" more lines)"))
    return F.concat(F.lit("### "), path, F.lit("\n"), F.array_join(F.when(n_lines > MAX_LINES, F.array_append(shown, more)).otherwise(shown), "\n"))


def no_changes(repo_path: Column, days: Column) -> Column:
    return F.concat(F.lit("No Markdown changes detected for `"), repo_path, F.lit("` in the last "), days.cast("string"), F.lit(" day(s)."))


def git_reports(requests: DataFrame, added: DataFrame) -> DataFrame:
    """repo, report for each row of requests (repo, repo_path, days_since). Only the lines that are shown are gathered."""
    files = C.first_lines(added, MAX_LINES)
    files = files.select("repo", "path", diff_section(F.col("path"), F.col("added_lines"), F.col("n_lines")).alias("section"))
    body = files.groupBy("repo").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("path", "section"))), lambda x: x["section"]), "\n\n").alias("body"))
    report = F.concat(F.lit("Git activity report for `"), F.col("repo_path"), F.lit("`\n\n"), F.col("body"))
    out = requests.select("repo", "repo_path", "days_since").join(body, "repo", "left")
    return out.select("repo", F.coalesce(report, no_changes(F.col("repo_path"), F.col("days_since"))).alias("report"))


def fallback_message(repo_path: Column, days: Column) -> Column:
    return F.concat(F.lit("No relevant Markdown additions detected for `"), T.trim(repo_path), F.lit("` within the last "), days.cast("string"), F.lit(" day(s)."))


def change_block(title: Column, level: Column, lines: Column) -> Column:
    head = F.concat(F.lit("  Section: "), F.coalesce(title, F.lit(C.NO_HEADING)), F.when(level.isNotNull(), F.concat(F.lit(" (level "), level.cast("string"), F.lit(")"))).otherwise(F.lit("")), F.lit("\n"))
    body = F.transform(lines, lambda x: F.concat(F.lit("    +"), x["line_number"].cast("string"), F.lit(" "), T.trim(x["content"]), F.lit("\n")))
    return F.concat(head, F.array_join(body, ""), F.lit("\n"))


def change_text(contextual: DataFrame) -> DataFrame:
    """repo, body: the changes of :func:`docloom.operators.changes.correlate`, by path and section."""
    blocks = contextual.select("repo", "path", "start_line", "section_title", "section_level", change_block(F.col("section_title"), F.col("section_level"), F.col("added_lines")).alias("block"))
    files = blocks.groupBy("repo", "path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start_line", "section_title", "section_level", "block"))), lambda x: x["block"]), "").alias("text"))
    files = files.select("repo", F.struct("path", F.concat(F.lit("File: "), F.col("path"), F.lit("\n"), F.col("text")).alias("text")).alias("f"))
    return files.groupBy("repo").agg(F.array_join(F.transform(F.sort_array(F.collect_list("f")), lambda x: x["text"]), "").alias("body"))


def prompt(repo_path: Column, days: Column, custom_prompt: Column, body: Column) -> Column:
    extra = F.when(custom_prompt.isNotNull() & ~T.is_blank(custom_prompt), F.concat(F.lit(GUIDANCE), T.trim(custom_prompt), F.lit("\n\n"))).otherwise(F.lit(""))
    head = F.concat(F.lit(ROLE), F.lit("Repository: "), T.trim(repo_path), F.lit("\nTime Window: Last "), days.cast("string"), F.lit(" day(s)\n\n"))
    return F.regexp_replace(F.concat(head, extra, F.lit(TASK), body), rf"[{T.SPACE}]+\z", "")


def rag_reports(requests: DataFrame, contextual: DataFrame, model_bytes: int = 5, model=None) -> DataFrame:
    """repo, kind, prompt, summary, message for each row of requests (repo, repo_path, days_since, custom_prompt).

    A repository without changes, and one whose prompt the model can't answer, gets a fallback message.
    """
    rows = requests.select("repo", "repo_path", "days_since", "custom_prompt").join(change_text(contextual), "repo", "left")
    path, days = F.col("repo_path"), F.col("days_since")
    rows = rows.withColumn("prompt", F.when(F.col("body").isNotNull(), prompt(path, days, F.col("custom_prompt"), F.col("body"))))
    if model is None:
        rows = rows.withColumn("error", F.when(F.col("prompt").isNotNull(), synthesis.mock_status(F.col("prompt")))).withColumn("summary", synthesis.mock(F.col("prompt"), model_bytes))
    else:
        rows = rows.withColumn("_out", model(F.col("prompt"))).withColumn("summary", F.col("_out.text")).withColumn("error", F.when(F.col("prompt").isNotNull(), F.col("_out.error")))
    told = F.when(F.startswith("error", F.lit(synthesis.FAILED)), F.lit(INFERENCE_FAILED)).otherwise(F.concat(F.lit(INVALID_PROMPT), F.col("error")))
    failed = F.concat(F.lit("GitNativeRAG could not produce a summary for `"), T.trim(path), F.lit("`: "), told)
    message = F.when(F.col("prompt").isNull(), fallback_message(path, days)).when(F.col("error").isNotNull(), failed)
    good = F.col("prompt").isNotNull() & F.col("error").isNull()
    return rows.select(
        "repo", F.when(good, SYNTHESIZED).otherwise(FALLBACK).alias("kind"), F.when(good, F.col("prompt")).alias("prompt"), F.when(good, F.col("summary")).alias("summary"), message.alias("message")
    )
