"""The single-request front: one repository or document at a time, errors as exceptions."""

from __future__ import annotations

import os
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from docloom.config import DictionaryLoadError, GitOperationError, InvalidInput, ModelInferenceError, ModelLoadError, ReportOptions, SummarizeError, SummaryConfig
from docloom.functions import text as T
from docloom.functions import tokenizers
from docloom.operators import changes, markdown, summarize, synthesis
from docloom.plans import report
from docloom.sources import files, gitlog


@dataclass(frozen=True)
class EngineConfig:
    """``model``: of :func:`docloom.operators.synthesis.synthesizer`; without one the stand-in answers."""

    model_bytes: bytes
    dictionary_bytes: bytes
    settings_bytes: bytes = b""
    summary: SummaryConfig = SummaryConfig()
    model: object = None


def _root(options: ReportOptions) -> str:
    """The repository's absolute path: executors have other working folders."""
    return os.path.abspath(options.repo_path.strip())


class Engine:
    def __init__(self, spark: SparkSession, config: EngineConfig):
        if not config.dictionary_bytes:
            raise DictionaryLoadError("the dictionary is empty")
        if not config.model_bytes:
            raise ModelLoadError("the model is empty")
        self.spark, self.config = spark, config
        tokenizers.get(config.summary.tokenizer)
        gitlog.register(spark)

    # -- repositories

    def commits(self, options: ReportOptions, now: int | None = None) -> DataFrame:
        options.validate()
        gitlog.check_repository(options.repo_path)
        return self._git(options, "commits", now)

    def _git(self, options: ReportOptions, table: str, now: int | None) -> DataFrame:
        since = max((int(time.time()) if now is None else now) - options.days_since * 86400, 0)
        return self.spark.read.format("gitlog").option("table", table).option("since", since).load(_root(options))

    def added_lines(self, options: ReportOptions, now: int | None = None) -> DataFrame:
        """repo, path, line_number, content of the window's additions."""
        options.validate()
        gitlog.check_repository(options.repo_path)
        lines = self._git(options, "added_lines", now)
        return changes.keep_added(lines, F.array(*map(F.lit, options.extensions())))

    def contextual_changes(self, options: ReportOptions, now: int | None = None) -> DataFrame:
        """Additions by file and section of the current files; a missing or unreadable file is an error."""
        added = self.added_lines(options, now)
        tree, missing = changes.working_files(added, files.touched_files(added).where("valid").select("repo", "path", "text"))
        if gone := [r["path"] for r in missing.limit(5).collect()]:
            raise FileNotFoundError(f"changed files can't be read: {gone}")
        return changes.correlate(added, markdown.parsed_sections(tree, ["repo", "path"]))

    def _request(self, options: ReportOptions) -> DataFrame:
        row = (_root(options), options.repo_path, options.days_since, options.custom_prompt)
        return self.spark.createDataFrame([row], "repo string, repo_path string, days_since int, custom_prompt string")

    def _run(self, df: DataFrame) -> Row:
        try:
            return df.first()
        except Exception as e:
            if "GitOperationError" in str(e):
                raise GitOperationError(str(e).split("GitOperationError", 1)[1][:500]) from e
            raise

    def generate_git_report(self, options: ReportOptions, now: int | None = None) -> str:
        return self._run(report.git_reports(self._request(options), self.added_lines(options, now)))["report"]

    def run_git_native_rag(self, options: ReportOptions, now: int | None = None) -> Row:
        """kind, prompt, summary, message; invalid options give a fallback, too."""
        try:
            found = self.contextual_changes(options, now)
        except InvalidInput as e:
            told = f"GitNativeRAG request was invalid for `{options.repo_path.strip()}`: {e}"
            return Row(repo=options.repo_path.strip(), kind=report.FALLBACK, prompt=None, summary=None, message=told)
        return self._run(report.rag_reports(self._request(options), found, len(self.config.model_bytes), self.config.model))

    # -- documents (the messages of InvalidInput are fixed values)

    def summarize_with_details(self, text: str) -> tuple[list[str], str]:
        if not text.strip():
            raise InvalidInput("summarize_document received empty text")
        docs = self.spark.createDataFrame([(0, text)], "doc_id long, text string")
        row = summarize.summarize(docs, len(self.config.model_bytes), self.config.summary, model=self.config.model).first()
        if row["status"] in (summarize.NOT_CONVERGED, summarize.NO_CANDIDATES):
            raise SummarizeError(row["status"])
        if row["status"] != summarize.OK:
            raise ModelInferenceError(row["status"])
        return list(row["extracted_sentences"]), row["synthesized_summary"]

    def summarize_document(self, text: str) -> str:
        return self.summarize_with_details(text)[1]

    def _one(self, text: str, expression) -> object:
        return self.spark.createDataFrame([(text,)], "text string").select(expression(F.col("text")).alias("x")).first()["x"]

    def synthesize_summary(self, sentences: list[str]) -> str:
        if not sentences:
            raise InvalidInput("synthesize_summary requires at least one sentence")
        if not any(s.strip() for s in sentences):
            raise InvalidInput("synthesize_summary received only blank sentences")
        prompt = "\n".join(s.strip() for s in sentences if s.strip())
        if self.config.model is not None:
            out = self._one(prompt, self.config.model)
            if out["error"]:
                raise ModelInferenceError(out["error"])
            return out["text"]
        n = len(self.config.model_bytes)
        got = self._one(prompt, lambda c: synthesis.mock(c, n))
        if got is None:
            raise ModelInferenceError("the model failed")
        return got

    def extract_important_sentences(self, text: str, count: int) -> list[str]:
        if count == 0:
            return []
        if not text.strip():
            raise InvalidInput("extract_important_sentences received empty text")
        return list(self._one(text, lambda c: T.first_sentences(c, count)))

    def tokenize_sentence(self, text: str) -> list[Row]:
        return list(self._one(text, tokenizers.get(self.config.summary.tokenizer)))
