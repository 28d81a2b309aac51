"""Added lines of a commit history, and the sections they belong to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T

NO_HEADING = "(no heading)"


def take_while_recent(commits: DataFrame, since: Column, repo: str = "repo", ts: str = "commit_ts", ordinal: str = "walk_ordinal") -> DataFrame:
    """The commits before the first one, in walk order, that is older than ``since``.

    Not a filter: a newer commit behind an older one in the walk is left out. The first old
    ordinal of a repository is an aggregate that is combined before its shuffle, so a repository
    with very many commits is not one task.
    """
    stops = commits.groupBy(F.col(repo).alias("_repo")).agg(F.min(F.when(F.col(ts) < since, F.col(ordinal))).alias("_stop"))
    joined = commits.join(stops, F.col(repo).eqNullSafe(F.col("_repo")))
    return joined.where(F.col("_stop").isNull() | (F.col(ordinal) < F.col("_stop"))).drop("_repo", "_stop")


def keep_added(diff_lines: DataFrame, extensions: Column) -> DataFrame:
    """Lines that were added to text files with one of the extensions, without their line ends.

    Reads repo, new_path, old_path, is_binary, origin, line_number, content.
    """
    path = F.coalesce("new_path", "old_path")
    kept = diff_lines.where(~F.col("is_binary") & (F.col("origin") == "+") & F.col("line_number").isNotNull() & T.matches_extension(path, extensions))
    return kept.select("repo", path.alias("path"), "line_number", T.strip_line_end(F.col("content")).alias("content"))


def by_file(added: DataFrame, keys: tuple[str, ...] = ("repo", "path")) -> DataFrame:
    """keys and added_lines: all added lines of a file over all commits, repeats included, by number and content."""
    return added.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("line_number", "content"))).alias("added_lines"))


def first_lines(added: DataFrame, limit: int, keys: tuple[str, ...] = ("repo", "path")) -> DataFrame:
    """keys, n_lines and the first ``limit`` lines of each file: no file's lines are gathered beyond the limit."""
    w = Window.partitionBy(*keys).orderBy("line_number", "content")
    top = added.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= limit)
    top = top.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_rn", "line_number", "content"))), lambda x: F.struct(x["line_number"].alias("line_number"), x["content"].alias("content"))).alias("added_lines"))
    return top.join(added.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_lines")), list(keys))


def attribute(added: DataFrame, sections: DataFrame, keys: tuple[str, ...] = ("repo", "path")) -> DataFrame:
    """Adds start_line, section_title and section_level: the last section that starts at or before a line and reaches it; nulls if none does.

    A file's sections are gathered into one sorted array, so the join is an equality join on the file,
    large sides can be split where they are skewed, and a line never multiplies.
    """
    own = sections.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("start_line", "end_line", "title", "level")), asc=False).alias("_sections"))
    line = F.col("line_number")
    hit = F.get(F.filter("_sections", lambda s: (s["start_line"] <= line) & (line <= F.greatest(s["end_line"], s["start_line"]))), F.lit(0))
    out = added.join(own, list(keys), "left").withColumn("_hit", hit)
    return out.select(
        *added.columns, F.coalesce(F.col("_hit.start_line"), F.lit(0)).alias("start_line"), F.col("_hit.title").alias("section_title"), F.col("_hit.level").alias("section_level")
    )


def correlate(added: DataFrame, sections: DataFrame, keys: tuple[str, ...] = ("repo", "path")) -> DataFrame:
    """A row for each file and section with added lines: keys, start_line (0 for none), section_title, section_level, added_lines in order."""
    rows = attribute(added, sections, keys)
    return rows.groupBy(*keys, "start_line", "section_title", "section_level").agg(F.sort_array(F.collect_list(F.struct("line_number", "content"))).alias("added_lines"))


def working_files(added: DataFrame, files: DataFrame, keys: tuple[str, ...] = ("repo", "path")) -> tuple[DataFrame, DataFrame]:
    """The current files (keys, text) that have additions, and the keys of those that are missing."""
    touched = added.select(*keys).distinct()
    return files.join(touched, list(keys), "left_semi"), touched.join(files, list(keys), "left_anti")
