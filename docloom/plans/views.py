"""Tables of commits, Markdown documents and added lines made from the driver's tables, in Spark and in SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.operators.lines import explode_lines

DAYS = 7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def commits(spark: SparkSession, sf_dir: str, skewed: bool = False) -> DataFrame:
    """Events as commits: a user's events are a repository; the skewed walk follows ids, not times."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("repo"), F.col("event_id").alias("oid"), "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    order = [F.desc("oid")] if skewed else [F.desc("us"), F.desc("oid")]
    w = Window.partitionBy("repo").orderBy(*order)
    return rows.select("repo", "oid", F.floor(F.col("us") / 1_000_000).cast("long").alias("commit_ts"), (F.row_number().over(w) - 1).cast("long").alias("walk_ordinal"))


COMMITS_SQL = """
    SELECT user_id AS repo, event_id AS oid, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS commit_ts,
           row_number() OVER (PARTITION BY user_id ORDER BY {order}) - 1 AS walk_ordinal
    FROM events
"""
IN_TIME, BY_ID = "epoch_us(ts) DESC, event_id DESC", "event_id DESC"
SINCE_SQL = f"(SELECT greatest(max(CAST(floor(epoch_us(ts) / 1000000) AS BIGINT)) - {DAYS} * 86400, 0) FROM events)"


def markdown_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as Markdown files: a level 1 heading, and a level 2 heading for each turn."""
    turns = table(spark, sf_dir, "conversations")
    part = F.concat(F.lit("## "), F.col("role"), F.lit(" "), F.col("turn").cast("string"), F.lit("\n"), F.col("text"), F.lit("\n"))
    files = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", part.alias("part")))), lambda x: x["part"]), "").alias("body"))
    conv = F.col("conv_id").cast("string")
    return files.select(
        (F.col("conv_id") % 10).alias("repo"), F.concat(F.lit("conv/"), conv, F.lit(".md")).alias("path"), F.concat(F.lit("# Conversation "), conv, F.lit("\n\n"), F.col("body")).alias("text")
    )


MARKDOWN_SQL = """
    SELECT conv_id % 10 AS repo, 'conv/' || conv_id || '.md' AS path,
           '# Conversation ' || conv_id || chr(10) || chr(10) || string_agg('## ' || role || ' ' || turn || chr(10) || text || chr(10), '' ORDER BY turn) AS text
    FROM conversations GROUP BY conv_id
"""

LINES_SQL = f"""
    SELECT repo, path, u.i AS line_number, a[u.i] AS content
    FROM (SELECT repo, path, string_split(text, chr(10)) AS a, CASE WHEN text LIKE '%' || chr(10) THEN 1 ELSE 0 END AS tail FROM ({MARKDOWN_SQL})), unnest(range(1, len(a) - tail + 1)) u(i)
"""


def added(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third line of those files, counted from the first, stands for an addition."""
    return explode_lines(markdown_docs(spark, sf_dir), ["repo", "path"]).where(F.col("line_number") % 3 != 1)


ADDED_SQL = f"SELECT * FROM ({LINES_SQL}) WHERE line_number % 3 <> 1"


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for each of twelve repositories, two of which have no additions."""
    base = spark.range(12).select(F.col("id").alias("repo"), F.concat(F.lit(" ./repo-"), F.col("id").cast("string"), F.lit(" ")).alias("repo_path"), F.lit(DAYS).alias("days_since"))
    return base.withColumn("custom_prompt", F.when(F.col("repo") % 2 == 0, F.lit(" Stress customer impact. ")))


REQUESTS_SQL = f"""
    SELECT i AS repo, ' ./repo-' || i || ' ' AS repo_path, {DAYS} AS days_since, CASE WHEN i % 2 = 0 THEN ' Stress customer impact. ' END AS custom_prompt
    FROM range(12) r(i)
"""
