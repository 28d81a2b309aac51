import json

from pyspark.sql import functions as F

from docloom.operators import summarize
from docloom.sources import files
from docloom.streaming import summaries as S

TEXT = "One lonely but long enough sentence here. Short."


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(i, TEXT.replace("lonely", f"lonely{i}")) for i in range(6)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    q = S.summaries(stream).writeStream.format("memory").queryName("stream_out").start()
    q.processAllAvailable()
    q.stop()
    got = {tuple(map(str, r)) for r in spark.table("stream_out").collect()}
    assert got == {tuple(map(str, r)) for r in summarize.summarize(docs).collect()} and len(got) == 6


def test_each_batch(spark, tmp_path):
    docs = spark.createDataFrame([(1, "# A\nx\n# B\n")], "k long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    seen = {}
    q = S.each_batch(stream, lambda df: S.sections(df, ["k"]), lambda df, n: seen.update({n: df.count()})).start()
    q.processAllAvailable()
    q.stop()
    assert seen == {0: 2}


def test_tsv_and_jsonl(spark, tmp_path):
    (tmp_path / "in.tsv").write_text(f"a\t{TEXT}\n\nb\tx\ty\nbad\n")
    rows = files.read_tsv(spark, str(tmp_path / "in.tsv"))
    assert {(r["source_id"], r["text"], r["valid"]) for r in rows.collect()} == {("a", TEXT, True), ("b", "x\ty", True), ("bad", None, False)}
    files.write_summaries(summarize.summarize(rows.where("valid").select(F.col("source_id").alias("doc_id"), "text")), str(tmp_path / "out"))
    lines = [json.loads(x) for f in (tmp_path / "out").glob("*.json") for x in f.read_text().splitlines()]
    assert {x["source_id"] for x in lines} == {"a", "b"} and all(set(x) == {"source_id", "extracted_sentences", "synthesized_summary"} for x in lines)


def test_working_tree(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.md").write_text("x")
    (tmp_path / "b.md").write_bytes(b"\xff\xfe")
    (tmp_path / "c.txt").write_text("x")
    got = {(r["path"], r["text"], r["valid"]) for r in files.working_tree(spark, str(tmp_path)).collect()}
    assert got == {("d/a.md", "x", True), ("b.md", None, False)}
