"""The pipeline against a version of it that goes through the documents in plain Python."""

import random
import sys
from pathlib import Path

import numpy as np
import pytest
from test_native_operators import brute_lines
from test_jaccard import alike, runs
from test_near_duplicates import reach

from docloom.llm import packing, quality
from docloom.llm._common import fold_of

pytest.importorskip("public_tokenizers")
sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402

from docloom.llm.queries import tokenizer_path  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(11)
    words = [a + b for a in "ka mi to re sol un der qui".split() for b in "ne la por ti sa em".split()]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    bench = [(i, line(25)) for i in range(6)]
    shared = line(12)
    rows = []
    for i in range(160):
        t = "\n".join(line(rng.randint(6, 30)) for _ in range(rng.randint(1, 6)))
        if i % 8 == 1:
            t = rng.choice([t.upper() + "!!!", " ".join(w + "###" for w in t.split()), "Buy Buy Buy " * 30])
        if i % 9 == 2:
            t = t + "\n" + shared
        if i % 12 == 3:
            t = t + "\n" + bench[i % 6][1] + "\n" + line(9)
        if i % 10 == 4:
            t = rows[rng.randrange(len(rows))][1]
        if i % 20 == 5:
            t = " ".join(rng.choice(words) for _ in range(300))
            rows.append((1000 + i, t.replace(words[3], words[4], 1)))
        rows.append((i, t))
    rows += [(2000, None), (2001, ""), (2002, "word " * 4000), (2003, "word " * 4000)]
    labels = [(i, 0 if i % 8 == 1 else 1, 0) for i in range(0, 160) if i % 3]
    d = tmp_path_factory.mktemp("pipeline")
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), rows, labels, bench


def by_hand(spark, tables):
    d, rows, _, bench = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = spark.read.parquet(f"{d}/labels.parquet").toPandas()
    learned = spark.createDataFrame(labels[[fold_of(int(i)) != 1 for i in labels["doc_id"]]])
    model = quality.fit(docs, learned)
    good = [(i, t) for i, t in rows if model.scores(np.stack([quality.terms(t)]))[0] >= 0.5]
    lined = [(i, t) for i, t, _, gone in brute_lines(good) if not gone or t.strip()]
    sets = {i: runs(t) for i, t in lined}
    ids = sorted(sets)
    comp = reach(ids, [(a, b) for a in ids for b in ids if a < b and alike(sets[a], sets[b])])
    single = [(i, t) for i, t in lined if comp[i] == i]
    return good, lined, single, [(i, t) for i, t in single if not any(b in (t or "") for _, b in bench)]


def test_each_stage(spark, tables):
    d = tables[0]
    want = by_hand(spark, tables)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_duplicates", "decontamination", "packing"]
    assert len({len(w) for w in want}) == 4  # every stage takes something away
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = corpus_pipeline.written(stage(spark, docs, d))
        assert docs.columns == COLUMNS
        assert sorted((r["doc_id"], r["text"] or "", r["n_chars"] or 0) for r in docs.collect()) == sorted((i, t or "", len(t or "")) for i, t in want[k])


def test_run(spark, tables):
    final = by_hand(spark, tables)[-1]
    got = corpus_pipeline.run(spark, tables[0]).toPandas()
    enc = packing.WordEncoder(tokenizer_path())
    lengths = {i: len(b) // 4 + 1 for (i, _), b in zip(final, enc.encode([t or "" for _, t in final]), strict=True)}
    assert got.groupby("doc_id")["length"].sum().to_dict() == lengths
    assert (got.groupby("sequence_id")["length"].sum() <= 2048).all()


def test_empty_tables(spark, tables, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tables[0]}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
