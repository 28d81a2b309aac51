"""Exact top-k and packing."""

import random
import sys
import zlib

import numpy as np
import pytest

from docloom.llm import packing, topk

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
VECTORS = "vec_id long, embedding array<float>, id int, v int, b int, rank int"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, 0, 0, 0, 0) for i, v in rows], VECTORS).repartition(3)


def brute_topk(rows, queries, k):
    ok = lambda v: v is not None and all(x is not None and np.isfinite(x) for x in v)
    q = lambda v: [int(np.floor(256 * float(np.float32(x)))) for x in v]
    good = [(i, q(v)) for i, v in rows if i is not None and ok(v)]
    out = []
    for i, v in {(i, tuple(q(v))) for i, v in queries if i is not None and ok(v)}:
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in good if j != i and len(w) == len(v))[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("block", [7, 1000])
def test_topk(spark, block):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(120)]
    rows += [(200 + i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(30)] + [(300, [0.0] * 6), (301, None), (302, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (303, [float("nan")] * 6), (304, [float("inf")] * 6), (None, [1.0] * 6), (305, [1.0, 2.0]), (306, [3.0, 4.0])]
    queries = [r for r in rows if r[0] is not None and r[0] % 10 == 0] + [(305, [1.0, 2.0]), (303, [float("nan")] * 6)]
    got = topk.topk(vectors_of(spark, rows), vectors_of(spark, queries), k=5, block_rows=block, query_rows=4).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == brute_topk(rows, queries, 5)
    assert topk.topk(vectors_of(spark, []), vectors_of(spark, queries)).count() == 0
    assert topk.topk(vectors_of(spark, rows), vectors_of(spark, [])).count() == 0


def test_threshold_stops_early():
    rng = np.random.default_rng(1)
    rows = np.floor(rng.normal(0, 5, (4000, 3)))
    rows[:10] = 500
    order = np.argsort(rows, axis=0, kind="stable").T
    best, scored = topk.threshold_topk(np.array([1.0, 2.0, 3.0]), None, rows, np.arange(4000), order, 5)
    assert [i for _, i in best] == [0, 1, 2, 3, 4] and scored < 1000


def test_large_components_stay_exact(spark):
    rows = [(1, [1e6, 1.0]), (2, [1e6 + 1, 1.0]), (3, [-1e6, 3.0])]
    got = topk.topk(vectors_of(spark, rows), vectors_of(spark, rows), k=5).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == brute_topk(rows, rows, 5)


TEXTS = [
    None, "", " ", "Hello, world's end. don't!", "É é ÀÉ naïve ﬁ", "x" * 3000, "word " * 5000, "a\x1cb c\x85d　e", "123 4.5% <|endoftext|> <|startoftext|>", "日本語のテキスト。\n改行", "é combining", "ΣΑΣ Σ", "İstanbul ß",
    "tab\tnew\nline\r\n", "***word*** ###x### a--b 'll 's's it's", "😀 emoji",
]


def whole(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(PATH))
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_encoder_equals_the_tokenizer(monkeypatch):
    enc = packing.WordEncoder(str(PATH))
    want = whole(TEXTS)
    for _ in range(2):
        got = [np.frombuffer(b, "<u4").tolist() for b in enc.encode([t or "" for t in TEXTS])]
        assert got == want
    monkeypatch.setattr(packing, "CACHE_WORDS", 3)  # words are forgotten and learnt again
    rng = random.Random(4)
    for _ in range(20):
        texts = ["".join(rng.choice("abéÉ.,'!1 \n") for _ in range(60)) for _ in range(5)]
        assert [np.frombuffer(b, "<u4").tolist() for b in enc.encode(texts)] == whole(texts)


def test_fill_is_closest_to_capacity():
    rng = random.Random(6)
    for _ in range(200):
        cap = rng.randint(5, 40)
        counts = {}
        for _ in range(rng.randint(1, 8)):
            n = rng.randint(1, cap)
            counts[n] = counts.get(n, 0) + 1
        used = packing.fill(counts, cap)
        sums = {0}
        first = max(counts)
        for n, c in counts.items():
            for _ in range(c - (n == first)):
                sums |= {s + n for s in sums if s + n + first <= cap}
        assert all(used[n] <= counts[n] for n in used) and first in used
        assert sum(n * m for n, m in used.items()) == first + max(sums)


@pytest.mark.parametrize("window", [16, 2048])
def test_packing(spark, window):
    rng = random.Random(8)
    texts = [*TEXTS, *("same text here" for _ in range(90)), *(" ".join(rng.choice(["alpha", "beta", "x"]) for _ in range(rng.randint(0, 60))) for _ in range(60))]
    rows = [(i if i != 3 else None, t, 0, 0) for i, t in enumerate(texts)] + [(5, texts[5], 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int, offset int").repartition(4)
    got = packing.packed(docs, str(PATH), window, with_ids=True).toPandas()
    ids = [x + [1] for x in whole([r[1] for r in rows])]
    assert got["length"].sum() == sum(map(len, ids)) and (got["length"] <= window).all()
    by_id = {r[0]: x for r, x in zip(rows, ids, strict=True)}
    for r in got.itertuples():
        own = by_id[None if r.doc_id != r.doc_id else int(r.doc_id)]
        assert r.doc_tokens == len(own) and list(r.ids) == own[r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(own[r.start : r.start + r.length], "<u4").tobytes())
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        ends = (g["offset"] + g["length"]).tolist()
        assert g["offset"].tolist() == [0, *ends[:-1]] and ends[-1] <= window
    assert sorted(got["sequence_id"].unique()) == list(range(got["sequence_id"].nunique()))
    assert packing.packed(docs.limit(0), str(PATH), window).count() == 0


def test_the_word_cache_is_bounded_in_bytes(monkeypatch):
    """F: packing took more than 3000 MB of an executor's memory; only the count of cached words was bounded, at some 200 MB a worker."""
    monkeypatch.setattr(packing, "CACHE_BYTES", 100_000, raising=False)
    enc = packing.WordEncoder(str(PATH))
    rng = random.Random(3)
    for _ in range(30):
        texts = [" ".join("".join(rng.choices("abcdefghij", k=9)) for _ in range(100)) for _ in range(2)]
        want = [np.array(enc.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        assert enc.encode(texts) == want
        assert sum(map(sys.getsizeof, enc.known)) + sum(map(sys.getsizeof, enc.known.values())) <= 100_000 + 2 * 100 * 300
