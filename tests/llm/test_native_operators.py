"""Sharding, decontamination and line dedup: SQL functions only."""

import collections
import random
import zlib

import pytest
from pyspark.sql import functions as F

from docloom.llm import decontam, linededup, sharding

DOCS = "doc_id long, text string, shard int, _b string, slot string, line string, h1 int, w int, item_id int, at int"


def docs_of(spark, rows, n=3):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, 0, "", "", "", 0, 0, 0, 0) for i, t in rows], DOCS).repartition(n)


def jump(key, n):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int(float(b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("n", [1, 2, 16, 17, 200])
def test_jump_hash(spark, n):
    rng = random.Random(n)
    keys = [0, 1, -1, 2**63 - 1, -(2**63), *(rng.randint(-(2**63), 2**63 - 1) for _ in range(200))]
    got = spark.createDataFrame([(k,) for k in keys], "k long").select("k", sharding.jump_shard(F.col("k"), n).alias("s")).collect()
    assert {r["k"]: r["s"] for r in got} == {k: jump(k, n) for k in keys}
    with pytest.raises(ValueError):
        sharding.jump_shard(F.lit(1), 0)


def test_shard(spark):
    rows = [(i, "x" * i) for i in range(300)] + [(None, None), (None, "é"), (7, "x" * 7), (7, "x" * 7), (301, None), (302, "")] + [(1000 + i, "same") for i in range(150)]
    got = sharding.shard(docs_of(spark, rows), 5, buckets=8).toPandas()
    assert len(got) == len(rows) and set(got["law"]) == {"key"}
    for r in got.itertuples():
        key = 0 if r.doc_id != r.doc_id else int(r.doc_id)
        assert r.shard == jump(key, 5) and r.grown_shard == jump(key, 6) and r.grown_shard in (r.shard, 5)
    assert all(sorted(g) == list(range(len(g))) for _, g in got.groupby("shard")["slot"])
    want = collections.Counter((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in rows)
    assert collections.Counter(zip(got["size"], got["text_crc32"], strict=True)) == want
    again = sharding.shard(docs_of(spark, rows, 5), 5, buckets=8).toPandas()
    order = ["doc_id", "size", "text_crc32", "shard", "slot"]
    assert sorted(map(str, got[order].values.tolist())) == sorted(map(str, again[order].values.tolist()))
    assert sharding.shard(docs_of(spark, []), 5).count() == 0


BENCH = [(1, "What is the sum of 12 km and 30 km for Anna who runs with Bob today"), (2, "one two three four five six seven eight nine ten"), (3, "too short"), (4, None)]


def found(spark, rows, **more):
    bench = spark.createDataFrame([(i, t, "x", 0) for i, t in BENCH], "item_id long, text string, doc_id string, h int")
    return {(r["doc_id"], r["item_id"]): r for r in decontam.contaminated(docs_of(spark, rows), bench, **more).collect()}


def test_decontamination(spark):
    rows = [
        (1, "Before. " + BENCH[0][1] + " after it"), (2, "what is the sum of 5 km and 99 km for Clara who runs with Dave, today"), (3, "What is the sum of 5 km and 5 km for Anna who runs with Bob today"),
        (4, "ONE two-three four, five six seven eight nine ten"), (5, "one two three four five six"), (6, None), (7, ""), (8, "too short"), (9, BENCH[1][1]), (9, BENCH[1][1]), (None, BENCH[1][1]),
        (10, "word " * 5000 + BENCH[1][1]), (11, "one two three four FIVE six seven eight nine ten " * 3),
    ]
    got = found(spark, rows)
    assert set(got) == {(1, 1), (2, 1), (4, 2), (9, 2), (None, 2), (10, 2), (11, 2)}
    assert not got[1, 1]["changed"] and got[2, 1]["changed"] and got[10, 2]["matched"] == got[10, 2]["windows"] == 6
    # 12 and 30 both becoming 5 is no consistent change, so only windows without values count
    assert (3, 1) not in got
    assert found(spark, []) == {}
    assert set(found(spark, rows, share=0.3)) >= {(5, 2)}
    kept = decontam.decontaminate(docs_of(spark, rows), spark.createDataFrame(BENCH, "item_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 5, 6, 7, 8] and kept.columns == DOCS.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.decontaminate(docs_of(spark, rows), none).count() == len(rows)


def test_decontamination_by_shuffle_is_the_same(spark, monkeypatch):
    rows = [(i, f"x{i} " + BENCH[i % 2][1]) for i in range(6)]
    want = set(found(spark, rows))
    monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", 0)
    assert set(found(spark, rows)) == want and len(want) == 6


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def brute_lines(rows):
    key = lambda t: t.strip(" \t\r")
    first = {}
    for i, t in sorted(((i, t) for i, t in rows if t is not None), key=lambda r: (r[0] is None, r[0] or 0)):
        for k, line in enumerate(t.split("\n")):
            if len(key(line)) >= linededup.SHORT:
                first.setdefault(key(line), (i is None, i or 0, k))
    near = {x for x in first for y in first if first[y] < first[x] and min(len(x), len(y)) >= linededup.NEAR and within_one(x, y)}
    out = []
    for i, t in rows:
        if t is None:
            out.append((i, None, 0, 0))
            continue
        lines = t.split("\n")
        kept = [x for k, x in enumerate(lines) if len(key(x)) < linededup.SHORT or (key(x) not in near and first[key(x)] == (i is None, i or 0, k))]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def test_line_dedup(spark):
    rng = random.Random(9)
    base = ["".join(rng.choice("abcé ") for _ in range(rng.randint(5, 40))) for _ in range(25)]

    def edited(s):
        k = rng.randrange(len(s))
        return rng.choice([s, s[:k] + s[k + 1 :], s[:k] + "Z" + s[k + 1 :], s[:k] + "q" + s[k:], "  " + s + "\t"])

    rows = [(i, "\n".join(edited(rng.choice(base)) for _ in range(rng.randint(0, 8)))) for i in range(0, 120, 2)]
    rows += [(1, None), (3, ""), (5, "\n\n"), (7, "x" * 5000 + "\n" + "x" * 5001), (9, "a a a a a a a a a a\na a a a a a a a a"), (None, base[0] + "\nfresh line of its own"), (11, "aaaaaaaaaaaaaaaa\naaaaaaaaaaaaaaaaa")]
    got = [(None if r["doc_id"] is None else r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in linededup.dedup_lines(docs_of(spark, rows)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute_lines(rows)))
    assert linededup.dedup_lines(docs_of(spark, [])).count() == 0
    twice = [(1, "a line that is long enough"), (1, "a line that is long enough")]
    assert [r["n_dropped"] for r in linededup.dedup_lines(docs_of(spark, twice)).collect()] == [0, 0]


def test_emptied_documents_go(spark):
    rows = [(1, "a line that is long enough"), (2, "a line that is long enough\n"), (3, ""), (4, None), (5, "a line that is long enough\nother text here")]
    got = {r["doc_id"]: r["text"] for r in linededup.without_emptied(docs_of(spark, rows)).collect()}
    assert got == {1: "a line that is long enough", 3: "", 4: None, 5: "other text here"}


def test_no_python_in_the_plans(spark):
    docs = docs_of(spark, [(1, "a line that is long enough")])
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    for df in (sharding.shard(docs), decontam.contaminated(docs, bench), linededup.dedup_lines(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
