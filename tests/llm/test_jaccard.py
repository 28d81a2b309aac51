"""The pipeline's near-duplicates against all pairs in plain Python."""

import random
import sys
from pathlib import Path

import pytest
from test_near_duplicates import reach

from docloom.llm import jaccard

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))


def runs(text, n=5):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()


def alike(x, y):
    return x == y or 10 * len(x & y) >= 8 * len(x | y)


def kept_by_hand(rows):
    sets = [runs(t) for _, t in rows]
    comp = reach(range(len(rows)), [(a, b) for a in range(len(rows)) for b in range(a) if alike(sets[a], sets[b])])
    groups = {}
    for k, c in comp.items():
        groups.setdefault(c, []).append(rows[k])
    return sorted(min(-1 if i is None else i for i, _ in g) if all(i is None for i, _ in g) else min(i for i, _ in g if i is not None) for g in groups.values())


def edited(rng, text, n):
    t = list(text)
    for _ in range(n):
        t[rng.randrange(len(t))] = f"new{rng.random()}"
    return t


def some_rows():
    rng = random.Random(3)
    rows = []
    for _ in range(12):
        text = [f"w{rng.randrange(900)}" for _ in range(rng.choice([12, 120, 240]))]
        for _ in range(8):
            rows.append(" ".join(edited(rng, text, rng.randint(0, 6))))
    passage = [f"p{k}" for k in range(60)]  # in many texts that are not alike
    rows += [" ".join([*(f"w{rng.randrange(900)}" for _ in range(40)), *passage]) for _ in range(20)]
    rng.shuffle(rows)
    return [*enumerate(rows), (500, None), (501, ""), (502, "one two"), (503, "ONE two")]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string").repartition(3)


@pytest.mark.parametrize("crowd", [24, 2])
def test_one_of_each(spark, monkeypatch, crowd):
    monkeypatch.setattr(jaccard, "CROWD", crowd)
    rows = some_rows()
    got = jaccard.one_of_each(docs_of(spark, rows))
    assert got.columns == ["doc_id", "text", "source"]
    assert sorted(r["doc_id"] for r in got.collect()) == kept_by_hand(rows)
    assert jaccard.one_of_each(docs_of(spark, rows[:0])).count() == 0


def test_fingerprints_decide_nothing(spark, monkeypatch):
    rows = some_rows()
    rng = random.Random(5)
    x, y = (" ".join(f"{c}{rng.randrange(900)}" for _ in range(120)) for c in "xy")
    rows += [(-1, x), (600, y), (601, y + " more")]
    # all fingerprints are equal: each node is compared with the least only, and what is alike apart from it must still meet
    monkeypatch.setattr(jaccard, "majority", lambda s: 7)
    assert sorted(r["doc_id"] for r in jaccard.one_of_each(docs_of(spark, rows)).collect()) == kept_by_hand(rows)
    monkeypatch.setattr(jaccard, "_by_fingerprint", lambda rows: spark.createDataFrame([], "a long, b long"))
    assert sorted(r["doc_id"] for r in jaccard.one_of_each(docs_of(spark, rows)).collect()) == kept_by_hand(rows)


@pytest.mark.parametrize("bits", [64, 1 << 24])
def test_texts_nobody_asked_for_are_not_shuffled(spark, monkeypatch, bits):
    monkeypatch.setattr(jaccard, "FILTER", bits)
    docs = docs_of(spark, some_rows())
    hashes = docs.selectExpr("xxhash64(text) AS th").distinct()
    asked = jaccard.written(hashes.where("th % 4 = 0"))
    passed = hashes.where(jaccard._holding(asked)(hashes["th"]))
    assert passed.join(asked, "th").count() == asked.count()
    if bits > 64:
        assert passed.count() < hashes.count() / 2


def test_tables_go_when_they_are_read(spark):
    from docloom.llm import _common, linededup

    folder = Path(_common.shared_dir(spark).split("://")[-1].removeprefix("file:"))
    docs = docs_of(spark, some_rows())
    for stage, most in ((linededup.without_emptied, 1), (jaccard.one_of_each, 1)):
        there = {p for p in folder.glob("docloom-*") if any(p.glob("*.parquet"))}
        out = stage(docs)
        left = [p for p in folder.glob("docloom-*") if p not in there and sum(f.stat().st_size for f in p.glob("*.parquet")) > 16_000]
        assert len(left) <= most and out.count() > 0


def test_the_stage_drops_copies_with_a_few_changed_words(spark):
    import corpus_pipeline

    rng = random.Random(1)
    text = [f"w{rng.randrange(900)}" for _ in range(200)]
    rows = [(1, " ".join(text)), (2, " ".join(w if k % 67 else f"new{k}" for k, w in enumerate(text))), (3, " ".join(w if k % 20 else f"new{k}" for k, w in enumerate(text)))]
    assert alike(runs(rows[0][1]), runs(rows[1][1])) and not alike(runs(rows[0][1]), runs(rows[2][1]))
    assert sorted(r["doc_id"] for r in corpus_pipeline.dedup_documents(spark, docs_of(spark, rows), "").collect()) == [1, 3]


def test_repeated_and_null_ids_are_decided_by_row(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(50)) for c in "ab")
    rows = [(None, a), (None, a), (4, b), (4, b), (4, b + " more"), (1, "other words alone"), (2, a + " end"), (1, b + " end"), (None, "unlike"), (None, "unlike")]
    got = [(r["doc_id"], r["text"]) for r in jaccard.one_of_each(docs_of(spark, rows)).collect()]
    assert sorted(got, key=repr) == sorted([(2, a + " end"), (1, b + " end"), (1, "other words alone"), (None, "unlike")], key=repr)
