"""SimHash, components and suffix dedup."""

import collections
import hashlib
import random

import numpy as np
import pytest
import xxhash

from docloom.llm import _graph, simhash, suffixdedup
from docloom.llm._gsaca import suffix_array


def docs_of(spark, rows, n=3):
    return spark.createDataFrame([(i, t, 0, 0, 0, "") for i, t in rows], "doc_id long, text string, fp int, key int, v int, component_id string").repartition(n)


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


@pytest.mark.parametrize("text", [None, "", " \n", "one", "One two", "a b c", "a b c d e f a b c", "É é A", "x\x85y z\x0bw v", "w " * 3000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def reach(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def balls(rng):
    """Groups of fingerprints a few bits around centres."""
    for _ in range(12):
        b = rng.getrandbits(64)
        for _ in range(15):
            x = b
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            yield x


def halves(rng):
    """Many that share one half: whatever is near there is so in the other."""
    low, centres = rng.getrandbits(32), [rng.getrandbits(32) for _ in range(40)]
    for _ in range(300):
        yield (rng.choice(centres) ^ 1 << rng.randrange(32) ^ 1 << rng.randrange(32)) << 32 | low ^ (rng.random() < 0.3) << rng.randrange(32)


def dense(rng):
    """All values of a few bits, and chains from bit to bit."""
    base = rng.getrandbits(64)
    for k in range(256):
        yield base ^ k << 20 ^ (k & 0x55) << 50
    for k in range(0, 64, 4):
        base ^= 0xF << k
        yield base


@pytest.mark.parametrize(("kind", "depth"), [(balls, 4), (halves, 4), (dense, 4), (halves, 1)])
def test_links_join_the_same_components_as_all_pairs(spark, monkeypatch, kind, depth):
    monkeypatch.setattr(simhash, "DEPTH", depth)
    fps = {0, 2**64 - 1, *kind(random.Random(kind.__name__))}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = [(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()]
    near = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1") <= 3
    assert all(near(a, b) for a, b in got)
    pairs = [(a, b) for a in signed for b in signed if a < b and near(a, b)]
    assert reach(signed, got) == reach(signed, pairs)


def test_near_duplicates(spark):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for g in range(8):
        text = [rng.choice(words) for _ in range(400)]
        for _ in range(5):
            t = list(text)
            for _ in range(rng.randint(0, 2)):
                t[rng.randrange(400)] = "changed"
            rows.append((len(rows), " ".join(t)))
    rows += [(100, None), (101, ""), (102, " "), (None, ""), (None, "only nulls here"), (3, rows[3][1]), (104, "short"), (105, "SHORT")]
    got = simhash.near_duplicates(docs_of(spark, rows)).collect()
    fp = {i: slow_fingerprint(t) for i, t in rows if i is not None}
    ids = sorted(fp)
    want = reach(ids, [(a, b) for a in ids for b in ids if a < b and bin(fp[a] ^ fp[b]).count("1") <= 3])
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert r["component_id"] == want[r["doc_id"]] and r["fingerprint"] == f"{fp[r['doc_id']]:016x}"
    assert sorted(str(r["component_id"]) for r in got if r["doc_id"] is None) == ["100", "None"]
    assert want[105] == 104
    assert simhash.near_duplicates(docs_of(spark, [])).count() == 0


def test_components(spark):
    rng = random.Random(5)
    links = [(k, k + 1) for k in range(100, 160)] + [(5, rng.randint(6, 60)) for _ in range(80)] + [(7, 7), (None, 3), (900, 901), (901, 902), (902, 900)]
    got = {r["node"]: r["component"] for r in _graph.components(spark.createDataFrame(links, "x long, y long"), "x", "y").collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    assert got == reach({n for p in real for n in p}, real)
    assert _graph.components(spark.createDataFrame([], "x long, y long"), "x", "y").count() == 0


@pytest.mark.parametrize("piece", [1, 3, 50, 10_000])
def test_components_do_not_depend_on_the_pieces(spark, piece):
    rng = random.Random(piece)
    links = [(rng.randrange(-90, 90), rng.randrange(-90, 90)) for _ in range(80)] + [(k, k + 1) for k in range(500, 540)] + [(7, 7)]
    nodes = {x for link in links if link[0] != link[1] for x in link}
    got = {r["node"]: r["component"] for r in _graph.components(spark.createDataFrame(links, "x long, y long"), "x", "y", piece).collect()}
    assert got == reach(nodes, [x for x in links if x[0] != x[1]])


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(3000):
        s = [rng.randint(0, rng.choice([0, 1, 2, 6])) for _ in range(rng.randint(0, 30))]
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])
    for s in (b"banana", b"mississippi", b"a" * 100, b"ab" * 60, b"abaab" * 30):
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def slow_removal(texts, n):
    count = collections.Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - n + 1):
            if count[t[i : i + n]] > 1:
                gone[i : i + n] = True
        left = np.frombuffer(t, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    return out


@pytest.mark.parametrize("crowd", [256, 3])
def test_suffix_dedup(spark, monkeypatch, crowd):
    monkeypatch.setattr(suffixdedup, "CROWD", crowd)
    rng = random.Random(5)
    some = lambda a, b: "".join(rng.choice("abcdefgh é") for _ in range(rng.randint(a, b)))
    passages = [some(380, 900) for _ in range(5)]
    texts = []
    for _ in range(40):
        parts = [rng.choice(["", some(1, 500), rng.choice(passages), rng.choice(passages)[rng.randint(0, 50) :], "De " * rng.randint(1, 300)]) for _ in range(rng.randint(0, 3))]
        texts.append("".join(parts))
    texts += [None, "", "x" * 399, "x" * 400, "y" * 401, texts[3], texts[3]]
    rows = [(i if i % 7 else None, t) for i, t in enumerate(texts)]
    got = suffixdedup.remove_repeats(docs_of(spark, rows), with_text=True).collect()
    want = slow_removal([(t or "").encode() for t in texts], 400)
    have = collections.Counter((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got)
    assert have == collections.Counter(want)
    for r in got:
        if r["n_removed"] == 0:
            assert hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"]
    assert suffixdedup.remove_repeats(docs_of(spark, [])).count() == 0


def test_pieces_across_chunks(monkeypatch):
    rng = random.Random(2)
    data = bytes(rng.randrange(256) for _ in range(3000))
    whole = {x[0] for x in suffixdedup.pieces(data)}
    monkeypatch.setattr(suffixdedup, "CHUNK", 700)
    cut = list(suffixdedup.pieces(data))
    assert {x[0] for x in cut} == whole
    assert cut[0][1] == 0 and cut[-1][2] == 2600 and all(x[2] + 1 == y[1] for x, y in zip(cut, cut[1:], strict=False))


def test_suffix_dedup_of_equal_hashes(spark):
    """Two strings of 400 bytes with one hash, the one sorted between two copies of the other."""
    rng = random.Random(3)
    other = 0
    while other != 4:  # bytes before the first full block
        middle = "".join(rng.choice("abcdefgh ") for _ in range(392))
        one, two = ("é" + "Cya" + middle + "uwaz").encode()[1:], (".èd" + middle + "eEuI").encode()
        (_, first, last, at), = suffixdedup.pieces(one)
        assert (len(one), len(two), first, last) == (400, 400, 0, 0)
        other = at % 8
    pair = np.frombuffer(one + two, np.uint8)
    assert suffixdedup.window_hashes(pair, 400)[[0, 400]].tolist() == suffixdedup.window_hashes(pair, 400)[[0, 0]].tolist()
    texts = [f"éCya{middle}uwaz1111", f".èd{middle}eEuI2222", f"ĩCya{middle}uwaz3333"]  # é and ĩ end alike
    got = suffixdedup.remove_repeats(docs_of(spark, list(enumerate(texts)))).collect()
    want = slow_removal([t.encode() for t in texts], 400)
    assert [x[1] for x in want] == [400, 0, 400]
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in sorted(got)] == want
