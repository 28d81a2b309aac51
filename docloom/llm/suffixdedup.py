"""Removal of long repeated byte strings with suffix arrays built by linear grouping.

Every window of ``length`` bytes has one anchor: among the windows' 64-byte strings the one of the
smallest hash, the leftmost at ties. Equal windows have equal anchors, so windows are only
compared within the group of their anchor's hash. Neighbouring windows with the same anchor form a
piece of text. Groups with a single piece hold nothing repeated; equal pieces are kept once with
their number. The different pieces of a group are joined into one text, whose suffix array
(:mod:`docloom.llm._gsaca`) brings equal windows side by side.

Windows of a group are equal only at equal distances from their anchors. So a piece is read in
blocks of BLOCK bytes counted from its anchor, blocks become symbols, and the suffix array is one over
symbols: windows whose full blocks agree lie side by side in it, and their first and last bytes are
compared after.

A group with more than CROWD different pieces, such as at the edges of a passage that very
many documents share, is cut up first: the windows that start far before the anchor all hold the same
bytes before it, and the others the same bytes behind it, so each half of a piece goes to the
group of those bytes. This is repeated for groups that are still too large; halves that are equal
become one, and halves alone in their group hold nothing repeated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm._common import written
from docloom.llm._gsaca import suffix_array

LENGTH, ANCHOR = 400, 64
#: Bytes a symbol; different pieces a group up to which it is sorted as one text; bytes sorted at once, at least.
BLOCK, CROWD, TEXT = 8, 1024, 1 << 19
#: Windows whose anchors are found at once.
CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_MIX = np.uint64(0xD6E8FEB86659FD93)
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    base = _BASE if kind == "up" else pow(_BASE, -1, 1 << 64)
    if kind not in _powers or len(_powers[kind]) < n:
        p = np.full(max(n, 1 << 12), base, np.uint64)
        p[0] = 1
        _powers[kind] = np.multiply.accumulate(p)
    return _powers[kind][:n]


def window_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k-byte string."""
    n = len(data)
    s = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("up", n), out=s[1:])
    h = (s[k:] - s[: n - k + 1]) * _power("down", n - k + 1)
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(29)
    h *= _MIX
    return h ^ (h >> np.uint64(32))


def pieces(data: bytes, length: int = LENGTH, anchor: int = ANCHOR) -> Iterator[tuple[int, int, int, int]]:
    """(hash of the anchor, first window, last window, place of the anchor) of each run of windows with the same anchor."""
    w = length - anchor + 1
    for at in range(0, len(data) - length + 1, CHUNK):
        part = np.frombuffer(data, np.uint8)[at : at + CHUNK + length - 1]
        h = window_hashes(part, anchor)
        m = len(h)
        mask = np.uint64((1 << 21) - 1)
        key = np.full(-(-m // w) * w, np.iinfo(np.uint64).max, np.uint64)
        key[:m] = (h & ~mask) | np.arange(m, dtype=np.uint64)
        grid = key.reshape(-1, w)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(back[: m - w + 1], ahead[w - 1 : m])
        where = (least & mask).astype(np.int64)
        ends = np.flatnonzero(np.diff(where))
        first = np.concatenate(([0], ends + 1))
        last = np.concatenate((ends, [len(where) - 1]))
        anchors = where[first]
        yield from zip(h[anchors].view(np.int64).tolist(), (first + at).tolist(), (last + at).tolist(), (anchors + at).tolist(), strict=True)


def _as_bytes(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def _longs(digest: bytes) -> tuple[int, int]:
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


_PIECES = "t1 long, t2 long, v long, d1 long, d2 long, n int, p long, windows int, anchor int, more array<long>"


def _pieces_of(batches: Iterator[pd.DataFrame], length: int) -> Iterator[pd.DataFrame]:
    """A row for each different piece of a text; ``p`` is its first place and ``more`` holds the others."""
    from xxhash import xxh3_128_digest as digest

    names = [x.split()[0] for x in _PIECES.split(", ")]
    for pdf in batches:
        rows: list[tuple] = []
        for t1, t2, text in zip(pdf["t1"], pdf["t2"], pdf["text"], strict=True):
            data = _as_bytes(text)
            if len(data) < length:
                continue
            view = memoryview(data)
            found: dict[tuple[int, bytes], list[int]] = {}
            for v, a, b, q in pieces(data, length):
                found.setdefault((v, b - a + 1, q - a, digest(view[a : b + length])), []).append(a)
            for (v, n, q, d), at in found.items():
                rows.append((t1, t2, v, *_longs(d), len(at), at[0], n, q, at[1:] or None))
            if len(rows) > 20_000:
                yield pd.DataFrame(rows, columns=names)
                rows = []
        yield pd.DataFrame(rows, columns=names)


def repeated_windows(texts: list[bytes], anchors: list[int], copies: list[bool], length: int = LENGTH) -> list[np.ndarray]:
    """For each text, which of its windows start more than once in all of them; in a text with copies all do.

    ``anchors``: the place of each text's anchor. Equal windows must lie at equal distances from theirs.
    """
    sizes = np.array([len(t) for t in texts])
    starts = np.concatenate(([0], np.cumsum(sizes)))
    windows = np.maximum(0, sizes - length + 1)
    marked = np.zeros(int(starts[-1]), bool)
    for s, n, many in zip(starts[:-1].tolist(), windows.tolist(), copies, strict=True):
        if many:
            marked[s : s + n] = True
    full = (length - BLOCK + 1) // BLOCK  # blocks inside a window, however it lies
    raw = np.frombuffer(b"".join(texts), np.uint8)
    if len(texts) > 1 or not all(copies):
        # one symbol for each block of each text, and one that ends each text
        words, at, owner = [], [], []
        for k, (s, t, q) in enumerate(zip(starts[:-1].tolist(), texts, anchors, strict=True)):
            m = (len(t) - q % BLOCK) // BLOCK
            words.append(np.frombuffer(t, "<u8", m, q % BLOCK))
            at.append(np.concatenate((s + q % BLOCK + BLOCK * np.arange(m), [-1])))
            owner.append(np.full(m + 1, k))
        known, symbols = np.unique(np.concatenate(words), return_inverse=True)
        joined = np.concatenate([np.concatenate((x + 1, [0])) for x in np.split(symbols, np.cumsum([len(w) for w in words])[:-1])])
        place, text_of = np.concatenate(at), np.concatenate(owner)
        order = np.array(suffix_array(joined.tolist()))
        # neighbours with the same full blocks are of one class
        whole = np.zeros(len(joined), bool)
        ends = np.flatnonzero(joined == 0)
        next_end = ends[np.searchsorted(ends, np.arange(len(joined)))]
        whole[next_end - np.arange(len(joined)) >= full] = True
        order = order[whole[order]]
        if len(order):
            runs = np.lib.stride_tricks.sliding_window_view(joined, full)
            same = np.zeros(len(order), bool)
            for a in range(1, len(order), 20_000):
                part = np.arange(a, min(len(order), a + 20_000))
                same[part] = (runs[order[part]] == runs[order[part - 1]]).all(axis=1)
            kind = np.cumsum(~same)
            several = np.bincount(kind)[kind] > 1
            order, kind = order[several], kind[several]
            of, rest = text_of[order], length - BLOCK * full
            for a in range(BLOCK):  # windows that start this far before their first full block
                p = place[order] - a
                fits = (p >= starts[of]) & (p < starts[of] + windows[of])
                p, k = p[fits], kind[fits]
                # the bytes before and behind the blocks, as numbers: equal ones are equal windows
                edge = np.zeros((len(p), -(-rest // 8) * 8), np.uint8)
                edge[:, :rest] = raw[p[:, None] + np.concatenate((np.arange(a), np.arange(length - rest + a, length)))]
                edge = edge.view(np.uint64)
                by = np.lexsort((*edge.T, k))
                p, k, edge = p[by], k[by], edge[by]
                like = np.flatnonzero((k[1:] == k[:-1]) & (edge[1:] == edge[:-1]).all(axis=1))
                marked[p[like]] = True
                marked[p[like + 1]] = True
    return [marked[s : s + n] for s, n in zip(starts[:-1].tolist(), windows.tolist(), strict=True)]


def _runs(marked: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], marked.astype(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


_FOUND = "v long, d1 long, d2 long, runs array<struct<s: int, e: int>>"


def _sorted_groups(batches: Iterator[pd.DataFrame], length: int) -> Iterator[pd.DataFrame]:
    """Suffix arrays over whole groups; rows come sorted by group, and groups are taken together up to TEXT bytes."""

    def done(rows: list[tuple]) -> pd.DataFrame:
        out = []
        # equal windows of different groups don't exist, so groups may share a suffix array
        for (v, d1, d2, _, _, _), hit in zip(rows, repeated_windows([r[3] for r in rows], [r[4] for r in rows], [r[5] > 1 for r in rows], length), strict=True):
            if runs := _runs(hit):
                out.append((v, d1, d2, [{"s": s, "e": e} for s, e in runs]))
        return pd.DataFrame(out, columns=["v", "d1", "d2", "runs"])

    rows: list[tuple] = []
    size, seen = 0, None
    for pdf in batches:
        for v, d1, d2, data, q, n in zip(pdf["v"], pdf["d1"], pdf["d2"], pdf["data"], pdf["anchor"], pdf["n"], strict=True):
            if (v, d1, d2) == seen:
                continue  # the piece of another row with the same id and text
            if rows and size > TEXT and v != rows[-1][0]:
                yield done(rows)
                rows, size = [], 0
            seen = v, d1, d2
            rows.append((v, d1, d2, bytes(data), q, n))
            size += len(data)
    if rows:
        yield done(rows)


_HALVES = "v long, d1 long, d2 long, shift int, v2 long, e1 long, e2 long, anchor int, lo int, hi int, n long, data binary"


def _halved(batches: Iterator[pd.DataFrame], length: int) -> Iterator[pd.DataFrame]:
    """Both halves of the windows of each piece that start lo to hi - 1 bytes before the anchor, with the groups they go to."""
    from xxhash import xxh3_64_intdigest as digest
    from xxhash import xxh3_128_digest as wide

    names = [x.split()[0] for x in _HALVES.split(", ")]
    columns = ["v", "d1", "d2", "data", "anchor", "n", "lo", "hi"]
    for pdf in batches:
        out = []
        for v, d1, d2, data, q, n, lo, hi in zip(*(pdf[c] for c in columns), strict=True):
            data, middle = bytes(data), (lo + hi) // 2
            for a, b in ((lo, middle), (middle, hi)):
                first, last = max(0, q - b + 1), min(len(data) - length, q - a)
                if a == b or first > last:
                    continue
                common = data[q - a : q - b + 1 + length]  # from the latest start of such windows to their earliest end
                part = data[first : last + length]
                key = digest(common, seed=(a << 32 | b) ^ (v & 0xFFFFFFFFFFFFFFFF))
                out.append((v, d1, d2, first, key - (1 << 64) if key >> 63 else key, *_longs(wide(part)), q - first, a, b, n, part))
        yield pd.DataFrame(out, columns=names)


def _resolved(items: DataFrame, length: int) -> DataFrame:
    """v, d1, d2, runs for items (v, d1, d2, n, kinds, anchor, lo, hi, data): which windows of each piece are repeated in its group.

    Groups of one kind hold its copies, all of whose windows are repeated.
    """
    whole = items.where("kinds = 1").select("v", "d1", "d2", F.array(F.struct(F.lit(0).alias("s"), (F.length("data") - length + 1).alias("e"))).alias("runs"))
    ordered = items.where((F.col("kinds") > 1) & (F.col("kinds") <= CROWD))
    ordered = ordered.repartition("v").sortWithinPartitions("v", "d1", "d2").select("v", "d1", "d2", "data", "anchor", "n").mapInPandas(lambda it: _sorted_groups(it, length), _FOUND)
    done = whole.unionByName(ordered)
    crowded = items.where(F.col("kinds") > CROWD)
    if crowded.isEmpty():
        return done
    # a range of one distance makes equal windows equal items, so this ends
    halves = written(crowded.dropDuplicates(["v", "d1", "d2"]).mapInPandas(lambda it: _halved(it, length), _HALVES))
    kinds = halves.groupBy("v2", "e1", "e2").agg(F.sum("n").alias("n"), *(F.first(c).alias(c) for c in ("anchor", "lo", "hi", "data")))
    counts = halves.groupBy("v2", "e1", "e2").agg(F.sum("n").alias("n")).groupBy("v2").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("all")).where("all > 1").drop("all")
    next_items = written(kinds.join(counts, "v2").select(F.col("v2").alias("v"), F.col("e1").alias("d1"), F.col("e2").alias("d2"), "n", "kinds", "anchor", "lo", "hi", "data"))
    found = _resolved(next_items, length).select(F.col("v").alias("v2"), F.col("d1").alias("e1"), F.col("d2").alias("e2"), "runs")
    moved = F.transform("runs", lambda r: F.struct((r["s"] + F.col("shift")).alias("s"), (r["e"] + F.col("shift")).alias("e")))
    up = halves.select("v", "d1", "d2", "shift", "v2", "e1", "e2").join(found, ["v2", "e1", "e2"]).select("v", "d1", "d2", moved.alias("runs"))
    return done.unionByName(up.groupBy("v", "d1", "d2").agg(F.flatten(F.collect_list("runs")).alias("runs")))


def _cut(batches: Iterator[pd.DataFrame], length: int, with_text: bool) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for i, text, spans in zip(pdf["doc_id"], pdf["text"], pdf["spans"], strict=True):
            data = _as_bytes(text)
            gone: list[list[int]] = []
            for s, e in sorted((x["s"], x["e"] + length - 1) for x in (spans if spans is not None else ())):
                if gone and s <= gone[-1][1]:
                    gone[-1][1] = max(gone[-1][1], e)
                else:
                    gone.append([s, e])
            kept, at = [], 0
            for s, e in gone:
                kept.append(data[at:s])
                at = e
            left = b"".join([*kept, data[at:]])
            row = (i, len(data), len(data) - len(left), len(gone), hashlib.sha256(left).hexdigest(), [{"s": s, "e": e} for s, e in gone])
            rows.append((*row, left.decode("utf-8", "replace")) if with_text else row)
        out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", *["kept_text"] * with_text])
        out["doc_id"] = out["doc_id"].astype("Int64")
        yield out


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (and kept_text) for each row.

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in this
    row or another. Matches never cross rows; all strings are judged on the input. Null texts are empty; texts
    under ``length`` bytes stay whole. Repeated rows repeat each other's text, so at ``length`` bytes or more
    nothing of it is left; null and repeated ids don't matter, as texts are told apart by their
    digests. Removed bytes may cut a character; kept_text then has replacement characters, the
    checksum is over the bytes. Other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("t1", F.xxhash64("text")).withColumn("t2", F.xxhash64(F.lit(1), F.col("text")))
    found = written(rows.select("t1", "t2", "text").mapInPandas(lambda it: _pieces_of(it, length), _PIECES))
    shared = found.groupBy("v").agg(F.sum("n").alias("all")).where("all > 1").select("v")
    # copies of a text have the same pieces: they are kept once, with their number
    own = written(found.join(shared, "v").groupBy("t1", "t2", "v", "d1", "d2", "p", "windows", "anchor").agg(F.sum("n").cast("long").alias("n"), F.first("more").alias("more")))
    kinds = own.groupBy("v", "d1", "d2").agg(F.sum("n").alias("n"), F.min(F.struct("t1", "t2", "p", "windows", "anchor")).alias("at"))
    groups = kinds.groupBy("v").agg(F.count(F.lit(1)).alias("kinds"))
    kinds = written(kinds.join(groups, "v").select("v", "d1", "d2", "n", "kinds", "at.*"))

    whole = kinds.where("kinds = 1 AND n > 1").select("v", "d1", "d2", F.array(F.struct(F.lit(0).alias("s"), F.col("windows").alias("e"))).alias("runs"))
    asked = kinds.where("kinds > 1").groupBy("t1", "t2").agg(F.collect_list(F.struct("v", "d1", "d2", "n", "kinds", "p", "windows", "anchor")).alias("asked"))
    texts = rows.groupBy("t1", "t2").agg(F.min("doc_id").alias("first"))
    asked = asked.join(texts, ["t1", "t2"])
    cut = f"named_struct('v', x.v, 'd1', x.d1, 'd2', x.d2, 'n', x.n, 'kinds', x.kinds, 'anchor', x.anchor, 'data', substring(bytes, cast(x.p + 1 as int), x.windows + {length - 1}))"
    source = rows.select("doc_id", "t1", "t2", F.encode("text", "UTF-8").alias("bytes"))
    items = (
        source.join(asked, (source["t1"] == asked["t1"]) & (source["t2"] == asked["t2"]) & source["doc_id"].eqNullSafe(asked["first"]))
        .select(F.explode(F.expr(f"transform(asked, x -> {cut})")).alias("x"))
        .select("x.*", F.lit(0).alias("lo"), F.lit(length - ANCHOR + 1).alias("hi"))
    )
    hits = whole.unionByName(_resolved(written(items), length))

    places = own.select("t1", "t2", "v", "d1", "d2", F.explode(F.concat(F.array("p"), F.coalesce("more", F.array().cast("array<long>")))).alias("p"))
    spans = (
        places.join(hits, ["v", "d1", "d2"])
        .select("t1", "t2", "p", F.explode("runs").alias("r"))
        .groupBy("t1", "t2")
        .agg(F.collect_list(F.struct((F.col("p") + F.col("r.s")).alias("s"), (F.col("p") + F.col("r.e")).alias("e"))).alias("spans"))
    )
    marked = rows.join(spans, ["t1", "t2"], "left").select("doc_id", "text", "spans")
    more = ", kept_text string" if with_text else ""
    return marked.mapInPandas(lambda it: _cut(it, length, with_text), f"doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<s: long, e: long>>{more}")
