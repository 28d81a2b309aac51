"""Packing token sequences with minimum bin slack (Gupta and Ho, 1999).

Documents are tokenized and cut into full windows and one remainder each. Only the
histogram of remainder lengths, at most one count per length, goes to the driver.
There windows are filled one after the other: the longest length left is fixed, and a
subset-sum dynamic programme over bitsets picks the multiset of lengths left that
brings the window closest to its capacity. Its counts are read back from the
bitsets, and the pattern is repeated while the histogram allows. Pieces then find
their window by their number among the pieces of their length.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm._common import docs_of, gapless, written

WINDOW = 2048
#: Pieces of one length that a task ranks at once, about.
BUCKET_ROWS = 100_000
#: Words whose ids a worker remembers; with more it begins anew.
CACHE_WORDS = 800_000
#: Bytes that they may take, about; an executor has a worker for each of its cores, beside its own heap.
CACHE_BYTES = 70_000_000
#: Bytes of a word besides its characters and ids: two objects and a slot.
_WORD_BYTES = 200
#: Texts of these characters alone are cut into words here: none of them is changed by the tokenizer but to lower case.
_PLAIN = re.compile("[\t\n\r -~À-ÖØ-öø-ÿ]*")
#: The tokenizer's own pattern, for lower-case texts of those characters.
_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ \t\n\ra-zß-öø-ÿ0-9]+")


class WordEncoder:
    """Ids of whole texts, as little-endian 32-bit integers, for the tokenizer of a file with word ends (as word_bpe_49k.json).

    Its words never join, and the last id of a word, and only that, is one with a word end. So the words of texts in plain
    characters are looked up in a cache; new ones are encoded together, by the same model without the steps that have
    been taken, and their ids are cut behind word ends. All other texts, and those that hold a special token, go through
    the tokenizer as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.held = 0

    def _learn(self, need: list[str]) -> None:
        for at in range(0, len(need), 16384):
            part = need[at : at + 16384]
            ids = np.array(self.model.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = [0, *(4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()]
            raw = ids.tobytes()
            if len(cuts) != len(part) + 1:
                raise ValueError("a tokenizer whose words have no ends")
            self.held += _WORD_BYTES * len(part) + sum(map(len, part)) + len(raw)
            self.known.update(zip(part, map(raw.__getitem__, map(slice, cuts, cuts[1:])), strict=False))

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        if len(self.known) > CACHE_WORDS or self.held > CACHE_BYTES:
            self.known.clear()
            self.held = 0
        known = self.known
        plain = [_WORDS.findall(t.lower()) if _PLAIN.fullmatch(t) and not any(x in t for x in self.special) else None for t in texts]
        self._learn([*set().union(*filter(None, plain)).difference(known)])
        ids = lambda w: b"".join(itemgetter(*w)(known)) if len(w) > 1 else known[w[0]] if w else b""
        return [self._whole(t) if words is None else ids(words) for t, words in zip(texts, plain, strict=True)]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One for each Python worker, which lives for many tasks."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def pieces_of(ids: bytes, window: int) -> list[tuple[int, int, int]]:
    """(start, length, checksum) of each piece: full windows, then the rest."""
    n = len(ids) // 4
    return [(s, min(window, n - s), zlib.crc32(ids[4 * s : 4 * min(s + window, n)])) for s in range(0, n, window)]


def tokenized_pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens (and ids, as an array) of each piece. A null text is an empty one: it has the end id only."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer)
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256]
                rows = []
                for i, ids in zip(part["doc_id"], enc.encode([t if isinstance(t, str) else "" for t in part["text"]]), strict=True):
                    ids += end
                    for s, n, crc in pieces_of(ids, window):
                        row = (i, s, n, crc, len(ids) // 4)
                        rows.append((*row, np.frombuffer(ids, "<u4")[s : s + n].astype(np.int32)) if with_ids else row)
                out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids])
                out["doc_id"] = out["doc_id"].astype("Int64")
                yield out

    more = ", ids array<int>" if with_ids else ""
    return docs_of(docs, id_col, text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, f"doc_id long, start long, length long, ids_crc32 long, doc_tokens long{more}")


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths, the longest left among them, whose sum is closest to the capacity from below.

    Subset sums are bits of an integer. Lengths are added from the longest on, a copy at a
    time, until the capacity itself is reached or all are in; the counts follow from the
    first bitset that holds each sum.
    """
    first = max(counts)
    room = capacity - first
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for n in sorted((n for n in counts if n <= room), reverse=True):
        for _ in range(min(counts[n] - (n == first), room // n)):
            wider = (reach | reach << n) & mask
            if wider == reach:
                break
            steps.append((n, reach))
            reach = wider
            if reach >> room & 1:
                break
        if reach >> room & 1:
            break
    used, total = {first: 1}, reach.bit_length() - 1
    for n, before in reversed(steps):
        if not before >> total & 1:  # this copy was needed
            used[n] = used.get(n, 0) + 1
            total -= n
    return used


def patterns(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(lengths with their counts, number of windows) until no length is left."""
    left = {n: c for n, c in histogram.items() if c}
    out = []
    while left:
        used = fill(left, capacity)
        times = min(left[n] // m for n, m in used.items())
        out.append((used, times))
        for n, m in used.items():
            left[n] -= m * times
            if not left[n]:
                del left[n]
    return out


def placements(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, from_rank, to_rank, copies, first_sequence, offset): where the pieces of a length go, by their rank."""
    ranks: dict[int, int] = {}
    rows, base = [], 0
    for used, times in patterns(histogram, capacity):
        offset = 0
        for n in sorted(used, reverse=True):
            m, r = used[n], ranks.get(n, 0)
            rows.append((n, r, r + m * times, m, base, offset))
            ranks[n] = r + m * times
            offset += m * n
        base += times
    return rows


def pack(pieces: DataFrame, capacity: int = WINDOW) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, start, length, ...), no longer than the capacity.

    Sequences are numbered from 0 without gaps; a sequence's pieces fill it from offset 0
    without gaps or overlaps. The histogram has at most ``capacity`` counts, and the plan that is
    joined back a few rows for each; neither grows with the input. Pieces are ranked
    within their length in hashed buckets, so that one very common length is not one task.
    An empty table gives no rows; repeated rows each get a place.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = spark.createDataFrame(placements(histogram, capacity), "p_length long, p_from long, p_to long, p_copies long, p_first long, p_offset long")
    # enough buckets that each holds a bounded number of pieces of the most frequent length
    buckets = max(64, -(-max(histogram.values(), default=0) // BUCKET_ROWS))
    ranked = gapless(pieces, "length", ["doc_id", "start", "ids_crc32"], "_rank", buckets)
    rank = F.col("_rank") - F.col("p_from")
    return (
        ranked.join(F.broadcast(plan), (F.col("length") == F.col("p_length")) & (F.col("_rank") >= F.col("p_from")) & (F.col("_rank") < F.col("p_to")))
        .withColumn("sequence_id", (F.col("p_first") + F.floor(rank / F.col("p_copies"))).cast("long"))
        .withColumn("offset", (F.col("p_offset") + rank % F.col("p_copies") * F.col("length")).cast("long"))
        .drop("_rank", "p_length", "p_from", "p_to", "p_copies", "p_first", "p_offset")
    )


def packed(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Each document's pieces with their places in sequences of at most ``window`` tokens.

    doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids). Null and
    empty texts hold the end id alone. Very long texts become many full windows and one
    rest. Null or repeated ids, repeated rows and ties are packed row by row. Other columns are
    ignored. An empty table gives no rows.
    """
    return pack(written(tokenized_pieces(docs, tokenizer, window, end_id, id_col, text_col, with_ids)), window)
