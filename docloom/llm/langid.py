"""Language identification by compression.

Every language has a dictionary of raw text. A text is compressed, block by block,
with each dictionary; the language whose dictionary makes it smallest wins, and a
text whose two best sizes are nearly the same is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm._common import bounded_ids, id_fold

UNKNOWN = "und"
#: Languages at most (those with the most rows), and training documents of each at most, which count whole.
LANGUAGES, SAMPLE_DOCS = 200, 128
#: Bytes compressed at a time, so that the dictionary counts for all of a long text.
BLOCK = 4096
LEVEL = 3
_FOLD = bytes(i if i >= 128 or chr(i).isalpha() else 32 for i in range(256))


def normalised(text: str) -> bytes:
    """Lower case; digits and ASCII punctuation are blanks, and blanks are single."""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_FOLD).split())


@dataclass(frozen=True)
class LanguageModel:
    """Dictionaries by language, the most frequent language first."""

    dictionaries: tuple[tuple[str, bytes], ...]

    def compressors(self) -> list:
        import zstandard as Z

        out = []
        for _, raw in self.dictionaries:
            d = Z.ZstdCompressionDict(raw or b" " * 8, dict_type=Z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            out.append(Z.ZstdCompressor(dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))
        return out


def sizes(data: bytes, compressors: list) -> list[int]:
    view = memoryview(data)
    return [sum(len(c.compress(view[a : a + BLOCK])) for a in range(0, len(data), BLOCK)) for c in compressors]


def verdict(sizes: list[int]) -> tuple[int, float, float]:
    """Index of the smallest (the first at ties), a score and the relative margin. The score is the share of
    the winner when each size in bytes stands for a probability of 2 to the minus size."""
    a = np.array(sizes, dtype=np.float64)
    best = int(a.argmin())
    if len(a) == 1:
        return best, 1.0, 1.0
    p = np.exp2(-np.minimum(a - a[best], 1000.0))
    rest = np.delete(a, best).min()
    return best, float(1 / p.sum()), float((rest - a[best]) / max(a[best], 1.0))


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Dictionaries from the whole texts of at most SAMPLE_DOCS documents a language, by ascending id (of texts of one id the least)."""
    rows = labelled.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    most = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    seen: dict[str, int] = {r["lang"]: r["n"] for r in most}
    ids = bounded_ids(rows.select("doc_id", "lang").where(F.col("lang").isin([*seen])), "doc_id", ["lang"], SAMPLE_DOCS)
    got = rows.join(F.broadcast(ids), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("piece")).collect()
    text: dict[str, list[bytes]] = {lang: [] for lang in seen}
    for r in sorted(got, key=lambda r: (r["lang"], r["doc_id"])):
        text[r["lang"]].append(normalised(r["piece"]))
    order = sorted(seen, key=lambda lang: (-seen[lang], lang))
    return LanguageModel(tuple((lang, b" ".join(text[lang])) for lang in order))


def predict(docs: DataFrame, model: LanguageModel, min_margin: float = 0.01, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, margin, rejected for each row; only the text is read for it.

    ``rejected`` marks margins under ``min_margin``. Null texts, texts without a letter, and
    all texts if the model has no language, get ``und`` with score 0 and are rejected. Equal
    sizes go to the language with more training rows. Whole texts count, however long. Repeated
    rows and null ids are rows as any other; other columns are ignored; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [lang for lang, _ in sent.value.dictionaries]
        compressors = sent.value.compressors()
        for pdf in batches:
            out = []
            for i, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                if not names or not isinstance(text, str) or not any(map(str.isalpha, text)):
                    out.append((i, UNKNOWN, 0.0, 0.0, True))
                    continue
                k, score, margin = verdict(sizes(normalised(text), compressors))
                out.append((i, names[k], score, margin, margin < min_margin))
            out = pd.DataFrame(out, columns=["doc_id", "lang_pred", "score", "margin", "rejected"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "doc_id long, lang_pred string, score double, margin double, rejected boolean")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learns from two folds of the rows by id, predicts all, and marks the third fold as held out."""
    model = fit(docs.where(id_fold(F.col(id_col)) != 1), id_col, text_col, lang_col)
    return predict(docs, model, id_col=id_col, text_col=text_col).withColumn("held_out", id_fold(F.col("doc_id")) == 1)
