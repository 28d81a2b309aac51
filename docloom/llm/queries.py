"""The operators' queries over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import decontam, langid, linededup, packing, quality, sharding, simhash, suffixdedup, topk, toxicity
from docloom.llm._common import table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), 16)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("th")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.topk(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.md5(F.col("text")).alias("kept_md5"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_sharding, op2_language_id, op3_decontamination, op4_quality, op5_exact_topk,
        op6_packing, op7_line_dedup, op8_simhash, op9_suffix_dedup, op10_toxicity,
    )
}


_UNITS = "|".join(sorted(decontam.UNITS, key=lambda u: (-len(u), u)))

#: DuckDB's SQL for the queries that SQL can express.
ORACLES: dict[str, str] = {
    "op5_exact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                   CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
            WHERE q.vec_id % 50 = 0
        ), ranked AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
            FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
    "op3_decontamination": rf"""
        WITH raw AS (
            SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark
        ), figured AS (
            SELECT side, id, regexp_replace(regexp_replace(regexp_replace(text, '([0-9])[.,:/]([0-9])', '\1\2', 'g'), '([0-9])[.,:/]([0-9])', '\1\2', 'g'),
                '([0-9])[\s-]*((?i:{_UNITS}))($|[^\p{{L}}\p{{N}}])', '\1 ' || chr(2) || '\2\3', 'g') AS s
            FROM raw WHERE text IS NOT NULL
        ), cut AS (
            SELECT side, id, regexp_extract_all(s, '[\p{{L}}\p{{N}}' || chr(2) || ']+[^\p{{L}}\p{{N}}' || chr(2) || ']*') AS a FROM figured
        ), tokens AS (
            SELECT side, id, i, regexp_replace(a[i], '[^\p{{L}}\p{{N}}' || chr(2) || ']+$', '') AS tok, regexp_matches(a[i], '^\p{{Lu}}\p{{Ll}}') AS capital,
                i > 1 AND regexp_matches(a[i], '^\p{{Lu}}\p{{Ll}}') AND regexp_matches(a[i - 1], '^\p{{Lu}}\p{{Ll}}\p{{L}}*\s+$') AS goes_on
            FROM cut, unnest(range(1, len(a) + 1)) u(i)
        ), numbered AS (
            SELECT *, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY side, id ORDER BY i) AS run FROM tokens
        ), named AS (
            SELECT side, id, run, (CASE WHEN bool_or(capital) THEN chr(1) ELSE '' END) || string_agg(lower(tok), '_' ORDER BY i) AS w FROM numbered GROUP BY side, id, run
        ), words AS (
            SELECT 0 AS kind, side, id, list(lower(tok) ORDER BY i) AS w FROM tokens GROUP BY side, id
            UNION ALL SELECT 1, side, id, list(w ORDER BY run) FROM named GROUP BY side, id
        ), templates AS (
            SELECT kind, side, id, w, list_transform(w, lambda x: CASE WHEN x[1] = chr(1) THEN chr(1) || 'name' WHEN x[1] = chr(2) THEN chr(2) || 'unit'
                WHEN x < ':' THEN '0number' ELSE x END) AS t
            FROM words WHERE len(w) >= 5
        ), windows AS (
            SELECT kind, side, id, i AS place, array_to_string(list_slice(t, i, i + 4), ' ') AS h, array_to_string(list_slice(w, i, i + 4), ' ') AS v,
                list_filter(list_slice(w, i, i + 4), lambda x: x < ':') AS slots
            FROM templates, unnest(range(1, len(w) - 3)) u(i)
        ), hits AS (
            SELECT d.kind, d.id AS doc_id, b.id AS item_id, d.place - b.place AS shift, b.place AS b, b.slots AS bs, d.slots AS ds, len(b.slots) <= 3 AS strong, d.v = b.v AS alike
            FROM windows d JOIN windows b ON d.kind = b.kind AND d.h = b.h WHERE d.side = 0 AND b.side = 1
        ), lines AS (
            SELECT DISTINCT kind, doc_id, item_id, shift FROM hits WHERE strong
        ), aligned AS (
            SELECT hits.* FROM hits JOIN lines USING (kind, doc_id, item_id, shift)
        ), pairs AS (
            SELECT DISTINCT kind, doc_id, item_id, shift, unnest(bs) AS x, unnest(ds) AS y FROM aligned WHERE len(bs) > 0
        ), maps AS (
            SELECT kind, doc_id, item_id, shift, count(*) = count(DISTINCT x) AND count(*) = count(DISTINCT y) AS fits, bool_or(x <> y) AS differs
            FROM pairs GROUP BY kind, doc_id, item_id, shift
        ), places AS (
            SELECT kind, doc_id, item_id, b, coalesce(fits AND differs, FALSE) AS differs FROM aligned LEFT JOIN maps USING (kind, doc_id, item_id, shift) WHERE len(bs) = 0 OR fits
            UNION ALL SELECT kind, doc_id, item_id, b, FALSE FROM hits WHERE kind = 0 AND NOT strong AND alike
        ), found AS (
            SELECT kind, doc_id, item_id, count(DISTINCT b) AS matched, bool_or(differs) AS changed FROM places GROUP BY kind, doc_id, item_id
        ), sizes AS (
            SELECT kind, id AS item_id, count(*) AS windows FROM windows WHERE side = 1 GROUP BY kind, id
        ), enough AS (
            SELECT found.*, windows, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY kind) AS r
            FROM found JOIN sizes USING (kind, item_id) WHERE matched >= ceil(windows * 0.8)
        )
        SELECT doc_id, item_id, matched, windows, changed FROM enough WHERE r = 1
    """,
    "op7_line_dedup": """
        WITH lines AS (
            SELECT doc_id, i - 1 AS pos, a[i] AS raw, trim(a[i], ' ' || chr(9) || chr(13)) AS line
            FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL), unnest(range(1, len(a) + 1)) u(i)
        ), firsts AS (
            SELECT line, min({'d': doc_id, 'p': pos}) AS place FROM lines WHERE length(line) >= 10 GROUP BY line
        ), variants AS (
            SELECT line, place, i, left(line, i - 1) || substr(line, i + 1) AS v
            FROM firsts, unnest(range(1, length(line) + 1)) u(i) WHERE length(line) >= 16
        ), near AS (
            SELECT x.line FROM variants x JOIN variants y ON x.v = y.v AND x.i = y.i AND y.place < x.place
            UNION SELECT x.line FROM variants x JOIN firsts y ON x.v = y.line AND length(y.line) >= 16 AND y.place < x.place
            UNION SELECT y.line FROM variants x JOIN firsts y ON x.v = y.line AND length(y.line) >= 16 AND x.place < y.place
        ), judged AS (
            SELECT doc_id, pos, raw, length(line) >= 10 AND (near.line IS NOT NULL OR firsts.place <> {'d': doc_id, 'p': pos}) AS gone
            FROM lines LEFT JOIN firsts USING (line) LEFT JOIN near USING (line)
        ), kept AS (
            SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
                   coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT coalesce(gone, FALSE)), '') AS text
            FROM judged GROUP BY doc_id
        )
        SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, md5(kept.text) AS kept_md5
        FROM documents LEFT JOIN kept USING (doc_id)
    """,
}
