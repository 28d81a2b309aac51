"""The operators' queries over the driver's tables, and their equivalents in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom import config as cfg
from docloom.functions import text as T
from docloom.operators import changes, lexrank, lines, markdown, summarize, synthesis
from docloom.plans import report
from docloom.plans import views as V

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
FILE = ["repo", "path"]


def query(sql: str | None, ints: str = "") -> Callable[[Query], Query]:
    """Registers a query under its function's name. ``ints``: the columns of the SQL that are 32-bit integers here."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            casts = ", ".join(f"CAST({c} AS INTEGER) AS {c}" for c in ints.split())
            ORACLES[f.__name__] = f"SELECT * REPLACE ({casts}) FROM ({sql})" if casts else sql
        return f

    return add


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


SP = f"[{T.SPACE}]"
TRIM = lambda x: f"regexp_replace({x}, {_q(T.TRIM)}, '', 'g')"

# -- commits and options


def _since(spark: SparkSession, sf_dir: str) -> int:
    now = V.table(spark, sf_dir, "events").agg(F.max(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)).cast("long").alias("now"))
    return now.select(T.since_seconds(F.col("now"), V.DAYS).alias("since")).first()["since"] or 0


def _take_while_sql(order: str) -> str:
    return f"""
        WITH c AS ({V.COMMITS_SQL.format(order=order)}), s AS (SELECT repo, min(walk_ordinal) FILTER (commit_ts < {V.SINCE_SQL}) AS stop FROM c GROUP BY repo)
        SELECT c.* FROM c JOIN s USING (repo) WHERE stop IS NULL OR walk_ordinal < stop
    """


@query(_take_while_sql(V.IN_TIME))
def since_takewhile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.take_while_recent(V.commits(spark, sf_dir), F.lit(_since(spark, sf_dir)))


@query(_take_while_sql(V.BY_ID))
def since_filter_skewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.take_while_recent(V.commits(spark, sf_dir, skewed=True), F.lit(_since(spark, sf_dir)))


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(f"""
    WITH p AS (SELECT page_id, url, url || CASE page_id % 4 WHEN 0 THEN '.MD' WHEN 1 THEN '.tar.md' WHEN 2 THEN '.markdown' ELSE '.md.txt' END AS path FROM pages)
    SELECT page_id, path FROM p WHERE {_LOWER.format("path")} LIKE '%.md' OR {_LOWER.format("path")} LIKE '%.markdown'
""")
def ext_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 4
    ending = F.when(k == 0, ".MD").when(k == 1, ".tar.md").when(k == 2, ".markdown").otherwise(".md.txt")
    paths = V.table(spark, sf_dir, "pages").select("page_id", F.concat("url", ending).alias("path"))
    return paths.where(T.matches_extension(F.col("path"), F.array(F.lit(".md"), F.lit(".markdown"))))


_OPTIONS = [
    (0, "./repo", 0, None, None), (1, "./repo", 1, ["md"], None), (2, "./repo", 1, [".md", ".MD"], None), (3, "./repo", 1, None, "   "),
    (4, " ./repo ", 7, [" .RST ", ".md"], " Highlight risk areas. "), (5, "   ", 1, None, None), (6, "./repo", 1, [], None), (7, "./repo", 1, [".m d"], None),
    (8, "./repo", 1, [" "], None), (9, "./repo", 1, [".md/x"], None), (10, "./repo", 1, [".md", ".txt", ".x\\y"], None), (11, "./repo", 2, [" .MD ", " .MarkDown "], "x"),
    (12, "", 0, [], " "),
]


def _options(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_OPTIONS, "request_id long, repo_path string, days_since int, target_extensions array<string>, custom_prompt string")


def _sql_value(x: object) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, list):
        return "CAST([" + ", ".join(map(_sql_value, x)) + "] AS VARCHAR[])"
    return str(x) if isinstance(x, int) else _q(str(x))


_OPTIONS_SQL = "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(_sql_value, r)) + ")" for r in _OPTIONS) + ") o(request_id, repo_path, days_since, target_extensions, custom_prompt)"


@query(f"""
    SELECT CAST(request_id AS BIGINT) AS request_id, CASE WHEN target_extensions IS NULL OR len(target_extensions) = 0 THEN '.md,.markdown'
        ELSE array_to_string(list_transform(target_extensions, lambda e: {_LOWER.format(TRIM("e"))}), ',') END AS extensions
    FROM ({_OPTIONS_SQL})
""")
def ext_effective(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _options(spark).select("request_id", F.array_join(T.effective_extensions(F.col("target_extensions")), ",").alias("extensions"))


def _told(message: str) -> str:
    return f"replace({_q(message)}, '%s', e)"


@query(f"""
    WITH o AS ({_OPTIONS_SQL}), each AS (
        SELECT request_id, u.i AS k, {TRIM("target_extensions[u.i]")} AS e FROM o, unnest(range(1, len(target_extensions) + 1)) u(i)
    ), faults AS (
        SELECT request_id, k, CASE WHEN e = '' THEN {_q(cfg.BLANK_EXTENSION)} WHEN regexp_matches(e, {_q(SP)}) THEN {_told(cfg.SPACED_EXTENSION)}
            WHEN NOT starts_with(e, '.') THEN {_told(cfg.UNDOTTED_EXTENSION)} WHEN e LIKE '%/%' OR contains(e, chr(92)) THEN {_told(cfg.PATH_EXTENSION)}
            WHEN EXISTS (SELECT 1 FROM each x WHERE x.request_id = each.request_id AND x.k < each.k AND {_LOWER.format("x.e")} = {_LOWER.format("each.e")}) THEN {_told(cfg.REPEATED_EXTENSION)} END AS fault
        FROM each
    ), firsts AS (SELECT request_id, arg_min(fault, k) FILTER (fault IS NOT NULL) AS fault FROM faults GROUP BY request_id)
    SELECT CAST(request_id AS BIGINT) AS request_id, CASE WHEN {TRIM("repo_path")} = '' THEN {_q(cfg.BLANK_PATH)} WHEN days_since = 0 THEN {_q(cfg.ZERO_DAYS)}
        WHEN len(target_extensions) = 0 THEN {_q(cfg.NO_EXTENSIONS)} WHEN fault IS NOT NULL THEN fault
        WHEN custom_prompt IS NOT NULL AND {TRIM("custom_prompt")} = '' THEN {_q(cfg.BLANK_PROMPT)} END AS fault
    FROM o LEFT JOIN firsts USING (request_id)
""")
def options_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    fault = cfg.options_fault(F.col("repo_path"), F.col("days_since"), F.col("target_extensions"), F.col("custom_prompt"))
    return _options(spark).select("request_id", fault.alias("fault"))


# -- lines


@query("SELECT event_id, regexp_replace(props || CASE event_id % 3 WHEN 0 THEN chr(13) || chr(10) WHEN 1 THEN chr(10) || chr(10) ELSE '' END, '[\\r\\n]+$', '') AS content FROM events")
def line_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 3
    raw = F.concat("props", F.when(k == 0, "\r\n").when(k == 1, "\n\n").otherwise(""))
    return V.table(spark, sf_dir, "events").select("event_id", T.strip_line_end(raw).alias("content"))


@query("SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) - CASE WHEN text LIKE '%' || chr(10) THEN 1 ELSE 0 END END AS n_lines FROM documents")
def line_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.documents(spark, sf_dir).select("doc_id", lines.line_count(F.col("text")).cast("long").alias("n_lines"))


_STARTS_SQL = """
    SELECT doc_id, u.i AS line_number, octet_length(encode(a[u.i])) AS n,
           sum(octet_length(encode(a[u.i])) + 1) OVER (PARTITION BY doc_id ORDER BY u.i) AS next_start, octet_length(encode(text)) AS total, text
    FROM (SELECT doc_id, text, string_split(text, chr(10)) AS a FROM documents), unnest(range(1, len(a) + 1)) u(i)
"""


@query(f"SELECT doc_id, line_number, CAST(next_start - n - 1 AS BIGINT) AS byte_start, CAST(next_start AS BIGINT) AS next_start FROM ({_STARTS_SQL})")
def line_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.exploded_starts(V.documents(spark, sf_dir), ["doc_id"]).withColumn("line_number", F.col("line_number").cast("long"))


def _line_of(off: str) -> str:
    return f"CASE WHEN {off} BETWEEN 0 AND total THEN greatest(least(count(*) FILTER (byte_start <= {off}), count(*) FILTER (byte_start < total)), 1) END"


_S = f"(SELECT doc_id, CAST(next_start - n - 1 AS BIGINT) AS byte_start, total FROM ({_STARTS_SQL}))"


@query(f"""
    SELECT doc_id, {_line_of("total // 2")} AS middle, {_line_of("total")} AS last, {_line_of("total + 1")} AS beyond FROM {_S} GROUP BY doc_id, total
""")
def offset_to_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.octet_length("text").cast("long")
    at = lambda off: lines.line_of(F.col("starts"), off, n).cast("long")
    docs = V.documents(spark, sf_dir).where("text IS NOT NULL").select("doc_id", "text", lines.line_starts(F.col("text")).alias("starts"))
    return docs.select("doc_id", at(F.floor(n / 2)).alias("middle"), at(n).alias("last"), at(n + 1).alias("beyond"))


@query(f"""
    SELECT doc_id, {_line_of("total // 3")} AS first_line,
           greatest(least(count(*) FILTER (byte_start <= CASE WHEN total // 3 = total // 2 THEN total // 3 ELSE total // 2 - 1 END), count(*) FILTER (byte_start < total)), 1) AS last_line
    FROM {_S} GROUP BY doc_id, total
""")
def line_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.octet_length("text").cast("long")
    docs = V.documents(spark, sf_dir).where("text IS NOT NULL").select("doc_id", "text", lines.line_starts(F.col("text")).alias("starts"))
    span = lines.line_span(F.col("starts"), F.floor(n / 3), F.floor(n / 2), n)
    return docs.select("doc_id", span.alias("s")).select("doc_id", F.col("s.first").cast("long").alias("first_line"), F.col("s.last").cast("long").alias("last_line"))


# -- sections and changes

_SECTIONS_SQL = f"""
    SELECT repo, path, length(regexp_extract(content, '^ {{0,3}}(#{{1,6}})', 1)) AS level, {TRIM("regexp_replace(regexp_replace(content, '^ {0,3}#{1,6}[ ]+', ''), '[ ]+', ' ', 'g')")} AS title,
           line_number AS start_line, greatest(coalesce(lead(line_number) OVER (PARTITION BY repo, path ORDER BY line_number) - 1, total), line_number) AS end_line
    FROM (SELECT *, max(line_number) OVER (PARTITION BY repo, path) AS total FROM ({V.LINES_SQL})) WHERE regexp_matches(content, '^ {{0,3}}#{{1,6}} ')
"""


@query(_SECTIONS_SQL, ints="level start_line end_line")
def md_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.sections(V.markdown_docs(spark, sf_dir), FILE)


@query(_SECTIONS_SQL, ints="level start_line end_line")
def md_sections_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.parsed_sections(V.markdown_docs(spark, sf_dir), FILE)


_JOINED = "string_agg('+' || line_number || ' ' || content, chr(10) ORDER BY line_number, content)"


def _joined(rows: DataFrame) -> DataFrame:
    text = F.array_join(F.transform("added_lines", lambda x: F.concat(F.lit("+"), x["line_number"].cast("string"), F.lit(" "), x["content"])), "\n")
    return rows.withColumn("lines", text).drop("added_lines")


@query(f"SELECT repo, path, {_JOINED} AS lines FROM ({V.ADDED_SQL}) GROUP BY repo, path")
def added_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(changes.by_file(V.added(spark, sf_dir)))


_ATTRIBUTED = """
    SELECT a.repo, a.path, a.line_number, a.content, coalesce(s.start_line, 0) AS start_line, s.title AS section_title, s.level AS section_level
    FROM ({added}) a LEFT JOIN ({sections}) s ON a.repo = s.repo AND a.path = s.path AND a.line_number BETWEEN s.start_line AND s.end_line
"""
_CORRELATED = _ATTRIBUTED.format(added=V.ADDED_SQL, sections=_SECTIONS_SQL)
_LEVEL_2 = f"SELECT * FROM ({_SECTIONS_SQL}) WHERE level = 2"


@query(f"SELECT repo, path, start_line, section_title, section_level, {_JOINED} AS lines FROM ({_CORRELATED}) GROUP BY ALL", ints="section_level start_line")
def correlate_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(changes.correlate(V.added(spark, sf_dir), md_sections(spark, sf_dir)))


@query(f"SELECT repo, path, line_number, content FROM ({_ATTRIBUTED.format(added=V.ADDED_SQL, sections=_LEVEL_2)}) WHERE section_title IS NULL", ints="line_number")
def no_heading_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    sections = md_sections(spark, sf_dir).where("level = 2")
    return changes.attribute(V.added(spark, sf_dir), sections).where("section_title IS NULL").select("repo", "path", "line_number", "content")


# -- reports


@query(f"""
    WITH a AS ({V.ADDED_SQL}), r AS (SELECT *, row_number() OVER (PARTITION BY repo, path ORDER BY line_number, content) AS rn, count(*) OVER (PARTITION BY repo, path) AS n FROM a),
    f AS (SELECT repo, path, '### ' || path || chr(10) || string_agg('  +' || line_number || ' ' || content, chr(10) ORDER BY rn)
              || CASE WHEN max(n) > 10 THEN chr(10) || '  ... (+' || (max(n) - 10) || ' more lines)' ELSE '' END AS section FROM r WHERE rn <= 10 GROUP BY repo, path),
    b AS (SELECT repo, string_agg(section, chr(10) || chr(10) ORDER BY path) AS body FROM f GROUP BY repo)
    SELECT q.repo, coalesce('Git activity report for `' || repo_path || '`' || chr(10) || chr(10) || body,
                            'No Markdown changes detected for `' || repo_path || '` in the last ' || days_since || ' day(s).') AS report
    FROM ({V.REQUESTS_SQL}) q LEFT JOIN b USING (repo)
""")
def git_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.git_reports(V.requests(spark, sf_dir), V.added(spark, sf_dir))


_RAG_SQL = f"""
    WITH c AS ({_CORRELATED}), k AS (
        SELECT repo, path, start_line, '  Section: ' || coalesce(section_title, '(no heading)') || coalesce(' (level ' || section_level || ')', '') || chr(10)
            || string_agg('    +' || line_number || ' ' || {TRIM("content")} || chr(10), '' ORDER BY line_number, content) || chr(10) AS block
        FROM c GROUP BY repo, path, start_line, section_title, section_level
    ), f AS (SELECT repo, path, 'File: ' || path || chr(10) || string_agg(block, '' ORDER BY start_line) AS t FROM k GROUP BY repo, path),
    b AS (SELECT repo, string_agg(t, '' ORDER BY path) AS body FROM f GROUP BY repo),
    p AS (
        SELECT q.repo, repo_path, days_since, CASE WHEN body IS NOT NULL THEN regexp_replace({_q(report.ROLE)} || 'Repository: ' || {TRIM("repo_path")} || chr(10) || 'Time Window: Last ' || days_since || ' day(s)'
            || chr(10) || chr(10) || CASE WHEN {TRIM("coalesce(custom_prompt, '')")} <> '' THEN {_q(report.GUIDANCE)} || {TRIM("custom_prompt")} || chr(10) || chr(10) ELSE '' END
            || {_q(report.TASK)} || body, {_q(SP + "+$")}, '') END AS prompt
        FROM ({V.REQUESTS_SQL}) q LEFT JOIN b USING (repo)
    )
"""


def _rag(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = changes.correlate(V.added(spark, sf_dir), md_sections(spark, sf_dir))
    return report.rag_reports(V.requests(spark, sf_dir), found)


@query(f"{_RAG_SQL} SELECT repo, prompt FROM p WHERE prompt IS NOT NULL")
def rag_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rag(spark, sf_dir).where("prompt IS NOT NULL").select("repo", "prompt")


_FALLBACK_SQL = f"'No relevant Markdown additions detected for `' || {TRIM('repo_path')} || '` within the last ' || days_since || ' day(s).'"


@query(f"{_RAG_SQL} SELECT repo, {_FALLBACK_SQL} AS message FROM p WHERE prompt IS NULL")
def rag_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rag(spark, sf_dir).where(F.col("kind") == report.FALLBACK).select("repo", "message")


@query(f"""
    {_RAG_SQL} SELECT repo, CASE WHEN prompt IS NULL THEN 'FALLBACK' ELSE 'SYNTHESIZED' END AS kind, prompt, '[mock-bytes:5] ' || {TRIM("prompt")} AS summary,
        CASE WHEN prompt IS NULL THEN {_FALLBACK_SQL} END AS message FROM p
""")
def rag_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rag(spark, sf_dir)


# -- sentences and tokens

_SENTENCES = f"""
    sentences AS (
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY si, pi) - 1 AS position, sentence FROM (
            SELECT doc_id, si, u.i AS pi, {TRIM(f"regexp_extract(p[u.i], {_q(T.HEAD)})")}
                || regexp_replace(substr(p[u.i], length(regexp_extract(p[u.i], {_q(T.HEAD)})) + 1), {_q(SP)}, '', 'g') AS sentence
            FROM (
                SELECT doc_id, v.i AS si, regexp_extract_all(a[v.i], {_q(T.PIECES)}) AS p
                FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL), unnest(range(1, len(a) + 1)) v(i)
            ), unnest(range(1, len(p) + 1)) u(i)
        ) WHERE sentence <> ''
    )
"""
_STOP = ", ".join(map(_q, T.STOPWORDS))
_TOKENS = f"""
    raw AS (
        SELECT doc_id, position, u.i AS k, regexp_replace({TRIM("w[u.i]")}, {_q(T.MARKS)}, '', 'g') AS t
        FROM (SELECT doc_id, position, string_split_regex(sentence, {_q(SP + "+")}) AS w FROM sentences WHERE length(sentence) >= 25), unnest(range(1, len(w) + 1)) u(i)
    ), tokens AS (
        SELECT doc_id, position, k, t AS token FROM (SELECT doc_id, position, k, CASE WHEN octet_length(encode(t)) = length(t) THEN {_LOWER.format("t")} ELSE t END AS t FROM raw)
        WHERE t <> '' AND NOT regexp_matches(t, '^[a-z]$') AND t NOT IN ({_STOP})
    )
"""
_BAGS = "bags AS (SELECT doc_id, position, token, least(count(*), 6) AS freq, max(total) AS total FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, position) AS total FROM tokens) GROUP BY doc_id, position, token)"
_TFIDF = """
    dfs AS (SELECT doc_id, token, count(*) AS df FROM bags GROUP BY doc_id, token), ns AS (SELECT doc_id, count(DISTINCT position) AS n FROM bags GROUP BY doc_id),
    tfidf AS (SELECT doc_id, position, token, freq / greatest(total, 1) * (ln((n + 1) / (df + 1)) + 1) AS w FROM bags JOIN dfs USING (doc_id, token) JOIN ns USING (doc_id))
"""
_EDGES = """
    norms AS (SELECT doc_id, position, sqrt(sum(w * w)) AS norm FROM tfidf GROUP BY doc_id, position),
    dots AS (SELECT a.doc_id, a.position AS i, b.position AS j, sum(a.w * b.w) AS dot FROM tfidf a JOIN tfidf b ON a.doc_id = b.doc_id AND a.token = b.token AND a.position < b.position GROUP BY ALL),
    edges AS (SELECT d.doc_id, d.i, d.j, round(dot / (x.norm * y.norm), 9) AS w FROM dots d JOIN norms x ON d.doc_id = x.doc_id AND d.i = x.position JOIN norms y ON d.doc_id = y.doc_id AND d.j = y.position
              WHERE round(dot / (x.norm * y.norm), 9) >= 0.12),
    arcs AS (SELECT doc_id, i, j, w / sum(w) OVER (PARTITION BY doc_id, i) AS p FROM (SELECT doc_id, i, j, w FROM edges UNION ALL SELECT doc_id, j, i, w FROM edges))
"""
_STEPS = f"WITH RECURSIVE {_SENTENCES}, {_TOKENS}, {_BAGS}, {_TFIDF}, {_EDGES}"
_RANKS = """
    nodes AS (SELECT b.doc_id, b.position, n, NOT EXISTS (SELECT 1 FROM arcs WHERE arcs.doc_id = b.doc_id AND arcs.i = b.position) AS loose FROM (SELECT DISTINCT doc_id, position FROM bags) b JOIN ns USING (doc_id)),
    power AS (
        SELECT 0 AS it, doc_id, position, 1.0::DOUBLE / n AS score FROM nodes
        UNION ALL
        SELECT s.it, s.doc_id, s.position, s.raw / sum(s.raw) OVER (PARTITION BY s.doc_id) AS score FROM (
            SELECT p.it + 1 AS it, nd.doc_id, nd.position, 0.15 / nd.n + 0.85 * (coalesce(g.spread, 0) + p.lost / nd.n) AS raw
            FROM nodes nd
            JOIN (SELECT power.it, power.doc_id, sum(CASE WHEN loose THEN score ELSE 0 END) AS lost FROM power JOIN nodes USING (doc_id, position) WHERE power.it < 50 GROUP BY power.it, power.doc_id) p ON p.doc_id = nd.doc_id
            LEFT JOIN (SELECT arcs.doc_id, arcs.j, sum(score * arcs.p) AS spread FROM power JOIN arcs ON arcs.doc_id = power.doc_id AND arcs.i = power.position GROUP BY arcs.doc_id, arcs.j) g
              ON g.doc_id = nd.doc_id AND g.j = nd.position
        ) s
    ),
    deltas AS (SELECT a.doc_id, a.it, sum(abs(a.score - b.score)) AS delta FROM power a JOIN power b ON a.doc_id = b.doc_id AND a.position = b.position AND a.it = b.it + 1 GROUP BY a.doc_id, a.it),
    stops AS (SELECT doc_id, coalesce(min(it) FILTER (delta < 1e-4), 50) AS iterations, coalesce(bool_or(delta < 1e-4), FALSE) AS converged FROM deltas GROUP BY doc_id),
    final AS (SELECT p.doc_id, p.position, round(round(p.score, 12), 5) AS score, converged FROM power p JOIN stops s ON p.doc_id = s.doc_id AND p.it = s.iterations),
    places AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, position) AS rn FROM final),
    chosen AS (SELECT * FROM places WHERE converged AND (rn = 1 OR (score >= 0.12 AND rn <= 5)))
"""


@query(f"WITH {_SENTENCES} SELECT doc_id, position, sentence FROM sentences", ints="position")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.documents(spark, sf_dir).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("position", "sentence"))


@query(f"WITH {_SENTENCES} SELECT doc_id, position, sentence FROM sentences WHERE position < 3", ints="position")
def first_n_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.documents(spark, sf_dir).select("doc_id", F.posexplode(T.first_sentences(F.col("text"), 3)).alias("position", "sentence"))


_NOISE = f"regexp_matches(sentence, {_q(f'^[{T.NOISE}]*$')})"


@query(f"WITH {_SENTENCES} SELECT doc_id, min(position) AS position, arg_min(sentence, position) AS sentence FROM sentences WHERE NOT {_NOISE} GROUP BY doc_id", ints="position")
def fallback_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = V.documents(spark, sf_dir).select("doc_id", T.fallback_sentence(F.col("text")).alias("s")).where("s IS NOT NULL")
    return found.select("doc_id", "s.position", F.col("s.text").alias("sentence"))


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexrank.node_rows(V.documents(spark, sf_dir))


@query(f"WITH {_SENTENCES}, {_TOKENS} SELECT doc_id, position, string_agg(token, ' ' ORDER BY k) AS tokens FROM tokens GROUP BY doc_id, position", ints="position")
def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir).select("doc_id", "position", F.array_join("tokens", " ").alias("tokens"))


@query(f"WITH {_SENTENCES}, {_TOKENS}, {_BAGS} SELECT doc_id, position, token, freq, total FROM bags", ints="position")
def bag_of_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexrank.bag_of_words(_nodes(spark, sf_dir)).withColumn("total", F.col("total").cast("long"))


@query(f"WITH {_SENTENCES}, {_TOKENS}, {_BAGS}, {_TFIDF} SELECT doc_id, token, df FROM dfs")
def doc_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexrank.document_frequency(lexrank.bag_of_words(_nodes(spark, sf_dir)))


def _round(c: str, places: int) -> Column:
    """A double as DuckDB rounds it: halves of the product go up. Spark's round() takes the shortest decimal for the value."""
    return F.floor(F.col(c) * 10.0**places + 0.5) / F.lit(10.0**places)


@query(f"WITH {_SENTENCES}, {_TOKENS}, {_BAGS}, {_TFIDF} SELECT doc_id, position, token, round(w, 9) AS w FROM tfidf", ints="position")
def tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexrank.tfidf(V.documents(spark, sf_dir)).withColumn("w", _round("w", 9))


@query(f"{_STEPS} SELECT doc_id, i, j, round(w, 6) AS w FROM edges", ints="i j")
def cosine_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexrank.cosine_edges(V.documents(spark, sf_dir)).withColumn("w", _round("w", 6))


@query(f"{_STEPS} SELECT doc_id, i, j, round(p, 6) AS p FROM arcs", ints="i j")
def transition_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexrank.transition_rows(V.documents(spark, sf_dir)).withColumn("p", _round("p", 6))


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexrank.ranked(V.documents(spark, sf_dir)).where(F.size("result.scores") > 0)


@query(f"{_STEPS}, {_RANKS} SELECT doc_id, position, score FROM final WHERE converged", ints="position")
def lexrank_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ranked(spark, sf_dir).where("result.converged").select("doc_id", "nodes", F.explode("order").alias("x"))
    return rows.select("doc_id", F.get(F.col("nodes"), F.col("x.k"))["position"].alias("position"), F.col("x.score").alias("score"))


@query(f"{_STEPS}, {_RANKS} SELECT doc_id, converged, iterations FROM stops")
def lexrank_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir).select("doc_id", "result.converged", "result.iterations")


@query(f"{_STEPS}, {_RANKS} SELECT doc_id, rn AS rank, position, score FROM chosen", ints="position")
def lexrank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ranked(spark, sf_dir).where("result.converged").select("doc_id", "nodes", F.posexplode(lexrank.selected(F.col("order"))).alias("at", "x"))
    return rows.select("doc_id", (F.col("at") + 1).cast("long").alias("rank"), F.get(F.col("nodes"), F.col("x.k"))["position"].alias("position"), F.col("x.score").alias("score"))


_PROMPT = f"{_q(summarize.INTRO)} || coalesce(list, '') || {_q(summarize.ORIGINAL)} || {TRIM('d.text')}"


@query(f"""
    {_STEPS}, {_RANKS}, fallback AS (SELECT doc_id, min(position) AS position FROM sentences WHERE NOT {_NOISE} GROUP BY doc_id),
    picked AS (
        SELECT doc_id, position FROM chosen
        UNION ALL SELECT doc_id, position FROM fallback WHERE doc_id NOT IN (SELECT doc_id FROM stops)
    ), lists AS (
        SELECT doc_id, string_agg(k || '. ' || sentence || chr(10), '' ORDER BY k) AS list, string_agg(sentence, chr(10) ORDER BY k) AS extracted FROM (
            SELECT doc_id, sentence, row_number() OVER (PARTITION BY doc_id ORDER BY position) AS k FROM picked JOIN sentences USING (doc_id, position)
        ) GROUP BY doc_id
    ), states AS (
        SELECT d.doc_id, CASE WHEN {TRIM("coalesce(d.text, '')")} = '' THEN 'INVALID_INPUT' WHEN NOT coalesce(converged, TRUE) THEN 'NOT_CONVERGED' WHEN list IS NULL THEN 'NO_CANDIDATES' ELSE 'OK' END AS status,
               extracted, {_PROMPT} AS prompt
        FROM documents d LEFT JOIN stops USING (doc_id) LEFT JOIN lists USING (doc_id)
    )
    SELECT doc_id, status, CASE WHEN status = 'OK' THEN extracted ELSE '' END AS extracted, CASE WHEN status = 'OK' THEN '[mock-bytes:5] ' || {TRIM("prompt")} END AS summary FROM states
""")
def hybrid_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = summarize.summarize(V.documents(spark, sf_dir))
    return rows.select("doc_id", "status", F.array_join("extracted_sentences", "\n").alias("extracted"), F.col("synthesized_summary").alias("summary"))


@query(f"""
    SELECT conv_id, '[mock-bytes:5] ' || {TRIM(f"string_agg({TRIM('text')}, chr(10) ORDER BY turn)")} AS summary
    FROM conversations WHERE {TRIM("text")} <> '' GROUP BY conv_id
""")
def synthesize_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = V.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("texts"))
    return turns.select("conv_id", synthesis.mock(synthesis.joined_sentences(F.col("texts")), 5).alias("summary")).where("summary IS NOT NULL")


@query(None)
def gitlog_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commits of this package's own checkout, if it is one; an empty table otherwise."""
    from pathlib import Path

    from docloom.sources import gitlog

    root = Path(__file__).resolve().parents[2]
    gitlog.register(spark)
    if not (root / ".git").exists():
        return spark.createDataFrame([], gitlog.COMMITS)
    return spark.read.format("gitlog").load(str(root))
