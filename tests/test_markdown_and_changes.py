from pyspark.sql import functions as F

from docloom.operators import changes, lines, markdown
from docloom.plans import report


def parsed(text):
    return markdown.section_rows(text)


def native(spark, text):
    rows = markdown.sections(spark.createDataFrame([(1, text)], "k long, text string"), ["k"]).orderBy("start_line").collect()
    return [(r["level"], r["title"], r["start_line"], r["end_line"]) for r in rows]


BOTH = [
    ("# Title\nLead paragraph.\n\n## Sub\nContent\n\n### Deep\nMore", [(1, "Title", 1, 3), (2, "Sub", 4, 6), (3, "Deep", 7, 8)]),
    ("   \n \n", []),
    ("", []),
    ("```\n# no\n```\n# yes\n", [(1, "yes", 4, 4)]),
    ("#no\n####### no\n#\n", [(1, "", 3, 3)]),
    ("    # code\n# a *b* `c` ##\n", [(1, "a b c", 2, 2)]),
    ("Head\nline\n===\ntext\n\nTwo\n---\n", [(1, "Head line", 1, 5), (2, "Two", 6, 7)]),
    ("a\n\n---\nb\n", []),
]


def test_sections_both_ways(spark):
    for text, want in BOTH:
        assert parsed(text) == want, text
        assert native(spark, text) == want, text


def test_parser_sees_containers_and_html():
    assert parsed("> # quoted\n> text\n") == [(1, "quoted", 1, 2)]
    assert parsed("- # item\n\n  ## inside\n") == [(1, "item", 1, 2), (2, "inside", 3, 3)]
    assert parsed("<div>\n# no\n</div>\n\n# yes\n") == [(1, "yes", 5, 5)]
    assert parsed("<!-- \n\n# no\n-->\n# yes\n") == [(1, "yes", 5, 5)]
    assert parsed("> ```\n> # no\n\n# yes") == [(1, "yes", 4, 4)]
    assert parsed("~~~\n```\n# no\n~~~\n# yes [link](http://x) \\# end\n") == [(1, "yes link # end", 5, 5)]


def test_section_udf_matches_rows(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(BOTH)] + [(99, None)], "k long, text string")
    got = {}
    for r in markdown.parsed_sections(docs, ["k"]).collect():
        got.setdefault(r["k"], []).append((r["level"], r["title"], r["start_line"], r["end_line"]))
    assert got == {i: want for i, (_, want) in enumerate(BOTH) if want}


def test_offsets(spark):
    text = "# Title\nLine two\n\nLine four"
    n = len(text)
    row = spark.createDataFrame([(text,)], "t string").select("t", lines.line_starts(F.col("t")).alias("s"), lines.line_count(F.col("t")).alias("n")).cache()
    at = lambda o: row.select(lines.line_of(F.col("s"), F.lit(o), F.octet_length("t"))).first()[0]
    assert row.first()["n"] == 4 and [at(0), at(2), at(8), at(n)] == [1, 1, 2, 4]
    assert at(1024) is None and at(-1) is None
    span = lambda a, b: row.select(lines.line_span(F.col("s"), F.lit(a), F.lit(b), F.octet_length("t"))).first()[0]
    assert tuple(span(0, 9)) == (1, 2) and tuple(span(8, 8)) == (2, 2) and span(5, 4) is None
    counts = spark.createDataFrame([("",), ("a",), ("a\n",), ("\n",), ("é\n\n",)], "t string").select(lines.line_count(F.col("t"))).collect()
    assert [r[0] for r in counts] == [0, 1, 1, 1, 2]


def test_take_while_stops_at_the_first_old_commit(spark):
    day = 86400
    now = 100 * day
    commits = spark.createDataFrame([("r", "a", now - day, 0), ("r", "b", now - 10 * day, 1), ("r", "c", now - 2 * day, 2), ("q", "d", now - 5 * day, 0), ("q", "e", now, 1)], "repo string, oid string, commit_ts long, walk_ordinal long")
    got = {r["oid"] for r in changes.take_while_recent(commits, F.lit(now - 5 * day)).collect()}
    assert got == {"a", "d", "e"}  # d is exactly at the threshold


def test_keep_added(spark):
    rows = [
        ("r", "a.MD", None, False, "+", 1, "x\r\n"), ("r", "a.txt", None, False, "+", 1, "x"), ("r", None, "old.md", False, "+", 2, "y"), ("r", "b.md", None, True, "+", 1, "x"),
        ("r", "b.md", None, False, "-", 1, "x"), ("r", "b.md", None, False, "+", None, "x"), ("r", "x.tar.md", None, False, "+", 3, "z"),
    ]
    df = spark.createDataFrame(rows, "repo string, new_path string, old_path string, is_binary boolean, origin string, line_number int, content string")
    got = {tuple(r) for r in changes.keep_added(df, F.array(F.lit(".md"))).collect()}
    assert got == {("r", "a.MD", 1, "x"), ("r", "old.md", 2, "y"), ("r", "x.tar.md", 3, "z")}


def correlated(spark, doc, added):
    docs = spark.createDataFrame([("r", "p.md", doc)], "repo string, path string, text string")
    rows = spark.createDataFrame([("r", "p.md", n, c) for n, c in added], "repo string, path string, line_number int, content string")
    got = changes.correlate(rows, markdown.parsed_sections(docs, ["repo", "path"])).orderBy("start_line").collect()
    return [(r["section_title"], [x["line_number"] for x in r["added_lines"]]) for r in got]


def test_correlation(spark):
    doc = "# Title\n\n## Summary\nNew insights\n\n## Details\nMore text\n"
    assert correlated(spark, doc, [(3, "- add summary bullet"), (6, "- add detail")]) == [("Summary", [3]), ("Details", [6])]
    assert correlated(spark, "Intro text\nSecond line\n", [(1, "x"), (2, "y")]) == [(None, [1, 2])]
    assert correlated(spark, "# Title\n\n## Summary\nLine\n", [(3, "- first"), (4, "- second")]) == [("Summary", [3, 4])]
    assert correlated(spark, "# T\na\n", [(7, "beyond"), (2, "b"), (2, "a")]) == [(None, [7]), ("T", [2, 2])]


def test_prompt_and_reports(spark):
    requests = spark.createDataFrame([("r", " repo ", 3, " Look closely. "), ("q", "other", 3, None)], "repo string, repo_path string, days_since int, custom_prompt string")
    rows = spark.createDataFrame([("r", "docs/guide.md", 2, "Summary", 10, [(12, " - new bullet ")]), ("r", "docs/a.md", None, None, 0, [(1, "x")])], "repo string, path string, section_level int, section_title string, start_line int, added_lines array<struct<line_number:int,content:string>>")
    got = {r["repo"]: r for r in report.rag_reports(requests, rows, 5).collect()}
    want = (
        report.ROLE + "Repository: repo\nTime Window: Last 3 day(s)\n\nAdditional Analyst Guidance:\nLook closely.\n\n" + report.TASK
        + "File: docs/a.md\n  Section: (no heading)\n    +1 x\n\nFile: docs/guide.md\n  Section: Summary (level 2)\n    +12 - new bullet"
    )
    assert got["r"]["prompt"] == want and got["r"]["summary"] == "[mock-bytes:5] " + want and got["r"]["kind"] == "SYNTHESIZED"
    assert got["q"]["kind"] == "FALLBACK" and got["q"]["message"] == "No relevant Markdown additions detected for `other` within the last 3 day(s)."
    added = spark.createDataFrame([("r", "b.md", i, f"l{i}") for i in range(1, 13)] + [("r", "a.md", 1, "x")], "repo string, path string, line_number int, content string")
    got = {r["repo"]: r["report"] for r in report.git_reports(requests, added).collect()}
    assert got["r"].startswith("Git activity report for ` repo `\n\n### a.md\n  +1 x\n\n### b.md\n  +1 l1\n") and got["r"].endswith("  +10 l10\n  ... (+2 more lines)")
    assert got["q"] == "No Markdown changes detected for `other` in the last 3 day(s)."
