import pytest
from pyspark.sql import functions as F

from docloom.config import InvalidInput, ModelInferenceError, ModelLoadError, DictionaryLoadError, SummarizeError, SummaryConfig
from docloom.functions import text as T
from docloom.operators import lexrank, summarize, synthesis
from docloom.plans.engine import Engine, EngineConfig


def test_rank_prefers_the_connected_sentence():
    c = SummaryConfig(similarity_threshold=0.1, max_iterations=100)
    done, _, _, s = lexrank.rank([["rust", "safety", "concurrency"], ["rust", "performance", "systems"], ["cooking", "recipe", "ingredients"]], c)
    assert done and s[0] >= s[1] > s[2]


def test_rank_edges_cases():
    assert lexrank.rank([]) == (True, 0, 0.0, [])
    done, n, delta, _ = lexrank.rank([["a"], ["b"]], SummaryConfig(max_iterations=0))
    assert not done and n == 0 and delta == SummaryConfig().convergence_delta
    # a path of three sentences doesn't settle within the default number of steps
    done, n, delta, _ = lexrank.rank([["a", "b"], ["a", "x"], ["b", "y"]])
    assert not done and n == 50 and delta > 1e-4


def test_sparse_kernel_equals_dense(monkeypatch):
    sentences = [[f"w{(i * k) % 7}" for k in range(1, 6)] for i in range(12)]
    dense = lexrank.rank(sentences)
    monkeypatch.setattr(lexrank, "_DENSE", 0)
    sparse = lexrank.rank(sentences)
    assert dense[:2] == sparse[:2] and dense[3] == pytest.approx(sparse[3])


def test_clamp(spark):
    rows = spark.createDataFrame([(1, 0, ["テスト"] * 4)], "doc_id long, position int, tokens array<string>")
    assert [(r["freq"], r["total"]) for r in lexrank.bag_of_words(rows, 1).collect()] == [(1, 4)]


def test_selection(spark):
    df = spark.createDataFrame([([(1, 0.2), (0, 0.05)],), ([(0, 0.05), (1, 0.04)],), ([],)], "o array<struct<k:int,score:double>>")
    c = SummaryConfig(max_sentences=2, similarity_threshold=0.1)
    assert [[x["k"] for x in r[0]] for r in df.select(lexrank.selected(F.col("o"), c)).collect()] == [[1], [0], []]
    c = SummaryConfig(max_sentences=0)
    assert df.select(lexrank.selected(F.col("o"), c)).first()[0] == []


def test_statuses(spark):
    path = "alpha beta gamma delta epsilon zeta. alpha beta eta theta iota kappa one. gamma delta lambda mu nu xi omicron."
    docs = spark.createDataFrame([(1, "  "), (2, "短い文です。"), (3, "!!!"), (4, None), (5, path)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in summarize.summarize(docs, 5).collect()}
    assert [got[k]["status"] for k in range(1, 6)] == ["INVALID_INPUT", "OK", "NO_CANDIDATES", "INVALID_INPUT", "NOT_CONVERGED"]
    assert got[2]["extracted_sentences"] == ["短い文です。"] and "短い文です。" in got[2]["synthesized_summary"]
    assert got[2]["prompt"] == summarize.INTRO + "1. 短い文です。\n" + summarize.ORIGINAL + "短い文です。"


def test_synthesis(spark):
    df = spark.createDataFrame([("x",), (" Raise ",), (" ",), (None,)], "p string")
    got = [tuple(r) for r in df.select(synthesis.mock(F.col("p"), 5), synthesis.mock_status(F.col("p"))).collect()]
    assert got == [("[mock-bytes:5] x", None), (None, "MODEL_INFERENCE_ERROR"), (None, "INVALID_INPUT"), (None, "INVALID_INPUT")]

    def model(p):
        if p == "x":
            return "y"
        raise ValueError("no")

    got = [r[0] for r in df.select(synthesis.synthesizer(model)(F.col("p"))).collect()]
    assert got[0]["text"] == "y" and got[1]["error"].startswith("MODEL_INFERENCE_ERROR") and got[3]["error"] == "INVALID_INPUT"


def test_engine(spark):
    with pytest.raises(DictionaryLoadError):
        Engine(spark, EngineConfig(b"", b""))
    with pytest.raises(ModelLoadError):
        Engine(spark, EngineConfig(b"", b"dict"))
    e = Engine(spark, EngineConfig(b"model", b"dict"))
    assert e.extract_important_sentences("A b. C d. E f.", 2) == ["A b.", "C d."] and e.extract_important_sentences(" ", 0) == []
    assert e.synthesize_summary([" a ", "", "b"]) == "[mock-bytes:5] a\nb"
    for bad in ([], [" "]):
        with pytest.raises(InvalidInput):
            e.synthesize_summary(bad)
    with pytest.raises(ModelInferenceError):
        e.synthesize_summary(["raise"])
    with pytest.raises(InvalidInput):
        e.summarize_document("  ")
    with pytest.raises(SummarizeError):
        e.summarize_document("!!!")
    assert "One lonely but long enough sentence here." in e.summarize_document("One lonely but long enough sentence here.")
    assert [m["surface"] for m in e.tokenize_sentence("a bc")] == ["a", "bc"]


ODD = [
    None, "", " \n ", "One two three four five six seven eight. ok? yes 」 ） !! More words follow here, and then some　words apart.",
    "Quoted 'words' (in marks) a b C ÄB äb The THE.\x1c\x1dwith\x1fseparators inside of it\r\nand a carriage return at the end\r ",
    "終わり。次の文はとても長いので二十五文字を超えるはずですよね。 ） 」残り words words words words words words words words",
    "no terminator at all but long enough to be a node\n\n\x85... !!! ! ? 。。x y z\x0b\x0cthe of and or a sentence of stop words that is has was",
]


def test_kernel_tokens_equal_the_columns(spark):
    from docloom.functions import pytext

    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in docs.select("doc_id", T.sentences(F.col("text")).alias("s"), lexrank.nodes(F.col("text")).alias("n")).collect()}
    for k, text in enumerate(ODD):
        assert pytext.sentences(text) == got[k]["s"]
        assert pytext.nodes(text) == ([n["position"] for n in got[k]["n"]], [n["tokens"] for n in got[k]["n"]])


@pytest.mark.parametrize("name", ["tfidf", "cosine_edges", "transition_rows"])
def test_one_shuffle_of_documents_and_no_join(spark, tmp_path, name):
    """The tables of 1 GB failed by time: text was cut up to 48 times, and joined by token."""
    from docloom.plans import catalogue

    text = "alpha beta gamma delta epsilon zeta. alpha beta eta theta iota kappa one. gamma delta lambda mu nu xi omicron."
    spark.createDataFrame([(1, text), (2, None), (None, text), (4, "短い文です。")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    df = catalogue.QUERIES[name](spark, str(tmp_path))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and plan.count("Relation") == 1
    rows = [r.asDict() for r in df.collect()]
    assert {r["doc_id"] for r in rows} == {1}
    if name == "transition_rows":
        assert {(r["i"], r["j"]): r["p"] for r in rows}.keys() == {(0, 1), (1, 0), (0, 2), (2, 0)}
        assert sum(r["p"] for r in rows if r["i"] == 0) == pytest.approx(1, abs=1e-6)


def test_pairs_row_by_row_equal_dense(spark, monkeypatch):
    text = " ".join(" ".join(f"w{(i * k) % 7}word" for k in range(1, 6)) + "." for i in range(12))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    vectors = lexrank._weights(lexrank.P.nodes(text)[1], 6)[:3]
    whole = lambda: sorted((int(i), int(j), round(float(w), 8)) for p in lexrank._pairs(12, *vectors, 0.12) for i, j, w in zip(*p, strict=True))
    dense = whole()
    monkeypatch.setattr(lexrank, "_DENSE", 0)
    assert dense == whole() and len(dense) == lexrank.cosine_edges(docs).count()


def test_rounded_as_the_sql_rounds(spark):
    from docloom.plans import catalogue

    df = spark.createDataFrame([(0.1287235,), (0.129166,), (0.25,)], "w double")
    assert [r[0] for r in df.select(catalogue._round("w", 6)).collect()] == [0.128723, 0.129166, 0.25]
