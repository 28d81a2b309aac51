import random
import re

import pytest
from pyspark.sql import functions as F

from docloom import config as cfg
from docloom.functions import text as T
from docloom.functions import tokenizers


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("風が吹けば桶屋が儲かる。雨が降る?\n\n次の文!", ["風が吹けば桶屋が儲かる。", "雨が降る?", "次の文!"]),
        ("   \n\n   ", []),
        ("本当？！\n信じられない!!", ["本当？！", "信じられない!!"]),
        (" First sentence.   Second sentence.  ", ["First sentence.", "Second sentence."]),
        ("「こんにちは。」今日は晴れです。", ["「こんにちは。」", "今日は晴れです。"]),
        ("pi is 3.14... ok", ["pi is 3.", "14.", ".", ".", "ok"]),
        ("", []),
        ("　a　b.　　c", ["a　b.", "c"]),
    ],
)
def test_sentences(spark, text, want):
    assert one(spark, text, T.sentences) == want


def machine(text):
    """A sentence splitter one character at a time."""
    out = []
    for segment in text.split("\n"):
        own, cur, after = [], "", False
        for c in [*segment, None]:
            if after and c is not None and c.isspace():
                continue
            if after and c is not None and c in T.CLOSERS:
                own[-1] += c
                continue
            after = False
            if c is not None:
                cur += c
            if c is None or c in T.TERMINATORS:
                t, cur = cur.strip(), ""
                if t and all(x in "!?！？" for x in t) and own:
                    own[-1] += t
                elif t:
                    own.append(t)
                after = c is not None and bool(own)
        out += own
    return out


def test_sentences_against_a_machine(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab 。.!？」) \n\t　") for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").select("i", T.sentences(F.col("t")).alias("s")).collect()
    assert {r["i"]: r["s"] for r in got} == {i: machine(t) for i, t in enumerate(texts)}


def test_fallback_sentence(spark):
    got = one(spark, "!!!\n\n有効な文です。  ", T.fallback_sentence)
    assert (got["position"], got["text"]) == (1, "有効な文です。")
    assert one(spark, "!!!\n??", T.fallback_sentence) is None
    assert one(spark, None, T.fallback_sentence) is None


@pytest.mark.parametrize(("word", "want"), [("Hello,", "hello"), ("(x)", None), ("7", "7"), ("É.", "É"), ("''", None), ("*", "*"), ("a", None), ("ab!?", "ab")])
def test_tokens(spark, word, want):
    assert one(spark, word, T.normalised_token) == want


def test_content_tokens(spark):
    assert one(spark, "The quick  Fox, and the dog.", tokenizers.content_tokens) == ["quick", "fox", "dog"]


def test_morphemes(spark):
    got = one(spark, "é bc", tokenizers.whitespace)
    assert [(m["surface"], m["begin"], m["end"], m["begin_char"], m["end_char"]) for m in got] == [("é", 0, 2, 0, 1), ("bc", 3, 5, 2, 4)]
    assert got[0]["part_of_speech"] == ["名詞"] and not got[0]["is_oov"]


def test_registered_tokenizer(spark):
    tokenizers.register("fixed", lambda c: F.transform(F.split(c, "/"), lambda w: tokenizers.whitespace(w)[0]))
    assert one(spark, "Rust/the/safety", lambda c: tokenizers.content_tokens(c, "fixed")) == ["rust", "safety"]
    with pytest.raises(KeyError):
        tokenizers.get("none")


def test_preferred_form_and_content_words(spark):
    rows = spark.createDataFrame([("*", "d", "s"), (" ", "*", " s "), ("n", "d", "s"), (None, None, "s")], "n string, d string, s string")
    assert [r[0] for r in rows.select(T.preferred_form(F.col("n"), F.col("d"), F.col("s"))).collect()] == ["d", "s", "n", "s"]
    rows = spark.createDataFrame([([], "a"), (["助詞"], "は"), (["助詞"], "x"), (["名詞"], "は")], "p array<string>, s string")
    assert [r[0] for r in rows.select(T.is_content_word(F.col("p"), F.col("s"))).collect()] == [False, False, True, True]


def test_trim_is_unicode(spark):
    assert one(spark, "　 a b  ", T.trim) == "a b"
    assert one(spark, "  Foo   \n  Bar\tBaz ", T.collapse) == "Foo Bar Baz"
    assert one(spark, "x\r\n\n", T.strip_line_end) == "x"


@pytest.mark.parametrize(
    ("options", "word"),
    [
        (cfg.ReportOptions("./r", 0), "days_since"), (cfg.ReportOptions("./r", 1, ("md",)), "dot"), (cfg.ReportOptions("./r", 1, (".md", ".MD")), "duplicates"),
        (cfg.ReportOptions("./r", 1, None, "   "), "custom_prompt"), (cfg.ReportOptions("  ", 1), "リポジトリ"), (cfg.ReportOptions("./r", 1, ()), "empty"),
        (cfg.ReportOptions("./r", 1, (" ",)), "blank"), (cfg.ReportOptions("./r", 1, (".m d",)), "whitespace"), (cfg.ReportOptions("./r", 1, (".a/b",)), "separators"),
    ],
)
def test_bad_options(spark, options, word):
    with pytest.raises(cfg.InvalidInput, match=re.escape(word)) as e:
        options.validate()
    row = spark.createDataFrame([(options.repo_path, options.days_since, None if options.target_extensions is None else list(options.target_extensions), options.custom_prompt)], "r string, d int, e array<string>, p string")
    assert row.select(cfg.options_fault(F.col("r"), F.col("d"), F.col("e"), F.col("p"))).first()[0] == str(e.value)


def test_good_options():
    o = cfg.ReportOptions(" ./repo ", 7, (" .RST ", ".md"), " Highlight risk areas. ")
    o.validate()
    assert o.extensions() == [".rst", ".md"]
    assert cfg.ReportOptions("x", 1).extensions() == [".md", ".markdown"]


def test_since(spark):
    got = spark.createDataFrame([(864000, 2), (100, 2)], "now long, d int").select(T.since_seconds(F.col("now"), F.col("d"))).collect()
    assert [r[0] for r in got] == [864000 - 172800, 0]
