"""Decontamination where names begin sentences."""

import random
import re

from docloom.llm import decontam

ITEM = "Tom has 12 apples and 7 pears. Tom gives 3 apples to a friend. Later Tom buys 9 more apples. How many apples does Tom have now?"
#: Here the name is never inside a sentence.
ONLY_FIRST = "Maria packed 4 boxes with pens. Maria sold 2 boxes at the market. Then 3 boxes came back. Maria counted every pen twice before night."


def test_names_at_sentence_starts(spark):
    sara = ITEM.replace("Tom", "Sara").replace("12", "15")
    rows = [
        (1, sara), (2, "Some words before.\n" + sara), (3, ONLY_FIRST.replace("Maria", "Olga")), (4, ITEM),
        # one name for two people is no consistent change
        (6, ITEM.replace("Tom has", "Sara has").replace("Tom gives", "Paul gives").replace("Later Tom", "Later Eva").replace("does Tom", "does Ina")),
        (7, "Sara has 15 apples and 7 pears. Nothing else of it is here, but some other words."),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, ITEM), (2, ONLY_FIRST)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontam.contaminated(docs, bench).collect()}
    assert set(got) == {(1, 1), (2, 1), (3, 2), (4, 1)}
    assert got[1, 1]["changed"] and got[3, 2]["changed"] and not got[4, 1]["changed"]
    assert got[4, 1]["matched"] == got[4, 1]["windows"] == 23
    assert decontam.decontaminate(docs, bench).count() == 2


WALK = "Compute how far Anna walks if Bob drives at forty miles and stops near Paris before noon"


def by_hand(text, item, words=5):
    """Whether the text holds the whole item, by words, in any letter case."""
    cut = lambda t: re.findall(r"[^\W_]+", t.lower())
    t, i = cut(text), cut(item)
    return any(t[k : k + len(i)] == i for k in range(len(t) - len(i) + 1))


def test_copies_in_other_case_and_lines(spark):
    texts = [
        WALK.lower(), WALK.upper(), WALK.replace(" ", "\n"), "Intro. " + WALK.replace(" if", "\n\n  if") + ". End",
        WALK.replace("Anna", "Mary Ann").replace("Bob", "John Henry Lee").replace("Paris", "New York"), WALK.replace("Paris", "the lake that is near our old farm"),
        WALK[:40], "Nothing of it",
    ]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in decontam.contaminated(docs, spark.createDataFrame([(1, WALK)], "item_id long, text string")).collect()}
    assert set(got) == {0, 1, 2, 3, 4}
    assert all((not got[k]["changed"]) == by_hand(t, WALK) for k, t in enumerate(texts) if k in got)
    assert all(got[k]["matched"] == got[k]["windows"] == 13 for k in got)


def test_tables_of_figures(spark):
    rng = random.Random(1)
    figures = lambda n: " ".join(str(rng.randrange(10**6)) for _ in range(n))
    item = figures(200)
    texts = [figures(20_000), figures(3000) + " " + item + " " + figures(3000), "0 " * 20_000, " ".join(item.split()[:100])]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, "0 " * 200)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontam.contaminated(docs, bench).collect()}
    assert set(got) == {(1, 1), (2, 2)} and got[1, 1]["matched"] == 196


def test_weak_windows_come_with_the_alignment(spark):
    item = "The table says 12 15 18 21 24 27 30 33 36 39 42 45 48 are the values of this row"
    again = item
    for a, b in zip("12 15 18 21 24 27 30 33 36 39 42 45 48".split(), "7 3 9 11 1 5 77 52 61 80 90 95 99".split(), strict=True):
        again = again.replace(a, f"<{b}>")
    docs = spark.createDataFrame([(1, again.replace("<", "").replace(">", "")), (2, "The table says 1 1 1 1 1 are the values of this row")], "doc_id long, text string")
    got = decontam.contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["matched"], r["changed"]) for r in got] == [(1, 18, True)]
