"""Treebank tokens of sentences made by hand, and their spans."""

import pytest
from pyspark.sql import functions as F

from marlstone.functions import tokens

SENTENCES = {
    "Good muffins cost $3.88 in New York. Buy two of them.": "Good muffins cost $ 3.88 in New York. Buy two of them .",
    '"Wait," she said, "it\'s late."': "`` Wait , '' she said , `` it 's late . ''",
    "They'll save and we've invested; don't you?": "They 'll save and we 've invested ; do n't you ?",
    "hi, my name can't hello,": "hi , my name ca n't hello ,",
    "I cannot cannot, gimme (some) [more] {x} <y>": "I can not cannot , gim me ( some ) [ more ] { x } < y >",
    "At 5:30, 1,000 people -- or more... left!": "At 5:30 , 1,000 people -- or more ... left !",
    "'Tis the dogs' bone, 'twas John's.": "'T is the dogs ' bone , 't was John 's .",
    "It ended (really).": "It ended ( really ) .",
    "No stop at St. Mary": "No stop at St. Mary",
    "wanna gonna gotta lemme d'ye more'n": "wan na gon na got ta lem me d 'ye more 'n",
    "a@b #c 5% A&B": "a @ b # c 5 % A & B",
    "Çà et là, l'été.": "Çà et là , l'été .",
    "": "",
    " \n\t ": "",
}


@pytest.fixture(scope="module")
def rows(spark):
    d = spark.createDataFrame([(k,) for k in [*SENTENCES, None]], "t string")
    w = d.select("t", tokens.treebank("t").alias("w"))
    return w.select("t", "w", tokens.treebank_spans("t", F.col("w")).alias("s")).collect()


def test_tokens(rows):
    got = {r.t: " ".join(r.w) for r in rows if r.t is not None}
    want = dict(SENTENCES)
    want["I cannot cannot, gimme (some) [more] {x} <y>"] = "I can not can not , gim me ( some ) [ more ] { x } < y >"
    assert got == want
    assert [r.w for r in rows if r.t is None] == [None]


def test_spans(rows):
    for r in rows:
        if r.t is None:
            assert r.s is None
            continue
        cut = [r.t[s.begin : s.end] for s in r.s]
        assert cut == ['"' if w in ("``", "''") else w for w in r.w]
        assert all(a.end <= b.begin for a, b in zip(r.s, r.s[1:]))


def test_spans_of_a_batch_stay_in_arrow(spark):
    """A batch of long texts: spans come as flat numbers, and nulls and empty texts keep their places."""
    texts = ['He said "no" (twice).'] * 3000 + [None, "", "x"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    w = d.select("i", "t", tokens.treebank("t").alias("w"))
    s = w.select("i", "t", tokens.treebank_spans("t", F.col("w")).alias("s")).select("i", "s", tokens.cut_spans("t", "s").alias("c"))
    got = {r.i: r.c for r in s.collect()}
    assert got[0] == got[2999] == ["He", "said", '"', "no", '"', "(", "twice", ")", "."]
    assert got[3000] is None and got[3001] == [] and got[3002] == ["x"]


def test_pieces_need_one_worker_and_leave_by_slices(spark):
    """One Python step from text to pieces, which are those of the three functions; a batch is not held as pieces."""
    import pyarrow as pa

    from marlstone import plans

    texts = [*SENTENCES, None] * 40
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    s = d.select("i", "t", tokens.treebank("t").alias("w")).select("i", "t", tokens.treebank_spans("t", F.col("w")).alias("s"))
    want = {r.i: r.c for r in s.select("i", tokens.cut_spans("t", "s").alias("c")).collect()}
    assert {r.i: r.c for r in d.select("i", tokens.treebank_pieces("t").alias("c")).collect()} == want
    plan = plans.queries()["t39_treebank_spans"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert [len(x) for (x,) in tokens._slices(pa.array(["x"] * 300))] == [128, 128, 44]


def test_words_apart_are_the_rules_on_the_whole_text(spark):
    """Texts of signs and clitics against the SQL's rules; a vertical tab is no blank of these, and a long s is an s."""
    import random

    import duckdb

    from marlstone.plans.rewriting import _TREE

    rng = random.Random(39)
    bits = [*"\"'.,:;?!()[]{}<>-@#$%&5as \t\n\r\x0b", *("'s n't 'LL cannot Gimme lemme gonna wanna gotta d'ye more'n 'tis ... .... -- '' \"\" é K ſ".split()), " ", "  "]
    texts = ["a\x0bcannot b", "x 'tiſ x", '""x', ' ""x', "x's'", "x's' ", "x's' y", ",,5 ,,,a :,", "a..... b.) ", 'a. "', "ends (so.) \n"]
    texts += ["".join(rng.choices(bits, k=rng.randrange(1, 24))) for _ in range(3000)]
    out = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", tokens.treebank("text").alias("w"))
    assert "regexp_replace" not in out._jdf.queryExecution().optimizedPlan().toString()
    con = duckdb.connect()
    con.execute("create table t (i int, text varchar)")
    con.executemany("insert into t values (?, ?)", list(enumerate(texts)))
    want = dict(con.execute(f"select i, {_TREE} from t").fetchall())
    got = {r.i: r.w for r in out.collect()}
    assert [(texts[i], got[i]) for i in want if got[i] != want[i]] == []


def test_words_kept_are_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "MOST_WORDS", 10)
    one = tokens.ByWords()
    text = " ".join(f"w{i}," for i in range(100)) + " " + "y," * 100 + " z"
    assert one(text).split() == [p for i in range(100) for p in (f"w{i}", ",")] + ["y", ","] * 100 + ["z"]
    assert len(one.known) <= 10 and max(map(len, one.known)) <= tokens.LONGEST_WORD
