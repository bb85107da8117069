"""Dictionary rewriting against brute force, ordered patterns against Python's own."""

import random
import re

import pytest
from pyspark.sql import functions as F

from marlstone.functions import rewriting


def longest(text, table):
    out, i = [], 0
    while i < len(text):
        best = max((k for k in table if text.startswith(k, i)), key=len, default=None)
        out.append(text[i] if best is None else table[best])
        i += 1 if best is None else len(best)
    return "".join(out)


def frame(spark, table):
    return spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(table.items())], "old string, new string, place int")


def test_longest(spark):
    rng = random.Random(1)
    for _ in range(4):
        table = {"".join(rng.choices("ab😀c ", k=rng.randint(1, 5))): rng.choice(["", "X", "ab"]) for _ in range(12)}
        texts = ["".join(rng.choices("ab😀c ", k=rng.randint(0, 40))) for _ in range(200)] + ["", None]
        d = spark.createDataFrame(enumerate(texts), "i int, t string")
        got = {r.i: r.x for r in d.select("i", rewriting.rewrite_longest("t", frame(spark, table)).alias("x")).collect()}
        assert got == {i: None if t is None else longest(t, table) for i, t in enumerate(texts)}


def test_thousands_of_entries(spark):
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(3, 7))) for _ in range(3000)]
    table = {w: f"<{i}>" for i, w in enumerate(dict.fromkeys(words))}
    assert len(table) > 2000
    texts = [" ".join(rng.choices(words, k=300)) for _ in range(5)] + ["".join(rng.choices("abcdefgh", k=200))]
    d = spark.createDataFrame(enumerate(texts), "i int, t string")
    e = frame(spark, table)
    both = d.select("i", rewriting.rewrite_longest("t", e).alias("x"), rewriting.rewrite_in_order("t", e).alias("y")).collect()
    for r in both:
        assert r.x == longest(texts[r.i], table)
        text = texts[r.i]
        for k, v in table.items():
            text = text.replace(k, v)
        assert r.y == text


def test_rules_of_the_dictionary(spark):
    e = spark.createDataFrame([("a", "2", 1), ("a", "1", 1), ("", "x", 0), (None, "x", 0), ("b", None, 2)], "old string, new string, place int")
    assert rewriting.load(e, order="place") == [("a", "1"), ("b", "")]
    none = e.limit(0)
    d = spark.createDataFrame([("abc",), (None,)], "t string")
    assert [r[0] for r in d.select(rewriting.rewrite_longest("t", none)).collect()] == ["abc", None]
    assert [r[0] for r in d.select(rewriting.rewrite_in_order("t", none)).collect()] == ["abc", None]


def test_too_large(spark, monkeypatch):
    monkeypatch.setattr(rewriting, "MOST_ENTRIES", 2)
    with pytest.raises(ValueError, match="too large"):
        rewriting.load(frame(spark, {"a": "1", "b": "2", "c": "3"}))


def test_order_matters(spark):
    d = spark.createDataFrame([("cat",)], "t string")
    e = frame(spark, {"ca": "b", "bt": "done", "b": "no"})
    assert d.select(rewriting.rewrite_in_order("t", e)).first()[0] == "done"
    assert d.select(rewriting.rewrite_longest("t", e)).first()[0] == "bt"


@pytest.mark.parametrize("rules", [rewriting.SUBSTITUTIONS, rewriting.FACES, ((r"\((a)(b)", r"\2\1$"), (r"(?:x)(y)", r"\1"))])
def test_patterns(spark, rules):
    texts = ["I can't pay $50k, or not? What's 2/3 of US e-mail - it's us: e - mail; 10kk x*y=3^2", "a :) b :-( (: ;-) xD :'( :\"( <3 ): : )", "", None, "(ab) xy (ab", "10k 5/k"]
    d = spark.createDataFrame(enumerate(texts), "i int, t string")
    got = {r.i: r.x for r in d.select("i", rewriting.rewrite_patterns("t", rules).alias("x")).collect()}

    def plain(t):
        for p, n in rules:
            t = re.sub(p, re.sub(r"\\(\d)", r"\\g<\1>", n), t)
        return t

    assert got == {i: None if t is None else plain(t) for i, t in enumerate(texts)}


def test_words_and_signs(spark):
    d = spark.createDataFrame([("brb  LOL\tlolly",), (None,)], "t string")
    e = spark.createDataFrame([("BRB", "be right back"), ("LOL", "laughing")], "old string, new string")
    assert [r[0] for r in d.select(rewriting.expand_words("t", e)).collect()] == ["be right back laughing lolly", None]
    names = spark.createDataFrame(rewriting.sign_names(), "sign string, name string")
    assert names.count() > 2000 and dict(rewriting.sign_names())["😀"] == ":grinning_face:"
    x = spark.createDataFrame([("well 😀❤ done",)], "t string").select(rewriting.name_signs("t", names).alias("t"))
    assert x.first()[0] == "well :grinning_face::heavy_black_heart: done"
    assert x.select(rewriting.name_signs(F.col("t"), names, back=True)).first()[0] == "well 😀❤ done"


def test_expanded_words_are_those_of_the_sql(spark, tmp_path):
    """Signs that only Python takes for blanks, capitals of several letters, a last sigma, texts without words and null."""
    import duckdb

    from marlstone import plans

    words = ["straße", "STRASSE", "ﬁn", "FIN", "ΟΔΟΣ", "οδος", "οδοσ", "ŉa", "ʼNA", "ᾳ", "ᾼ", "ΑΙ", "İx", "ix", "ǰ", "plain", "éa"]
    texts = [" ".join(words), "plain\u00a0plain", "plain\x1cplain \x85 plain", "\u2003", "plain\u3000éa\u2028Éa", "", " \t\n\x0b", None, "PLAIN", "unseen ẞ ß"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, f"{w}, {w.swapcase()}") for i, w in enumerate(words)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    want = sorted(con.execute(plans.oracle_sql()["t34_expand_words"]).fetchall())
    assert sorted(map(tuple, plans.queries()["t34_expand_words"](spark, str(tmp_path)).collect())) == want


def test_in_order_reads_what_was_written():
    """Replacements that make, break, border on or hold later entries, against one replace after another."""
    rng = random.Random(3)
    for _ in range(300):
        keys = dict.fromkeys("".join(rng.choices("abc", k=rng.randint(1, 4))) for _ in range(rng.randint(0, 12)))
        table = [(k, "".join(rng.choices("abx", k=rng.randint(0, 4)))) for k in keys]
        one = rewriting.InOrder(table)
        for _ in range(10):
            text = want = "".join(rng.choices("abcx", k=rng.randint(0, 30)))
            for k, v in table:
                want = want.replace(k, v)
            assert one(text) == want


def test_in_order_looks_for_what_a_text_has():
    """2,000 entries of which a text has one: one replacement, not 2,000."""

    class Counted(str):
        calls = 0

        def replace(self, *a):
            Counted.calls += 1
            return Counted(str(self).replace(*a))

    one = rewriting.InOrder([(f"word{i:04}", f"<{i}>") for i in range(2000)])
    assert one(Counted("a word0007 b")) == "a <7> b"
    assert Counted.calls == 1


def test_signs_without_automaton(spark, monkeypatch):
    import sys

    monkeypatch.setitem(sys.modules, "ahocorasick", None)
    d = spark.createDataFrame([("]a^b-\\é",), (None,), ("",)], "t string")
    e = frame(spark, {"]": "1", "^": "2", "-": "3", "\\": "4", "é": "5"})
    assert [r[0] for r in d.select(rewriting.rewrite_longest("t", e)).collect()] == ["1a2b345", None, ""]


def test_a_batch_is_read_in_slices(monkeypatch):
    import pyarrow as pa

    seen = []
    real = pa.Array.to_pylist

    class Texts:
        def __init__(self, a):
            self.a = a

        def __len__(self):
            return len(self.a)

        def slice(self, begin, n):
            seen.append(len(self.a.slice(begin, n)))
            return self.a.slice(begin, n)

    out = rewriting.each_text(Texts(pa.array(["a", None, "b"] * 1000)), str.upper)
    assert real(out) == ["A", None, "B"] * 1000
    assert max(seen) <= rewriting.SLICE and sum(seen) == 3000
