"""What the pipeline's docstring promises: nulls, repeats, empties, long texts, clashing columns, empty tables."""

import random

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from marlstone.llm import toxicity
from marlstone.llm.common import materialize


def prose(rng, n):
    return " ".join("".join(rng.choices("aeiouthnsr", k=rng.randint(3, 8))) for _ in range(n))


def run(spark, docs):
    """The ids that each stage keeps, and the last stage's rows."""
    left = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = materialize(stage(spark, docs, ""), "test")
        assert docs.columns == columns
        left.append(sorted((r.doc_id for r in docs.collect()), key=str))
    return left, docs, corpus_pipeline.STAGES[-1][1](spark, docs, "")


def test_odd_rows(spark):
    rng = random.Random(31)
    good = [(i, prose(rng, 60), "en", "s") for i in range(40)]
    long = prose(rng, 40_000)
    odd = [
        (None, prose(rng, 60), "en", "s"),  # a null id is a document
        (None, prose(rng, 60), "en", "s"),
        (200, good[3][1], None, None),  # a copy without a language, the lower id stays
        good[4],  # a repeated row
        good[4],
        (201, None, "en", "s"),
        (202, "", "en", "s"),
        (203, " \n ", None, "s"),
        (204, long, "en", "s"),
        (205, prose(rng, 30) + " secret=abcdefghijklmnop " + prose(rng, 30), "en", "s"),
    ]
    extra = "doc_id long, text string, lang string, source string, key string, blob int, label string, n int, content string, x1 double, chunk int, t string"
    rows = [(*r, "k", 1, "l", 2, "c", 0.5, 3, "t") for r in good + odd]
    left, docs, packed = run(spark, spark.createDataFrame(rows, extra))
    whole = {i for i, *_ in good} | {204, 205}
    assert {i for i in left[0] if i is not None} >= whole | {200} and left[0].count(4) == 3 and left[0].count(None) == 2
    for kept in left[1:]:
        assert not {201, 202, 203} & set(kept)  # without words: the base rules reject them
    assert set(left[3]) == {*whole, None} and left[3].count(4) == 1 and left[3].count(None) == 2
    last = {r.doc_id: r for r in docs.where("doc_id is not null").collect()}
    assert last[204].text == long and "abcdefghijklmnop" not in last[205].text
    assert all((r.key, r.blob, r.label, r.n, r.content, r.x1, r.chunk, r.t) == ("k", 1, "l", 2, "c", 0.5, 3, "t") for r in last.values())
    assert packed.count() == len(left[3])


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    left, _, packed = run(spark, docs)
    assert left == [[], [], [], []] and packed.count() == 0


def test_score_of_toxicity(spark):
    """The score by its definition: longest known unit of each token, all maximal segments, E-values, logistic curve."""
    rng = random.Random(8)
    m = toxicity.Model({"vile ": 3.0, "vil": 1.5, "grim ": 2.0, "nice ": -2.0, "abcd": 0.7}, decay=0.6, scale=0.3, slope=2.0, offset=-1.0)
    vocabulary = ["vile", "vilest", "grim", "grimmer", "nice", "abcde", "abcdefg", "so", "Vile", "the", "ünd", "x1y"]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 60))) for _ in range(200)] + [None, "", "12 !!"]

    def points(word):
        if word + " " in m.units:
            return m.units[word + " "]
        return next((m.units[word[:n]] for n in range(8, 2, -1) if n < len(word) and word[:n] in m.units), toxicity.DRIFT)

    def segments(v):
        best = max(((sum(v[i:j]), -(j - i), -i, j) for i in range(len(v)) for j in range(i + 1, len(v) + 1)), default=None)
        if best is None or best[0] <= 0:
            return []
        i, j = -best[2], best[3]
        return [*segments(v[:i]), best[0], *segments(v[j:])]

    def brute(text):
        v = [points(w) for w in toxicity.TOKEN.findall((text or "").lower())]
        if not v:
            x = toxicity.LOWEST
        else:
            cost = np.log(max(0.3 * len(v), 1.0))
            found = sorted((0.6 * s - cost for s in segments(v)), reverse=True)
            x = max(toxicity.LOWEST, found[0] + sum(max(0, y) for y in found[1:]) if found else -cost - 1)
        return 1 / (1 + np.exp(-(2.0 * np.sign(x) * np.log1p(abs(x)) - 1.0)))

    rows = [(i, t, "en", 1.0, 2.0, 0) for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, statistic double, passages int")
    got = {r.doc_id: r.score for r in toxicity.score(d, m).collect()}
    assert np.allclose([got[i] for i in range(len(texts))], [brute(t) for t in texts])
    assert toxicity.score(d, m).select(F.col("score")).count() == len(texts)
