"""Toxicity by maximum-scoring segments of token log-odds.

Units are words and their prefixes. On a bounded sample of labelled documents
(``TRAIN_ROWS``) the log-odds of every unit between toxic and other documents
are estimated with an informative Dirichlet prior (the pooled frequencies,
``PRIOR`` pseudo-documents); units whose z-score is beyond ``Z`` make the
model. A token scores the log-odds of its longest unit in the model, any other
token the small negative ``DRIFT``, so that segments end. A linear-time scan
finds all maximal segments of a document. Their scores are calibrated by
extreme-value theory: lambda and K solve the Karlin-Altschul equations for the
tokens of non-toxic training documents, a segment is significant where its
E-value in a text of this length is small, and a logistic curve over the
document's statistic, fitted on the same sample, gives the probability.

Defined results: a null or empty text has no segment and gets ``LOWEST``, below
which no statistic goes; documents without a label are only scored; different
labels of one document are a training row each, equal ones are one; of several
texts with a labelled id the least is the training text; where no usable label
exists, no unit is known and every score is that of the curve's first offset,
1 / (1 + e^20); an empty table gives an empty table; equal
texts get equal scores; language, source and id are never looked at, other
columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import share, shared, small_batches, text_of

TRAIN_ROWS = 10_000
PREFIXES = (3, 4, 5, 6, 7, 8)
PRIOR = 50.0
Z = 4.0
TOP = 8.0
DRIFT = -0.15
SIGNIFICANT = 0.01
LOWEST = -12.0
FOLDS = 5
TOKEN = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    units: dict[str, float]
    decay: float = 1.0
    scale: float = 1.0
    slope: float = 0.0
    offset: float = -20.0


def units_of(word: str) -> list[str]:
    """The word itself (marked by a closing blank) and its prefixes."""
    return [word + " ", *[word[:n] for n in PREFIXES if n < len(word)]]


class Scores(dict):
    """Score of each token, computed at first sight; forgets all when it grows too large."""

    def __init__(self, units: dict[str, float]) -> None:
        super().__init__()
        self.units = units

    def __missing__(self, word: str) -> float:
        if len(self) > 300_000:
            self.clear()
        found = self.units.get(word + " ")
        if found is None:
            for n in reversed(PREFIXES):
                if n < len(word) and (found := self.units.get(word[:n])) is not None:
                    break
        self[word] = score = DRIFT if found is None else found
        return score


def maximal_segments(scores: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """All maximal scoring subsequences of disjoint pieces (start, end, score), in one linear pass.

    Kept candidates have rising left sums; a new positive piece is extended to
    the left over every candidate whose right sum it exceeds (Ruzzo and Tompa).
    """
    total, kept = 0.0, []  # kept: start, end, sum before, sum after, place of the nearest candidate with a lower left sum
    for start, end, score in scores:
        before, total = total, total + score
        if score <= 0:
            continue
        now = [start, end, before, total]
        at = len(kept) - 1
        while True:
            while at >= 0 and kept[at][2] >= now[2]:
                at = kept[at][4]
            if at < 0 or kept[at][3] >= now[3]:
                now.append(at)
                kept.append(now)
                break
            now = [kept[at][0], end, kept[at][2], total]
            del kept[at:]
            at -= 1
    return [(s, e, after - before) for s, e, before, after, _ in kept]


def document_segments(text: str, scores: Scores) -> tuple[int, list[tuple[int, int, float]]]:
    """Tokens of the text, and its maximal segments as (first token, end token, score)."""
    tokens = TOKEN.findall(text.lower())
    if not tokens:
        return 0, []
    values = np.fromiter(map(scores.__getitem__, tokens), "f8", len(tokens))
    hits = np.flatnonzero(values > 0)
    if not len(hits):
        return len(tokens), []
    sums = np.concatenate([[0.0], values.cumsum()])
    pieces, at = [], 0
    for h in hits.tolist():
        if h > at:
            pieces.append((at, h, float(sums[h] - sums[at])))
        pieces.append((h, h + 1, float(values[h])))
        at = h + 1
    return len(tokens), maximal_segments(pieces)


def statistic(n: int, segments: list[tuple[int, int, float]], m: Model) -> float:
    """Significance (minus log E-value) of the best segment of a document of ``n`` tokens, and that of all others that have some."""
    if not n:
        return LOWEST
    cost = math.log(max(m.scale * n, 1.0))
    best = sorted((m.decay * s - cost for _, _, s in segments), reverse=True)
    return max(LOWEST, best[0] + sum(max(0.0, x) for x in best[1:]) if best else -cost - 1.0)


def passages(text: str, scores: Scores, m: Model) -> tuple[float, list[tuple[int, int, float, float]]]:
    """The statistic, and every significant passage: start, end (code points), score, E-value."""
    n, segments = document_segments(text, scores)
    x = statistic(n, segments, m)
    good = [(s, e, v, m.scale * n * math.exp(-m.decay * v)) for s, e, v in segments]
    good = [g for g in good if g[3] <= SIGNIFICANT]
    if good:
        lower = text.lower()
        spots = [t.span() for t in TOKEN.finditer(lower if len(lower) == len(text) else text)]
        good = [(spots[s][0], spots[min(e, len(spots)) - 1][1], v, p) for s, e, v, p in good if s < len(spots)]
    return x, good


def training_rows(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS) -> DataFrame:
    """Texts and labels of at most ``bound`` labelled documents outside the held-out fold."""
    usable = labels.where(F.col("toxic").isNotNull() & (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) != 0))
    distinct = usable.select(F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("y")).distinct()
    chosen = distinct.orderBy(F.xxhash64("__id"), "__id", "y").limit(bound)
    texts = docs.select(F.col("doc_id").alias("__d"), text_of("text").alias("t"))
    both = texts.join(F.broadcast(chosen), F.col("__d") == F.col("__id"))  # at most ``bound`` rows
    return both.groupBy("__id", "y").agg(F.min("t").alias("t")).select("t", "y")  # copies meet before the shuffle


def fit(train: DataFrame) -> Model:
    """The model from (t, y) rows; what reaches the driver is the chosen units and bounded summaries."""
    small_batches(train.sparkSession)
    train = train.persist()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: tuple[Counter, Counter] = Counter(), Counter()
        for batch in batches:
            for t, y in zip(batch["t"], batch["y"], strict=True):
                seen[int(y > 0)].update({u for w in set(TOKEN.findall(t.lower())) for u in units_of(w)})
        yield pd.DataFrame([(u, c[0], c[1]) for u in {**seen[0], **seen[1]} for c in [(seen[0][u], seen[1][u])]], columns=["u", "a", "b"])

    sizes = {r["y"]: r["n"] for r in train.groupBy((F.col("y") > 0).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 or not n1:
        train.unpersist()
        return Model({})
    counts = train.mapInPandas(count, "u string, a long, b long").groupBy("u").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where(F.col("a") + F.col("b") >= 5)
    prior = PRIOR * (F.col("a") + F.col("b")) / (n0 + n1)
    one, two = F.col("b") + prior, F.col("a") + prior
    odds = F.log(one / (n1 + PRIOR - one)) - F.log(two / (n0 + PRIOR - two))
    z = odds / F.sqrt(1 / one + 1 / two)
    chosen = counts.select("u", odds.alias("odds"), F.col("b").alias("b"), z.alias("z")).where(F.abs("z") >= Z).collect()
    kept = general({r["u"]: r["b"] for r in chosen})
    m = Model({r["u"]: min(TOP, max(-TOP, r["odds"])) for r in chosen if r["u"] in kept})

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scores, found = Scores(m.units), Counter()
        for batch in batches:
            for t, y in zip(batch["t"], batch["y"], strict=True):
                if y <= 0:
                    found.update(round(scores[w], 2) for w in TOKEN.findall(t.lower()))
        yield pd.DataFrame(list(found.items()), columns=["s", "n"])

    null = [(r["s"], r["n"]) for r in train.mapInPandas(spread, "s double, n long").groupBy("s").agg(F.sum("n").alias("n")).collect()]
    m.decay, m.scale = extreme_values(null)

    def rate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scores = Scores(m.units)
        for batch in batches:
            yield pd.DataFrame({"x": [statistic(*document_segments(t, scores), m) for t in batch["t"]], "y": batch["y"] > 0})

    rated = train.mapInPandas(rate, "x double, y boolean").toPandas()
    m.slope, m.offset = logistic(rated["x"].to_numpy("f8"), rated["y"].to_numpy("f8"))
    train.unpersist()
    return m


def general(toxic: dict[str, int]) -> set[str]:
    """The units (with their toxic documents) without prefixes whose evidence is that of one or two chosen words: those words speak for themselves."""
    words: dict[str, list[int]] = {}
    for unit, n in toxic.items():
        if unit.endswith(" "):
            for prefix in units_of(unit[:-1])[1:]:
                words.setdefault(prefix, []).append(n)
    few = {u for u, n in words.items() if len(n) < 3 and sum(n) >= 0.8 * toxic.get(u, 0)}
    return {u for u in toxic if u.endswith(" ") or u not in few}


def extreme_values(null: list[tuple[float, int]]) -> tuple[float, float]:
    """lambda with sum p e^(lambda s) = 1, and an approximate K, for a null distribution of token scores."""
    total = sum(n for _, n in null)
    if not total or max(s for s, _ in null) <= 0 or sum(s * n for s, n in null) >= 0:
        return 1.0, 0.1
    low, high = 1e-6, 20.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(n / total * math.exp(min(mid * s, 500)) for s, n in null) < 1 else (low, mid)
    return low, min(1.0, max(1e-4, low * abs(sum(s * n for s, n in null)) / total))


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and offset of a logistic curve, by damped Newton steps with a small ridge."""
    squeezed = squeeze(x)
    a, b = 0.0, math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * squeezed + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([(squeezed * (y - p)).sum() - 0.01 * a, (y - p).sum()])
        h = np.array([[(w * squeezed * squeezed).sum() + 0.01, (w * squeezed).sum()], [(w * squeezed).sum(), w.sum()]])
        step = np.linalg.solve(h, g)
        a, b = a + float(step[0]), b + float(step[1])
        if np.abs(step).max() < 1e-9:
            break
    return max(a, 0.0), b


def squeeze(x: np.ndarray | float) -> np.ndarray:
    """Odd, monotone, bounded in growth: far statistics must not rule the fit."""
    return np.sign(x) * np.log1p(np.abs(x))


def score(docs: DataFrame, m: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score, statistic, passages (start, end, score, evalue) of every row."""
    small_batches(docs.sparkSession)
    given = share(docs.sparkSession, m)

    @F.pandas_udf("score double, statistic double, passages array<struct<start:int,end:int,score:double,evalue:double>>")
    def work(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared(given)
        scores = Scores(m.units)
        for texts in batches:
            found = [passages(t, scores, m) for t in texts]
            x = np.array([f[0] for f in found], "f8")
            p = 1 / (1 + np.exp(-np.clip(m.slope * squeeze(x) + m.offset, -30, 30)))
            rows = [[dict(zip(("start", "end", "score", "evalue"), g, strict=True)) for g in f[1]] for f in found]
            yield pd.DataFrame({"score": p, "statistic": x, "passages": rows})

    return docs.select(F.col(f"`{key}`").alias(key), work(text_of(text)).alias("__made")).select(key, "__made.*")
