"""Collocations, importance resampling and the n-gram join against brute force, with nulls, empties, ties and clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import collocations, importance, ngram_join
from marlstone.llm.word_bytes import joined, runs

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows, schema="doc_id long, text string, lang string"):
    """Rows with extra columns whose names the operators use themselves."""
    extra = ", t int, key int, n int, phrase int, block int, bucket int, id int"
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6, 7) for r in rows], schema + extra)


# --- collocations


def brute_phrases(rows, longest, least, cover, top):
    f, size = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            size[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        many = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        scored = []
        for p, a in many.items():
            if any(len(q) > len(p) and inside(p, q) and 100 * b >= cover * a for q, b in many.items()):
                continue
            cuts = [(1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            scored.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, size[lang], -score))
    return sorted(out)


def phrase_rows():
    rng = random.Random(11)
    words = ["new", "York", "the", "city", "été", "of", "in", "a-b", "Ünit", "x"]
    rows = [(0, None, "en"), (1, "", None), (2, " \t ", "en"), (3, "new york city", None), (4, "New  York\tcity", "und")]
    for i in range(300):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", ".\n", "\r", "\x0b"]) for _ in range(rng.randint(0, 40)))
        rows.append((5 + i, text + rng.choice(["", "new york city hall"]), rng.choice(["en", "en", "fr", None])))
    return rows + rows[:20]


@pytest.mark.parametrize("longest,top", [(3, 40), (4, 1000), (2, 5)])
def test_collocations(spark, longest, top):
    rows = phrase_rows()
    got = collocations.collocations(frame(spark, rows), longest=longest, least=4, top=top)
    assert sorted(tuple(r) for r in got.collect()) == brute_phrases(rows, longest, 4, 50, top)
    assert [t for _, t in got.dtypes] == ["string", "bigint", "string", "bigint", "bigint", "bigint", "bigint", "bigint"]


def test_collocations_with_a_full_filter(spark, monkeypatch):
    """A table of bits far too small lets nearly everything through; results stay."""
    monkeypatch.setattr(collocations, "MOST_BITS", 4)
    monkeypatch.setattr(collocations, "LEAST_BITS", 3)
    rows = phrase_rows()
    assert sorted(tuple(r) for r in collocations.collocations(frame(spark, rows), least=4).collect()) == brute_phrases(rows, 3, 4, 50, 2000)


def test_collocations_ranked_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(collocations, "RANKED", 3)
    rows = phrase_rows()
    assert sorted(tuple(r) for r in collocations.collocations(frame(spark, rows), least=4, top=7).collect()) == brute_phrases(rows, 3, 4, 50, 7)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(frame(spark, []), least=1).count() == 0
    assert collocations.collocations(frame(spark, [(1, None, None), (2, "a. b", None)]), least=1).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3])
def test_windows_repeat_and_lose_nothing(n):
    rng = random.Random(n)
    for _ in range(200):
        text = "".join(rng.choice(["a", "bb", "cccccccccccc", " ", " ", "  ", "\t", "." if rng.random() < 0.3 else " "]) for _ in range(rng.randint(0, 80))).encode()
        want = Counter()
        for piece in re.split(rb"[.]", text):
            w = piece.split()
            want.update(b" ".join(w[i : i + n]) for i in range(len(w) - n + 1))
        got = Counter()
        for _, part in collocations.windows(np.frombuffer(text + b"\n", "u1"), n, 9):
            low, first, last, _, _, begins = collocations.phrases(part, n)
            got.update(low[first[i] : last[i + n - 1]].tobytes() for i in begins)
        assert got == want


# --- importance resampling


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def features_of(text):
    w = words_of(text)
    return w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10_000


def brute_draw(docs, target, percent=25, least=20):
    big, aim = Counter(), Counter()
    for _, text in docs:
        big.update(map(bucket, features_of(text)))
    for text in target:
        aim.update(map(bucket, features_of(text)))
    s, t = sum(big.values()), sum(aim.values())
    gain = lambda b: math.floor(1000 * math.log((aim[b] + 1) * (s + 10_000) / ((big[b] + 1) * (t + 10_000))))
    out = []
    for i, text in docs:
        f = features_of(text)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words_of(text)) >= least))
    long = sorted((r for r in out if r[4]), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    rank = defaultdict(list)
    for place, r in enumerate(long[: len(long) * percent // 100], 1):
        rank[r[:4]].append(place)
    return Counter((*r[:4], rank[r[:4]].pop(0) if rank[r[:4]] else None) for r in sorted(out, key=lambda r: not r[4]))


def test_importance(spark):
    rng = random.Random(12)
    common = ["alpha", "Beta", "gämma", "δelta", "e1", "7", "x" * 70, "the", "of"]
    line = lambda n: "".join(rng.choice(common) + rng.choice([" ", ", ", "\n", "--", "_"]) for _ in range(n))
    docs = [(i, line(rng.choice([0, 3, 19, 20, 21, 60]))) for i in range(200)] + [(500, None), (501, ""), (502, "...!"), (None, line(30)), (None, line(5))]
    docs += docs[:3] + docs[:3]
    target = ["the alpha of gämma", None, "", "δelta e1 of the 7"]
    d = frame(spark, docs, "doc_id long, text string")
    got = importance.resample(d, spark.createDataFrame([(t, 1) for t in target], "text string, id int"))
    assert Counter(tuple(r) for r in got.collect()) == brute_draw(docs, target)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]


def test_importance_with_salts(spark, monkeypatch):
    monkeypatch.setattr(importance, "GROUP_BYTES", 40)
    monkeypatch.setattr(importance, "RANKED", 20)
    docs = [(i, " ".join(f"w{(i * k) % 17}" for k in range(i % 40))) for i in range(300)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    got = importance.resample(d, spark.createDataFrame([("w1 w2 w3",)], "text string"))
    assert Counter(tuple(r) for r in got.collect()) == brute_draw(docs, ["w1 w2 w3"])


def test_importance_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert importance.resample(empty, some).count() == 0
    assert [tuple(r) for r in importance.resample(some, empty).collect()] == list(brute_draw([(1, "a b")], []))


def test_checksums_over_windows(monkeypatch):
    rng = random.Random(3)
    for size in (16, 64, 1 << 20):
        monkeypatch.setattr(importance, "WINDOW", size)
        texts = ["".join(rng.choice(["ab", "Ç", "z9", " ", ".", "Q" * rng.choice([1, 63, 64, 65, 200])]) for _ in range(rng.randint(0, 60))) for _ in range(30)]
        words, sizes, b, of, counts = importance.count_features([t.encode() for t in texts])
        assert words.tolist() == [len(words_of(t)) for t in texts] and sizes.tolist() == [len(features_of(t)) for t in texts]
        want = Counter((bucket(f), i) for i, t in enumerate(texts) for f in features_of(t))
        assert dict(zip(zip(b.tolist(), of.tolist()), counts.tolist())) == dict(want)


# --- n-gram join


def grams(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if x]
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()


def brute_join(docs):
    sets = [grams(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(docs):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return Counter((k, len(sets[i]), least.get(find(i)) if sets[i] else k) for i, (k, _) in enumerate(docs))


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = rng.choice(["x", "y", f"u{rng.randrange(10**6)}"])
    return " ".join(words)


def copies(seed, group):
    """Chains, near copies on both sides of the threshold, shared passages, a large group, and odd rows."""
    rng = random.Random(seed)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    docs = [(None, "a b c d e"), (None, "A b\tc d e"), (900, "A b c d e"), (901, None), (902, ""), (903, " \n"), (904, ""), (905, "One two"), (906, "one TWO"), (907, "one two three"), (908, "y y y y y y"), (909, "y y y y y")]
    passage = fresh(30)
    for i in range(40):
        base = fresh(rng.choice([8, 40, 120]))
        docs += [(i * 10 + k, edited(rng, base, rng.randint(0, 3) if len(base) > 20 else rng.randint(0, 1))) for k in range(rng.randint(1, 4))]
        docs.append((i * 10 + 9, " ".join(passage + fresh(rng.choice([1, 2, 3, 4, 60])))))
    base = fresh(100)
    docs += [(1000 + k, edited(rng, base, rng.randint(0, 4))) for k in range(group)]
    return docs + docs[:5] + [docs[-1]]


@pytest.mark.parametrize("seed,group,small,block", [(1, 30, 64, 512), (2, 150, 64, 512), (3, 60, 2, 8), (4, 60, 1, 5)])
def test_ngram_join(spark, monkeypatch, seed, group, small, block):
    monkeypatch.setattr(ngram_join, "SMALL", small)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    docs = copies(seed, group)
    got = ngram_join.link(frame(spark, docs, "doc_id long, text string"))
    assert Counter(tuple(r) for r in got.collect()) == brute_join(docs)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]


def test_ngram_join_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.link(empty).count() == 0
    assert [tuple(r) for r in ngram_join.link(spark.createDataFrame([(1, None), (None, "a")], "doc_id long, text string")).orderBy("doc_id").collect()] == [(None, 1, None), (1, 0, 1)]


def test_prefix_depths_lose_no_pair():
    """Two sets at the threshold share the smaller k of their prefixes, whatever depth each has chosen."""
    rng = np.random.default_rng(5)
    seen = set()
    for _ in range(400):
        n = int(rng.integers(1, 60))
        a = rng.choice(200, n, replace=False)
        m = ngram_join.misses(n, 85)
        b = np.concatenate([a[rng.permutation(n)[: n - int(rng.integers(0, m + 1))]], 200 + rng.choice(50, int(rng.integers(0, 4)), replace=False)])
        both = len(np.intersect1d(a, b))
        if not ngram_join.linked(len(a), len(b), both, 85):
            continue
        df = {int(x): int(d) for x, d in zip(range(250), np.minimum(rng.zipf(1.3, 250) + 1, 10**6))}
        found = []
        for s in (a, b):
            own = sorted(s.tolist(), key=lambda x: (df[x], x))
            k = ngram_join.depth(np.array([df[x] for x in own]), len(own), 0, 85)
            seen.add(k)
            found.append((k, set(own[: ngram_join.misses(len(own), 85) + k])))
        assert len(found[0][1] & found[1][1]) >= min(found[0][0], found[1][0])
    assert len(seen) > 2


def test_runs():
    assert [x.tolist() for x in runs(np.array([True, False, True, True]))] == [[0, 2], [1, 4]]
    assert joined([b"", b"ab"])[1].tolist() == [1, 4]
