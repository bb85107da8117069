"""Toxicity, near duplicates, language ID and the pipeline: held-out accuracy and brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marlstone.llm import language_id, near_dedup, toxicity
from marlstone.llm.common import materialize


def words(rng, n, signs="abcdefghijkl"):
    return ["".join(rng.choices(signs, k=rng.randint(2, 8))) for _ in range(n)]


def brute_segments(values):
    """All maximal segments by definition: best segment, then the same left and right of it."""

    def inside(lo, hi):
        best = max(((sum(values[i:j]), -(j - i), -i, j) for i in range(lo, hi) for j in range(i + 1, hi + 1)), default=None)
        if best is None or best[0] <= 0:
            return []
        i, j = -best[2], best[3]
        return [*inside(lo, i), (i, j, best[0]), *inside(j, hi)]

    return inside(0, len(values))


def test_maximal_segments():
    rng = random.Random(7)
    for _ in range(200):
        v = [rng.choice([-3, -2, -1, 1, 2, 4]) + rng.random() / 10 for _ in range(rng.randint(0, 14))]
        got = toxicity.maximal_segments([(i, i + 1, x) for i, x in enumerate(v)])
        want = brute_segments(v)
        assert [(s, e) for s, e, _ in got] == [(s, e) for s, e, _ in want]
        assert np.allclose([x for *_, x in got], [x for *_, x in want])


def test_toxicity(spark):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        w = words(rng, 80)
        if i % 4 == 0:
            for k in rng.sample(range(80), 6):
                w[k] = rng.choice(["zzvile", "zznasty", "zzgrim"])
        rows.append((i, " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    m = toxicity.fit(toxicity.training_rows(d, labels))
    extra = spark.createDataFrame([(1000, None), (1001, ""), (1002, "ZZVILE!! zznasty, " * 5), (1003, "x" * 100_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score(d.union(extra), m).collect()}
    assert all((got[i].score >= 0.5) == (i % 4 == 0) for i in range(400))
    assert got[1000].score == got[1001].score < 0.5 <= got[1002].score
    p = got[1002].passages[0]
    assert (p.start, "ZZVILE!! zznasty, " * 5)[0] == 0 and p.end == 18 * 5 - 2
    assert got[1003].passages == []
    nothing = toxicity.fit(toxicity.training_rows(d, labels.limit(0)))
    assert toxicity.score(d, nothing).where("score >= 0.5").count() == 0
    assert toxicity.score(d.limit(0), m).count() == 0


def test_toxicity_training_rows_and_units(spark):
    d = spark.createDataFrame([(1, "b", "x"), (1, "a", "x"), (2, None, "x"), (None, "c", "x")] + [(3, "t", "x")] * 50, "doc_id long, text string, y string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (2, 0), (3, 1), (None, 1)], "doc_id long, toxic int")
    folds = {r.doc_id for r in labels.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0).collect()}
    want = sorted((t, y) for i, t, y in ((1, "a", 1), (1, "a", 0), (2, "", 0), (3, "t", 1)) if i in folds)
    assert sorted((r.t, r.y) for r in toxicity.training_rows(d, labels).collect()) == want
    toxic = {"grim ": 9, "grimly ": 1, "gri": 11, "vile ": 3, "vil": 20, "abcd": 4, "abcde ": 1, "abcdf ": 1, "abcdg ": 1}
    slow = {u for u in toxic if u.endswith(" ") or not (0 < len(w := [n for v, n in toxic.items() if v.endswith(" ") and v.startswith(u)]) < 3 and sum(w) >= 0.8 * toxic[u])}
    assert toxicity.general(toxic) == slow == set(toxic) - {"gri"}


def test_toxicity_statistic():
    m = toxicity.Model({}, decay=0.7, scale=0.2)
    e = lambda s, n: 0.7 * s - np.log(max(0.2 * n, 1.0))
    assert toxicity.statistic(0, [], m) == toxicity.LOWEST
    assert np.isclose(toxicity.statistic(100, [(0, 1, 9.0), (3, 5, 2.0), (7, 9, 6.0)], m), e(9, 100) + max(0, e(2, 100)) + e(6, 100))
    for n in (1, 50, 10**4, 10**9):
        assert toxicity.statistic(n, [], m) >= toxicity.LOWEST
        assert n > 10**5 or toxicity.statistic(n, [], m) < toxicity.statistic(n, [(0, 1, 0.1)], m)
    null = [(-0.15, 900), (2.0, 20), (-3.0, 80)]
    decay, scale = toxicity.extreme_values(null)
    assert np.isclose(sum(n / 1000 * np.exp(decay * s) for s, n in null), 1) and decay > 0 < scale <= 1


def test_language(spark):
    rng = random.Random(2)
    rows = []
    for i in range(120):
        lang = "en" if i % 2 else "fr"
        rows.append((i, " ".join(words(rng, 30, "aeiouthnsr" if lang == "en" else "éèçuaqxzvl")), lang if i % 7 else None, f"h{i % 3}.{'fr' if lang == 'fr' else 'com'}", "k"))
    rows += [(900, None, "en", "h1.com", "k"), (901, " 12 ! ", None, None, "k"), (902, " ".join(words(rng, 20, "éèçuaqxzvl")), "en-US", None, "k"), (902, "", "xx", "h", "k")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, language string")
    got = language_id.identify(d).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id < 900:
            assert r["__language"] == ("en" if r.doc_id % 2 else "fr")
    odd = {(r.doc_id, r.text): r["__language"] for r in got if r.doc_id >= 900}
    assert odd[(900, None)] == odd[(901, " 12 ! ")] == odd[(902, "")] == "und"
    assert odd[(902, rows[-2][1])] == "fr"
    kept = language_id.keep_identified(d)
    assert kept.columns == d.columns and kept.count() == 121
    assert language_id.keep_identified(d.limit(0)).count() == 0
    assert language_id.keep_identified(d.withColumn("lang", F.lit(None).cast("string"))).count() == 0
    small = language_id.identify(d, keep=["doc_id"])
    assert small.columns == ["doc_id", "__declared", "__suffix", "__host", "__language", "__posterior", "__kept"]


def posterior(m, text, declared, suffix, host, hosts):
    """Best language and its posterior by definition; ``hosts`` are the host and text posterior of every other row."""
    n = len(m.languages)
    pieces = list(language_id.trigrams(text or ""))
    if not pieces:
        return "und", 0.0
    k = sum(len(p) for p in pieces)
    logs = sum(m.table[p].sum(0, dtype="f8") for p in pieces) / (1 + k / language_id.EFFECTIVE)
    prior = (sum((p for _, p in hosts), np.zeros(n)) + 1) / (len(hosts) + n)
    labels = (host or "").split(".")
    levels = sorted({".".join(labels[-j:]) for j in (2, 3)} | {host}, key=lambda x: len(x or ""))
    for level in levels if host else []:
        inside = [p for h, p in hosts if h and (h == level or level != host and h.endswith("." + level))]
        prior = (sum(inside, np.zeros(n)) + language_id.STRENGTH * prior) / (len(inside) + language_id.STRENGTH)
    logs = logs + np.log(prior)
    for value, trust in ((declared, language_id.DECLARED_TRUST), (suffix, language_id.SUFFIX_TRUST)):
        if value in m.languages:
            logs += [np.log(trust if x == value else (1 - trust) / (n - 1)) for x in m.languages]
    p = np.exp(logs - logs.max())
    p /= p.sum()
    return m.languages[int(p.argmax())], float(p.max())


def test_language_posteriors(spark):
    """All four kinds of evidence, fused, against the definition; texts are short, so that evidence decides."""
    rng = random.Random(12)
    signs = {"en": "aeiouthnsr", "fr": "aeiouéèçqr", "de": "aeiouäöüsh"}
    hosts = ["a.site.example.net", "b.site.example.net", "c.other.example.net", "site.example.net", "example.org", "www.shop.example.de", "src1", None]
    docs, pages = [], []
    for i in range(90):
        lang = rng.choice(["en", "fr", "de"])
        docs.append((i, " ".join(words(rng, rng.choice([0, 1, 1, 2, 4]), signs[lang])), lang, rng.choice(["src1", "src2", None]), "x"))
        if i % 3:
            host = rng.choice(hosts[:6])
            path = f"/{rng.choice(['en', 'fr', 'de', 'xx'])}" if rng.random() < 0.7 else ""
            pages.append((i, f"https://{host}{path}/{i}{rng.choice(['', '/', '?q=1', '.html', '#top'])}", f'<!DOCTYPE html><html class="a" lang="{rng.choice(["en-US", "fr", "de", "zz", ""])}"><p>x'))
    pages += [(1000, pages[0][1], "<html lang=de>"), (1001, None, None), (1002, "no address", ""), (1003, "http://x.example.fr/about", "<html>")]
    docs += [(3, None, "en", "src1", "x"), (None, "the then", "en", "src1", "x"), (5, "", None, None, "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, host string")
    evidence = language_id.page_evidence(spark.createDataFrame(pages, "page_id long, url string, html string"))
    told = {r.key: r for r in evidence.collect()}
    assert len(told) == 60 and told[pages[0][0]].host == pages[0][1].split("/")[2]
    got = language_id.identify(d, evidence=evidence, keep=["doc_id", "text", "host"]).collect()
    m = language_id.fit(d, "text", F.col("lang"))
    rows = []
    for i, t, _, source, _ in docs:
        e = told.get(i)
        host = e.host if e else source
        suffix = (e.suffix if e else "") or ""
        rows.append((i, t, e.declared if e else None, suffix if suffix in m.languages else language_id.SUFFIX.get(suffix), host))
    post = []
    for _, t, *_ in rows:
        pieces = list(language_id.trigrams(t or ""))
        if pieces:
            logs = sum(m.table[p].sum(0, dtype="f8") for p in pieces) / (1 + sum(len(p) for p in pieces) / language_id.EFFECTIVE)
            p = np.exp(logs - logs.max())
            post.append(p / p.sum())
        else:
            post.append(None)
    want = {}
    for k, (i, t, declared, suffix, host) in enumerate(rows):
        others = [(r[4], p) for j, (r, p) in enumerate(zip(rows, post, strict=True)) if j != k and p is not None]
        want.setdefault((i, t), posterior(m, t, declared, suffix, host, others))
    assert all(r.host == "x" for r in got)
    for r in got:
        language, p = want[r.doc_id, r.text]
        assert (r["__language"], round(r["__posterior"], 9)) == (language, round(p, 9))
    assert {r["__suffix"] for r in got} >= {"en", "fr", "de", None} and {r["__declared"] for r in got} >= {"en", "fr", "de", "zz", None}


def test_rare_languages_and_copies(spark):
    rng = random.Random(4)
    rows = [(" ".join(words(rng, 20, "aeiouthnsr")), "en") for _ in range(1500)]
    rows += [(" ".join(words(rng, 20, "éèçuaqxzvl")), "fr") for _ in range(6)] + [(" ".join(words(rng, 20, "wkzyj")), "pl") for _ in range(4)]
    copies = [(rows[0][0], "en")] * 800
    fit = lambda r, bound: language_id.fit(spark.createDataFrame(r, "text string, lang string"), "text", F.col("lang"), bound)
    m = fit(rows + copies, 40)
    assert m.languages == ["en", "fr"]  # by all rows, not by those of a sample of 40
    for bound in (40, 10_000):
        assert np.array_equal(fit(rows + copies, bound).table, fit(rows, bound).table)
    # all six texts of the rare language are counted
    assert np.allclose(m.table[:, 1], fit(rows[1500:1506], 40).table[:, 0])


def shingle_weights(text, df, n):
    w = text.split()
    out = {}
    for i in range(max(1, len(w) - 4) if w else 0):
        out[tuple(w[i : i + 5])] = out.get(tuple(w[i : i + 5]), 0) + 1
    return {s: (1 + np.log(t)) * (1 - (np.log(df.get(s, 1)) / np.log(n)) ** 2 / 2) for s, t in out.items()}


def near_texts():
    rng = random.Random(3)
    texts = []
    for size in (1, 1, 2, 5, 40, 120):  # families of near copies, more and less alike
        base = words(rng, 150)
        for _ in range(size):
            w = list(base)
            for k in rng.sample(range(150), rng.choice([0, 1, 2, 3, 4, 8])):
                w[k] = words(rng, 1)[0]
            texts.append(" ".join(w))
    shared = " ".join(words(rng, 30))
    texts += [" ".join(words(rng, 60)) + " " + shared for _ in range(60)]
    return texts + [texts[0], texts[0], "", None, " \n", "two words", "two  words", "two words!", texts[50]]


@pytest.mark.parametrize("small", [64, 4])
def test_near_duplicates(spark, monkeypatch, small):
    monkeypatch.setattr(near_dedup, "SMALL", small)
    if small == 4:  # many blocks, several passes over named shingles, no broadcast
        monkeypatch.setattr(near_dedup, "BLOCK", 32)
        monkeypatch.setattr(near_dedup, "SLICE", 300)
        monkeypatch.setattr(near_dedup, "LEAST", 5000)
        monkeypatch.setattr(near_dedup, "MOST", 5000)
        monkeypatch.setattr(near_dedup, "HELD", 700)
        monkeypatch.setattr(near_dedup, "BROADCAST_KEYS", 0)
    texts = near_texts()
    d = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)] + [(3, texts[3], "k"), (None, texts[2], "k")], "doc_id long, text string, key string")
    rows = near_dedup.deduplicate(d).collect()
    assert len(rows) == len(texts) + 2
    got = {r.doc_id: r.class_id for r in rows if r.doc_id is not None}
    plain = [t or "" for t in texts]
    n = len(set(plain))
    df = {}
    for t in set(plain):
        for s in shingle_weights(t, {}, 2):
            df[s] = df.get(s, 0) + 1
    weights = [shingle_weights(t, df, n) for t in plain]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            a, b = weights[i], weights[j]
            both = sum(min(a[s], b[s]) for s in a.keys() & b.keys())
            whole = sum(a.values()) + sum(b.values()) - both
            if plain[i] == plain[j] or (whole and both / whole >= near_dedup.CLOSE):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    assert got == {i: find(i) for i in range(len(texts))}
    assert sum(r.kept for r in rows) == len(set(got.values()))  # one of the two rows (3, texts[3]) at most
    assert all(r.doc_id == r.class_id for r in rows if r.kept)
    kept = near_dedup.keep_first(d)
    assert kept.columns == d.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(got.values()))
    assert near_dedup.deduplicate(d.limit(0)).count() == 0


def test_samples_estimate_similarity():
    rng = random.Random(5)
    nothing = np.zeros(0, "u8"), np.zeros(0, "i8")
    pairs = []
    for step in (200, 40, 20):
        base = words(rng, 400)
        other = list(base)
        for k in range(0, 400, step):
            other[k] = "changed"
        owner, h, times = near_dedup.shingles([" ".join(base).encode(), " ".join(other).encode()])
        weights = near_dedup.log_weights(h, times, nothing, 10)
        marks = near_dedup.sample(owner, h, weights, 2)
        vecs = [(h[owner == k], np.exp(weights[owner == k])) for k in (0, 1)]
        true = near_dedup.weighted_jaccard(*vecs)
        assert abs((marks[0] == marks[1]).mean() - true) < 0.25
        p = near_dedup.profiles(owner, h, np.exp(weights), 2)
        bound = np.minimum(*p).sum() / np.maximum(*p).sum()
        assert true <= bound + 1e-6  # never rules out what reaches the threshold
        pairs.append((true, bound))
    assert near_dedup.able(p[0], p[1]) == (pairs[-1][1] >= near_dedup.THRESHOLD)


@pytest.mark.parametrize("bits", [0, 3, 18])
def test_ranges_hold_whole_hashes(bits):
    h = np.unique(np.random.default_rng(bits).integers(0, 2**64 - 1, 5000, dtype="u8"))
    rows = list(near_dedup.ranges_of(h, np.ones(len(h), "i8"), bits))
    assert np.array_equal(np.concatenate([near_dedup.hashes_of(*r[1:4]) for r in rows]), h)
    assert len({r[0] for r in rows}) == len(rows) and (len(rows) == 1) == (bits == 0)


@pytest.mark.parametrize("size", [40, 7])
def test_pieces_have_the_same_shingles(monkeypatch, size):
    rng = random.Random(8)
    texts = [" ".join(words(rng, n, "ab")) for n in (0, 1, 4, 5, 6, 200)] + ["x" * 90 + " a b c d e  " + "y" * 50, " \n a b c d \n", "a b c d e" + " " * 60]
    for t in texts:
        want = near_dedup.few_shingles([t.encode()])
        monkeypatch.setattr(near_dedup, "SLICE", size)
        got = near_dedup.shingles([t.encode()])
        assert all(np.array_equal(a, b) for a, b in zip(got[1:], want[1:], strict=True))


@pytest.mark.parametrize("unlike", [True, False])
def test_large_buckets(spark, monkeypatch, unlike):
    """One bucket of many members that are unlike each other, or of which many are near the threshold; one is very long."""
    monkeypatch.setattr(near_dedup, "BLOCK", 100)
    rng = random.Random(11)
    shared = words(rng, 80)
    texts = []
    for _ in range(300):
        own = list(shared)
        for k in rng.sample(range(80), 40 if unlike else rng.choice([1, 2, 3, 4])):
            own[k] = words(rng, 1)[0]
        texts.append(" ".join(own))
    texts.append(" ".join(words(rng, 30_000)))
    rows = spark.createDataFrame([(bytes([k >> 8, k & 255]) * 8, t, k % 3) for k, t in enumerate(texts)], "key binary, t string, chunk long")
    light = spark.createDataFrame([], "chunk long, hs binary, ns binary")
    sigs = materialize(near_dedup.signatures(rows, light, len(texts)), "t")
    made = materialize(near_dedup.vectors(rows, light, len(texts)), "t")
    members = sigs.select(F.lit(1).cast("long").alias("bucket"), "key", "shingles")
    labels = spark.createDataFrame([], "node binary, label binary")
    left = near_dedup.open_buckets(members, labels)
    links = [(bytes(r.a), bytes(r.b)) for r in near_dedup.block_links(left, sigs, made).collect()]
    by = {bytes(r.key): (np.frombuffer(r.h, "u8"), np.frombuffer(r.w, "f4")) for r in made.collect()}
    keys = sorted(by)
    parent = {k: k for k in keys}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def classes(pairs):
        parent.update({k: k for k in keys})
        for a, b in pairs:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
        return [find(k) for k in keys]

    got = classes(links)
    want = classes((a, b) for i, a in enumerate(keys) for b in keys[:i] if near_dedup.weighted_jaccard(by[a], by[b]) >= near_dedup.CLOSE)
    assert got == want
    assert (len(set(got)) == len(texts)) == unlike


def test_pipeline_stages(spark):
    rng = random.Random(9)
    base = ["".join(rng.choices("aeiouthnsr", k=5)) for _ in range(3000)]
    rows = [(i, " ".join(rng.sample(base, 60)), "en", "s", 0) for i in range(60)]
    rows += [(100, rows[0][1], "en", "s", 0), (101, "12 34", "en", "s", 0), (102, " ".join(w + "###" for w in rows[5][1].split()), "en", "s", 0)]
    rows += [(103, " ".join(rng.sample(base, 60)) + " password=abcdefghijklmnop", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    names = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, ""), "test")
        names.append((name, {r.doc_id for r in docs.collect()}))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    whole = {r[0] for r in rows}
    assert names[0] == ("language_id", whole - {101})
    assert names[1] == ("quality_rules", whole - {101, 102})
    assert names[2] == ("near_dedup", whole - {100, 101, 102})
    assert "abcdefghijklmnop" not in docs.where("doc_id = 103").first().text
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == len(names[2][1])
