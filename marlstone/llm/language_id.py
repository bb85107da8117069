"""Language ID by Bayesian evidence fusion.

Four pieces of evidence are multiplied: the likelihood of the text's byte
trigrams in each language, the language that the markup declares, the language
that the address names (its path, or else its country suffix), and a prior of
the host. Host priors are hierarchically smoothed: a host towards its site (the
last three labels), a site towards its domain (the last two), a domain towards
the whole table; their counts are sums of text posteriors, made by grouped
aggregation over all rows. A row's own posterior is taken out of every count
before it is used as that row's prior.

Markup and addresses come from the pages that show the documents
(``page_evidence``); a document without a page has its source as host, and no
declared language. The label column trains the trigram model and is no evidence.
The model is trained here on a bounded sample of the distinct texts of each
label with ``LEAST_ROWS`` rows or more in the whole table (``TRAIN_ROWS`` of
each in expectation, chosen by a hash).

Defined results: a null text is empty; a text without letters has language
``und`` and is rejected; a null or unknown declared language, host or suffix is
no evidence; of several pages of one document that with the least id counts;
repeated rows are rated alike, ties go to the language that sorts first; texts
are read whole, a piece at a time; if nothing is labelled anywhere, every row is
``und``; an empty table gives an empty table; other columns, whatever their
names, are kept untouched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import content_key, materialize, scratch, share, shared, small_batches, text_of

TRAIN_ROWS = 8_000
LEAST_ROWS = 5
BITS = 14
HASHES = 1 << 40
SMOOTH = 0.5
EFFECTIVE = 200.0
DECLARED_TRUST = 0.9
SUFFIX_TRUST = 0.8
STRENGTH = 20.0
LEAST_POSTERIOR = 0.5
BROADCAST_ROWS = 100_000
PIECE = 1 << 20
# Languages of country suffixes.
SUFFIX = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "ie": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl", "se": "sv", "ru": "ru", "jp": "ja", "cn": "zh"}
_BLANK = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # (buckets, languages): log probabilities, float32


def trigrams(text: str) -> Iterator[np.ndarray]:
    """Buckets of the byte trigrams of a lower-cased text, a bounded piece at a time; none without letters."""
    data = f" {text} ".lower().encode("utf-8", "surrogatepass").translate(_BLANK)
    if not data.strip():
        return
    raw = np.frombuffer(data, "u1")
    for at in range(0, len(raw) - 2, PIECE):
        part = raw[at : at + PIECE + 2].astype("u4")
        code = (part[:-2] << 16) | (part[1:-1] << 8) | part[2:]
        yield ((code * np.uint32(2654435761)) >> np.uint32(32 - BITS))[code != 0x202020]


def language_code(column: Column) -> Column:
    """``en-US`` and ``EN_us`` are ``en``."""
    return F.nullif(F.lower(F.regexp_extract(F.coalesce(column, F.lit("")), r"^\s*([A-Za-z]{2,3})(?:[-_].*)?\s*$", 1)), F.lit(""))


def fit(docs: DataFrame, text: str, declared: Column, bound: int = TRAIN_ROWS) -> Model:
    """Trigram log probabilities of each declared language; counts of at most 2^BITS buckets a language reach the driver.

    A language is known by its count over all rows. Of each known one, distinct
    texts are taken by their hash, ``bound`` in expectation, so neither frequent
    languages nor copies of a text displace others.
    """
    rows = docs.select(text_of(text).alias("t"), language_code(declared).alias("l")).where("l is not null").withColumn("h", F.xxhash64("t"))
    sizes = rows.groupBy("l", "h").agg(F.count("*").alias("n")).groupBy("l").agg(F.sum("n").alias("n"), F.count("*").alias("texts")).where(F.col("n") >= LEAST_ROWS).collect()
    languages = sorted(r["l"] for r in sizes)
    if not languages:
        return Model([], np.zeros((1 << BITS, 0), "f4"))
    place = {v: k for k, v in enumerate(languages)}
    most = [(r["l"], place[r["l"]], math.ceil(min(1.0, bound / r["texts"]) * HASHES)) for r in sizes]
    known = docs.sparkSession.createDataFrame(most, "l string, k int, most long")
    rows = rows.join(F.broadcast(known), "l").where(F.pmod("h", F.lit(HASHES)) < F.col("most")).groupBy("k", "h").agg(F.min("t").alias("t"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, t in zip(batch["k"], batch["t"], strict=True):
                own = seen.setdefault(k, np.zeros(1 << BITS, "i8"))
                for buckets in trigrams(t):
                    own += np.bincount(buckets, minlength=1 << BITS)
        for k, own in seen.items():
            at = np.flatnonzero(own)
            yield pd.DataFrame({"k": k, "b": at, "n": own[at]})

    counts = rows.select("k", "t").mapInPandas(count, "k int, b int, n long").groupBy("k", "b").agg(F.sum("n").alias("n")).toArrow()
    full = np.zeros((1 << BITS, len(languages)))
    full[counts["b"].to_numpy(), counts["k"].to_numpy()] = counts["n"].to_numpy()
    smoothed = full + SMOOTH
    return Model(languages, np.log(smoothed / smoothed.sum(0)).astype("f4"))


def text_evidence(docs: DataFrame, m: Model, text: str, out: str = "__ll") -> DataFrame:
    """Adds the tempered log-likelihoods of the text (null without letters) and the mean of the best one."""
    given = share(docs.sparkSession, m)

    @F.pandas_udf("ll array<double>, post array<double>, mean double")
    def work(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        table = shared(given).table
        for texts in batches:
            found, posts, means = [], [], []
            for t in texts:
                total, n = np.zeros(table.shape[1]), 0
                for buckets in trigrams(t):
                    total += table[buckets].sum(0, dtype="f8")
                    n += len(buckets)
                mean = total / max(n, 1)
                if not n:
                    found.append(None), posts.append(None), means.append(None)
                    continue
                logs = mean * n / (1 + n / EFFECTIVE)
                post = np.exp(logs - logs.max())
                found.append(logs.tolist()), posts.append((post / post.sum()).tolist()), means.append(float(mean.max()))
            yield pd.DataFrame({"ll": pd.Series(found, dtype=object), "post": pd.Series(posts, dtype=object), "mean": pd.Series(means, dtype="f8")})

    return docs.withColumn(out, work(text_of(text)))


def page_evidence(pages: DataFrame, url: str = "url", html: str = "html", order: str = "page_id") -> DataFrame:
    """key, declared, host, suffix of each document that a page shows.

    Addresses are ``scheme://host/language/document...``. The declared language
    is that of the html element; suffix is the language in the path, else the
    last label of the host.
    """
    address = F.coalesce(F.col(f"`{url}`"), F.lit(""))
    pattern = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)(?::[0-9]+)?(?:/([a-z]{2})(?=/))?(?:/([0-9]{1,18})(?![0-9]))?"
    piece = lambda k: F.nullif(F.regexp_extract(address, pattern, k), F.lit(""))
    markup = F.regexp_extract(F.coalesce(F.col(f"`{html}`"), F.lit("")), r"""(?i)<html\b[^>]*?\slang\s*=\s*["']?([A-Za-z_-]+)""", 1)
    rows = pages.select(piece(3).cast("long").alias("key"), F.col(f"`{order}`").alias("o"), language_code(markup).alias("declared"), F.lower(piece(1)).alias("host"), piece(2).alias("path"))
    rows = rows.where("key is not null").withColumn("suffix", F.coalesce("path", F.regexp_extract("host", r"\.([a-z]{2})$", 1)))
    first = rows.groupBy("key").agg(F.min(F.struct("o", "declared", "host", "suffix")).alias("m"))
    return first.select("key", "m.declared", "m.host", "m.suffix")


def host_counts(rows: DataFrame, m: Model) -> tuple[DataFrame, list[float]]:
    """Sums of text posteriors: (__h, host, site, domain) for every host, as a written table, and those of all rows.

    Site and domain are null where they are the host itself. ``rows`` has __host
    and __ll. Sums are partial before the shuffle, so a host with a third of all
    rows costs no more than another.
    """
    n = len(m.languages)
    soft = rows.where("__ll.post is not null").select("__host", *[F.col("__ll.post")[k].alias(f"p{k}") for k in range(n)])
    sums = [F.sum(f"p{k}").alias(f"p{k}") for k in range(n)]
    part = lambda k: F.substring_index("__host", ".", -k)
    hosts = materialize(soft.groupBy("__host").agg(*sums).withColumns({"__site": part(3), "__domain": part(2)}), "langid-hosts")
    world = [x or 0.0 for x in hosts.agg(*sums).first()]
    made = F.array(*[F.col(f"p{k}") for k in range(n)])
    out = hosts.where("__host is not null").select(F.col("__host").alias("__h"), "__site", "__domain", made.alias("host"))
    for level, below in (("site", "__h"), ("domain", "__site")):
        table = hosts.groupBy(f"__{level}").agg(*sums).select(F.col(f"__{level}").alias("__key"), made.alias(level))
        out = out.join(table, (F.col(f"__{level}") == F.col("__key")) & (F.col(f"__{level}") != F.col(below)), "left").drop("__key")
    return materialize(out.select("__h", "host", "site", "domain"), "langid-priors"), world


def fuse(rows: DataFrame, counts: tuple[DataFrame, list[float]], m: Model) -> DataFrame:
    """Adds __language, __posterior and __kept to rows with __ll, __declared, __host, __suffix; drops the text evidence."""
    languages, n = m.languages, len(m.languages)
    table, world = counts

    def told(column: str, k: int, trust: float) -> Column:
        known = F.col(column).isin(languages)
        return F.when(known & (F.col(column) == languages[k]), math.log(trust)).when(known, math.log((1 - trust) / max(1, n - 1))).otherwise(0.0)

    own = F.col("__ll.post")

    def towards(sums: Column, above: Column) -> Column:
        """A level's counts without the row itself, smoothed towards the level above; the level above where there are none."""
        rest = F.zip_with(sums, own, lambda c, x: F.greatest(c - x, F.lit(0.0)))
        size = F.greatest(F.aggregate(sums, F.lit(0.0), lambda a, c: a + c) - 1, F.lit(0.0))
        return F.when(sums.isNull(), above).otherwise(F.zip_with(rest, above, lambda c, q: (c + STRENGTH * q) / (size + STRENGTH)))

    # a host occurs once in the table
    both = rows.join(table, F.col("__host") == F.col("__h"), "left")
    q = F.zip_with(F.array(*[F.lit(float(x)) for x in world]), own, lambda c, x: (F.greatest(c - x, F.lit(0.0)) + 1) / F.lit(max(sum(world) - 1, 0.0) + n))
    for level in ("domain", "site", "host"):
        q = towards(F.col(level), q)
    both = both.withColumn("__q", q)
    # the softmax of the logs: the posterior of the best is 1 / sum(exp(x - best))
    logs = [F.col("__ll.ll")[k] + told("__declared", k, DECLARED_TRUST) + told("__suffix", k, SUFFIX_TRUST) + F.log(F.col("__q")[k]) for k in range(n)]
    both = both.withColumn("__logs", F.array(*logs))
    best = F.array_max("__logs")
    odds = F.transform(F.array(best), lambda top: F.aggregate("__logs", F.lit(0.0), lambda a, x: a + F.exp(x - top)))[0]
    name = F.element_at(F.array(*[F.lit(x) for x in languages]), F.array_position("__logs", best).cast("int"))
    some = F.col("__ll.ll").isNotNull()
    out = both.withColumns({"__language": F.when(some, name).otherwise("und"), "__posterior": F.when(some, 1 / odds).otherwise(0.0)})
    fits = some & (F.col("__posterior") >= LEAST_POSTERIOR) & (F.col("__ll.mean") >= -BITS * math.log(2))
    return out.withColumn("__kept", F.coalesce(fits, F.lit(False))).drop("__h", "host", "site", "domain", "__q", "__logs", "__ll")


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", host: str = "source", evidence: DataFrame | None = None, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all by default) with __declared, __suffix, __host, __language, __posterior, __kept of every row.

    ``evidence`` has one row (key, declared, host, suffix) for a key at most. The
    evidence of the texts is written once, beside the ``keep`` columns, and read for
    both the priors and the fusion.
    """
    small_batches(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    names = [f"__c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    of = dict(zip(docs.columns, names, strict=True))
    m = fit(plain, of[text], F.col(of[label]))
    named = [F.col(of[c]).alias(f"__k{i}") for i, c in enumerate(keep)]
    back = {f"__k{i}": c for i, c in enumerate(keep)}
    if not m.languages:
        nothing = [F.lit(None).cast("string").alias(c) for c in ("__declared", "__suffix", "__host")]
        return plain.select(*named, *nothing, F.lit("und").alias("__language"), F.lit(0.0).alias("__posterior"), F.lit(False).alias("__kept")).withColumnsRenamed(back)
    ready = text_evidence(plain, m, of[text]).select(*named, F.col(of[key]).alias("__id"), F.col(of[host]).alias("__source"), "__ll")
    ready = materialize(ready, "langid-evidence")
    blank = F.lit(None).cast("string")
    if evidence is None:
        ready = ready.withColumns({"__told": blank, "__at": blank, "__tail": blank})
    else:
        ready = ready.join(evidence.select(F.col("key").alias("__doc"), F.col("declared").alias("__told"), F.col("host").alias("__at"), F.col("suffix").alias("__tail")), F.col("__id") == F.col("__doc"), "left").drop("__doc")
    countries = F.create_map(*[F.lit(x) for kv in SUFFIX.items() for x in kv])
    where = F.nullif(F.lower(F.coalesce("__at", "__source", F.lit(""))), F.lit(""))
    tail = F.lower(F.coalesce("__tail", F.regexp_extract(where, r"\.([a-z]{2})$", 1), F.lit("")))
    suffix = F.when(tail.isin(m.languages), tail).otherwise(F.try_element_at(countries, tail))
    ready = ready.select(*back, language_code(F.col("__told")).alias("__declared"), suffix.alias("__suffix"), where.alias("__host"), "__ll")
    return fuse(ready, host_counts(ready, m), m).withColumnsRenamed(back)


def keep_identified(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", **how: object) -> DataFrame:
    """The rows of ``docs`` whose language is known, with their own columns.

    A verdict follows from key, text and host; the rejected ones are written and taken out by a join.
    """
    names = [f"__c{i}" for i in range(len(docs.columns))]
    of = dict(zip(docs.columns, names, strict=True))
    rows = docs.toDF(*names).withColumn("__content", content_key(of[text]))
    parts = [of[key], "__content", of[host]]
    how = how | {"label": of[how.get("label", "lang")]}
    with scratch() as keep:
        bad = identify(rows, of[key], of[text], host=of[host], keep=parts, **how).where(~F.col("__kept")).select(*[F.col(c).alias(f"__bad{i}") for i, c in enumerate(parts)])
        bad = keep(materialize(bad.distinct(), "langid-rejected"))
    if bad.count() <= BROADCAST_ROWS:
        bad = F.broadcast(bad)  # its size was just counted
    same = [F.col(c).eqNullSafe(F.col(f"__bad{i}")) for i, c in enumerate(parts)]
    return rows.join(bad, same, "left_anti").select(*names).toDF(*docs.columns)
