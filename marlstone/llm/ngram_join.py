"""Set similarity self-join of word shingles by adaptive multi-match prefixes.

1. Equal texts take part once. Shingles are hashed to 64 bits and ordered by
   rising document frequency, then hash; frequencies come from one exchange of
   packed ranges (``near_dedup.frequencies``).
2. A set of n shingles can only reach Jaccard similarity P % with a set that
   shares at least ceil(P n / 100) of them. So two linked sets share one shingle
   among the first n - ceil(P n / 100) + 1 of each, and k of them in prefixes
   that are k - 1 longer. Shingles of one document only come first; a document
   with more of them than it may miss has no partner and leaves here.
3. Each document chooses its own k from 1 to ``DEEPEST``: a longer prefix costs
   more postings, and a partner must match k of its shingles, so fewer have to
   be verified. Estimated cost: postings scanned, and for candidates the least
   of all bounds that the frequencies of its prefix give. A pair has to share
   the smaller k of its two documents.
4. Documents of one prefix shingle meet in a bucket. No bucket is expanded into
   all pairs: each member is first compared with one leader, links are merged
   into components, and buckets inside one component are done. In the others,
   pairs of different components are counted over their buckets (``SMALL``), or
   compared in blocks inside tasks; the largest component of a bucket is never
   compared with itself. No link between components is lost.
5. Candidates are verified by 100 * intersection >= P * union of whole sets.

Defined results: a null text is the empty text; a text without words has no
shingles and is linked with nothing, not even an equal one; fewer words than
``words`` are one shingle; texts longer than ``near_dedup.SLICE`` are cut into
overlapping pieces, which changes memory only; a null id is a row of its
component and never its name, unless all are null; repeated rows are rows of
one component; an empty table gives an empty table; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import content_key, discard, materialize, scratch, small_batches
from marlstone.llm.near_dedup import BLOCK, Cut, components, counted, distinct_texts, ordered, shingles

WORDS, PERCENT = 4, 85
DEEPEST = 8
SMALL = 64
#: Postings scanned cost 1; verifying costs this for a shingle of the document.
VERIFY = 0.05


def lower_shingles(words: int) -> Cut:
    """Shingles of the text with A to Z in lower case."""
    return lambda docs: shingles([d.lower() for d in docs], words)


def misses(n: int, percent: int) -> int:
    """How many of ``n`` shingles a partner need not have."""
    return n * (100 - percent) // 100


def depth(df: np.ndarray, n: int, alone: int, percent: int) -> int:
    """The number k of prefix shingles to share that costs least.

    ``df`` are the frequencies of the shingles that other documents have too, rising.
    """
    up = np.concatenate([[0], np.cumsum(df.astype("i8") - 1)])
    first = misses(n, percent) - alone  # shingles of the prefix are those before first + k
    best, least, bound = 1, np.inf, np.inf
    for k in range(1, DEEPEST + 1):
        q = first + k
        if q > len(df):
            break
        # whoever shares k of q shares m of the first q - k + m, for every m up to k
        bound = min(up[q - k + m] / m for m in range(1, k + 1))
        cost = up[q] + VERIFY * n * bound
        if cost < least:
            best, least = k, cost
    return best


def sets_of(texts: DataFrame, light: DataFrame, cut: Cut, percent: int) -> DataFrame:
    """key, n, k, prefix, tokens of every text; without tokens (8 bytes each, by frequency) where no partner is possible."""

    def make(docs: int, owner: np.ndarray, h: np.ndarray, times: np.ndarray, df: np.ndarray) -> list[tuple]:
        cuts, out = np.searchsorted(owner, np.arange(docs + 1)), []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            n, shared = b - a, df[a:b] > 1
            alone = n - int(shared.sum())
            if not n or alone > misses(n, percent):
                out.append((n, 0, None, None))
                continue
            own, many = h[a:b][shared], df[a:b][shared]
            order = np.lexsort((own, many))
            own, many = own[order], many[order]
            k = depth(many, n, alone, percent)
            out.append((n, k, own[: misses(n, percent) - alone + k].astype("<i8").tobytes(), own.tobytes()))
        return out

    return counted(texts, light, make, "key binary, n long, k int, prefix binary, tokens binary", cut)


def postings(sets: DataFrame) -> DataFrame:
    """(bucket, key, n, k): one row for each prefix shingle."""
    each = F.transform(F.sequence(F.lit(1), F.length("prefix"), F.lit(8)), lambda i: F.substring(F.col("prefix"), i, F.lit(8)))
    return sets.select(F.explode(each).alias("bucket"), "key", "n", "k")


def common(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def linked(n: int, m: int, both: int, percent: int) -> bool:
    return 100 * both >= percent * (n + m - both)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that share enough of their prefixes, and then of their sets."""

    @F.pandas_udf("boolean")
    def close(na: pd.Series, ka: pd.Series, pa: pd.Series, ta: pd.Series, nb: pd.Series, kb: pd.Series, pb: pd.Series, tb: pd.Series) -> pd.Series:
        out, of = [], lambda x: np.frombuffer(x, "<u8")
        for n, k, p, t, m, j, q, s in zip(na, ka, pa, ta, nb, kb, pb, tb, strict=True):
            out.append(100 * min(n, m) >= percent * max(n, m) and common(of(p), of(q)) >= min(k, j) and linked(n, m, common(of(t), of(s)), percent))
        return pd.Series(out)

    both = pairs
    for side in "ab":
        own = sets.select(F.col("key").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("n", "k", "prefix", "tokens")])
        both = both.join(own, side)
    of = [f"{c}_{side}" for side in "ab" for c in ("n", "k", "prefix", "tokens")]
    return both.where(close(*of)).select("a", "b")


def leader_pairs(members: DataFrame) -> DataFrame:
    """Each member with the leader of its bucket: linear in the postings."""
    lead = materialize(members.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("key").alias("h"), "key")).alias("m")).select("bucket", F.col("m.key").alias("a")), "join-leaders")
    return ordered(members.join(lead, "bucket").where("key != a").select("a", F.col("key").alias("b")))


def open_members(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of the buckets in several components: bucket, key, n, k, label, size, giant (the label of the most members), outer (blocks of the others), inner."""
    own = labels.select(F.col("node").alias("key"), F.col("label").alias("__l"))
    rows = materialize(members.join(own, "key", "left").select("bucket", "key", "n", "k", F.coalesce("__l", "key").alias("label")), "join-members")
    parts = rows.groupBy("bucket", "label").agg(F.count("*").alias("some"))
    mixed = parts.groupBy("bucket").agg(F.sum("some").alias("size"), F.max(F.struct("some", "label")).alias("top"), F.count("*").alias("kinds")).where("kinds > 1")
    mixed = mixed.select("bucket", "size", F.col("top.label").alias("giant"), F.ceil(F.col("top.some") / BLOCK).alias("inner"), F.ceil((F.col("size") - F.col("top.some")) / BLOCK).alias("outer"))
    return materialize(rows.join(materialize(mixed, "join-open"), "bucket"), "join-left")


def small_pairs(left: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that share as many small buckets as the smaller k asks for.

    A pair that shares a large bucket as well is counted in full there.
    """
    some = left.where(F.col("size") <= SMALL)
    other = some.select("bucket", F.col("key").alias("b"), F.col("label").alias("lb"), F.col("n").alias("nb"), F.col("k").alias("kb"))
    both = some.withColumnRenamed("key", "a").join(other, "bucket").where(F.col("label") < F.col("lb"))
    both = both.where(100 * F.least("n", "nb") >= percent * F.greatest("n", "nb")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.least("k", "kb").alias("k"))
    return both.groupBy("a", "b", "k").agg(F.count("*").alias("shared")).where("shared >= k").select("a", "b")


def matches(mine: np.ndarray, tokens: np.ndarray, owner: np.ndarray, docs: int) -> np.ndarray:
    """How many of ``mine`` each document has; ``tokens`` are sorted, ``owner`` is who has them."""
    low, high = np.searchsorted(tokens, mine, "left"), np.searchsorted(tokens, mine, "right")
    size = high - low
    at = np.arange(int(size.sum())) + np.repeat(low - (np.cumsum(size) - size), size)
    return np.bincount(owner[at], minlength=docs)


def close_pairs(group: pd.DataFrame, column: str, percent: int, whole: bool) -> Iterator[tuple[int, int]]:
    """Pairs between the two blocks of different components that share enough of ``column``.

    With ``whole`` the sets are compared and pairs that links found before join
    are left out; else prefixes are counted against the smaller k.
    """
    of = [np.frombuffer(x, "<u8") for x in group[column]]
    n, k, block, label = group["n"].to_numpy(), group["k"].to_numpy(), group["block"].to_numpy(), pd.factorize(group["label"])[0]
    left, right = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
    tokens, owner = np.concatenate([of[j] for j in right]), np.repeat(right, [len(of[j]) for j in right])
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    root = list(range(int(label.max()) + 1))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for i in left.tolist():
        both = matches(of[i], tokens, owner, len(group))
        if whole:
            good = 100 * both >= percent * (n[i] + n - both)
        else:
            good = (both >= np.minimum(k[i], k)) & (both > 0) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i]))
        good[: i + 1 if block.min() == block.max() else 0] = False
        good[left if block.min() != block.max() else []] = False
        for j in np.flatnonzero(good & (label != label[i])).tolist():
            if whole:
                x, y = find(label[i]), find(label[j])
                if x == y:
                    continue
                root[x] = y
            yield i, j


def block_links(left: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Verified links between components in buckets of more than ``SMALL`` members, block against block.

    The largest component of a bucket is cut into blocks 0..inner-1, the others
    into the next ``outer``; of two blocks that meet, one at least is of the others.
    Prefixes travel first, whole sets only for members that have a candidate.
    """
    g, s = F.col("inner"), F.col("outer")
    inside = F.col("label") == F.col("giant")
    block = F.when(inside, F.pmod(F.xxhash64("key"), g)).otherwise(g + F.pmod(F.xxhash64("key"), s))
    others = F.sequence(F.when(inside, g).otherwise(F.lit(0)), g + s - 1)
    rows = left.where(F.col("size") > SMALL).select("bucket", "key", "n", "k", "label", block.alias("block"), F.explode(others).alias("other"))
    rows = rows.select("bucket", "key", "n", "k", "label", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))

    def hopeful(group: pd.DataFrame) -> pd.DataFrame:
        found = np.zeros(len(group), bool)
        if group["block"].nunique() == 2 or group["x"].iloc[0] == group["y"].iloc[0]:
            for i, j in close_pairs(group, "prefix", percent, False):
                found[i] = found[j] = True
        return group[found].drop(columns="prefix")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        key = group["key"].tolist()
        found = close_pairs(group, "tokens", percent, True) if group["block"].nunique() == 2 or group["x"].iloc[0] == group["y"].iloc[0] else []
        return pd.DataFrame([tuple(sorted((bytes(key[i]), bytes(key[j])))) for i, j in found], columns=["a", "b"])

    cells = ["bucket", "x", "y"]
    schema = "bucket binary, key binary, n long, k int, label binary, block long, x long, y long"
    some = materialize(rows.join(sets.select("key", "prefix"), "key").groupBy(*cells).applyInPandas(hopeful, schema), "join-hopeful")
    return some.join(sets.select("key", "tokens"), "key").groupBy(*cells).applyInPandas(compare, "a binary, b binary").distinct()


def links(docs: DataFrame, text: str = "text", words: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Two written tables: key and n (shingles) of every distinct text; key and label (one key of its component) of every linked one."""
    small_batches(docs.sparkSession)
    with scratch() as keep:
        cut = lower_shingles(words)
        written, texts, light, _ = distinct_texts(docs, text, cut)
        every = materialize(sets_of(texts, light, cut, percent), "join-sets")
        discard(written)
        discard(light)
        sizes = keep(materialize(every.select("key", "n"), "join-sizes"))
        sets = materialize(every.where("tokens is not null"), "join-able")
        discard(every)
        posted = postings(sets)
        shared = materialize(posted.groupBy("bucket").agg(F.min("key").alias("x"), F.max("key").alias("y")).where("x != y").select("bucket"), "join-buckets")
        members = materialize(posted.join(shared, "bucket", "left_semi"), "join-members")

        def checked(pairs: DataFrame) -> DataFrame:
            return materialize(verified(materialize(pairs, "join-pairs"), sets, percent), "join-links")

        first = checked(leader_pairs(members))
        labels = components(first)
        left = open_members(members, labels)
        more = checked(small_pairs(left, percent)).union(materialize(block_links(left, sets, percent), "join-links"))
        if more.limit(1).count():
            labels = components(first.union(more))
        return sizes, keep(labels)


def link(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row for each document: key, n_shingles, component_id (the least key that links reach, its own included)."""
    sizes, labels = links(docs, text, words, percent)
    known = sizes.join(labels.select(F.col("node").alias("key"), "label"), "key", "left").select("key", "n", F.coalesce("label", "key").alias("label"))
    rows = docs.select(F.col(f"`{key}`").alias("id"), content_key(f"`{text}`").alias("key"))
    least = rows.groupBy("key").agg(F.min("id").alias("id"))
    named = known.join(least, "key")
    named = named.join(named.where("n > 0").groupBy("label").agg(F.min("id").alias("component")), "label", "left").select("key", "n", "component")
    named = materialize(named, "join-components")
    out = rows.join(named, "key")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id"))
