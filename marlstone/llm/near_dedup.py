"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles.

1. Equal texts share one content key and take part once. Their word shingles
   (five words) are hashed to 64 bits. A shingle weighs (1 + ln tf) *
   (1 - (ln df / ln N)^2 / 2), with its own document frequency df among the N
   distinct texts: 1 for a shingle of one text, 1/2 for one of all texts. The
   square keeps the few shared shingles of a small group near 1, so that what
   plain Jaccard similarity calls 0.8 is 0.8 here too. Frequencies come from one exchange: each chunk of texts sends
   the ranges of its sorted hashes, with its own counts, to the tasks of those
   ranges, which add them up and answer each chunk with the hashes that two
   texts or more have. A task sends a hash of a chunk once for each ``HELD``
   hashes it has read, so no shingle is a hot key. A chunk and a range have
   ``share_of`` the corpus, which grows with its square root up to ``MOST``: rows
   between them stay long (25 hashes and more at 100 TB) and tasks bounded.
2. Improved consistent weighted sampling gives ``BANDS * ROWS`` samples a
   document; equal samples have the weighted Jaccard similarity as probability.
3. Documents that share a band meet in a bucket. No bucket is expanded into all
   pairs: first each member is compared with one leader, verified links are
   merged into components, and buckets inside one component are done. In the
   other buckets every pair of different components is compared, so no link is
   lost: small buckets (``SMALL``) by a join, larger ones in blocks inside the
   tasks. The largest component of a bucket is never compared with itself.
4. Before two texts are compared, their similarity is bounded from above by the
   sums of weights in ``PROFILE`` classes of shingles: sum of minima over sum of
   maxima. No pair at the threshold is passed over. Blocks are first compared by
   these profiles; whole vectors travel only for members that have a partner in
   the other block. What the bound lets through is verified by the exact
   weighted Jaccard similarity of the whole texts.

Defined results: a null text is the empty text; texts without words are in a
class only with equal texts; texts of one to four words have one shingle; a text
longer than ``SLICE`` is cut into overlapping pieces, which changes memory only;
a null doc_id is a row of its class, and the class id is the least doc_id that
is not null; repeated rows are members of one class, of which one is kept; an
empty table gives an empty table; other columns, whatever their names, are
ignored.
"""

from __future__ import annotations

import math
import re
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import content_key, discard, materialize, release, scratch, small_batches, text_of

WORDS = 5
THRESHOLD = 0.8
#: Weights are kept with 32 bits; a similarity that is the threshold but for rounding reaches it.
CLOSE = THRESHOLD - 1e-6
BANDS, ROWS = 12, 4
PROFILE = 64
SMALL = 64
#: Documents, and shingles of them, in a block.
BLOCK, BLOCK_SHINGLES = 512, 1_000_000
SLICE = 1 << 20
#: Least and most signs of text for which there is a range of hashes, and a chunk of texts.
LEAST, MOST = 1 << 24, 1 << 27
HELD = 2_000_000
BROADCAST_KEYS = 250_000
U = np.uint64
SPACES = re.compile(rb"[\x20\x09-\x0D]")
Cut = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray, np.ndarray]]  # texts to (document, hash, times), by document and hash


def tables() -> dict[str, np.ndarray]:
    """Fixed random numbers: of bytes and places for hashing, and of the sampling, from one seed. Made once in a process."""
    made = sys.__dict__.get("_marlstone_tables")
    if made:
        return made
    rng = np.random.Generator(np.random.PCG64(20240229))
    odd = lambda n: rng.integers(0, 2**63, n, dtype="u8") * U(2) + U(1)
    n = 1 << 16
    r, c = rng.gamma(2, 1, n), rng.gamma(2, 1, n)
    out = {"byte": odd(256), "place": odd(WORDS), "step": odd(1), "sample": odd(BANDS * ROWS), "r": r, "lnc": np.log(c), "beta": rng.random(n)}
    plain = np.exp(out["lnc"] + r * out["beta"] - r).astype("f4")  # weight 1: t is 0
    out["plain"] = plain.view("u4").astype("u8") << U(32)
    sys.__dict__["_marlstone_tables"] = out
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64 bits (a bijection)."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def slices(texts: list[str]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of documents of about ``SLICE`` bytes; a longer document is a run of its own."""
    start, held, size = 0, [], 0
    for k, t in enumerate(texts):
        data = t.encode("utf-8", "surrogatepass")
        if held and size + len(data) > SLICE:
            yield start, held
            start, held, size = k, [], 0
        held.append(data)
        size += len(data)
    if held:
        yield start, held


def pieces(data: bytes, words: int = WORDS) -> Iterator[bytes]:
    """A long text in pieces of about ``SLICE`` bytes; each begins with the last ``words - 1`` words of the one before."""
    at, end = 0, SLICE
    while True:
        cut = SPACES.search(data, end)
        if not cut:
            yield data[at:]
            return
        tail = data[at : cut.start()].rsplit(None, words - 1)
        end = cut.start() + SLICE
        if len(tail) == words:  # else the piece has too few words and grows
            yield data[at : cut.start()]
            at += len(tail[0])


def shingles(docs: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every document: (document, hash, times), sorted by document and hash."""
    if len(docs) == 1 and len(docs[0]) > SLICE:
        parts = [few_shingles([x], words) for k, x in enumerate(pieces(docs[0], words)) if not k or len(x.split(None, words)) >= words]
        h, back = np.unique(np.concatenate([x[1] for x in parts]), return_inverse=True)
        times = np.bincount(back, np.concatenate([x[2] for x in parts]), len(h)).astype("i8")
        return np.zeros(len(h), "i8"), h, times
    return few_shingles(docs, words)


def few_shingles(docs: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    t = tables()
    data = np.frombuffer(b" ".join(docs) + b" ", "u1")
    space = (data == 32) | ((data >= 9) & (data <= 13))
    letters = np.flatnonzero(~space)
    if not len(letters):
        return np.zeros(0, "i8"), np.zeros(0, "u8"), np.zeros(0, "i8")
    first = np.ones(len(letters), bool)
    first[1:] = np.diff(letters) > 1
    at = np.flatnonzero(first)
    sizes = np.diff(np.append(at, len(letters)))
    place = np.arange(len(letters)) - np.repeat(at, sizes)
    power = np.cumprod(np.full(int(sizes.max()), t["step"][0], "u8"))
    word = mix(np.add.reduceat(t["byte"][data[letters]] * power[place], at))
    ends = np.cumsum([len(d) + 1 for d in docs])
    owner = np.searchsorted(ends, letters[at], side="right")
    n = np.bincount(owner, minlength=len(docs))
    hashes, owners = [], []
    if len(word) >= words:
        m = len(word) - words + 1
        total = np.zeros(m, "u8")
        for k in range(words):
            total += word[k : k + m] * t["place"][k]
        whole = owner[:m] == owner[words - 1 :]
        hashes.append(mix(total[whole]))
        owners.append(owner[:m][whole])
    begins = np.concatenate([[0], np.cumsum(n)[:-1]])
    short = np.flatnonzero((n > 0) & (n < words))
    if len(short):
        few = [int((word[begins[d] : begins[d] + n[d]] * t["place"][: n[d]]).sum(dtype="u8")) for d in short]
        hashes.append(mix(np.array(few, "u8") + n[short].astype("u8")))
        owners.append(short)
    h, d = np.concatenate(hashes), np.concatenate(owners)
    if len(short) and len(hashes) > 1:
        order = np.argsort(d, kind="stable")
        h, d = h[order], d[order]
    cuts = np.flatnonzero(np.diff(d)) + 1
    for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(h)], strict=True):
        h[low:high].sort()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    spots = np.flatnonzero(new)
    return d[spots], h[spots], np.diff(np.append(spots, len(h)))


def log_weights(times: np.ndarray, df: np.ndarray, n: int) -> np.ndarray:
    """ln of the weights; 0 for a shingle that occurs once, in one text only."""
    out = np.zeros(len(times))
    many, common = times > 1, df > 1
    out[many] = np.log1p(np.log(times[many]))
    if n > 1:
        out[common] += np.log1p(-np.square(np.log(df[common]) / math.log(n)) / 2)
    return out


def sample(owner: np.ndarray, h: np.ndarray, lnw: np.ndarray, n: int) -> np.ndarray:
    """(documents, samples) 32-bit marks of the consistent weighted samples of ``n`` documents; all 0 without words.

    For weight w: t = floor(ln w / r + beta), ln y = r (t - beta), and the
    shingle with the least a = c / (y exp(r)) is the sample, marked by (a,
    shingle, t). The random numbers of a shingle are drawn from a table by its hash.
    """
    t = tables()
    out = np.zeros((n, BANDS * ROWS), "u4")
    if not len(h):
        return out
    odd = np.flatnonzero(lnw != 0)
    begins = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    have = owner[begins]
    mark = ((h >> U(32)) & U(0xFFFFFF)) << U(8)
    for k in range(BANDS * ROWS):
        spot = (h * t["sample"][k]) >> U(48)
        key = t["plain"][spot] | mark
        if len(odd):
            s = spot[odd]
            r, beta = t["r"][s], t["beta"][s]
            step = np.floor(lnw[odd] / r + beta)
            a = np.exp(t["lnc"][s] - r * (step - beta) - r).astype("f4")
            key[odd] = (a.view("u4").astype("u8") << U(32)) | mark[odd] | (step.astype("i8") & 0xFF).astype("u8")
        least = mix(np.minimum.reduceat(key, begins))
        out[have, k] = (least >> U(32)).astype("u4") | U(1).astype("u4")
    return out


def ranges_of(h: np.ndarray, times: np.ndarray, bits: int) -> Iterator[tuple[int, bytes, bytes, bytes, bytes]]:
    """Sorted hashes by the ranges of their first ``bits``: range, first 16 bits that occur, how often, the other 48 of each hash, times."""
    part = (h >> U(64 - bits)).astype("i8") if bits else np.zeros(len(h), "i8")
    cuts = np.flatnonzero(np.diff(part, prepend=-1))
    for low, high in zip(cuts, [*cuts[1:], len(h)], strict=True):
        some = h[low:high]
        first, often = np.unique((some >> U(48)).astype("u2"), return_counts=True)
        rest = some.astype("<u8").view("u1").reshape(-1, 8)[:, :6]
        yield int(part[low]), first.tobytes(), often.astype("u4").tobytes(), rest.tobytes(), times[low:high].astype("u4").tobytes()


def hashes_of(first: bytes, often: bytes, rest: bytes) -> np.ndarray:
    """The sorted hashes of one row of ``ranges_of``."""
    out = np.zeros((len(rest) // 6, 8), "u1")
    out[:, :6] = np.frombuffer(rest, "u1").reshape(-1, 6)
    top = np.repeat(np.frombuffer(first, "u2"), np.frombuffer(often, "u4"))
    return out.reshape(-1).view("<u8") | top.astype("u8") << U(48)


def frequencies(texts: DataFrame, bits: int, cut: Cut = shingles) -> DataFrame:
    """chunk, hs, ns: hashes of a chunk that two texts or more of all have, with their document frequencies; several rows a chunk."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[np.ndarray]] = {}
        size = 0

        def rows() -> pd.DataFrame:
            out = []
            for chunk, parts in held.items():
                h, times = np.unique(np.concatenate(parts), return_counts=True)
                out += [(r[0], chunk, *r[1:]) for r in ranges_of(h, times, bits)]
            return pd.DataFrame(out, columns=["part", "chunk", "first", "often", "rest", "times"])

        for batch in batches:
            for chunk, some in batch.groupby("chunk")["t"]:
                for _, docs in slices(some.tolist()):
                    _, h, _ = cut(docs)
                    held.setdefault(chunk, []).append(h)
                    size += len(h)
            if size > HELD:
                yield rows()
                held, size = {}, 0
        if size:
            yield rows()

    def add(group: pd.DataFrame) -> pd.DataFrame:
        parts = [hashes_of(*x) for x in zip(group["first"], group["often"], group["rest"], strict=True)]
        h, back = np.unique(np.concatenate(parts), return_inverse=True)
        n = np.bincount(back, np.concatenate([np.frombuffer(x, "u4") for x in group["times"]])).astype("u4")
        out, at = [], 0
        for chunk, part in zip(group["chunk"], parts, strict=True):
            own = n[back[at : at + len(part)]]
            at += len(part)
            again = own > 1
            if again.any():
                out.append((chunk, part[again].tobytes(), own[again].tobytes()))
        return pd.DataFrame(out, columns=["chunk", "hs", "ns"])

    sent = texts.select("chunk", "t").mapInPandas(send, "part long, chunk long, first binary, often binary, rest binary, times binary")
    return sent.groupBy("part").applyInPandas(add, "chunk long, hs binary, ns binary")


def counted(texts: DataFrame, light: DataFrame, work: Callable[[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray], list[tuple]], schema: str, cut: Cut = shingles) -> DataFrame:
    """``work`` (documents, owner, hash, times, document frequency) of runs of texts: a row (key, ...) for each.

    Chunks come one after another, the counts of each before its texts, so a
    task holds the counts of one chunk and one run of texts.
    """
    none = lambda kind: F.lit(None).cast(kind)
    both = light.select("chunk", F.lit(0).alias("kind"), none("binary").alias("key"), none("string").alias("t"), "hs", "ns")
    both = both.unionByName(texts.select("chunk", F.lit(1).alias("kind"), "key", "t", none("binary").alias("hs"), none("binary").alias("ns")))
    names = [x.split()[0] for x in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, told, known = None, [], None
        for batch in batches:
            out: list[tuple] = []
            for (chunk, kind), rows in batch.groupby(["chunk", "kind"]):
                if chunk != now:
                    now, told, known = chunk, [], None
                if not kind:
                    told += [(np.frombuffer(h, "<u8"), np.frombuffer(k, "u4")) for h, k in zip(rows["hs"], rows["ns"], strict=True)]
                    continue
                if known is None:
                    h, at = np.unique(np.concatenate([np.zeros(0, "u8"), *[x[0] for x in told]]), return_index=True)
                    known, told = (h, np.concatenate([np.zeros(0, "u4"), *[x[1] for x in told]])[at]), []
                keys = rows["key"].tolist()
                for first, docs in slices(rows["t"].tolist()):
                    owner, h, times = cut(docs)
                    df = np.ones(len(h), "u4")
                    if len(known[0]):
                        spot = np.minimum(np.searchsorted(known[0], h), len(known[0]) - 1)
                        df = np.where(known[0][spot] == h, known[1][spot], df)
                    made = work(len(docs), owner, h, times, df)
                    out += [(k, *x) for k, x in zip(keys[first : first + len(docs)], made, strict=True)]
            yield pd.DataFrame(out, columns=names)

    return both.repartition("chunk").sortWithinPartitions("chunk", "kind").mapInPandas(run, schema)


def profiles(owner: np.ndarray, h: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    """(documents, PROFILE) sums of the weights of each class of shingles."""
    place = owner * PROFILE + (h >> U(32)).astype("i8") % PROFILE
    return np.bincount(place, w, n * PROFILE).reshape(n, PROFILE).astype("f4")


def signatures(texts: DataFrame, light: DataFrame, n: int) -> DataFrame:
    """key, sig (4 bytes a sample, null without words), profile and shingles (their number) of every text."""

    def sign(docs: int, owner: np.ndarray, h: np.ndarray, times: np.ndarray, df: np.ndarray) -> list[tuple]:
        lnw = log_weights(times, df, n)
        marks, sums, size = sample(owner, h, lnw, docs), profiles(owner, h, np.exp(lnw), docs), np.bincount(owner, minlength=docs)
        return [(m.tobytes() if m[0] else None, p.tobytes(), int(k)) for m, p, k in zip(marks, sums, size, strict=True)]

    return counted(texts, light, sign, "key binary, sig binary, profile binary, shingles long")


def vectors(texts: DataFrame, light: DataFrame, n: int) -> DataFrame:
    """key, h, w: sorted hashes (8 bytes) and weights (4 bytes) of every text."""

    def make(docs: int, owner: np.ndarray, h: np.ndarray, times: np.ndarray, df: np.ndarray) -> list[tuple]:
        cuts, w = np.searchsorted(owner, np.arange(docs + 1)), np.exp(log_weights(times, df, n)).astype("f4")
        return [(h[a:b].tobytes(), w[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    return counted(texts, light, make, "key binary, h binary, w binary")


def able(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether documents with these profiles (broadcast against each other) can reach ``THRESHOLD``."""
    low, high = np.minimum(a, b).sum(-1), np.maximum(a, b).sum(-1)
    return low * (1 + 1e-4) >= THRESHOLD * high


def promising(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """Pairs (a, b) that their profiles do not rule out."""

    @F.pandas_udf("boolean")
    def can(a: pd.Series, b: pd.Series) -> pd.Series:
        left, right = (np.frombuffer(b"".join(x), "f4").reshape(-1, PROFILE) for x in (a, b))
        return pd.Series(able(left, right))

    both = pairs.join(sigs.select(F.col("key").alias("a"), F.col("profile").alias("pa")), "a").join(sigs.select(F.col("key").alias("b"), F.col("profile").alias("pb")), "b")
    return both.where(can("pa", "pb")).select("a", "b")


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = np.minimum(a[1][i], b[1][j]).sum(dtype="f8")
    whole = a[1].sum(dtype="f8") + b[1].sum(dtype="f8") - common
    return float(common / whole) if whole else 0.0


def verified(pairs: DataFrame, vecs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose weighted Jaccard similarity reaches ``THRESHOLD``."""

    @F.pandas_udf("boolean")
    def close(ha: pd.Series, wa: pd.Series, hb: pd.Series, wb: pd.Series) -> pd.Series:
        of = lambda h, w: (np.frombuffer(h, "u8"), np.frombuffer(w, "f4"))
        return pd.Series([weighted_jaccard(of(a, b), of(c, d)) >= CLOSE for a, b, c, d in zip(ha, wa, hb, wb, strict=True)])

    both = pairs
    for side in "ab":
        both = both.join(vecs.select(F.col("key").alias(side), F.col("h").alias(f"h{side}"), F.col("w").alias(f"w{side}")), side)
    return both.where(close("ha", "wa", "hb", "wb")).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """node, label (least node of its component) for every node of the links, as a written table.

    Each step takes the least label among neighbours, then the label of the
    label; it ends when nothing changes. Nothing but a count reaches the driver.
    """
    edges = materialize(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")).distinct(), "dedup-edges")
    labels = materialize(edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")), "dedup-labels")
    while True:
        near = edges.join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("label").alias("m"))
        lower = labels.join(near, F.col("node") == F.col("u")).select("node", F.least("label", "m").alias("to"), "label")
        lower = materialize(lower, "dedup-labels")
        jump = lower.join(lower.select(F.col("node").alias("n2"), F.col("to").alias("further")), F.col("to") == F.col("n2"))
        after = materialize(jump.select("node", F.least("to", "further").alias("label"), (F.least("to", "further") != F.col("label")).alias("changed")), "dedup-labels")
        moved = after.where("changed").limit(1).count()
        discard(labels)
        discard(lower)
        labels = after
        if not moved:
            discard(edges)
            return labels


def buckets(sigs: DataFrame) -> DataFrame:
    """(bucket, key, shingles): one row for each band of each signature."""
    band = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring(F.col("sig"), i * (4 * ROWS) + 1, F.lit(4 * ROWS))))
    return sigs.where("sig is not null").select(F.explode(band).alias("bucket"), "key", "shingles")


def open_buckets(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, key, label, shingles, size, giant, inner, outer) of buckets in several components.

    ``giant`` is the label of the most members; ``inner`` and ``outer`` are the
    numbers of blocks for its members and for the others.
    """
    own = labels.select(F.col("node").alias("key"), F.col("label").alias("__l"))
    rows = materialize(members.join(own, "key", "left").select("bucket", "key", "shingles", F.coalesce("__l", "key").alias("label")), "dedup-members")
    parts = rows.groupBy("bucket", "label").agg(F.count("*").alias("n"), F.sum("shingles").alias("s"))
    mixed = parts.groupBy("bucket").agg(F.sum("n").alias("size"), F.sum("s").alias("whole"), F.max(F.struct("n", "label", "s")).alias("top"), F.count("*").alias("kinds")).where("kinds > 1")
    blocks = lambda n, s: F.greatest(F.ceil(n / BLOCK), F.ceil(s / BLOCK_SHINGLES))
    inner, outer = blocks(F.col("top.n"), F.col("top.s")), blocks(F.col("size") - F.col("top.n"), F.col("whole") - F.col("top.s"))
    mixed = materialize(mixed.select("bucket", "size", F.col("top.label").alias("giant"), inner.alias("inner"), outer.alias("outer")), "dedup-open")
    return materialize(rows.join(mixed, "bucket"), "dedup-left")


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def star_pairs(members: DataFrame) -> DataFrame:
    """Each member with the leader of its bucket: linear in the members."""
    leaders = materialize(members.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("key").alias("h"), "key")).alias("m")).select("bucket", F.col("m.key").alias("a")), "dedup-leaders")
    return ordered(members.join(leaders, "bucket").where("key != a").select("a", F.col("key").alias("b")))


def small_pairs(left: DataFrame) -> DataFrame:
    """All pairs of different components in buckets of at most ``SMALL`` members."""
    some = left.where(F.col("size") <= SMALL).select("bucket", "key", "label")
    other = some.select("bucket", F.col("key").alias("b"), F.col("label").alias("lb"))
    return ordered(some.withColumnRenamed("key", "a").join(other, "bucket").where("label < lb").select("a", "b"))


def partners(p: np.ndarray, side: np.ndarray, label: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of the first side, the rows of the second with another label that their profiles do not rule out.

    ``side`` is 0 or 1; if all rows are of one side, each is compared with those behind it.
    """
    left, right = np.flatnonzero(side == side.min()), np.flatnonzero(side == side.max())
    one = side.min() == side.max()
    for k, i in enumerate(left):
        others = right[k + 1 :] if one else right
        others = others[label[others] != label[i]]
        if len(others):
            yield i, others[able(p[i], p[others])]


def close_pairs(vecs: list[tuple[np.ndarray, np.ndarray]], side: np.ndarray, label: np.ndarray) -> list[tuple[int, int]]:
    """Links between the two sides that join documents with different labels and reach ``THRESHOLD``.

    A pair that the links found before have joined already is not looked at.
    """
    n = len(vecs)
    owner = np.repeat(np.arange(n), [len(v[0]) for v in vecs])
    p = profiles(owner, np.concatenate([v[0] for v in vecs]), np.concatenate([v[1] for v in vecs]), n)
    root = list(range(int(label.max()) + 1))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    out = []
    for i, others in partners(p, side, label):
        for j in others.tolist():
            x, y = find(label[i]), find(label[j])
            if x != y and weighted_jaccard(vecs[i], vecs[j]) >= CLOSE:
                root[x] = y
                out.append((i, j))
    return out


def block_links(left: DataFrame, sigs: DataFrame, vecs: DataFrame) -> DataFrame:
    """Verified links between different components in buckets of more than ``SMALL`` members.

    The giant component of a bucket is cut into blocks 0..inner-1, the others
    into inner..inner+outer-1; each task compares two blocks of which one at
    least is of the others, first by profiles, then, where those leave partners,
    by vectors. A block holds about ``BLOCK`` documents and ``BLOCK_SHINGLES``
    shingles, whatever the bucket's size.
    """
    g, s = F.col("inner"), F.col("outer")
    inside = F.col("label") == F.col("giant")
    block = F.when(inside, F.pmod(F.xxhash64("key"), g)).otherwise(g + F.pmod(F.xxhash64("key"), s))
    others = F.sequence(F.when(inside, g).otherwise(F.lit(0)), g + s - 1)
    rows = left.where(F.col("size") > SMALL).select("bucket", "key", "label", block.alias("block"), F.explode(others).alias("other"))
    rows = rows.select("bucket", "key", "label", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))

    def hopeful(group: pd.DataFrame) -> pd.DataFrame:
        """The members with a partner."""
        p = np.frombuffer(b"".join(group["profile"]), "f4").reshape(-1, PROFILE)
        found = np.zeros(len(group), bool)
        for i, others in partners(p, group["block"].to_numpy(), pd.factorize(group["label"])[0]):
            found[others] = True
            found[i] |= len(others) > 0
        return group[found].drop(columns="profile")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        vecs = [(np.frombuffer(h, "u8"), np.frombuffer(w, "f4")) for h, w in zip(group["h"], group["w"], strict=True)]
        found = close_pairs(vecs, group["block"].to_numpy(), pd.factorize(group["label"])[0])
        key = group["key"].tolist()
        return pd.DataFrame([tuple(sorted((bytes(key[i]), bytes(key[j])))) for i, j in found], columns=["a", "b"])

    cells = ["bucket", "x", "y"]
    some = rows.join(sigs.select("key", "profile"), "key").groupBy(*cells).applyInPandas(hopeful, "key binary, bucket long, label binary, block long, x long, y long")
    some = materialize(some, "dedup-hopeful")
    return some.join(vecs, "key").groupBy(*cells).applyInPandas(compare, "a binary, b binary").distinct()


def share_of(signs: int) -> int:
    """Signs of text in a chunk, and in a range of hashes."""
    return min(MOST, max(LEAST, 512 * math.isqrt(signs)))


def distinct_texts(docs: DataFrame, text: str, cut: Cut = shingles) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """The written distinct texts; the same as key, t, chunk; frequencies of their shingles; how many texts there are.

    Equal texts meet in one row before the shuffle; a chunk is what one task
    writes, or a part of it chosen by the key.
    """
    written = docs.select(content_key(text).alias("key"), text_of(text).alias("t")).groupBy("key").agg(F.first("t").alias("t"))
    written = materialize(written.select("key", "t", F.length("t").alias("signs"), F.spark_partition_id().alias("task")), "dedup-texts")
    size = written.agg(F.count("*").alias("n"), F.coalesce(F.sum("signs"), F.lit(0)).alias("signs"), F.count_distinct("task").alias("tasks")).first()
    share = share_of(size["signs"])
    split = max(1, math.ceil(size["signs"] / max(1, size["tasks"]) / share))
    texts = written.select("key", "t", (F.col("task").cast("long") * split + F.pmod(F.hash("key"), F.lit(split))).alias("chunk"))
    light = materialize(frequencies(texts, math.ceil(math.log2(max(1, size["signs"] / share))), cut), "dedup-frequencies")
    return written, texts, light, size["n"]


def _classes(rows: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    spark = docs.sparkSession
    small_batches(spark)
    written, texts, light, n = distinct_texts(docs, text)
    release(spark)
    sigs = materialize(signatures(texts, light, n), "dedup-signatures")
    release(spark)
    shared = materialize(buckets(sigs).groupBy("bucket").agg(F.min("key").alias("x"), F.max("key").alias("y")).where("x != y").select("bucket"), "dedup-buckets")
    members = materialize(buckets(sigs).join(shared, "bucket", "left_semi"), "dedup-members")
    needed = materialize(members.select("key").distinct(), "dedup-needed")
    if needed.count() <= BROADCAST_KEYS:
        needed = F.broadcast(needed)  # its size was just counted
    vecs = materialize(vectors(texts.join(needed, "key", "left_semi"), light, n), "dedup-vectors")
    discard(written)
    discard(light)

    def checked(pairs: DataFrame) -> DataFrame:
        return materialize(verified(materialize(promising(materialize(pairs, "dedup-pairs"), sigs), "dedup-promising"), vecs), "dedup-links")

    first = checked(star_pairs(members))
    labels = components(first)
    left = open_buckets(members, labels)
    more = checked(small_pairs(left)).union(materialize(block_links(left, sigs, vecs), "dedup-links"))
    if more.limit(1).count():
        labels = components(first.union(more))
    release(spark)
    contents = rows.groupBy("key").agg(F.sum("m").alias("n"), F.min("id").alias("id"))
    contents = contents.join(labels.select(F.col("node").alias("key"), "label"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    contents = materialize(contents, "dedup-contents")
    whole = materialize(contents.groupBy("label").agg(F.sum("n").alias("class_size"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("m")), "dedup-classes")
    out = contents.join(whole, "label").select(F.col("key").alias("content"), F.col("m.id").alias("class_id"), "class_size", F.col("m.key").alias("first_content"))
    return materialize(out, "dedup-result")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Two written tables: the classes, and the rows of ``docs`` in short.

    The classes have content (16 bytes), class_id, class_size, first_content of
    every distinct text: ``class_id`` is the least key of the class,
    ``first_content`` the content of that document. The rows have id, key
    (content), part and m: so many equal rows of that part of the input.
    """
    with scratch() as keep:
        rows = docs.select(F.col(f"`{key}`").alias("id"), content_key(text).alias("key"), F.spark_partition_id().alias("part"))
        rows = keep(materialize(rows.groupBy("id", "key", "part").agg(F.count("*").alias("m")), "dedup-rows"))
        return keep(_classes(rows, docs, text)), rows


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: key, class_id, class_size, kept (one row of its class, with the least key)."""
    found, rows = classes(docs, key, text)
    is_first = F.col("id").eqNullSafe(F.col("class_id")) & (F.col("key") == F.col("first_content"))
    both = rows.join(found, F.col("key") == F.col("content")).select("id", "class_id", "class_size", "part", "m", "key", is_first.alias("first"))
    # of equal rows, those of the least part hold the one that is kept
    least = both.where("first").groupBy("key").agg(F.min("part").alias("__part")).withColumnRenamed("key", "__key")
    marked = both.join(least, F.col("first") & (F.col("key") == F.col("__key")) & (F.col("part") == F.col("__part")), "left")
    each = marked.select("id", "class_id", "class_size", F.col("__key").isNotNull().alias("one"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))).alias("i"))
    return each.select(F.col("id").alias(key), "class_id", "class_size", (F.col("one") & (F.col("i") == 1)).alias("kept"))


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` for each class, with its own columns."""
    found, _ = classes(docs, key, text)
    first = found.where(F.col("content") == F.col("first_content")).select(F.col("content").alias("__content"), F.col("class_id").alias("__id"))
    names = [f"__c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    own, body = names[docs.columns.index(key)], names[docs.columns.index(text)]
    mine = plain.withColumn("__key", content_key(body)).join(first, (F.col("__key") == F.col("__content")) & F.col(own).eqNullSafe(F.col("__id")), "left_semi")
    return mine.dropDuplicates(["__key", own]).select(*names).toDF(*docs.columns)
