"""Target-distribution importance resampling over bucket-partitioned inverted postings.

1. Blocks of documents are turned into postings (bucket, document, count) of
   their hashed features, runs of one to ``LONGEST`` words. The postings of a
   block are cut into ``PARTS`` ranges of buckets and packed, one row for each
   (part, block); the blocks are a written table.
2. Counts of every bucket are added up in the tasks and then by bucket: at most
   ``BUCKETS`` rows leave a task.
3. Postings are shuffled by (part, salt) and co-grouped with the counts of both
   corpora in that part. Each group computes the gains of its buckets and
   answers every block with its documents' sums. Salts keep a group at about
   ``GROUP_BYTES``, so that a bucket that all documents share is spread as well.
4. Sums are added by block, which gives each document its weight. Noise that
   follows from the id makes the draw reproducible, and a global order over
   ranges gives the ranks.

Defined results: a null or empty text has no features, weight 0; a null id
draws with the noise of an empty one and comes first among equal scores; every
row is a document, repeated rows as well, ties beyond the id are equal rows;
texts longer than ``WINDOW`` are read in windows that lose and repeat no
feature; an empty table gives an empty table, an empty target gain by counts of
0; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import materialize, scratch, small_batches, text_of
from marlstone.llm.word_bytes import LOWER, joined, runs
from marlstone.operators.ordering import running

# The buckets, and the signs of words (digits, a to z, all beyond ASCII).
BUCKETS = 10_000
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True
PARTS = 16
WINDOW = 4 << 20
GROUP_BYTES = 8 << 20
#: Documents in a range of the order that ranks them.
RANKED = 20_000
#: Bytes of a word whose checksum is made for all words at once.
SHORT = 64


def crc_tables() -> tuple[np.ndarray, np.ndarray]:
    """The CRC-32 of single bytes, and for n = 0..SHORT and each byte of a checksum what n more bytes make of it."""
    one = np.arange(256, dtype="u4")
    for _ in range(8):
        one = np.where(one & 1, one >> np.uint32(1) ^ np.uint32(0xEDB88320), one >> np.uint32(1))  # the polynomial, reflected
    shift = np.zeros((SHORT + 1, 4, 256), "u4")
    for k in range(4):
        shift[0, k] = np.arange(256, dtype="u4") << np.uint32(8 * k)
    for n in range(SHORT):
        shift[n + 1] = one[shift[n] & np.uint32(255)] ^ shift[n] >> np.uint32(8)
    return one, shift


def word_crcs(data: np.ndarray, first: np.ndarray, last: np.ndarray, one: np.ndarray) -> np.ndarray:
    """The CRC-32 of every word."""
    size = last - first
    order = np.argsort(-size, kind="stable")
    begin, sizes = first[order], size[order]
    crc = np.full(len(first), 0xFFFFFFFF, "u4")
    for k in range(min(SHORT, int(size.max(initial=0)))):
        n = int(np.searchsorted(-sizes, -k, side="left"))  # words longer than k
        crc[:n] = one[(crc[:n] ^ data[begin[:n] + k]) & np.uint32(255)] ^ crc[:n] >> np.uint32(8)
    out = np.empty_like(crc)
    out[order] = ~crc
    for i in np.flatnonzero(size > SHORT):
        out[i] = zlib.crc32(data[first[i] : last[i]].tobytes())
    return out


def features(data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For windows of joined texts: each word's document, and document and checksum of every single word and pair of words."""
    one, shift = crc_tables()
    at, wide, again = 0, WINDOW, 0
    while at < len(data):
        part = LOWER[data[at : at + wide]]
        first, last = runs(WORD[part])
        more = at + wide < len(data)
        if more:  # the last word may go on; the one before it begins the next window
            if len(first) < 3:
                wide *= 2
                continue
            first, last = first[:-1], last[:-1]
        owner = np.searchsorted(ends, first + at, side="right")
        crc = word_crcs(part, first, last, one)
        pair = np.flatnonzero(owner[:-1] == owner[1:])
        left = ~crc[pair]
        left = ~(one[(left ^ np.uint32(32)) & np.uint32(255)] ^ left >> np.uint32(8))  # with a blank
        size = (last - first)[pair + 1]
        step = np.minimum(size, SHORT)
        both = crc[pair + 1].copy()
        for k in range(4):
            both ^= shift[step, k, left >> np.uint32(8 * k) & np.uint32(255)]
        for i in np.flatnonzero(size > SHORT):
            a, b = pair[i], pair[i] + 1
            both[i] = zlib.crc32(part[first[b] : last[b]].tobytes(), int(left[i]))
        yield owner[again:], np.concatenate([owner[again:], owner[pair]]), np.concatenate([crc[again:], both])
        if not more:
            return
        at, wide, again = at + int(first[-1]), WINDOW, 1


def count_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of these texts: words and features of each; bucket, document and count of the postings, by bucket and document."""
    data, ends = joined(texts)
    n = len(texts)
    words, held = np.zeros(n, "i8"), []
    for owner, of, crc in features(data, ends):
        words += np.bincount(owner, minlength=n)
        held.append(np.unique((crc % np.uint32(BUCKETS)).astype("i8") * n + of, return_counts=True))
    keys, back = np.unique(np.concatenate([np.zeros(0, "i8"), *[h[0] for h in held]]), return_inverse=True)
    counts = np.bincount(back, np.concatenate([np.zeros(0), *[h[1] for h in held]]), len(keys)).astype("i8")
    bucket, of = keys // max(n, 1), keys % max(n, 1)
    return words, np.bincount(of, counts, n).astype("i8"), bucket, of, counts


def narrow(x: np.ndarray) -> bytes:
    """Unsigned numbers in as many bytes as the largest needs."""
    kind = next(k for k in ("u1", "u2", "u4", "u8") if not len(x) or int(x.max()) < 2 ** (8 * int(k[1])))
    return x.astype(f"<{kind}").tobytes()


def wide(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // n}" if n else "<u1").astype("i8")


def blocks_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows of two kinds. part -1: a block's ids, words and features. Others: buckets of a part with their numbers of postings, documents and counts."""
    ids = docs.schema[key].dataType

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            n = batch.num_rows
            words, sizes, bucket, of, counts = count_features(batch.column(1).cast(pa.binary()).to_pylist())
            rows = [(block, -1, narrow(words), narrow(sizes), b"", n)]
            part = bucket * PARTS // BUCKETS
            cuts = np.flatnonzero(np.diff(part, prepend=-1))
            for a, b in zip(cuts, [*cuts, len(part)][1:], strict=True):
                low = -(-int(part[a]) * BUCKETS // PARTS)
                rows.append((block, int(part[a]), np.bincount(bucket[a:b] - low).astype("<u4").tobytes(), narrow(of[a:b]), narrow(counts[a:b]), b - a))
            own = pa.ListArray.from_arrays(pa.array([0, *[n] * len(rows)], pa.int32()), batch.column(0))
            columns = [pa.array(c) for c in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([columns[0], columns[1].cast(pa.int32()), own, *[c.cast(pa.binary()) for c in columns[2:5]], columns[5]], names=["block", "part", "ids", "a", "b", "c", "n"])
            block += 1

    schema = f"block long, part int, ids array<{ids.simpleString()}>, a binary, b binary, c binary, n long"
    return docs.select(F.col(f"`{key}`").alias("id"), text_of(F.col(f"`{text}`")).alias("t")).mapInArrow(pack, schema)


def per_bucket(part: int, a: bytes, c: bytes, n: int) -> tuple[int, np.ndarray, np.ndarray]:
    """First bucket of the part, postings of each bucket from there, counts of the postings."""
    return -(-part * BUCKETS // PARTS), np.frombuffer(a, "<u4"), wide(c, n)


def bucket_counts(blocks: DataFrame, name: str) -> DataFrame:
    """bucket and the features of all documents in it."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BUCKETS, "i8")
        for batch in batches:
            for part, a, c, n in zip(batch["part"], batch["a"], batch["c"], batch["n"], strict=True):
                low, times, counts = per_bucket(part, a, c, n)
                total += np.bincount(np.repeat(np.arange(len(times)) + low, times), counts, BUCKETS).astype("i8")
        some = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": some, "n": total[some]})

    return blocks.where("part >= 0").select("part", "a", "c", "n").mapInPandas(add, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias(name))


def gain(s: int, t: int, source: int, target: int) -> int:
    return math.floor(1000 * math.log((t + 1) * (source + BUCKETS) / ((s + 1) * (target + BUCKETS))))


def weights(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """A written table with a row for each document: id, n_words, n_features, weight."""
    small_batches(docs.sparkSession)
    with scratch() as keep:
        blocks = materialize(blocks_of(docs, key, text), "importance-blocks")
        aim = blocks_of(target.select(F.lit(0).alias("id"), F.col(f"`{target_text}`").alias("t")), "id", "t")
        both = bucket_counts(blocks, "s").join(bucket_counts(aim, "t"), "bucket", "full").select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t"))
        both = materialize(both, "importance-counts")  # a row for each bucket at most
        sums = both.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
        source, aimed = sums["s"], sums["t"]
        size = blocks.agg(F.coalesce(F.sum(F.length("b") + F.length("c")), F.lit(0)).alias("n")).first()["n"]
        salts = max(1, math.ceil(size / PARTS / GROUP_BYTES))

        def contribute(posted: pd.DataFrame, counted: pd.DataFrame) -> pd.DataFrame:
            gains = np.zeros(BUCKETS)
            gains[counted["bucket"].to_numpy()] = [gain(s, t, source, aimed) for s, t in zip(counted["s"].tolist(), counted["t"].tolist(), strict=True)]
            rows = []
            for block, part, a, b, c, n in zip(posted["block"], posted["part"], posted["a"], posted["b"], posted["c"], posted["n"], strict=True):
                low, times, counts = per_bucket(part, a, c, n)
                of = wide(b, n)
                rows.append((block, np.bincount(of, np.repeat(gains[low : low + len(times)], times) * counts).astype("<i8").tobytes()))
            return pd.DataFrame(rows, columns=["block", "sums"])

        posted = blocks.where("part >= 0").select("block", "part", "a", "b", "c", "n", F.pmod(F.hash("block"), F.lit(salts)).alias("salt"))
        counted = both.select("bucket", "s", "t", F.expr(f"CAST(bucket * {PARTS} DIV {BUCKETS} AS INT)").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
        answered = posted.groupBy("part", "salt").cogroup(counted.groupBy("part", "salt")).applyInPandas(contribute, "block long, sums binary")

        own = blocks.where("part < 0").select("block", "ids", "a", "b", F.lit(None).cast("binary").alias("sums"), "n")
        none = F.lit(None)
        every = own.unionByName(answered.select("block", none.cast(own.schema["ids"].dataType).alias("ids"), none.cast("binary").alias("a"), none.cast("binary").alias("b"), "sums", none.cast("long").alias("n")))

        def reduce(table: pa.Table) -> pa.Table:
            """The documents of one block."""
            rows = table.to_pylist()
            k = next(i for i, r in enumerate(rows) if r["n"] is not None)
            n = rows[k]["n"]
            total = np.zeros(n, "i8")
            for r in rows:
                if r["sums"] is not None:
                    some = np.frombuffer(r["sums"], "<i8")
                    total[: len(some)] += some
            words, sizes = wide(rows[k]["a"], n), wide(rows[k]["b"], n)
            ids = table.column("ids").combine_chunks().slice(k, 1).flatten()
            return pa.table({"id": ids, "n_words": words, "n_features": sizes, "weight": total // np.maximum(sizes, 1)})

        kind = docs.schema[key].dataType.simpleString()
        out = every.groupBy("block").applyInArrow(reduce, f"id {kind}, n_words long, n_features long, weight long")
        return keep(materialize(out, "importance-weights"))


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: str = "7", key: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """Every document: key, n_features, weight, score, rank (from 1; null where it is not drawn).

    Of the documents with ``least_words`` words or more, ``percent`` in a hundred
    are drawn without replacement, in proportion to exp(weight / 1000).
    """
    weighed = weights(docs, target, key, text, target_text)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = materialize(weighed.select("id", "n_words", "n_features", "weight", (F.col("weight") + noise).alias("score")), "importance-scores")
    long = F.col("n_words") >= least_words
    most = scored.where(long).count() * percent // 100
    ranked = running(scored.where(long), "score", {}, ties=["id"], descending=True, range_rows=RANKED)
    rank = F.when(F.col("__row") <= most, F.col("__row").cast("long")).alias("rank")
    columns = [F.col("id").alias(key), "n_features", "weight", "score"]
    return ranked.select(*columns, rank).unionByName(scored.where(~long).select(*columns, F.lit(None).cast("long").alias("rank")))
