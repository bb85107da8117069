"""Phrase collocations by level-wise Apriori passes.

1. Pass k counts phrases of k words by language. From the second pass on, the
   frequent phrases of k-1 words are broadcast, and a phrase is emitted only
   when both its overlapping parts of k-1 words are among them. Counts of a part
   are never below those of the whole, so no frequent phrase is lost.
2. What is broadcast is a table of bits, set at the hashes of the frequent
   phrases: ``SHARE`` bits for each, ``MOST_BITS`` (64 MB) in all. More phrases
   than that let some infrequent ones through the filter, which are counted and
   dropped like any other; results are the same at every size.
3. Tasks count what a window of text repeats before it is shuffled, so a hot
   phrase is one row a window. Counts of all levels are written tables; the
   scores of all cuts are joins with them.

Words are counted exactly: phrases are shuffled as texts, hashes only find
repeats within a window of ``WINDOW`` bytes.

Defined results: a null or empty text has no words, a null language is ``und``
and shares its counts; repeated rows count each time; equal scores and counts
go by the phrase's bytes; texts longer than ``WINDOW`` are read in windows that
lose and repeat no phrase; an empty table gives an empty table; other columns,
whatever their names, are ignored. All counts cover all rows: there is no limit
but ``top`` rows for each language in the report.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import discard, materialize, scratch, small_batches, text_of
from marlstone.llm.word_bytes import LOWER, U, cut_out, joined, mix, run_hashes, runs, table_of, word_hashes
from marlstone.operators.ordering import running

# What ends a piece of text, and what stands between its words.
BREAK, BLANK = table_of(b".,;:!?\n\x0b\x0c\r"), table_of(b" \t")
WINDOW = 1 << 20
#: Candidates in a range of the order that ranks them.
RANKED = 20_000
SHARE, LEAST_BITS, MOST_BITS, SLICE_BITS = 32, 16, 29, 22


def windows(data: np.ndarray, n: int, size: int = WINDOW) -> Iterator[tuple[int, np.ndarray]]:
    """Parts of about ``size`` bytes and their offsets, in which every run of ``n`` words of a piece is once.

    They are cut at ends of pieces; in a piece longer than ``size`` at a blank,
    and then the next part repeats the last n - 1 words.
    """
    at, wide = 0, size
    while at + wide < len(data):
        part = data[at : at + wide]
        ends = np.flatnonzero(BREAK[part])
        if len(ends):
            yield at, part[: ends[-1] + 1]
            at, wide = at + int(ends[-1]) + 1, size
            continue
        first, last = runs(~BLANK[part])
        if len(first) > n:  # the last word may go on
            yield at, part[: last[-2]]
            at, wide = at + int(first[-n]), size
        else:
            wide *= 2
    yield at, data[at:]


def phrases(part: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-case part with single blanks, the words' begins and ends in it, their hashes, first places in ``part``, and where runs of ``n`` words begin."""
    low = LOWER[part]
    blank = BLANK[low]
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    place = np.flatnonzero(keep).astype("i4")
    low = np.where(blank, np.uint8(32), low)[place]
    end = BREAK[low]
    first, last = runs(~(end | (low == 32)))
    piece = np.searchsorted(np.flatnonzero(end), first)
    m = max(0, len(first) - n + 1)
    return low, first, last, word_hashes(low, first, last), place[first], np.flatnonzero(piece[:m] == piece[n - 1 :][:m])


def language_hash(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def found(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the table of bits is set at these hashes."""
    at = h >> U(64 - int(math.log2(len(bits) * 8)))
    return (bits[at >> U(3)] >> (at & U(7)).astype("u1")) & 1 > 0


def count_level(docs: DataFrame, n: int, known: Broadcast | None) -> DataFrame:
    """lang, phrase, a: occurrences of the phrases of ``n`` words whose parts of n - 1 words are ``known``."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if known is None else np.frombuffer(known.value, "u1")
        for batch in batches:
            texts = batch.column(0).cast(pa.binary()).to_pylist()
            codes = batch.column(1).dictionary_encode()
            langs, code = codes.dictionary, codes.indices.to_numpy(zero_copy_only=False)
            salt = np.array([language_hash(x) for x in langs.to_pylist()], "u8")
            data, ends = joined(texts)
            for at, part in windows(data, n):
                low, first, last, words, place, begins = phrases(part, n)
                own = code[np.searchsorted(ends, place + at, side="right")]
                if bits is not None and len(begins):
                    parts = found(bits, mix(run_hashes(words, n - 1) + salt[own[: max(0, len(words) - n + 2)]]))
                    begins = begins[parts[begins] & parts[begins + 1]]
                if not len(begins):
                    continue
                h = mix(run_hashes(words, n)[begins] + salt[own[begins]])
                _, once, times = np.unique(h, return_index=True, return_counts=True)
                once = begins[once]
                said, offsets = cut_out(low, first[once], last[once + n - 1])
                text = pa.StringArray.from_buffers(len(once), pa.py_buffer(offsets), pa.py_buffer(said))
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(own[once])), text, pa.array(times.astype("i8"))], names=["lang", "phrase", "n"])

    emitted = docs.select("t", "lang").mapInArrow(emit, "lang string, phrase string, n long")
    return emitted.groupBy("lang", "phrase").agg(F.sum("n").alias("a"))


def filter_bits(frequent: DataFrame, n: int) -> Broadcast:
    """The table of bits of these phrases of ``n`` words, put together from slices that tasks have made; its size is bounded."""
    spark = frequent.sparkSession
    power = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(SHARE * max(1, frequent.count())))))
    inner = min(power, SLICE_BITS)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            data, _ = joined(batch.column(1).cast(pa.binary()).to_pylist())
            first, last = runs(~(BLANK | BREAK)[data])
            h = run_hashes(word_hashes(data, first, last), n)[::n]
            salt = np.array([language_hash(x) for x in batch.column(0).to_pylist()], "u8")
            at = np.unique(mix(h + salt) >> U(64 - power))
            part = (at >> U(inner)).astype("i8")
            cuts = np.flatnonzero(np.diff(part, prepend=-1))
            inside = (at & U((1 << inner) - 1)).astype("<u4")
            rows = [inside[a:b].tobytes() for a, b in zip(cuts, [*cuts, len(at)][1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(part[cuts], pa.int64()), pa.array(rows, pa.binary())], names=["slice", "at"])

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        on = np.zeros(1 << inner, bool)
        for at in group["at"]:
            on[np.frombuffer(at, "<u4")] = True
        return pd.DataFrame({"slice": [group["slice"].iloc[0]], "bits": [np.packbits(on, bitorder="little").tobytes()]})

    marked = frequent.select("lang", "phrase").mapInArrow(mark, "slice long, at binary")
    out = np.zeros((1 << power) // 8, "u1")
    wide = (1 << inner) // 8
    for r in marked.groupBy("slice").applyInPandas(merge, "slice long, bits binary").toLocalIterator():
        out[r["slice"] * wide : (r["slice"] + 1) * wide] = np.frombuffer(r["bits"], "u1")
    return spark.sparkContext.broadcast(out.tobytes())


def levels(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = 3, least: int = 10) -> tuple[DataFrame, list[DataFrame]]:
    """lang, n (all words of a language), and for each length a written table lang, phrase, a of the phrases with ``a`` of ``least`` or more."""
    small_batches(docs.sparkSession)
    texts = docs.select(text_of(F.col(f"`{text}`")).alias("t"), F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"))
    words = materialize(count_level(texts, 1, None), "phrases-words")
    whole = materialize(words.groupBy("lang").agg(F.sum("a").alias("n")), "phrases-sizes")
    out = [materialize(words.where(F.col("a") >= least), "phrases-1")]
    discard(words)
    for n in range(2, longest + 1):
        known = filter_bits(out[-1], n - 1)
        out.append(materialize(count_level(texts, n, known).where(F.col("a") >= least), f"phrases-{n}"))
        known.destroy()
    return whole, out


def uncovered(tables: list[DataFrame], cover: int) -> DataFrame:
    """lang, phrase, a, size of all phrases of two words or more that no longer one with ``cover`` percent of their count contains."""
    every = None
    for n, t in enumerate(tables[1:], 2):
        own = t.withColumn("size", F.lit(n))
        every = own if every is None else every.union(own)
    word = F.split("phrase", " ")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda i: F.array_join(F.slice(word, i, n), " "))))
    inside = every.where("size > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), F.col("a").alias("f"))
    above = inside.groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    left = every.join(above, ["lang", "phrase"], "left")
    return left.where(F.col("f").isNull() | (F.col("f") * 100 < F.col("a") * cover)).select("lang", "phrase", "a", "size")


def scored(candidates: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """Adds l, r, score of the cut with the least score (the first of equal ones); exact in 38 digits."""
    parts = tables[0]
    for t in tables[1:-1]:
        parts = parts.union(t)
    word, k = F.split("phrase", " "), F.col("k")
    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.array_join(F.slice(word, 1, k), " "), "right": F.array_join(F.slice(word, k + 1, F.col("size") - k), " ")})
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(parts.select("lang", F.col("phrase").alias(side), F.col("a").alias(name)), ["lang", side])
    big = lambda c: F.col(c).cast("decimal(18,0)")
    cuts = cuts.withColumns({"up": F.lit(1_000_000).cast("decimal(7,0)") * big("a") * big("a"), "down": big("l") * big("r")})
    score = F.expr("up div down")
    return cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = 3, least: int = 10, cover: int = 50, top: int = 2000) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    with scratch() as keep:
        whole, tables = levels(docs, text, lang, longest, least)
        keep(whole)
        every = keep(materialize(scored(uncovered(tables, cover), tables), "phrases-scored"))
    # by language: score and count falling, then the phrase
    ranked = running(every.withColumn("less", -F.col("a")), "score", {}, ["less", "phrase"], descending=True, range_rows=RANKED, by=["lang"]).withColumnRenamed("__row", "rank").where(F.col("rank") <= top)
    return ranked.join(whole, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
