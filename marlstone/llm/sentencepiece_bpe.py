"""SentencePiece BPE with byte fallback, encoded and decoded exactly as the library does.

Merge-type prefix table: every prefix of a text has one valid last token. An
automaton gives all vocabulary pieces that end at a position; such a piece is
the last token if the merges by which it and the last token of what precedes it
came about leave the border between the two alone (pair compatibility). The ids
follow from the end backwards.

No piece has a space sign behind another sign, and signs that occur in no piece
never merge, so a text falls apart into stretches that are encoded on their own
and remembered in a bounded memory of each worker. Runs of several space signs
merge last and from the left, longest piece first.

Work is row-local; the vocabulary (fixed size) is broadcast. Defined results: a
null text is the empty text, which has only the begin and end ids; equal texts
get equal ids; an empty table gives an empty table.
"""

from __future__ import annotations

import codecs
import hashlib
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import ahocorasick
import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import share, shared, small_batches, text_of

SPACE_SIGN = "▁"
REMEMBERED = 400_000


@dataclass
class Vocabulary:
    """Pieces by id, with the merges that make each piece."""

    pieces: list[str]
    normal: list[bool]
    byte: dict[int, int]
    begin: int
    end: int
    unknown: int
    rank: list[int]
    score: list[float]
    split: dict[int, tuple[int, int]] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """Reads the pieces of a model file with the sentencepiece library."""
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        pieces = [m.id_to_piece(i) for i in range(n)]
        byte = {i: int(pieces[i][3:5], 16) for i in range(n) if m.is_byte(i)}
        normal = [not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i)) for i in range(n)]
        order = sorted(range(n), key=lambda i: (-m.get_score(i), i))
        rank = [0] * n
        for k, i in enumerate(order):
            rank[i] = k
        out = cls(pieces, normal, byte, m.bos_id(), m.eos_id(), m.unk_id(), rank, [m.get_score(i) for i in range(n)])
        out.find_splits()
        return out

    def find_splits(self) -> None:
        """The last merge by which plain BPE makes each piece; pieces that it never makes have none."""
        ids = {p: i for i, p in enumerate(self.pieces) if self.normal[i]}
        rank = self.rank
        for piece, i in ids.items():
            if len(piece) < 2 or set(piece) == {SPACE_SIGN}:
                continue
            parts, last = list(piece), None
            while len(parts) > 1:
                merges = [(rank[j], k) for k in range(len(parts) - 1) if (j := ids.get(parts[k] + parts[k + 1])) is not None]
                if not merges:
                    break
                k = min(merges)[1]
                last = parts[k], parts[k + 1]
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            if len(parts) == 1 and last[0] in ids and last[1] in ids:
                self.split[i] = ids[last[0]], ids[last[1]]


class Encoder:
    """Encodes and decodes with one vocabulary; holds the bounded memories of a worker."""

    def __init__(self, v: Vocabulary) -> None:
        self.v = v
        self.ids = {p: i for i, p in enumerate(v.pieces) if v.normal[i]}
        self.length = [len(p) for p in v.pieces]
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            if len(p) == 1 or i in v.split:
                self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        self.known = {p for p in self.ids if len(p) == 1}
        mixed = {c for p in self.ids for c in p} - self.known
        if mixed:
            raise ValueError("signs that are part of pieces but no pieces themselves are not supported")
        self.of_byte = {b: i for i, b in v.byte.items()}
        self.longest_run = max([0, *(len(p) for p in self.ids if set(p) == {SPACE_SIGN})])
        self.pairs: dict[int, bool] = {}
        self.runs: dict[int, list[int]] = {}
        self.stretches: dict[str, bytes] = {}
        self.stretch = re.compile(f"{SPACE_SIGN}+[^{SPACE_SIGN}\n]*|[^{SPACE_SIGN}\n]+|\n")
        plain = [b" \xe2\x81\x87 " if i == v.unknown else bytes([v.byte[i]]) if i in v.byte else p.replace(SPACE_SIGN, " ").encode() if v.normal[i] else b"" for i, p in enumerate(v.pieces)]
        self.sizes = np.array([len(p) for p in plain], "i8")
        self.starts = np.concatenate([[0], self.sizes.cumsum()[:-1]])
        self.bytes = np.frombuffer(b"".join(plain), "u1")

    def compatible(self, left: int, right: int) -> bool:
        """Whether BPE of the two pieces' text keeps the border between them.

        Undoes the merges of both, latest first. Whenever the two signs groups at
        the border could have merged before the merge undone last, they would
        have; a merge of equal rank goes to the left one.
        """
        rank, split, pieces, ids = self.v.rank, self.v.split, self.v.pieces, self.ids
        before = len(rank) + 1
        while True:
            joined = ids.get(pieces[left] + pieces[right])
            if joined is not None and rank[joined] < before:
                return False
            a = rank[left] if left in split else -1
            b = rank[right] if right in split else -1
            if a < 0 and b < 0:
                return True
            if a > b:
                before, left = a, split[left][1]
            else:
                before, right = b + 1, split[right][0]

    def prefix_table(self, word: str) -> list[int]:
        """Ids of a stretch of known signs."""
        length, pairs = self.length, self.pairs
        last = [-1] * (len(word) + 1)
        for at, piece in self.automaton.iter(word):
            at += 1
            if last[at] >= 0:
                continue
            start = at - length[piece]
            if start:
                key = last[start] << 20 | piece
                fits = pairs.get(key)
                if fits is None:
                    fits = pairs[key] = self.compatible(last[start], piece)
                if not fits:
                    continue
            last[at] = piece
        out, at = [], len(word)
        while at:
            out.append(last[at])
            at -= length[last[at]]
        return out[::-1]

    def encode_stretch(self, s: str) -> list[int]:
        run = len(s) - len(s.lstrip(SPACE_SIGN))
        body = s[run:]
        out: list[int] = []
        lead = SPACE_SIGN if run else ""
        for known, signs in groupby(body, self.known.__contains__):
            if known:
                ids = self.prefix_table(lead + "".join(signs))
                if lead and self.v.pieces[ids[0]] == SPACE_SIGN:
                    ids = ids[1:]
                elif lead:
                    run -= 1
            else:
                ids = [self.of_byte.get(b, self.v.unknown) for c in signs for b in c.encode("utf-8", "surrogatepass")]
            if lead or not out:
                out += self.spaces(run)
            lead, run = "", 0
            out += ids
        return out or self.spaces(run)

    def spaces(self, run: int) -> list[int]:
        """A run of space signs: pieces of equal score merge from the left; beyond twice the longest piece it repeats."""
        if run not in self.runs:
            top = max(1, self.longest_run)
            whole = max(0, run // top - 2)
            parts = [SPACE_SIGN] * (run - whole * top)
            while True:
                merges = [(-self.v.score[j], k) for k in range(len(parts) - 1) if (j := self.ids.get(parts[k] + parts[k + 1])) is not None]
                if not merges:
                    break
                k = min(merges)[1]
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            found = [self.ids[SPACE_SIGN * top]] * whole + [self.ids[x] for x in parts]
            if run > 4 * top:
                return found
            self.runs[run] = found
        return self.runs[run]

    def encode(self, text: str) -> bytes:
        """Ids with begin and end as little-endian unsigned 32-bit integers."""
        ends = (self.v.begin.to_bytes(4, "little"), self.v.end.to_bytes(4, "little"))
        if not text:
            return b"".join(ends)
        stretches, out = self.stretches, [ends[0]]
        for s in self.stretch.findall(SPACE_SIGN + text.replace(" ", SPACE_SIGN)):
            ids = stretches.get(s)
            if ids is None:
                ids = np.array(self.encode_stretch(s), "<u4").tobytes()
                if len(s) <= 64:
                    if len(stretches) >= REMEMBERED:
                        stretches.clear()
                    stretches[s] = ids
            out.append(ids)
        if len(self.pairs) > 4 * REMEMBERED:
            self.pairs.clear()
        out.append(ends[1])
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; each byte that is part of no sign becomes U+FFFD, control ids say nothing."""
        codecs.register_error("one_byte", lambda e: ("\ufffd", e.start + 1))
        said = self.sizes[ids] > 0
        if said.sum() >= len(ids) - 2 and said[1:-1].all():
            parts = [ids[said]]
        else:  # bytes do not join into a sign across control ids
            parts = [x[self.sizes[x] > 0] for x in np.split(ids, np.flatnonzero(~said))]
        parts = [x for x in parts if len(x)]
        raw = [self.plain(x) for x in parts]
        if parts and self.v.pieces[parts[0][0]].startswith(SPACE_SIGN):
            raw[0] = raw[0][1:]
        return "".join(x.decode("utf-8", "one_byte") for x in raw)

    def plain(self, ids: np.ndarray) -> bytes:
        """The bytes that the pieces stand for, one after another."""
        sizes = self.sizes[ids]
        ends = sizes.cumsum()
        return self.bytes[np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(int(ends[-1]))].tobytes()


def _encoder(given: Broadcast) -> Encoder:
    """The encoder of this worker process, made once for each vocabulary and kept for later tasks."""
    made = sys.__dict__.setdefault("_marlstone_encoders", {})
    key = hash(given.value)
    if key not in made:
        made.clear()
        made[key] = Encoder(shared(given))
    return made[key]


def encode_texts(df: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with a column of ids (array<int>), begin and end included."""
    small_batches(df.sparkSession)
    given = share(df.sparkSession, Vocabulary.load(path))

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = _encoder(given)
        for texts in batches:
            yield pd.Series([np.frombuffer(e.encode(t), "<u4").astype("i4") for t in texts])

    return df.withColumn(out, encode(text_of(text)))


def decode_ids(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text of a column of ids; null ids give a null text."""
    small_batches(df.sparkSession)
    given = share(df.sparkSession, Vocabulary.load(path))

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = _encoder(given)
        for column in batches:
            yield pd.Series([None if x is None else e.decode(np.asarray(x, "i8")) for x in column], dtype=object)

    return df.withColumn(out, decode(F.col(ids)))


def round_trip(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes, then decodes the ids: key, n_tokens, ids_sha256, decoded_sha256."""
    small_batches(df.sparkSession)
    given = share(df.sparkSession, Vocabulary.load(path))

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def work(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        e = _encoder(given)
        for texts in batches:
            rows = []
            for t in texts:
                ids = e.encode(t)
                decoded = e.decode(np.frombuffer(ids, "<u4").astype("i8"))
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(F.col(f"`{key}`").alias(key), work(text_of(text)).alias("__made")).select(key, "__made.*")
