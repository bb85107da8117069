"""Words of running text as a treebank splits them: clitics, quotes by their side, brackets, the last full stop."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions.rewriting import SLICE, each_text

# The splitting rules in their order; a quote becomes `` where it opens and '' where it closes.
SPLITS = (
    (r'^"', "`` "),
    (r'([\s(\[{<])"', r"\1 `` "),
    (r"([:,])([^\d])", r" \1 \2"),
    (r"([:,])\z", r" \1 "),
    (r"\.\.\.", " ... "),
    (r"([;@#$%&])", r" \1 "),
    (r"""([^.])(\.)([\])}>"']*)\s*\z""", r"\1 \2\3 "),
    (r"([?!])", r" \1 "),
    (r"([^'])'\s", r"\1 ' "),
    (r"([\]\[(){}<>])", r" \1 "),
    (r"--", " -- "),
    (r"\A|\z", " "),
    (r'"', " '' "),
    (r"\s", "  "),  # each word has blanks of its own
    (r"([^'\s])('[sSmMdD]|')\s", r"\1 \2 "),
    (r"([^'\s])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T)\s", r"\1 \2 "),
    (r"(?i)\s(can)(not)\s", r" \1 \2 "),
    (r"(?i)\s(d)('ye)\s", r" \1 \2 "),
    (r"(?i)\s(gim|lem)(me)\s", r" \1 \2 "),
    (r"(?i)\s(gon|wan)(na)\s", r" \1 \2 "),
    (r"(?i)\s(got)(ta)\s", r" \1 \2 "),
    (r"(?i)\s(more)('n)\s", r" \1 \2 "),
    (r"(?i)\s('t)(is|was)\s", r" \1 \2 "),
)


# Of the rules, that on : and , and those that set signs apart, whatever is beside them.
COMMA, SIGNS = SPLITS[2], (SPLITS[4], SPLITS[5], SPLITS[7], SPLITS[9], SPLITS[10])
# What the other rules need, apart from the ends of a text: a quote or one of these words.
WORDS = frozenset("cannot gimme lemme gonna wanna gotta".split())
#: Rewritten words with signs that a task keeps, and the longest of them.
MOST_WORDS = 1 << 16
LONGEST_WORD = 64
#: What parts tokens, as Java has it.
_BLANKS = re.compile(r"[ \t\n\x0b\f\r]+")


class ByWords:
    """The rules on a text, word by word: most words have no sign, and one with signs met before is looked up.

    No rule reads beyond one word and the blanks beside it: what it takes of them
    is a blank at most, and only the first and the last word can touch an end of
    the text. Blanks are those of RE2 (no vertical tab), as is the case of letters.
    """

    def __init__(self):
        self.rules, self.known = [], {}
        for pattern, new in SPLITS:  # a word has no blank but those that are put beside it
            pattern = pattern.replace(r"\s", " ").replace(r"\d", "0-9").replace(r"\z", r"\Z")
            if pattern.startswith("(?i)"):
                pattern = pattern.replace("s", "[s\u017f]")
            self.rules.append((re.compile(pattern, re.ASCII), new))
        self.others, self.comma = re.compile("|".join(["(?i)['\"]", *WORDS]), re.ASCII), self.rules[SPLITS.index(COMMA)][0]
        self.signs = re.compile("|".join(pattern for pattern, _ in SIGNS))

    def rewrite(self, text: str) -> str:
        for pattern, new in self.rules:
            text = pattern.sub(new, text)
        return text.strip(" ")

    def apart(self, word: str) -> str:
        """A word with others on both sides."""
        out = self.known.get(word)
        if out is None:
            if self.others.search(word):
                out = self.rewrite(f" {word} x")[:-1]
            else:
                out = self.signs.sub(r" \g<0> ", self.comma.sub(COMMA[1], f"{word} "))
            if len(word) <= LONGEST_WORD:
                if len(self.known) >= MOST_WORDS:
                    self.known.clear()
                self.known[word] = out
        return out

    def __call__(self, text: str) -> str:
        for sign in "\t\n\f\r":
            text = text.replace(sign, " ")
        words = text.strip(" ").split(" ")
        before, after = " " * text.startswith(" "), " " * text.endswith(" ")
        if len(words) == 1:
            return self.rewrite(before + words[0] + after)
        first, last = self.rewrite(f"{before}{words[0]} x")[:-1], self.rewrite(f"x {words[-1]}{after}")[1:]
        return " ".join([first, *[w if w.isalnum() and w.lower() not in WORDS else self.apart(w) for w in words[1:-1]], last])


def treebank(x: str | Column) -> Column:
    """The tokens of a text; none for an empty one, null for null."""

    @F.arrow_udf("string")
    def rewrite(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        one = ByWords()
        for texts in batches:
            yield each_text(texts, one)

    return F.array_remove(F.split(rewrite(x), r"\s+"), "")


def _of_slice(texts: list[str | None], tokens: Iterator[list[str]]) -> pa.Array:
    """Spans of some texts as flat numbers; the tokens of one text at a time are Python strings."""
    begins, ends, offsets = array("i"), array("i"), array("i", [0])
    for text in texts:
        at = 0
        for w in next(tokens) if text is not None else ():
            begin = text.find(w, at)
            if w in ("``", "''"):  # a quote, if that comes first
                quote = text.find('"', at)
                if quote >= 0 and (begin < 0 or quote < begin):
                    begin, w = quote, '"'
            at = begin + len(w)
            begins.append(begin)
            ends.append(at)
        offsets.append(len(begins))
    both = pa.StructArray.from_arrays([pa.array(np.asarray(begins)), pa.array(np.asarray(ends))], ["begin", "end"])
    return pa.ListArray.from_arrays(pa.array(np.asarray(offsets)), both, mask=pa.array([text is None for text in texts], pa.bool_()))


def _pieces(texts: list[str | None], spans: pa.Array) -> pa.Array:
    out = []
    for text, found in zip(texts, spans, strict=True):
        at = () if text is None else zip(*(np.asarray(found.values.field(k)).tolist() for k in ("begin", "end")), strict=True)
        out.append(None if text is None else [text[a:b] for a, b in at])
    return pa.array(out, pa.list_(pa.string()))


def _slices(*columns: pa.Array) -> Iterator[tuple[pa.Array, ...]]:
    """A batch by slices, which leave the task as they are made."""
    for begin in range(0, len(columns[0]), SLICE):
        yield tuple(c.slice(begin, SLICE) for c in columns)


def treebank_spans(x: str | Column, tokens: str | Column) -> Column:
    """Where each token stands in its text: begin and end (exclusive) in characters."""

    @F.arrow_udf("array<struct<begin:int,end:int>>")
    def spans(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for batch in batches:
            for some, words in _slices(*batch):
                texts = some.to_pylist()
                yield _of_slice(texts, (w.as_py() for text, w in zip(texts, words, strict=True) if text is not None))

    return spans(x, tokens)


def cut_spans(x: str | Column, spans: str | Column) -> Column:
    """The pieces of a text that spans name."""

    @F.arrow_udf("array<string>")
    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for batch in batches:
            for some, found in _slices(*batch):
                yield _pieces(some.to_pylist(), found)

    return cut(x, spans)


def treebank_pieces(x: str | Column) -> Column:
    """What the spans of its tokens cut out of a text: ``treebank``, ``treebank_spans`` and ``cut_spans`` in one pass, so that a task has one Python worker and tokens and spans never leave it."""

    @F.arrow_udf("array<string>")
    def pieces(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        one = ByWords()
        for batch in batches:
            for (some,) in _slices(batch):
                texts = some.to_pylist()
                tokens = ([w for w in _BLANKS.split(one(text)) if w] for text in texts if text is not None)
                yield _pieces(texts, _of_slice(texts, tokens))

    return pieces(x)
