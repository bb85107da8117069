"""Texts rewritten by dictionaries and by ordered patterns.

A dictionary is a frame that the caller gives. It is counted first: up to
``MOST_ENTRIES`` entries and ``MOST_SIGNS`` characters are broadcast and become
one automaton in each task, so a text is read once, whatever the number of
entries. A larger dictionary of whole words is joined instead
(``operators.vocabulary.replace_words``).

Null and empty entries are left out; of several with one key the least
replacement counts; a null replacement is the empty text; a null text stays null.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_ENTRIES = 200_000
MOST_SIGNS = 8 << 20

# The ordered substitutions of the cleaning chain.
SUBSTITUTIONS = (
    (r"[^A-Za-z0-9^,*+-=]", " "),
    (r"(\d+)(k)", r"\1000"),
    (r";", " "),
    (r":", " "),
    (r",", " "),
    (r"\.", " "),
    (r"<", " "),
    (r"\^", " "),
    (r"(\d+)(/)", r"\1 divide "),
    (r"/", " "),
    (r"\+", " plus "),
    (r"-", " minus "),
    (r"\*", " multiply "),
    (r"=", "equal"),
    (r"What's", "What is "),
    (r"what's", "what is "),
    (r"Who's", "Who is "),
    (r"who's", "who is "),
    (r"'s", " "),
    (r"'ve", " have "),
    (r"can't", "cannot "),
    (r"n't", " not "),
    (r"'re", " are "),
    (r"'d", " would "),
    (r"'ll", " will "),
    (r"'m", " am "),
    (r"or not", " "),
    (r"What should I do to", "How can I"),
    (r"How do I", "How can I"),
    (r"How can you make", "What can make"),
    (r"How do we", "How do I"),
    (r"How do you", "How do I"),
    (r"Is it possible", "Can we"),
    (r"Why is", "Why"),
    (r"Which are", "What are"),
    (r"What are the reasons", "Why"),
    (r"What are some tips", "tips"),
    (r"What is the best way", "best way"),
    (r"e-mail", "email"),
    (r"e - mail", "email"),
    (r"US", "America"),
    (r"USA", "America"),
    (r"us", "America"),
    (r"usa", "America"),
    (r"Chinese", "China"),
    (r"india", "India"),
    (r"\s{2,}", " "),
)
# Faces and their tags, in their order.
FACES = (
    (r"(:\s?\)|:-\)|\(\s?:|\(-:|:'\))", " EMO_POS "),
    (r"(:\s?D|:-D|x-?D|X-?D)", " EMO_POS "),
    (r"(<3|:\*)", " EMO_POS "),
    (r"(;-?\)|;-?D|\(-?;)", " EMO_POS "),
    (r"(:\s?\(|:-\(|\)\s?:|\)-:)", " EMO_NEG "),
    (r"""(:,\(|:'\(|:"\()""", " EMO_NEG "),
)
# First and last code points of blocks of pictures and signs.
PICTURES = ((0x203C, 0x203C), (0x2190, 0x21FF), (0x2300, 0x23FF), (0x2600, 0x27BF), (0x2B00, 0x2BFF), (0x1F000, 0x1FAFF))


def rewrite_patterns(x: str | Column, rules: Sequence[tuple[str, str]] = SUBSTITUTIONS) -> Column:
    r"""Regular expressions replaced one after another; ``\1`` in a replacement is a group (of one digit), everything else is literal."""
    t = F.col(x) if isinstance(x, str) else x
    for pattern, new in rules:  # fewer than ten groups, so that further digits are literal
        t = F.regexp_replace(t, pattern, "$".join(p.replace("$", r"\$") for p in new.split("\\")))
    return t


def load(entries: DataFrame, old: str = "old", new: str = "new", order: str | None = None) -> list[tuple[str, str]]:
    """The dictionary in the order of ``order`` (else of its keys); a ValueError where it is too large to be broadcast."""
    kept = entries.where((F.length(old) > 0) & F.col(old).isNotNull()).select(F.col(old).alias("a"), F.coalesce(new, F.lit("")).alias("b"), (F.col(order) if order else F.lit(0)).alias("o"))
    kept = kept.groupBy("a").agg(F.min(F.struct("o", "b")).alias("m")).select("a", "m.b", "m.o")
    size = kept.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("a") + F.length("b")), F.lit(0)).alias("signs")).first()
    if size["n"] > MOST_ENTRIES or size["signs"] > MOST_SIGNS:
        raise ValueError(f"a dictionary of {size['n']} entries and {size['signs']} characters is too large to be broadcast; join it as words")
    return [(r["a"], r["b"]) for r in kept.orderBy("o", "a").collect()]


def share(entries: DataFrame, table: list[tuple[str, str]]) -> Broadcast:
    return entries.sparkSession.sparkContext.broadcast(table)


#: Texts that are Python strings at one time; a batch of them stays in Arrow.
SLICE = 128


def each_text(texts: pa.Array, one: Callable[[str], str]) -> pa.Array:
    """A function of one text on a batch, a slice at a time, so that a batch of long texts is never held as Python strings; null stays null."""
    parts = [pa.array([None if t is None else one(t) for t in texts.slice(begin, SLICE).to_pylist()], pa.string()) for begin in range(0, len(texts), SLICE)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def code_points(signs: Iterable[str]) -> np.ndarray:
    """By code point, whether it is one of these signs."""
    out = np.zeros(sys.maxunicode + 1, bool)
    out[[ord(c) for c in signs]] = True
    return out


def rewrite_longest(x: str | Column, entries: DataFrame, old: str = "old", new: str = "new") -> Column:
    """All entries replaced in one pass: the leftmost, and there the longest; what was replaced is not read again."""
    table = share(entries, load(entries, old, new))

    @F.arrow_udf("string")
    def rewrite(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import ahocorasick

        known = dict(table.value)
        if all(len(a) == 1 for a in known):  # signs: most texts have few of them, and an automaton tries every branch of its root at every sign
            has = code_points(known)

            def name(text: str) -> str:
                out, last = [], 0
                for i in np.flatnonzero(has[np.frombuffer(text.encode("utf-32-le"), "u4")]).tolist():
                    out += [text[last:i], known[text[i]]]
                    last = i + 1
                return "".join([*out, text[last:]])

            for texts in batches:
                yield each_text(texts, name)
            return
        automaton = ahocorasick.Automaton()
        for a, b in table.value:
            automaton.add_word(a, (len(a), b))
        automaton.make_automaton()

        def one(text: str) -> str:
            longest = {}
            for end, (size, b) in automaton.iter(text):  # by their ends: the last of one start is its longest
                longest[end - size + 1] = (end + 1, b)
            out, at = [], 0
            for start in sorted(longest):
                if start >= at:
                    end, b = longest[start]
                    out += [text[at:start], b]
                    at = end
            return "".join([*out, text[at:]])

        for texts in batches:
            yield each_text(texts, one)

    return rewrite(x)


class InOrder:
    """Entries replaced one after another, looking only for those that a text has or that a replacement may have made."""

    def __init__(self, table: Sequence[tuple[str, str]]):
        import ahocorasick

        self.table, self.found = table, ahocorasick.Automaton()
        for i, (a, _) in enumerate(table):
            self.found.add_word(a, i)
        if table:
            self.found.make_automaton()
        self.heads = {a[:k] for a, _ in table for k in range(1, len(a) + 1)}
        self.tails = {a[-k:] for a, _ in table for k in range(1, len(a) + 1)}
        self.keys = "\0".join(a for a, _ in table)
        self.may_make: dict[str, bool] = {}

    def makes(self, new: str) -> bool:
        """Whether an entry may lie over this replacement or a part of it: they share a border, or one holds the other."""
        if new not in self.may_make:
            borders = any(new[k:] in self.heads or new[: k + 1] in self.tails for k in range(len(new)))
            self.may_make[new] = not new or borders or new in self.keys or next(self.found.iter(new), None) is not None
        return self.may_make[new]

    def __call__(self, text: str) -> str:
        if not self.table:
            return text
        waiting = sorted({i for _, i in self.found.iter(text)}, reverse=True)
        while waiting:
            i = waiting.pop()
            old, new = self.table[i]
            after = text.replace(old, new)
            if after != text and self.makes(new):
                waiting = sorted({k for _, k in self.found.iter(after) if k > i}, reverse=True)
            text = after
        return text


def rewrite_in_order(x: str | Column, entries: DataFrame, old: str = "old", new: str = "new", order: str = "place") -> Column:
    """One entry after another replaced in the whole text, so that later ones read what earlier ones wrote."""
    table = share(entries, load(entries, old, new, order))

    @F.arrow_udf("string")
    def rewrite(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        one = InOrder(table.value)
        for texts in batches:
            yield each_text(texts, one)

    return rewrite(x)


#: Words between blanks as RE2 and Java have them; Python's split takes more signs for blanks.
_WORD = re.compile(r"[^ \t\n\x0b\f\r]+")


def upper_form(word: str) -> str:
    """Capitals sign by sign, as SQL has them: a sign whose capital would be several stays (or is its title form), but ``ß`` is SS."""
    out = word.upper()
    if len(out) == len(word):
        return out
    forms = ((c, c.upper(), c.title()) for c in word)
    return "".join("SS" if c == "ß" else u if len(u) == 1 else t if len(t) == 1 else c for c, u, t in forms)


def lower_form(word: str) -> str:
    """Small letters sign by sign, whatever stands beside them."""
    return "".join(c.lower()[0] for c in word)


def in_form(x: str | Column, form: Callable[[str], str]) -> Column:
    """Words of a column in one of these forms; null stays null."""

    @F.arrow_udf("string")
    def each(words: pa.Array) -> pa.Array:
        return each_text(words, form)

    return each(x)


def expand_words(x: str | Column, entries: DataFrame, old: str = "old", new: str = "new") -> Column:
    """Blank-separated words whose ``upper_form`` is an entry replaced; words are joined by one blank."""
    table = share(entries, load(entries, old, new))

    @F.arrow_udf("string")
    def expand(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = dict(table.value)
        for texts in batches:
            yield each_text(texts, lambda t: " ".join([known.get(upper_form(w), w) for w in _WORD.findall(t)]))

    return expand(x)


def sign_names(ranges: Sequence[tuple[int, int]] = PICTURES) -> list[tuple[str, str]]:
    """Every named sign of these ranges of code points with its name between colons, as the Unicode tables have it."""
    signs = (chr(c) for a, b in ranges for c in range(a, b + 1))
    names = ((s, unicodedata.name(s, "")) for s in signs)
    return [(s, f":{n.lower().replace(' ', '_')}:") for s, n in names if n]


def name_signs(x: str | Column, entries: DataFrame, back: bool = False) -> Column:
    """Signs to names, or names back to signs, by a frame of ``sign`` and ``name``."""
    return rewrite_longest(x, entries, "name", "sign") if back else rewrite_longest(x, entries, "sign", "name")
