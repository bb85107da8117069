"""Text functions on built-in expressions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns of the cleaning steps, and small word lists.
URL = r"(?i)\b(?:https?://|www\.)\S+"
MENTION = r"@\w+"
HASHTAG = r"#\w+"
RESERVED = r"\b(?:RT|rt|FAV|fav|VIA|via)\b"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
EXOTIC_SPACES = "       　"
ZERO_WIDTH = "​‌‍﻿"
CONTRACTIONS = (("won't", "will not"), ("can't", "can not"), ("n't", " not"), ("'re", " are"), ("'s", " is"), ("'d", " would"), ("'ll", " will"), ("'t", " not"), ("'ve", " have"), ("'m", " am"))
PUNCTUATION_MAP = {"‘": "'", "’": "'", "“": '"', "”": '"', "´": "'", "`": "'", "–": "-", "—": "-", "…": "...", "«": '"', "»": '"', "•": "-", "×": "x", "−": "-"}
HAPPY = (":)", ":-)", ":D", ";)", "=)")
SAD = (":(", ":-(", ":'(", "=(")
# Faces that are counted as happy and as sad.
SMILIES = (
    ":‑)", ":)", ":-]", ":]", ":-3", ":3", ":->", ":>", "8-)", "8)", ":-}", ":}", ":o)", ":c)", ":^)", "=]", "=)", ":‑D", ":D", "8‑D", "8D", "x‑D",
    "xD", "X‑D", "XD", "=D", "=3", "B^D", ":-))", ";‑)", ";)", "*-)", "*)", ";‑]", ";]", ";^)", ":‑,", ";D", ":‑P", ":P", "X‑P", "XP", "x‑p", "xp",
    ":‑p", ":p", ":‑Þ", ":Þ", ":‑þ", ":þ", ":‑b", ":b", "d:", "=p", ">:P", ":'‑)", ":')", ":-*", ":*", ":×",
)
SAD_FACES = (
    ":-<", ":()", ";-()", ";(", ":‑(", ":(", ":‑c", ":c", ":‑<", ":<", ":‑[", ":[", ":-||", ">:[", ":{", ":@", ">:(", "D‑':", "D:<", "D:", "D8", "D;",
    "D=", "DX", ":‑/", ":/", ":‑.", ">:\\", ">:/", ":\\", "=/", "=\\", ":L", "=L", ":S", ":‑|", ":|", "|‑O", "<:‑|",
)
IPV4 = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
IPV4_STRICT = r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b"
ISO_DATE = r"\b\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])\b"


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def count_of(x: str | Column, literal: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(_col(x)) - F.length(F.replace(_col(x), F.lit(literal), F.lit("")))) / len(literal)).cast("int")


def words(x: str | Column) -> Column:
    """Blank-separated words; none for an empty text."""
    return F.array_remove(F.split(_col(x), r"\s+"), "")


def statistics(x: str) -> dict[str, Column]:
    """Counts that describe a text."""
    w = words(x)
    n = F.size(w)
    letters = F.aggregate(w, F.lit(0), lambda a, v: a + F.length(v))
    return {
        "chars": F.length(x),
        "words": n,
        "unique_words": F.size(F.array_distinct(w)),
        "unique_share": F.try_divide(F.size(F.array_distinct(w)), n),
        "upper_chars": F.regexp_count(x, F.lit(r"\p{Lu}")),
        "upper_words": F.size(F.filter(w, lambda v: v.rlike(r"^[^\p{Ll}]*\p{Lu}[^\p{Ll}]*$"))),
        "title_words": F.size(F.filter(w, lambda v: v.rlike(r"^\p{Lu}\p{Ll}*[^\p{L}]*$"))),
        "punctuation": F.length(x) - F.length(F.translate(x, PUNCTUATION, "")),
        "mean_word": F.try_divide(letters, n),
    }


def squeeze_blanks(x: str | Column) -> Column:
    return F.trim(F.regexp_replace(_col(x), r"\s+", " "))


def clean(x: str | Column, stop_words: Sequence[str] = ()) -> Column:
    """The fixed chain: addresses, mentions, hashtags, reserved words, punctuation, single letters, numbers, blanks, stop words; lower case."""
    t = F.regexp_replace(_col(x), URL, " ")
    t = F.regexp_replace(F.regexp_replace(t, MENTION, " "), HASHTAG, " ")
    t = F.regexp_replace(t, RESERVED, " ")
    t = F.lower(F.translate(t, PUNCTUATION, ""))
    t = F.regexp_replace(t, r"(?<![\p{L}\p{N}])\p{L}(?![\p{L}\p{N}])", " ")
    kept = F.filter(words(t), lambda v: ~v.rlike(r"^\d+$") & ~v.isin(*stop_words) if stop_words else ~v.rlike(r"^\d+$"))
    return F.array_join(kept, " ")


def rewrite(x: str | Column, rules: Sequence[tuple[str, str]] = CONTRACTIONS) -> Column:
    """Literal replacements in their order."""
    t = _col(x)
    for old, new in rules:
        t = F.replace(t, F.lit(old), F.lit(new))
    return t


def strip_accents(x: str | Column) -> Column:
    """Compatibility decomposition without combining marks, for every script; built-ins have no Unicode normal forms, so Arrow batches do it."""
    import sys
    import unicodedata

    import numpy as np

    from marlstone.functions.rewriting import code_points, each_text

    @F.arrow_udf("string")
    def plain(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        marks = code_points(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.combining(c))

        def one(text: str) -> str:
            if text.isascii():
                return text
            signs = np.frombuffer(unicodedata.normalize("NFKD", text).encode("utf-32-le"), "u4")
            return signs[~marks[signs]].tobytes().decode("utf-32-le")

        for texts in batches:
            yield each_text(texts, one)

    return plain(_col(x))


def plain_punctuation(x: str | Column, table: dict[str, str] | None = None) -> Column:
    """Typographic signs replaced by plain ones."""
    return rewrite(x, tuple((PUNCTUATION_MAP if table is None else table).items()))


def plain_spaces(x: str | Column) -> Column:
    return F.translate(_col(x), EXOTIC_SPACES + ZERO_WIDTH, " " * len(EXOTIC_SPACES))


def squeeze_letters(x: str | Column, keep: int = 2) -> Column:
    """Runs of one letter cut to ``keep``."""
    return F.regexp_replace(_col(x), rf"(\p{{L}})\1{{{keep},}}", "$1" * keep)


def space_numbers(x: str | Column) -> Column:
    """``1,000`` joined, ``50k`` spelled out, units set apart."""
    t = F.regexp_replace(_col(x), r"(?<=\d),(?=\d{3}\b)", "")
    t = F.regexp_replace(t, r"\b(\d+)[kK]\b", "$1000")
    return F.regexp_replace(t, r"(\d)(\p{L})", "$1 $2")


def isolate_punctuation(x: str | Column) -> Column:
    return squeeze_blanks(F.regexp_replace(_col(x), r"([^\p{L}\p{N}\s])", " $1 "))


def negated(x: str | Column, negators: Sequence[str] = ("not", "no")) -> Column:
    """Each word behind a negator marked by ``not_``; the first word is never negated."""
    # the words are split once, not for every word
    mark = lambda w: F.transform(w, lambda v, i: F.when((i > 0) & F.get(w, i - 1).isin(*negators), F.concat(F.lit("not_"), v)).otherwise(v))
    return F.transform(F.array(words(x)), mark)[0]


def ngrams(items: Column, low: int, high: int, separator: str = " ") -> Column:
    """All n-grams of an array, shorter ones first."""

    def of(w: Column, n: int) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), separator))
        return F.when(F.size(w) >= n, grams).otherwise(F.array().cast("array<string>"))

    # the array is computed once, not for every gram
    return F.transform(F.array(items), lambda w: F.concat(*[of(w, n) for n in range(low, high + 1)]))[0]


def char_ngrams(word: Column, n: int) -> Column:
    """Character n-grams of a word padded by a blank on either side."""
    padded = F.concat(F.lit(" "), word, F.lit(" "))
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - (n - 1), F.lit(1))), lambda i: F.substring(padded, i, F.lit(n)))


def range_bounds(x: str | Column) -> tuple[Column, Column]:
    """``10/49`` -> 10, 49; ``10000+`` -> 10000, null."""
    low = F.regexp_extract(_col(x), r"^(\d+)", 1).try_cast("int")
    return low, F.nullif(F.regexp_extract(_col(x), r"/(\d+)$", 1), F.lit("")).cast("int")


def version_parts(x: str | Column, n: int) -> list[Column]:
    pieces = F.split(_col(x), r"\.")
    return [F.get(pieces, k).try_cast("int") for k in range(n)]


def url_piece(x: str | Column, k: int) -> Column:
    """The k-th piece of an address between slashes."""
    return F.get(F.split(_col(x), "/"), k)
