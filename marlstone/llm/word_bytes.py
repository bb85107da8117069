"""Words of UTF-8 texts as numpy arrays: where they begin and end, 64-bit hashes of them and of their runs."""

from __future__ import annotations

import sys

import numpy as np

U = np.uint64


def table_of(signs: bytes) -> np.ndarray:
    """For every byte, whether it is one of ``signs``."""
    out = np.zeros(256, bool)
    out[list(signs)] = True
    return out


#: Every byte, A to Z as a to z.
LOWER = np.arange(256, dtype="u1")
LOWER[65:91] += 32


def numbers() -> dict[str, np.ndarray]:
    """Fixed odd random numbers for bytes and places, from one seed; made once in a process."""
    made = sys.__dict__.get("_marlstone_numbers")
    if made is None:
        rng = np.random.Generator(np.random.PCG64(20261128))
        odd = lambda n: rng.integers(0, 2**63, n, dtype="u8") * U(2) + U(1)
        made = {"byte": odd(256), "step": odd(1), "place": odd(64)}
        sys.__dict__["_marlstone_numbers"] = made
    return made


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64 bits (a bijection)."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts with a newline behind each, and where each ends (behind its newline)."""
    data = np.frombuffer(b"\n".join([*texts, b""]), "u1")
    return data, np.cumsum([len(t) + 1 for t in texts])


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends (exclusive) of the runs of true values."""
    edge = np.flatnonzero(np.diff(inside.view("i1"), prepend=np.int8(0), append=np.int8(0)))
    return edge[::2], edge[1::2]


#: Words that are hashed at once: their letters fit a processor's cache, and memory stays small.
CHUNK = 1 << 15


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words between ``starts`` and ``ends``, which rise and do not overlap."""
    made, out = numbers(), np.zeros(len(starts), "u8")
    power = np.cumprod(np.full(int((ends - starts).max(initial=1)), made["step"][0], "u8"))
    for k in range(0, len(starts), CHUNK):
        begin, sizes = starts[k : k + CHUNK], (ends - starts)[k : k + CHUNK]
        first = np.cumsum(sizes) - sizes
        place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
        out[k : k + CHUNK] = np.add.reduceat(made["byte"][data[place + np.repeat(begin, sizes)]] * power[place], first)
    return mix(out)


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words, each at its first word's place; runs of different lengths differ."""
    m = max(0, len(words) - n + 1)
    total = np.full(m, n, "u8")
    for k in range(n):
        total += words[k : k + m] * numbers()["place"][k]
    return mix(total)


def cut_out(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes between ``starts`` and ``ends`` one after another, and 32-bit offsets into them."""
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(int(offsets[-1]), "u1")
    for k in range(0, len(starts), CHUNK):
        low, high = int(offsets[k]), int(offsets[min(k + CHUNK, len(starts))])
        out[low:high] = data[np.arange(low, high) + np.repeat((starts - offsets[:-1])[k : k + CHUNK], sizes[k : k + CHUNK])]
    return out, offsets.astype("i4")
