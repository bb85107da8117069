"""Media columns: Netpbm and BMP decoded to numpy, resized by integral images, kept as NPY tiles.

The work is row by row: Arrow batches go through one task each, no shuffle.

Defined results: null media decode to a null tile and a null feature; media that
are no whole Netpbm or BMP file (or name a maximum of 0) give nulls too; an empty text becomes 64 zero bytes;
equal inputs give equal outputs; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import io
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import small_batches, text_of

WIDTH = 64
HASH_ROWS, HASH_COLUMNS = 8, 9


def read_netpbm(data: bytes) -> np.ndarray | None:
    """P1 to P6 as an array (rows, columns) or (rows, columns, 3) of 8-bit samples."""
    kind, at, values = data[:2], 2, []
    need = 2 if kind in (b"P1", b"P4") else 3
    while len(values) < need:
        while at < len(data) and (data[at : at + 1].isspace() or data[at : at + 1] == b"#"):
            at = data.find(b"\n", at) + 1 or len(data) if data[at : at + 1] == b"#" else at + 1
        end = at
        while end < len(data) and data[end : end + 1].isdigit():
            end += 1
        if end == at:
            return None
        values.append(int(data[at:end]))
        at = end
    columns, rows, top = *values[:2], values[2] if need == 3 else 1
    if not 0 < top < 65536:
        return None
    shape = (rows, columns, 3) if kind in (b"P3", b"P6") else (rows, columns)
    count = int(np.prod(shape))
    if kind in (b"P5", b"P6"):
        wide = np.dtype(">u2") if top > 255 else np.dtype("u1")
        body = data[at + 1 : at + 1 + count * wide.itemsize]
        if len(body) < count * wide.itemsize:
            return None
        flat = np.frombuffer(body, wide)
    elif kind == b"P4":
        packed = np.frombuffer(data, "u1", offset=at + 1)
        line = -(-columns // 8)
        if packed.size < rows * line:
            return None
        flat = 1 - np.unpackbits(packed[: rows * line].reshape(rows, line), axis=1)[:, :columns]
    elif kind == b"P1":
        signs = [x - 48 for x in data[at:] if x in b"01"]
        flat = 1 - np.array(signs[:count], "i8")
    else:
        flat = np.array(data[at:].split()[:count], "i8")
    if flat.size < count:
        return None
    return flat.reshape(shape).astype("u1") if top == 255 else (flat.reshape(shape).astype("f8") * 255 / top).round().astype("u1")


def run_lengths(data: bytes, columns: int, rows: int, bits: int) -> np.ndarray:
    """Colour numbers of run-length coded lines, bottom line first; what a file skips is colour 0."""
    grid = np.zeros((rows, columns), "u1")
    x = y = at = 0

    def put(values: np.ndarray) -> None:
        nonlocal x
        if y < rows:
            some = values[: max(0, columns - x)]
            grid[y, x : x + len(some)] = some
        x += len(values)

    def split(part: bytes, n: int) -> np.ndarray:
        found = np.frombuffer(part, "u1")
        return found[:n] if bits == 8 else np.stack([found >> 4, found & 15], 1).ravel()[:n]

    while at + 1 < len(data):
        n, code = data[at], data[at + 1]
        at += 2
        if n:
            put(split(bytes([code]) * n, n))
        elif code == 0:
            x, y = 0, y + 1
        elif code == 1:
            break
        elif code == 2:
            x, y, at = x + data[at], y + data[at + 1], at + 2
        else:
            size = code if bits == 8 else -(-code // 2)
            put(split(data[at : at + size], code))
            at += size + size % 2
    return grid


def read_bmp(data: bytes) -> np.ndarray | None:
    """BMP as 8-bit samples: 1, 4 or 8 bits with a palette, plain or run-length coded; 16, 24 or 32 bits, also with masks."""
    number = lambda at, n, signed=False: int.from_bytes(data[at : at + n], "little", signed=signed)
    start, head = number(10, 4), number(14, 4)
    old = head == 12
    columns, rows, bits = (number(18, 2), number(20, 2), number(24, 2)) if old else (number(18, 4, True), number(22, 4, True), number(28, 2))
    packing = 0 if old else number(30, 4)
    coded = (packing, bits) in ((1, 8), (2, 4))
    if not (coded or packing in (0, 3, 6)) or bits not in (1, 4, 8, 16, 24, 32) or columns <= 0 or not rows or (packing in (3, 6) and bits not in (16, 32)):
        return None
    height, line = abs(rows), -(-columns * bits // 32) * 4
    body = data[start:] if coded else data[start : start + line * height]
    if not coded and len(body) < line * height:
        return None
    if bits <= 8:
        if coded:
            grid = run_lengths(body, columns, height, bits)
        else:
            raw = np.frombuffer(body, "u1").reshape(height, line)
            places = np.arange(columns) * bits
            grid = raw[:, places // 8] >> (8 - bits - places % 8).astype("u1") & ((1 << bits) - 1)
        grid = grid[::-1] if rows > 0 else grid
        wide, first = 3 if old else 4, 14 + head
        count = (0 if old else number(46, 4)) or 1 << bits
        palette = np.frombuffer(data[first : first + wide * count][: max(0, start - first) // wide * wide], "u1").reshape(-1, wide)[:, 2::-1]
        if not len(palette):
            return None
        colours = palette[np.minimum(grid, len(palette) - 1)]
        return colours[..., 0] if (palette == palette[:, :1]).all() else colours
    if bits == 24 or (bits == 32 and not packing):
        grid = np.frombuffer(body, "u1").reshape(height, line)[:, : columns * bits // 8].reshape(height, columns, bits // 8)[..., 2::-1]
        return grid[::-1] if rows > 0 else grid
    pixels = np.frombuffer(body, f"<u{bits // 8}").reshape(height, -1)[:, :columns].astype("u4")
    masks = [number(54 + 4 * k, 4) for k in range(3)] if packing else [0x7C00, 0x3E0, 0x1F]
    if not all(masks):
        return None
    low = [m & -m for m in masks]
    grid = np.stack([((pixels & m) // f * 255.0 / (m // f)).round().astype("u1") for m, f in zip(masks, low, strict=True)], -1)
    return grid[::-1] if rows > 0 else grid


def decode(data: bytes | None) -> np.ndarray | None:
    """The samples of a Netpbm or BMP file, None for anything else."""
    if not data or len(data) < 3:
        return None
    try:
        if data[:2] == b"BM":
            return read_bmp(data)
        if data[:1] == b"P" and data[1:2] in b"123456":
            return read_netpbm(data)
    except (ValueError, IndexError, OverflowError):
        return None
    return None


def area_resize(image: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Mean over the exact area that each output cell covers, by an integral image."""
    grey = image.astype("f8") if image.ndim == 2 else image.astype("f8") @ np.array([0.299, 0.587, 0.114])
    total = np.zeros((grey.shape[0] + 1, grey.shape[1] + 1))
    total[1:, 1:] = grey.cumsum(0).cumsum(1)

    def along(a: np.ndarray, n: int) -> np.ndarray:
        at = np.linspace(0, a.shape[0] - 1, n + 1)
        low = np.minimum(at.astype("i8"), a.shape[0] - 2)
        part = (at - low)[:, None]
        return np.diff(a[low] * (1 - part) + a[low + 1] * part, axis=0)

    cells = along(along(total, rows).T, columns).T
    return cells * (rows * columns) / (grey.shape[0] * grey.shape[1])


def difference_hash(image: np.ndarray) -> str:
    """64 bits, 16 hex digits: whether each cell of an 8 x 9 area resize is darker than its right neighbour."""
    cells = area_resize(image, HASH_ROWS, HASH_COLUMNS).round(6)
    return np.packbits(cells[:, :-1] < cells[:, 1:]).tobytes().hex()


def to_npy(image: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(image), version=(1, 0), allow_pickle=False)
    return out.getvalue()


def from_npy(data: bytes) -> np.ndarray:
    return np.lib.format.read_array(io.BytesIO(data), allow_pickle=False)


def payload_pgm(text: str) -> tuple[int, bytes]:
    """Bytes of the text, and a binary PGM of ``WIDTH`` columns that holds them, filled with zeros."""
    raw = text.encode("utf-8", "surrogatepass")
    rows = max(1, -(-len(raw) // WIDTH))
    return len(raw), b"P5\n%d %d\n255\n" % (WIDTH, rows) + raw.ljust(rows * WIDTH, b"\0")


def tile(media: bytes | None, rows: int | None = None, columns: int | None = None) -> tuple[bytes | None, str | None]:
    """NPY tile (resized where a size is given) and difference hash of one file."""
    image = decode(media)
    if image is None or not image.size:
        return None, None
    kept = image if rows is None else area_resize(image, rows, columns).round().astype("u1")
    stored = to_npy(kept)
    return stored, difference_hash(from_npy(stored))


def tiles(df: DataFrame, media: str, rows: int | None = None, columns: int | None = None) -> DataFrame:
    """``df`` with columns tile (NPY bytes) and dhash in place of the media column."""

    small_batches(df.sparkSession)

    @F.pandas_udf("tile binary, dhash string")
    def make(column: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([tile(None if x is None else bytes(x), rows, columns) for x in column], columns=["tile", "dhash"])

    return df.withColumn("__made", make(F.col(media))).select(*[c for c in df.columns if c != media], "__made.*")


def store_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts stored as PGM payloads, turned to NPY tiles, read back, with their features.

    Columns: key, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256 (of the NPY tile), feature (shape and difference
    hash), tile (the NPY bytes).
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, t in zip(batch["k"], batch["t"], strict=True):
                n, pgm = payload_pgm(t)
                stored, dhash = tile(pgm)
                back = from_npy(stored)
                payload = back.tobytes()
                out.append((k, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), f"{back.shape[0]}x{back.shape[1]}:{dhash}", stored))
            yield pd.DataFrame(out, columns=["k", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile"])

    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(f"`{key}`").alias("k"), text_of(text).alias("t"))
    made = rows.mapInPandas(work, f"k {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary")
    return made.withColumnRenamed("k", key)
