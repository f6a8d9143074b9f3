"""What the text operators share: input, tables in the shared folder, byte views and hashes."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.store import settled as stored

__all__ = ["ByteSums", "IS_SPACE", "LOWER", "as_long", "blocks", "cut_text", "documents", "free", "held_out", "mixed", "run_hashes", "stored", "text_bytes", "words"]

#: Bytes of text that a task works on at once; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def free(columns: list[str], name: str) -> str:
    """name, with underscores after it while a column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def held_out(doc_id: str = "doc_id", parts: int = 4) -> Column:
    """The rows that no model learns from: crc32 of the id as text leaves 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % parts == 2, F.lit(False))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column of strings, end to end, and where each text starts (and the last ends)."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    places = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[places[0] : places[-1]], places - places[0]


def blocks(batches: Iterator[pa.RecordBatch], text: str, limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows in blocks of at most limit bytes of text (or one row): the rows, their bytes, their starts."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, places = text_bytes(batch.column(batch.schema.get_field_index(text)))
        row = 0
        while row < batch.num_rows:
            last = max(row + 1, int(np.searchsorted(places, places[row] + limit, "right")) - 1)
            yield batch.slice(row, last - row), data[places[row] : places[last]], places[row : last + 1] - places[row]
            row = last


def mixed(h: np.ndarray) -> np.ndarray:
    """A finalizer for 64-bit hashes: every bit of the input reaches every bit of the output."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def as_long(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


class ByteSums:
    """Hashes of any run of a block's bytes from prefix sums modulo 2**64: byte values are replaced by
    random 64-bit numbers and weighed by powers of an odd base, whose inverse undoes the run's place."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, seed: int = 1):
        self.table = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.up = self.down = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            n = 1 << (n - 1).bit_length()
            powers = []
            for base in (self.BASE, pow(self.BASE, -1, 1 << 64)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                powers.append(np.multiply.accumulate(steps))
            self.up, self.down = powers

    def sums(self, data: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
        """table: another 256 numbers, as to read letters of both cases alike."""
        self.grow(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((self.table if table is None else table)[data] * self.up[: len(data)], out=sums[1:])
        return sums

    def runs(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((sums[end] - sums[start]) * self.down[start] + (end - start).astype(np.uint64))


#: Between a small letter and a blank before another every tokenizer at hand ends a word.
BETWEEN = re.compile("(?<=[a-z]) (?=[a-z])")


def cut_text(text: str, most: int = 1 << 20) -> Iterator[str]:
    """A text in parts of about most characters, cut before blanks between small letters; whole where it has none."""
    begin = 0
    while len(text) - begin > most:
        cut = BETWEEN.search(text, begin + most)
        if not cut:
            break
        yield text[begin : cut.start()]
        begin = cut.start()
    yield text[begin:] if begin else text


#: The low bytes of eight that a run still has.
LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def run_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, most: int = 64) -> np.ndarray:
    """A 64-bit hash of every run of bytes of data: eight bytes at a time through the finalizer, so that runs of one
    length of up to eight bytes never collide; runs of more than `most` bytes by BLAKE2b."""
    size = end - start
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    h = mixed(size.astype(np.uint64) + np.uint64(1))
    rows = np.flatnonzero((size > 0) & (size <= most))
    for k in range(0, most, 8):
        if not len(rows):
            break
        h[rows] = mixed((h[rows] + np.uint64(0x9E3779B97F4A7C15)) ^ (eight[start[rows] + k] & LOW[np.minimum(size[rows] - k, 8)]))
        rows = rows[size[rows] > k + 8]
    for k in np.flatnonzero(size > most).tolist():
        h[k] = int.from_bytes(hashlib.blake2b(data[start[k] : end[k]].tobytes(), digest_size=8).digest(), "little")
    return h


#: A to Z as a to z; space and 0x09 to 0x0D part words.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
IS_SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])


def words(data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every run of bytes that are no white space, none across texts; and how many words
    the texts before each text have."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(places), np.int64)
    inside = ~IS_SPACE[data]
    first = np.empty(len(data), bool)
    first[0] = True
    first[1:] = ~inside[:-1]
    first[places[:-1][places[:-1] < len(data)]] = True
    start = np.flatnonzero(first & inside)
    last = np.empty(len(data), bool)
    last[-1] = True
    last[:-1] = first[1:]
    # a byte ends a word if the next one is white space or starts a text
    last[:-1] |= ~inside[1:]
    end = np.flatnonzero(last & inside) + 1
    return start, end, np.searchsorted(start, places)
