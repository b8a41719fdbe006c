"""Helpers shared by the training-data operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import shared_dir

#: The words of a text, everywhere in this subpackage.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a task turns into arrays at once; a longer text is taken alone, and whole.
CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """The same rows, read from a table in the shared folder: lineage ends there, and losing an executor loses nothing."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def frugal(run):
    """A task's function that gives free memory back when it ends: Python workers serve later stages, beside a full heap of the JVM."""

    def own(batches):
        import ctypes

        import pyarrow as pa

        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only where the C library has it
        if trim is not None:
            trim(0)

    return own


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


_BYTE_CODE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse, modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        have = _POWERS[base] = (both[0], both[1])
    return have[0][:n], have[1][:n]


def spans_hash(code: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of code[start:end] for each span, from one running sum."""
    n = len(code)
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(code * up[:n], out=total[1:])
    return mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Texts:
    """A chunk of texts as one byte array, each ended by a line feed, with the bounds of texts and words."""

    def __init__(self, texts: list[bytes]):
        self.n = len(texts)
        self.bytes = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8) if texts else np.zeros(0, np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, self.n)
        self.starts = np.concatenate([[0], np.cumsum(lengths + 1)])[: self.n].astype(np.int64)
        self.ends = self.starts + lengths
        word = ~_SPACE[self.bytes]
        edge = np.diff(np.concatenate([[0], word.view(np.int8), [0]]).astype(np.int8))
        self.word_starts = np.flatnonzero(edge == 1)
        self.word_ends = np.flatnonzero(edge == -1)
        self.is_word = word
        self.first_word = np.searchsorted(self.word_starts, self.starts)
        self.n_words = np.diff(np.concatenate([self.first_word, [len(self.word_starts)]])).astype(np.int64)

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """The number of flagged bytes of each text."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.ends] - total[self.starts]

    def per_words(self, flags: np.ndarray) -> np.ndarray:
        """The number of flagged words of each text."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.first_word + self.n_words] - total[self.first_word]

    def word_hashes(self, data: np.ndarray | None = None) -> np.ndarray:
        return spans_hash(_BYTE_CODE[self.bytes if data is None else data], self.word_starts, self.word_ends)

    def word_text(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.n_words)

    def windows(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts (word numbers) and hashes of the windows of k words that lie within one text."""
        m = len(hashes)
        if m < k:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        left = np.repeat(self.first_word + self.n_words, self.n_words) - np.arange(m)
        at = np.flatnonzero(left >= k)
        return at, spans_hash(hashes, at, at + k)


def byte_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return spans_hash(_BYTE_CODE[data], starts, ends)


def sliding_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """The byte hashes of all windows of so many bytes."""
    n = len(data)
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_CODE[data] * up[:n], out=total[1:])
    value = total[width:] - total[: n + 1 - width]
    value *= down[: len(value)]
    return mix64(value + np.uint64(width * 0xD6E8FEB86659FD93 % (1 << 64)))


def chunks(lengths: list[int], most: int = CHUNK_BYTES):
    """Slices of consecutive texts of about so many bytes together."""
    begin, total = 0, 0
    for i, n in enumerate(lengths):
        if i > begin and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(lengths):
        yield begin, len(lengths)


def as_bytes(column) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string column, none for null."""
    import pyarrow as pa

    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
