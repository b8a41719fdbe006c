"""Best-fit packing of token sequences, in bulk-synchronous rounds.

Pieces are range-sorted by length, longest first, which gives each a rank; gaps are kept sorted as well, as runs of equal
gaps. A round takes the pieces of one length and sweeps over the gaps upward from that length: each run of gaps takes the
next ranks, as many pieces a gap as fit, and moves to its new, smaller size; pieces that find no gap open new sequences.
Lengths and gaps are at most the capacity, so the sweeps hold a few thousand runs whatever the number of documents: they
are made over counts. Only then does each piece, wherever it is, look up its place by its rank. Ranks decide between pieces
of equal length. Pieces are as good as best-fit decreasing places them, since that can't tell equal lengths apart either.

Defined results: a null or empty text is the end id alone; a text longer than the capacity is cut into full pieces and a
last one; repeated rows are packed each; pieces of equal length are ranked by id, piece and
place; other columns aren't read; an empty table gives an empty one.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import Encoder, WordLevel
from .common import as_bytes, chunks, frugal, stored
from .tokens import vocabulary

CAPACITY, END = 4096, 1


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, doc_id: str = "doc_id", text: str = "text", ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, row (a number of the row, which tells copies apart) and the zipped ids of each piece of each row."""

    def run(batches):
        import pyarrow as pa
        import zstandard

        zip_ = zstandard.ZstdCompressor(level=1).compress
        encode, end = Encoder(path or vocabulary("word_bpe_49k.json"), WordLevel), END.to_bytes(4, "little")
        for b in batches:
            keys, texts, numbers = b.column(0).to_pylist(), as_bytes(b.column(1)), b.column(2).to_pylist()
            for i, j in chunks(list(map(len, texts))):
                rows = []
                for key, number, own in zip(keys[i:j], numbers[i:j], encode([t.decode() for t in texts[i:j]]), strict=True):
                    own += end
                    for k, at in enumerate(range(0, len(own), 4 * capacity)):
                        part = own[at : at + 4 * capacity]
                        rows.append((key, k, at // 4, len(part) // 4, zlib.crc32(part), *((number, zip_(part)) if ids else ())))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=False)], names=["doc_id", "piece", "start", "length", "ids_crc32", "row", "zipped"][: 5 + 2 * ids])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row"))
    return rows.mapInArrow(frugal(run), "doc_id long, piece int, start long, length long, ids_crc32 long" + ", row long, zipped binary" * ids)


def rounds(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Where each run of ranks goes: first rank, first sequence, pieces a sequence, offset, length; ordered by first rank."""
    gaps: dict[int, list[tuple[int, int]]] = {}
    sizes: list[int] = []  # the keys of gaps, ascending
    out, rank, opened = [], 0, 0

    def add(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                gaps[gap] = []
                insort(sizes, gap)
            gaps[gap].append((first, n))

    def fill(gap: int, first: int, n: int, left: int, length: int) -> int:
        """Puts at most so many pieces into n sequences of this gap; how many it put there."""
        nonlocal rank
        each = gap // length
        full, rest = (n, 0) if n * each <= left else divmod(left, each)
        if full:
            out.append((rank, first, each, capacity - gap, length))
            rank += full * each
            add(gap - each * length, first, full)
        if rest:
            out.append((rank, first + full, rest, capacity - gap, length))
            rank += rest
            add(gap - rest * length, first + full, 1)
        used = full + bool(rest)
        add(gap, first + used, n - used)
        return full * each + rest

    for length in sorted(counts, reverse=True):
        left = counts[length]
        at = bisect_left(sizes, length)
        while left and at < len(sizes):
            gap = sizes.pop(at)
            runs = gaps.pop(gap)
            while left and runs:
                left -= fill(gap, *runs.pop(), left, length)
            for r in runs:
                add(gap, *r)
            at = bisect_left(sizes, max(length, gap + 1 if not left else gap))
        if left:
            n = -(-left // (capacity // length))
            fill(capacity, opened, n, left, length)
            opened += n
    return np.array(out, np.int64).reshape(-1, 5)


def placed(items: DataFrame, capacity: int = CAPACITY, length: str = "length") -> DataFrame:
    """items with sequence_id and offset; every length is between 1 and the capacity. Ties go by the other columns that aren't binary."""
    others = [c for c, kind in items.dtypes if c != length and kind != "binary"]
    by = [F.col(length).desc(), *(F.col(c) for c in others)]
    ranged = items.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id())
    ranged = stored(ranged)  # ranges are drawn anew when they are computed anew
    part, row = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    sizes = dict(ranged.groupBy(part.cast("int").alias("p")).count().collect())  # a number a partition
    first = np.zeros(max(sizes, default=0) + 2, np.int64)
    for p, n in sizes.items():
        first[p + 1] = n
    first = np.cumsum(first)
    names = [*items.columns, "sequence_id", "offset"]
    runs = rounds(dict(ranged.groupBy(length).count().collect()), capacity)  # at most the capacity's number of lengths

    def run(batches):
        import pyarrow as pa

        for b in batches:
            own = b.column(b.num_columns - 2).to_numpy(zero_copy_only=False)
            rank = first[own] + b.column(b.num_columns - 1).to_numpy(zero_copy_only=False)
            r = runs[np.searchsorted(runs[:, 0], rank, "right") - 1]
            k = rank - r[:, 0]
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(r[:, 1] + k // r[:, 2]), pa.array(r[:, 3] + k % r[:, 2] * r[:, 4])], names=names)

    schema = T.StructType([*items.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranged.select(*items.columns, part.cast("int").alias("__part"), row.alias("__row")).mapInArrow(frugal(run), schema)


def packed(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, doc_id: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of the documents; with their row and ids if asked for."""
    where = placed(stored(pieces(docs, capacity, path, doc_id, text, ids)), capacity)
    if not ids:
        return where
    names = [c for c in where.columns if c != "zipped"]

    def run(batches):
        import pyarrow as pa
        import zstandard

        unzip = zstandard.ZstdDecompressor().decompress
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                own = [np.frombuffer(unzip(z), "<u4") for z in part.column(len(names)).to_pylist()]
                bounds = np.cumsum([0, *map(len, own)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(own).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists], names=[*names, "ids"])

    schema = T.StructType([*where.select(*names).schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return where.select(*names, "zipped").mapInArrow(frugal(run), schema)


def sequences(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """sequence_id and the ids of each whole sequence; a sequence has at most the capacity, so groups are bounded."""
    parts = packed(docs, capacity, path, ids=True).groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten("parts.ids").alias("ids"))
