"""Removal of repeated passages: every byte covered by a string of ``LENGTH`` bytes that also starts earlier.

1. Anchors. In every window of ``LENGTH`` bytes the ``GRAM``-gram of least hash is its anchor, so equal windows have equal
   anchors at equal places in them. An anchor occurrence, with the consecutive windows that it anchors, is one row: the
   anchor's hash and the hash of the bytes under those windows (its context).
2. Equal contexts. Of occurrences with equal contexts all but the earliest are covered. Each chunk of documents settles
   this for its own occurrences first, so that a passage in very many documents reaches the shuffle once a chunk.
3. Different contexts of one anchor. Their bytes are gathered by anchor; shards of them are sorted alone, their
   Burrows-Wheeler transforms merged by interleave refinement (see ``bwt``), and the blocks of rows that share
   ``LENGTH`` symbols are the repeated strings: all but the earliest in a block are covered. An anchor with more than
   ``MOST_CONTEXTS`` contexts doesn't meet in one task: each of its windows goes where its own hash sends it, without its
   bytes, and all but the earliest of equal hashes are covered; each batch settles its own windows first.
4. The covered ranges of a document meet its text and are cut out.

A document is an id with its text, known by the id and a 64-bit hash of the text (its mark), which also decides between
documents of one id. Strings are equal if two 64-bit hashes are, that of their anchor and their own, or byte for byte where
they are merged.

Defined results: a null or empty text has nothing to remove; repeated rows (equal id and text) are one document and keep
equally much; rows that repeat an id with other texts are documents of their own; rows without an id come before all others,
in the order of their marks; a very long text is one document like any other; extra columns pass through ``without_repeats``
whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bwt import earlier
from .common import as_bytes, byte_hashes, chunks, frugal, sliding_hashes, stored

LENGTH, GRAM = 100, 32
#: Bytes of contexts that are merged at once; the contexts of one anchor stay together.
BLOCK_BYTES = 1 << 17
#: Contexts of an anchor that one merge may hold; beyond, its windows meet by their own hashes.
MOST_CONTEXTS = 1 << 13
_NO_ID = -(1 << 63)
_NUM_BITS, _LOW = 8, 255  # a place and a number of windows in one long


def least_in_windows(value: np.ndarray, width: int) -> np.ndarray:
    """The least of each so many consecutive values."""
    step, low = 1, value
    while 2 * step <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    rest = width - step
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def anchored(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """By anchor occurrence: text number, first window's start in it, number of windows, anchor hash, context hash."""
    keep = [i for i, t in enumerate(texts) if len(t) >= LENGTH]
    none = tuple(np.zeros(0, np.int64) for _ in range(3)) + (np.zeros(0, np.uint64),) * 2
    if not keep:
        return none
    data = np.frombuffer(b"".join(texts[i] for i in keep), np.uint8)
    lengths = np.fromiter((len(texts[i]) for i in keep), np.int64, len(keep))
    ends = np.cumsum(lengths)
    n = len(data)
    at = np.arange(n - GRAM + 1)
    bits = np.uint64(max(1, int(n).bit_length()))
    gram = sliding_hashes(data, GRAM)
    value = gram >> bits << bits | at.astype(np.uint64)  # the place decides between equal ones
    anchor = (least_in_windows(value, LENGTH - GRAM + 1) & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    window = np.arange(len(anchor))
    of = np.repeat(np.arange(len(keep)), lengths)[: len(anchor)]
    whole = window + LENGTH <= ends[of]
    window, anchor, of = window[whole], anchor[whole], of[whole]
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (of[1:] != of[:-1])]))
    first, last = window[new], window[np.concatenate([new[1:], [len(window)]]) - 1]
    return np.array(keep)[of[new]], first - (ends - lengths)[of[new]], last - first + 1, gram[anchor[new]], byte_hashes(data, first, last + LENGTH)


def _anchors(docs: DataFrame) -> DataFrame:
    """anchor, context, doc, mark, place of each occurrence; without a context, those that their chunk has shown to be covered."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            ids, marks, texts = b.column(0).to_numpy(), b.column(1).to_numpy(), as_bytes(b.column(2))
            for i, j in chunks(list(map(len, texts)), 8 << 20):
                cols = []
                for p, q in chunks(list(map(len, texts[i:j]))):
                    of, first, n, anchor, context = anchored(texts[i + p : i + q])
                    cols.append((ids[i + p + of], marks[i + p + of], first << _NUM_BITS | n, anchor, context))
                own = [np.concatenate(c) for c in zip(*cols, strict=True)]
                order = np.lexsort((own[2], own[1], own[0], own[4], own[3]))
                doc, mark, place, anchor, context = (c[order] for c in own)
                same = np.zeros(len(doc), bool)
                same[1:] = (anchor[1:] == anchor[:-1]) & (context[1:] == context[:-1])
                late = same & _apart(same, doc, mark, place)
                yield pa.RecordBatch.from_arrays([pa.array(np.where(late, mark, anchor.view(np.int64))), pa.array(context.view(np.int64), mask=late), pa.array(doc), pa.array(mark), pa.array(place)], names=["anchor", "context", "doc", "mark", "place"])

    return docs.mapInArrow(frugal(run), "anchor long, context long, doc long, mark long, place long")


def _settled(anchors: DataFrame) -> DataFrame:
    """doc, mark, place, anchor, hot: covered occurrences (without an anchor), and the first ones of each context if the anchor has several."""
    by = "PARTITION BY anchor, context"
    seen = anchors.repartition("anchor").selectExpr(
        "*",
        *(f"first_value({c}) OVER ({by} ORDER BY doc, mark, place) AS first_{c}" for c in ("doc", "mark", "place")),
        "min(context) OVER (PARTITION BY anchor) != max(context) OVER (PARTITION BY anchor) AS several",
    )
    late = "(context IS NULL OR doc != first_doc OR mark != first_mark OR place != first_place)"
    counted = seen.selectExpr("*", f"{late} AS late").selectExpr("*", "count_if(NOT late) OVER (PARTITION BY anchor) AS contexts")
    return counted.where("late OR several").selectExpr("doc", "mark", "place", "CASE WHEN NOT late THEN anchor END AS anchor", f"NOT late AND contexts > {MOST_CONTEXTS} AS hot").distinct()


def _zipped(docs: DataFrame) -> DataFrame:
    """doc, mark, zipped: the texts, compressed for the shuffle."""

    def run(batches):
        import pyarrow as pa
        import zstandard

        zip_ = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array([zip_(t) for t in as_bytes(b.column(2))], pa.binary())], names=["doc", "mark", "zipped"])

    return docs.mapInArrow(frugal(run), "doc long, mark long, zipped binary")


def _unzip():
    import zstandard

    return zstandard.ZstdDecompressor().decompress


def _contexts(docs: DataFrame, several: DataFrame) -> DataFrame:
    """key, anchor, doc, mark, place, bytes of each occurrence whose anchor has several contexts, the key being the anchor.

    Those of a hot anchor give a row a window, the key being the window's hash: without bytes, or with none in them if an
    earlier window of the same batch equals it.
    """
    wanted = several.groupBy("doc", "mark").agg(F.collect_list(F.struct("anchor", "place", "hot")).alias("wanted"))

    def run(batches):
        import pyarrow as pa

        names = ["key", "anchor", "doc", "mark", "place", "bytes"]

        def rows(*cols):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "bytes" else pa.int64()) for c, n in zip(cols, names, strict=True)], names=names)

        unzip = _unzip()
        for b in batches:
            hot: list[tuple] = []
            for doc, mark, zipped, own in zip(*(c.to_pylist() for c in b.columns), strict=True):
                text, out = unzip(zipped), []
                for w in own:
                    first, n = w["place"] >> _NUM_BITS, w["place"] & _LOW
                    context = text[first : first + n + LENGTH - 1]
                    if w["hot"]:
                        at = np.arange(max(0, min(n, len(context) - LENGTH + 1)))
                        hot.append((byte_hashes(np.frombuffer(context, np.uint8), at, at + LENGTH).view(np.int64), *(np.full(len(at), x) for x in (w["anchor"], doc, mark)), (first + at) << _NUM_BITS | 1))
                    else:
                        out.append((w["anchor"], w["anchor"], doc, mark, w["place"], context))
                if out:
                    yield rows(*zip(*out, strict=True))
            if hot:
                own = [np.concatenate(c) for c in zip(*hot, strict=True)]
                order = np.lexsort(own[::-1])
                key, anchor, doc, mark, place = (c[order] for c in own)
                same = np.zeros(len(key), bool)
                same[1:] = (key[1:] == key[:-1]) & (anchor[1:] == anchor[:-1])
                late = _apart(same, doc, mark, place)
                yield rows(np.where(late, mark, key), anchor, doc, mark, place, [b"" if x else None for x in late.tolist()])

    return _zipped(docs).join(wanted, ["doc", "mark"]).select("doc", "mark", "zipped", "wanted").mapInArrow(frugal(run), "key long, anchor long, doc long, mark long, place long, bytes binary")


def _apart(same: np.ndarray, *place: np.ndarray) -> np.ndarray:
    """Which rows lie elsewhere than the first one of their group; same: which rows go on with the group before them."""
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))
    return np.logical_or.reduce([p != p[head] for p in place])


def _repeated(contexts: DataFrame) -> DataFrame:
    """doc, mark, place: ranges of windows (with their number) that an earlier window of another context equals."""

    def run(batches):
        import pyarrow as pa

        held: list[tuple] = []
        size = 0
        first: tuple = (None,) * 6  # the first of equal windows

        def done():
            _, _, doc, mark, place, parts = zip(*held, strict=True)
            doc, mark, place = np.array(doc, np.int64), np.array(mark, np.int64), np.array(place, np.int64)
            n = np.minimum(place & _LOW, np.fromiter(map(len, parts), np.int64, len(parts)) - LENGTH + 1)
            turn = np.unique(np.stack([doc, mark], axis=1), axis=0, return_inverse=True)[1].ravel()
            part, at = earlier(list(parts), n, turn, place >> _NUM_BITS, LENGTH)
            order = np.lexsort((at, part))
            part, at = part[order], at[order]
            new = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (at[1:] != at[:-1] + 1)])) if len(part) else np.zeros(0, np.int64)
            runs = np.diff(np.concatenate([new, [len(part)]]))
            return pa.RecordBatch.from_arrays([pa.array(doc[part[new]]), pa.array(mark[part[new]]), pa.array(((place[part[new]] >> _NUM_BITS) + at[new]) << _NUM_BITS | runs)], names=["doc", "mark", "place"])

        for b in batches:
            late = []
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not row[5]:
                    if row[5] is None and row[:2] != first[:2]:
                        first = row
                    elif row[5] is not None or row[2:5] != first[2:5]:
                        late.append(row[2:5])
                    continue
                if size > BLOCK_BYTES and row[0] != held[-1][0]:
                    yield done()
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
            if late:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*late, strict=True)], names=["doc", "mark", "place"])
        if len(held) > 1:
            yield done()

    return contexts.repartition("key").sortWithinPartitions("key", "anchor", "doc", "mark", "place").mapInArrow(frugal(run), "doc long, mark long, place long")


def _ids(docs: DataFrame, doc_id: str, text: str) -> tuple:
    """doc, mark, text as columns."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(_NO_ID)).alias("doc"), F.xxhash64(whole).alias("mark"), whole.alias("text")


def covered(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, mark, places: of each document with covered bytes, its ranges of repeated windows."""
    rows = docs.select(*_ids(docs, doc_id, text))
    settled = stored(_settled(_anchors(rows)))
    late = settled.where("anchor IS NULL").select("doc", "mark", "place")
    again = _repeated(_contexts(rows, settled.where("anchor IS NOT NULL")))
    return late.unionByName(again).groupBy("doc", "mark").agg(F.collect_list("place").alias("places"))


def spans(places: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal covered ranges of a text of so many bytes."""
    first = np.minimum(places >> _NUM_BITS, size)
    last = np.minimum(first + (places & _LOW) + LENGTH - 1, size)
    order = np.argsort(first, kind="stable")
    first, last = first[order], np.maximum.accumulate(last[order])
    new = np.concatenate([[True], first[1:] > last[:-1]]) if len(first) else np.zeros(0, bool)
    return first[new], last[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(last) - 1]])] if len(first) else last


def cut(text: bytes, places: list[int] | None) -> tuple[bytes, int]:
    """What is left of a text, and the number of spans removed."""
    if not places:
        return text, 0
    first, last = spans(np.array(places, np.int64), len(text))
    return b"".join(text[a:b] for a, b in zip([0, *last.tolist()], [*first.tolist(), len(text)], strict=True)), len(first)


def removed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""

    def run(batches):
        import pyarrow as pa

        unzip = _unzip()
        for b in batches:
            out = []
            for doc, zipped, places in zip(*(c.to_pylist() for c in b.columns), strict=True):
                whole = unzip(zipped)
                left, n = cut(whole, places)
                out.append((None if doc == _NO_ID else doc, len(whole), len(whole) - len(left), n, hashlib.sha256(left).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(),) * 4 + (pa.string(),))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = _zipped(docs.select(*_ids(docs, doc_id, text))).join(covered(docs, doc_id, text), ["doc", "mark"], "left").select("doc", "zipped", "places")
    return rows.mapInArrow(frugal(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The documents, with all their columns, and the repeated bytes cut out of their texts.

    A cut may fall within a character; what is left of such a character is dropped from the text. Lengths in n_chars, where
    that column exists, are counted again. A null text stays null.
    """
    schema, at, out = docs.schema, docs.columns.index(text), docs.columns
    chars = out.index(n_chars) if n_chars in out else None

    def run(batches):
        import pyarrow as pa

        for b in batches:
            cols, places = b.column(0).flatten(), b.column(1).to_pylist()
            texts = cols[at].to_pylist()
            new = [t if t is None or not p else cut(t.encode(), p)[0].decode(errors="ignore") for t, p in zip(texts, places, strict=True)]
            cols[at] = pa.array(new, cols[at].type)
            if chars is not None:
                cols[chars] = pa.array([c if t is None or not p else len(t) for c, t, p in zip(cols[chars].to_pylist(), new, places, strict=True)], cols[chars].type)
            yield pa.RecordBatch.from_arrays(cols, names=out)

    rows = docs.select(F.struct("*").alias("row"), *_ids(docs, doc_id, text)[:2])
    return rows.join(covered(docs, doc_id, text), ["doc", "mark"], "left").select("row", "places").mapInArrow(frugal(run), T.StructType(schema.fields))
