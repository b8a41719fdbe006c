"""Near-duplicate documents by MinHash with tensored banding.

A document's set is its distinct shingles of five words. Two collections of n (see ``tables``) short bands each are computed;
the key of table (i, j) joins band i of the first collection with band j of the second, so that n ** 2 tables cost
2 * n * BAND minhashes. Documents with equal sets are one class from the start. Classes that share a key are
candidates; the members of a candidate group meet with their full sets, are counted against each other through an inverted
list, and only edges of a spanning forest leave the task: members are linked with leaders first, and what these leave apart is
counted only where two pieces share one of their rarest shingles (see ``forest``). In a group beyond ``GROUP_SHINGLES`` each member first meets just those it shares the least place in
a key with, in parts of bounded size. If that leaves the group in several pieces, the members outside of its largest piece are
dealt into blocks, and each of these meets every other one and every block of the largest piece in a task of its own, so that
memory stays bounded and no pair is missed. Such parts are always shuffled.

Two documents that the definition links share no key with a probability of at most ``MISSED`` = 0.0004 at a similarity of
exactly the threshold, and less above: 2 * (1 - 0.85 ** 3) ** 9 with 9 bands at 0.85, 2 * (1 - 0.8 ** 3) ** 12 with 12 at 0.8.

Sets are compared by 128 bits of hash, shingles by 64.

Defined results: a text without words has an empty set and is linked with nothing; one of fewer than five words has its
whole sequence as its only shingle; rows that repeat an id are one node; a row without an id is linked with nothing, has no
component and is kept; a very long text is one document, whole; other columns aren't read, or pass through ``deduplicated``
whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Texts, as_bytes, chunks, frugal, mix64, spans_hash, stored
from .graph import components

SHINGLE, BAND, PERCENT, MISSED = 5, 3, 85, 0.0004
#: Shingles of a group that one task may hold.
GROUP_SHINGLES = 8_000_000
#: Rows of (id, group) up to which they are broadcast to the documents, one a member; beyond, both sides are shuffled.
BROADCAST_ROWS = 500_000


def tables(percent: int) -> int:
    """Bands of each collection: as few as miss a pair at the threshold with a probability of at most ``MISSED``."""
    return math.ceil(math.log(MISSED / 2) / math.log(1 - (percent / 100) ** BAND))


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, one after another, and how many each has."""
    t = Texts(texts)
    upper = (t.bytes >= 65) & (t.bytes <= 90)
    words = t.word_hashes(t.bytes + (upper * 32).astype(np.uint8))
    at, key = t.windows(words, SHINGLE)
    of = t.word_text()[at]
    short = np.flatnonzero((t.n_words > 0) & (t.n_words < SHINGLE))
    if len(short):
        key = np.concatenate([key, spans_hash(words, t.first_word[short], t.first_word[short] + t.n_words[short])])
        of = np.concatenate([of, short])
    order = np.lexsort((key, of))
    key, of = key[order], of[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
    return key[new], np.bincount(of[new], minlength=t.n)


def _bands(key: np.ndarray, sizes: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """Two digests and the bands (a row a text) of the texts that have shingles."""
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])[sizes > 0].astype(np.int64)
    one, two = np.add.reduceat(mix64(key), first), np.add.reduceat(mix64(key ^ np.uint64(0x5851F42D4C957F2D)), first)
    bands = np.zeros((len(first), 2 * n), np.uint64)
    multiply = mix64(np.arange(1, 2 * n * BAND + 1, dtype=np.uint64)) | np.uint64(1)
    add = mix64(np.arange(1001, 1001 + 2 * n * BAND, dtype=np.uint64))
    for k in range(2 * n * BAND):
        low = np.minimum.reduceat(key * multiply[k] + add[k], first)
        bands[:, k // BAND] = mix64(bands[:, k // BAND] * np.uint64(31) + low)
    return one, two, bands


def sketched(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, one, two (digests of the set), bands of every row."""
    n = tables(percent)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            ids, texts = b.column(0), as_bytes(b.column(1))
            for i, j in chunks(list(map(len, texts))):
                key, sizes = shingle_sets(texts[i:j])
                one, two, bands = np.zeros(j - i, np.uint64), np.zeros(j - i, np.uint64), np.zeros((j - i, 2 * n), np.uint64)
                if len(key):
                    one[sizes > 0], two[sizes > 0], bands[sizes > 0] = _bands(key, sizes, n)
                flat = pa.array(bands.view(np.int64).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * 2 * n), flat)
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(sizes.astype(np.int64)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), lists], names=["doc_id", "n_shingles", "one", "two", "bands"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(frugal(run), "doc_id long, n_shingles long, one long, two long, bands array<long>")


def _candidates(classes: DataFrame, n: int) -> DataFrame:
    """a, b: classes that share a table's key, each with the least one of that key."""
    keys = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.xxhash64(i * n + j, F.get("bands", i), F.get("bands", j + n)))))
    rows = classes.select("rep", F.explode(keys).alias("key"))
    least = rows.groupBy("key").agg(F.min("rep").alias("b"), F.max("rep").alias("top")).where("b != top")
    return rows.join(least, "key").select(F.col("rep").alias("a"), "b").where("a != b").distinct()


def _leaders(own: list[np.ndarray], code: np.ndarray, of: np.ndarray, sizes: np.ndarray, percent: int, star: bool) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Each document's piece, and links with leaders: the first document, then the first that isn't linked with one.

    It ends with the first leader (a star) or once a leader wins less than a hundredth of the rest.
    """
    mark, piece, edges = np.zeros(len(code) and code.max() + 1, bool), np.full(len(own), -1), []
    left = np.arange(len(own))
    while len(left):
        leader = int(left[0])
        mark[own[leader]] = True
        shared = np.bincount(of[mark[code]], minlength=len(own))[left]
        mark[own[leader]] = False
        near = left[(shared > 0) & (100 * shared >= percent * (sizes[left] + sizes[leader] - shared))]
        piece[near] = piece[leader] = leader
        edges += [(x, leader) for x in near.tolist() if x != leader]
        if star or 100 * len(near) < len(left):
            break
        left = left[piece[left] < 0]
    return np.where(piece < 0, np.arange(len(own)), piece), edges


def forest(ids: list[int], key: np.ndarray, sizes: np.ndarray, percent: int = PERCENT, labels: list[int] | None = None, star: bool = False) -> list[tuple[int, int]]:
    """Edges that connect the linked ones of some documents, given their sets one after another.

    Documents with equal labels are connected already, without labels those linked with a leader. Of the others only classes
    (see ``_classes``) of different pieces are counted, and only those that share one of their rarest shingles: each class has
    so many of these that it can't be linked with one that holds none. A star has only the links with the first document.
    """
    n = len(ids)
    _, code = np.unique(key, return_inverse=True)
    bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    of = np.repeat(np.arange(n), sizes)
    own = [code[i:j] for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    pairs: list[tuple[int, int]] = []
    if labels is None:
        piece, pairs = _leaders(own, code, of, sizes, percent, star)
        if star:
            return [(ids[x], ids[y]) for x, y in pairs]
    else:
        piece = np.array(labels)
    piece = np.unique(piece, return_inverse=True)[1]
    comp, inside = np.arange(n), [[p] for p in range(n)]  # of each piece, and the pieces of each component

    def join(docs: list[int]) -> None:
        for x in docs[1:]:
            p, q = sorted((int(comp[piece[x]]), int(comp[piece[docs[0]]])), key=lambda c: len(inside[c]))
            if p != q:
                comp[inside[p]] = q
                inside[q] += inside[p]
                pairs.append((x, docs[0]))

    need = -(-percent * sizes // 100)
    live, own, classes, code, of = _classes(code, of, sizes, need, n)
    if not len(live):
        return [(ids[x], ids[y]) for x, y in pairs]
    for c in classes:
        if len(c) > 1 and 100 * len(own[c[0]]) >= percent * (2 * sizes[c[0]] - len(own[c[0]])):
            join(c)
    first = np.array([c[0] for c in classes])
    one = np.array([len(np.unique(comp[piece[c]])) == 1 for c in classes])
    top = one & (piece[first] == np.argmax(np.bincount(piece[live])))
    number = np.full(n, -1)
    number[first] = np.arange(len(first))
    code, of = code[number[of] >= 0], number[of[number[of] >= 0]]
    # the rarest shingles of each class: its size less the overlap that any link needs, and one
    size = np.bincount(of, minlength=len(first))
    order = np.lexsort((code, np.bincount(code)[code], of))
    to = of[order]
    rare = order[np.arange(len(code)) - (np.cumsum(size) - size)[to] < (size - need[first] + 1)[to]]
    doc, token = of[rare], code[rare]
    by = np.lexsort((doc, token))
    doc, token = doc[by], token[by]
    head = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    many = np.diff(np.concatenate([head, [len(doc)]]))
    begin, end = np.repeat(head, many), np.repeat(head + many, many)
    asks = np.flatnonzero((end - begin > 1) & ~top[doc])
    asks = asks[np.argsort(doc[asks], kind="stable")]
    mark, full = np.zeros(code.max() + 1, bool), sizes[first]
    for at in np.split(asks, np.flatnonzero(np.diff(doc[asks])) + 1) if len(asks) else ():
        x = int(doc[at[0]])
        near = np.unique(np.concatenate([doc[begin[k] : end[k]] for k in at.tolist()]))
        near = near[((near < x) | top[near]) & ~(one[near] & one[x] & (comp[piece[first[near]]] == comp[piece[first[x]]]))]
        near = near[(100 * full[near] >= percent * full[x]) & (100 * full[x] >= percent * full[near])]
        if not len(near):
            continue
        mark[own[first[x]]] = True
        shared = np.add.reduceat(mark[np.concatenate([own[y] for y in first[near].tolist()])].astype(np.int64), np.concatenate([[0], np.cumsum(size[near])[:-1]]))
        mark[own[first[x]]] = False
        for y in near[100 * shared >= percent * (full[x] + full[near] - shared)].tolist():
            join(classes[y] + classes[x])
            one[x] = one[y] = True
    return [(ids[x], ids[y]) for x, y in pairs]


def _classes(code: np.ndarray, of: np.ndarray, sizes: np.ndarray, need: np.ndarray, n: int) -> tuple:
    """Documents that can be linked at all, the shingles that they share with others, and their classes.

    Shingles of one document alone go, and then documents with fewer left than a link needs. Documents of equal sizes that
    agree in all that is left are linked with the same ones, and form a class.
    """
    alive = np.ones(n, bool)
    while True:
        code, of = code[alive[of]], of[alive[of]]
        shared = np.bincount(code)[code] > 1
        code, of = code[shared], of[shared]
        size = np.bincount(of, minlength=n)
        fit = alive & (size >= need) & (size > 0)
        if (fit == alive).all():
            break
        alive = fit
    live = np.flatnonzero(alive)
    if not len(live):
        return live, {}, [], code, of
    start = (np.cumsum(size) - size)[live]
    one, two = (np.add.reduceat(mix64(code.astype(np.uint64) + np.uint64(k)), start) for k in (1, 1 << 40))
    order = np.lexsort((two, one, sizes[live]))
    same = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1]) & (np.diff(sizes[live][order]) == 0)
    classes = [live[c].tolist() for c in np.split(order, np.flatnonzero(~same) + 1)]
    heads = [c[0] for c in classes]
    at = np.cumsum(size) - size
    return live, {h: code[at[h] : at[h] + size[h]] for h in heads}, classes, code, of


def _linked(groups: DataFrame, percent: int, star: bool = False) -> DataFrame:
    """a, b: confirmed edges in each group of (part, doc_id, text, label), where labels are null in all or none of a group."""

    def run(batches):
        import pyarrow as pa

        part, ids, texts, labels = None, [], [], []

        def done():
            edges = forest(ids, *shingle_sets(texts), percent, None if labels[0] is None else labels, star) if len(ids) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for b in batches:
            for p, i, t, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), as_bytes(b.column(2)), b.column(3).to_pylist(), strict=True):
                if p != part:
                    if len(ids) > 1:
                        yield done()
                    part, ids, texts, labels = p, [], [], []
                ids.append(i)
                texts.append(t)
                labels.append(c)
        if len(ids) > 1:
            yield done()

    return groups.repartition("part").sortWithinPartitions("part", "doc_id").select("part", "doc_id", "text", "label").mapInArrow(frugal(run), "a long, b long")


def _star_parts(large: DataFrame, candidates: DataFrame) -> DataFrame:
    """a, part, label (null): members of large groups with a candidate of theirs, the least id of its part."""
    pairs = candidates.join(large.select("a", "own"), "a")
    total = pairs.groupBy("b").agg(F.ceil(F.sum("own") / (GROUP_SHINGLES // 2)).alias("parts"))
    rows = pairs.join(total, "b").select("a", "b", F.xxhash64("b", F.pmod(F.xxhash64("a"), F.col("parts"))).alias("part"))
    return rows.select("a", "part").unionByName(rows.select(F.col("b").alias("a"), "part").distinct()).withColumn("label", F.lit(None).cast("long"))


def _block_parts(large: DataFrame, pieces: DataFrame) -> DataFrame:
    """a, part, label: blocks that meet, of those large groups that are in several pieces (a, b as in components)."""
    rows = large.join(pieces.select("a", F.col("b").alias("piece")), "a", "left").withColumn("label", F.coalesce("piece", "a"))
    sums = rows.groupBy("b", "label").agg(F.sum("own").alias("n"))
    top = sums.groupBy("b").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("n")).where("n > top.n")
    blocks = lambda n: F.ceil(n / (GROUP_SHINGLES // 2)).cast("int")
    top = top.select("b", F.col("top.label").alias("top"), blocks(F.col("n") - F.col("top.n")).alias("few"), blocks(F.col("top.n")).alias("most"))
    rows = rows.select("a", "b", "label").join(top, "b")
    at = lambda n: F.pmod(F.xxhash64("a"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias("q")
    others, largest = rows.where("label != top"), rows.where("label = top")
    parts = (
        others.select("a", "b", "label", at("few").alias("p"), each("few")).select("a", F.xxhash64("b", F.lit(0), F.least("p", "q"), F.greatest("p", "q")).alias("part"), "label"),
        others.select("a", "b", "label", at("few").alias("p"), each("most")).select("a", F.xxhash64("b", F.lit(1), "p", "q").alias("part"), "label"),
        largest.select("a", "b", "label", at("most").alias("p"), each("few")).select("a", F.xxhash64("b", F.lit(1), "q", "p").alias("part"), "label"),
    )
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def linked_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """The sketch of every row, and (a, b): each document but the least of its component, with that least one."""
    sketch = stored(sketched(docs, doc_id, text, percent))
    own = sketch.where("n_shingles > 0 and doc_id is not null")
    classes = stored(own.groupBy("n_shingles", "one", "two").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")))
    candidates = stored(_candidates(classes, tables(percent)))
    near = components(candidates)
    group = near.unionByName(near.select(F.col("b").alias("a"), "b").distinct()).join(classes.select(F.col("rep").alias("a"), F.col("n_shingles").alias("own")), "a")
    group = stored(group.join(group.groupBy("b").agg(F.sum("own").alias("n")), "b").select("a", "b", "own", "n"))
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    met = lambda parts: texts.join(parts, F.col("doc_id") == F.col("a"))
    parts = group.where(F.col("n") <= GROUP_SHINGLES).select("a", F.xxhash64("b").alias("part"), F.lit(None).cast("long").alias("label"))
    edges = _linked(met(F.broadcast(parts) if parts.count() <= BROADCAST_ROWS else parts), percent)
    large = group.where(F.col("n") > GROUP_SHINGLES)
    if not large.isEmpty():
        stars = stored(_linked(met(_star_parts(large, candidates).hint("merge")), percent, star=True))
        edges = edges.unionByName(stars).unionByName(_linked(met(_block_parts(large, components(stars)).hint("merge")), percent))
    edges = edges.unionByName(own.join(classes.select("n_shingles", "one", "two", "rep"), ["n_shingles", "one", "two"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    return sketch, components(edges)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the least id of its component), kept, for every row."""
    sketch, of = linked_components(docs, doc_id, text, percent)
    least = F.coalesce("b", "doc_id")
    return sketch.select("doc_id", "n_shingles").join(of, F.col("doc_id") == F.col("a"), "left").select("doc_id", "n_shingles", least.alias("component_id"), F.coalesce(F.col("doc_id") == least, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """One document of each component, the one of the smallest id, with all its columns whatever their names.

    Here a node is an id with its text, so texts that share an id, or have none, are documents of their own; of rows that
    agree in both one stays. Ids come before none, and the text's hash decides between equal ids.
    """
    of_row = F.xxhash64(F.col(doc_id).cast("long"), F.coalesce(F.col(text), F.lit("")), F.col(text).isNull())
    nodes = docs.select(of_row.alias("node"), F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    sketch, of = linked_components(nodes, "node", "text", percent)
    group = of.unionByName(of.select(F.col("b").alias("a"), "b").distinct()).withColumnRenamed("a", "node")
    ranked = nodes.select("node", "id").join(group, "node").select("b", F.struct(F.col("id").isNull(), "id", "node").alias("place"))
    first = ranked.groupBy("b").agg(F.min("place").alias("place")).select("b", F.col("place.node").alias("kept"))
    dropped = stored(group.join(first, "b").where("node != kept").select("node"))
    rows = docs.select(F.struct("*").alias("row"), of_row.alias("node")).join(dropped, "node", "left_anti")
    twice = stored(sketch.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("node")))
    if not twice.isEmpty():
        again = rows.join(twice, "node", "left_semi").groupBy("node").agg(F.first("row").alias("row"))
        rows = rows.join(twice, "node", "left_anti").select("node", "row").unionByName(again)
    return rows.select("row.*")
