"""Runs of repeated words: repeated k-grams mask the text, Main and Lorentz's division finds the runs of what survives.

A run of period q is at least ``max(least, times * q)`` words long, so it overlaps itself, moved by q words, in at least k =
min over q of (max(least, times * q) - q) words: each of its words lies in a k-gram that its document holds twice. Words
outside of such k-grams are masked; the stretches between are divided at their middles, level by level. A run across a
middle m holds the q words before or after it, so the common extensions of (m, m + q) and (m - q, m) to both sides give it.
Extensions come from ranks of all windows of 1, 2, 4, ... words: they are exact. Hashes only mask, and equal grams have
equal ones. All nodes of a level, over all stretches of a chunk of texts, are extended at once.

Defined results: a null, empty or blank text has no words and no runs, and collapses to an empty one; rows are judged each on
its own, so repeated rows and ids, or none, get equal results; a stretch with several periods counts by its smallest; runs
that overlap are all given; a very long text is one text, taken whole; other columns aren't read; an empty table gives an
empty one.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import compress

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Texts, as_bytes, chunks, frugal, mix64

#: A run has so many words and so many periods, at least.
LEAST, TIMES = 6, 4
FOUND = "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def overlap(least: int = LEAST, times: int = TIMES) -> int:
    """The words in which any run overlaps itself, at least, when moved by its period."""
    return min(max(least, times * q) - q for q in range(1, least + 1))


def stretches(t: Texts, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and ends of the stretches of words that lie in repeated k-grams of their text."""
    at, gram = t.windows(t.word_hashes(), k)
    of = np.searchsorted(t.first_word, at, "right") - 1
    gram = mix64(gram + of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(gram)
    same = gram[order[1:]] == gram[order[:-1]]
    again = at[order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]] if len(at) else at
    n = len(t.word_starts)
    edge = np.bincount(again, minlength=n + 1) - np.bincount(again + k, minlength=n + 1)[: n + 1]
    inside = np.cumsum(edge)[:n] > 0
    new_text = np.zeros(n + 1, bool)
    new_text[t.first_word] = True
    before, after = np.concatenate([[False], inside[:-1]]), np.concatenate([inside[1:], [False]])
    first = np.flatnonzero(inside & (~before | new_text[:n]))
    end = np.flatnonzero(inside & (~after | new_text[1:])) + 1
    long = end - first >= least
    return first[long], end[long]


def _ranks(ids: np.ndarray, longest: int) -> list[np.ndarray]:
    """By j: the rank of each window of 2**j symbols, as long as any two are equal and a stretch may hold one."""
    out, step = [np.unique(ids, return_inverse=True)[1].astype(np.int32)], 1
    while 2 * step <= longest:
        r = out[-1]
        pair = r[:-step].astype(np.int64) * np.int64(int(r.max()) + 1) + r[step:]
        values, rank = np.unique(pair, return_inverse=True)
        if len(values) == len(pair):
            break
        out.append(rank.astype(np.int32))
        step *= 2
    return out


def _extended(ranks: list[np.ndarray], x: np.ndarray, y: np.ndarray, back: bool) -> np.ndarray:
    """How many symbols from x and y on (or before them, if back) are equal; x < y."""
    n = np.zeros(len(x), np.int64)
    for j in range(len(ranks) - 1, -1, -1):
        a, b = (x - n - (1 << j), y - n - (1 << j)) if back else (x + n, y + n)
        at = np.flatnonzero((a >= 0) & (b < len(ranks[j])))
        n[at[ranks[j][a[at]] == ranks[j][b[at]]]] += 1 << j
    return n


def runs_of(ids: np.ndarray, first: np.ndarray, end: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and periods of all runs, by start, then period, within stretches of ids between which an id occurs that nothing else has."""
    none = np.zeros(0, np.int64)
    if not len(first):
        return none, none, none
    ranks = _ranks(ids, int((end - first).max()))
    low, high, found = first, end, []
    while len(low):
        mid, most = (low + high) // 2, (high - low) // times
        node = np.repeat(np.arange(len(low)), most)
        period = np.arange(len(node)) - np.repeat(np.cumsum(most) - most, most) + 1
        for before in (0, 1):
            x = mid[node] - before * period
            near = (ids[x] == ids[x + period]) | (ids[x - 1] == ids[x + period - 1])
            x, q, own = x[near], period[near], node[near]
            s, e = x - _extended(ranks, x, x + q, True), x + q + _extended(ranks, x, x + q, False)
            # a run lies across the middle of one node that holds it whole: there it is taken
            ok = (e - s >= np.maximum(least, times * q)) & (s >= low[own]) & (e <= high[own])
            found.append((s[ok], e[ok], q[ok]))
        low, high = np.concatenate([low, mid]), np.concatenate([mid, high])
        long = high - low >= max(least, times)
        low, high = low[long], high[long]
    s, e, q = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((q, e, s))
    s, e, q = s[order], e[order], q[order]
    new = np.concatenate([[True], (s[1:] != s[:-1]) | (e[1:] != e[:-1])]) if len(s) else np.zeros(0, bool)
    s, e, q = s[new], e[new], q[new]
    order = np.lexsort((q, s))
    return s[order], e[order], q[order]


def in_texts(texts: list[bytes], least: int = LEAST, times: int = TIMES) -> tuple[Texts, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' words, and starts, ends and periods of their runs, numbered across texts."""
    t = Texts(texts)
    first, end = stretches(t, overlap(least, times), least)
    size = end - first
    # the stretches side by side, each with a number of its own before it, and one after all
    new = np.cumsum(size + 1) - size
    ids = np.zeros(int((size + 1).sum()) + 1, np.int64)
    ids[np.concatenate([new - 1, [len(ids) - 1]])] = -1 - np.arange(len(first) + 1)
    known: dict[bytes, int] = {}
    data = t.bytes.tobytes()
    for at, a, b in zip(new.tolist(), first.tolist(), end.tolist(), strict=True):
        ids[at : at + b - a] = [known.setdefault(data[x:y], len(known)) for x, y in zip(t.word_starts[a:b].tolist(), t.word_ends[a:b].tolist(), strict=True)]
    s, e, q = runs_of(ids, new, new + size, least, times)
    move = (first - new)[np.searchsorted(new, s, "right") - 1] if len(s) else s
    return t, s + move, e + move, q


def found(docs: DataFrame, least: int = LEAST, times: int = TIMES, rewritten: Callable[[int | None, bytes], bytes] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, runs (by start, then period; places and lengths in words), collapsed (the words but those after a run's first period).

    A function of id and text may give the text that is searched in the place of each.
    """

    def run(batches):
        import pyarrow as pa

        for b in batches:
            ids, texts = b.column(0), as_bytes(b.column(1))
            if rewritten is not None:
                texts = [rewritten(i, x) for i, x in zip(ids.to_pylist(), texts, strict=True)]
            for i, j in chunks(list(map(len, texts))):
                t, start, end, period = in_texts(texts[i:j], least, times)
                of = np.searchsorted(t.first_word + t.n_words, start, "right")
                n = len(t.word_starts)
                dropped = np.cumsum(np.bincount(start + period, minlength=n + 1)[:n] - np.bincount(end, minlength=n + 1)[:n]) > 0
                gone, left = t.per_words(dropped), []
                for x, own in enumerate(texts[i:j]):
                    words = own.split()
                    left.append(b" ".join(compress(words, (~dropped[t.first_word[x] :][: len(words)]).tolist()) if gone[x] else words))
                runs = pa.StructArray.from_arrays([pa.array(start - t.first_word[of]), pa.array(end - start), pa.array(period)], names=["start", "length", "period"])
                offsets = np.searchsorted(of, np.arange(t.n + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.ListArray.from_arrays(pa.array(offsets), runs), pa.array(left, pa.binary()).cast(pa.string())], names=["doc_id", "runs", "collapsed"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(frugal(run), FOUND)


def digests(runs: DataFrame) -> DataFrame:
    """Of what ``found`` gives: doc_id, n_runs, the run with the greatest exact exponent, and digests of all runs and of the collapsed text."""
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    # of runs by start, then period: the first whose length / period no other one exceeds
    best = F.aggregate("runs", F.expr("CAST(NULL AS STRUCT<start: BIGINT, length: BIGINT, period: BIGINT>)"), lambda top, r: F.when(top.isNull() | (r["length"] * top["period"] > top["length"] * r["period"]), r).otherwise(top))
    exponent = F.expr("CAST(1000 * best.length DIV best.period AS BIGINT)")
    return runs.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", exponent.alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
