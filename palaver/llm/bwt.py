"""Merging of Burrows-Wheeler transforms by refining their interleave.

A shard is a byte string whose parts are each ended by a zero. Its rotations are sorted by prefix doubling. Two shards are
merged without sorting their suffixes again: which shard each merged row comes from is refined two symbols a round, by
putting the rows, in their present order, in the order of the two symbols before them. After h rounds rows are in the order
of their first 2 * h symbols, and rows that share these form a block. Only rows that lead back to a window asked for take
part: in round h those that begin 2 * h symbols before its end. A row alone in its block repeats nothing, and neither do the
rows before it, so it leaves the interleave: a round costs as much as there are rows that still repeat.
"""

from __future__ import annotations

import numpy as np


def sorted_rotations(text: np.ndarray, depth: int) -> np.ndarray:
    """The starts of the text's rotations in the order of their first symbols, at least so many."""
    n = len(text)
    wide = np.concatenate([text, text[: min(n, 8)]])
    wide = np.concatenate([wide, np.resize(text, 8)])[: n + 8] if n < 8 else wide
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = key << np.uint64(8) | wide[k : k + n].astype(np.uint64)
    order = np.argsort(key)
    new = np.ones(n, bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]  # a group's number is the place of its first row
    k = 8
    while k < depth:
        open_ = np.flatnonzero(~_alone(new))
        if not len(open_):
            break
        rows = order[open_]
        key = rank[rows] * np.int64(n + 1) + rank[(rows + k) % n]
        turn = np.argsort(key)
        rows, key = rows[turn], key[turn]
        order[open_] = rows
        new[open_[1:]] = key[1:] != key[:-1]
        head = new[open_]
        rank[rows] = open_[head][np.cumsum(head) - 1]
        k *= 2
    return order


def _alone(new: np.ndarray) -> np.ndarray:
    """Which rows are groups of their own; new: which rows begin a group."""
    return new & np.append(new[1:], True)


def merge(left: np.ndarray, right: np.ndarray, wanted: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts in the text left + right by merged row, and each row's block of equal first symbols, an even number of them.

    Wanted: starts of the windows asked for, each at least so many symbols before its shard's end. Only rows whose block holds
    several are returned; those of a block are next to each other.
    """
    rounds = -(-depth // 2)
    starts, places, before, back = [], [], [], []
    for s, offset in ((left, 0), (right, len(left))):
        order = sorted_rotations(s, depth)
        place = np.empty(len(s), np.int32)
        place[order] = np.arange(offset, offset + len(s), dtype=np.int32)
        starts.append(order + offset)
        places.append(place)
        # the transform, two symbols wide: those before each rotation, and the row of the rotation that begins with them
        before.append(np.take(s, order - 2, mode="wrap").astype(np.uint16) << 8 | np.take(s, order - 1, mode="wrap"))
        back.append(np.take(place, order - 2, mode="wrap"))
    start, symbol, before_it = (np.concatenate(x) for x in (starts, before, back))
    row = np.sort(np.concatenate(places)[wanted + 2 * rounds])  # left's, then right's, as each shard has them
    block = np.zeros(len(row), np.int32)
    for _ in range(rounds):
        two = symbol[row]
        order = np.argsort(two, kind="stable")
        two, origin, row = two[order], block[order], before_it[row[order]]
        new = np.ones(len(row), bool)
        new[1:] = (two[1:] != two[:-1]) | (origin[1:] != origin[:-1])
        block = np.cumsum(new, dtype=np.int32)
        several = ~_alone(new)
        row, block = row[several], block[several]
    return start[row], block


def earlier(parts: list[bytes], windows: np.ndarray, first: np.ndarray, second: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Part and start of each window that an earlier window equals.

    Windows are the strings of so many bytes at starts 0 to windows[i] - 1 of part i; a window's place is
    (first[i], second[i] + start), and earlier means a smaller place.
    """
    half = len(parts) // 2
    shards = [np.frombuffer(b"\0".join(p) + b"\0", np.uint8) for p in (parts[:half], parts[half:])]
    # zero bytes in a text would read as ends: symbols are moved up by one, which UTF-8 leaves room for
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    both = np.concatenate(shards) + np.uint8(1)
    both[ends] = 0
    windows = np.maximum(windows, 0)
    begin, of = ends - lengths, np.repeat(np.arange(len(parts)), windows)
    wanted = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows) + begin[of]
    start, block = merge(both[: len(shards[0])], both[len(shards[0]) :], wanted, depth)
    part = np.searchsorted(ends, start, "left")
    at = start - begin[part]
    one, two = first[part], second[part] + at
    order = np.lexsort((two, one, block))
    part, at, block, one, two = part[order], at[order], block[order], one[order], two[order]
    head = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else np.zeros(0, np.int64)
    of = np.repeat(head, np.diff(np.concatenate([head, [len(block)]])))
    late = (one > one[of]) | (two > two[of])
    return part[late], at[late]
