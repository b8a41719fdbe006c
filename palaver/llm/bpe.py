"""Byte-pair merging over many sequences at once.

Pre-tokens are held as one array of symbols with the bounds of each sequence. In a round each sequence's pair of lowest
rank is merged wherever it occurs in it, left to right, in all sequences together, until no pair has a rank. A merge's
result has a higher rank than the merge itself, so this gives what one merge at a time gives.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import cache

import numpy as np
import regex

_NONE = np.int64(1 << 40)
#: Pieces that are merged together: few enough for their arrays to stay in a core's cache.
LEARN = 10_000
#: White space as the tokenizers' library has it; Python's own class also holds U+001C to U+001F.
_S = r"\t-\r\x20\x85\xa0  -     　"


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable in Latin-1, else the next from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256))
    return [chr(b) if b in own else chr(256 + next(rest)) for b in range(256)]


class Pairs:
    """Rank and result of each pair of symbols, by open addressing in two arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, result: np.ndarray):
        self.bits = max(10, int(np.ceil(np.log2(max(len(left), 1)))) + 4)
        self.key = np.full(1 << self.bits, -1, np.int64)
        self.value = np.zeros(1 << self.bits, np.int64)
        self.result = result.astype(np.int32)
        keys = left.astype(np.int64) << 20 | right.astype(np.int64)
        wait, self.steps = np.arange(len(keys)), 0
        while len(wait):
            at = (self._slot(keys[wait]) + self.steps) & ((1 << self.bits) - 1)
            free = self.key[at] == -1
            _, first = np.unique(at[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.key[at[put]] = keys[wait[put]]
            self.value[at[put]] = wait[put]
            wait, self.steps = np.delete(wait, put), self.steps + 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 20 | right.astype(np.int64)
        slot = self._slot(keys)
        found = self.key[slot]
        out = np.where(found == keys, self.value[slot], _NONE)
        on = np.flatnonzero((found != keys) & (found != -1))
        for step in range(1, self.steps):
            if not len(on):
                break
            at = (slot[on] + step) & ((1 << self.bits) - 1)
            found = self.key[at]
            hit = found == keys[on]
            out[on[hit]] = self.value[at[hit]]
            on = on[~hit & (found != -1)]
        return out


class Merger:
    """The merges of a tokenizer file, over byte-level symbols."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.suffix = model["end_of_word_suffix"] or ""
        stand = byte_symbols()
        self.plain = np.array([vocab[c] for c in stand], np.int32)
        self.last = np.array([vocab[c + self.suffix] for c in stand], np.int32)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.pairs = Pairs(*(np.array([vocab[f(m)] for m in merges], np.int64) for f in (lambda m: m[0], lambda m: m[1], lambda m: m[0] + m[1])))

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in their order, and how many of them each word has."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        sym, seq = self.plain[data], np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        ends = np.cumsum(lengths)[lengths > 0] - 1
        sym[ends] = self.last[data[ends]]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        if len(sym):
            rank = np.full(len(sym), _NONE)
            same = np.flatnonzero(seq[1:] == seq[:-1])
            rank[same] = self.pairs.ranks(sym[same], sym[same + 1])
        while len(sym):
            first = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]]))
            size = np.diff(np.concatenate([first, [len(seq)]]))
            low = np.minimum.reduceat(rank, first)
            over = low == _NONE
            low = np.repeat(low, size)
            if over.any():
                out = np.repeat(over, size)
                done.append((sym[out], seq[out]))
                sym, seq, rank, low = sym[~out], seq[~out], rank[~out], low[~out]
                if not len(sym):
                    break
            hit = rank == low
            at = np.flatnonzero(hit)
            if (hit[1:] & hit[:-1]).any():  # of a run of overlapping pairs, every second one
                run = np.flatnonzero(np.concatenate([[True], np.diff(at) != 1]))
                nth = np.arange(len(at)) - np.repeat(run, np.diff(np.concatenate([run, [len(at)]])))
                at = at[nth % 2 == 0]
            sym[at] = self.pairs.result[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            new = np.cumsum(keep)[at] - 1
            rank[at] = rank[at + 1]  # no pair after it: none; else it is computed below
            sym, seq, rank = sym[keep], seq[keep], rank[keep]
            changed = np.zeros(len(sym) + 1, bool)  # the last place is for new - 1 = -1
            changed[new] = changed[new - 1] = True
            near = np.flatnonzero(changed[:-1])
            has = (near + 1 < len(sym)) & (seq[np.minimum(near + 1, len(sym) - 1)] == seq[near])
            rank[near] = _NONE
            near = near[has]
            rank[near] = self.pairs.ranks(sym[near], sym[near + 1])
        ids = np.concatenate([x[0] for x in done]) if done else np.zeros(0, np.int32)
        of = np.concatenate([x[1] for x in done]) if done else np.zeros(0, np.int32)
        order = np.argsort(of, kind="stable")
        return ids[order], np.bincount(of, minlength=len(words))


@cache
def merger(path: str) -> Merger:
    return Merger(path)


#: Pre-tokens of the byte-level file: contractions, then letters, digits or other signs after at most one space, then white space.
_BYTE_LEVEL = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
#: Pre-tokens of the word-level file: contractions, letters, single digits, other signs.
_WORD_LEVEL = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_S}\p{{L}}\p{{N}}]+")
#: No pre-token crosses these coarser pieces, so what a piece gives depends on the piece alone.
_BYTE_PIECES = re.compile(rf" ?[^{_S}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_WORD_PIECES = re.compile(rf"[^{_S}]+")
_ODD_SPACE = re.compile("[\x1c-\x1f]")


class ByteLevel:
    pieces = staticmethod(_BYTE_PIECES.findall)
    words = staticmethod(_BYTE_LEVEL.findall)


class WordLevel:
    @staticmethod
    def pieces(text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        return _WORD_PIECES.findall(text) if _ODD_SPACE.search(text) else text.split()

    words = staticmethod(_WORD_LEVEL.findall)


class Encoder:
    """Ids or counts of whole texts; pieces seen before come from a memory of bounded size."""

    def __init__(self, path: str, split: type, counts: bool = False, most: int = 700_000):
        self.merger, self.split, self.counts, self.most = merger(path), split, counts, most
        self.known: dict[str, bytes | int] = {}
        self.special = {k: 1 if counts else v.to_bytes(4, "little") for k, v in self.merger.specials.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")

    def _learn(self, pieces: list[str]) -> None:
        split = list(map(self.split.words, pieces))
        words = {w: i for i, w in enumerate(dict.fromkeys(w for p in split for w in p))}
        ids, sizes = self.merger.merge([w.encode() for w in words])
        if self.counts:
            of = dict(zip(words, sizes.tolist(), strict=True))
            self.known.update((p, sum(of[w] for w in ws)) for p, ws in zip(pieces, split, strict=True))
        else:
            raw, at = ids.astype("<u4").tobytes(), [0, *(np.cumsum(sizes) * 4).tolist()]
            of = {w: raw[at[i] : at[i + 1]] for w, i in words.items()}
            self.known.update((p, b"".join([of[w] for w in ws])) for p, ws in zip(pieces, split, strict=True))

    def __call__(self, texts: list[str]) -> list:
        """For each text the little-endian 32-bit ids as bytes, or the number of ids."""
        flat: list[tuple[int, list[str] | str]] = []  # special strings stand alone
        for i, t in enumerate(texts):
            if self.cut.search(t):
                flat += [(i, p if k % 2 else self.split.pieces(p)) for k, p in enumerate(self.cut.split(t))]
            else:
                flat.append((i, self.split.pieces(t)))
        known = self.known
        missing = {w for _, p in flat if p.__class__ is list for w in p if w not in known}
        if len(known) + len(missing) > self.most:  # what this call needs must stay
            known.clear()
            missing = {w for _, p in flat if p.__class__ is list for w in p}
        ordered = list(missing)
        for i in range(0, len(ordered), LEARN):
            self._learn(ordered[i : i + LEARN])
        get, join = self.known.__getitem__, sum if self.counts else b"".join
        out: list = [[] for _ in texts]
        for i, p in flat:
            out[i].append(join(map(get, p)) if p.__class__ is list else self.special[p])
        return [x[0] if len(x) == 1 else join(x) for x in out]
