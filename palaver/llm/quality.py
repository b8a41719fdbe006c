"""Quality rules as a short-circuit cascade.

Each rule is a cost and a verdict over arrays. On a sample of the documents the cost of each rule and the share that it
rejects are measured; the rules then run in the order of rejections per cost, each only over documents that none has
rejected so far. The order changes the time taken, never the verdict.

The rules: too few words; repeated windows of words; many symbols; mostly repeated lines; words too short or too long; nearly
all lines bullets; many lines that end in an ellipsis; many words without a letter; one pair of words all over the text.

Defined results: a null or empty text has no words, so it fails ``few_words``. Rows are judged one by one: repeated rows
and repeated ids get equal verdicts, and a very long text is judged whole. Other columns pass through ``keep`` untouched,
whatever their names. An empty table gives an empty one.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Texts, as_bytes, byte_hashes, chunks, frugal, mix64

#: Documents of the sample, about: each is drawn by chance, so that they come from the whole table.
SAMPLE_ROWS = 1000

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
WINDOW = 8


def _word_chars(t: Texts) -> np.ndarray:
    return t.per_text(t.is_word & ((t.bytes & 0xC0) != 0x80))


def _symbols(t: Texts) -> np.ndarray:
    return t.per_text(_SYMBOL[t.bytes])


def _lines(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the lines that hold a word, and their texts' numbers."""
    ends = np.flatnonzero(t.bytes == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    full = np.searchsorted(t.word_starts, ends) > np.searchsorted(t.word_starts, starts)
    starts, ends = starts[full], ends[full]
    return starts, ends, np.searchsorted(t.starts, starts, "right") - 1


def _dup_lines(t: Texts) -> np.ndarray:
    starts, ends, of = _lines(t)
    key = mix64(byte_hashes(t.bytes, starts, ends) + of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    again = order[1:][key[order[1:]] == key[order[:-1]]]
    return np.bincount(of[again], minlength=t.n)


def _full_lines(t: Texts) -> np.ndarray:
    return np.bincount(_lines(t)[2], minlength=t.n)


def _repeat_words(t: Texts) -> np.ndarray:
    """Words in windows of eight that the same text holds twice or more."""
    at, key = t.windows(t.word_hashes(), WINDOW)
    key = mix64(key + t.word_text()[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    opened = np.zeros(len(t.word_starts) + WINDOW, np.int64)
    opened[at[twice]] += 1
    total = np.concatenate([np.zeros(WINDOW, np.int64), np.cumsum(opened)])[: len(t.word_starts) + WINDOW]
    return t.per_words(total[WINDOW:] > total[: len(t.word_starts)])


def _bullets(t: Texts) -> np.ndarray:
    """Lines whose first word begins with a hyphen, an asterisk or a bullet."""
    starts, _, of = _lines(t)
    at = t.word_starts[np.searchsorted(t.word_starts, starts)]
    b = np.concatenate([t.bytes, [10, 10]])
    return np.bincount(of[(b[at] == 45) | (b[at] == 42) | ((b[at] == 0xE2) & (b[at + 1] == 0x80) & (b[at + 2] == 0xA2))], minlength=t.n)


def _ellipses(t: Texts) -> np.ndarray:
    """Lines whose last word ends in three full stops or an ellipsis."""
    _, ends, of = _lines(t)
    last = t.word_ends[np.searchsorted(t.word_ends, ends, "right") - 1] if len(ends) else ends
    b = np.concatenate([[10, 10, 10], t.bytes])  # shifted by three: the last three bytes are at last to last + 2
    dots = (b[last] == 46) & (b[last + 1] == 46) & (b[last + 2] == 46)
    return np.bincount(of[dots | ((b[last] == 0xE2) & (b[last + 1] == 0x80) & (b[last + 2] == 0xA6))], minlength=t.n)


def _alphabetic(t: Texts) -> np.ndarray:
    """Words that hold a letter: of ASCII, or any character beyond it."""
    low = t.bytes | 32
    total = np.concatenate([[0], np.cumsum(((low >= 97) & (low <= 122)) | (t.bytes >= 128))])
    return t.per_words(total[t.word_ends] > total[t.word_starts])


def _top_pair(t: Texts) -> np.ndarray:
    """How often a text holds its most frequent pair of words."""
    at, key = t.windows(t.word_hashes(), 2)
    of = t.word_text()[at]
    key = mix64(key + of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    head = np.flatnonzero(np.concatenate([[True], key[order[1:]] != key[order[:-1]]])) if len(order) else np.zeros(0, np.int64)
    out = np.zeros(t.n, np.int64)
    np.maximum.at(out, of[order[head]], np.diff(np.concatenate([head, [len(order)]])))
    return out


MEASURES: dict[str, Callable[[Texts], np.ndarray]] = {
    "n_words": lambda t: t.n_words,
    "word_chars": _word_chars,
    "n_symbols": _symbols,
    "n_dup_lines": _dup_lines,
    "n_repeat_words": _repeat_words,
    "n_lines": _full_lines,
    "n_bullets": _bullets,
    "n_ellipses": _ellipses,
    "n_alphabetic": _alphabetic,
    "n_top_pair": _top_pair,
}


@dataclass(frozen=True)
class Rule:
    """rejects: from the measures of some documents, which of them it rejects."""

    name: str
    needs: tuple[str, ...]
    rejects: Callable[..., np.ndarray]


#: The first two are the base rules.
RULES = (
    Rule("few_words", ("n_words",), lambda n: n < 20),
    Rule("repeated_words", ("n_words", "n_repeat_words"), lambda n, r: 100 * r > 30 * n),
    Rule("symbols", ("n_words", "n_symbols"), lambda n, s: 10 * s > n),
    Rule("repeated_lines", ("n_lines", "n_dup_lines"), lambda n, d: 2 * d > n),
    Rule("word_length", ("n_words", "word_chars"), lambda n, c: (c < 2 * n) | (c > 15 * n)),
    Rule("bullets", ("n_lines", "n_bullets"), lambda n, b: 10 * b > 9 * n),
    Rule("ellipses", ("n_lines", "n_ellipses"), lambda n, e: 10 * e > 3 * n),
    Rule("alphabetic", ("n_words", "n_alphabetic"), lambda n, a: 10 * a < 6 * n),
    Rule("one_pair", ("n_words", "n_top_pair"), lambda n, p: 10 * p > n),
)
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(texts: list[bytes], rules: tuple[Rule, ...], timed: dict | None = None, known: dict[str, np.ndarray] | None = None) -> np.ndarray:
    """Which texts pass every rule. A rule sees those that passed the rules before it; what it measured, or is known, serves the later ones."""
    rows, view, have = np.arange(len(texts)), Texts(texts), dict(known or {})
    alive = np.ones(len(texts), bool)
    for rule in rules:
        began = time.perf_counter()
        if not alive.any():
            break
        for m in rule.needs:
            if m not in have:
                have[m] = MEASURES[m](view)
        out = rule.rejects(*(have[m] for m in rule.needs))
        if timed is not None:
            timed[rule.name] = timed.get(rule.name, np.zeros(3)) + [time.perf_counter() - began, view.n, out.sum()]
            continue
        alive &= ~out
        if alive.sum() < 0.8 * view.n:  # worth a smaller view
            rows, have = rows[alive], {m: v[alive] for m, v in have.items()}
            view, alive = Texts([texts[i] for i in rows]), np.ones(len(rows), bool)
    kept = np.zeros(len(texts), bool)
    kept[rows[alive]] = True
    return kept


def cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> tuple[Rule, ...]:
    """The rules in the order of rejections per second, as measured in one task over a sample of the documents."""
    order = {r.name: r for r in rules}

    def measure(batches):
        import pyarrow as pa

        seen = {r: np.zeros(3) for r in order}
        for b in batches:
            texts = as_bytes(b.column(0))
            for i, j in chunks(list(map(len, texts))):
                for r in rules:  # each alone, so that none rides on what another has measured
                    judge(texts[i:j], (r,), seen)
        yield pa.RecordBatch.from_pydict({"rule": list(seen), "seconds": [float(v[0]) for v in seen.values()], "n": [float(v[1]) for v in seen.values()], "out": [float(v[2]) for v in seen.values()]})

    texts_ = docs.select(F.col(text).alias("text"))
    share = min(1.0, SAMPLE_ROWS / max(1, docs.count()))
    sample = texts_.sample(share, seed=11) if share < 1 else texts_
    worth: dict[str, list[float]] = {}
    for r in sample.mapInArrow(measure, "rule string, seconds double, n double, out double").collect():  # a row a rule and task
        s = worth.setdefault(r.rule, [0.0, 0.0, 0.0])
        for k, v in enumerate((r.seconds, r.n, r.out)):
            s[k] += v
    score = {name: (out / n) / max(seconds / n, 1e-12) if n else 0.0 for name, (seconds, n, out) in worth.items()}
    return tuple(sorted(rules, key=lambda r: (-score.get(r.name, 0.0), rules.index(r))))


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The documents that every rule keeps, with all their columns."""
    ordered, schema, at = cascade(docs, rules, text), docs.schema, docs.columns.index(text)

    def run(batches) -> Iterator:
        import pyarrow as pa

        for b in batches:
            texts = as_bytes(b.column(at))
            for i, j in chunks(list(map(len, texts))):
                kept = judge(texts[i:j], ordered)
                yield b.slice(i, j - i).filter(pa.array(kept))

    return docs.mapInArrow(frugal(run), schema)


def measured(docs: DataFrame, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the five base measures, base_failed and the cascade's verdict, for every row."""
    ordered = cascade(docs, rules, text)

    def run(batches) -> Iterator:
        import pyarrow as pa

        for b in batches:
            ids, texts = b.column(0), as_bytes(b.column(1))
            for i, j in chunks(list(map(len, texts))):
                view = Texts(texts[i:j])
                base = {m: MEASURES[m](view) for m in BASE}
                failed = (base["n_words"] < 20) | (100 * base["n_repeat_words"] > 30 * base["n_words"])
                passed = np.flatnonzero(~failed)
                kept = np.zeros(j - i, bool)
                known = {m: v[passed] for m, v in base.items()}
                kept[passed] = judge([texts[i + k] for k in passed], tuple(r for r in ordered if r.name not in ("few_words", "repeated_words")), known=known)
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), *(pa.array(base[m].astype(np.int64)) for m in BASE), pa.array(failed), pa.array(kept)], names=["doc_id", *BASE, "base_failed", "kept"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(frugal(run), "doc_id long, " + ", ".join(f"{m} long" for m in BASE) + ", base_failed boolean, kept boolean")
