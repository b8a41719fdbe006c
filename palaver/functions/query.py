"""Queries taken apart on the driver: terms, phrases, time words, word forms. A query is one short string."""

from __future__ import annotations

import re
import unicodedata
from datetime import datetime, timedelta

from .language import STOP_WORDS

_CJK = re.compile("[\u2e80-\u2fdf\u3005-\u3007\u3021-\u3029\u3038-\u303b\u3041-\u3096\u3099-\u309f\u30a1-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7af\u1100-\u11ff\uf900-\ufaff\uff66-\uff9f〆]")


def _unique(items) -> list[str]:
    return list(dict.fromkeys(x for x in items if x))


def content(terms: list[str]) -> list[str]:
    """Terms without stop words, all of them if there is nothing else."""
    return [t for t in terms if t not in STOP_WORDS] or terms


def query_tokens(text: str) -> list[str]:
    """Words between white space without punctuation around them, of two bytes or more, once each."""
    return _unique(t for t in (w.strip("\t\n\r .,;:!?()[]{}<>\"'`") for w in text.lower().split()) if len(t.encode()) >= 2)


def query_parts(text: str) -> tuple[list[str], list[str]]:
    """Terms and quoted phrases; a quote left open is none."""
    pieces = text.split('"')
    if len(pieces) % 2 == 0:
        return content(query_tokens(text)), []
    phrases, terms = [], []
    for i, p in enumerate(pieces):
        if i % 2 and any(c.isalpha() or c.isdigit() for c in p):
            phrases.append(p.strip().lower())
        if not i % 2 or any(c.isalpha() or c.isdigit() for c in p):
            terms += query_tokens(p)
    return content(_unique(terms)), _unique(phrases)


def cjk_pairs(text: str) -> list[str]:
    """Pairs of CJK characters of a token that has some; the token alone if it has none."""
    if not _CJK.search(text):
        return [text]
    out, run = [], ""
    for c in [*text, " "]:
        if _CJK.match(c):
            run += c
            continue
        out += [run] if len(run) == 1 else [run[i : i + 2] for i in range(len(run) - 1)]
        run = ""
    return _unique([*out, *re.findall(r"[^\W]+", _CJK.sub(" ", text))])


def surface_words(text: str) -> list[str]:
    """The words of a query as they are indexed, longest first."""
    words = re.findall(r"[\w-]+", unicodedata.normalize("NFC", text).lower())
    return sorted(_unique(w for w in words if len(w.encode()) >= 2), key=lambda w: (-len(w.encode()), w))


def query_keys(text: str, fold: dict[str, str] | None = None) -> list[str]:
    """The index tokens of a query, longest first, CJK words as pairs, without stop words."""
    keys = [k for w in surface_words(text) for k in cjk_pairs(w)]
    return ["".join((fold or {}).get(c, c) for c in k) for k in content(_unique(keys))]


def relevance_terms(text: str) -> list[str]:
    """Words that keep dots, slashes, hyphens and underscores, of three bytes or CJK, once each, no stop words."""
    fields = "".join(c if (c.isascii() and (c.isalnum() or c in "-_./")) or (not c.isascii() and (c.isalpha() or c.isdigit())) else " " for c in text.lower()).split()
    pairs = [p for f in fields for p in cjk_pairs(f)]
    return _unique(p for p in pairs if len(p) >= 2 and (len(p.encode()) >= 3 or _CJK.match(p)) and p not in STOP_WORDS)


# Months, in English and Russian, and numbers before a unit of time.
_ENGLISH = "january february march april may june july august september october november december".split()
_RUSSIAN = "январь февраль март апрель май июнь июль август сентябрь октябрь ноябрь декабрь".split()
MONTHS = {m: i + 1 for i, m in enumerate(_ENGLISH)} | {m[:3]: i + 1 for i, m in enumerate(_ENGLISH)} | {"sept": 9}
MONTHS |= {form: i + 1 for i, m in enumerate(_RUSSIAN) for form in (m, m.rstrip("ьй") + ("а" if m[-1] == "т" else "я"), m.rstrip("ьй") + "е")}
NUMBERS = dict(zip("a an one two three four five six seven eight nine ten".split(), (1, 1, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10), strict=True))
_AGO = re.compile(rf"(?i)\b(?:({'|'.join(NUMBERS)}|[0-9]{{1,3}})\s+(day|week|month|year)s?\s+ago|(yesterday)|last\s+(week|month|year|monday|tuesday|wednesday|thursday|friday|saturday|sunday))\b", re.ASCII)


def _months_before(now: datetime, n: int) -> datetime:
    """The same day so many months ago; a day that month lacks runs into the next one."""
    year, month = divmod(now.year * 12 + now.month - 1 - n, 12)
    return datetime(year, month + 1, 1) + timedelta(days=now.day - 1)


def time_terms(text: str, now: datetime) -> list[str]:
    """Year-month and month name of the times that a query speaks of."""
    times = [datetime(now.year - (MONTHS[w] > now.month), MONTHS[w], 1) for w in re.findall(r"[^\W\d_]+", text.lower()) if w in MONTHS]
    for n, unit, yesterday, last in _AGO.findall(text):
        if yesterday:
            times.append(now - timedelta(days=1))
            continue
        count = NUMBERS.get(n.lower()) or int(n or 1)
        unit = unit.lower() or (last if last in ("month", "year") else "week")
        if count:
            times.append(now - timedelta(days=count * (7 if unit == "week" else 1)) if unit in ("day", "week") else _months_before(now, count * (12 if unit == "year" else 1)))
    return _unique(x for t in times for x in (t.strftime("%Y-%m"), _ENGLISH[t.month - 1]))


# Words that developers write short.
SYNONYMS = (
    ("auth", "authentication"), ("auth", "authorization"), ("db", "database"), ("k8s", "kubernetes"), ("env", "environment"), ("config", "configuration"), ("cfg", "config"), ("repo", "repository"), ("perm", "permission"), ("cert", "certificate"),
    ("dir", "directory"), ("msg", "message"), ("deps", "dependencies"), ("prod", "production"), ("param", "parameter"), ("arg", "argument"), ("docs", "documentation"), ("err", "error"), ("regex", "regexp"), ("spec", "specification"),
)


def synonyms(word: str) -> list[str]:
    """What a word stands for, or is written as."""
    return [b if word == a else a for a, b in SYNONYMS if word in (a, b)]


# Fixed values, T12: endings that may come off, the first that fits, and what takes their place.
_OFF = (("tion", ("te",)), ("ing", ("", "e")), ("ies", ("y", "i")), ("ied", ("y",)), ("ed", ("", "e")), ("ment", ("", "e")), ("es", ("",)), ("s", ("",)))


def _step(word: str) -> set[str]:
    out = set()
    for end, puts in _OFF:
        if word.endswith(end):
            out |= {word[: -len(end)] + p for p in puts}
            break
    if word.endswith("e"):
        out |= {word[:-1] + "ing", word[:-1] + "ed", word.removesuffix("te") + "tion"}
    if len(word) > 2 and word[-1] == "y" and word[-2] not in "aeiou":
        out |= {word[:-1] + "ies", word[:-1] + "ied"}
    if not word.endswith("s"):
        out.add(word + "s")
    if not word.endswith(("e", "ing", "ed")):
        out |= {word + "ing", word + "ed"}
    return {f for f in out if len(f.encode()) >= 3 and f != word}


def english_forms(word: str) -> list[str]:
    """The word and the forms that two steps of taking off and putting on endings give."""
    forms = {word}
    for _ in range(2):
        forms |= {f for w in forms for f in _step(w)}
    return sorted(forms)


# Russian endings in the order in which one is taken off; those of soft stems, verbs and nouns.
ENDINGS = "иями ями ами ией иях ях ах ов ев ей ой ий ия ию ии ие ый ая ое ые ью ям ем ом ть л ла ло ли а я у ю ы и е о ь".split()
SOFT = "и ью ям ях ями ей е я ю ем".split()
VERB = "ть л ла ло ли ю у а я е и ем".split()
PAST = frozenset("ть л ла ло ли".split())
NOMINAL = frozenset("иями ями ами ией иях ях ах ов ев ей ой ий ия ию ии ие ый ая ое ые ом".split())


def russian_forms(word: str) -> list[str]:
    """The forms of a Russian word's own paradigm, without the word."""
    if len(word) < 4 or not re.fullmatch("[а-яё]+", word):
        return []
    if word.endswith("ь"):
        forms = [word[:-1] + e for e in SOFT] if len(word) > 3 else []
        if word.endswith("ть") and word[-3] in "аеёиоуыэюя" and len(word) >= 5:
            forms += [word[:-2], *(word[:-2] + e for e in VERB)]
    else:
        off = next((e for e in ENDINGS if word.endswith(e) and len(word) - len(e) >= 3), "")
        base = word[: len(word) - len(off)]
        forms = [base, *(base + e for e in ENDINGS if not (off in NOMINAL and e in PAST))]
    return [f for f in _unique(forms) if f != word]


def word_forms(word: str) -> list[str]:
    """All forms that stand for a word of a query, the word first."""
    return _unique([word, *english_forms(word), *russian_forms(word), *synonyms(word)])


def _short_forms(word: str) -> list[str]:
    return [f for f in (word, word + "s", word + "es", word.removesuffix("s")) if len(f.encode()) >= 3]


def stem_forms(word: str) -> list[str]:
    """The forms of a query's word that the stem tier looks up, in order; words under five characters only take an s or es."""
    return _unique([*(_short_forms(word) if len(word) < 5 else english_forms(word)), *synonyms(word), *russian_forms(word)])


def relevance_forms(word: str) -> list[str]:
    """The other forms of a word that stand in for one that the archive lacks; a Russian word's always do."""
    if re.fullmatch("[а-яё]+", word):
        return russian_forms(word)
    return [f for f in (_short_forms(word) if len(word) < 5 else english_forms(word)) if f != word]


# Words that say nothing about what a prompt is about, if they stand alone.
WORKING = frozenset(
    "tests test retry build error errors check checks files patch trace output command branch suite commit commits deploy fixes again write wrote merge start print there these those which where line file code read open task step note logs docs".split()
)


def worth_showing(terms: list[str], matched: int) -> bool:
    """Whether what was recalled for some terms is worth showing: one of them names something, or two matched."""
    names = any((len(t) >= 3 and t not in WORKING) or re.search(r"[_./\-0-9]", t) for t in terms)
    return bool(terms) and (names or matched >= 2)


def duration(text: str) -> timedelta:
    """30d, 12h, 90m and 45s, also after one another."""
    parts = re.findall(r"([0-9]+(?:\.[0-9]+)?)([dhms])", text)
    if not parts or "".join(a + b for a, b in parts) != text or ("d" in text and not re.fullmatch(r"[0-9]+d", text)):
        raise ValueError(f"{text!r} is not a duration: try 30d, 12h or 90m")
    return sum((timedelta(**{{"d": "days", "h": "hours", "m": "minutes", "s": "seconds"}[u]: float(n)}) for n, u in parts), timedelta())


def path_forms(path: str) -> list[str]:
    """A path's endings, whole path first, each with and without a slash before it."""
    parts = path.replace("\\", "/").lower().strip("/").split("/")
    return [x for i in range(len(parts)) for x in ("/" + "/".join(parts[i:]), "/".join(parts[i:]))]
