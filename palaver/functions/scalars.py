"""Small column functions: paths, times, names, hashes, bars, edit distance."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .language import fields, once, stripped


#: What a text holds that composing may change.
COMPOSES = r"[\p{M}\x{1100}-\x{11ff}\x{212a}\x{212b}\x{2126}]"


def nfc(text: Column) -> Column:
    """Composed characters. Only texts that hold combining marks or letters that compose with others are sent to Python."""

    @F.pandas_udf("string")
    def composed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))

    return F.coalesce(composed(F.when(text.rlike(COMPOSES), text)), text)


def base_name(path: Column) -> Column:
    """What follows the last slash or backslash."""
    return F.element_at(F.split(path, r"[/\\]"), -1)


def path_matches(path: Column, want: str) -> Column:
    """Equal, ending in the wanted path, or the same name where only a name is wanted."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    return (p == want) | F.endswith(p, F.lit("/" + want))


def mention_level(text: Column, forms: list[str]) -> Column:
    """How specific the most specific ending of a path is that a text holds between other than word characters: 1, or 1 and a quarter a segment."""
    low = F.replace(F.lower(text), F.lit("\\"), F.lit("/"))
    w = r"[\p{L}\p{Nd}_-]"
    one = lambda f: F.when(low.rlike(rf"(?<!{w})\Q{f}\E(?!{w})"), 1 + len(f.split("/")) / 4).otherwise(1.0)
    return F.greatest(F.lit(1.0), *map(one, forms))


def mention_count(text: Column, name: str) -> Column:
    """How often a text holds a file's name as a word or a part of a path."""
    w = r"[\p{L}\p{Nd}_-]"
    return F.regexp_count(F.replace(F.lower(text), F.lit("\\"), F.lit("/")), F.lit(rf"(?<!{w})\Q{name.lower()}\E(?!{w})"))


def lenient_time(raw: Column) -> Column:
    """ISO times with or without seconds and zone, and epochs in seconds or, above 1e12, in milliseconds, whole or not."""
    n = raw.cast("string").try_cast("double")
    epoch = F.when(n > 1e12, F.timestamp_millis(n.cast("long"))).when(n > 0, F.timestamp_seconds(n.cast("long")))
    text = raw.cast("string")
    iso = text.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d(?::\d\d(?:\.\d+)?)?(?:Z|[+-]\d\d:\d\d)?$")
    return F.coalesce(F.when(iso, F.try_to_timestamp(F.regexp_replace(text, r"([T ]\d\d:\d\d)(?=$|Z|[+-])", "$1:00"))), F.when(~iso, epoch))


def project_name(path: Column) -> Column:
    """The last part of a path; a dash for none."""
    p = F.regexp_replace(path, r"[/\\]+$", "")
    return F.when(F.coalesce(path, F.lit("")) == "", F.lit("-")).when(p == "", F.lit("/")).otherwise(base_name(p))


def decoded_project(folder: Column) -> Column:
    """The last two parts of a folder's name in which dashes stand for slashes (where the folder itself can't be asked)."""
    base = base_name(F.regexp_replace(folder, r"[/\\]+$", ""))
    parts = F.filter(F.split(base, "-"), lambda p: p != "")
    n = F.size(parts)
    return F.when(F.coalesce(base, F.lit("")).isin("", "."), F.lit("-")).when(n == 0, base).when(n == 1, F.get(parts, F.lit(0))).otherwise(F.concat_ws("/", F.get(parts, n - 2), F.get(parts, n - 1)))


def relative_date(ts: Column, now: Column) -> Column:
    """today, days ago within a week, else the date, with its year if that is another one."""
    days = F.datediff(now, ts)
    return F.when(days == 0, F.lit("today")).when(days.between(1, 6), F.concat(days.cast("string"), F.lit("d ago"))).when(F.year(ts) == F.year(now), F.date_format(ts, "MMM d")).otherwise(F.date_format(ts, "MMM d yyyy"))


def bucket_day(session_id: Column, prefix: str = "note") -> Column:
    """the day that a note bucket's id names."""
    return F.try_to_date(F.regexp_extract(session_id, rf"^\Q{prefix}\E-(\d{{4}}-\d\d-\d\d)", 1), "yyyy-MM-dd")


def trimmed(text: Column, n: int) -> Column:
    """at most so many characters, the last one an ellipsis if something was cut."""
    return F.when(F.char_length(text) <= n, text).otherwise(F.left(text, F.lit(n)) if n <= 1 else F.concat(F.left(text, F.lit(n - 1)), F.lit("…")))


def scaled_bar(n: Column, most: Column, width: int) -> Column:
    """a bar's length; one for anything more than nothing."""
    return F.when((n <= 0) | (most <= 0), 0).otherwise(F.greatest(F.floor(n * width / most), F.lit(1)).cast("int"))


def sparkline(values: Column) -> Column:
    """a block of eight heights for each value."""
    most = F.array_max(values)
    level = lambda v: F.when((most > 0) & (v > 0), F.floor((v - 1) * 7 / most) + 1).otherwise(0).cast("int")
    return F.array_join(F.transform(values, lambda v: F.substring(F.lit("▁▂▃▄▅▆▇█"), level(v) + 1, F.lit(1))), "")


def fingerprint(*parts: Column) -> Column:
    """a 64-bit mark of some values; a null differs from nothing."""
    return F.xxhash64(*(F.struct(p.isNull(), p) for p in parts))


def short_hash(text: Column, n: int = 12) -> Column:
    """the first hexadecimal digits of a digest."""
    return F.left(F.sha2(text, 256), F.lit(n))


def imported_id(harness: Column, session: Column) -> Column:
    """the id under which another machine's session is kept."""
    return F.concat(F.lit("imported-"), short_hash(F.concat_ws(":", harness, session)))


def clean_field(text: Column, most: int = 120) -> Column:
    """one printable line of at most so many characters."""
    flat = F.array_join(fields(F.regexp_replace(text, r"[\p{Cc}\p{Cf}]", " ")), " ")
    return F.when(F.char_length(flat) > most, F.concat(stripped(F.left(flat, F.lit(most))), F.lit("…"))).otherwise(flat)


def note_state(text: Column) -> Column:
    """the state that a promoted note begins with, else null."""
    state = F.regexp_extract(text, r"^\[(accepted|rejected|superseded|stale)\]", 1)
    return F.when(state != "", state)


def normal_tags(tags: Column) -> Column:
    """lower case, without a number sign, once each, eight at most."""
    clean = F.transform(tags, lambda t: F.lower(F.regexp_replace(stripped(t), "^#", "")))
    return F.slice(F.array_distinct(F.filter(clean, lambda t: t != "")), 1, 8)


def merged_capped(have: Column, more: Column, most: int) -> Column:
    """two lists as one, each value once, in order, so many at most."""
    return F.slice(F.array_distinct(F.concat(have, more)), 1, most)


def osa(a: Column, b: Column) -> Column:
    """edits, with swaps of neighbours, that make one word another, no part edited twice; in the JVM, by rows of the table.

    A row of the table follows from the two before it, so the fold over a's characters carries both.
    """
    x, y = F.split(a, ""), F.split(b, "")
    n = F.char_length(b)
    first = F.sequence(F.lit(0), n)
    empty = F.struct(first.alias("row"), first.alias("before"), F.lit("").alias("last"), F.lit(0).alias("i"))

    def step(acc, c):
        i = acc["i"] + 1

        def cell(row, j):
            up, corner, left = F.element_at(acc["row"], j + 1), F.element_at(acc["row"], j), F.element_at(row, j)
            same = F.element_at(y, j) == c
            best = F.least(left + 1, up + 1, corner + F.when(same, 0).otherwise(1))
            swap = (i > 1) & (j > 1) & (F.try_element_at(y, F.greatest(j - 1, F.lit(1))) == c) & (F.element_at(y, j) == acc["last"])
            return F.concat(row, F.array(F.when(swap, F.least(best, F.element_at(acc["before"], F.greatest(j - 1, F.lit(1))) + 1)).otherwise(best)))

        row = F.aggregate(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), F.array(i), cell)
        return F.struct(row.alias("row"), acc["row"].alias("before"), c.alias("last"), i.alias("i"))

    return F.when(F.char_length(a) == 0, n).otherwise(F.aggregate(x, empty, step, lambda acc: F.element_at(acc["row"], -1)))


def covering_window(text: Column, terms: list[str]) -> Column:
    """The bytes from the first to the last of the closest places at which a text holds all terms; 0 if it doesn't.

    Where the terms' first places are already within 200 bytes that span counts. Other texts are cut where a term begins, and
    one fold over the pieces keeps where each term comes next and the least window so far: all places count, overlapping ones too.
    """
    if len(terms) < 2:
        return F.lit(0)
    low = F.lower(text)
    at = lambda t: F.when(F.instr(low, t) > 0, F.octet_length(F.substring_index(low, t, 1)))
    span = F.greatest(*(at(t) + len(t.encode()) for t in terms)) - F.least(*(at(t) for t in terms))
    every = F.lit(True)
    for t in terms:
        every = every & (F.instr(low, t) > 0)
    far = F.when(every & (span > 200), low)
    return F.when(~every, 0).when(span <= 200, span).otherwise(_closest(far, terms))


def _closest(low: Column, terms: list[str]) -> Column:
    """The least window over all places of all terms: for each place, from the last one back, up to where the others come next."""
    pieces = F.reverse(F.split(low, "(?=" + "|".join(r"\Q" + t + r"\E" for t in terms) + ")"))
    own = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(t).alias("t"), F.lit(len(t.encode())).alias("size")) for k, t in reversed(list(enumerate(terms)))))
    longest = max(map(len, terms))
    place = lambda d, k, size: F.struct(d.alias("d"), (-k).alias("k"), size.alias("size"))
    state = lambda back, ahead, after, best: F.struct(back.alias("back"), ahead.alias("ahead"), after.alias("after"), best.alias("best"))
    start = state(F.lit(0), F.lit(""), F.array_repeat(place(F.lit(-1), F.lit(0), F.lit(0)), len(terms)), F.lit(0))

    def met(acc, t):
        after = F.transform(acc["after"], lambda v, i: F.when(i == t["k"], place(acc["back"], t["k"], t["size"])).otherwise(v))
        last = F.array_min(after)  # the nearest to the end; of terms that begin there the last one
        span = acc["back"] - last["d"] + last["size"]
        best = F.when((last["d"] >= 0) & ((acc["best"] == 0) | (span < acc["best"])), span).otherwise(acc["best"])
        return F.when(acc["ahead"].startswith(t["t"]), state(acc["back"], acc["ahead"], after, best)).otherwise(acc)

    # terms may begin within one another, so a piece is looked at with what comes after it
    step = lambda acc, piece: F.aggregate(own, state(acc["back"] + F.octet_length(piece), F.left(F.concat(piece, acc["ahead"]), F.lit(longest)), acc["after"], acc["best"]), met)
    return F.aggregate(pieces, start, step, lambda acc: acc["best"])


def proximity(window: Column) -> Column:
    """Up to 35 % more for terms that meet."""
    return F.when(window > 0, 1 + 0.35 * 200 / (200 + window)).otherwise(1.0)


def title_boost(title: Column, terms: list[str]) -> Column:
    """Up to 40 % more for terms that the title holds."""
    hits = sum((F.contains(F.lower(title), F.lit(t)).cast("int") for t in terms), F.lit(0))
    return 1 + 0.4 * F.coalesce(hits, F.lit(0)) / max(1, len(terms))


def densest_mention(text: Column, query: str, ahead: int = 200, first: int | None = None) -> Column:
    """The characters before the mention after which most others begin within so many characters; -1 for none.

    Mentions are taken from the last one back, each with those that begin close behind it, which are few as they don't overlap.
    All mentions count, or so many first ones if first is given.
    """
    q = query.lower()
    place = lambda n, back: F.struct(n.alias("n"), back.alias("back"))
    state = lambda back, near, best: F.struct(back.alias("back"), near.alias("near"), best.alias("best"))
    start = state(F.lit(0), F.array().cast("array<int>"), place(F.lit(0), F.lit(0)))

    def met(acc, part):  # a part of the text, and the mention before it; of equally dense mentions the earlier one counts
        back = acc["back"] + F.char_length(part) + len(q)
        counted = lambda near: state(back, near, F.when(F.size(near) >= acc["best"]["n"], place(F.size(near), back)).otherwise(acc["best"]))
        return once(F.concat(F.filter(acc["near"], lambda o: back - o <= ahead), F.array(back)), counted)

    def densest(parts: Column) -> Column:
        n = F.size(parts) - 1
        rest = F.slice(parts, 2, F.greatest(n if first is None else F.least(n, F.lit(first)), F.lit(0)))
        spot = lambda acc: F.char_length(F.get(parts, F.lit(0))) + acc["back"] - acc["best"]["back"]
        return F.when(F.lit(q == "") | (n == 0), -1).otherwise(F.aggregate(F.reverse(rest), start, met, spot))

    return once(F.split(F.lower(text), r"\Q" + q + r"\E", -1), densest)


def snippet(text: Column, query: str) -> Column:
    """300 characters around the densest mention of the query, else around its first word that occurs."""
    from .language import snippet_text
    from .query import query_tokens

    words = query_tokens(query)

    def place(flat: Column) -> Column:
        first = once(F.lower(flat), lambda low: F.array_min(F.array(*(F.when(F.instr(low, t) > 0, F.instr(low, t) - 1) for t in words)))) if words else F.lit(0)
        at = lambda found: F.greatest(F.when(found >= 0, found).otherwise(F.coalesce(first, F.lit(0))) - 100, F.lit(0))
        return once(densest_mention(flat, query), at)

    def cut(flat: Column, start: Column, n: Column) -> Column:
        shown = F.regexp_replace(F.substring(flat, start + 1, F.lit(300)), r"^[ ,.;:\-\n\t]+|[ ,.;:\-\n\t]+$", "")
        return F.concat(F.when(start > 0, F.lit("… ")).otherwise(""), shown, F.when(start + 300 < n, F.lit(" …")).otherwise(""))

    def around(flat: Column) -> Column:
        n = F.char_length(flat)
        start = once(place(flat), lambda at: F.when(at + 300 > n, F.greatest(n - 300, F.lit(0))).otherwise(at))
        return once(start, lambda s: cut(flat, s, n))

    return once(snippet_text(text), around)

