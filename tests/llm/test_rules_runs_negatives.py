"""Periodic runs against brute force, hard negatives against plain products, URL filters against small graphs worked out by hand."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from palaver.llm import negatives, runs, urls
from palaver.llm.queries import QUERIES, made_periodic


def brute_runs(words, least=runs.LEAST, times=runs.TIMES):
    out, known = {}, {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    for q in range(1, len(words) // times + 1):
        same = np.concatenate([[False], ids[:-q] == ids[q:], [False]])
        first, end = np.flatnonzero(~same[:-1] & same[1:]), np.flatnonzero(same[:-1] & ~same[1:])
        for s, e in zip(first.tolist(), end.tolist(), strict=True):
            if e - s + q >= max(least, times * q):
                out.setdefault((s, e - s + q), q)
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def brute_row(text):
    words = text.split()
    own = brute_runs(words)
    gone = {i for s, n, q in own for i in range(s + q, s + n)}
    best = max(own, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    return (len(own), *(best or (None,) * 3), best and 1000 * best[1] // best[2], digest("".join(f"{s},{n},{q}\n" for s, n, q in own).encode()), digest(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def periodic(r, n):
    w = []
    while len(w) < n:
        w += [r.choice("abc") for _ in range(r.randint(1, 6))] if r.random() < 0.5 else [r.choice("abcd") for _ in range(r.randint(1, 7))] * r.randint(2, 7)
    return " ".join(w)


COLUMNS = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_runs_of_odd_texts_equal_brute_force(spark):
    r = random.Random(11)
    texts = [None, "", " \t\n", "a", "a " * 6, "a " * 5, "x y " * 4, "x y x y x y x", "é\u2003é\u2003é " * 7, "a " * 3_000 + "b", "w1 w2 w3 w4 w5 " * 3 + "w1 w2 w3 w4", " ".join(map(str, range(3000))) + " " + "k l m " * 900]
    texts += [periodic(r, r.randint(0, 150)) for _ in range(300)]
    rows = [(i % 290 if i else None, x, 1, "start") for i, x in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs int, collapsed string").repartition(3)
    got = sorted(tuple(x) for x in runs.digests(runs.found(df)).select(F.coalesce("doc_id", F.lit(-1)), *COLUMNS).collect())
    assert got == sorted((-1 if i is None else i, *brute_row((x or "").encode())) for i, x, *_ in rows)
    assert runs.digests(runs.found(df.limit(0))).count() == 0


@pytest.mark.parametrize(("least", "times"), [(6, 4), (4, 2), (3, 3), (9, 2), (1, 2)])
def test_runs_of_other_bounds_equal_brute_force(least, times):
    r = random.Random(least)
    for _ in range(60):
        texts = [periodic(r, r.randint(0, 90)).encode() for _ in range(4)]
        t, s, e, q = runs.in_texts(texts, least, times)
        of = np.searchsorted(t.first_word + t.n_words, s, "right")
        got = [[(int(a - t.first_word[i]), int(b - a), int(c)) for a, b, c, o in zip(s, e, q, of, strict=True) if o == i] for i in range(4)]
        assert got == [brute_runs(x.split(), least, times) for x in texts]


def test_the_query_of_runs_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want, planted = {}, 0
    for d in docs:
        words, h = (d.text or "").encode().split(), zlib.crc32(str(d.doc_id).encode())
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            planted += 1
        want[d.doc_id] = brute_row(b" ".join(words))
    got = {x.doc_id: tuple(x[c] for c in COLUMNS) for x in QUERIES["op11_periodic_runs"](spark, "/root/testdata/sf0.001").collect()}
    assert got == want and planted > 5 and sum(w[0] > 0 for w in want.values()) > 5
    assert made_periodic(None, b"a b") == b"a b" and made_periodic(7, b"") == b""


def brute_negatives(rows, is_anchor, positives, k, low, high):
    own = [(i, label, negatives.whole(v)) for i, label, v in rows if label is not None]
    own = [(n, *x) for n, x in enumerate(own) if x[2] is not None]
    out = []
    for a, i, label, v in own:
        if i is None or not is_anchor(i):
            continue
        scored = sorted((-int(np.dot(v.astype(object), w.astype(object))), j, n, other == label) for n, j, other, w in own if n != a)
        for s, j, _, alike in [x for x in scored if x[3]][:positives]:
            fit = [x for x in scored if not x[3] and low * -s <= 100 * -x[0] <= high * -s][:k]
            out += [(i, j, rank, x[1], -s, -x[0]) for rank, x in enumerate(fit, 1)]
    return sorted(out)


@pytest.mark.parametrize(("spread", "dim", "kinds"), [(0.1, 8, 40), (3.0, 5, 200), (60_000.0, 16, 200), (0.004, 3, 200)])
def test_negatives_equal_plain_products(spark, monkeypatch, spread, dim, kinds):
    monkeypatch.setattr(negatives, "ANCHOR_BLOCK", 16)
    monkeypatch.setattr(negatives, "ROWS", 64)
    monkeypatch.setattr(negatives, "ANCHORS", 7)
    monkeypatch.setattr(negatives, "TASK_ROWS", 100)
    r = np.random.default_rng(dim)
    pool = (r.standard_normal((kinds, dim)) * spread + spread / 2).tolist()
    rows = [(int(r.integers(0, 400)), int(r.integers(0, 4)), pool[int(r.integers(0, kinds))]) for _ in range(500)]
    odd = [(10, None, pool[0]), (20, 1, None), (30, 1, []), (40, 1, [None] * dim), (50, 1, [float("nan")] * dim), (60, 1, [float("inf")] * dim), (70, 9, [0.0] * dim), (80, 1, [1e300] * dim), *[rows[0]] * 30]
    df = spark.createDataFrame([(*x, 1, 2) for x in rows + odd], "vec_id long, label long, embedding array<double>, rank int, id long").repartition(3)
    got = sorted(tuple(x) for x in negatives.mined(df, lambda i: i % 10 == 0, positives=3, k=4, low=30, high=95).collect())
    assert got == brute_negatives(rows + odd, lambda i: i % 10 == 0, 3, 4, 30, 95) and got
    if dim == 8:
        assert negatives.mined(df.limit(0), lambda i: i % 10 == 0).count() == 0
        short = df.unionByName(spark.createDataFrame([(100, 1, [0.5], 1, 2), *((None, 8, v, 1, 2) for v in pool)], df.schema))
        assert negatives.mined(short, lambda i: i % 10 == 0, k=200).where("negative_id IS NULL").count() > 0


def test_urls_of_odd_pages(spark):
    rows = [
        (1, None, None), (2, "no scheme", "<a href='//x.net/'>"), (3, "http://", ""), (4, "HTTP://WWW.Example.ORG/es/1?x#y", None), (5, "http://org/a", None), (6, "http://borg/a", None), (7, "http://a.org", None), (7, "http://a.org", None),
        (8, "a://b://c/d", None), (9, "x\ny://Ünï.com:80/fr/\n?q", None), (10, "http://example.org/en/12", None), (11, "http://example.org?/es/", None), (12, "http://a.b.com/de/x", None), (13, "http://a.b.com/en/x", None), (14, "http://b.com/fr/x", None),
    ]
    df = spark.createDataFrame([(*x, "h", "r") for x in rows], "page_id long, url string, html string, host string, rule string")
    got = sorted((x.page_id, x.host, x.path, x.rule, x.verdict) for x in urls.judged(df).collect())
    assert [(i, h, p, r or "", v) for i, h, p, r, v in got] == [
        (1, "", "", "", "allow"), (2, "", "", "", "allow"), (3, "", "", "", "allow"), (4, "www.example.org", "/es/1", "example.org/es/", "block"), (5, "org", "/a", "org/", "allow"), (6, "borg", "/a", "", "allow"), (7, "a.org", "", "", "allow"), (7, "a.org", "", "", "allow"),
        (8, "b:", "//c/d", "", "allow"), (9, "Ünï.com:80", "/fr/\n", "", "allow"), (10, "example.org", "/en/12", "example.org/en/1", "block"), (11, "example.org", "", "", "block"), (12, "a.b.com", "/de/x", "com/de/", "block"), (13, "a.b.com", "/en/x", "", "block"), (14, "b.com", "/fr/x", "com/fr/", "allow"),
    ]
    assert urls.judged(df.limit(0)).count() == 0


def test_distrust_goes_against_links_and_trust_along_them(spark):
    rules = (("allow", "good.net", "/"), ("block", "bad.net", "/"))
    pages = [("good.net", "near.net"), ("near.net", "far.net"), ("fan.net", "bad.net"), ("fan.net", "x.net"), ("of-fan.net", "fan.net"), ("bad.net", "victim.net"), ("both.net", "bad.net"), ("good.net", "both.net"), ("bad.net", None), ("alone.net", "alone.net")]
    rows = [(n, f"http://{a}/", f'<p><A class=x HREF = "HTTPS://{b.upper()}/y?z">l</A> <a href=//{b}#q>again</a> <a href="/own">' if b else None) for n, (a, b) in enumerate(pages)]
    got = {x.host: (x.verdict, x.trust, x.distrust) for x in urls.judged(spark.createDataFrame(rows, "page_id long, url string, html string"), rules).collect()}
    million, fan, both = 1_000_000, 2 * 850_000 // 2, 850_000
    assert got["good.net"] == ("allow", 2 * million, both * 85 // 100)
    # two hosts link to the bad one; it passes distrust to both in equal parts, and nothing to whom it links
    assert got["fan.net"] == ("block", 0, fan) and got["of-fan.net"] == ("block", 0, fan * 85 // 100)
    assert got["near.net"] == ("allow", 850_000, 0) and got["bad.net"][0] == "block" and got["alone.net"] == ("allow", 0, 0) and "victim.net" not in got
    assert got["both.net"] == ("allow", 850_000, 850_000)


def test_the_longest_rule_wins(spark):
    rules = (("block", "net", "/a/"), ("allow", "x.net", "/a/b"), ("block", "w.x.net", "/a/b"), ("allow", "net", "/a/b/c/d/e/f"))
    urls_ = {"http://y.net/a/": "block", "http://x.net/a/b": "allow", "http://w.x.net/a/b": "block", "http://w.x.net/a/b/c/d/e/f": "allow", "http://v.w.x.net/a/bc": "block", "http://ax.net/a/b": "block"}
    df = spark.createDataFrame([(n, u, None) for n, u in enumerate(urls_)], "page_id long, url string, html string")
    assert [x.verdict for x in urls.judged(df, rules).orderBy("page_id").collect()] == list(urls_.values())
