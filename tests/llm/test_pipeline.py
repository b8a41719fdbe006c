"""The pipeline against a plain version of each of its stages, and the switches for hot groups against results without them."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from palaver.llm import neighbours, packing, passages, tokens

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def _documents():
    r = random.Random(11)
    vocabulary = ["".join(r.choice("abcdefghijklmnopqrstuvé") for _ in range(r.randint(2, 9))) for _ in range(900)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage = prose(60)
    texts = [prose(r.randint(25, 400)) for _ in range(50)]
    texts += texts[:5] + [t + " more" for t in texts[5:12]]
    texts += [f"{prose(90)} {passage}\n{prose(r.randint(30, 90))}" for _ in range(12)]
    texts += [None, "", "too short", prose(40) + " # $ | <> " * 20, "\n".join([prose(10)] * 9), prose(9000)]
    rows = [(i * 37 % 101, t, "en", r.choice(["a", "a", "a", "b", "é", None]), len(t or "")) for i, t in enumerate(texts)]
    return rows + [rows[20]]


def _passes(text):
    words, lines = WORDS.findall(text or ""), [x for x in (text or "").split("\n") if WORDS.search(x)]
    n, seen = len(words), {}
    for i in range(n - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    again = {i + k for own in seen.values() if len(own) > 1 for i in own for k in range(8)}
    chars, symbols = sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or ""))
    return not (n < 20 or 100 * len(again) > 30 * n or 10 * symbols > n or 2 * (len(lines) - len(set(lines))) > len(lines) or chars < 2 * n or chars > 15 * n or _more_rules(words, lines))


def _more_rules(words, lines):
    pairs = Counter(zip(words, words[1:]))
    bullets = sum(bool(re.match(r"[ \t\r\f\v]*[-*•]", x)) for x in lines)
    ellipses = sum(bool(re.search(r"(\.\.\.|…)[ \t\r\f\v]*$", x)) for x in lines)
    alphabetic = sum(bool(re.search(r"[A-Za-z]|[^\x00-\x7f]", w)) for w in words)
    return 10 * bullets > 9 * len(lines) or 10 * ellipses > 3 * len(lines) or 10 * alphabetic < 6 * len(words) or 10 * max(pairs.values(), default=0) > len(words)


def _least_of_each_group(rows):
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((r[0], WORDS.findall(r[1].translate({c: c + 32 for c in range(65, 91)}))) for r in rows)}
    of = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                low, high = sorted((of[a], of[b]))
                of = {i: low if c == high else c for i, c in of.items()}
    return list(dict.fromkeys(r for r in rows if of[r[0]] == r[0]))


def _without_repeats(rows):
    first, out = {}, {}
    for i, t in sorted({(r[0], r[1]) for r in rows}):
        b = t.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if first.setdefault(b[p : p + 100], (i, p)) != (i, p):
                gone[p : p + 100] = b"\1" * 100
        out[i] = bytes(x for x, g in zip(b, gone, strict=True) if not g).decode(errors="ignore")
    return [(r[0], out[r[0]], *r[2:]) for r in rows]


def _mixed(rows):
    size = {}
    for r in rows:
        size[r[3]] = size.get(r[3], 0) + len(WORDS.findall(r[1]))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, left, open_ = {}, 1.5 * sum(size.values()), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * size[s]}
        target |= {s: 2.0 * size[s] if s in full else level * weight[s] for s in full or open_}
        left -= sum(2 * size[s] for s in full)
        open_ = open_ - full if full else set()
    out = []
    for r in rows:
        rate = target[r[3]] / size[r[3]]
        key = f"{r[0]}:{hashlib.md5(r[1].encode()).hexdigest()}:0:17"  # no two rows here are equal, so each one's number is 0
        part = int(hashlib.md5(key.encode()).hexdigest()[:13], 16) / 16**13
        out += [r] * (int(rate) + (part < rate - int(rate)))
    return out


def _pieces(rows):
    encode = Tokenizer.from_file(tokens.vocabulary("word_bpe_49k.json")).encode
    for r in rows:
        ids = np.array([*encode(r[1], add_special_tokens=False).ids, 1], "<u4")
        for k, at in enumerate(range(0, len(ids), 4096)):
            own = ids[at : at + 4096]
            yield r[0], k, at, len(own), zlib.crc32(own.tobytes())


def test_pipeline_equals_plain_stages(spark, tmp_path):
    rows = _documents()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = [r for r in rows if _passes(r[1])]
    alone = _least_of_each_group(kept)
    want = list(_pieces(_mixed(_without_repeats(alone))))
    assert len(rows) > len(kept) > len(alone) > 40
    assert sorted((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in got) == sorted(want)
    used: dict = {}
    for x in sorted(got, key=lambda x: (x.sequence_id, x.offset)):
        assert used.get(x.sequence_id, 0) == x.offset
        used[x.sequence_id] = x.offset + x.length
    gaps: list = []
    for n in sorted((p[3] for p in want), reverse=True):
        fit = min((g for g in gaps if g >= n), default=None)
        if fit is not None:
            gaps.remove(fit)
        gaps.append((fit or 4096) - n)
    assert max(used.values()) <= 4096 and len(used) == len(gaps)
    assert all(zlib.crc32(np.array(x.ids, "<u4").tobytes()) == x.ids_crc32 and len(x.ids) == x.length for x in got)
    assert len({(x.row, x.piece) for x in got}) == len(got)


def test_sequences_hold_their_pieces_in_order(spark):
    docs = spark.createDataFrame([(i, "some words of a text " * (i * 37 % 90)) for i in range(40)] + [(3, "twice"), (3, "twice")], "doc_id long, text string")
    parts = packing.packed(docs, 64, ids=True).collect()
    want: dict = {}
    for x in sorted(parts, key=lambda x: (x.sequence_id, x.offset)):
        want.setdefault(x.sequence_id, []).extend(x.ids)
    assert {x.sequence_id: list(x.ids) for x in packing.sequences(docs, 64).collect()} == want


def test_stages_take_any_column_names(spark):
    extra = "node row doc mark places __row __size __source __target __id __of __copies __source_size __dropped b kept".split()
    docs = spark.createDataFrame([(i, f"text {i} " + "of some words that go on " * 30, "en", "a", 9, *([i] * len(extra))) for i in range(12)], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} long" for c in extra))
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        got = stage(spark, docs, "").collect()
        assert got and all(x[c] == x.doc_id for x in got for c in extra)


def test_rows_that_share_an_id_or_have_none_stay_apart(spark):
    r = random.Random(31)
    text = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    a, b, c, d = text(300), text(300), text(600), text(500)
    rows = [(1, a), (5, a + text(50)), (5, b), (None, c), (None, d), (None, d + a), (None, None), (7, d), (7, d)]
    got = [(x.doc_id, x.n_bytes, x.n_removed) for x in passages.removed(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert (5, 300, 0) in got and (5, 350, 300) in got and (None, 600, 0) in got and (None, 0, 0) in got
    assert sum(n for i, _, n in got if i is None) == 500 and got.count((7, 500, 500)) == 2 and (1, 300, 300) in got
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {(x.doc_id, x.text) for x in corpus_pipeline.passage_dedup(spark, docs, "").collect()}
    assert {(5, b), (None, c), (None, None)} <= kept
    words = lambda k: " ".join(f"{k}{r.randrange(10**6)}" for _ in range(60))
    one, two, three = words("a"), words("b"), words("c")
    rows = [(1, one), (2, two), (2, one), (None, three), (None, three), (None, one), (3, two), (4, None), (4, None), (5, "")]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(x.doc_id, x.text) for x in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert sorted(got, key=str) == sorted([(1, one), (2, two), (None, three), (4, None), (5, "")], key=str)


def test_near_dedup_links_from_four_fifths(spark):
    r = random.Random(17)
    rows = []
    for i, tail in enumerate((20, 22, 24, 26) * 5):  # similarities of 196 / (196 + 2 * tail)
        words = [f"d{i}w{r.randrange(10**9)}" for _ in range(200 + tail)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:200] + [w + "x" for w in words[200:]]))]
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for _, t in rows]
    share = [len(sets[k] & sets[k + 1]) / len(sets[k] | sets[k + 1]) for k in range(0, len(rows), 2)]
    assert sum(0.8 <= x < 0.85 for x in share) >= 10 and sum(x < 0.8 for x in share) >= 5
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {x.doc_id for x in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert kept == {2 * i for i in range(20)} | {2 * i + 1 for i, x in enumerate(share) if x < 0.8}


def test_stages_keep_the_columns(spark, tmp_path):
    docs = spark.createDataFrame(_documents(), "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns
        assert stage(spark, docs.limit(0), "").count() == 0


def test_hot_anchors_are_whole(spark, monkeypatch):
    r = random.Random(13)
    shared = "".join(r.choice("abcdé ") for _ in range(260))
    rows = []
    for i in range(80):
        a, b = r.randint(0, 120), r.randint(121, 260)
        rows.append((i * 7 % 83, "".join(r.choice("xyz") for _ in range(r.randint(0, 40))) + shared[a:b] + "".join(r.choice("xyz") for _ in range(r.randint(0, 40))) + shared[a // 2 : b]))
    rows += [rows[3], (200, "ab" * 200), (201, "b" * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, passages.removed(df).collect()))
    monkeypatch.setattr(passages, "MOST_CONTEXTS", 1)
    assert sorted(map(tuple, passages.removed(df).collect())) == want
    monkeypatch.setattr(passages, "MOST_CONTEXTS", 5)
    assert sorted(map(tuple, passages.removed(df).collect())) == want
    assert sum(x[2] for x in want) > 5000


def test_crowded_leaves_are_dealt_into_parts(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding")
    find = lambda: sorted((x.query_id, x.rank, x.vec_id, round(x.score, 9)) for x in neighbours.nearest(df, lambda i: i % 20 == 0).collect())
    want = find()
    monkeypatch.setattr(neighbours, "MEET_ROWS", 7)
    assert find() == want
