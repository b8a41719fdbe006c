"""The training-data operators against SQL, brute force, the tokenizers' library and held-out rows; odd input of each kind."""

import hashlib
import random
import time

import numpy as np
import pytest

from palaver.llm import bpe, chat, extraction, licences, minhash, mixing, neighbours, packing, passages, quality, tokens
from palaver.llm.queries import QUERIES, SQL

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words long, component_id string"
ODD = [
    (1, None, "en", "a", None, 7, "x"),
    (2, "", "en", None, 0, 7, "x"),
    (3, " \t\n", None, "b", 3, 7, "x"),
    (4, "one two", "en", "a", 7, 7, "x"),
    (4, "one two", "en", "a", 7, 7, "x"),
    (None, "w " * 5000 + "tail", "en", "é", 10004, 7, "x"),
    (6, "Quick brown foxes jump over lazy dogs " * 4 + "\0 <|endoftext|> ¿Σας?", "en", "a", 170, 7, "x"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.mark.parametrize("name", SQL)
def test_equals_sql(name, against_sql):
    against_sql(QUERIES[name], SQL[name])


def test_every_quality_rule_rejects_its_own_texts():
    r = random.Random(43)
    prose = lambda n: " ".join("".join(r.choice("abcdefg") for _ in range(r.randint(3, 8))) for _ in range(n))
    bad = {
        "few_words": prose(5), "repeated_words": prose(10) + (" " + prose(1)) * 3 + " a b c d e f g h i" * 8, "symbols": prose(30) + " # | $ %", "repeated_lines": "\n".join([prose(8)] * 3),
        "word_length": "a " * 30, "bullets": "\n".join(f"{c} {prose(9)}" for c in "-*•-"), "ellipses": "\n".join(f"{prose(9)}{e}" for e in ("...", "…", " .", "")), "alphabetic": prose(15) + " 12 34 5 6 7 8 9 10 11 13 14 15 16", "one_pair": " ".join(f"{prose(3)} my own" for _ in range(9)),
    }
    for rule in quality.RULES:
        kept = quality.judge([bad[rule.name].encode(), prose(60).encode(), b""], (rule,))
        assert kept[:2].tolist() == [False, True], rule.name
    assert quality.judge([prose(60).encode()], quality.RULES).all()


def test_every_operator_takes_odd_and_empty_tables(spark, odd):
    calls = (quality.measured, quality.keep, mixing.taken, mixing.mix, minhash.near_duplicates, minhash.deduplicated, passages.removed, passages.without_repeats, packing.packed, tokens.counted, licences.scanned)
    grown = {"mix", "packed", "scanned", "keep", "deduplicated"}
    for f in calls:
        n = len(f(odd).collect())
        assert n == len(ODD) or f.__name__ in grown, f.__name__
        assert f(odd.limit(0)).count() == 0, f.__name__
    for f in (quality.keep, minhash.deduplicated, passages.without_repeats, mixing.mix):
        assert f(odd).columns == odd.columns


@pytest.mark.parametrize(("file", "split"), [("byte_bpe_50k.json", bpe.ByteLevel), ("word_bpe_49k.json", bpe.WordLevel)])
def test_ids_equal_the_library(file, split):
    from tokenizers import Tokenizer

    texts = [t[1] or "" for t in ODD] + [" \x1c\x1d aaaa\x85 don't DON'T ΟΔΟΣ İx", "東京 ١٢٣ ½ é é", "a" * 999 + "ab" * 99, "a<|endoftext|>b <|startoftext|>"]
    path = tokens.vocabulary(file)
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe.Encoder(path, split)(texts)] == want
    assert bpe.Encoder(path, split, counts=True)(texts) == list(map(len, want))


def test_packing_is_gapless_and_best_fit(spark):
    r = random.Random(3)
    lengths = [r.randint(1, r.choice([40, 9])) for _ in range(500)]
    got = packing.placed(spark.createDataFrame(list(enumerate(lengths)), "key long, length long"), 40).collect()
    used: dict = {}
    for x in sorted(got, key=lambda x: (x.sequence_id, x.offset)):
        assert used.get(x.sequence_id, 0) == x.offset
        used[x.sequence_id] = x.offset + x.length
    assert len(got) == 500 and max(used.values()) <= 40
    gaps: list = []
    for n in sorted(lengths, reverse=True):
        fit = min((g for g in gaps if g >= n), default=None)
        if fit is not None:
            gaps.remove(fit)
        gaps.append((fit or 40) - n)
    assert len(used) == len(gaps)


def test_chat_round_trip():
    for t in ("</s>[INST] ok [/INST]", "\\", "\\<s>", "<|turn|><|turn|>", "a\\\nb", ""):
        assert chat.unescape(chat.escape(t)) == t
        assert not any(c in chat.escape(t) for c in (*chat.MARKS, *chat.FOREIGN))


def test_chat_takes_nulls_ties_repeats_and_long_turns(spark):
    rows = [(1, 1, "assistant", "b</s>", 9), (1, 0, "user", None, 9), (1, 1, "assistant", "a", 9), (1, 1, None, "z", 9), (1, 1, "assistant", "a", 9), (None, 0, "user", "n", 9), (None, None, "assistant", "m", 9), (2, 0, "assistant", "long \\ <|turn|> " * 20_000, 9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, ids long")
    got = {x.conv_id: x for x in chat.read_back(chat.assembled(df)).collect()}
    for key in (1, None, 2):
        own = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x, _ in rows if c == key))
        loss = "".join(x for *_, r, x in own if r == "assistant")
        assert got[key].n_turns == len(own) and got[key].loss_chars == len(loss)
        assert got[key].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for *_, r, x in own).encode()).hexdigest()
        assert got[key].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.read_back(chat.assembled(df.limit(0))).count() == 0


def test_counts_and_ids_of_a_whole_table_equal_the_library(spark):
    from tokenizers import Tokenizer

    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    texts = [r.text or "" for r in rows]
    for file, split in (("byte_bpe_50k.json", bpe.ByteLevel), ("word_bpe_49k.json", bpe.WordLevel)):
        path = tokens.vocabulary(file)
        want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
        assert [np.frombuffer(x, "<u4").tolist() for x in bpe.Encoder(path, split)(texts)] == want
    got = {r.doc_id: r.n_tokens for r in tokens.counted(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()}
    want = {r.doc_id: len(e.ids) for r, e in zip(rows, Tokenizer.from_file(tokens.vocabulary("byte_bpe_50k.json")).encode_batch(texts, add_special_tokens=False), strict=True)}
    assert got == want


def _brute_removal(rows):
    first, out = {}, {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if first.setdefault(b[p : p + 100], (i, p)) != (i, p):
                gone[p : p + 100] = b"\1" * 100
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[i] = (i, len(b), len(b) - len(kept), sum(1 for k in range(len(b)) if gone[k] and (not k or not gone[k - 1])), hashlib.sha256(kept).hexdigest())
    return out


def test_repeated_passages_equal_brute_force(spark):
    r = random.Random(5)
    base = ["".join(r.choice("abcdé ") for _ in range(400)) for _ in range(5)]
    rows = [(i * 7 % 61, "".join(r.choice(base)[r.randint(0, 150) :][: r.randint(50, 250)] for _ in range(r.randint(0, 4)))) for i in range(60)]
    rows += [(100, "a" * 500), (101, "ab" * 300), (102, None), (104, "a" * 99), (105, "a" * 100), (106, "\0" * 300)]
    got = {x[0]: tuple(x) for x in passages.removed(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == _brute_removal(rows)


def test_large_groups_of_near_copies_are_whole_when_dealt_into_blocks(spark, monkeypatch):
    r = random.Random(7)
    words = [f"w{k}" for k in range(300)]
    rows = []
    for i in range(60):
        own = list(words)
        for _ in range(r.randint(0, 5)):
            own[r.randrange(300)] = f"x{i}"
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, minhash.near_duplicates(df).collect()))
    monkeypatch.setattr(minhash, "GROUP_SHINGLES", 2000)
    assert sorted(map(tuple, minhash.near_duplicates(df).collect())) == want
    sets = [{tuple(t.split()[k : k + 5]) for k in range(296)} for _, t in rows]
    label = list(range(60))
    for a in range(60):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                label = [min(label[a], label[b]) if x in (label[a], label[b]) else x for x in label]
    assert [x[2] for x in want] == label


@pytest.mark.parametrize("chain", [False, True])
def test_hot_groups_are_met_by_few_rows_and_never_broadcast_dealt(spark, monkeypatch, chain):
    r = random.Random(19)
    words = [f"w{k}" for k in range(300)]
    rows = []
    for i in range(60):
        if chain:  # each is near the last one, the first ones are far from the last ones
            words = [f"x{i}" if 5 * i <= k < 5 * i + 5 else w for k, w in enumerate(words)]
            rows.append((i * 7 % 60, " ".join(words)))
        else:
            rows.append((i, " ".join(f"x{i}" if k == 5 * i else w for k, w in enumerate(words))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, minhash.near_duplicates(df).collect()))
    assert {x[2] for x in want} == {0}
    sent, met, linked, broadcast = [], [], minhash._linked, minhash.F.broadcast
    monkeypatch.setattr(minhash, "GROUP_SHINGLES", 2000)
    monkeypatch.setattr(minhash, "BROADCAST_ROWS", 100)
    monkeypatch.setattr(minhash.F, "broadcast", lambda x: sent.append(x.count()) or broadcast(x))
    monkeypatch.setattr(minhash, "_linked", lambda groups, *a, **k: met.append(groups.count()) or linked(groups, *a, **k))
    assert sorted(map(tuple, minhash.near_duplicates(df).collect())) == want
    assert max(sent, default=0) <= 100
    assert chain or sum(met) < 5 * 60


def test_forest_connects_what_all_pairs_connect():
    r = random.Random(29)
    for case in range(60):
        n = r.randint(2, 30)
        sets = [sorted(r.sample(range(24), r.randint(1, 24))) for _ in range(n)]
        sets += [sorted({*s[:-1], r.randrange(24)}) for s in sets]
        label = list(range(len(sets)))
        join = lambda of, a, b: [min(of[a], of[b]) if x in (of[a], of[b]) else x for x in of]
        pairs = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len({*sets[a]} & {*sets[b]}) >= 85 * len({*sets[a]} | {*sets[b]})]
        some = r.sample(pairs, len(pairs) // 2)
        known = label
        for a, b in pairs:
            label = join(label, a, b)
        for a, b in some:
            known = join(known, a, b)
        key, sizes = np.array([x for s in sets for x in s], np.uint64), np.array([len(s) for s in sets])
        for start, labels in ((range(len(sets)), None), (known, known)):
            got = list(start)
            for a, b in minhash.forest(list(range(len(sets))), key, sizes, 85, labels):
                assert got[a] != got[b] and label[a] == label[b]
                got = join(got, a, b)
            assert got == label


def test_short_near_copies_that_no_leader_links_take_no_pairs():
    r = random.Random(37)
    words = [f"w{k}" for k in range(41)]
    texts = [" ".join(f"x{i}" if k == at else w for k, w in enumerate(words)).encode() for i, at in enumerate(r.randrange(41) for _ in range(20_000))]
    began = time.process_time()
    edges = minhash.forest(list(range(len(texts))), *minhash.shingle_sets(texts))
    assert time.process_time() - began < 20 and len({x for e in edges for x in e}) > 500


def test_neighbours_recall_and_odd_vectors(spark):
    folder = "/root/testdata/sf0.01"
    df = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding")
    odd = spark.createDataFrame([(9000, None), (9020, [0.0] * 64), (9040, [float("nan")] * 64), (9060, [None] * 64), (9080, [1.0])], "vec_id long, embedding array<float>")
    got = neighbours.nearest(df.union(odd), lambda i: i % 20 == 0).toPandas()
    rows = df.orderBy("vec_id").toPandas()
    x, ids = np.stack(rows.embedding).astype(float), rows.vec_id.to_numpy()
    score = x @ x.T
    np.fill_diagonal(score, -9)
    recall = []
    for q, own in got.groupby("query_id"):
        best = ids[np.argsort(-score[q], kind="stable")[:20]]
        recall.append(len(set(best) & set(own.vec_id)) / 20)
        assert np.allclose(own.sort_values("rank").score, score[q][own.sort_values("rank").vec_id])
    assert len(recall) == (ids % 20 == 0).sum() and np.mean(recall) >= 0.9
    assert neighbours.nearest(df.limit(0), lambda i: i % 20 == 0).count() == 0


def test_neighbours_in_clusters_are_found_by_few_scorings(spark, monkeypatch):
    rng = np.random.default_rng(41)
    centres = rng.standard_normal((2_100, 64))
    x = np.repeat(centres, 25, axis=0) + 0.2 * rng.standard_normal((52_500, 64))
    import pyarrow as pa

    df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 64).cast(pa.list_(pa.float64()))}))
    seen, settled = [], neighbours.settled
    monkeypatch.setattr(neighbours, "settled", lambda forest, *a: seen.append((settled(forest, *a), forest)) or seen[0][0])
    got = neighbours.nearest(df, lambda i: i % 20 == 0).toPandas()
    visits, forest = seen[0]
    assert visits / (1 << forest.depth) <= 0.1  # of the vectors scored for a query
    score = x[::20] @ x.T
    score[np.arange(len(score)), np.arange(0, len(x), 20)] = -np.inf
    best = np.argpartition(-score, 20, axis=1)[:, :20]
    own = got.groupby("query_id").vec_id.apply(set)
    assert len(own) == len(score) and np.mean([len(own[20 * i] & set(b.tolist())) / 20 for i, b in enumerate(best)]) >= 0.9


def test_neighbours_cut_ties_by_the_returned_score_and_take_odd_rows(spark):
    rows = [(i, [float(i % 3 == j) for j in range(4)], 7) for i in range(300)]
    rows += [(20, [0.0, 0.0, 0.5, 0.0], 7), (20, [0.0, 0.0, 0.5, 0.0], 7), (400, [1.0, 0.0, 0.0, 0.0], 7), (None, [1.0] * 4, 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id long")
    want = []
    for q in {r[0] for r in rows if r[0] is not None and r[0] % 20 == 0}:
        best: dict = {}
        for a, u, _ in rows:
            for b, v, _ in rows:
                if a == q and b is not None and b != q:
                    best[b] = max(best.get(b, -9), sum(m * n for m, n in zip(u, v, strict=True)))
        want += [(q, n + 1, b, s) for n, (b, s) in enumerate(sorted(best.items(), key=lambda z: (-z[1], z[0]))[:20])]
    assert sorted(map(tuple, neighbours.nearest(df, lambda i: i % 20 == 0).collect())) == sorted(want)


def test_licences_on_held_out_and_planted_lines(spark):
    assert licences.Scanner(spark).accuracy > 0.95
    text = "prose of a kind\nReleased under the MIT License.\nLicensed under the Apache License, Version 2.0."
    got = licences.scanned(spark.createDataFrame([(1, text), (2, "a general public house"), (3, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.n_licence_paragraphs, r.families) for r in got] == [(2, "apache,mit"), (0, ""), (0, "")]


WRAPPED = {
    "mit": """MIT License

Copyright (c) 2021 A. Writer

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:""",
    "bsd": """Copyright (c) 2021, A. Writer. All rights reserved.

# Redistribution and use in source and binary forms, with or without
# modification, are permitted provided that the following conditions are met:
#
# 1. Redistributions of source code must retain the above copyright notice, this
#    list of conditions and the following disclaimer.""",
    "apache": """Licensed under the Apache License, Version
2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at""",
    "gpl": """    This program is free software: you can redistribute it and/or modify\r
    it under the terms of the GNU General Public License as published by\r
    the Free Software Foundation, either version 3 of the License, or\r
    (at your option) any later version.""",
}


WORDINGS = {
    "This library is available under the terms of the MIT License.": "mit",
    "You may choose between the conditions of the Mozilla Public License, version 2.0, and others.": "mpl",
    "SPDX-License-Identifier: LGPL-2.1-or-later": "lgpl",
    "it under the terms of the GNU Lesser General Public License as published by\nthe Free Software Foundation; either version 2.1 of the License": "lgpl",
    "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that": "isc",
    "All of it comes with the Eclipse Public License v. 2.0, which is here.": "epl",
    "The server part is under the GNU Affero General Public License, version 3": "agpl",
    "This is free and unencumbered software released into the public domain.": "unlicense",
    "We never licensed under the MIT License": "",
    "This is not released under the Apache License, Version 2.0": "",
    "the mit of it and a license for the car": "",
    "The general public was at the gnu farm": "",
}


def test_licence_wordings_that_no_template_has(spark):
    df = spark.createDataFrame(list(enumerate(WORDINGS)), "doc_id long, text string")
    got = {x.doc_id: x.families for x in licences.scanned(df.union(df)).collect()}
    wrong = [(t, got[i], want) for i, (t, want) in enumerate(WORDINGS.items()) if got[i] != want]
    assert len(wrong) <= 1 and not any(found for _, found, _ in wrong)  # one may be missed, none taken for another


def test_wrapped_licence_notices_are_found(spark):
    r = random.Random(23)
    prose = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(n))
    rows = [(i, t) for i, t in enumerate(WRAPPED.values())]
    rows += [(10 + i, f"{prose(150)}\n{t.replace(chr(10) * 2, chr(10))}\n{prose(150)}") for i, t in enumerate(WRAPPED.values())]
    rows += [(20, f"{prose(200)} Released under the MIT\nLicense. {prose(200)}"), (21, "\n\n".join(WRAPPED.values())), (22, prose(40) + "\n \n" + prose(40) + "\n" + prose(9)), (21, WRAPPED["mit"]), (21, WRAPPED["mit"])]
    got = {x.doc_id: x for x in licences.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].families for i in range(4)] == list(WRAPPED)
    assert [got[10 + i].families for i in range(4)] == list(WRAPPED)
    assert (got[20].families, got[21].families, got[22].families) == ("mit", "apache,bsd,gpl,mit", "")
    assert (got[0].n_paragraphs, got[0].n_licence_paragraphs, got[20].n_paragraphs, got[22].n_paragraphs) == (3, 2, 1, 2)  # the title names the licence, too
    assert got[21].n_licence_paragraphs == 9


LAYOUTS = {
    "a paper in German, with readers' comments under a foreign class": (
        "<html><body><div class=kopf>Zeitung</div><ul class=x1><li><a href=/a>Politik</a><li><a href=/b>Sport</a></ul><div class=inhalt2><h1>Der Titel des Artikels</h1>"
        "<p>Es war einmal ein langer Absatz, der viel erzählte. Und noch ein Satz dazu.</p><p>Zweiter Absatz, der auch lang genug ist, um zu zählen.</p></div>"
        "<div class='commentaires'><h3>Kommentare</h3><div class=k><b>Anna</b> 12:30<p>Nice one!</p></div><div class=k><b>Bert</b> 12:40<p>Ja.</p></div></div><div class=unten>Impressum | Kontakt</div></body></html>",
        "Der Titel des Artikels Es war einmal ein langer Absatz, der viel erzählte. Und noch ein Satz dazu. Zweiter Absatz, der auch lang genug ist, um zu zählen.",
    ),
    "an advert without a telling class inside an article": (
        "<body><nav><a href=1>a</a></nav><article><h2>Head line here</h2><p>First real paragraph with enough words in it to be prose.</p><div class='xyz'>Buy now! Shop</div>"
        "<p>Second real paragraph with some more words to read.</p></article><footer>c</footer>",
        "Head line here First real paragraph with enough words in it to be prose. Second real paragraph with some more words to read.",
    ),
    "forms, formulas and unknown elements": (
        "<main><h1>T one two</h1><p>Paragraph text of reason<img src=x>able length, x<math><mi>y</mi></math>z, with a <my-x>comma</my-x>.</p>"
        "<form><select><option>a<option>b</select><textarea>type here</textarea></form></main>",
        "T one two Paragraph text of reasonable length, xyz, with a comma.",
    ),
}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_main_text_of_other_layouts(layout):
    source, want = LAYOUTS[layout]
    assert extraction.main_texts([source], extraction.trained()) == [want]


@pytest.mark.parametrize("piece", ["<div>", "<a ", "<textarea>", '<a href="', "<h1>", "</b></p>", "<!--", "</script ", "<script></script", "<", "&", "<b =\t", "<ul><li>"])
def test_pages_take_time_in_proportion(piece):
    began = time.process_time()
    page = extraction.Page(piece * (1_000_000 // len(piece)))
    took = time.process_time() - began
    page.decode(page.features()[:, 0])
    assert took < 4


def test_main_text_of_held_out_and_broken_pages(spark):
    from collections import Counter

    from palaver.llm.page_samples import Writer

    model = extraction.trained()
    writers = [Writer(99_000_000 + s) for s in range(200)]
    pages = [w.page() for w in writers]
    got = extraction.main_texts([p for p, _ in pages], model)
    exact = [g == " ".join(t) for g, (_, t) in zip(got, pages, strict=True)]
    assert np.mean([x for x, w in zip(exact, writers, strict=True) if not w.plain]) > 0.85
    bags = [(Counter(g.split()), Counter(" ".join(t).split())) for g, (_, t) in zip(got, pages, strict=True)]
    shared, found, wanted = (sum(sum(x.values()) for x in xs) for xs in zip(*((a & b, a, b) for a, b in bags), strict=True))
    assert shared / found > 0.95 and shared / wanted > 0.95
    broken = "<nav><a href=x>m</a></nav><article><h1>T&amp;t</h1><p>Some  words<br>here, and more of them.</article><footer>f</footer>"
    rows = [(1, None, None, 7), (2, "u", "", 7), (3, "u", "<p <a </b>><div>", 7), (4, "u", broken, 7), (4, "u", broken, 7), (None, None, broken, 7), (5, "u", f"<article><p>{'word ' * 100_000}</p></article>", 7)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text long")
    got = {(x.page_id, x.url): x for x in extraction.extracted(pages).collect()}
    assert extraction.extracted(pages).count() == len(rows) and extraction.extracted(pages.limit(0)).count() == 0
    assert [got[1, None].text, got[2, "u"].text] == ["", ""] and got[4, "u"].text == got[None, None].text == "T&t Some words here, and more of them."
    assert all(x.n_chars == len(x.text) for x in got.values()) and got[5, "u"].n_chars == 499_999


def test_main_text_of_the_test_pages_is_their_article(spark):
    import html
    import re

    for x in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").join(extraction.extracted(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")), "page_id").collect():
        own = re.search("<article>(.*?)</article>", x.html or "", re.S)
        want = re.sub("<br>", " ", re.sub("</?(p|h1)>", " ", own[1])).replace("<b>", "") if own else ""
        assert x.text == " ".join(html.unescape(want).split())
