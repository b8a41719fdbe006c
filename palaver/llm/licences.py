"""Licence scans with a trained paragraph classifier, by DataFrame and ML functions that run in the JVM.

Paragraphs are blocks of lines between lines without words, so a wrapped notice is whole. What is judged are a paragraph's
lines and, across its line ends, overlapping windows of each template's length and half as much again. Their words and word
pairs are hashed into sparse vectors; a multinomial logistic regression, trained here on statements of twenty families filled
into templates, on the same statements denied and on other prose, gives each family's probability and that of the unknown class.
The least probability that a family needs is calibrated on held-out paragraphs so that at most ``FALSE_SHARE`` of those without
a licence would pass. A line or window that passes is confirmed only if it holds at least ``COVER`` of the telling words of one
of its family's templates; those that hold as much of no template, and paragraphs that don't, can't be confirmed and never reach
the regression. Of families found in one unit's surroundings the more specific name counts: a lesser or affero licence isn't
also the general one.

Defined results: null and empty texts have no paragraphs and no licence; a paragraph that grants several families counts once
for each among the licence paragraphs; rows that repeat an id are scanned together, as one document; rows without an id are
one document; of families of equal probability the first by name counts; a very long text is scanned whole; other columns
aren't read; an empty table gives an empty one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_GRANTS = ("licensed under the {name}", "released under the {name}", "distributed under the terms of the {name}", "{name}")


def _family(names: tuple[str, ...], spdx: str, *headers: str) -> tuple[str, ...]:
    """The statements of a family: grants under each of its names, its identifier, and what its own text says first."""
    return (*(g.replace("{name}", n) for n in names for g in _GRANTS), f"spdx license identifier {spdx}", *headers)


_COPY = "you can redistribute it and or modify it under the terms of the gnu {} as published by the free software foundation"
#: What statements of each family look like; {} is a version or year.
TEMPLATES = {
    "agpl": _family(("gnu affero general public license version {}", "gnu affero general public license"), "agpl {}", _COPY.replace("{}", "affero general public license")),
    "apache": _family(("apache license version {}",), "apache {}", "you may not use this file except in compliance with the apache license version {}", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    "artistic": _family(("artistic license {}",), "artistic {}", "this package is free software you may redistribute and modify it under the artistic license"),
    "boost": _family(("boost software license version {}",), "bsl {}", "boost software license permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    "bsd": _family(("bsd license", "bsd {} clause license"), "bsd {} clause", "redistribution and use in source and binary forms with or without modification are permitted"),
    "cc": _family(("cc by {}", "cc by sa {}", "cc by nc {}", "creative commons attribution license version {}", "creative commons attribution license"), "cc by {}", "this work is licensed under a creative commons attribution license version {}"),
    "cc0": _family(("cc0 {} universal", "creative commons zero public domain dedication"), "cc0 {}", "to the extent possible under law the author has waived all copyright and related rights to this work"),
    "cddl": _family(("common development and distribution license version {}",), "cddl {}"),
    "epl": _family(("eclipse public license version {}", "eclipse public license"), "epl {}", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    "eupl": _family(("european union public licence version {}",), "eupl {}"),
    "gpl": _family(("gnu general public license version {}", "gnu general public license", "gpl version {}"), "gpl {}", _COPY.replace("{}", "general public license")),
    "isc": _family(("isc license",), "isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    "lgpl": _family(("gnu lesser general public license version {}", "gnu lesser general public license"), "lgpl {}", _COPY.replace("{}", "lesser general public license")),
    "mit": _family(("mit license",), "mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    "mpl": _family(("mozilla public license version {}", "mozilla public license"), "mpl {}", "this source code form is subject to the terms of the mozilla public license version {}"),
    "ofl": _family(("sil open font license version {}",), "ofl {}", "this font software is licensed under the sil open font license"),
    "openssl": _family(("openssl license",), "openssl", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    "unlicense": _family(("unlicense",), "unlicense", "this is free and unencumbered software released into the public domain"),
    "wtfpl": _family(("do what the fuck you want to public license",), "wtfpl"),
    "zlib": _family(("zlib license",), "zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
}
#: Prose that shares words with licences and grants none.
OTHER = (
    "the driver had a licence for the car and the public road",
    "a license to kill is the name of an old film",
    "the work of the general was released under the new version of the plan",
    "apache is the name of a people and of a helicopter",
    "permission was granted to the software team to use the room free of charge",
    "the file you may use is in this folder under the desk",
    "mit is a university and its public work is known",
    "the license plate of the car was not in the public record",
    "modification of the source is permitted by the terms of the contract",
    "creative work is common in the version of the school",
    "the eclipse was public and free for any person to see",
    "the union of european cities gave a licence to its public version",
    "a license for the mit museum shop was granted by the town",
    "the font of the software project is open to any author",
    "we compared the mit license and the gnu general public license in a table",
)
#: What turns a statement into none.
DENIALS = ("this is not {}", "we never {}", "it was not {}", "nothing here is {}", "no part of it is {}", "unlike others it is not {}", "it may not be {}", "do not assume that it is {}", "formerly {} but no longer", "instead of being {}")
#: Words that tell nothing of a family; a template's cover goes without them.
PLAIN = frozenset("a an and any are as at be been by can do for from has have in into is it its may not of on or other see that the this to under use used was we will with without within you your".split())
FAMILIES = (*TEMPLATES, "unknown")
UNKNOWN = len(TEMPLATES)
#: The end of a paragraph: one or more lines without words.
BETWEEN = r"\n(?:[^\p{L}\p{N}\n]*+\n)+"
TRAIN_ROWS, FEATURES, FALSE_SHARE, COVER = 6000, 1 << 13, 0.0005, 0.7
#: Words before a window that are judged with it, since they may deny it.
LEAD = 6


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def grams(own: Column) -> Column:
    """Words and word pairs."""
    return F.concat(own, F.transform(F.sequence(F.lit(1), F.greatest(F.size(own) - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.try_element_at(own, i), F.try_element_at(own, i + 1))))


def _pick(options: Column, n: Column) -> Column:
    return F.element_at(options, (F.pmod(n, F.size(options)) + 1).cast("int"))


def samples(spark: SparkSession, rows: int = TRAIN_ROWS) -> DataFrame:
    """text, label: licence statements with varied versions and surroundings, and as many other paragraphs."""
    h = lambda k: F.xxhash64("id", F.lit(k))
    label = F.when(F.pmod(F.col("id"), 2) == 0, F.lit(UNKNOWN)).otherwise(F.pmod(h(1), UNKNOWN)).cast("int")
    by_label = F.array(*(F.array(*map(F.lit, t)) for t in (*TEMPLATES.values(), OTHER)))
    filled = lambda own: F.replace(_pick(own, h(2)), F.lit("{}"), _pick(F.array(*map(F.lit, ("2", "3", "1 1", "2 0", "4 0", "2021", "3 0 or later"))), h(3)))
    every = F.array(*(F.array(*map(F.lit, t)) for t in TEMPLATES.values()))
    denied = F.replace(_pick(F.array(*map(F.lit, DENIALS)), h(9)), F.lit("{}"), filled(F.element_at(every, (F.pmod(h(10), UNKNOWN) + 1).cast("int"))))
    statement = F.when((F.col("label") == UNKNOWN) & (F.pmod(h(11), 2) == 0), denied).otherwise(filled(F.element_at(by_label, F.col("label") + 1)))
    # the surroundings: invented words of one to four letter pairs, and common ones
    pair = lambda k: F.concat(*(F.when(F.pmod(F.xxhash64("id", k, F.lit(j)), j + 1) == 0, F.chr((F.lit(97) + F.pmod(F.xxhash64("id", k, F.lit(10 + j)), 26)).cast("int"))).otherwise("e") for j in range(6)))
    filler = lambda k, most: F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.pmod(h(k), most), F.lit(1)).cast("int")), lambda i: F.when(F.pmod(i + h(k), 3) == 0, _pick(F.array(*map(F.lit, "the a of and in to is for with by on as la de und der the this work under version".split())), F.xxhash64("id", i, F.lit(k)))).otherwise(pair(i + F.lit(100 * k)))), " ")
    plain = F.pmod(h(4), 3) > 0
    text = F.when((F.col("label") == UNKNOWN) & plain, filler(5, 60)).when(F.pmod(h(6), 2) == 0, statement).otherwise(F.concat_ws(" ", filler(7, 6), statement, filler(8, 6)))
    return spark.range(rows).withColumn("label", label).select(text.alias("text"), "label")


def _own(template: str) -> list[str]:
    """The distinct telling words of a template."""
    return sorted({w for w in template.split() if w != "{}"} - PLAIN)


#: One template of each set of telling words: grants by other verbs hold the same ones or more.
_DISTINCT = tuple({tuple(_own(t)): t for ts in TEMPLATES.values() for t in ts if not any(t.startswith(g.split("{")[0]) for g in _GRANTS[:3])}.values())


def _cover(own: Column, template: str) -> Column:
    """The share of a template's distinct words that are among a list's."""
    return F.size(F.array_intersect(own, F.array(*map(F.lit, _own(template))))) / len(_own(template))


def _bound(value: Column, body) -> Column:
    """body(value), with value computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _holds(own: Column) -> Column:
    """Whether a list of words holds enough of any template. Most texts hold hardly any telling word, and are passed over at once."""
    every = F.array(*map(F.lit, sorted({w for ts in TEMPLATES.values() for t in ts for w in _own(t)})))
    least = min(len(_own(t)) for ts in TEMPLATES.values() for t in ts)
    enough = lambda few: reduce(lambda a, b: a | b, (_cover(few, t) >= COVER for t in _DISTINCT))
    return _bound(F.array_intersect(own, every), lambda few: F.when(F.size(few) >= least, enough(few)).otherwise(False))


def _windows(own: Column) -> Column:
    """Overlapping windows of each template's length and half as much again, with a few words before, where they hold enough of that template."""

    def of(template: str) -> Column:
        n = len(template.replace("{}", "2 0").split())
        starts = F.sequence(F.lit(1), F.greatest(F.size(own) - n, F.lit(0)) + 1, F.lit(n // 4 + 1))
        near = F.filter(starts, lambda i: _cover(F.slice(own, i, n + n // 2 + 1), template) >= COVER)
        return F.transform(near, lambda i: F.slice(own, F.greatest(i - LEAD, F.lit(1)), n + n // 2 + 1 + LEAD))

    none = F.expr("cast(array() as array<array<string>>)")
    return F.concat(*(F.when(_cover(own, t) >= COVER, of(t)).otherwise(none) for t in _DISTINCT))


def judged(blocks: DataFrame) -> DataFrame:
    """The columns of the blocks but __block, with __unit and __text for each of a block's lines and windows that holds enough of a template."""
    keys = [c for c in blocks.columns if c != "__block"]
    lines = F.transform(F.split("__block", "\n"), words)
    units = F.filter(F.array_distinct(F.concat(lines, _bound(words(F.col("__block")), _windows))), _holds)
    own = blocks.where(_bound(words(F.col("__block")), _holds))
    return own.select(*keys, F.posexplode(units).alias("__unit", "__own")).select(*keys, "__unit", F.array_join("__own", " ").alias("__text"))


def _features(df: DataFrame) -> DataFrame:
    own = df.withColumn("__words", words(F.col("__text"))).where(F.size("__words") > 0).withColumn("__grams", grams(F.col("__words")))
    return HashingTF(inputCol="__grams", outputCol="__features", numFeatures=FEATURES, binary=True).transform(own)


class Scanner:
    """The trained regression and its calibrated threshold."""

    def __init__(self, spark: SparkSession, rows: int = TRAIN_ROWS):
        known = _features(samples(spark, rows).withColumnRenamed("text", "__text")).withColumn("__held", F.pmod(F.xxhash64("__text"), 4) == 0)
        fit = LogisticRegression(featuresCol="__features", labelCol="label", family="multinomial", maxIter=30, regParam=0.0005, probabilityCol="__probability", rawPredictionCol="__raw", predictionCol="__predicted")
        self.model = fit.fit(known.where("not __held").coalesce(1))
        held = self.scored(known.where("__held"))
        self.accuracy = held.agg(F.avg((F.col("__family") == F.col("label")).cast("double"))).first()[0]
        false = held.where(F.col("label") == UNKNOWN).agg(F.percentile_approx("__score", 1 - FALSE_SHARE, 10_000)).first()[0]
        self.least = max(0.5, min(0.95, false or 0.0))

    def scored(self, features: DataFrame) -> DataFrame:
        """__family (the likeliest one other than unknown, unless unknown is likelier) and __score, that family's probability."""
        p = vector_to_array("__probability")
        out = self.model.transform(features).withColumn("__p", p)
        best = F.array_max(F.slice("__p", 1, UNKNOWN))
        return out.withColumn("__score", best).withColumn("__family", F.when(F.get("__p", F.lit(UNKNOWN)) >= best, F.lit(UNKNOWN)).otherwise(F.array_position("__p", best).cast("int") - 1))

    def found(self, paragraphs: DataFrame) -> DataFrame:
        """paragraphs (with their text in __text) with __licence: the confirmed family or null, and __score."""
        scored = self.scored(_features(paragraphs))
        covers = [F.greatest(F.lit(0.0), *(_cover(F.col("__words"), t) for t in ts if t in _DISTINCT), F.lit(0.0)) for ts in TEMPLATES.values()]
        cover = reduce(lambda c, k: c.when(F.col("__family") == k, covers[k]), range(1, UNKNOWN), F.when(F.col("__family") == 0, covers[0])).otherwise(0.0)
        sure = (F.col("__family") < UNKNOWN) & (F.col("__score") >= self.least)
        names = F.array(*map(F.lit, FAMILIES))
        return scored.withColumn("__licence", F.when(sure & (F.when(sure, cover).otherwise(0.0) >= COVER), F.element_at(names, F.col("__family") + 1)))


def scanned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_paragraphs, n_licence_paragraphs, families (in order, by comma; empty if none), best_score of every document."""
    blocks = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), BETWEEN), lambda b: F.regexp_like(b, F.lit(r"[\p{L}\p{N}]")))
    # equal rows have equal digests: each of their finds counts as often as its unit was found
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("__digest"), F.posexplode(blocks).alias("__at", "__block"))
    found = Scanner(docs.sparkSession).found(judged(rows)).where(F.col("__licence").isNotNull())
    found = found.groupBy("doc_id", "__digest", "__at", "__licence", "__unit").agg(F.count("*").alias("n"), F.max("__score").alias("__score"))
    found = found.groupBy("doc_id", "__digest", "__at", "__licence").agg(F.max("n").alias("n"), F.max("__score").alias("__score"))
    every = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.size(blocks).cast("long").alias("own"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("string").alias("__licence"), F.lit(None).cast("double").alias("__score"))
    return (
        every.unionByName(found.select("doc_id", F.lit(0).cast("long").alias("own"), "n", "__licence", "__score"))
        .groupBy("doc_id")
        .agg(F.sum("own").alias("n_paragraphs"), F.sum("n").alias("n_licence_paragraphs"), F.array_join(F.sort_array(F.collect_set("__licence")), ",").alias("families"), F.max("__score").alias("best_score"))
    )
