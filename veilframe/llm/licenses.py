"""Licence families of paragraphs: a trained classifier, confirmed by comparison with templates.

A text is cut into paragraphs (lines), long ones into windows of ``WINDOW`` words that overlap, and every window is classified by
multinomial logistic regression over hashed words and word pairs. The training rows are made from ``TEMPLATES`` - words
dropped, years changed, prose around them up to a whole window - and from about ``UNKNOWN`` windows of the corpus, drawn by hash, that share no
template's wording; these and ``OTHER`` (licence words in plain prose) are the class 'unknown'. A third of the rows is kept out of
training to calibrate: every family is weighed against 'unknown' alone, so that two in a window do not hide each other, and the least
probability it needs is set so that at most one in a thousand unknown windows reaches it. Every family that the classifier names is reported
if at least ``SHARED`` of a template's word triples, or of the window's, are common to both, and not all of these belong to a family that fits better.

Everything runs in built-in functions and Spark's own learners; scoring is one pass without a shuffle of texts, and the only
grouping is by document over findings. The training rows are bounded by parameters; nothing else is sampled.

Defined cases: null and empty texts have no paragraph and no licence; texts without words neither; repeated rows are judged one by one;
no documents give no rows (the classifier then learns from the templates and ``OTHER`` alone); extra columns are ignored. Rows are told
apart by their place in the input, so ``docs`` must be a table scan (or another frame that yields the same partitions).
"""

from __future__ import annotations

from collections import Counter

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm.text import hash_draw, let, words
from veilframe.storage import materialize

WINDOW, STEP, TERMS, VARIANTS, UNKNOWN, SHARED = 60, 40, 1 << 13, 120, 3000, 0.6

# Wordings of public licences, by family.
TEMPLATES = [
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd", "Licensed under the BSD 3-Clause License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("cc0", "Released under CC0 1.0 Universal Public Domain Dedication"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "You should have received a copy of the GNU General Public License along with this program"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "Licensed under the GNU Lesser General Public License, version 3"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("mpl", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"),
    ("reserved", "All rights reserved"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]

# Prose with words of licences that grants nothing.
OTHER = [
    "The driver showed a valid license and the registration of the car",
    "She asked for permission to copy the recipe from the old book",
    "The software was released last year and distributed to all schools",
    "Version 2.0 of the program runs faster than version 1.0",
    "The public library opened under new terms this general assembly",
    "He reserved all seats and the rights of way were blocked",
    "A fishing license costs ten euros and is valid for any person under eighteen",
    "The terms of the agreement were published by the free press foundation",
    "Students work under the guidance of the general council",
    "All rights and duties of citizens follow from the law",
]
UNKNOWN_LABEL = "unknown"


def windows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(u, id, nr, w): the word windows of every paragraph; ``nr`` is the paragraph's line from 0."""
    lines = docs.select(F.monotonically_increasing_id().alias("u"), F.col(key).alias("id"), F.split(F.coalesce(F.col(text), F.lit("")), "\n").alias("lines"))
    each = lines.select("u", "id", F.posexplode("lines").alias("nr", "line")).select("u", "id", "nr", words(F.col("line")).alias("all"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - (WINDOW - STEP), F.lit(1)), F.lit(STEP))
    return each.where(F.size("all") > 0).select("u", "id", "nr", F.explode(F.transform(starts, lambda s: F.slice("all", s, WINDOW))).alias("w"))


def _terms(w: Column) -> Column:
    pairs = F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat(F.get(w, i - 1), F.lit(" "), F.get(w, i)))
    return F.when(F.size(w) > 1, F.concat(w, pairs)).otherwise(w)


def _triples(w: Column) -> Column:
    return F.when(F.size(w) > 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.concat_ws(" ", F.slice(w, i, 3))))).otherwise(F.array(F.concat_ws(" ", w)))


def templates(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([(i, f, t) for i, (f, t) in enumerate(TEMPLATES)], "template int, family string, text string")
    return rows.select("template", "family", words(F.col("text")).alias("tw")).select("*", _triples(F.col("tw")).alias("tt"))


def _vectors(rows: DataFrame) -> DataFrame:
    return HashingTF(numFeatures=TERMS, binary=True, inputCol="terms", outputCol="features").transform(rows.withColumn("terms", _terms(F.col("w"))))


def _similarity(tt: Column, own: Column) -> Column:
    """Share of the shorter one's triples that both have."""
    return F.size(F.array_intersect(tt, own)) / F.least(F.size(tt), F.size(own))


def training_rows(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", unknown: int = UNKNOWN) -> DataFrame:
    """(family, w, kept_out): variants of the templates, and windows of the corpus that share no template's wording."""
    every = windows(docs, key, text)
    chance = min(1.0, unknown / max(1, docs.count()))  # one window of each drawn document
    drawn = every.where(hash_draw(chance, "u")).groupBy("u").agg(F.min_by("w", F.xxhash64("nr", "w")).alias("w"))
    known = F.broadcast(templates(spark).select(F.explode("tt").alias("t")).distinct())
    seen = drawn.select("u", F.explode(_triples(F.col("w"))).alias("t")).join(known, "t").select("u").distinct()
    own = spark.createDataFrame([(-i - 1, t) for i, t in enumerate(OTHER)], "u long, t string").select("u", words(F.col("t")).alias("w"))
    plain = materialize(drawn.join(seen, "u", "left_anti").unionByName(own).withColumn("nr", F.row_number().over(_by_u()) - 1), "unknown")
    n = plain.count()
    draw = lambda salt: F.xxhash64("template", "variant", F.lit(salt))
    size = Counter(f for f, _ in TEMPLATES)  # every family has as many variants, however few its templates
    number = F.get(F.array(*[F.lit(VARIANTS // size[f]) for f, _ in TEMPLATES]), F.col("template"))
    variants = templates(spark).select("template", "family", "tw", F.explode(F.sequence(F.lit(1), number)).alias("variant"))
    less = F.filter("tw", lambda w, i: (F.col("variant") <= 2) | (F.pmod(F.xxhash64(w, i, "variant"), F.lit(12)) > 0))
    dated = F.transform(less, lambda w: F.when(w.rlike("^(19|20)[0-9]{2}$"), (F.pmod(draw("y"), F.lit(40)) + 1985).cast("string")).otherwise(w))
    around = variants.withColumns({"nr": F.pmod(draw("n"), F.lit(n)).cast("int"), "left": F.pmod(draw("l"), F.lit(20)), "right": F.pmod(draw("r"), F.lit(20))}).join(plain.withColumnRenamed("w", "prose"), "nr")
    # a third alone, a third among up to 19 words on either side, a third inside a whole window
    room = F.greatest(F.lit(WINDOW) - F.size(dated), F.lit(0))
    left = F.when(F.col("variant") % 3 == 1, F.col("left")).otherwise(F.pmod(draw("f"), room + 1)).cast("int")
    right = F.when(F.col("variant") % 3 == 1, F.col("right")).otherwise(room - left).cast("int")
    alone = F.col("variant") % 3 == 0
    side = lambda of, size: F.when(alone, F.array().cast("array<string>")).otherwise(F.slice("prose", of, size))
    made = around.select("family", F.concat(side(F.lit(1), left), dated, side(left + 1, right)).alias("w"), F.pmod(draw("k"), F.lit(3)).alias("part"))
    rest = plain.select(F.lit(UNKNOWN_LABEL).alias("family"), "w", F.pmod(F.xxhash64("u", F.lit(3)), F.lit(3)).alias("part"))
    rows = made.unionByName(rest).where(F.size("w") > 0)
    return materialize(rows.select("family", "w", (F.col("part") == 0).alias("kept_out")), "training")


def _by_u():
    from pyspark.sql import Window

    return Window.orderBy("u")  # the drawn sample only


class Classifier:
    """The fitted model, its families in order of class number (unknown last), and the least probability each needs."""

    def __init__(self, model: LogisticRegressionModel, families: list[str], least: list[float]):
        self.model, self.families, self.least = model, families, least

    def probabilities(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with ``w``) plus ``p``: the probability of every family where the choice is between it and unknown."""
        margins = self.model.transform(_vectors(rows)).withColumn("z", F.array(vector_to_array("rawPrediction")))
        scored = margins.select(*rows.columns, F.explode("z").alias("z"))  # a generator: no filter or lambda gets a copy of the scoring
        last = F.lit(len(self.families) - 1)
        against = F.transform(F.slice("z", F.lit(1), last), lambda z: 1 / (1 + F.exp(F.get("z", last) - z)))
        return scored.select(*rows.columns, against.alias("p"))

    def named(self, rows: DataFrame) -> DataFrame:
        """``rows`` plus ``named``, (family, probability) of every family that reaches its limit; rows without any go."""
        names, limits = F.array(*[F.lit(f) for f in self.families]), F.array(*[F.lit(x) for x in self.least])
        every = F.transform("p", lambda p, i: F.when(p >= F.get(limits, i), F.struct(F.get(names, i).alias("family"), p.alias("probability"))))
        found = self.probabilities(rows).select(*rows.columns, F.filter(every, lambda x: x.isNotNull()).alias("named"))
        return found.where(F.size("named") > 0)


def train(rows: DataFrame) -> Classifier:
    families = sorted({f for f, _ in TEMPLATES}) + [UNKNOWN_LABEL]
    number = F.array_position(F.array(*[F.lit(f) for f in families]), F.col("family")).cast("double") - 1
    labelled = materialize(rows.withColumn("label", number).coalesce(4), "labelled")
    learner = LogisticRegression(family="multinomial", regParam=1e-3, maxIter=40, standardization=False, aggregationDepth=2)
    model = learner.fit(_vectors(labelled.where("not kept_out")).select("features", "label"))
    first = Classifier(model, families, [])
    held = first.probabilities(labelled.where(F.col("kept_out") & (F.col("family") == UNKNOWN_LABEL)).select("w"))
    wrong = [r.p for r in held.select("p").collect()]  # of the kept-out sample
    n = len(wrong)
    for f in range(len(families) - 1):
        reached = sorted((p[f] for p in wrong), reverse=True)
        first.least.append(max(0.3, reached[n // 1000] + 1e-9) if n else 0.3)
    return first


def _template_map(spark: SparkSession) -> Column:
    """Family -> the triples of its templates, as a literal."""
    held: dict[str, list] = {}
    for r in templates(spark).select("family", "tt").collect():  # the fixed templates
        held.setdefault(r.family, []).append(F.array(*[F.lit(t) for t in r.tt]))
    return F.create_map(*[x for family, texts in held.items() for x in (F.lit(family), F.array(*texts))])


def _fits(groups: Column, named: Column, own: Column) -> Column:
    """(family, probability, similarity, hits) of every named family; ``hits``: the triples shared with templates that fit."""

    def fit(x: Column) -> Column:
        texts = F.element_at(groups, x["family"])
        similarity = F.array_max(F.transform(texts, lambda tt: _similarity(tt, own)))
        hits = F.flatten(F.transform(F.filter(texts, lambda tt: _similarity(tt, own) >= SHARED), lambda tt: F.array_intersect(tt, own)))
        return F.struct(x["family"].alias("family"), x["probability"].alias("probability"), similarity.alias("similarity"), F.array_distinct(hits).alias("hits"))

    return F.transform(named, fit)


def _confirmed(x: Column, fits: Column) -> Column:
    """Whether ``x`` fits and has a hit that no better fitting family has; other wordings of a family of licences share most."""
    rank = lambda y: F.struct(y["similarity"], F.size(y["hits"]), y["family"])
    better = F.flatten(F.transform(F.filter(fits, lambda y: rank(y) > rank(x)), lambda y: y["hits"]))
    return F.size(F.array_except(x["hits"], better)) > 0


def find(docs: DataFrame, classifier: Classifier, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(u, doc_id, nr, family, probability, similarity, confirmed) per window and family that the classifier names."""
    named = classifier.named(windows(docs, key, text))
    groups = _template_map(docs.sparkSession)
    fits = let(_triples(F.col("w")), lambda own: _fits(groups, F.col("named"), own))
    judged = let(fits, lambda all_: F.transform(all_, lambda x: F.struct(x["family"].alias("family"), x["probability"].alias("probability"), x["similarity"].alias("similarity"), _confirmed(x, all_).alias("confirmed"))))
    found = named.select("u", F.col("id").alias("doc_id"), "nr", F.explode(judged).alias("x"))
    return found.select("u", "doc_id", "nr", "x.*")


def scan(docs: DataFrame, classifier: Classifier, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, families (confirmed ones, sorted), n_notices (paragraphs that hold one)."""
    found = find(docs, classifier, key, text).where("confirmed")
    per = found.groupBy("u").agg(F.array_sort(F.collect_set("family")).alias("families"), F.countDistinct("nr").alias("n_notices"))
    rows = docs.select(F.monotonically_increasing_id().alias("u"), F.col(key).alias("doc_id"))
    empty = F.array().cast("array<string>")
    return rows.join(per, "u", "left").select("doc_id", F.coalesce("families", empty).alias("families"), F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"))
