import re

import pytest
from pyspark.sql import functions as F

from veilframe.llm import licenses as lc

SF = "/root/testdata/sf0.01"
#: The notices that the table's texts hold, by family.
NOTICES = {"gpl": "GNU General Public License, version 3.", "cc-by-nc": "Licensed under CC BY-NC 4.0.", "mit": "Released under the MIT License.", "apache": "Licensed under the Apache License, Version 2.0.", "reserved": "All rights reserved."}


@pytest.fixture(scope="module")
def classifier(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return lc.train(lc.training_rows(spark, docs))


def test_every_notice_of_the_table_is_found_and_nothing_else(spark, classifier):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r.doc_id: sorted(f for f, t in NOTICES.items() if re.search(re.escape(t[:-1]), r.text, re.I)) for r in docs.collect()}
    got = {r.doc_id: r.families for r in lc.scan(docs, classifier).collect()}
    assert sum(map(bool, want.values())) > 20 and got == want


def test_reworded_and_embedded_notices_and_plain_prose(spark, classifier):
    prose = "then the rest of them went over to the other side of the river and stayed there for a while "
    rows = [
        (1, "Copyright (c) 2019 Some One. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation"),
        (2, prose * 5 + "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published. " + prose * 4),
        (3, "He lost his driving license under the bridge.\nThe version of the story released was long."),
        (4, prose * 3),
        (5, "x\n\nlicensed under the apache license version 2.0\nReleased under the MIT license!"),
    ]
    got = {r.doc_id: r.families for r in lc.scan(spark.createDataFrame(rows, "doc_id long, text string"), classifier).collect()}
    assert got == {1: ["mit"], 2: ["gpl"], 3: [], 4: [], 5: ["apache", "mit"]}


def test_odd_rows(spark, classifier, odd_documents):
    docs = odd_documents.withColumns({c: F.lit(1) for c in ("w", "family", "nr", "terms", "features", "probability")})
    rows = lc.scan(docs, classifier).collect()
    assert len(rows) == docs.count() and not any(r.families for r in rows)
    assert lc.scan(docs.limit(0), classifier).count() == 0
    plan = lc.scan(docs, classifier)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "NestedLoop" not in plan
    once = classifier.probabilities(lc.windows(docs, "doc_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert 0 < plan.count("UDF(") <= once.count("UDF(")


def test_learns_without_documents(spark, odd_documents):
    alone = lc.train(lc.training_rows(spark, odd_documents.limit(0)))
    docs = spark.createDataFrame([(1, "Released under the MIT License.")], "doc_id long, text string")
    assert lc.scan(docs, alone).first().families == ["mit"]


def test_two_licences_in_a_line_and_short_notices_inside_long_lines(spark, classifier):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("text IS NOT NULL AND lang = 'en'").orderBy("doc_id").limit(40).collect()
    plain = [" ".join(w for w in re.findall(r"[a-z]+", r.text.lower()) if w not in ("license", "licensed", "rights"))[:2000].split() for r in docs]
    plain = [w for w in plain if len(w) >= 100][:12]
    assert len(plain) >= 5
    mit, apache, gpl = NOTICES["mit"][:-1], NOTICES["apache"][:-1], NOTICES["gpl"][:-1]
    nc = "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"
    rows, want = [(0, f"{mit} or licensed under the Apache License, Version 2.0."), (1, f"{apache}, or under the {gpl}"), (2, nc)], {0: ["apache", "mit"], 1: ["apache", "gpl"], 2: ["cc-by-nc"]}
    for i, w in enumerate(plain):
        for j, (family, notice) in enumerate([("mit", mit), ("apache", apache), ("cc-by-nc", "Licensed under CC BY-NC 4.0"), ("reserved", "All rights reserved")]):
            rows.append((100 + 10 * i + j, " ".join(w[:25]) + f" {notice} " + " ".join(w[25:95])))
            want[100 + 10 * i + j] = [family]
    got = {r.doc_id: r.families for r in lc.scan(spark.createDataFrame(rows, "doc_id long, text string"), classifier).collect()}
    assert got == want
