import re

import pytest

from seqloom.llm.license_scan import CONFIRM, FAMILIES, STEP, TEMPLATES, WIDTH, Classifier, _with_terms, free_share, plain_words, scan

SF = "/root/testdata/sf0.01"
LINES = {"Licensed under the Apache License, Version 2.0.": "apache-2.0", "Released under the MIT License.": "mit", "This work is licensed under the GNU General Public License, version 3.": "gpl", "Licensed under CC BY-NC 4.0.": "cc-by-nc"}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_documents_by_brute_force(spark, docs):
    got = {r.doc_id: r for r in scan(docs).collect()}
    want = {r.doc_id: sorted({f for line, f in LINES.items() if line in (r.text or "")}) for r in docs.collect()}
    assert sum(map(bool, want.values())) > 10
    assert {i: r.licences for i, r in got.items()} == want
    blocks = lambda t: sum(any(ch.isalnum() for ch in b) for b in re.split(r"\n(?:[^\w\n]*\n)+", t or ""))
    assert all(got[r.doc_id].n_paragraphs == blocks(r.text) for r in docs.collect())


def test_families_and_unknown(spark, docs):
    model = Classifier(docs.selectExpr("doc_id as id", "text"))
    rows = [(f, t) for f, texts in TEMPLATES.items() for t in texts] + [("unknown", "She lost her license near the public library in version two of the story."), ("unknown", "The cat sat on the mat."), ("unknown", "")]
    got = model.apply(_with_terms(spark.createDataFrame(rows, "want string, text string"))).collect()
    right = [(FAMILIES[r.family] if r.probability >= 0.5 else "unknown") == r.want for r in got]
    assert sum(right) >= len(right) - 1


NOTICES = {
    "gpl": """
/*
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 */""",
    "bsd": """
# Redistribution and use in source and binary forms, with or without
# modification, are permitted provided that the following conditions
# are met:""",
    "mit": """
// Permission is hereby granted, free of charge, to any person
// obtaining a copy of this software and associated documentation
// files (the "Software"), to deal in the Software without restriction,
// including without limitation the rights to use it""",
    "isc": """
dnl Permission to use, copy, modify, and/or distribute this software for
dnl any purpose with or without fee is hereby granted, provided that the
dnl above copyright notice and this permission notice appear in all
dnl copies.""",
    "lgpl": """
 * This library is free software; you can redistribute it and/or
 * modify it under the terms of the GNU Lesser General Public
 * License as published by the Free Software Foundation.""",
    "mpl-2.0": """
This Source Code Form is subject to the terms of the
Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one elsewhere.""",
    "apache-2.0": """
   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at""",
}


def test_wrapped_notices(spark, docs):
    """Hard-wrapped notices in comments are found, whatever stands around them, and however the rows are dealt."""
    prose = [r.text.replace("\n", " ")[:600] for r in docs.filter("length(text) > 700").orderBy("doc_id").limit(len(NOTICES)).collect()]
    rows = [(f"{k} {name}", text) for (name, notice), p in zip(NOTICES.items(), prose, strict=True) for k, text in enumerate((notice, f"{p}\n\n{notice}\n\n{p}", f"{p}{notice}\n{p}"))]
    extra = spark.createDataFrame(rows, "doc_id string, text string")
    every = extra.unionByName(docs.selectExpr("cast(doc_id as string) as doc_id", "text"))
    got = {r.doc_id: r.licences for r in scan(every).collect()}
    assert {i: got[i] for i, _ in rows} == {i: [i.split()[1]] for i, _ in rows}
    again = {r.doc_id: r.licences for r in scan(every.repartition(11)).collect()}
    assert again == got


def test_anchors_lose_nothing():
    assert all(free_share(t) < CONFIRM for texts in TEMPLATES.values() for t in texts)
    assert max(len(plain_words(t)) for texts in TEMPLATES.values() for t in texts) <= WIDTH - STEP


def test_edges(spark, docs):
    extra = spark.createDataFrame([(-1, None, "x"), (-2, "", "x"), (-3, "Released under the MIT License.\n" * 3, "x"), (-3, "Licensed under CC BY-NC 4.0.", "x"), (-4, "Released under the MIT License.\n\n#\n" * 3 + "the end", "x"), (None, "word " * 100_000, "x")], "doc_id long, text string, family string")
    got = {r.doc_id: r for r in scan(docs.unionByName(extra, allowMissingColumns=True)).filter("doc_id < 0 or doc_id is null").collect()}
    assert got[-1].licences == got[-2].licences == [] and got[-1].n_paragraphs == 0
    assert got[-3].licences == ["cc-by-nc", "mit"] and got[None].licences == []
    assert got[-3].n_paragraphs == got[-3].n_licence_paragraphs == 2
    assert got[-4].n_paragraphs == 4 and got[-4].n_licence_paragraphs == 3
    assert scan(extra.filter("doc_id > 0")).count() == 0


def test_the_model_is_small(spark):
    """Each pass of the fit sends its weights, and every task a gradient of that size, through the driver."""
    from seqloom.llm import license_scan as L

    docs = spark.createDataFrame([(f"some plain words of text {i}",) for i in range(60)], "text string").repartition(40)
    model = L.Classifier(docs).model
    assert model.numFeatures == len(L._known_terms()) < 2000
