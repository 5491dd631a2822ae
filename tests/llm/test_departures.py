"""Repeated rows in the mix, a bounded sample for the classifier, and standard licence headers."""

import pytest
from pyspark.sql import functions as F

from quillmesh.llm import licenses, mixing, quality

BSD_1 = "Copyright (c) 2024, A. All rights reserved.\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution.\n"
BSD_2 = "\n3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.\n"


@pytest.mark.parametrize("n, words, other", [(100, 1_000, 20_000), (7, 3, 1_000), (1, 50, 60), (64, 1, 10_000)])
def test_repeated_rows_come_near_their_target(spark, n, words, other):
    """Weights 1, 2, 3 over three sources, the first of which is one row many times."""
    rows = [(5, "w " * words, "a")] * n + [(k, "x " * (k % 9 + 1), "b") for k in range(other // 5)] + [(k, "y " * 4, "c") for k in range(other // 8)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(5)).withColumn("taken", F.col("size") * F.col("copies"))
    for r in got.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("most"), F.max("copies").alias("copies")).collect():
        assert abs(r["taken"] - r["target"]) <= r["most"] / 2 + 1e-6, r
        assert r["copies"] <= 3
    assert got.count() == len(rows) and mixing.sample(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).count() == got.agg(F.sum("copies")).first()[0]


def test_null_ids_in_several_sources_are_split(spark):
    rows = [(None, "one two three", s) for s in ("a", "b", None) for _ in range(50)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(6))
    for r in got.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r["taken"] - r["target"]) <= 1.5


def test_classifier_sample_is_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "fit", lambda x, y: seen.append(len(y)) or quality.Model(0.0))
    docs = spark.createDataFrame([(k % 20, f"text {k} of words. " * (k % 7 + 1)) for k in range(3_000)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)] * 3, "doc_id bigint, quality int")
    quality.train(docs, labels, max_rows=10)
    quality.train(docs, labels)
    assert seen[0] <= 10 and seen[1] <= 20


def test_standard_headers(spark):
    apache = 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software is distributed as is'
    texts = {
        "BSD-3-Clause": BSD_1 + BSD_2,
        "BSD-2-Clause": BSD_1 + "\nTHIS SOFTWARE IS PROVIDED AS IS",
        "MIT": "// SPDX-License-Identifier: MIT\nint main;",
        "EPL-2.0": " * This program and the accompanying materials are made\n * available under the terms of the Eclipse Public License 2.0\n * which is available at https://www.eclipse.org/legal/epl-2.0/\n *\n * SPDX-License-Identifier: EPL-2.0".replace(" * ", ""),
        "Apache-2.0": apache,
        "Proprietary": "Copyright 2024 A.\nAll rights reserved.",
        "": "No licence here.",
    }
    df = spark.createDataFrame(list(texts.items()), "name string, text string")
    got = {r["name"]: r for r in licenses.scan_licenses(df).collect()}
    assert {k: ",".join(r["licenses"]) for k, r in got.items()} == {k: k for k in texts}
    assert "apache-copy" in [s["id"] for s in got["Apache-2.0"]["license_sentences"]]
