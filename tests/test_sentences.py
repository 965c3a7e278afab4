"""Sentences by learnt abbreviations."""

from __future__ import annotations

from pyspark.sql import functions as F

from issuelens.operators import sentences

TEXT = ("See Fig. 3 for the plan. We use tools, e.g. hammers. It needs v. 1.2 of the library!\nThe plan of the tools is old. "
        "An old hammers box of plan size? Yes.")


def test_abbreviations_do_not_split(spark):
    rows = [(i, TEXT) for i in range(40)] + [(100, None), (101, ""), (102, "no end"), (103, "Fig. 4"), (104, "\x01 One. \n Two... three")]
    df = spark.createDataFrame(rows, "id LONG, body STRING")
    found = sentences.abbreviations(df, F.col("body"))
    words = {r["word"] for r in found.collect()}
    assert {"fig", "e.g", "v"} <= words and not words & {"plan", "old", "hammers", "library"}
    got = {r["id"]: r["sentences"] for r in sentences.sentences(df, F.col("body"), found).collect()}
    assert got[0] == ["See Fig. 3 for the plan.", "We use tools, e.g. hammers.", "It needs v. 1.2 of the library!",
                      "The plan of the tools is old.", "An old hammers box of plan size?", "Yes."]
    assert got[100] == [] and got[101] == [] and got[102] == ["no end"] and got[103] == ["Fig. 4"]
    assert got[104] == ["One.", "Two...", "three"]


def test_no_texts(spark):
    df = spark.createDataFrame([], "id LONG, body STRING")
    found = sentences.abbreviations(df, F.col("body"))
    assert found.count() == 0 and sentences.sentences(df, F.col("body"), found).count() == 0
