from __future__ import annotations

import random

import numpy as np
from graphloom.llm import compression as c
from pyspark.sql import functions as F


def corpus(n=500):
    rng = random.Random(6)
    good = [f"{a}{b}" for a in ("the", "and", "or", "in", "on") for b in ("re", "st", "ing", "ed", "ly", "")]
    rows = []
    for i in range(n):
        words = rng.choices(good, k=rng.randint(20, 200))
        bad = i % 3 == 0
        rows.append((i, " ".join(w.upper() + "!!" if bad and i % 2 else w + "###" if bad else w for w in words), int(not bad)))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 5) for i, t, _ in rows], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    model = c.train(docs, labels.where(~c.held_out("doc_id")))
    got = {r["id"]: r["score"] for r in c.score(docs, model).collect()}
    out = [(i, y) for i, _, y in rows if c.fold(i) == 2]
    assert len(got) == len(rows) and len(out) > 90
    assert np.mean([(got[i] >= c.THRESHOLD) == y for i, y in out]) > 0.97
    tools = c.compressors(model)
    x = np.array([c.features(rows[7][1].encode(), tools)])
    want = 1 / (1 + np.exp(-(c.expanded(x, model.mean, model.scale) @ model.weights)[0]))
    assert abs(got[7] - want) < 1e-9
    flipped = spark.createDataFrame([(i, 1 - y if c.fold(i) == 2 else y) for i, _, y in rows], "doc_id long, quality int")
    again = c.train(docs, flipped.where(~c.held_out("doc_id")))
    assert np.array_equal(again.weights, model.weights)


def test_nulls_repeats_and_no_labels(spark):
    docs = spark.createDataFrame([(1, None), (1, ""), (None, "a b"), (2, "x" * 200_000), (2, "x" * 200_000)], "doc_id long, text string")
    none = spark.createDataFrame([(1, None), (7, 3)], "doc_id long, quality int")
    assert [r["score"] for r in c.score(docs, c.train(docs, none)).collect()] == [0.5] * 5
    rows = corpus(200)
    many = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = c.train(many, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int"))
    got = c.score(docs, model).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    assert c.score(docs.where("doc_id = 9"), model).count() == 0


def test_fold_is_that_of_the_text_form(spark):
    got = spark.range(200).select("id", c.held_out("id").alias("h")).collect()
    assert all(r["h"] == (c.fold(r["id"]) == 2) for r in got)
    assert spark.range(1).select(F.crc32(F.lit("12").cast("string")).alias("x")).first()["x"] == __import__("zlib").crc32(b"12")


def test_scores_against_plain_zstandard(spark):
    """Every score from the dictionaries and weights alone: sizes by the library, the polynomial and the logistic written out."""
    import zstandard

    rows = corpus(260)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, ""), (901, None), (902, "z" * 9000)], "doc_id long, text string")
    model = c.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int"))
    got = {r["id"]: r["score"] for r in c.score(docs, model).collect()}

    def size(view, content):
        one = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        tool = zstandard.ZstdCompressor(level=3, dict_data=one, write_content_size=False, write_checksum=False, write_dict_id=False)
        return sum(len(tool.compress(view[i : i + 2048])) for i in range(0, max(1, len(view)), 2048))

    shape = lambda b: bytes(97 if x >= 128 or chr(x).islower() else 65 if chr(x).isupper() else 48 if chr(x).isdigit() else x for x in b)
    for i, text in [(i, t) for i, t, _ in rows[::20]] + [(900, ""), (901, ""), (902, "z" * 9000)]:
        data = text.encode()
        x = []
        for view, (bad, good) in zip((data, shape(data)), model.dictionaries, strict=True):
            a, b = size(view, bad), size(view, good)
            x += [(a - b) / (a + b), np.log((a + b) / 2 / max(1, len(data)))]
        x.append(np.log(max(1, len(data))))
        z = np.clip((np.array(x) - model.mean) / model.scale, -5, 5)
        terms = [1.0, *z, *(z[i] * z[j] for i in range(5) for j in range(i, 5))]
        assert abs(got[i] - 1 / (1 + np.exp(-np.dot(model.weights, terms)))) < 1e-9
