from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from graphloom.llm import pieces
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor

PATH = public_tokenizers.path("piece_bpe_32k.model")
SIGNS = ["the", "ing", " ", "  ", "\n", "é", "日本", "🙂", "▁", "aaaa", ".", "x", "qu", "\x00", "tion", "Ω", "     ", "\t", "1", "é"]


def library():
    return SentencePieceProcessor(model_file=PATH)


def by_scan(text, chunk):
    tool = pieces.codec(PATH)
    s = pieces.marked(text)
    cuts = [*range(0, len(s), chunk), len(s)]
    relations = [tool.transfer(s, a, b, b == len(s)) for a, b in zip(cuts, cuts[1:], strict=False)]
    at = pieces.states(relations)
    return [i for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) for i in tool.trace(s, a, b, at[k], at[k + 1])]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(SIGNS), min_size=1, max_size=60).map("".join), st.integers(17, 90))
def test_scan_and_units_against_the_library(text, chunk):
    want = library_once().encode(text)
    assert pieces.codec(PATH).encode(text).tolist() == want
    if want:
        assert by_scan(text, chunk) == want


def library_once(kept=[]):  # noqa: B006
    if not kept:
        kept.append(library())
    return kept[0]


def test_products_are_associative():
    tool = pieces.codec(PATH)
    s = pieces.marked("an unbelievable thing, isn't it? " * 6)
    cuts = [*range(0, len(s), 40), len(s)]
    a, b, c, *_ = (tool.transfer(s, x, y, y == len(s)) for x, y in zip(cuts, cuts[1:], strict=False))
    left, right = pieces.compose(pieces.compose(a, b), c), pieces.compose(a, pieces.compose(b, c))
    assert {k: set(v) for k, v in left.items()} == {k: set(v) for k, v in right.items()}


@pytest.mark.parametrize("finish", ["ids", "digest"])
def test_operator(spark, finish):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choices(SIGNS, k=rng.choice([0, 3, 50, 900])))) for i in range(40)] + [(50, None), (51, ""), (None, "a b"), (3, "same"), (60, "no blanks" * 400), (61, "z" * 3000)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, ids int").repartition(3)
    got = pieces.encode(docs, PATH, giant=500, chunk=128, finish=finish)
    want = [(str(i), library_once().encode(t or "")) for i, t in rows]
    if finish == "ids":
        assert sorted((str(r["id"]), r["ids"]) for r in got.collect()) == sorted(want)
        back = sorted((str(r["id"]), r["text"]) for r in pieces.decode(got, PATH).collect())
        assert back == sorted((str(i), (t or "").replace("▁", " ")) for i, t in rows)
    else:
        sums = [(i, len(x), zlib.crc32(np.array(x, dtype="<i4").tobytes()), True) for i, x in want]
        assert sorted((str(r["id"]), r["n_pieces"], r["ids_crc32"], r["round_trip"]) for r in got.collect()) == sorted(sums)


def test_empty(spark):
    assert pieces.encode(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_levels_of_products(spark):
    """More chunks than a task combines: three levels, texts of any number of chunks."""
    rng = random.Random(5)
    rows = [(i, "".join(rng.choices(SIGNS, k=n))) for i, n in enumerate([30, 700, 2500, 90])] + [(9, "z" * 900), (10, " ".join("abcdefg" for _ in range(300)))]
    frame = spark.createDataFrame(rows, "uid long, text string")
    got = {r["uid"]: r["ids"] for r in pieces.giants(frame, PATH, chunk=40, fan=3).collect()}
    assert got == {i: library_once().encode(t) for i, t in rows}


def test_tree_of_products():
    tool = pieces.codec(PATH)
    s = pieces.marked("some 日本 text with  blanks, and unbelievable things " * 5)
    cuts = [*range(0, len(s), 30), len(s)]
    parts = [tool.transfer(s, x, y, y == len(s)) for x, y in zip(cuts, cuts[1:], strict=False)]
    whole = parts[0]
    for part in parts[1:]:
        whole = pieces.compose(whole, part)
    assert {k: set(v) for k, v in pieces.product(parts).items()} == {k: set(v) for k, v in whole.items()}
    inner = pieces.states(parts)
    assert pieces.states(parts[2:6], inner[2], inner[6]) == inner[2:7]
