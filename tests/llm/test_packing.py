from __future__ import annotations

import random
import subprocess
import sys
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from graphloom.llm import packing
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, got, window):
    plain = Tokenizer.from_file(PATH)
    want = [np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4") for _, t in rows]
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    for (name, _), ids in zip(rows, want, strict=True):
        at = 0
        for r in sorted(by[name], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            if "ids" in r:
                assert r["ids"] == ids[at : at + r["length"]].tolist()
            at += r["length"]
        assert at == len(ids)
    rows = defaultdict(list)
    for r in got:
        rows[r["sequence_id"]].append((r["offset"], r["length"]))
    pad = 0
    for pieces in rows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= window
        pad += 0 if at & at - 1 == 0 else window - at
    return pad


def test_pieces_cover_every_id_once(spark):
    rng = random.Random(5)
    words = ["Alpha", "beta.", "it's", "don't!", "ÉÉ", "x1y2", "日本語", "<|endoftext|>", "***", "ẃ", "a\x1cb", "ﬁ?", "Ω" * 70]
    rows = [(i, " \n\t"[i % 3].join(rng.choices(words, k=rng.choice([0, 1, 5, 40, 300])))) for i in range(300)]
    rows += [(900, None), (901, ""), (902, "long. " * 9000), (903, "z" * 9000), (904, " \x1d 　\u0085")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, start int").repartition(3)
    got = [r.asDict() for r in packing.pack(docs, PATH, with_ids=True).collect()]
    total = sum(r["length"] for r in got)
    assert check(rows, got, 2048) < 0.01 * total


def test_least_cost_against_every_choice():
    rng = random.Random(1)
    for _ in range(200):
        at = np.array(sorted(rng.sample(range(1, 40), rng.randint(1, 9))))
        at = np.concatenate([[0], at])
        cost = np.array([0.0] + [float(rng.randint(0, 6)) for _ in at[1:]])
        window = max(int(np.diff(at).max()), rng.randint(4, 16))
        best = [0.0]
        for i in range(1, len(at)):
            best.append(min(best[j] + window - (at[i] - at[j]) for j in range(i) if at[i] - at[j] <= window) + cost[i])
        assert packing.best_cuts(at, cost, window)[0].tolist() == best


def test_small_blocks_keep_order():
    rng = random.Random(2)
    docs = [(i, np.arange(n, dtype="<u4"), np.array(sorted(rng.sample(range(n), n // 9)), dtype=np.int64)) for i, n in enumerate(rng.choices(range(1, 90), k=500))]
    got = list(packing.packed(iter(docs), 64, 0, block=400))
    assert [x[0] for x in got] == sorted(x[0] for x in got)
    for name, ids, _ in docs:
        assert np.concatenate([x[1] for x in got if x[0] == name]).tolist() == ids.tolist()
    assert [x[4] for x in got] == sorted(x[4] for x in got)


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_words_against_the_library(monkeypatch):
    """Every kind of word, each text by itself and all together, with a cache that is emptied now and then."""
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" * 3 + "àéîõüßñçÀÉÎÕÜÑÇÿœŒšİıſÅµªº"
    made = ["".join(rng.choices(letters, k=rng.randint(1, 14))) + rng.choice(["", "", ".", ",", "!?", "'s", "'ll", "-x", "7", "e\u0301", "%&|", "\u00b2"]) for _ in range(4000)]
    made += ["aaaaaaaaaaaaaaaaaaaaaa", "lalalalalala", "...", "''", "'S", "don'T.", "ß.", "ẞ", "Ǆ", "a" * 300, "<|startoftext|>.", "日本語。", "٣٤", "x\u00ady", "😀😀"]
    texts = [rng.choice([" ", "\n", "\u00a0", "\u3000 "]).join(rng.choices(made, k=rng.randint(0, 60))) for _ in range(400)] + [None, "", " ", "a\x1cb \x1f c"]
    plain = Tokenizer.from_file(PATH)
    want = [[*plain.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
    monkeypatch.setattr(packing, "CACHE", 2000)
    for step in (7, 404):
        got = [ids.tolist() for i in range(0, len(texts), step) for ids, _ in packing.encoded_all(pa.array(texts[i : i + step], pa.string()), PATH)]
        assert got == want


@pytest.mark.parametrize("kind", ["smallint", "int", "long", "decimal(20,0)", "string", "binary", "date"])
def test_ids_of_any_type(spark, kind):
    docs = spark.createDataFrame([(i % 7 if i else None, f"text number {i} . " * (i + 1)) for i in range(20)], "doc_id int, text string")
    docs = docs.selectExpr("date_add(date'2020-01-01', doc_id) AS doc_id" if kind == "date" else f"CAST(CAST(doc_id AS STRING) AS {kind}) AS doc_id", "text").repartition(2)
    out = packing.pack(docs, PATH)
    assert out.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    got, want = {}, {}
    for r in out.collect():
        got[str(r["doc_id"])] = got.get(str(r["doc_id"]), 0) + r["length"]
    for r in docs.collect():
        want[str(r["doc_id"])] = want.get(str(r["doc_id"]), 0) + len(packing.encoded(r["text"], PATH)[0])
    assert got == want and "None" in got


MEMORY = """
import random, re, sys
import pyarrow as pa
from graphloom.llm import packing

path, rng = sys.argv[1], random.Random(3)
texts = [" ".join("".join(rng.choices("abcdefghijklmnop", k=6)) + "." for _ in range(3500)) for _ in range(600)]
batches = [pa.RecordBatch.from_arrays([pa.array(range(i, i + 100)), pa.array(texts[i : i + 100])], ["id", "text"]) for i in range(0, 600, 100)]
del texts
now = lambda: sum(map(int, re.findall("Pss_(?:Anon|Shmem): +([0-9]+)", open("/proc/self/smaps_rollup").read()))) >> 10
list(packing.encoded_all(pa.array(["a text"]), path))
begin = now()
docs = sum(x[2] == 0 for x in packing.packed(packing.streamed(iter(batches), path, 1), 2048, 0))
print(docs, now() - begin)
"""


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="memory is read from /proc")
def test_memory_of_a_worker():
    """Over 14 MB of text with two million words that are nearly all different: neither the words nor what is freed stays with the worker."""
    run = subprocess.run([sys.executable, "-c", MEMORY, PATH], cwd=Path(__file__).parents[2], capture_output=True, text=True, check=True, timeout=300)
    docs, kept = map(int, run.stdout.split())
    assert docs == 600 and kept < 50, run.stdout


def test_tasks_leave_no_words(spark):
    """Workers are used again by other tasks, which would hold the words of this one beside their own."""
    docs = spark.createDataFrame([(i, f"word{i} and word{i * 7}. " * 9) for i in range(300)], "doc_id long, text string").coalesce(2)
    assert packing.pack(docs, PATH).agg({"doc_tokens": "count"}).first()[0] >= 300

    def probe(batches):
        for _ in batches:
            held = len(packing.words(PATH).names) if packing.words.cache_info().currsize else 0
            yield pa.RecordBatch.from_arrays([pa.array([held])], ["held"])

    assert spark.range(0, 64, 1, 64).mapInArrow(probe, "held long").agg({"held": "max"}).first()[0] == 0
