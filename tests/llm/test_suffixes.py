from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from graphloom.llm import common, lcpsort, suffixes


def brute(texts, span):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + span] for d in data for i in range(len(d) - span + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, dtype=bool)
        for i in range(len(d) - span + 1):
            if seen[d[i : i + span]] > 1:
                gone[i : i + span] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone[:-1], [False]]).astype(int)) == 1)
        left = bytes(b for b, g in zip(d, gone, strict=False) if not g)
        out.append((len(d), int(gone.sum()), len(edges), hashlib.sha256(left).hexdigest()))
    return out


def made(rng, letters, n):
    return "".join(rng.choices(letters, k=n))


def corpus(seed, span):
    rng = random.Random(seed)
    passages = [made(rng, "abcdé ", rng.randint(span // 2, 3 * span)) for _ in range(6)]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 5)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 2)
            parts.append(rng.choice([p, p[a:], p[: len(p) - a], made(rng, "abcdefgh ", rng.randint(1, 2 * span))]))
        texts.append("".join(parts))
    for t in texts[:12]:
        at = rng.randint(0, len(t))
        texts.append(t[:at] + rng.choice(["", "X", "é"]) + t[at + 1 :])
    return texts + texts[:3] + ["", None, "a" * (span - 1), "a" * span, "b" * (span + 1), "ab" * span, "q" * (4 * span), "x" * 10]


@pytest.mark.parametrize(("seed", "span"), [(1, 400), (2, 100), (3, 40)])
def test_against_brute_force(spark, seed, span):
    texts = corpus(seed, span)
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, runs string").repartition(3)
    got = {r["id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.dedup(docs, span=span).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, span)


def test_long_text_in_parts(spark, monkeypatch):
    rng = random.Random(8)
    monkeypatch.setattr(suffixes, "CHUNK_BYTES", 3000)
    a = made(rng, "abc", 9000)
    texts = [a, made(rng, "abc", 500) + a[2000:7000] + made(rng, "abc", 50), "z" + a[100:501]]
    found = [[(i, s + b, n) for r, t, b in buffers_of(x) for i, s, n, *_ in suffixes.contexts(t)] for x in texts]
    assert [sum(n for *_, n in f) for f in found] == [len(x) - 399 for x in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.dedup(docs).collect()}
    assert [got[i] for i in range(3)] == brute(texts, 400)


def buffers_of(text):
    import pyarrow as pa

    return suffixes.buffers(pa.RecordBatch.from_arrays([pa.array([text])], ["t"]), 0, 400)


def test_repeated_rows_and_empty_table(spark):
    rng = random.Random(3)
    t = made(rng, "abc", 450)
    docs = spark.createDataFrame([(None, t), (1, t), (1, t), (2, t[:399])], "doc_id long, text string")
    assert sorted((r["id"] or 0, r["n_removed"]) for r in suffixes.dedup(docs).collect()) == [(0, 450), (1, 450), (1, 450), (2, 0)]
    assert suffixes.dedup(docs.where("doc_id = 9")).count() == 0


def test_merge_against_sorting():
    rng = random.Random(2)
    for _ in range(200):
        every = [bytes(rng.choices(b"ab", k=rng.randint(0, 12))) for _ in range(rng.randint(0, 60))]
        k = rng.randint(1, 7)
        runs = [lcpsort.decoded(lcpsort.front_coded(*lcpsort.run_of(every[i::k]))) for i in range(k) if every[i::k]]
        got = list(lcpsort.neighbours(runs)) if runs else []
        want = []
        for s in sorted(set(every)):
            others = list(every)
            others.remove(s)
            want.append((s, max((lcpsort.common(s, o) for o in others), default=0)))
        assert got == want


def test_key_ranges(spark, monkeypatch):
    monkeypatch.setattr(lcpsort, "RUN", 50)
    rng = random.Random(4)
    every = [bytes(rng.choices(b"ab", k=rng.randint(1, 14))) for _ in range(900)] + [b"hot"] * 300
    df = common.written(spark.createDataFrame([(rng.getrandbits(40), bytearray(s)) for s in every], "s1 long, s binary").repartition(3), "t")
    got = {(r["d1"], r["d2"]): r["shared"] for r in lcpsort.longest_shared(df, lambda b: b.column("s").to_pylist(), len(every)).collect()}
    want = {lcpsort.digest(s): n for s, n in lcpsort.neighbours([lcpsort.decoded(lcpsort.front_coded(*lcpsort.run_of(list(every))))])}
    assert got == want


def brute_passages(texts, span, words):
    """Runs of repeated strings with enough words, and the texts without them."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + span] for d in data for i in range(len(d) - span + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 2, dtype=int)
        for i in range(len(d) - span + 1):
            if seen[d[i : i + span]] > 1:
                gone[i + 1 : i + span + 1] = 1
        edges = np.flatnonzero(np.diff(gone)).reshape(-1, 2)
        spans = [(a, b) for a, b in edges.tolist() if len(d[a:b].split()) >= words]
        ends = [0, *(b for _, b in spans)]
        out.append((len(spans), b"".join(d[x:y] for x, y in zip(ends, [*(a for a, _ in spans), len(d)], strict=True))))
    return out


def prose(rng, n):
    return " ".join(made(rng, "abcdefghé", rng.randint(2, 8)) for _ in range(n))


def test_passages_beside_the_long_span(spark):
    rng = random.Random(12)
    shared = [prose(rng, n) for n in (30, 51, 55, 60, 90, 200)]
    texts = [" ".join([prose(rng, rng.randint(0, 60)), rng.choice(shared), prose(rng, rng.randint(0, 60))]) for _ in range(60)]
    texts += [shared[5] + " " + prose(rng, 9) + " " + shared[5], prose(rng, 300), "a" * 500, "a" * 500, "", None]
    docs = spark.createDataFrame([(i, t, 1, "r") for i, t in enumerate(texts)], "doc_id long, text string, n_chars int, runs string").repartition(3)
    got = {r["id"]: r for r in suffixes.dedup(docs, passage=200).collect()}
    assert [(got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) for i in range(len(texts))] == brute(texts, 400)
    want = brute_passages(texts, 200, 50)
    assert [got[i]["n_passages"] for i in range(len(texts))] == [n for n, _ in want] and sum(n for n, _ in want) > 40
    left = suffixes.without_repeats(docs)
    assert left.columns == docs.columns
    rows = {r["doc_id"]: r for r in left.collect()}
    assert [rows[i]["text"] if texts[i] is not None else "" for i in range(len(texts))] == [x.decode("utf-8", "ignore") for _, x in want]
    assert rows[len(texts) - 1]["text"] is None and all(r["n_chars"] == len(r["text"]) for r in rows.values() if r["text"] is not None)
    assert {r["runs"] for r in rows.values()} == {"r"}


@pytest.mark.parametrize(("seed", "span", "passage"), [(1, 100, 60), (5, 80, 80), (6, 60, 40)])
def test_two_spans_against_brute_force(spark, seed, span, passage):
    texts = corpus(seed, span)
    docs = spark.createDataFrame([(i if i % 7 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(2)
    got = Counter((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], r["n_passages"]) for r in suffixes.dedup(docs, span=span, passage=passage, words=2).collect())
    assert got == Counter((*x, n) for x, (n, _) in zip(brute(texts, span), brute_passages(texts, passage, 2), strict=True))


def test_the_shuffle_of_all_contexts_ends_before_that_of_the_texts(spark, monkeypatch):
    """The contexts that are asked for come from a written table: no shuffle of all contexts lies beside the texts'."""
    plans, partial = [], suffixes.partial

    def seen(keyed, asked, span):
        plans.append(asked._jdf.queryExecution().executedPlan().toString())
        return partial(keyed, asked, span)

    monkeypatch.setattr(suffixes, "partial", seen)
    texts = corpus(3, 60)
    got = {r["id"]: r for r in suffixes.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), span=60).collect()}
    assert len(got) == len(texts) and any(r["n_removed"] for r in got.values())
    assert plans and not any("Exchange" in p for p in plans)
