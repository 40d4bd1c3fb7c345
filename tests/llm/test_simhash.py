from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from graphloom.llm import simhash
from graphloom.llm.components import components


def brute(texts):
    prints = []
    for text in texts:
        words = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
        prints.append(sum(1 << k for k in range(64) if sum(h >> k & 1 for h in hashes) * 2 > len(hashes)))
    return prints, group(prints)


def group(prints):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 2:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(prints))]


def test_whole_against_brute_force(spark):
    rng = random.Random(3)
    words = [f"W{i}é" if i % 9 == 0 else f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 30))) for _ in range(150)]
    texts += [t.upper() if i % 2 else t + "\n" for i, t in enumerate(texts[:40])] + ["", None, " \t", "one", "one two", "x " * 5000]
    rows = [(i, t, "clash") for i, t in enumerate(texts)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, component_id string")).collect()
    prints, roots = brute(texts)
    assert {(r["id"], r["fingerprint"], r["component_id"]) for r in got} == {(i, f"{p:016x}", c) for i, (p, c) in enumerate(zip(prints, roots, strict=True))}


@pytest.mark.parametrize("paired", [2, 10, 10_000])
def test_links_by_both_routes(spark, paired):
    rng = random.Random(paired)
    base = [rng.getrandbits(64) for _ in range(5)]
    prints = set(base)
    for _ in range(160):
        x = rng.choice(sorted(prints))
        for k in rng.sample(range(64), rng.randint(1, 4)):
            x ^= 1 << k
        prints.add(x)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), 2, paired)
    assert all(((r["a"] ^ r["b"]) & (1 << 64) - 1).bit_count() <= 2 for r in found.collect())
    name = {r["node"]: r["component"] for r in components(found).collect()}
    want = group(prints)
    by = {}
    for s, w in zip(signed, want, strict=True):
        by.setdefault(w, set()).add(name.get(s, s))
    assert all(len(x) == 1 for x in by.values()) and len({*map(min, by.values())}) == len(by)


def test_distance_one(spark):
    prints = [0, 1, 3, 1 << 40, 7]
    for paired in (1, 64):
        got = {frozenset((r["a"], r["b"])) for r in simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"), 1, paired).collect()}
        assert got == {frozenset(x) for x in ((0, 1), (1, 3), (0, 1 << 40), (3, 7))}


def test_empty_and_repeated(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = spark.createDataFrame([(5, "a b c d"), (5, "a b c d"), (2, "a b c d"), (None, "a b c d")], "doc_id long, text string")
    assert sorted((r["id"] or 0, r["component_id"]) for r in simhash.near_duplicates(rows).collect()) == [(0, 2), (2, 2), (5, 2), (5, 2)]
    assert [r["doc_id"] for r in simhash.keep_one(rows).collect()] == [2]
    assert simhash.keep_one(rows.where("doc_id = 9")).count() == 0
    same = spark.createDataFrame([(2, "q r s t"), (2, "q r s t"), (3, None), (4, "")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.keep_one(same).collect()) == [2, 3]


def test_one_row_of_each_group_stays(spark):
    """Rows, not ids, go: a text that is like no other stays whatever id it has, and of repeated rows one is left."""
    long = " ".join(f"w{i}" for i in range(9000))
    rows = [(1, "t u v w x", "a", 1), (2, "t u v w x", "b", 2), (2, "only this one", "c", 3), (None, "t u v w x", "d", 4), (None, "nobody", "e", 5), (7, "nobody else", "f", 6), (7, "nobody else", "f", 6)]
    rows += [(8, long, None, 7), (9, long + " end", None, 8), (10, None, None, 9), (10, "", None, 10), (None, None, None, 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k1 string, same long").repartition(3)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted(kept.select("doc_id", "text", "k1").collect(), key=str)
    want = [(1, "t u v w x", "a"), (2, "only this one", "c"), (None, "nobody", "e"), (7, "nobody else", "f"), (8, long, None)]
    assert [tuple(r) for r in got if r["doc_id"] != 10] == sorted(want, key=lambda r: str(r) if 0 else f"Row(doc_id={r[0]!r}, text={r[1]!r}, k1={r[2]!r})")
    assert sum(r["doc_id"] == 10 for r in got) == 1


def test_recall_of_planted_pairs(spark):
    """1,200 pairs of Jaccard similarity 0.8 to 0.95: all are found."""
    rng = random.Random(11)
    rows = []
    for k in range(1200):
        words = [f"p{k}w{i}" for i in range(rng.choice([64, 204, 404]))]
        n = len(words) - 4
        cut = rng.randint(1, n // 9)  # the last words differ: (n - cut) / (n + cut)
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:-cut] + [f"n{k}w{i}" for i in range(cut)]))]
    got = {r["id"]: r["component_id"] for r in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[2 * k] == got[2 * k + 1] == 2 * k for k in range(1200))


def test_links_are_about_one_a_class(spark):
    links = spark.createDataFrame([(a, b) for a in range(10, 200) for b in range(8)], "a long, b long")
    few = simhash.contracted(links)
    assert few.count() <= 200
    assert {r["component"] for r in components(few).collect()} == {0}


@pytest.mark.parametrize("paired", [3, 64])
def test_similar_sets(spark, paired):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(3000)]
    rows, base = [], [rng.choices(words, k=n) for n in (40, 150, 600)]
    for b in base:
        for k in range(12):
            t = list(b)
            for at in rng.sample(range(len(t)), 0 if not k else max(1, len(t) // 70)):
                t[at] = "new" + str(rng.random())
            rows.append(" ".join(t))
    rows += [" ".join(rng.choices(words, k=rng.choice([5, 40, 200]))) for _ in range(60)]
    got = {r["id"]: r["component_id"] for r in simhash.similar(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), paired=paired).collect()}
    sets = [{tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in rows]
    for i, a in enumerate(sets):
        for j in range(i):
            alike = len(a & sets[j]) / len(a | sets[j])
            assert alike < 0.8 or got[i] == got[j]
            assert alike > 0.3 or i // 12 == j // 12 < 3 or got[i] != got[j]


def hamming_components(fp, reach):
    near = np.bitwise_count(fp[:, None] ^ fp[None]) <= reach
    label = np.arange(len(fp))
    while True:
        least = np.where(near, label[None], len(fp)).min(1)
        if (least == label).all():
            return label
        label = least


def test_large_segment_is_whole():
    """Pairs whose one side is absorbed by a large component early, among many classes of no link."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, dtype=np.uint64)
    copies = [base ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, 7, replace=False))) for _ in range(700)]
    tails = [copies[i] ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, 12, replace=False))) for i in range(0, 700, 7)]
    fp = np.array([*copies, *tails, *rng.integers(0, 1 << 63, 600, dtype=np.uint64)], dtype=np.uint64)
    same = np.sort(rng.choice(1 << 62, len(fp), replace=False))
    fp = fp[rng.permutation(len(fp))]
    label = dict(zip(same.tolist(), same.tolist(), strict=True))
    for a, b in simhash.linked(same, fp, 14, 64):
        label.update(zip(a.tolist(), b.tolist(), strict=True))
    assert [label[x] for x in same.tolist()] == same[hamming_components(fp, 14)].tolist()


def test_segment_over_many_tasks(spark):
    """One segment of a chain: neighbours link, so all is one component however the rows are spread."""
    fp = [(1 << k) - 1 for k in range(0, 63)]
    rows = [(1000 + k, f, 0, 7) for k, f in enumerate(fp)]
    random.Random(1).shuffle(rows)
    found = simhash.ring_links(spark.createDataFrame(rows, "same long, fp long, fp2 long, key long").repartition(16), 1, 8)
    assert {(r["node"], r["component"]) for r in components(found).collect()} == {(1000 + k, 1000) for k in range(63)}


@pytest.mark.parametrize("shingles", [2000, 1_000_000])
def test_similarity_is_exact(spark, shingles):
    """Pairs just below 0.8 stay apart, those above and repeats of one shingle set are found, in one block or many."""
    rows = []
    for base in range(8):
        words = [f"b{base}w{i}" for i in range(204)]  # 200 shingles
        rows += [" ".join(words[: 204 - k] + [f"n{base}c{k}w{i}" for i in range(k)]) for k in (0, 1, 40, 60)]  # (200 - k) / (200 + k)
        rows += [" ".join([f"f{base}c{k}w{i}" for i in range(18)] + words[18:]) for k in range(6)]  # 182 / 218
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in rows]
    root = list(range(len(sets)))
    for i, x in enumerate(sets):
        for j in range(i):
            if len(x & sets[j]) * 10 >= 8 * len(x | sets[j]) and root[i] != root[j]:
                least, most = sorted((root[i], root[j]))
                root = [least if r == most else r for r in root]
    assert len(set(root)) > 8
    words = [f"l{i}" for i in range(200)]
    rows += [" ".join(words + ["x"] * n) for n in (5, 6, 900)]
    got = {r["id"]: r["component_id"] for r in simhash.similar(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"), shingles=shingles).collect()}
    assert [got[i] for i in range(len(rows))] == root + [len(sets)] * 3


def test_blocks_of_one_group(spark):
    """A group over many blocks has the components of the whole group: a chain of texts, each like the next only."""
    words = [f"w{i}" for i in range(900)]
    rows = [(k + 1, " ".join(words[18 * k : 18 * k + 204]), 7, 6) for k in range(30)] + [(99, " ".join(words[::-1]), 7, 6)]
    found = simhash.verified(spark.createDataFrame(rows, "same long, text string, group long, blocks long"), 5, 0.8)
    assert {(r["node"], r["component"]) for r in components(found).collect()} == {(k + 1, 1) for k in range(30)}


def test_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 501)], "a long, b long")
    assert {(r["node"], r["component"]) for r in components(links).collect()} == {(i, 0) for i in range(101)} | {(500, 500), (501, 500)}
