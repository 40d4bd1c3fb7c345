from __future__ import annotations

import random
import re
from collections import Counter
from fractions import Fraction

from graphloom.llm import quality_rules as rules


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    three = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(three)
    cover = {i + k for i, t in enumerate(three) if seen[t] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return (n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover), n < 50 or 100 * len(cover) > 50 * n)


def corpus(seed=1):
    rng = random.Random(seed)
    words = ["a", "bé", "c|", "日本", "#x", "dd", "e\x1cf", " g", "h<>"] + [f"w{i}" for i in range(200)]
    rows = []
    for i in range(240):
        text = "".join(rng.choice(words) + rng.choice([" ", "  ", "\n", "\t", "\x0b", "\r\n"]) for _ in range(rng.choice([0, 2, 60, 120, 400])))
        rows.append((i, text + (text[:90] * rng.randint(0, 4)), rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s1", None])))
    return rows + [(903, " ".join(f"u{i}####" for i in range(90)), "en", "s0"), (900, None, "en", "s0"), (901, "", "fr", "s9"), (902, "x y z " * 6000, "en", "s0"), (902, "x y z " * 6000, "en", "s0"), (None, "one\none", None, None)]


def bucket(v):
    e = max(0, v.bit_length() - 6)
    return e * 32 + (v >> e) if e else v


def top(b):
    e = b // 32 - 1
    return b if b < 64 else ((b - e * 32 + 1) << e) - 1


def test_counts_and_verdicts(spark):
    rows = corpus()
    got = rules.judge(spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, lang string, source string, kept int")).collect()
    assert sorted((r["id"] or 0, r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got) == sorted((i or 0, *brute(t)) for i, t, _, _ in rows)
    parts = {"symbols": ("n_symbols", "n_words"), "lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"), "length": ("word_chars", "n_words")}
    rate = lambda r, k: r[parts[k][0]] * 1000 // max(1, r[parts[k][1]])
    good = [r for r in got if not r["base_failed"]]

    def quantile(k, r, percent):
        """Of the group with a hundred rows dealt as the language's, which has a hundred dealt as all."""
        lang = [x for x in good if x["lang"] == r["lang"]]
        own = [x for x in lang if x["source"] == r["source"]]
        weight = Counter()
        for some, w in ((own, 1), (lang, Fraction(100, len(lang) + 100)), (good, Fraction(100, len(lang) + 100) * Fraction(100, len(good)))):
            for x in some:
                weight[bucket(rate(x, k))] += w
        up = 0
        for b in sorted(weight):
            up += weight[b]
            if up * 100 >= sum(weight.values()) * percent:
                return top(b)

    for r in got:
        out = False
        if any((x["lang"], x["source"]) == (r["lang"], r["source"]) for x in good):
            for k, percent in (("symbols", 90), ("lines", 99), ("repeats", 99)):
                allowed = Fraction(quantile(k, r, percent) * 3 // 2 * r[parts[k][1]], 1000)
                x = r[parts[k][0]] - allowed
                out |= x > 0 and x * x > 9 * (allowed + 1)
            q1, q3 = (quantile("length", r, p) for p in (25, 75))
            out |= not q1 - 3 * (q3 - q1) <= rate(r, "length") <= q3 + 3 * (q3 - q1)
        assert r["kept"] == (not r["base_failed"] and not out), r
    assert 0 < sum(r["kept"] for r in got) < len(good)


def test_sketch_is_native_and_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert rules.judge(empty).count() == 0
    got = {r["v"]: (r["b"], r["t"]) for r in spark.range(0, 5000, 7).selectExpr("id AS v").selectExpr("v", f"{rules.BUCKET} AS b").selectExpr("v", "b", f"{rules.VALUE} AS t").collect()}
    assert all(b == bucket(v) and t == top(b) and v <= t <= v * 33 // 32 + 1 for v, (b, t) in got.items())
