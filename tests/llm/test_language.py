from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
from graphloom.llm import language as lang

WORDS = {"en": ["the", "and", "thing", "with", "ing", "wh"], "fr": ["le", "é", "que", "ment", "eau", "oui"], "de": ["der", "und", "sch", "ung", "ö", "heit"]}


def corpus():
    rng = random.Random(2)
    rows = []
    for i in range(200):
        true = rng.choice(list(WORDS))
        host = {"en": "a.x.com", "fr": "b.x.com", "de": "c.y.org"}[true] if i % 4 else None
        said = true if rng.random() < 0.8 else rng.choice([None, "en", "xx"])
        rows.append((i, " ".join(rng.choices(WORDS[true], k=rng.choice([0, 1, 3, 50]))), said, rng.choice([None, "com", "org"]), host))
    return rows + [(900, None, "en", None, None), (901, "123 !!", "de", "com", "c.y.org"), (None, "der und", None, None, "new.y.org"), (3, rows[3][1], *rows[3][2:])]


def brute(rows, model):
    names = model.languages
    lls, ns = [], []
    for _, text, *_ in rows:
        who, bucket = lang.trigrams([(text or "").encode()])
        n = len(bucket)
        lls.append([float(np.sum(t[bucket], dtype=np.float64)) / max(n, 1) * (n / (1 + n / lang.TEMPER)) for t in model.table])
        ns.append(n)
    best = [int(np.argmax(x)) for x in lls]
    use = [i for i, n in enumerate(ns) if n]
    total = Counter(best[i] for i in use)
    share = [(total[k] + 1) / (len(use) + len(names)) for k in range(len(names))]
    count = defaultdict(Counter)
    domain = lambda h: ".".join(h.split(".")[-2:]) if h else None
    for i in use:
        _, _, d, s, h = rows[i]
        for key in (("d", d), ("s", s), ("h", h), ("o", domain(h))):
            count[key][best[i]] += 1
    kinds = {k: len({x for (a, x) in count if a == k and x is not None}) for k in "ds"}
    out = []
    for (name, _, d, s, h), ll, n in zip(rows, lls, ns, strict=True):
        score = []
        for k in range(len(names)):
            v = ll[k]
            for key, x in (("d", d), ("s", s)):
                if x is not None and count.get((key, x)):
                    v += math.log((count[key, x][k] + 1) / (total[k] + kinds[key] + 1))
            if h is not None and count.get(("h", h)):
                o, c = count["o", domain(h)], count["h", h]
                wide = (o[k] + 50 * share[k]) / (sum(o.values()) + 50)
                v += math.log((c[k] + 20 * wide) / (sum(c.values()) + 20))
            else:
                v += math.log(share[k])
            score.append(v)
        top = max(score)
        p = 1 / sum(math.exp(x - top) for x in score)
        best_name = names[score.index(top)]
        out.append((name, best_name, round(p, 6), n > 0 and p >= 0.5 and best_name != "und"))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1) for r in rows], "id long, text string, declared string, suffix string, host string, n int")
    model = lang.train(df)
    got = sorted(((r["id"], r["language"], round(r["confidence"], 6), r["kept"]) for r in lang.identify(df, model).collect()), key=str)
    want = brute(rows, model)
    assert [g[:2] + g[3:] for g in got] == [w[:2] + w[3:] for w in want]
    assert all(abs(g[2] - w[2]) < 1e-5 for g, w in zip(got, want, strict=True))


def test_documents_pages_and_empty(spark):
    rows = [(i, " ".join(WORDS[x] * 9), x.upper() + "-XX", "s") for i, x in enumerate(["en", "fr", "de"] * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["id"]: r for r in lang.identify(lang.documents(docs)).collect()}
    assert all(got[i]["language"] == x.lower()[:2] and got[i]["kept"] for i, _, x, _ in rows)
    assert lang.identify(lang.documents(docs.where("doc_id < 0"))).count() == 0
    raw = spark.createDataFrame([(1, "https://U@WWW.Ex.ORG:80/a?b", "<html class=x lang='fr-CA'><script>the</script><p>le&amp;é</p>"), (2, None, None)], "page_id long, url string, html string")
    one, two = lang.pages(raw).orderBy("id").collect()
    assert (one["declared"], one["suffix"], one["host"], one["text"].split()) == ("fr", "org", "www.ex.org", ["le&amp;é"])
    assert (two["text"], two["declared"], two["host"]) == (None, None, None)


def prose(rng, name, n):
    return " ".join(rng.choices(WORDS[name], k=n))


def test_rare_languages_are_learnt_and_unknown_ones_rejected(spark):
    """Ten of 3,000 rows declare German; French is declared by nobody; what stands late in a long text counts."""
    rng = random.Random(4)
    rows = [(i, prose(rng, "en", 40), "en", "s") for i in range(2990)] + [(5000 + i, "1 2 3 " * 2000 + prose(rng, "de", 60), "de", "s") for i in range(10)]
    rows += [(6000 + i, prose(rng, "de", 40), None, "t") for i in range(5)] + [(7000 + i, "éàé ôui quéau mèntéàu çàüï " * 8, None, "t") for i in range(5)]
    got = {r["id"]: r for r in lang.identify(lang.documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))).collect()}
    assert all(got[i]["language"] == "en" and got[i]["kept"] for i in range(2990))
    assert all(got[i]["language"] == "de" and got[i]["kept"] for i in [*range(5000, 5010), *range(6000, 6005)])
    assert all(got[i]["language"] == "und" and not got[i]["kept"] for i in range(7000, 7005))


def test_sample_of_each_language_is_bounded(spark):
    rng = random.Random(6)
    rows = spark.createDataFrame([(prose(rng, x, 30), x) for x in ["en"] * 900 + ["fr"] * 30 + ["de"] * 4], "text string, declared string")
    model = lang.train(rows, sample=50)
    assert model.languages == ["en", "fr", "und"] and model.table.shape == (3, lang.BUCKETS)
    assert np.allclose(np.exp(model.table.astype(float)).sum(1), 1, atol=1e-3)


def test_character_references(spark):
    raw = spark.createDataFrame([(i, "http://a.example.org/", f"<html lang='{x}'><p>{t}") for i, (x, t) in enumerate([("de", "f&uuml;r &#246;ffnen und sch&ouml;n " * 9), ("en", "the thing with &amp; " * 9)] * 6)], "page_id long, url string, html string")
    got = {r["id"]: r for r in lang.identify(lang.pages(raw), entities=True).collect()}
    assert all(got[i]["language"] == ["de", "en"][i % 2] for i in range(12))
    assert 0 <= got[0]["n_trigrams"] - len(lang.trigrams(["für öffnen und schön ".encode() * 9])[1]) <= 2  # blanks around
