from __future__ import annotations

import random

from graphloom.llm import quotes


def test_parsing():
    text = "Hello\nAnna wrote:\n> first\n> line\n>> deeper\n> > deeper still\n\nown > words\n>last"
    body, passages = quotes.parsed(text)
    assert body == "Hello\n\nown > words" and passages == [(1, "first\nline"), (2, "deeper\ndeeper still"), (1, "last")]
    assert quotes.parsed(None) == ("", []) and quotes.parsed("\n a ") == ("\n a ", [])
    assert quotes.normal("  A\tb\nC ") == "a b c"


def brute(rows):
    parsed = [quotes.parsed(t) for *_, t in rows]
    out = []
    up = {}
    for i, (conv, turn, _, _) in enumerate(rows):
        found, linked = [], 0
        for level, passage in parsed[i][1]:
            key = quotes.normal(passage)
            said = [(t, j) for j, (c, t, _, _) in enumerate(rows) if c == conv and conv is not None and t is not None and key and key in {quotes.normal(x) for x in quotes.own(parsed[j][0])}]
            if said and turn is not None and min(said)[0] < turn:
                linked += 1
                if level == 1:
                    found.append(min(said))
        up[i] = max(found)[1] if found else None
        out.append((linked, len(parsed[i][1])))
    result = []
    for i, (conv, turn, role, _) in enumerate(rows):
        path, j = [turn], up[i]
        while j is not None:
            path.insert(0, rows[j][1])
            j = up[j]
        result.append((str(conv), str(turn), str(role), str(path[-2] if len(path) > 1 else None), len(path) - 1, str(path), out[i][1], out[i][0], parsed[i][0]))
    return sorted(result)


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for conv in range(12):
        said = []
        for turn in range(rng.randint(1, 9)):
            parts = []
            for _ in range(rng.randint(0, 2)):
                if said:
                    body = rng.choice(said)
                    mark = rng.choice(["> ", ">", "> > ", ">>"])
                    parts += [mark + (x.upper() if rng.random() < 0.3 else x) for x in rng.choice([body, body.split("\n")[0]]).split("\n")] + [""]
            own = "\n".join(" ".join(rng.choices("alpha beta gamma delta".split(), k=rng.randint(1, 4))) for _ in range(rng.randint(1, 3)))
            said.append(own)
            rows.append((conv, turn, rng.choice(["user", "assistant", None]), "\n".join([*parts, own])))
    chain = [(99, 0, "user", "m0")] + [(99, i, "user", f"> m{i - 1}\nm{i}") for i in range(1, 20)]
    rows += chain + [(7, None, "user", "> alpha"), (None, 1, "user", "x"), (None, 2, "user", "> x"), (50, 0, "user", None), (50, 1, "user", ">"), (50, 2, "system", "")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, path string").coalesce(1)
    got = quotes.link(df).collect()
    assert sorted((str(r["conv_id"]), str(r["turn"]), str(r["role"]), str(r["reply_to"]), r["depth"], str(r["path"]), r["n_quotes"], r["n_linked"], r["body"]) for r in got) == brute(rows)
    assert max(r["depth"] for r in got) == 19
    assert all(r["rendered"] == f"<|{r['role'] or 'unknown'}|>\n{r['body']}\n" for r in got)


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "> a\nb"), (1, 1, "user", "> a\nb")], "conv_id long, turn long, role string, text string")
    assert sorted(tuple(r["path"]) for r in quotes.link(df).collect()) == [(0,), (0, 1), (0, 1)]
    assert quotes.link(df.where("turn > 5")).count() == 0


def test_trimmed_quotes(spark):
    """Some lines of a paragraph, some paragraphs, a sentence of a line; the longest match is the original."""
    said = "Red one here.\nGreen two there. And more green.\nBlue three.\n\nSecond part.\n\nThird part, the longest of all."
    quoted = ["> Green two there. And more green.\n> Blue three.", "> Second part.\n>\n> Third part, the longest of all.", "> And more green.", "> Blue three.\n> Third part, the longest of all."]
    rows = [(1, 0, "user", "Blue three."), (1, 1, "user", said)] + [(1, 2 + i, "user", f"{q}\nanswer {i}") for i, q in enumerate(quoted)] + [(1, 9, "user", "> never said\nx")]
    got = {r["turn"]: r for r in quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [(got[2 + i]["reply_to"], got[2 + i]["n_quotes"], got[2 + i]["n_linked"]) for i in range(4)] == [(1, 1, 1)] * 4
    assert (got[9]["reply_to"], got[9]["n_quotes"], got[9]["n_linked"]) == (None, 1, 0)


def test_derived_quotations_are_linked(spark):
    rng = random.Random(8)
    rows = [(c, t, "user", "\n".join(" ".join(f"w{rng.randint(0, 9999)}" for _ in range(5)) + "." for _ in range(rng.randint(1, 3)))) for c in range(40) for t in range(6)]
    rows += [(None, 1, "user", "x"), (3, None, "user", "y"), (80, 0, "user", None), (80, 1, "user", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    mails = quotes.quoting(df)
    assert mails.columns == df.columns and mails.count() == len(rows)
    got = {(r["conv_id"], r["turn"]): r for r in quotes.link(mails).collect()}
    texts = {(c, t): x for c, t, _, x in rows}
    linked = 0
    for (c, t), r in got.items():
        assert r["n_linked"] == r["n_quotes"] and r["body"] == (texts[c, t] or "")
        if r["n_quotes"]:
            linked += 1
            assert r["reply_to"] == t - 1 and r["depth"] == got[c, t - 1]["depth"] + 1
    assert linked > 100 and max(r["n_quotes"] for r in got.values()) == 2
    long = spark.createDataFrame([(1, 0, "user", "word " * 60_000), (1, 1, "user", "> " + "word " * 60_000 + "\nshort")], "conv_id long, turn long, role string, text string")
    assert [r["reply_to"] for r in quotes.link(long).orderBy("turn").collect()] == [None, 0]
