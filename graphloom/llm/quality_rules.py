"""Quality rules with adaptive thresholds, in DataFrame functions only.

Rates of each text become counts in a mergeable sketch: an integer below 64 is its own bucket, a larger one keeps its
six leading bits, so that a bucket is at most 1/32 wide and sketches merge by adding counts.  The sketch of each
(language, source) is merged with PRIOR rows dealt as its language's, and that with PRIOR rows dealt as all, so a small
group leans on its language without any switch.  Its quantiles give the group's fences:

- symbols, repeated lines and repeated words: WIDER times the quantile of TAIL; a text is over it only by more than
  DEVIATIONS standard deviations of a count, so that one or two of them in a short text say nothing;
- characters a word: FENCE quartile distances below the lower and above the upper quartile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import release, small, written

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Rows dealt as the wider group's that each sketch is merged with.
PRIOR = 100
#: Percentiles that hold what is usual: up to a tenth of a source may be strewn with symbols, a hundredth repeats itself.
TAIL = {"symbols": 90, "lines": 99, "repeats": 99}
#: Fences over the percentile, in halves; and those of the characters a word, in quartile distances.
WIDER, FENCE = 3, 3
DEVIATIONS = 3

def measured(text: Column) -> dict[str, Column]:
    """First the arrays that the counts need: words, and \\n-split lines that have a word."""
    whole = F.coalesce(text, F.lit(""))
    return {
        "whole": whole,
        "words": F.filter(F.split(F.translate(whole, BLANKS[1:], " " * 5), " ", -1), lambda w: w != ""),
        "lines": F.filter(F.split(whole, "\n", -1), lambda line: F.translate(line, BLANKS, "") != ""),
    }


def counted(rows: DataFrame) -> DataFrame:
    """n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words from the arrays of :func:`measured`."""
    three = F.expr(
        "array_sort(transform(sequence(0, size(words) - 3), i -> struct(xxhash64(words[i], words[i + 1], words[i + 2]) AS h, i AS i)))"
    )
    twice = F.expr(
        "array_sort(transform(filter(sequence(0, size(three) - 1), k -> three[k].h = get(three, k - 1).h OR three[k].h = get(three, k + 1).h), k -> three[k].i))"
    )
    cover = F.expr("aggregate(twice, struct(-3 AS last, 0 AS n), (a, i) -> struct(i AS last, a.n + least(3, i - a.last) AS n)).n")
    rows = rows.withColumn("three", F.when(F.size("words") >= 3, three))
    rows = rows.withColumn("twice", F.when(F.size("words") >= 3, twice).otherwise(F.array().cast("array<int>")))
    return rows.withColumns(
        {
            "n_words": F.size("words").cast("long"),
            "word_chars": F.char_length(F.translate("whole", BLANKS, "")).cast("long"),
            "n_symbols": (F.char_length("whole") - F.char_length(F.translate("whole", SYMBOLS, ""))).cast("long"),
            "n_lines": F.size("lines").cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
            "n_repeat_words": cover.cast("long"),
        }
    ).drop("whole", "words", "lines", "three", "twice")


#: What is counted, and among how many.
PARTS = {"symbols": ("n_symbols", "n_words"), "lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"), "length": ("word_chars", "n_words")}
RATES = {k: f"{n} * 1000 div greatest({of}, 1)" for k, (n, of) in PARTS.items()}
#: Bucket of a rate v, and the largest rate of bucket b.
BUCKET = "IF(v < 64, v, (length(bin(v)) - 6) * 32 + shiftright(v, CAST(length(bin(v)) - 6 AS INT)))"
VALUE = "IF(b < 64, b, shiftleft(b - (b div 32 - 1) * 32 + 1, CAST(b div 32 - 1 AS INT)) - 1)"


def sketches(metrics: DataFrame) -> DataFrame:
    """(l, s, rate, b, n): one mergeable sketch for each language, source and rate, from rows that pass the base rules."""
    rates = F.explode(F.array(*(F.struct(F.lit(k).alias("rate"), F.expr(v).alias("v")) for k, v in RATES.items())))
    each = metrics.where("NOT base_failed").select("l", "s", rates.alias("r")).select("l", "s", "r.rate", F.col("r.v").alias("v"))
    return each.select("l", "s", "rate", F.expr(BUCKET).alias("b")).groupBy("l", "s", "rate", "b").agg(F.count("*").cast("double").alias("n"))


def merged(sketch: DataFrame) -> DataFrame:
    """(l, s, rate, b, w): each sketch with PRIOR rows dealt as its language's, which has PRIOR rows dealt as all.

    Weights are whole numbers in doubles: counts times N (all rows) times the language's rows and PRIOR.  A group has a
    row for each bucket of all, at most 64 + 32 * 58 a rate.
    """
    every = sketch.groupBy("rate", "b").agg(F.sum("n").alias("of_all"))
    total = every.groupBy("rate").agg(F.sum("of_all").alias("total"))
    langs = sketch.groupBy("l", "rate", "b").agg(F.sum("n").alias("of_lang"))
    sizes = langs.groupBy("l", "rate").agg(F.sum("of_lang").alias("in_lang"))
    wide = sizes.join(every.join(total, "rate"), "rate").join(langs, ["l", "rate", "b"], "left")
    wide = wide.select("l", "rate", "b", (F.col("total") * (F.col("in_lang") + PRIOR)).alias("unit"), (F.coalesce("of_lang", F.lit(0.0)) * F.col("total") + PRIOR * F.col("of_all")).alias("share"))
    groups = sketch.select("l", "s", "rate").distinct().join(wide, ["l", "rate"]).join(sketch, ["l", "s", "rate", "b"], "left")
    return groups.select("l", "s", "rate", "b", (F.coalesce("n", F.lit(0.0)) * F.col("unit") + PRIOR * F.col("share")).alias("w"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """(l, s, f_symbols, f_lines, f_repeats, f_least, f_most) for each language and source; the windows are over the buckets of a sketch."""
    group = Window.partitionBy("l", "s", "rate")
    run = merged(sketch).withColumns({"up": F.sum("w").over(group.orderBy("b")), "all": F.sum("w").over(group)})

    def percentile(k: int) -> Column:
        return F.min(F.when(F.col("up") * 100 >= F.col("all") * k, F.expr(VALUE)))

    found = run.groupBy("l", "s", "rate").agg(*(percentile(k).alias(f"q{k}") for k in (25, 75, 90, 99)))
    fence = {f"f_{r}": (r, F.expr(f"q{k} * {WIDER} div 2")) for r, k in TAIL.items()}
    fence |= {"f_least": ("length", F.col("q25") - FENCE * (F.col("q75") - F.col("q25"))), "f_most": ("length", F.col("q75") + FENCE * (F.col("q75") - F.col("q25")))}
    return found.groupBy("l", "s").agg(*(F.max(F.when(F.col("rate") == r, f)).alias(name) for name, (r, f) in fence.items()))


def over(rate: str) -> str:
    """Whether a text has significantly more than the fence f allows: x = count - f * n / 1000 with x > 0 and x^2 > DEVIATIONS^2 (f * n / 1000 + 1)."""
    n, of = PARTS[rate]
    allowed, excess = f"CAST(f_{rate} AS DOUBLE) * {of} / 1000", f"(CAST({n} AS DOUBLE) - CAST(f_{rate} AS DOUBLE) * {of} / 1000)"
    return f"({excess} > 0 AND {excess} * {excess} > {DEVIATIONS**2} * ({allowed} + 1))"


#: A text is out where it is over a fence; one whose group has none isn't.
OUT = "coalesce(" + " OR ".join([*map(over, TAIL), f"({RATES['length']}) < f_least", f"({RATES['length']}) > f_most"]) + ", false)"


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Rows (id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed, kept, f_*), one for each of ``docs``.

    Null text: no words, base_failed.  A null language or source is a group like any other; null ids and repeated rows
    are kept; an empty table gives no rows; other columns are not read.
    """
    named = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("_text"))
    rows = counted(named.withColumns(measured(F.col("_text"))).drop("_text"))
    keys = {k: F.coalesce(F.concat(F.lit("="), c), F.lit("")) for k, c in (("l", "lang"), ("s", "source"))}  # null is a value too
    metrics = written(rows.withColumns({"base_failed": F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"), **keys}), "metrics")
    sketch = written(sketches(metrics), "sketch")
    limits = written(thresholds(sketch), "limits")
    release(sketch)
    judged = metrics.join(small(limits), ["l", "s"], "left").drop("l", "s")
    return judged.withColumn("kept", ~F.col("base_failed") & ~F.expr(OUT))


ORACLE = rf"""
WITH docs AS (SELECT row_number() OVER () AS uid, doc_id, lang, source, coalesce(text, '') AS whole FROM documents),
split AS (
    SELECT uid, regexp_extract_all(whole, '[^\x20\x09-\x0D]+') AS words,
           list_filter(string_split(whole, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
           length(whole) - length(translate(whole, '{SYMBOLS}', '')) AS n_symbols
    FROM docs
), spots AS (SELECT uid, unnest(range(1, len(words) - 1)) AS i, words FROM split WHERE len(words) >= 3),
windows AS (SELECT uid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w FROM spots),
twice AS (SELECT uid, i FROM (SELECT uid, i, count(*) OVER (PARTITION BY uid, w) AS n FROM windows) WHERE n > 1),
cover AS (SELECT uid, count(DISTINCT j) AS n FROM (SELECT uid, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY uid),
metrics AS (
    SELECT d.uid, doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
           CAST(n_symbols AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
           CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
    FROM docs d JOIN split s USING (uid) LEFT JOIN cover c USING (uid)
), base AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM metrics),
rated AS (
    SELECT *, n_symbols * 1000 // greatest(n_words, 1) AS symbols, n_dup_lines * 1000 // greatest(n_lines, 1) AS lines,
           n_repeat_words * 1000 // greatest(n_words, 1) AS repeats, word_chars * 1000 // greatest(n_words, 1) AS length FROM base
), long AS (
    SELECT lang, source, u.rate AS rate, u.v AS v
    FROM (SELECT lang, source, unnest([{{'rate': 'symbols', 'v': symbols}}, {{'rate': 'lines', 'v': lines}}, {{'rate': 'repeats', 'v': repeats}}, {{'rate': 'length', 'v': length}}]) AS u FROM rated WHERE NOT base_failed)
), sketch AS (
    SELECT lang, source, rate, CASE WHEN v < 64 THEN v ELSE (length(bin(v)) - 6) * 32 + (v >> (length(bin(v)) - 6)) END AS b, CAST(count(*) AS DOUBLE) AS n FROM long GROUP BY ALL
), every AS (SELECT rate, b, sum(n) AS of_all FROM sketch GROUP BY ALL),
langs AS (SELECT lang, rate, b, sum(n) AS of_lang FROM sketch GROUP BY ALL),
sizes AS (SELECT lang, rate, sum(of_lang) AS in_lang FROM langs GROUP BY ALL),
wide AS (
    SELECT z.lang, z.rate, e.b, in_lang, sum(of_all) OVER (PARTITION BY z.lang, z.rate) AS total, coalesce(of_lang, 0) AS of_lang, of_all
    FROM sizes z JOIN every e USING (rate) LEFT JOIN langs g ON g.lang IS NOT DISTINCT FROM z.lang AND g.rate = z.rate AND g.b = e.b
), run AS (
    SELECT lang, source, rate, b, sum(w) OVER (PARTITION BY lang, source, rate ORDER BY b) AS up, sum(w) OVER (PARTITION BY lang, source, rate) AS every,
           CASE WHEN b < 64 THEN b ELSE ((b - (b // 32 - 1) * 32 + 1) << (b // 32 - 1)) - 1 END AS value
    FROM (
        SELECT g.lang, g.source, g.rate, w.b, coalesce(k.n, 0) * total * (in_lang + {PRIOR}) + {PRIOR} * (of_lang * total + {PRIOR} * of_all) AS w
        FROM (SELECT DISTINCT lang, source, rate FROM sketch) g JOIN wide w ON w.lang IS NOT DISTINCT FROM g.lang AND w.rate = g.rate
        LEFT JOIN sketch k ON k.lang IS NOT DISTINCT FROM g.lang AND k.source IS NOT DISTINCT FROM g.source AND k.rate = g.rate AND k.b = w.b
    )
), quantiles AS (
    SELECT lang, source, rate, {", ".join(f"min(value) FILTER (up * 100 >= every * {k}) AS q{k}" for k in (25, 75, 90, 99))} FROM run GROUP BY ALL
), fence AS (
    SELECT lang, source, {", ".join(f"max(q{k} * {WIDER} // 2) FILTER (rate = '{r}') AS f_{r}" for r, k in TAIL.items())},
           max(q25 - {FENCE} * (q75 - q25)) FILTER (rate = 'length') AS f_least, max(q75 + {FENCE} * (q75 - q25)) FILTER (rate = 'length') AS f_most FROM quantiles GROUP BY ALL
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce({" OR ".join(map(over, TAIL))} OR length < f_least OR length > f_most, false) AS kept
FROM rated r LEFT JOIN fence w ON r.lang IS NOT DISTINCT FROM w.lang AND r.source IS NOT DISTINCT FROM w.source
"""
