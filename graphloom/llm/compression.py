"""Quality classifier by compression.

Text that resembles a dictionary's text compresses better with it.  Two zstandard dictionaries for each view of a text (its
bytes, and its shape: letters, capitals and digits each made one) hold pieces of good and of bad labelled texts.  The
difference of the compressed sizes, divided by their sum, and the sizes themselves are calibrated to a
probability by a logistic regression on labelled texts that are not in the dictionaries.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import text_chunks, written

#: Labelled texts that a fit uses at most, half for the dictionaries and half for the calibration, those of the least hashes of their ids.
LABELLED = 6000
#: Bytes of a dictionary, bytes that a labelled text gives it at most, bytes compressed at a time.
DICTIONARY, PIECE, CHUNK = 65_536, 400, 2048
LEVEL = 3
THRESHOLD = 0.7
SHAPE = bytes(97 if c >= 128 or 97 <= c <= 122 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256))
PLAIN = dict(level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)


@dataclass
class Model:
    """dictionaries: (bad, good) for each view; weights over the expanded features, or None where labels were of one kind: then ``share`` is every score."""

    dictionaries: list[tuple[bytes, bytes]]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None
    share: float


def compressors(model: Model) -> list[list[zstandard.ZstdCompressor]]:
    out = []
    for both in model.dictionaries:
        row = []
        for content in both:
            one = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            one.precompute_compress(level=LEVEL)
            row.append(zstandard.ZstdCompressor(dict_data=one, **PLAIN))
        out.append(row)
    return out


def features(text: bytes, tools: list[list[zstandard.ZstdCompressor]]) -> list[float]:
    """Of each view the difference of its sizes over their sum, and the log of their mean over the length; then the log of the length."""
    n, out = max(1, len(text)), []
    for view, (bad, good) in zip((text, text.translate(SHAPE)), tools, strict=True):
        pieces = [view[i : i + CHUNK] for i in range(0, n, CHUNK)]
        a, b = (sum(len(tool.compress(p)) for p in pieces) for tool in (bad, good))
        out += [(a - b) / (a + b), math.log((a + b) / 2 / n)]
    return [*out, math.log(n)]


def expanded(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / scale, -5, 5)
    pairs = [z[:, i] * z[:, j] for i in range(z.shape[1]) for j in range(i, z.shape[1])]
    return np.stack([np.ones(len(z)), *z.T, *pairs], axis=1)


def calibrated(a: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton's method."""
    w = np.zeros(a.shape[1])
    keep = ridge * np.eye(len(w))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a.T * (p * (1 - p) + 1e-9)) @ a + keep, a.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def featured(docs: DataFrame, model: Model, rest: list[str]) -> DataFrame:
    """Columns ``rest`` and x: the features of column text."""

    def run(batches):
        tools = compressors(model)
        for batch in batches:
            for start, end in text_chunks(batch, 0):
                part = batch.slice(start, end - start)
                x = [features(t or b"", tools) for t in part.column(0).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(x, pa.list_(pa.float64()))], [*rest, "x"])

    few = docs.select(F.col("text").cast("string").alias("text"), *rest)
    return few.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in few.schema.fields[1:]) + ", x array<double>")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", labelled: int = LABELLED) -> Model:
    """A model of at most ``labelled`` rows of ``docs`` that ``labels`` marks 0 or 1 (the least of several marks).

    Null ids, labels and texts are passed over.  At most PIECE bytes of half of these texts, and the features of
    the other half, come to the driver.
    """
    marked = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).cast("int").alias("y"))
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    found = own.select("id").distinct().join(marked, F.col("id") == F.col("_id")).select("_id", "y").orderBy(F.xxhash64("_id"), "_id").limit(labelled)
    known = own.join(F.broadcast(found), F.col("id") == F.col("_id")).select("text", "y", F.xxhash64("id", "text").alias("h"))  # no text is shuffled
    chosen = written(known.orderBy("h").limit(labelled), "labelled")
    place = F.expr(f"1 + pmod(shiftright(h, 8), greatest(length(text) - {PIECE}, 1))")
    pieces = chosen.where("h % 2 = 0").select("y", "h", F.substring("text", place, F.lit(PIECE)).alias("piece")).collect()
    content = {0: b"", 1: b""}
    for r in sorted(pieces, key=lambda r: r["h"]):
        if len(content[r["y"]]) < DICTIONARY:
            content[r["y"]] += r["piece"].encode()[:PIECE] + b"\n"
    bad, good = (content[k][:DICTIONARY] for k in (0, 1))
    model = Model([(bad, good), (bad.translate(SHAPE), good.translate(SHAPE))], np.zeros(5), np.ones(5), None, 0.5)
    if min(len(bad), len(good)) < 8:  # shorter ones are no dictionaries
        count = len(pieces)
        model.share = sum(r["y"] for r in pieces) / count if count else 0.5
        return model
    rows = featured(chosen.where("h % 2 <> 0").select("text", "y"), model, ["y"]).collect()
    y = np.array([r["y"] for r in rows], dtype=float)
    if len(set(y)) < 2:
        model.share = float(y.mean()) if len(y) else 0.5
        return model
    x = np.array([r["x"] for r in rows])
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-9
    model.weights = calibrated(expanded(x, model.mean, model.scale), y)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, score), one for each of ``docs``: the probability of label 1 for the whole text.

    A null text counts as empty and is scored as such; null ids and repeated rows are kept; an empty table gives no
    rows; other columns are not read.
    """
    if model.weights is None:
        return docs.select(F.col(id_col).alias("id"), F.lit(model.share).alias("score"))
    found = featured(docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("id")), model, ["id"])
    z = [F.greatest(F.lit(-5.0), F.least(F.lit(5.0), (F.col("x")[i] - float(m)) / float(s))) for i, (m, s) in enumerate(zip(model.mean, model.scale, strict=True))]
    found = found.select("id", *(c.alias(f"z{i}") for i, c in enumerate(z)))
    names = [F.lit(1.0), *(F.col(f"z{i}") for i in range(5)), *(F.col(f"z{i}") * F.col(f"z{j}") for i in range(5) for j in range(i, 5))]
    total = sum((c * float(w) for c, w in zip(names[1:], model.weights[1:], strict=True)), F.lit(float(model.weights[0])))
    return found.select("id", (1 / (1 + F.exp(-total))).alias("score"))


def held_out(id_col: str):
    """The fold that no label is learnt from."""
    return F.crc32(F.col(id_col).cast("string")) % 4 == 2


def fold(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % 4
