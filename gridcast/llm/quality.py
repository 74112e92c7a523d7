"""Compression classifier of text quality.

Two zstandard dictionaries are built from good and from bad labelled texts. A text is cut into blocks, and each block
is compressed once with either dictionary. The difference of the two summed sizes over the text's own size is positive
where the good dictionary fits better. A logistic curve of this one number, fitted on labelled texts that neither
dictionary has seen and weighted to the classes' shares among all labels, gives the probability.

Fitting reads a bounded sample: of either class at most `per_class` labelled rows, the first by a hash of the id; of a
text of more than `sample_bytes` bytes it reads PIECES blocks at even distances, its start and end among them. Scoring
reads every text whole.

Cases: null and empty texts tell nothing and score 0.5; labels that are null or not 0 or 1, and rows that `held_out`
marks, are never read for fitting; an id with more labels counts as good if one of them is good;
without labels of both classes every score is the share of good labels (0.5 without any); an empty table gives no
rows; other columns aren't carried, except by `keep_good`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import pieces, prepare, released, text_bytes

#: Bytes compressed at once: as long as a dictionary still matters in it.
BLOCK = 2048
LEVEL = 3
#: Bytes added to a text's size, so that a few bytes tell little, and blocks that stand for a long labelled text.
DAMPING, PIECES = 10, 9
SCORE = StructField("score", DoubleType())


@dataclass(frozen=True)
class Model:
    """What a worker needs to score: two dictionaries and the curve."""

    good: bytes
    bad: bytes
    curve: tuple[float, float]  # slope and shift over difference()


def held_out(id_col: str) -> Column:
    """The fold that fitting never reads: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Sizes:
    """Normalised differences of compressed sizes."""

    def __init__(self, good: bytes, bad: bytes):
        self.compressors = []
        for raw in (good, bad):
            own = zstandard.ZstdCompressionDict(raw)
            own.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False))

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        """Rows of bytes compressed with the good, with the bad dictionary, and of the text."""
        out = np.zeros((len(texts), 3))
        good, bad = (c.compress for c in self.compressors)
        for i, t in enumerate(texts):
            blocks = [t[k : k + BLOCK] for k in range(0, len(t), BLOCK)]
            out[i] = sum(len(good(x)) for x in blocks), sum(len(bad(x)) for x in blocks), len(t)
        return out


def difference(sizes: np.ndarray) -> np.ndarray:
    """Bytes that the good dictionary saves over the bad one, by byte of text."""
    good, bad, n = sizes.T
    return (bad - good) / (n + DAMPING)


def probability(curve: tuple[float, float], sizes: np.ndarray) -> np.ndarray:
    p = 1 / (1 + np.exp(-np.clip(difference(sizes) * curve[0] + curve[1], -30, 30)))
    return np.where(sizes[:, 2] > 0, p, 0.5)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the likeliest logistic curve, by Newton steps with a weak prior."""
    mean, spread = x.mean(), x.std() + 1e-9
    z = np.column_stack([(x - mean) / spread, np.ones(len(x))])
    w = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (weight * (p * (1 - p) + 1e-9))[:, None]).T @ z + 1e-3 * np.eye(2), z.T @ (weight * (y - p)) - 1e-3 * w)
        w += step
        if abs(step).max() < 1e-9:
            break
    return float(w[0] / spread), float(w[1] - w[0] / spread * mean)


def _sampled(text: Column, sample_bytes: int) -> Column:
    """The text, or of a longer one the blocks that stand for it."""
    step = lambda i: F.floor((F.octet_length(text) - BLOCK) * i / (PIECES - 1)).cast("int")
    return F.when(F.octet_length(text) <= sample_bytes, text).otherwise(F.concat(*(F.substring(text, step(i) + 1, F.lit(BLOCK)) for i in range(PIECES))))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 4000, sample_bytes: int = 20_000, dict_bytes: int = 112_640, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Build the dictionaries and the curve on the driver from the bounded sample."""
    usable = labels.filter(F.col("quality").isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
    usable = usable.groupBy(F.col(id_col).alias("id")).agg(F.max("quality").alias("good"))
    n = {r["good"]: r["count"] for r in usable.groupBy("good").count().collect()}
    order = F.xxhash64("id")
    text = F.col(text_col).cast("binary")
    texts = docs.select(F.col(id_col).alias("id"), text.alias("text")).filter(F.octet_length("text") > 0)
    sample = []
    for k in (0, 1):
        chosen = usable.filter(F.col("good") == k).orderBy(order, "id").limit(per_class)
        rows = texts.join(F.broadcast(chosen), "id").select("id", _sampled(F.col("text"), sample_bytes).alias("text"), order.alias("h"))
        rows = rows.orderBy("h", "id", "text").limit(per_class)
        sample.append([bytes(r["text"]) for r in rows.collect()])
    bad, good = sample
    if min(len(bad), len(good)) < 20:
        share = (len(good) + 1) / (len(good) + len(bad) + 2)
        return Model(b"", b"", (0.0, float(np.log(share / (1 - share)))))
    dicts = []
    for own in (good, bad):
        use = [x for i, x in enumerate(own) if i % 3]
        try:
            dicts.append(zstandard.train_dictionary(dict_bytes, use).as_bytes())
        except zstandard.ZstdError:  # too few or too uniform samples to train on: the samples themselves are the dictionary
            dicts.append(b"".join(use)[-dict_bytes:])
    sizes = Sizes(*dicts)
    x = [difference(sizes(own[::3])) for own in (bad, good)]
    weight = [n[k] / (n[0] + n[1]) * (len(x[0]) + len(x[1])) / len(x[k]) for k in (0, 1)]
    y = np.repeat([0, 1], [len(x[0]), len(x[1])])
    return Model(dicts[0], dicts[1], _logistic(np.concatenate(x), y, np.array(weight)[y]))


def _scores(model: Model, column: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(model.good, model.bad) if model.good else lambda texts: np.array([[0, 0, len(t)] for t in texts], dtype=float).reshape(-1, 3)
        for batch in pieces(batches):
            found = probability(model.curve, sizes(text_bytes(batch.column(column))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], [*batch.schema.names, name])

    return run


def score(docs: DataFrame, model: Model, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted of every row."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    scored = rows.mapInArrow(released(_scores(model, "text", "score")), StructType([*rows.schema, SCORE]))
    return scored.select(
        F.col("id").alias(id_col),
        held_out("id").alias("held_out"),
        "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"),
    )


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that score at least the threshold."""
    prepare(docs.sparkSession)
    rows = docs.select(F.struct("*").alias("row"), docs[text_col].alias("text"))
    scored = rows.mapInArrow(released(_scores(model, "text", "score")), StructType([*rows.schema, SCORE]))
    return scored.filter(F.col("score") >= threshold).select("row.*")
