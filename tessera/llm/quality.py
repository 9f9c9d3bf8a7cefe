"""Quality classifier by compression.

Two zstandard dictionaries are built, one from good and one from bad labelled text. A document is compressed piece by piece
with either; the normalised difference of the sizes, of the whole document and of its two outermost pieces, goes through a logistic
calibration fitted on labelled documents that the dictionaries have not seen. The calibration also sees what the difference is normalised by, the sizes by the byte
with either dictionary and with none: with few labelled documents the difference alone tells less (see the README).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import held_out, share_of

#: Bytes of a piece when scoring, and of a sample for a dictionary.
PIECE, SAMPLE = 256, 2048
#: Samples from one document at most, spread over all of it.
SAMPLES = 16
#: Bytes of a dictionary.
DICTIONARY = 112_640
#: Normalised differences of all pieces, the least and the largest of a piece, and the sizes by the byte: both, and without a dictionary.
N_FEATURES = 6


@dataclass
class Model:
    good: bytes
    bad: bytes
    raw: bool
    low: np.ndarray
    high: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float


class Scorer:
    """Compressors for one task."""

    def __init__(self, good: bytes, bad: bytes, raw: bool):
        import zstandard as z

        kind = z.DICT_TYPE_RAWCONTENT if raw else z.DICT_TYPE_FULLDICT
        frame = {"level": 3, "write_content_size": False, "write_dict_id": False, "write_checksum": False}
        self.good, self.bad = (z.ZstdCompressor(dict_data=z.ZstdCompressionDict(d, dict_type=kind), **frame) if d else z.ZstdCompressor(**frame) for d in (good, bad))
        self.plain = z.ZstdCompressor(**frame)

    def features(self, text: bytes) -> tuple[float, ...]:
        pieces = [text[i : i + PIECE] for i in range(0, len(text), PIECE)] or [b""]
        g, b = (np.array([len(c.compress(p)) for p in pieces], float) for c in (self.good, self.bad))
        each = (b - g) / (b + g)
        n = max(len(text), 1)
        return (b.sum() - g.sum()) / (b.sum() + g.sum()), each.min(), each.max(), g.sum() / n, b.sum() / n, len(self.plain.compress(text)) / n


def dictionary(samples: list[bytes]) -> tuple[bytes, bool]:
    """(dictionary, whether it is raw content): trained where there are samples enough for that."""
    import zstandard as z

    if len(samples) >= 100:
        try:
            return z.train_dictionary(DICTIONARY, samples).as_bytes(), False
        except z.ZstdError:
            pass
    return b"".join(samples)[-DICTIONARY:], True


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 40) -> np.ndarray:
    """Weights, the last one for the constant, by damped Newton steps."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * len(x) / 100 * np.eye(len(w)), x.T @ (y - p) - ridge * len(x) / 100 * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, rows_per_label: int = 3000) -> Model:
    """Fit on a bounded sample: about ``rows_per_label`` rows of each label, chosen by a hash of doc_id.

    Rows of the held-out quarter, with a null label or with conflicting labels are not used; of several texts with one id one is. Half of the
    sample makes the dictionaries (SAMPLES pieces of SAMPLE bytes a document at most, spread over it), the other half the calibration; of
    the latter only the features reach the driver. Four times ``rows_per_label`` rows are used at most, the first by a hash. Without rows of both labels every score is the share of label 1, or 0.5.
    """
    known = labels.where(F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("quality").alias("top")).where("q = top and q in (0, 1)").select("doc_id", "q")
    sizes = {r["q"]: r["n"] for r in known.groupBy("q").agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = sizes.get(1, 0) / sum(sizes.values()) if sizes else 0.5
    nothing = Model(b"", b"", True, *(np.zeros(N_FEATURES) for _ in range(3)), np.ones(N_FEATURES), np.zeros(N_FEATURES + 1), prior)
    if len(sizes) < 2:
        return nothing
    picked = known.where(F.when(F.col("q") == 1, share_of(F.col("doc_id"), min(1.0, rows_per_label / sizes[1]))).otherwise(share_of(F.col("doc_id"), min(1.0, rows_per_label / sizes[0]))))
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2))
    picked = picked.orderBy(F.xxhash64("doc_id", F.lit("sample")), "doc_id").limit(4 * rows_per_label)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null").join(F.broadcast(picked), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.first("q").alias("q"), F.min_by("text", F.xxhash64("text")).alias("text"))

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, found = [], []
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                pieces = -(-len(text) // SAMPLE)
                for k in range(min(SAMPLES, pieces)):
                    at = SAMPLE * (k * pieces // min(SAMPLES, pieces))
                    q.append(label)
                    found.append(text[at : at + SAMPLE])
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(found, pa.binary())], ["q", "sample"])

    samples: dict[int, list[bytes]] = {0: [], 1: []}
    for r in rows.where(half == 0).select(F.col("q").cast("int"), "text").mapInArrow(sampled, "q int, sample binary").collect():
        samples[r["q"]].append(bytes(r["sample"]))
    if not samples[0] or not samples[1]:
        return nothing
    made = [dictionary(sorted(samples[q])) for q in (1, 0)]
    if made[0][1] != made[1][1]:
        made = [(b"".join(sorted(samples[q]))[-DICTIONARY:], True) for q in (1, 0)]
    (good, raw), (bad, _) = made
    seen = rows.where(half == 1).select(F.col("q").cast("long"), F.lit(False).alias("held_out"), "text")
    table = _featured(seen, docs.sparkSession.sparkContext.broadcast((good, bad, raw))).orderBy(F.xxhash64("x"), "doc_id").collect()
    y = np.array([r["doc_id"] for r in table], float)
    if len(set(y.tolist())) < 2:
        return nothing
    x = np.array([r["x"] for r in table])
    low, high, mean, scale = x.min(axis=0), x.max(axis=0), x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    return Model(good, bad, raw, low, high, mean, scale, logistic((x - mean) / scale, y), prior)


def _featured(rows: DataFrame, dictionaries) -> DataFrame:
    """(doc_id, held_out, x): features of rows of (id, held out, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*dictionaries.value)
        for batch in batches:
            x = [scorer.features(t or b"") for t in batch.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([list(r) for r in x], pa.list_(pa.float64()))], ["doc_id", "held_out", "x"])

    return rows.mapInArrow(work, "doc_id bigint, held_out boolean, x array<double>")


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, rows_per_label: int = 3000) -> DataFrame:
    """(doc_id, held_out, score, predicted, gain) for every row of ``docs``.

    score (0 to 1) is the calibrated probability of label 1, predicted whether it reaches ``threshold``, gain the normalised
    size difference alone. Every whole text is scored: a null or empty one by the sizes of an empty frame, kept
    within the range seen in the calibration. doc_id, lang, source and labels are not inputs of a score. Repeated rows get a row each.
    """
    m = train(docs, labels, rows_per_label)
    rows = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.col("text").cast("string"))
    found = _featured(rows, docs.sparkSession.sparkContext.broadcast((m.good, m.bad, m.raw)))
    if not m.weights.any():
        score = F.lit(m.prior)
    else:
        total = F.lit(float(m.weights[-1]))
        for k in range(N_FEATURES):
            x = F.least(F.greatest(F.col("x")[k], F.lit(float(m.low[k]))), F.lit(float(m.high[k])))
            total = total + (x - float(m.mean[k])) / float(m.scale[k]) * float(m.weights[k])
        score = 1 / (1 + F.exp(-F.least(F.greatest(total, F.lit(-30.0)), F.lit(30.0))))
    return found.select("doc_id", "held_out", score.cast("double").alias("score"), F.col("x")[0].alias("gain")).select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "gain")
