"""Embedding near-dedup by collision counting over one-dimensional projections.

Vectors are projected on many random lines. On every line the values are sorted and a query's window around
its own value is an interval of ranks; a pair's collisions are the lines on which it falls into that interval. Pairs
that collide on as many lines as a pair at the threshold does with the wanted recall are verified by their cosine in double precision.

Counting touches all pairs of a label, whatever its size, in pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb, erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.blocks import block_pairs
from tessera.llm.common import written
from tessera.llm.components import connected_components
from tessera.llm.near_simhash import stars

#: Lines, half width of a window in standard deviations of the difference of two vectors at the threshold, and recall of the count.
LINES, HALF_WIDTH, RECALL = 32, 2.0, 0.9999
#: Vectors of a block. A block travels once for each other block of its label, so large ones shuffle less.
BLOCK = 8192
#: Queries counted at once.
QUERIES = 256


def least_count(lines: int = LINES, half_width: float = HALF_WIDTH, recall: float = RECALL) -> int:
    """The collisions that a pair at the threshold has with probability ``recall`` or more; closer pairs have more."""
    p = erf(half_width / sqrt(2))
    at_least = 0.0
    for k in range(lines, -1, -1):
        at_least += comb(lines, k) * p**k * (1 - p) ** (lines - k)
        if at_least >= recall:
            return k
    return 0


@lru_cache(maxsize=8)
def _lines(dim: int, n: int, what: int) -> np.ndarray:
    return np.random.default_rng((dim, n, what)).normal(size=(dim, n))


def collisions(a: np.ndarray, b: np.ndarray, half_width: float) -> np.ndarray:
    """Number of lines (columns) on which each value of ``b`` is in the window around each value of ``a``."""
    counts = np.zeros((len(a), len(b)), np.uint8)
    for k in range(a.shape[1]):
        order = np.argsort(b[:, k], kind="stable")
        ranks = np.empty(len(b), np.uint16)
        ranks[order] = np.arange(len(b), dtype=np.uint16)
        values = b[order, k]
        low = np.searchsorted(values, a[:, k] - half_width, "left").astype(np.uint16)
        high = np.searchsorted(values, a[:, k] + half_width, "right").astype(np.uint16)
        counts += (ranks[None, :] - low[:, None]) < (high - low)[:, None]  # unsigned: ranks below the window wrap around
    return counts


def _side(lists: pa.ListArray, row: int):
    items = lists[row].values if lists[row].is_valid else None
    if items is None:
        return None
    vectors = items.field("v")
    dim = len(vectors[0])
    return (
        items.field("rep").to_numpy(zero_copy_only=False),
        items.field("n").to_numpy(zero_copy_only=False),
        vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim),
    )


def _pairs(a, b, threshold: float, distance: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of two sides (or of one with itself) whose cosine reaches the threshold."""
    lines = _lines(a[2].shape[1], LINES, 1)
    pa_, pb_ = a[2] @ lines, b[2] @ lines
    least = least_count()
    for at in range(0, len(a[0]), QUERIES):
        hit = collisions(pa_[at : at + QUERIES], pb_, HALF_WIDTH * distance) >= least
        i, j = np.nonzero(hit)
        i += at
        if a is b:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), 100_000):
            x, y = i[k : k + 100_000], j[k : k + 100_000]
            close = np.einsum("ij,ij->i", a[2][x], b[2][y]) >= threshold
            yield x[close], y[close]


def near_vectors(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding, label).

    Two vectors are linked if their labels are equal and not null and their cosine is ``threshold`` or more. Vectors that are null, empty,
    zero or hold null or non-finite components, and rows without a vec_id, link with nothing; so do vectors of
    different lengths. Equal vectors of a label are one class, linked among themselves; only classes are compared.
    A dense group never comes as pairs: each block comparison returns a count and one link for each class. Other columns are not read.
    """
    clean = "transform(cast(embedding as array<double>), x -> x + 0D)"
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label"), F.expr(clean).alias("v"))
    ok = "vec_id is not null and label is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x != 0)"
    rows = written(rows.select("*", F.coalesce(F.expr(ok), F.lit(False)).alias("ok"), F.xxhash64("v").alias("h1"), F.xxhash64("v", F.lit(1)).alias("h2")), "vectors")
    usable = rows.where("ok")
    classes = usable.groupBy("label", "h1", "h2", "v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    classes = written(classes, "classes")
    distance = sqrt(2 - 2 * threshold)

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for v in batch.column(2).to_pylist():
                v = np.array(v)
                v = v / np.abs(v).max()
                v /= sqrt(v @ v)
                made.append(v.tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.list_(pa.float64()))], ["rep", "n", "v"])

    unit = classes.select("rep", "n", "v").mapInArrow(units, "rep bigint, n bigint, v array<double>")
    unit = unit.join(classes.select("rep", "label"), "rep").withColumn("dim", F.size("v"))
    pairs = block_pairs(unit, ["label", "dim"], F.struct("rep", "n", "v"), F.xxhash64("rep"), BLOCK)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                a, b = _side(batch.column(0), row), _side(batch.column(1), row)
                b = a if b is None else b
                ids, sizes = (a[0], a[1]) if a is b else (np.concatenate((a[0], b[0])), np.concatenate((a[1], b[1])))
                shift = 0 if a is b else len(a[0])
                links, root_a, root_b = np.zeros(len(ids), np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
                for x, y in _pairs(a, b, threshold, distance):
                    np.add.at(links, x, sizes[y + shift])
                    np.add.at(links, y + shift, sizes[x])
                    root_a, root_b = stars(np.concatenate((root_a, ids[x])), np.concatenate((root_b, ids[y + shift])))
                to = dict(zip(root_a.tolist(), root_b.tolist(), strict=True))
                found = np.flatnonzero(links)
                nodes = ids[found]
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(links[found]), pa.array([to.get(i, i) for i in nodes.tolist()], pa.int64())], ["node", "links", "to"])

    found = written(pairs.select("a", "b").repartition(F.xxhash64(F.col("a")[0]["rep"], F.col("b")[0]["rep"])).mapInArrow(compare, "node bigint, links bigint, to bigint"), "links")
    comps = connected_components(found.select("node", "to"), "node", "to")
    sums = found.groupBy("node").agg(F.sum("links").alias("more"))
    ends = classes.select("label", "h1", "h2", "rep", "n").join(sums, F.col("rep") == sums["node"], "left").drop("node")
    ends = ends.join(comps, F.col("rep") == comps["node"], "left").select("label", "h1", "h2", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("total"), F.coalesce("component", "rep").alias("component"))
    linked = usable.select("vec_id", "label", "h1", "h2").join(ends, ["label", "h1", "h2"]).select("vec_id", F.col("total").alias("n_links"), F.col("component").alias("component_id"))
    alone = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
