"""Language ID by multilingual mixture inference.

A document's character trigrams are drawn from a mixture of languages. Expectation-maximisation estimates the
proportions from the trigrams' likelihoods in each language; languages leave the mixture one by one as long as
that lowers the penalised likelihood (BIC) least, and the set with the best value stands.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import held_out, share_of

#: Trigrams fall into so many cells.
CELLS = 1 << 16
#: Expectation-maximisation ends once no proportion changes by more than this in a step.
SETTLED = 1e-4


@lru_cache(maxsize=1)
def _folds() -> np.ndarray:
    """For every code point: itself if it's a letter, else 32."""
    return np.array([i if chr(i).isalpha() else 32 for i in range(0x110000)], np.uint32)


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(cells, counts) of the trigrams of the lower-cased text's letters; runs of anything else count as one space."""
    if not text:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    x = _folds()[np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")]
    x = np.concatenate(([32], x, [32])).astype(np.uint64)
    x = x[(x != 32) | (np.concatenate(([0], x[:-1])) != 32)]
    if len(x) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    h = (x[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (x[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (x[2:] * np.uint64(0x165667B19E3779F9))
    h = ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(48)
    counts = np.bincount(h.astype(np.int64), minlength=0)
    cells = np.flatnonzero(counts)
    return cells, counts[cells]


def train(docs: DataFrame, rows_per_lang: int = 2000) -> tuple[list[str], np.ndarray]:
    """(languages, log-likelihood of each cell in each language).

    Learns from text and non-null lang of rows outside the held-out quarter only: of about ``rows_per_lang`` rows of each
    language, chosen by a hash of doc_id. Only cell counts reach the driver: CELLS a language at most.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return [], np.zeros((CELLS, 0))
    langs = sorted(sizes)
    share = F.element_at(F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, rows_per_lang / sizes[k])))]), F.col("lang"))
    some = known.where(F.col("lang").isin(langs)).where(F.pmod(F.xxhash64("doc_id", F.lit("lang")), F.lit(1 << 30)) < share * (1 << 30))

    place = {x: i for i, x in enumerate(langs)}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[int, np.ndarray] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                cells, counts = trigrams(text)
                if len(cells):
                    sums.setdefault(place[lang], np.zeros(CELLS, np.int64))[cells] += counts
            for at, total in sums.items():
                cells = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), at, np.int32)), pa.array(cells.astype(np.int32)), pa.array(total[cells])], ["lang", "cell", "n"])

    rows = some.select("lang", "text").mapInArrow(work, "lang int, cell int, n bigint").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    table = np.full((CELLS, len(langs)), 0.05)
    table[rows.column("cell").to_numpy(), rows.column("lang").to_numpy()] += rows.column("n").to_numpy()
    return langs, np.log(table / table.sum(axis=0))


def mixture(counts: np.ndarray, likes: np.ndarray) -> tuple[np.ndarray, float]:
    """(proportions, log-likelihood) by expectation-maximisation; ``likes`` holds each cell's likelihoods in each language."""
    share = np.full(likes.shape[1], 1 / likes.shape[1])
    weight = counts / counts.sum()
    while len(share) > 1:
        new = share * ((weight / (likes @ share)) @ likes)
        moved, share = np.abs(new - share).max(), new / new.sum()
        if moved < SETTLED:
            break
    return share, float(counts @ np.log(likes @ share))


def infer(text: str | None, langs: list[str], table: np.ndarray) -> tuple[str, float, list[str], list[float]]:
    """(main language, score, languages, proportions). ``und`` with score 0 for a text that is null or has no letter."""
    cells, counts = trigrams(text)
    if not len(cells) or not langs:
        return "und", 0.0, [], []
    logs = table[cells]
    peak = logs.max(axis=1)
    likes = np.exp(logs - peak[:, None])
    counts = counts.astype(float)
    total = counts.sum()
    share, best = mixture(counts, likes)
    use = np.flatnonzero(share * total >= 1)  # a language of less than one trigram can't pay for itself
    if len(use) < len(share):
        use = use if len(use) else np.array([share.argmax()])
        share, best = mixture(counts, likes[:, use])
    penalty = np.log(total) / 2
    while len(use) > 1:
        keep = np.delete(np.arange(len(use)), share.argmin())
        less, like = mixture(counts, likes[:, use[keep]])
        if like - penalty * (len(keep) - 1) < best - penalty * (len(use) - 1):
            break
        use, share, best = use[keep], less, like
    order = np.argsort(-share, kind="stable")
    names, parts = [langs[use[i]] for i in order], [float(share[i]) for i in order]
    rest = np.delete(np.arange(len(langs)), use[order[0]])
    gap = (counts @ (logs[:, use[order[0]]][:, None] - logs[:, rest])).min() if len(rest) else np.inf
    return names[0], parts[0] / (1 + np.exp(-min(max(gap, 0.0), 50.0))), names, parts


def identify(docs: DataFrame, rows_per_lang: int = 2000, learn_from: DataFrame | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, langs, proportions) for every row of ``docs``.

    lang_pred is the language with the largest proportion in the selected set, ``und`` where the text is null or has no
    letter, or where nothing could be learned (no row with a lang). score (0 to 1) is its proportion, lowered where no
    likelihood favours it. lang, source and doc_id are never inputs of a prediction. Repeated rows and rows with a null doc_id get
    their own results; other columns are not read. Every trigram counts as often as it occurs, so proportions don't depend on a
    text's length.
    """
    langs, table = train(docs if learn_from is None else learn_from, rows_per_lang)
    model = docs.sparkSession.sparkContext.broadcast((langs, table))  # CELLS numbers a language

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, table = model.value
        for batch in batches:
            got = [infer(t, langs, table) for t in batch.column(2).to_pylist()]
            columns = [pa.array(c, t) for c, t in zip(zip(*got, strict=True), (pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.float64())), strict=True)] if got else [pa.array([], pa.string()), pa.array([], pa.float64()), pa.array([], pa.list_(pa.string())), pa.array([], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "held_out", "lang_pred", "score", "langs", "proportions"])

    rows = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(work, "doc_id bigint, held_out boolean, lang_pred string, score double, langs array<string>, proportions array<double>")


def drop_unidentified(docs: DataFrame, least: float = 0.3, rows_per_lang: int = 2000) -> DataFrame:
    """``docs`` without the rows whose language can't be told: null or letterless texts, and scores under ``least``. Same columns.

    Where no language could be learned (no row with a lang outside the held-out quarter), every text with a letter stays.
    """
    langs, table = train(docs, rows_per_lang)
    model = docs.sparkSession.sparkContext.broadcast((langs, table))
    place = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, table = model.value
        for batch in batches:
            texts = batch.column(place).cast(pa.string()).to_pylist()
            if not langs:
                yield batch.filter(pa.array([len(trigrams(t)[0]) > 0 for t in texts], pa.bool_()))
                continue
            found = [infer(t, langs, table) for t in texts]
            yield batch.filter(pa.array([lang != "und" and score >= least for lang, score, _, _ in found], pa.bool_()))

    return docs.mapInArrow(work, docs.schema)
