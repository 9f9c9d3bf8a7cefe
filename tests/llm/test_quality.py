import math

import numpy as np
import zstandard as z

from tessera.llm import quality as m
from tessera.llm.queries import queries


def test_held_out_accuracy(spark, sf_dir):
    docs_dir = sf_dir.replace("sf0.001", "sf0.01")
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{docs_dir}/labels.parquet").collect()}
    rows = queries()["op1_quality_classifier"](spark, docs_dir).collect()
    assert len(rows) == spark.read.parquet(f"{docs_dir}/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    held = [(r["predicted"], label[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in label]
    assert np.mean([a == b for a, b in held]) > 0.93


def test_calibration():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 1))
    y = (rng.random(4000) < 1 / (1 + np.exp(-(2 * x[:, 0] - 1)))).astype(float)
    w = m.logistic(x, y, ridge=0)
    assert abs(w[0] - 2) < 0.25 and abs(w[1] + 1) < 0.2


def test_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(2, 1, 0), (4, 1, 0), (4, 1, 0), (6, 0, 0), (5, 0, 0), (5, 1, 0), (7, None, 0), (None, 1, 0), (99, 0, 1)], "doc_id long, quality int, toxic int")
    rows = m.score_quality(odd, labels).collect()
    assert len(rows) == odd.count() and all(r["score"] is not None and 0 <= r["score"] <= 1 for r in rows)
    assert m.score_quality(empty, labels).count() == 0
    assert {r["score"] for r in m.score_quality(odd, labels.where("false")).collect()} == {0.5}
    assert m.score_quality(odd, labels.where("quality = 1")).count() == odd.count()


def slow_score(text, model):
    """The score of one text, a fresh compressor for every piece."""
    kind = z.DICT_TYPE_RAWCONTENT if model.raw else z.DICT_TYPE_FULLDICT

    def size(piece, content):
        own = {"dict_data": z.ZstdCompressionDict(content, dict_type=kind)} if content else {}
        return len(z.ZstdCompressor(level=3, write_content_size=False, write_dict_id=False, write_checksum=False, **own).compress(piece))

    raw = (text or "").encode()
    pieces = [raw[i : i + 256] for i in range(0, len(raw), 256)] or [b""]
    good, bad = [size(p, model.good) for p in pieces], [size(p, model.bad) for p in pieces]
    each = [(b - g) / (b + g) for g, b in zip(good, bad, strict=True)]
    x = [(sum(bad) - sum(good)) / (sum(bad) + sum(good)), min(each), max(each), sum(good) / max(len(raw), 1), sum(bad) / max(len(raw), 1), size(raw, None) / max(len(raw), 1)]
    total = model.weights[-1]
    for k in range(6):
        total += (min(max(x[k], model.low[k]), model.high[k]) - model.mean[k]) / model.scale[k] * model.weights[k]
    return 1 / (1 + math.exp(-min(max(total, -30), 30)))


def test_scores_against_brute_force(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/{t}.parquet") for t in ("documents", "labels"))
    model = m.train(docs, labels)
    some = docs.where("doc_id < 60").unionByName(spark.createDataFrame([(-1, None), (-2, "")], "doc_id long, text string"), allowMissingColumns=True)
    found = m._featured(some.select("doc_id", m.held_out().alias("held_out"), "text"), spark.sparkContext.broadcast((model.good, model.bad, model.raw)))
    assert found.count() == some.count()
    got = {r["doc_id"]: r["score"] for r in m.score_quality(docs, labels).where("doc_id < 60").collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.where("doc_id < 60").collect()}
    assert got and all(abs(got[i] - slow_score(texts[i], model)) < 1e-9 for i in got)


def test_repeated_ids_are_sampled_once(spark):
    rows = [(i, f"some {'good' if i % 2 else 'bad'} words number {i} and more of them") for i in range(40)] + [(1, f"text {k}") for k in range(5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    a, b = (m.train(docs.repartition(n), labels) for n in (3, 11))
    assert a.good == b.good and a.bad == b.bad and len(a.good) < 10_000
