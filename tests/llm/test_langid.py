import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import langid as m
from tessera.llm.queries import queries


def test_held_out_accuracy(spark, sf_dir):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries()["op9_language_id"](spark, sf_dir).collect()
    assert len(rows) == len(lang) and all(0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.95


def test_mixture_is_found():
    rng = np.random.default_rng(0)
    table = np.log(rng.dirichlet(np.full(400, 0.1), 3).T + 1e-9)
    cells = np.concatenate((rng.choice(400, 600, p=np.exp(table[:, 0]) / np.exp(table[:, 0]).sum()), rng.choice(400, 300, p=np.exp(table[:, 1]) / np.exp(table[:, 1]).sum())))
    counts = np.bincount(cells, minlength=400).astype(float)
    share, _ = m.mixture(counts, np.exp(table))
    assert abs(share[0] - 2 / 3) < 0.05 and share[2] < 0.02


def test_two_languages(spark):
    rows = [(i, "the cat and the dog went with this and that there" if i % 2 else "der hund und die katze gehen nicht mit auf ein", "en" if i % 2 else "de") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    test = spark.createDataFrame([(1000, "the dog and the cat with that dog there. " * 6 + "die katze und der hund gehen nicht. " * 3, None), (1001, "12 + 7", "en"), (1002, None, "en")], docs.schema)
    got = {r["doc_id"]: r for r in m.identify(test, learn_from=docs).collect()}
    assert got[1000]["langs"] == ["en", "de"] and 0.5 < got[1000]["proportions"][0] < 0.85
    assert got[1001]["lang_pred"] == got[1002]["lang_pred"] == "und" and got[1002]["score"] == 0


@pytest.mark.parametrize("share", [0.6, 0.7, 0.8])
def test_proportions_do_not_depend_on_length(spark, sf_dir, share):
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    langs, table = m.train(docs)
    texts = {x: "\n".join(r["text"] for r in docs.where(f"lang = '{x}' and text is not null").orderBy("doc_id").limit(100).collect()) for x in langs}
    for other in ("es", "fr", "de"):
        for size in (1000, 10_000, 100_000, 300_000, 1_000_000):
            parts = [(texts[x] * (n // len(texts[x]) + 1))[:n] for x, n in (("en", int(size * share)), (other, int(size * (1 - share))))]
            lang, _, names, shares = m.infer("\n".join(parts), langs, table)
            assert lang == "en" and abs(dict(zip(names, shares, strict=True))["en"] - share) < 0.1, (other, size)


def test_odd_rows(odd, empty):
    rows = m.identify(odd).collect()
    assert len(rows) == odd.count() and {r["lang_pred"] for r in rows if r["doc_id"] in (1, 2, 3)} == {"und"}
    assert m.identify(empty).count() == 0
    assert {r["lang_pred"] for r in m.identify(odd, learn_from=empty).collect()} == {"und"}


def test_nothing_learned_keeps_texts_with_letters(odd):
    kept = m.drop_unidentified(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["4", "4", "5", "6", "7", "None"]


def test_more_than_500_languages(spark):
    docs = spark.range(2400).selectExpr("id as doc_id", "concat('some words ', id % 600) as text", "concat('l', id % 600) as lang")
    known = docs.where(~m.held_out()).select("lang").distinct().count()
    assert known > 500 and len(m.train(docs)[0]) == known


def slow_trigrams(text):
    """Counts by cell: letters in lower case, everything else one space."""
    letters = "".join(c if c.isalpha() else " " for c in text.lower())
    letters = " " + " ".join(letters.split()) + " "
    out = {}
    for a, b, c in zip(letters, letters[1:], letters[2:]):
        h = (ord(a) * 0x9E3779B97F4A7C15 ^ ord(b) * 0xC2B2AE3D27D4EB4F ^ ord(c) * 0x165667B19E3779F9) & (1 << 64) - 1
        h = (sum((x & (1 << 64) - 1) for x in [h ^ h >> 29]) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1) >> 48
        out[h] = out.get(h, 0) + 1
    return out


def slow_infer(text, langs, table):
    """Expectation-maximisation and the choice of languages in plain loops."""
    counts = slow_trigrams(text) if text and any(c.isalpha() for c in text) else {}
    if not counts:
        return "und", [], []
    total = sum(counts.values())

    def settle(use):
        share = [1 / len(use)] * len(use)
        while True:
            new = [0.0] * len(use)
            for cell, n in counts.items():
                parts = [s * math.exp(table[cell][k]) for s, k in zip(share, use, strict=True)]
                for i, p in enumerate(parts):
                    new[i] += n * p / sum(parts) / total
            moved = max(abs(a - b) for a, b in zip(new, share, strict=True))
            share = new
            if moved < m.SETTLED or len(use) == 1:
                break
        like = sum(n * math.log(sum(s * math.exp(table[cell][k]) for s, k in zip(share, use, strict=True))) for cell, n in counts.items())
        return share, like

    use = list(range(len(langs)))
    share, best = settle(use)
    some = [k for k in use if share[k] * total >= 1] or [max(use, key=lambda k: share[k])]
    if some != use:
        use = some
        share, best = settle(use)
    while len(use) > 1:
        less = [k for i, k in enumerate(use) if i != share.index(min(share))]
        new, like = settle(less)
        if like - math.log(total) / 2 * len(less) + math.log(total) / 2 * len(use) < best:
            break
        use, share, best = less, new, like
    order = sorted(range(len(use)), key=lambda i: -share[i])
    return langs[use[order[0]]], [langs[use[i]] for i in order], [share[i] for i in order]


def test_inference_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    langs, table = m.train(docs)
    rows = docs.where("doc_id < 40").collect()
    texts = [(r["text"] or "")[:1500] for r in rows] + [None, "", "12", "a", " ".join((r["text"] or "")[:300] for r in rows[:6])]
    for text in texts:
        lang, score, names, shares = m.infer(text, langs, table)
        want, slow_names, slow_shares = slow_infer(text, langs, table)
        assert (lang, names) == (want, slow_names) and np.allclose(shares, slow_shares, atol=1e-6) and 0 <= score <= 1
