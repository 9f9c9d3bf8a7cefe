import pytest

import corpus_pipeline as p
from tests.llm.test_decontaminate import slow as contaminated
from tests.llm.test_near_simhash import jaccard
from tests.llm.test_packing import check


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    out["documents"] = {r["doc_id"]: r for r in docs.collect()}
    for name, stage in p.STAGES:
        docs = p.written(stage(spark, docs, sf_dir), name)
        rows = docs.collect()
        out[name] = rows if name == "packing" else {r["doc_id"]: r for r in rows}
        assert name == "packing" or (len(rows) == len(out[name]) and set(docs.columns) == {"doc_id", "text", "lang", "source", "n_chars"})
    return out


def test_order():
    assert [n for n, _ in p.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "decontamination", "packing"]


def test_language_stage_keeps_what_it_can_tell(stages):
    before, after = stages["documents"], stages["language_id"]
    assert all(after[i] == before[i] for i in after) and len(after) >= 0.97 * len(before)
    assert all(any(c.isalpha() for c in r["text"]) for r in after.values())


def test_line_stage_only_takes_lines(stages):
    before, after = stages["language_id"], stages["line_dedup"]
    assert set(before) == set(after)
    for i, r in after.items():
        lines = iter(before[i]["text"].split("\n"))
        assert all(line in lines for line in r["text"].split("\n")) or r["text"] == ""


def test_near_dedup_stage(stages):
    before, kept = {i: r["text"] for i, r in stages["line_dedup"].items()}, stages["simhash_near_dedup"]
    ids = sorted(before)
    near = {(a, b): x for k, a in enumerate(ids) for b in ids[k + 1 :] if (x := jaccard(before[a], before[b])) > 0.5}
    assert all(kept[i]["text"] == before[i] for i in kept)
    assert not [p for p, x in near.items() if x >= 0.93 and p[0] in kept and p[1] in kept], "one of two near copies goes"
    assert all(any(i in p and x > 0.6 for p, x in near.items()) for i in before if i not in kept), "and nothing else"


def test_decontamination_stage(spark, sf_dir, stages):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    found = contaminated([(i, r["text"]) for i, r in stages["simhash_near_dedup"].items()], items)
    assert set(stages["decontamination"]) == {i for i, x in found.items() if not x[4]}


def test_packing_stage(stages):
    check(stages["packing"], {i: r["text"] for i, r in stages["decontamination"].items()})


def test_run(spark, sf_dir, stages):
    assert p.run(spark, sf_dir).count() == len(stages["packing"])


def test_odd_rows(spark, odd, empty, sf_dir):
    for docs in (odd, empty):
        for name, stage in p.STAGES[:-1]:
            docs = stage(spark, docs, sf_dir)
            assert docs.columns == odd.columns
        p.packing(spark, docs, sf_dir).count()


def test_line_stage_takes_templates_with_a_field_in_each_quarter(spark):
    word = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(4))
    rows = [(i, f"the server said {word(i)} logged in from {word(3 * i)} office with code {word(5 * i)} and left {word(7 * i)} again\n\n{word(7 * i)}", "en", "a", 9) for i in range(60)]
    out = p.line_dedup(spark, spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"), "").collect()
    assert {r["doc_id"]: r["text"] for r in out} == {i: f"\n{word(7 * i)}" for i in range(60)}


def test_line_stage_takes_templates_that_have_less_company_than_a_value_of_their_field(spark):
    word = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(4))
    rows = [(i, f"host {word(i)} went down for the whole long night\n{word(3 * i)}") for i in range(12)]
    rows += [(100 + 20 * i + j, "host " + " ".join([word(i), *(word(k * j + i) for k in range(1, 14, 2))])) for i in range(12) for j in range(14)]
    docs = spark.createDataFrame([(*r, "en", "a", 9) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert {r["doc_id"]: r["text"] for r in p.line_dedup(spark, docs, "").collect()} == {i: t.split("\n")[-1] for i, t in rows}
