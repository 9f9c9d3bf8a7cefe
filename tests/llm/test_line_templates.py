import hashlib
import random
import re
from collections import defaultdict

import duckdb
import pytest

from tessera.llm import line_templates as m


def by_sql(rows):
    c = duckdb.connect()
    c.execute("create table docs (doc_id bigint, text varchar)")
    c.executemany("insert into docs values (?, ?)", rows)
    return {r[0]: r[1:] for r in c.execute(m.SQL.format(docs="docs")).fetchall()}


def by_spark(spark, rows):
    got = m.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    return {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in got}


def masked(line):
    return re.sub("[0-9]+", "0", line)


def brute(rows, least=10, share=0.6):
    """Straight from the words of the docstring: sets of texts for every line, leaf, token and template."""
    texts = {t for _, t in rows if t is not None}
    having = defaultdict(set)
    for t in texts:
        for line in t.split("\n"):
            if masked(line).strip(" "):
                having[masked(line)].add(t)

    def leaves(line):
        k = line.split(" ")
        out = [("all", len(k), *k[:3])]
        return out + [(f"wild {i}", len(k), *[x for j, x in enumerate(k[:3]) if j != i]) for i in range(3)] if len(k) >= 3 else out

    support = defaultdict(set)
    for line, ts in having.items():
        for leaf in leaves(line):
            support[leaf] |= ts
    quarter = defaultdict(set)

    def quarters(line):
        k = line.split(" ")
        n = len(k) - 3
        cuts = [-(-n * j // 4) for j in range(5)]
        return [(len(k), j, *k[3 + cuts[j] : 3 + cuts[j + 1]]) for j in range(4) if cuts[j + 1] > cuts[j]] if n > 0 else [(len(k),)]

    for line, ts in having.items():
        for q in quarters(line):
            quarter[q] |= ts
    home = {}
    for line in having:
        if len(having[line]) < least and all(len(quarter[q]) < least for q in quarters(line)):
            continue
        known = [x for x in leaves(line) if len(support[x]) >= least]
        if known:
            home[line] = known[0] if known[0][0] == "all" else max(known, key=lambda x: (len(support[x]), -int(x[0][-1])))
    tokens = defaultdict(set)
    for line, leaf in home.items():
        for i, x in enumerate(line.split(" ")):
            tokens[leaf, i, x] |= having[line]
    form, users = {}, defaultdict(set)
    for line, leaf in home.items():
        made = tuple(x if len(tokens[leaf, i, x]) >= least else None for i, x in enumerate(line.split(" ")))
        if sum(x is not None for x in made) >= share * len(made):
            form[line] = leaf, made
            users[leaf, made] |= having[line]
    gone = {line for line, f in form.items() if len(users[f]) >= least}
    out = {}
    for i, t in rows:
        lines = [] if t is None else t.split("\n")
        kept = [x for x in lines if masked(x) not in gone]
        out[i] = len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()
    return out


def word(i):
    return "".join(chr(97 + i // 26**k % 26) for k in range(4))


def test_against_brute_force_and_sql(spark):
    rows = []
    for i in range(60):
        own = f"body of document number {word(i)} goes on with {word(i * 7)} and {word(i * 11)}"
        rows.append((i, "\n".join([f"head {word(i)[:2]} {i // 26 * 'x'}", own, f"Released under license {i}.0 by user{word(i % 20)} today", "", own, "tail 7", f"end {own}"])))
    rows += [(100 + i, f"copied first line here\ncopied second line here\ncopied third {'a' if i else 'b'}") for i in range(30)]
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, "Released under license 3.0 by userq today")]
    rows += [(300 + i, f"{word(i)} posted in the main office\nuser {word(i % 9)} posted in the main office\n{word(i)} {word(i)} posted\nx  y") for i in range(40)]
    got = by_spark(spark, rows)
    assert got == brute(rows) == by_sql(rows)
    assert got[0][1] >= 2 and got[203][1] == 1, "boilerplate goes, whatever its variable fields hold"
    assert got[105][1] == 0, "copies of a whole document are one voice"
    assert got[305][1] == 3


def test_tables_against_brute_force_and_sql(spark, sf_dir):
    for d in (sf_dir, sf_dir.replace("sf0.001", "sf0.01")):
        rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
        assert by_spark(spark, rows) == brute(rows) == by_sql(rows)


def test_lines_of_one_document_do_not_recur(spark):
    rows = [(0, "\n".join(f"session opened for user {word(k)} from the main office" for k in range(40)))] + [(i, f"another text {word(i)}") for i in range(1, 31)]
    assert by_spark(spark, rows)[0][1] == 0


def test_blocks_go_whole(spark):
    rows = [(i, f"{word(i)} {word(3 * i)}\nThis is the footer of the page\nAll rights are reserved here\nContact the office for details") for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(500)]
    assert all(x[1] == 3 for x in by_spark(spark, rows).values()), "copies don't shield them"


@pytest.mark.parametrize("form", ["{} user logged in from the main office", "user {} logged in from the main office", "the user {} logged in from the main office", "the user logged {} in from the main office"])
def test_a_word_field_anywhere(spark, form):
    rows = [(i, f"{form.format(word(i))}") for i in range(60)]
    assert all(x[1] == 1 for x in by_spark(spark, rows).values())
    got = m.templates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r["template"], r["n_docs"]) for r in got] == [(form.format("<*>"), 60)]


def test_no_python_in_plan(spark, sf_dir):
    plan = m.drop_recurring(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_odd_rows(odd, empty):
    out = m.drop_recurring(odd)
    assert out.columns == odd.columns
    assert sorted(map(str, out.collect())) == sorted(map(str, odd.collect()))
    assert m.drop_recurring(empty).count() == 0


def test_columns_with_clashing_names(spark):
    rows = [(1 if i < 5 else i, f"own {word(i)}\nshared line of five words", i, "c", "d") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, line_count string, line_drops string")
    out = m.drop_recurring(docs, "n_chars")
    assert sorted(map(tuple, out.collect())) == sorted((r[0], r[1].split("\n")[0], 8, "c", "d") for r in rows), "texts under one id are cut each by itself"
    assert out.schema == docs.schema
    assert m.drop_recurring(docs.drop("n_chars"), "n_chars").columns == ["doc_id", "text", "line_count", "line_drops"]


@pytest.mark.parametrize("copies", [9, 10])
def test_threshold(spark, copies):
    rows = [(i, f"shared line of five\nown {word(i)} text {word(5 * i)} {word(7 * i)}") for i in range(copies)]
    assert by_spark(spark, rows)[0][1] == (copies == 10)


def whole_rule(rows, least=10, share=0.6):
    """The lines that go, without regard to where a template's variable fields are."""
    lines = defaultdict(set)
    for t in {t for _, t in rows if t is not None}:
        for line in t.split("\n"):
            lines[masked(line)].add(t)
    lines = {x: ts for x, ts in lines.items() if x.strip(" ")}

    def reach(line):
        k = line.split(" ")
        return [(at, len(k), *(k[:3] if at == 0 else [x for j, x in enumerate(k[:3]) if j != at - 1])) for at in range(4 if len(k) >= 3 else 1)]

    support, having, users, form = defaultdict(set), defaultdict(set), defaultdict(set), {}
    for line, ts in lines.items():
        for leaf in reach(line):
            support[leaf] |= ts
    home = {x: max(found, key=lambda leaf: (leaf[0] == 0, len(support[leaf]), -leaf[0])) for x in lines if (found := [leaf for leaf in reach(x) if len(support[leaf]) >= least])}
    for line, leaf in home.items():
        for at, token in enumerate(line.split(" ")):
            having[leaf, at, token] |= lines[line]
    for line, leaf in home.items():
        made = tuple(token if len(having[leaf, at, token]) >= least else None for at, token in enumerate(line.split(" ")))
        if sum(x is not None for x in made) / len(made) >= share:
            form[line] = leaf, made
            users[leaf, made] |= lines[line]
    return {line for line, f in form.items() if len(users[f]) >= least}


@pytest.mark.parametrize("hot", [m.HOT_DOCS, 15])
def test_variable_fields_anywhere_after_the_leading_tokens(spark, monkeypatch, hot):
    monkeypatch.setattr(m, "HOT_DOCS", hot)
    form = "the server said {0} logged in from {1} office with code {2} and left {3} again".format
    rows = [(i, form(word(i), word(3 * i), word(5 * i), word(7 * i)) + f"\nown line {word(i)} of {word(11 * i)} it has {word(i % 7)}") for i in range(60)]
    rows += [(100 + i, form("root", word(3 * i), "seven", word(7 * i)) + f"\n{form('root', 'main', 'seven', 'them')}\nthe server said {word(i)} {word(2 * i)} {word(3 * i)}") for i in range(30)]
    rows += [(200 + i, rows[i % 3][1]) for i in range(40)] + [(300, "\n".join(rows[0][1].split("\n") * 20)), (301, None), (302, "")]
    gone = whole_rule(rows)
    got = by_spark(spark, rows)
    for i, t in rows:
        lines = [] if t is None else t.split("\n")
        kept = [x for x in lines if masked(x) not in gone]
        assert got[i] == (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    assert got[0][1] >= 1 and got[100][1] >= 2, "four fields, one in each quarter of the line"


def every_leaf(rows, least=10, share=0.6):
    """The lines that go if a line is judged in every leaf that it reaches, and in a leaf with a wildcard also without the lines that have a better one."""
    lines = defaultdict(set)
    for t in {t for _, t in rows if t is not None}:
        for line in t.split("\n"):
            if masked(line).strip(" "):
                lines[masked(line)].add(t)

    def reach(line):
        k = line.split(" ")
        return [(at, len(k), *(k[:3] if at == 0 else [x for j, x in enumerate(k[:3]) if j != at - 1])) for at in range(4 if len(k) >= 3 else 1)]

    reached = defaultdict(set)
    for line in lines:
        for leaf in reach(line):
            reached[leaf].add(line)
    support = {leaf: len(set().union(*(lines[x] for x in found))) for leaf, found in reached.items()}
    members = {leaf: found for leaf, found in reached.items() if support[leaf] >= least}
    for line in lines:
        own = [leaf for leaf in reach(line) if leaf in members]
        if own:
            members.setdefault(("own", max(own, key=lambda leaf: (leaf[0] == 0, support[leaf], -leaf[0]))), set()).add(line)
    gone = set()
    for found in members.values():
        having, users, form = defaultdict(set), defaultdict(set), {}
        for line in found:
            for place in enumerate(line.split(" ")):
                having[place] |= lines[line]
        for line in found:
            form[line] = tuple(token if len(having[at, token]) >= least else None for at, token in enumerate(line.split(" ")))
            users[form[line]] |= lines[line]
        gone |= {line for line, made in form.items() if sum(x is not None for x in made) / len(made) >= share and len(users[made]) >= least}
    return gone


def kept_by(rows, gone):
    cut = {i: ([] if t is None else t.split("\n"), [] if t is None else [x for x in t.split("\n") if masked(x) not in gone]) for i, t in rows}
    return {i: (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()) for i, (lines, kept) in cut.items()}


def test_a_larger_leaf_does_not_shield_a_template(spark):
    rows = [(i, f"own {word(i)}\nhost {word(i)} went down for the whole long night") for i in range(12)]
    # each host has more company by its name, where nothing else recurs, than by that line
    rows += [(100 + 20 * i + j, "host " + " ".join([word(i), *(word(k * j + i) for k in range(1, 14, 2))])) for i in range(12) for j in range(14)]
    got = by_spark(spark, rows)
    assert got == kept_by(rows, every_leaf(rows))
    assert all(got[i][1] == (i < 12) for i in got)
    listed = m.templates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [tuple(r) for r in listed] == [("host <*> went down for the whole long night", 12)]


@pytest.mark.parametrize("seed", range(2))
def test_mixed_lines_against_every_leaf(spark, monkeypatch, seed):
    monkeypatch.setattr(m, "HOT_DOCS", 40)
    draw = random.Random(seed)
    rows = [(i, "\n".join(" ".join(draw.choices("abcdef", [9, 6, 4, 2, 1, 1], k=draw.choice([2, 3, 5, 7, 8]))) for _ in range(3))) for i in range(400)]
    gone = every_leaf(rows)
    assert by_spark(spark, rows) == kept_by(rows, gone)
    assert whole_rule(rows) < gone, "nothing that goes by one leaf alone stays"


def broadcasts(plan):
    """The text of a plan below each of its broadcasts."""
    lines = plan.split("\n")
    depth = [re.search(r"[A-Za-z]", re.sub(r"\*\(\d+\)", "    ", line)) for line in lines]
    depth = [d.start() if d else 0 for d in depth]
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            yield "\n".join(lines[i + 1 : end])


def test_repeated_rows_are_not_broadcast(spark, monkeypatch):
    """Spark takes exploded rows for as large as the file they come from, so their number has no limit in the driver."""
    plans, real = [], m.written

    def written(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return real(df, name)

    monkeypatch.setattr(m, "written", written)
    rows = [(i, f"alpha beta gamma w{'abcdefghijkl'[i]} delta epsilon\nthe same line again\nown{'abcdefghijkl'[i]} x") for i in range(12)]
    out = m.report(spark.createDataFrame(rows, "doc_id long, text string"))
    plans.append(("report", out._jdf.queryExecution().executedPlan().toString()))
    seen = [(name, below) for name, plan in plans for below in broadcasts(plan)]
    assert any("bit_or" in below for _, below in seen)  # filters of a fixed size
    assert not [name for name, below in seen if "Generate" in below.split("Exchange hashpartitioning")[0]]
    assert sorted((r["n_lines"], r["n_dropped"]) for r in out.collect()) == [(3, 2)] * 12
