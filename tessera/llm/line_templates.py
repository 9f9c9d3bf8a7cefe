"""Line dedup with a log-template tree of fixed depth. DataFrame functions only.

A line goes down the tree by its number of tokens and its three leading tokens, with numbers masked. Where too few documents share
the three, one of them may be a wildcard. In the leaf that a line reaches, a token that few documents have at its position is a
variable field. What remains is the line's template; lines whose template recurs across documents are dropped. A common start may have a
leaf of its own with too few lines of a template that recurs beside it, so a line is judged in every leaf that it reaches. Ordinary sentences
reach common leaves too, the more the larger the corpus is, so lines are dealt by leaf as text and fall into tokens only where these are counted.

"Documents" are different texts everywhere: equal texts are one voice, so copies of a whole document don't make its lines recur. That is
near-dedup's work. Texts are split and masked once; later steps shuffle hashes, and once each different line that shares a leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written

#: Different texts in which a template, a leaf of the tree, and a constant token of a leaf must be found.
MIN_DOCS = 10
#: Least share of constant tokens in a template.
CONSTANT = 0.6
VARIABLE = "<*>"
#: Parts of the lines of one leaf, template or text when they meet a table with a row for each: a hot one isn't one task.
SALTS = 32
#: Bits of a broadcast filter: 65,536 words, 1 MB as a table.
BITS = 1 << 22
#: A leaf of so many texts isn't counted in one task.
HOT_DOCS = 10_000
#: Bytes of compressed lines whose tokens one task counts.
TASK_BYTES = 2 << 20
#: A score above that of any leaf with a wildcard.
_FULL = 1 << 60
#: Most leaves in which one line is judged.
_HOMES = 4


def _lines(docs: DataFrame) -> DataFrame:
    """(doc, t, line, h, leaves, m) for every line that isn't blank: t a hash of the text, m the masked line, h its hash.

    leaves are the hashes of the leaves a line can reach: by all three leading tokens, or with the first, second or third as a wildcard
    (lines of three tokens or more).
    """
    text = F.col("text").cast("string")
    arrays = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64(text).alias("t"), F.split(F.regexp_replace(text, "[0-9]+", "0"), "\n", -1).alias("all"))
    rows = arrays.where("all is not null").select("doc", "t", F.posexplode("all").alias("line", "m")).where(F.trim("m") != "")
    n = F.length("m") - F.length(F.replace("m", F.lit(" "), F.lit(""))) + 1
    rows = rows.select("*", n.alias("n"), F.split("m", " ", 4).alias("lead"))
    token = [F.get("lead", F.lit(i)) for i in range(3)]
    leaves = [F.xxhash64(F.lit(0), "n", *token)] + [F.when(F.col("n") >= 3, F.xxhash64(F.lit(i + 1), "n", *token[:i], *token[i + 1 :])) for i in range(3)]
    return rows.select("doc", "t", "line", F.xxhash64("m").alias("h"), F.array(*leaves).alias("leaves"), "m")


def _tokens(members: DataFrame, *keep: str) -> DataFrame:
    """(keep, n, key, at, token) for every token of m: n the number of tokens, key a hash of leaf, place and token."""
    rows = members.withColumn("words", F.split("m", " ", -1)).select(*{*keep, "leaf"}, F.size("words").alias("n"), F.posexplode("words").alias("at", "token"))
    return rows.select(*keep, "n", F.xxhash64("leaf", "at", "token").alias("key"), "at", "token")


def _tasks(df: DataFrame, times: int) -> int:
    """Tasks for ``times`` the rows of ``df``, which is read from files: the session's number, more if one would have over TASK_BYTES."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) * times
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // TASK_BYTES)


def _at_home(members: DataFrame) -> DataFrame:
    """``members`` with one row for each of their homes: kind, leaf and hot instead of homes."""
    return members.withColumn("home", F.explode("homes")).select("h", "home.kind", "home.leaf", "often", "home.hot", "ts", "m")


def _known(members: DataFrame) -> DataFrame:
    """key of each constant token: one of a line that recurs as it is, or one that MIN_DOCS different texts have in their leaf.

    Lines of one leaf meet in one task, as text; only those of leaves of HOT_DOCS texts or more are shuffled token by token.
    """

    def counted(rows: DataFrame, *by: str) -> DataFrame:
        pairs = _tokens(rows, "leaf", "ts").select(*by, F.explode("ts").alias("t")).distinct()
        return pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") >= MIN_DOCS).select("key")

    rows = _at_home(members)
    other = rows.where("not often")
    cold = other.where("not hot").select("leaf", "ts", "m").repartition(_tasks(members, _HOMES), "leaf")
    return _tokens(rows.where("often"), "leaf").select("key").unionByName(counted(cold, "leaf", "key")).unionByName(counted(other.where("hot"), "key")).distinct()


def _voices(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, n_docs) for each key that MIN_DOCS different texts t have. Counted in two steps, so that a hot key meets as partial counts."""
    return rows.select(*keys, "t").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") >= MIN_DOCS)


def _salted(small: DataFrame) -> DataFrame:
    """``small`` once for each salt, to be joined by a shuffle: Spark sizes it as if it weren't repeated and would broadcast SALTS times its limit."""
    return small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")


def _salt(of: str) -> Column:
    return F.pmod(F.xxhash64(of, F.lit("salt")), F.lit(SALTS)).cast("int")


def _marked(rows: DataFrame, key: str, known: DataFrame) -> DataFrame:
    """``rows`` with _may: false where the hash ``key`` is surely not among those of ``known``. Without a shuffle of ``rows``.

    A table of BITS bits is broadcast, as 64-bit words, however many keys there are; with very many of them more rows are marked.
    """
    place = f"pmod({key}, {BITS}L)"
    words = known.select(F.expr(f"cast({place} div 64 as int)").alias("_word"), F.expr(f"shiftleft(1L, cast({place} % 64 as int))").alias("bit")).groupBy("_word").agg(F.bit_or("bit").alias("_bits"))
    placed = rows.withColumn("_word", F.expr(f"cast({place} div 64 as int)")).join(F.broadcast(words), "_word", "left")
    return placed.withColumn("_may", F.expr(f"coalesce((shiftright(_bits, cast({place} % 64 as int)) & 1L) = 1L, false)")).drop("_word", "_bits")


def _maybe(rows: DataFrame, key: str, known: DataFrame) -> DataFrame:
    """The rows whose hash ``key`` may be among those of ``known``, and few others."""
    return _marked(rows, key, known).where("_may").drop("_may")


def _without(rows: DataFrame, key: str, known: DataFrame) -> DataFrame:
    """The rows whose hash ``key`` isn't among those of ``known``. Only marked rows are shuffled, those of one key by their text t."""
    marked = _marked(rows, key, known)
    sought = marked.where("_may").withColumn("salt", _salt("t")).join(_salted(known.select(key)), [key, "salt"], "left_anti")
    return marked.where("not _may").drop("_may").unionByName(sought.select(rows.columns))


def recurring_lines(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lines as of ``_lines``, their members of leaves, one (h, leaf, template, n_docs) for each of the lines to be dropped).

    template is a hash, of several the one that most texts have; a line that recurs as it is has its own hash as template.
    """
    lines = written(_lines(docs), "lines")
    often = written(_voices(lines, "h"), "often")
    reach = lines.select("h", "t", F.posexplode("leaves").alias("at", "leaf")).where("leaf is not null")
    leaves = written(_voices(reach, "leaf"), "leaves")
    found = _maybe(reach.select("h", "at", "leaf"), "leaf", leaves).distinct().withColumn("salt", _salt("h"))
    # homes of a line: every leaf that it reaches; and, where its best leaf has a wildcard, that leaf once more with only the lines whose best it
    # is. Best is the leaf by all three tokens, else the one that most documents share
    score = F.when(F.col("at") == 0, F.lit(_FULL)).otherwise(F.col("n_docs") * 4 + 3 - F.col("at"))
    reached = F.struct(score.alias("score"), F.col("at").alias("kind"), "leaf", (F.col("n_docs") >= HOT_DOCS).alias("hot"))
    chosen = found.join(_salted(leaves), ["leaf", "salt"]).groupBy("h").agg(F.array_sort(F.collect_list(reached)).alias("homes")).withColumn("best", F.element_at("homes", -1))
    alone = F.struct(F.lit(_HOMES).alias("kind"), F.xxhash64(F.lit(_HOMES), "best.leaf").alias("leaf"), F.col("best.hot").alias("hot"))
    homes = F.transform("homes", lambda x: F.struct(x["kind"].alias("kind"), x["leaf"].alias("leaf"), x["hot"].alias("hot")))
    chosen = chosen.select("h", F.when(F.col("best.kind") == 0, homes).otherwise(F.concat(homes, F.array(alone))).alias("homes"))
    chosen = written(chosen.join(often.hint("merge"), "h", "left_anti"), "chosen")
    # one row for each line; the fewer than MIN_DOCS texts of one that doesn't recur as it is are with it. Tables of lines are joined by a shuffle, as
    # the lines of ``rows`` lie by h already: files are some ten times smaller than the rows that a broadcast holds
    homes = F.filter(F.transform("leaves", lambda x, i: F.struct(i.alias("kind"), x.alias("leaf"), F.lit(False).alias("hot"))), lambda x: x["leaf"].isNotNull())
    same = _maybe(lines, "h", often).groupBy("h").agg(F.first("leaves").alias("leaves"), F.first("m").alias("m")).join(often.hint("merge"), "h")
    same = same.select("h", homes.alias("homes"), F.lit(True).alias("often"), F.lit(None).cast("array<bigint>").alias("ts"), "m")
    other = _without(_maybe(lines.select("h", "t", "m"), "h", chosen), "h", often)
    other = other.groupBy("h").agg(F.collect_set("t").alias("ts"), F.first("m").alias("m")).join(chosen.hint("merge"), "h")
    other = other.select("h", "homes", F.lit(False).alias("often"), "ts", "m")
    members = written(same.unionByName(other), "members")
    known = written(_known(members), "known")
    # lines with too few constants, told by a filter that may only take a variable field for a constant, need no exact look
    members = _at_home(members)
    alive = _maybe(_tokens(members.where("not often"), "h", "leaf").select("h", "leaf", "n", "key"), "key", known).groupBy("h", "leaf", "n").agg(F.count(F.lit(1)).alias("constants"))
    alive = written(alive.where(F.col("constants") / F.col("n") >= CONSTANT).select("h", "leaf"), "alive")
    rare = written(members.where("not often").join(alive, ["h", "leaf"], "left_semi"), "rare")
    tokens = _tokens(rare, "h", "leaf").withColumn("salt", _salt("h"))
    needed = _maybe(known, "key", tokens.select("key")).withColumn("known", F.lit(True))
    placed = tokens.join(_salted(needed), ["key", "salt"], "left")
    part = F.xxhash64("at", F.when(F.col("known"), F.xxhash64("token")))  # a variable field hashes as its position alone
    forms = placed.groupBy("leaf", "h").agg(F.bit_xor(part).alias("template"), F.avg(F.coalesce(F.col("known").cast("int"), F.lit(0))).alias("constant"))
    forms = written(forms.where(F.col("constant") >= CONSTANT).select("h", "leaf", "template"), "forms")
    recurring = _voices(rare.select("h", "leaf", F.explode("ts").alias("t")).hint("merge").join(forms, ["h", "leaf"]), "leaf", "template")
    variable = forms.withColumn("salt", _salt("h")).join(_salted(recurring), ["leaf", "template", "salt"])
    variable = variable.groupBy("h").agg(F.max(F.struct("n_docs", "leaf", "template")).alias("most")).select("h", "most.leaf", "most.template", "most.n_docs")
    as_is = often.join(members.where("often and kind = 0").select("h", "leaf").hint("merge"), "h").select("h", "leaf", F.col("h").alias("template"), "n_docs")
    return lines, members, written(as_is.unionByName(variable), "templates")


def templates(docs: DataFrame) -> DataFrame:
    """(template, n_docs): the recurring templates as text, with VARIABLE for fields and 0 for numbers, and the number of different texts."""
    _, members, dropped = recurring_lines(docs)
    groups = dropped.groupBy("leaf", "template", "n_docs").agg(F.min("h").alias("h"))
    one = members.join(groups, ["leaf", "h"]).groupBy("leaf", "template", "n_docs", "h").agg(F.first("m").alias("m"))
    lines = dropped.join(members, ["leaf", "h"]).select("leaf", "template", "n_docs", F.posexplode(F.split("m", " ", -1)).alias("at", "token"))
    fields = lines.groupBy("leaf", "template", "n_docs", "at").agg((F.min("token") != F.max("token")).alias("varies"))
    tokens = one.select("leaf", "template", "n_docs", F.posexplode(F.split("m", " ", -1)).alias("at", "token")).join(fields, ["leaf", "template", "n_docs", "at"])
    listed = F.array_sort(F.collect_list(F.struct("at", F.when(F.col("varies"), VARIABLE).otherwise(F.col("token")).alias("token"))))
    return tokens.groupBy("leaf", "template", "n_docs").agg(listed.alias("tokens")).select(F.array_join("tokens.token", " ").alias("template"), "n_docs")


def _cut(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns _ld_all (its lines) and _ld_drop (places of those to be dropped, null for none)."""
    lines, _, dropped = recurring_lines(docs)
    seen = _maybe(lines.select("doc", "t", "line", "h"), "h", dropped).withColumn("salt", F.pmod(F.xxhash64("doc", "t"), F.lit(SALTS)).cast("int"))
    found = seen.join(_salted(dropped.select("h")), ["h", "salt"]).groupBy("doc", "t").agg(F.collect_set("line").alias("_ld_drop"))
    found = found.withColumnsRenamed({"doc": "_ld_doc", "t": "_ld_t"})
    text = F.col("text").cast("string")
    keyed = docs.withColumn("_ld_key", F.xxhash64(text))
    same = (F.col("_ld_key") == F.col("_ld_t")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_ld_doc"))
    return keyed.join(found, same, "left").withColumn("_ld_all", F.split(text, "\n", -1)).drop("_ld_doc", "_ld_t", "_ld_key")


def drop_recurring(docs: DataFrame, length_column: str | None = None) -> DataFrame:
    """``docs`` with the lines of recurring templates removed from text. Same columns.

    A template recurs if MIN_DOCS different texts or more have a line of it, however often one of them repeats it; equal texts count once.
    At least CONSTANT of its tokens and two of the first three are constants, wherever the others are. A constant is a token that MIN_DOCS
    different texts have at its place, in the lines of as many tokens that share the leading ones; all choices of these are tried.
    Numbers never tell lines apart. Blank lines are no templates and stay. A null text stays null, an empty one is one blank line, a text whose
    lines all go becomes empty and keeps its row. Rows with the same doc_id, or with none, are cut by their own texts; repeated rows all
    stay. Other columns pass through, but ``length_column``, if there is one of that name, gets the new length of a text that was cut.
    """
    out = _cut(docs)
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("_ld_all") - 1), F.col("_ld_drop")), lambda i: F.get(F.col("_ld_all"), i))
    out = out.withColumn("_ld_text", F.when(F.col("_ld_drop").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))
    if length_column in docs.columns:
        new = F.length("_ld_text").cast(docs.schema[length_column].dataType)
        out = out.withColumn(length_column, F.when(F.col("_ld_drop").isNull(), F.col(length_column)).otherwise(new))
    return out.withColumn("text", F.col("_ld_text")).select(docs.columns)


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256): counts, and a digest of the text that stays (of the empty text for null)."""
    out = _cut(docs.select("doc_id", "text"))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("_ld_all") - 1), F.col("_ld_drop")), lambda i: F.get(F.col("_ld_all"), i))
    text = F.when(F.col("_ld_drop").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(kept, "\n"))
    counts = [F.when(F.col(c).isNull(), 0).otherwise(F.size(c)).cast("long") for c in ("_ld_all", "_ld_drop")]
    return out.select("doc_id", counts[0].alias("n_lines"), counts[1].alias("n_dropped"), F.sha2(text, 256).alias("kept_sha256"))


#: DuckDB for ``report``; {docs} names the relation.
SQL = f"""
WITH texts AS (SELECT row_number() OVER () AS t, text FROM (SELECT DISTINCT text FROM {{docs}} WHERE text IS NOT NULL)),
placed AS (SELECT t, unnest(string_split(regexp_replace(text, '[0-9]+', '0', 'g'), chr(10))) AS m FROM texts),
lines AS (SELECT DISTINCT t, m, string_split(m, ' ') AS k FROM placed WHERE trim(m, ' ') <> ''),
reach AS (
    SELECT t, m, 0 AS wild, [len(k)::varchar, k[1], k[2], k[3]] AS leaf FROM lines
    UNION ALL SELECT t, m, 1, [len(k)::varchar, k[2], k[3]] FROM lines WHERE len(k) >= 3
    UNION ALL SELECT t, m, 2, [len(k)::varchar, k[1], k[3]] FROM lines WHERE len(k) >= 3
    UNION ALL SELECT t, m, 3, [len(k)::varchar, k[1], k[2]] FROM lines WHERE len(k) >= 3),
quarters AS (SELECT t, m, len(k) AS n, j, k[4 + ceil((len(k) - 3) * j / 4)::int : 3 + ceil((len(k) - 3) * (j + 1) / 4)::int] AS q FROM lines, range(4) r(j) WHERE len(k) > 3
    UNION ALL SELECT t, m, len(k), 0, NULL FROM lines WHERE len(k) <= 3),
again AS (SELECT n, j, q FROM quarters WHERE q IS NULL OR len(q) > 0 GROUP BY ALL HAVING count(DISTINCT t) >= {MIN_DOCS}),
alive AS (SELECT DISTINCT m FROM quarters JOIN again ON quarters.n = again.n AND quarters.j = again.j AND quarters.q IS NOT DISTINCT FROM again.q
    UNION SELECT m FROM lines GROUP BY m HAVING count(DISTINCT t) >= {MIN_DOCS}),
leaves AS (SELECT wild, leaf, count(DISTINCT t) AS n_docs FROM reach GROUP BY ALL HAVING count(DISTINCT t) >= {MIN_DOCS}),
chosen AS (SELECT DISTINCT ON (m) m, wild, leaf FROM reach JOIN leaves USING (wild, leaf) SEMI JOIN alive USING (m) ORDER BY m, CASE WHEN wild = 0 THEN 0 ELSE 1 END, n_docs DESC, wild),
tokens AS (SELECT t, m, wild, leaf, unnest(range(1, len(k) + 1)) AS i, unnest(k) AS token FROM lines JOIN chosen USING (m)),
constants AS (SELECT wild, leaf, i, token FROM tokens GROUP BY ALL HAVING count(DISTINCT t) >= {MIN_DOCS}),
forms AS (SELECT m, wild, leaf, list(CASE WHEN known THEN token END ORDER BY i) AS template, avg(known::int) AS constant
    FROM (SELECT DISTINCT k.m, k.wild, k.leaf, k.i, k.token, c.i IS NOT NULL AS known FROM tokens k LEFT JOIN constants c USING (wild, leaf, i, token)) GROUP BY m, wild, leaf),
recurring AS (SELECT wild, leaf, template FROM forms JOIN lines USING (m) WHERE constant >= {CONSTANT} GROUP BY ALL HAVING count(DISTINCT t) >= {MIN_DOCS}),
gone AS (SELECT DISTINCT m FROM forms JOIN recurring USING (wild, leaf, template)),
cut AS (SELECT text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i, unnest(string_split(text, chr(10))) AS line FROM texts),
marked AS (SELECT text, i, line, g.m IS NOT NULL AS drop FROM cut LEFT JOIN gone g ON regexp_replace(cut.line, '[0-9]+', '0', 'g') = g.m),
kept AS (SELECT text, count(*) AS n_lines, count(*) FILTER (WHERE drop) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT drop), '') AS body FROM marked GROUP BY text)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_dropped, 0) AS n_dropped, sha256(coalesce(k.body, '')) AS kept_sha256 FROM {{docs}} d LEFT JOIN kept k USING (text)
"""
