"""DuckDB SQL for the queries that SQL can express, written from their rules rather than from the operators."""

from __future__ import annotations

from tessera.llm import line_templates, secrets

_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

DECONTAMINATION = f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
wins AS (SELECT DISTINCT id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM
    (SELECT id, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
docs AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
places AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM
    (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM wins))),
hits AS (SELECT DISTINCT doc_id, id, i, k FROM places JOIN wins USING (k, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY 1),
found AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, id FROM hits) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(found.n, 0) AS BIGINT) AS n_items,
    sha256(coalesce(found.ids, '')) AS items_sha256, coalesce(words.n, 0) > 0 AND 20 * coalesce(words.n, 0) >= len(d.w) AS contaminated
FROM docs d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
"""

EMBEDDINGS = """
WITH RECURSIVE ok AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.93),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
comps AS (SELECT a AS vec_id, min(b) AS c FROM reach GROUP BY 1),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY 1)
SELECT e.vec_id, CAST(coalesce(counts.n, 0) AS BIGINT) AS n_links, comps.c AS component_id, comps.c = e.vec_id AS kept
FROM embeddings e JOIN comps USING (vec_id) LEFT JOIN counts USING (vec_id)
"""


def _secrets() -> str:
    def any_case(word: str) -> str:
        return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)

    keys = "|".join(any_case(w) for w in ("password", "passwd", "secret", "token", "api")) + "_?" + any_case("key")
    assign = f"({keys})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
    patterns = {"assign": assign, "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+", "entropy": "[A-Za-z0-9+/_=-]{20,}"}
    kept = {"assign": f"length(regexp_extract(s, '{assign}', 2)) >= 6", "access": "length(s) >= 20", "hex": "length(s) >= 24", "entropy": "true"}
    found = " UNION ALL ".join(
        f"""SELECT doc_id, {n} AS rank, '{k}' AS kind, s, length(array_to_string(p[1:i], '')) + length(array_to_string(m[1:i - 1], '')) AS start FROM
        (SELECT doc_id, m, p, unnest(m) AS s, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, '{r}') AS m, string_split_regex(t, '{r}') AS p FROM docs WHERE regexp_matches(t, '{r}'))) WHERE {kept[k]}"""
        for n, (k, r) in enumerate(patterns.items())
    )
    allowed = " OR ".join(f"regexp_matches(s, '{a}')" for a in secrets.ALLOWED)
    w = secrets.WINDOW
    return f"""
    WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    found AS ({found}),
    base AS (SELECT doc_id, rank, kind, start, start + length(s) AS stop FROM found WHERE rank < 3),
    free AS (SELECT doc_id, s, start FROM found f WHERE rank = 3 AND NOT ({allowed}) AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = f.doc_id AND b.start < f.start + length(f.s) AND f.start < b.stop)),
    windows AS (SELECT doc_id, s, start, i, list_aggregate(string_split(s[i:i + {w - 1}], ''), 'entropy') AS h FROM (SELECT doc_id, s, start, unnest(range(1, length(s) - {w} + 2)) AS i FROM free)),
    added AS (SELECT doc_id, 3 AS rank, 'entropy' AS kind, start + min(i) - 1 AS start, start + max(i) + {w - 1} AS stop FROM windows
        WHERE h >= CASE WHEN regexp_full_match(s, '[0-9a-fA-F]+') THEN {secrets.LEAST['hex']} ELSE {secrets.LEAST['base64']} END GROUP BY doc_id, s, windows.start HAVING NOT regexp_matches(s[min(i):max(i) + {w - 1}], '{secrets.PLACEHOLDERS}')),
    texts AS (SELECT doc_id, count(*) FILTER (WHERE rank = 0) AS a, count(*) FILTER (WHERE rank = 1) AS b, count(*) FILTER (WHERE rank = 2) AS c, count(*) FILTER (WHERE rank = 3) AS d,
        string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (WHERE rank < 3) AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans
        FROM (SELECT * FROM base UNION ALL SELECT * FROM added) GROUP BY doc_id)
    SELECT docs.doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, coalesce(d, 0) AS n_entropy, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM docs LEFT JOIN texts USING (doc_id)
    """


def oracle_sql() -> dict[str, str]:
    return {"op3_decontamination": DECONTAMINATION, "op4_line_dedup": line_templates.SQL.format(docs="documents"), "op6_embedding_near_dedup": EMBEDDINGS, "op7_secret_scan": _secrets()}
