"""Personal data by weak supervision. DataFrame functions only on the data; the models are fitted on counts of bounded size.

Four patterns give the base spans. They and every other number-like or contact-like run of text are candidates, and labelers vote on each: the
base patterns, shapes by regular expression, gazetteers of cue words, given names and places near it, and shapes and words that speak against.
Expectation-maximisation over the counts of vote patterns estimates each labeler's reliability without labels. The resulting soft labels train
the final span classifier, a logistic regression over votes and form; candidates that it accepts are added to the base spans, which always stay.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written
from tessera.llm.native_spans import digest, overlaps, with_blocks, with_spans

#: Base patterns. Possessive, and only at the start of a run or right after a match: the same matches without retries inside a run.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Candidates: runs of digits and separators, and written-out addresses.
NUMBER = r"(?<![A-Za-z0-9._+-])\(?[0-9](?:[\x20()./-]{0,2}[0-9]){6,24}(?![A-Za-z0-9])"
WRITTEN = r"(?<![A-Za-z0-9])[A-Za-z0-9._-]{1,64}\x20?[\[(](?i:at)[\])]\x20?[A-Za-z0-9-]{1,64}\x20?(?:\.|[\[(](?i:dot)[\])])\x20?[A-Za-z]{2,24}"
KINDS = ("email", "ip", "card", "phone", "weak")

#: Words that announce personal data, looked for in the 24 characters before a candidate.
CUES = "phone|tel|telephone|mobile|call|fax|contact|email|e-mail|mail|write to|ssn|social security|passport|iban|account|card|born|dob|teléfono|llame|correo|telefon|anruf|konto|geboren|téléphone|appelez|courriel|compte"
#: Words and signs that announce other numbers.
OTHER = "version|isbn|issn|page|section|chapter|table|figure|license|gpl|no\\\\.|price|total|usd|eur|\\\\$|€|£|#"

#: Common given names and places of the languages that the corpus holds, looked for in the 24 characters before a candidate.
NAMES = "anna|anne|antonio|carlos|carmen|charles|claire|daniel|david|elena|emily|emma|francisco|franz|hans|heinrich|isabel|jack|jacques|james|jane|jean|john|jose|josé|juan|julia|julie|jürgen|karl|klaus|laura|lucia|luis|manuel|marc|maria|marie|mark|martin|mary|michael|michel|miguel|nicolas|olivia|otto|pablo|paul|pedro|peter|philippe|pierre|robert|sarah|sofia|sophie|stefan|susan|thomas|ursula|william|wolfgang"
PLACES = "barcelona|berlin|bogotá|bordeaux|boston|bremen|bruxelles|chicago|dallas|dresden|dublin|frankfurt|genève|hamburg|houston|köln|lima|london|lyon|madrid|málaga|marseille|méxico|miami|münchen|nantes|new york|paris|san francisco|seattle|sevilla|straße|avenue|street|calle|rue|toronto|toulouse|valencia|wien|zürich"

#: Each votes 1 (personal), 0 (not) or -1 (abstains) on a candidate x with its text s, the 24 characters before it and the one after it.
LABELERS = {
    "pattern": "if(x.rank < 4, 1, -1)",
    "shape": r"if(x.s rlike '^\\(?[0-9]{3}\\)?[\\x20./-]{1,2}[0-9]{3}[\\x20./-][0-9]{4}$' or x.s rlike '^[0-9]{3}-[0-9]{2}-[0-9]{4}$' or x.s rlike '(?i)[\\[(]at[\\])]', 1, -1)",
    "international": r"if(x.before rlike '\\+[0-9]{0,3}[\\x20(]*$' or x.s rlike '^00[1-9]', 1, -1)",
    "cue": rf"if(x.before rlike '(?i)(^|[^\\p{{L}}])({CUES})[^\\p{{L}}]{{0,8}}$', 1, -1)",
    "names": rf"if(x.before rlike '(?i)(^|[^\\p{{L}}])({NAMES})([^\\p{{L}}]|$)', 1, -1)",
    "places": rf"if(x.before rlike '(?i)(^|[^\\p{{L}}])({PLACES})([^\\p{{L}}]|$)', 1, -1)",
    "other": rf"if(x.before rlike '(?i)({OTHER})[^\\p{{L}}]{{0,4}}$', 0, -1)",
    "date": r"if(x.s rlike '^(19|20)[0-9]{2}[-/.][0-9]{1,2}[-/.][0-9]{1,2}' or x.s rlike '^[0-9]{1,2}[-/.][0-9]{1,2}[-/.](19|20)[0-9]{2}$', 0, -1)",
    "plain": r"if(x.s rlike '^[0-9]+$', 0, -1)",
}
#: What the classifier sees besides the votes: all of few values, so that counts of them stay small.
FORM = {
    "digits": "cast(least(length(regexp_replace(x.s, '[^0-9]', '')), 16) as int)",
    "separators": "cast(least(length(regexp_replace(x.s, '[0-9]', '')), 4) as int)",
    "sentence_end": "cast(x.after rlike '^[.!?,;]?($|\\\\s)' as int)",
}
#: Share of personal data among candidates from which EM starts, steps, and the score at which a candidate is added.
PRIOR, STEPS, ACCEPT = 0.3, 50, 0.9


def _base(df: DataFrame) -> DataFrame:
    """Adds ``matched``: all base spans as (start, rank, end, kind, from, to, s)."""
    digits = "regexp_replace(x.s, '[^0-9]', '')"
    part = r"length(regexp_replace(p, '^0+', '')) <= 3 and cast(concat('0', right(p, 3)) as int) <= 255"
    luhn = f"""aggregate(sequence(1, length({digits})), 0, (a, i) -> a + if(i % 2 = 1, ascii(substring({digits}, -i, 1)) - 48,
        (2 * (ascii(substring({digits}, -i, 1)) - 48)) % 10 + cast(ascii(substring({digits}, -i, 1)) >= 53 as int))) % 10 = 0"""
    rules = {
        "email": "true",
        "ip": rf"forall(split(x.s, '\\.'), p -> {part})",
        "card": f"if(length({digits}) between 13 and 19, {luhn}, false)",
        "phone": f"length({digits}) between 9 and 15",
    }
    kept = [f"transform(filter({k}, x -> {r}), x -> struct(x.start as start, cast({n} as int) as rank, x.end as end, '{k}' as kind, x.from as from, x.to as to, x.s as s))" for n, (k, r) in enumerate(rules.items())]
    return df.withColumn("matched", F.expr(f"concat({', '.join(kept)})"))


def spans_and_candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, base, candidates): base spans as (start, rank, end, kind), candidates as (start, rank, end, votes, form).

    Candidates are the base spans themselves and the other runs (rank 4) that overlap none of them. What stands around one is cut from the
    bytes of the text, so many candidates in a long text cost no more than their number.
    """
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    df = _base(with_spans(df, "text", {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "number": NUMBER, "written": WRITTEN}))
    df = with_blocks(df, "matched", "_blocks")
    own = "transform(matched, x -> struct(x.rank as rank, x.start as start, x.end as end, x.from as from, x.to as to, x.s as s))"
    rest = f"transform(filter(concat(number, written), x -> not {overlaps('_blocks')}), x -> struct(cast(4 as int) as rank, x.start as start, x.end as end, x.from as from, x.to as to, x.s as s))"
    df = df.select("doc_id", F.expr("transform(matched, x -> struct(x.start as start, x.rank as rank, x.end as end, x.kind as kind))").alias("base"), F.col("text").cast("binary").alias("bytes"), F.expr(f"concat({own}, {rest})").alias("found"))
    seen = """transform(found, x -> struct(x.rank as rank, x.start as start, x.end as end, x.s as s,
        right(cast(substring(bytes, greatest(x.from - 95, 1), least(x.from, 96)) as string), 24) as before, left(cast(substring(bytes, x.to + 1, 8) as string), 2) as after))"""
    df = df.select("doc_id", "base", F.expr(seen).alias("seen"))
    votes = ", ".join(f"cast({v} as int)" for v in LABELERS.values())
    return df.select("doc_id", "base", F.expr(f"transform(seen, x -> struct(x.start as start, x.rank as rank, x.end as end, array({votes}) as votes, array({', '.join(FORM.values())}) as form))").alias("candidates"))


def reliabilities(votes: np.ndarray, counts: np.ndarray, prior: float = PRIOR, steps: int = STEPS) -> tuple[np.ndarray, float, np.ndarray]:
    """(posterior of each vote pattern, share of class 1, [labeler, class, vote 0/1/abstain] probabilities) by expectation-maximisation.

    Starts from labelers that are right four times in five; the counts of a uniform vote keep all probabilities off 0 and 1.
    """
    n = votes.shape[1]
    table = np.empty((n, 2, 3))
    for k in range(n):
        speaks = max(1e-3, min(0.999, counts[votes[:, k] >= 0].sum() / max(counts.sum(), 1)))
        table[k, 1], table[k, 0] = [0.2 * speaks, 0.8 * speaks, 1 - speaks], [0.8 * speaks, 0.2 * speaks, 1 - speaks]
    column = np.where(votes < 0, 2, votes)
    for _ in range(steps):
        logs = np.array([np.log(p) + sum(np.log(table[k, c, column[:, k]]) for k in range(n)) for c, p in ((0, 1 - prior), (1, prior))])
        post = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
        prior = float(np.clip((post @ counts + 1) / (counts.sum() + 2), 1e-4, 1 - 1e-4))
        for k in range(n):
            for c, w in ((0, counts * (1 - post)), (1, counts * post)):
                table[k, c] = (np.bincount(column[:, k], w, 3) + 1) / (w.sum() + 3)
    return post, prior, table


def train(candidates: DataFrame) -> list[float]:
    """Weights of the span classifier (constant last) from the rows' candidates.

    The driver gets one row for each combination of votes and form that occurs: 2**10 vote patterns by 17 x 5 x 2 forms at most.
    """
    each = candidates.select(F.explode("candidates").alias("x")).groupBy("x.votes", "x.form").agg(F.count(F.lit(1)).alias("n"))
    rows = each.orderBy("votes", "form").collect()
    size = len(LABELERS) + len(FORM)
    if not rows:
        return [0.0] * size + [-10.0]
    votes, form, n = np.array([r["votes"] for r in rows]), np.array([r["form"] for r in rows], float), np.array([r["n"] for r in rows], float)
    post, _, _ = reliabilities(votes, n)
    x = np.c_[_signs(votes), form / 10, np.ones(len(rows))]
    w = np.zeros(x.shape[1])
    weight = n / n.sum() * min(n.sum(), 1e6)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(len(w)), x.T @ (weight * (post - p)) - w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def _signs(votes: np.ndarray) -> np.ndarray:
    return np.where(votes < 0, 0.0, np.where(votes == 1, 1.0, -1.0))


def find_private(docs: DataFrame) -> DataFrame:
    """(doc_id, spans array of (start, rank, end, kind)) for every row of ``docs``; rank is the kind's place in KINDS.

    Positions are code points, ends exclusive. Base spans always stay; ``weak`` spans are candidates that overlap none of them and that the
    classifier gives ACCEPT or more and some labeler a vote for. A null text counts as empty; rows with a null doc_id and repeated rows
    get their own results (and count in the training). Other columns are not read. The models are refitted for each table.
    """
    found = written(spans_and_candidates(docs), "candidates")
    w = train(found)
    terms = [f"if(x.votes[{k}] < 0, 0D, if(x.votes[{k}] = 1, 1D, -1D)) * {w[k]!r}D" for k in range(len(LABELERS))]
    terms += [f"x.form[{k}] / 10D * {w[len(LABELERS) + k]!r}D" for k in range(len(FORM))]
    accept = f"array_contains(x.votes, 1) and {' + '.join(terms)} + {w[-1]!r}D >= {float(np.log(ACCEPT / (1 - ACCEPT)))!r}D"
    added = f"transform(filter(candidates, x -> x.rank = 4 and {accept}), x -> struct(x.start as start, cast(4 as int) as rank, x.end as end, 'weak' as kind))"
    return found.select("doc_id", F.expr(f"concat(base, {added})").alias("spans"))


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_weak): counts and a digest of the spans of ``find_private``."""
    found = find_private(docs).withColumn("base", F.expr("filter(spans, x -> x.rank < 4)"))
    counts = [F.expr(f"cast(size(filter(spans, x -> x.rank = {n})) as bigint)").alias(f"n_{k}") for n, k in enumerate(KINDS)]
    return found.select("doc_id", *counts[:4], F.sha2(F.expr(digest("base", "rank start")), 256).alias("base_sha256"), F.expr(digest("spans", "rank start")).alias("spans"), counts[4])
