"""The registered queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.llm import oracles
from tessera.llm.common import table


def op1_quality_classifier(spark, sf_dir):
    """Quality of every document, learned from labels outside the held-out quarter. Nulls, ties and repeated rows: see the operator."""
    from tessera.llm.quality import score_quality

    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_best_fit_packing(spark, sf_dir):
    """Every document's pieces in sequences of 1024 tokens. Nulls, ties and repeated rows: see the operator."""
    from tessera.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op3_decontamination(spark, sf_dir):
    """Benchmark windows in every document. Nulls, ties and repeated rows: see the operator."""
    from tessera.llm.decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_line_dedup(spark, sf_dir):
    """Lines of every document that belong to recurring templates. Nulls, ties and repeated rows: see the operator."""
    from tessera.llm.line_templates import report

    return report(table(spark, sf_dir, "documents"))


def op5_simhash_near_dedup(spark, sf_dir):
    """Components of all documents within four bits of each other. Nulls, ties and repeated rows: see the operator."""
    from tessera.llm.near_simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_embedding_near_dedup(spark, sf_dir):
    """Links and components of all vectors of equal label with a cosine of 0.93 or more. Nulls, ties and repeated rows: see the operator."""
    from tessera.llm.near_embeddings import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op7_secret_scan(spark, sf_dir):
    """Secrets in every document. Nulls, ties and repeated rows: see the operator."""
    from tessera.llm.secrets import report

    return report(table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark, sf_dir):
    """Bytes of every document that a string of 200 bytes repeats anywhere. Nulls, ties and repeated rows: see the operator."""
    from tessera.llm.suffix_levels import report

    return report(table(spark, sf_dir, "documents"))


def op9_language_id(spark, sf_dir):
    """Languages of every document. Nulls, ties and repeated rows: see the operator."""
    from tessera.llm.langid import identify

    return identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score", F.array_join("langs", ",").alias("langs"))


def op10_private_data(spark, sf_dir):
    """Personal data in every document. Nulls, ties and repeated rows: see the operator."""
    from tessera.llm.private import report

    return report(table(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    """The five stages of corpus_pipeline over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_ALL = (op1_quality_classifier, op2_best_fit_packing, op3_decontamination, op4_line_dedup, op5_simhash_near_dedup, op6_embedding_near_dedup, op7_secret_scan, op8_suffix_dedup, op9_language_id, op10_private_data, pipeline)


def queries():
    return {f.__name__: f for f in _ALL}


def oracle_sql():
    return oracles.oracle_sql()
