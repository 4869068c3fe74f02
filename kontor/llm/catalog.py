"""Registered queries of the training-data operators and the corpus pipeline."""

from __future__ import annotations

from kontor.llm import licenses, mixing, pii, url_filter
from kontor.llm.common import table
from kontor.llm.embedding_dups import embedding_duplicates
from kontor.llm.language_id import language_id
from kontor.llm.packing import best_fit_packing
from kontor.llm.quality import quality
from kontor.llm.simhash import simhash
from kontor.llm.spelling import spelling_variants
from kontor.llm.suffix_dedup import suffix_dedup
from kontor.llm.token_alignment import token_alignment
from kontor.llm.toxicity import toxicity


def op1_language_id(spark, sf_dir):
    return language_id(table(spark, sf_dir, "documents"))


def op2_url_filter(spark, sf_dir):
    rules = spark.sql(f"SELECT * FROM VALUES {url_filter.RULES_SQL} AS rules(host, path, verdict)")
    return url_filter.url_filter(table(spark, sf_dir, "pages"), rules)


def op3_toxicity(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_pii(spark, sf_dir):
    return pii.digest(pii.pii_spans(table(spark, sf_dir, "documents")))


def op5_quality(spark, sf_dir):
    return quality(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark, sf_dir):
    return suffix_dedup(table(spark, sf_dir, "documents"))


def op7_embedding_dups(spark, sf_dir):
    return embedding_duplicates(table(spark, sf_dir, "embeddings"))


def op8_packing(spark, sf_dir):
    return best_fit_packing(table(spark, sf_dir, "documents"))


def op9_simhash(spark, sf_dir):
    return simhash(table(spark, sf_dir, "documents"))


def op10_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op11_token_alignment(spark, sf_dir):
    return token_alignment(table(spark, sf_dir, "documents"))


def op12_license_scan(spark, sf_dir):
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark, sf_dir):
    return spelling_variants(table(spark, sf_dir, "documents"))


def queries():
    import corpus_pipeline

    return {
        "op1_language_id": op1_language_id,
        "op2_url_filter": op2_url_filter,
        "op3_toxicity": op3_toxicity,
        "op4_pii": op4_pii,
        "op5_quality": op5_quality,
        "op6_suffix_dedup": op6_suffix_dedup,
        "op7_embedding_dups": op7_embedding_dups,
        "op8_packing": op8_packing,
        "op9_simhash": op9_simhash,
        "op10_mixing": op10_mixing,
        "op11_token_alignment": op11_token_alignment,
        "op12_license_scan": op12_license_scan,
        "op13_spelling_variants": op13_spelling_variants,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql():
    return {
        "op2_url_filter": url_filter.ORACLE,
        "op10_mixing": mixing.oracle(),
        "op12_license_scan": licenses.oracle(),
    }
