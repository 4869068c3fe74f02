"""The corpus pipeline: five stages, each one operator of ``kontor.llm``.

Stage functions take ``(spark, docs, sf_dir)`` and return a DataFrame; all but
the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from kontor.llm import language_id as lid
from kontor.llm import mixing, packing, pii, simhash
from kontor.llm.common import saved, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
MIN_SHARE = 0.5
SAMPLE_SHARE = 0.65  # of the tokens, in expectation

ORACLE_SQL = None


def language(spark, docs, sf_dir):
    """Documents whose language is undetermined, or has under half of the text, go."""
    labelled = docs.select("doc_id", "text", "lang").where("lang IS NOT NULL")
    found = lid.identify(docs.select(*COLUMNS), lid.learn(labelled))
    return found.where((F.col("lang_pred") != lid.UNDETERMINED) & (F.col("score") >= MIN_SHARE)).select(*COLUMNS)


def near_duplicates(spark, docs, sf_dir):
    """One document of each group of near copies stays, the one with the smallest id.

    Texts that share that id and the group are told apart by their hashes.
    Rows without an id cannot be told apart and all stay.
    """
    docs = docs.select(*COLUMNS)
    leads = simhash.grouped(docs, marked=True).where("doc_id = component_id")
    kept = leads.groupBy("cluster").agg(F.min(F.struct("print", "doc_id", "mark")).alias("lead")).select(
        "lead.doc_id", F.col("lead.mark").alias("mark_"))
    named = (docs.where("doc_id IS NOT NULL").withColumn("mark_", F.xxhash64("text"))
             .join(kept, ["doc_id", "mark_"], "left_semi").dropDuplicates(["doc_id", "mark_"]))
    return named.select(*COLUMNS).unionByName(docs.where("doc_id IS NULL"))


def personal_data(spark, docs, sf_dir):
    """Personal data is masked; n_chars follows the text."""
    return pii.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def mixture(spark, docs, sf_dir):
    """A stated share of the tokens is sampled in the raked proportions; rare cells stay whole."""
    return mixing.sample(docs.select(*COLUMNS), share=SAMPLE_SHARE)


def pack(spark, docs, sf_dir):
    """The pieces of the documents and their places in sequences."""
    return packing.best_fit_packing(docs)


STAGES = [("language_id", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data),
          ("mixture", mixture), ("packing", pack)]


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = saved(docs, name)
    return docs
