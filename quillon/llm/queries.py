"""The registered queries of this subpackage: (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from quillon.llm import decontaminate, html_blocks, jaccard, langid, lm, packing, quality, secrets, sstable, toxicity
from quillon.llm.common import crc_mod, table
from quillon.llm.sql import SQL  # noqa: F401

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def op1_quality(spark, sf_dir):
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_decontaminate(spark, sf_dir):
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_html_text(spark, sf_dir):
    return html_blocks.extract(table(spark, sf_dir, "pages"))


def op4_secrets(spark, sf_dir):
    return secrets.scan(table(spark, sf_dir, "documents"))


def op5_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = crc_mod(F.col("doc_id"), 5) == 0
    return toxicity.score(docs, toxicity.fit(docs, labels, ~held), held)


def op6_lm_score(spark, sf_dir):
    held = crc_mod(F.col("doc_id"), 10) == 0
    return lm.run(table(spark, sf_dir, "documents"), ~held, held)


def op7_jaccard_join(spark, sf_dir):
    return jaccard.join(table(spark, sf_dir, "documents"))


def op8_langid(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held = crc_mod(F.col("doc_id"), 4) == 2
    return langid.predict(docs, langid.fit(docs, ~held), held)


def op9_sstable(spark, sf_dir):
    return sstable.round_trip(table(spark, sf_dir, "documents"), VOCABULARY, 0)


def op10_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), VOCABULARY, 1)


QUERIES = {f.__name__: f for f in (op1_quality, op2_decontaminate, op3_html_text, op4_secrets, op5_toxicity, op6_lm_score, op7_jaccard_join, op8_langid, op9_sstable, op10_packing)}
