"""The registered queries of the training-data operators, and SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, exact_dedup, fingerprints, langid, lm, packing, pii, simhash, token_files, toxicity
from .common import table


def queries():
    return {
        "op1_packing": lambda spark, d: packing.pack(table(spark, d, "documents")),
        "op2_byte_bpe": lambda spark, d: bpe.round_trip(table(spark, d, "documents")),
        "op3_pii": lambda spark, d: pii.report(table(spark, d, "documents")),
        "op4_toxicity": lambda spark, d: toxicity.score(table(spark, d, "documents"), table(spark, d, "labels")),
        "op5_language_model": lambda spark, d: lm.score(table(spark, d, "documents")),
        "op6_language": lambda spark, d: langid.identify(table(spark, d, "documents")),
        "op10_token_files": lambda spark, d: token_files.write_and_read(table(spark, d, "documents")),
        "op7_exact_dedup": lambda spark, d: exact_dedup.exact_dedup(table(spark, d, "documents")),
        "op8_simhash": lambda spark, d: simhash.near_duplicates(table(spark, d, "documents")),
        "op9_fingerprints": lambda spark, d: fingerprints.edited_likeness(table(spark, d, "documents")),
    }


def oracle_sql():
    return {"op7_exact_dedup": exact_dedup.ORACLE}
