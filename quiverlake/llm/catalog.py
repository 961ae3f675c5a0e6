"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bestfit, decontaminate, fill_middle, host_rules, license_rules, ngram_join, secret_index, target_resample, token_cache, token_files, virtual_slots, warc_index, wrapper
from .shared import small_batches


def prepared(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {
    "op1_token_files": prepared(token_files.op1_token_files),
    "op2_decontaminate": prepared(decontaminate.op2_decontaminate),
    "op3_host_rules": prepared(host_rules.op3_host_rules),
    "op4_virtual_slots": prepared(virtual_slots.op4_virtual_slots),
    "op5_token_cache": prepared(token_cache.op5_token_cache),
    "op6_bestfit": prepared(bestfit.op6_bestfit),
    "op7_warc_index": prepared(warc_index.op7_warc_index),
    "op8_wrapper": prepared(wrapper.op8_wrapper),
    "op9_ngram_join": prepared(ngram_join.op9_ngram_join),
    "op10_secret_index": prepared(secret_index.op10_secret_index),
    "op11_target_resample": prepared(target_resample.op11_target_resample),
    "op12_fill_middle": prepared(fill_middle.op12_fill_middle),
    "op13_license_rules": prepared(license_rules.op13_license_rules),
}
ORACLES = {
    "op3_host_rules": host_rules.OP3_SQL,
    "op4_virtual_slots": virtual_slots.OP4_SQL,
    "op7_warc_index": warc_index.OP7_SQL,
    "op9_ngram_join": ngram_join.OP9_SQL,
    "op10_secret_index": secret_index.OP10_SQL,
    "op11_target_resample": target_resample.OP11_SQL,
    "op12_fill_middle": fill_middle.OP12_SQL,
    "op13_license_rules": license_rules.OP13_SQL,
}
