"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barograph.llm import (
    centroids, decontamination, jaccard, lm, negatives, neighbours, packing, quality, setsketch, sharding, substrings, toxicity)
from barograph.llm.common import table
from barograph.llm.oracles import ORACLES


def op1_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_pivot_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"), size=4, percent=85)


def op4_classifier_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.chain(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeated_bytes(table(spark, sf_dir, "documents")).drop("kept")


def op6_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op7_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op8_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeated_passages(table(spark, sf_dir, "documents")).drop("kept", "rest")


def op9_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op10_column_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_coordinate_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(table(spark, sf_dir, "embeddings"))


def op12_equal_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op13_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.classes(table(spark, sf_dir, "documents"), size=5, percent=85)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_spaced_seeds, op2_boosted_trees, op3_pivot_regions, op4_classifier_chain, op5_suffix_array, op6_sampled_splitters, op7_posting_lists, op8_suffix_tree, op9_deleted_interpolation,
                                     op10_column_generation, op11_coordinate_pruning, op12_equal_average, op13_setsketch)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
