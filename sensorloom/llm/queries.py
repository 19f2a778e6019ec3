"""Queries of the training-data operators that belong to this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.llm.leakage import LeakRule, leak_report, leaked_items
from sensorloom.llm.nearest_time import match_frames
from sensorloom.llm.score_cutoff import kept_items, score_cutoffs
from sensorloom.llm.split import split_corpus
from sensorloom.llm.split_overlap import cross_split_overlap, found_pairs, overlap_of_classes, overlap_report
from sensorloom.llm.tokenize import encode_corpus, roundtrip_report
from sensorloom.session import table


def _overlap(spark: SparkSession, d: str) -> DataFrame:
    return cross_split_overlap(table(spark, d, "split_frames"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return found_pairs(_overlap(spark, d))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap_report(_overlap(spark, d))


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every record of a split with its class of equal records and the number of overlaps of its class."""
    pairs, members = overlap_of_classes(table(spark, d, "split_frames"))
    links = pairs.select("eval_id", "train_id").distinct()
    links = links.select(F.explode(F.array("eval_id", "train_id")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("links"))
    return members.join(links, "class_id", "left").select("rec_id", "class_id", F.coalesce("links", F.lit(0).cast("bigint")).alias("links"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    cutoffs, items = score_cutoffs(table(spark, d, "per_frame"), table(spark, d, "recordings"))
    return kept_items(cutoffs, items).select(F.col("source").alias("seq"), F.col("item").alias("name"))


def p3_cutoffs(spark: SparkSession, d: str) -> DataFrame:
    cutoffs, items = score_cutoffs(table(spark, d, "per_frame"), table(spark, d, "recordings"))
    kept = kept_items(cutoffs, items).groupBy("source").agg(F.count("*").alias("kept"))
    return cutoffs.join(kept, "source").select(F.col("source").alias("seq"), "n", "need", "kept", "cutoff", F.round(F.col("loss") + 2e-9, 6).alias("loss"))


def p3_passes(spark: SparkSession, d: str) -> DataFrame:
    """How many cutting-plane passes each recording took."""
    cutoffs, _ = score_cutoffs(table(spark, d, "per_frame"), table(spark, d, "recordings"))
    return cutoffs.select(F.col("source").alias("seq"), "n", "passes")


def _matches(spark: SparkSession, d: str) -> DataFrame:
    return match_frames(table(spark, d, "frame_record"), table(spark, d, "pose_track"), table(spark, d, "imu_track"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _matches(spark, d).select("frame_id", "clock", "line")


def p4_offsets(spark: SparkSession, d: str) -> DataFrame:
    return _matches(spark, d).groupBy("clock").agg(F.count("*").alias("matched"), F.max("distance_us").alias("worst_us"), F.sum("distance_us").alias("total_us"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(table(spark, d, "documents"))


def p6_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return roundtrip_report(table(spark, d, "documents"))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id")


def p7_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Leaks in any order, with the share of the item that the document covers."""
    hits = leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"), rule=LeakRule(ordered=False))
    return hits.select("doc_id", "item_id", F.round("span", 4).alias("span"), F.round("coverage", 4).alias("coverage"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return leak_report(_leaks(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return split_corpus(table(spark, d, "documents"), with_text=False).where("piece = 0").select("doc_id")


def p8_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_corpus(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_classes, p1_report, p3_found, p3_cutoffs, p3_passes, p4_found, p4_offsets, p6_ids, p6_roundtrip, p7_found, p7_coverage, p7_report, p8_found, p8_pieces)}
