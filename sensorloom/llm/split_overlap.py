"""Same or near-same records across splits (problem 1).

A record is read as a short text of "words": the capture stamp in its file name and the
quantised words of its pose (three position and two orientation cells). Its n-grams are
(recording, stamp) and (recording, five pose words), kept as 64-bit hashes. Evaluation
records carry the n-grams of every cell their tolerance reaches; training is scanned for
hits by an equi-join on the hash, hits are checked exactly, and per pair the containment
is the share of the evaluation record's n-gram kinds that the training record holds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The tolerances that make two records the same.
MAX_SHIFT_M = 0.02
MAX_TURN_DEG = 1.0


def capture_stamp_ns(name: Column) -> Column:
    """Stamp in a file name as nanoseconds: first digits of its last path part, without padding; up to 16 digits are µs, 17 to 19 ns."""
    base = F.regexp_extract(name, r"([^/\\]*)$", 1)
    digits = F.ltrim(F.regexp_extract(base, r"([0-9]+)", 1), F.lit("0"))
    n = F.length(digits)
    return F.when((n > 0) & (n <= 15), digits.cast("bigint") * 1000).when(n == 16, F.concat(digits, F.lit("000")).try_cast("bigint")).when((n > 16) & (n <= 19), digits.try_cast("bigint"))


def _append_each(own: Column):
    return lambda head: F.transform(own, lambda c: F.concat(head, F.array(c)))


def _cells(values: list[tuple[Column, float]], reach: bool) -> Column:
    """All combinations of the cells (four tolerances wide) that value ± tolerance touches, as arrays."""
    combined = None
    for v, tol in values:
        width = 4 * tol
        low = F.floor((v - tol * 1.000001) / width) if reach else F.floor(v / width)
        high = F.floor((v + tol * 1.000001) / width) if reach else low
        own = F.array_distinct(F.array(low, high))
        if combined is None:
            combined = F.transform(own, lambda c: F.array(c))
        else:
            combined = F.flatten(F.transform(combined, _append_each(own)))
    return combined


def cross_split_overlap(
    df: DataFrame, max_shift_m: float = MAX_SHIFT_M, max_turn_deg: float = MAX_TURN_DEG,
    train: str = "train", evaluation: tuple[str, ...] = ("val", "test"),
) -> DataFrame:
    """Pairs (seq, eval_id, eval_split, train_id, same_stamp, same_pose, containment).

    df needs rec_id, seq, split, rgb_name, tmat. Rows with a null seq, rec_id or split take
    no part; a null name or a tmat that is null, short or not finite leaves only the other
    n-gram; repeated rows count once; an empty table gives none; further columns, whatever
    their names, are dropped. Both sides are partitioned by n-gram hash, so one large
    recording is spread over all tasks and adaptive skew splitting handles one hot n-gram;
    only evaluation records are replicated (7.6 hashes each on average), by a fixed factor.
    """
    turn = 2 * math.sin(math.radians(max_turn_deg) / 2)  # how far a column of the rotation can move
    floats = F.transform(F.slice("tmat", 1, 12), lambda v: v.cast("double"))
    usable = (F.size("tmat") >= 12) & F.forall(floats, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < 1e9))
    rec = df.where(F.col("seq").isNotNull() & F.col("rec_id").isNotNull() & F.col("split").isin(train, *evaluation)).select(
        "rec_id", "seq", "split", capture_stamp_ns(F.col("rgb_name")).alias("stamp"), F.when(usable, floats).alias("m")
    )
    rec = rec.distinct()  # repeated rows would multiply in the join
    m = F.col("m")
    words = [(m[3], max_shift_m), (m[7], max_shift_m), (m[11], max_shift_m), (m[0], turn), (m[4], turn)]

    def grams(side: DataFrame, reach: bool) -> DataFrame:
        name = F.when(F.col("stamp").isNotNull(), F.array(F.xxhash64(F.lit("stamp"), "seq", "stamp")))
        pose = F.when(m.isNotNull(), F.transform(_cells(words, reach), lambda c: F.xxhash64(F.lit("pose"), F.col("seq"), c)))
        return side.withColumn("gram", F.explode(F.concat(F.coalesce(name, F.array().cast("array<bigint>")), F.coalesce(pose, F.array().cast("array<bigint>")))))

    ev = grams(rec.where(F.col("split") != train), True)
    ev = ev.select("gram", *[F.col(c).alias(f"e_{c}") for c in ("rec_id", "seq", "split", "stamp", "m")])
    tr = grams(rec.where(F.col("split") == train), False)
    tr = tr.select("gram", *[F.col(c).alias(f"t_{c}") for c in ("rec_id", "seq", "stamp", "m")])
    hits = ev.join(tr, "gram").where(F.col("e_seq") == F.col("t_seq"))

    same_stamp = F.coalesce(F.col("e_stamp") == F.col("t_stamp"), F.lit(False))
    e, t = F.col("e_m"), F.col("t_m")
    shift2 = sum((e[i] - t[i]) * (e[i] - t[i]) for i in (3, 7, 11))
    trace = sum(e[i] * t[i] for i in (0, 1, 2, 4, 5, 6, 8, 9, 10))
    same_pose = F.coalesce((shift2 <= max_shift_m**2) & (trace >= 1 + 2 * math.cos(math.radians(max_turn_deg))), F.lit(False))
    kinds = F.col("e_stamp").isNotNull().cast("int") + F.col("e_m").isNotNull().cast("int")
    checked = hits.select(
        F.col("e_seq").alias("seq"), F.col("e_rec_id").alias("eval_id"), F.col("e_split").alias("eval_split"), F.col("t_rec_id").alias("train_id"),
        same_stamp.alias("same_stamp"), same_pose.alias("same_pose"), kinds.alias("kinds"),
    ).where(F.col("same_stamp") | F.col("same_pose"))
    pairs = checked.groupBy("seq", "eval_id", "eval_split", "train_id").agg(F.max("same_stamp").alias("same_stamp"), F.max("same_pose").alias("same_pose"), F.max("kinds").alias("kinds"))
    return pairs.select(
        "seq", "eval_id", "eval_split", "train_id", "same_stamp", "same_pose",
        ((F.col("same_stamp").cast("int") + F.col("same_pose").cast("int")) / F.col("kinds")).alias("containment"),
    )


def overlap_of_classes(df: DataFrame, **kw) -> tuple[DataFrame, DataFrame]:
    """(pairs, membership): overlaps between one record of each class, and (rec_id, class_id) of all records.

    Records of one recording and split with the same stamp and pose are a class, named by its
    smallest rec_id: a parked sensor's many equal records then make one pair a class instead of
    one a pair of records. Joined with the membership on both sides the pairs are those of
    cross_split_overlap. Records that overlap cannot find (null seq, split or rec_id) have no class.
    """
    rec = df.where(F.col("seq").isNotNull() & F.col("rec_id").isNotNull() & F.col("split").isNotNull())
    rec = rec.select("rec_id", "seq", "split", "rgb_name", "tmat", capture_stamp_ns(F.col("rgb_name")).alias("stamp"), F.slice("tmat", 1, 12).alias("m"))
    key = [F.xxhash64("seq", "split", "stamp", "m").alias("key"), F.xxhash64("m", "stamp", "split", "seq", F.lit(1)).alias("key2")]  # 128 bits
    rec = rec.select("*", *key)
    classes = rec.groupBy("key", "key2").agg(F.min("rec_id").alias("class_id"), F.min_by(F.struct("seq", "split", "rgb_name", "tmat"), "rec_id").alias("r"))
    heads = classes.select(F.col("class_id").alias("rec_id"), "r.*")
    return cross_split_overlap(heads, **kw), rec.join(classes.select("key", "key2", "class_id"), ["key", "key2"]).select("rec_id", "class_id").distinct()


def found_pairs(overlap: DataFrame) -> DataFrame:
    """(rec_a, rec_b), rec_a < rec_b, of each overlap."""
    return overlap.select(F.least("eval_id", "train_id").alias("rec_a"), F.greatest("eval_id", "train_id").alias("rec_b")).where("rec_a < rec_b")


def overlap_report(overlap: DataFrame) -> DataFrame:
    """Per evaluation split and recording: overlapping evaluation records, training records and links."""
    per = overlap.groupBy("eval_split", "seq", "eval_id").agg(F.count("*").alias("links"), F.max("containment").alias("containment"))
    return per.groupBy("eval_split", "seq").agg(
        F.count("*").alias("eval_records"), F.sum("links").alias("links"), F.count_if(F.col("containment") >= 1).alias("contained_whole")
    )
