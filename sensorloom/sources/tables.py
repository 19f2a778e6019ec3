"""CSV, JSON, mesh and model files as sinks and sources, written by Spark's own writers where a format has one.

Folders must be ones that all executors share. A sink returns the folder it wrote.
"""

from __future__ import annotations

import json
import os
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sensorloom.functions import geometry as geo
from sensorloom.session import shared_folder

# Columns of the per-frame blur table and their decimals.
PER_FRAME = (("name", None), ("t", 6), ("used", 0), ("rate_px_per_ms_med", 5), ("rate_px_per_ms_p90", 5), ("omega_mocap", 4), ("omega_imu", 4))
IMAGE_INDEX = "cam string, ns bigint, file string, sharp double, mean double"


def fixed_decimals(df: DataFrame, columns: tuple[tuple[str, int | None], ...]) -> DataFrame:
    """Numbers as text with a fixed count of decimals, as "nan" and "inf" where they are not finite; null stays null."""

    def text(name: str, digits: int | None):
        c = F.col(name)
        if digits is None:
            return c.cast("string").alias(name)
        if digits == 0:
            return c.cast("bigint").cast("string").alias(name)
        v = c.cast("double")
        shown = F.when(F.isnan(v), "nan").when(F.abs(v) == float("inf"), F.when(v > 0, "inf").otherwise("-inf")).otherwise(F.format_string(f"%.{digits}f", v))
        return F.when(v.isNotNull(), shown).alias(name)

    return df.select(*[text(n, k) for n, k in columns])


def write_csv(df: DataFrame, folder: str, partition_by: list[str] | None = None) -> str:
    """Comma-separated parts with a header; null and the empty text are told apart."""
    w = df.write.mode("overwrite").option("header", True).option("emptyValue", '""').option("nullValue", "")
    (w.partitionBy(*partition_by) if partition_by else w).csv(folder)
    return folder


def read_csv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """CSV by a stated schema. With a header, columns are taken by its names, whatever their order and number; without, by place.

    Numbers may be nan, inf or -inf; fields that do not parse are null.
    """
    if not header:
        return spark.read.schema(schema).option("nanValue", "nan").option("positiveInf", "inf").option("negativeInf", "-inf").csv(path)
    raw = spark.read.option("header", True).csv(path)  # only the first line is read here
    kinds = T.StructType.fromDDL(schema)
    return raw.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in kinds])


def read_image_index(spark: SparkSession, path: str, cameras: list[str] | None = None) -> DataFrame:
    """(cam, rn, ns, file, sharp, mean): the image index, numbered from 0 per camera by stamp, then file; only the given cameras."""
    i = read_csv(spark, path, IMAGE_INDEX)
    if cameras is not None:
        i = i.where(F.col("cam").isin(cameras))
    return i.withColumn("rn", F.row_number().over(Window.partitionBy("cam").orderBy("ns", "file")) - 1)  # one camera's images


def read_trajectory(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, t, p, q) of trajectory text: seconds, position, scalar-last quaternion; # lines are comments."""
    from sensorloom.sources.text import pose_log, read_lines

    return pose_log(read_lines(spark, path))


def trajectory_lines(poses: DataFrame, t: str, p: str, q: str) -> DataFrame:
    """(value): "t x y z qx qy qz qw", nine decimals for the time and places, as read_trajectory reads them."""
    cols = [F.col(t), *[F.col(p)[c] for c in "xyz"], *[F.col(q)[c] for c in "xyzw"]]
    return poses.select(F.format_string(" ".join(["%.9f"] * 8), *cols).alias("value"))


def write_lines(lines: DataFrame, folder: str) -> str:
    lines.select("value").write.mode("overwrite").text(folder)
    return folder


def append_jsonl(rows: DataFrame, folder: str) -> str:
    """Adds a batch to a ledger of JSON lines; earlier batches stay."""
    rows.write.mode("append").json(folder)
    return folder


def read_jsonl(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(folder)


def _plain(value: Any) -> Any:
    """Arrays and numbers of array libraries as plain lists and numbers; anything else is an error."""
    if hasattr(value, "tolist") and (hasattr(value, "dtype") or hasattr(value, "typecode")):
        return value.tolist()
    raise TypeError(f"not a JSON value: {type(value).__name__}")


def write_json(path: str, value: Any) -> None:
    """One JSON document (a report or a configuration, driver-sized by nature), replaced at once."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    temporary = f"{path}.{uuid.uuid4().hex}"
    with open(temporary, "w") as f:
        json.dump(value, f, indent=2, default=_plain)
    os.replace(temporary, path)


def model_lines(cameras: DataFrame, images: DataFrame, by: list[str]) -> dict[str, DataFrame]:
    """Text of a whole multi-camera model per `by`: {"cameras": (by, camera_id, value), "images": (by, image_id, value)}.

    cameras has camera_id, model, width, height, params (array of doubles); images has name,
    camera_id and tmat (camera to world). Images are numbered from 1 in order of name, then
    camera; each has its world-to-camera pose and an empty line for its points.
    """
    params = F.array_join(F.transform("params", lambda p: F.format_string("%.10g", p)), " ")
    cam = cameras.select(*by, "camera_id", F.format_string("%d %s %d %d %s", "camera_id", "model", "width", "height", params).alias("value"))
    n = images.withColumn("image_id", F.row_number().over(Window.partitionBy(*by).orderBy("name", "camera_id")).cast("bigint"))
    n = n.withColumn("_m", geo.inverse(F.col("tmat"))).withColumn("_r", geo.rotation(F.col("_m")))
    n = n.select(*by, "image_id", "camera_id", "name", geo.rotation_to_quat(F.col("_r")).alias("q"), geo.position(F.col("_m")).alias("p"))
    pose = F.format_string("%d " + "%.12f " * 7 + "%d %s", "image_id", *[F.col("q")[c] for c in "wxyz"], *[F.col("p")[c] for c in "xyz"], "camera_id", "name")
    return {"cameras": cam, "images": n.select(*by, "image_id", F.concat(pose, F.lit("\n")).alias("value"))}


def mesh_lines(vertices: DataFrame, faces: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, part, n, value) of an OBJ mesh per `by`: vertices (vid from 0, x, y, z), then triangles (fid, a, b, c of vids), written from 1 on; in order of part and n."""
    by = by or []
    v = vertices.select(*by, F.lit(0).alias("part"), F.col("vid").alias("n"), F.format_string("v %.6f %.6f %.6f", "x", "y", "z").alias("value"))
    f = faces.select(*by, F.lit(1).alias("part"), F.col("fid").alias("n"), F.format_string("f %d %d %d", F.col("a") + 1, F.col("b") + 1, F.col("c") + 1).alias("value"))
    return v.unionByName(f)


def read_mesh(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices (path, line_no, x, y, z), faces (path, line_no, a, b, c), counted from 0) of OBJ lines; other records are skipped.

    Corners may carry texture and normal numbers ("7/1/3"); faces of more corners are fanned.
    """
    t = F.split(F.trim("value"), r"\s+")
    v = lines.where(F.col("value").rlike(r"^\s*v\s")).select("path", "line_no", *[t[i + 1].cast("double").alias(c) for i, c in enumerate("xyz")])
    corners = F.transform(F.slice(t, 2, F.size(t)), lambda c: F.split(c, "/")[0].cast("bigint") - 1)
    f = lines.where(F.col("value").rlike(r"^\s*f\s")).select("path", "line_no", corners.alias("c"))
    fan = F.transform(F.sequence(F.lit(1), F.size("c") - 2), lambda i: F.struct(F.col("c")[0].alias("a"), F.element_at("c", i + 1).alias("b"), F.element_at("c", i + 2).alias("c")))
    return v, f.where(F.size("c") >= 3).select("path", "line_no", F.explode(fan).alias("z")).select("path", "line_no", "z.*")


def coded_mask(known: F.Column | Any, kept: F.Column | Any):
    """0 dropped, 128 unknown, 255 kept: the code of a pixel of a mask."""
    return F.when(~F.coalesce(known, F.lit(False)), 128).when(kept, 255).otherwise(0)


def assemble(frames: DataFrame, companions: dict[str, DataFrame], key: str) -> DataFrame:
    """frames with the companion files they have: {kind: (key, file)} adds a column of that name, null where there is none.

    A data set is a row subset and the addresses of its files; nothing is copied or linked.
    """
    out = frames
    for kind, files in companions.items():
        one = files.groupBy(key).agg(F.min("file").alias(kind))
        out = out.join(one, key, "left")
    return out


def catalogue_entry(catalogue: DataFrame, name: str, column: str = "name") -> DataFrame:
    """The entry (each distinct one) of that name; an error if there is none."""
    hit = catalogue.where(F.col(column) == name).agg(F.collect_set(F.struct(*catalogue.columns)).alias("_e"))  # names are unique but for repeated rows
    found = F.when(F.size("_e") > 0, F.col("_e")).otherwise(F.raise_error(F.lit(f"{name} is not in the catalogue")))
    return hit.select(F.explode(found).alias("_r")).select("_r.*")


def cached_stats(cache: DataFrame, current: DataFrame, key: str, compute) -> DataFrame:
    """The cached rows of each key whose number of rows is still the current one's; the others are computed again by `compute`."""
    n_cache = cache.groupBy(key).agg(F.count("*").alias("_a"))
    n_now = current.groupBy(key).agg(F.count("*").alias("_b"))
    fresh = n_cache.join(n_now, key).where("_a = _b").select(key)
    stale = current.join(fresh, key, "left_anti")
    return cache.join(fresh, key, "left_semi").unionByName(compute(stale))


def folder_for(spark: SparkSession, name: str) -> str:
    """A new folder of that name in the shared place."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
