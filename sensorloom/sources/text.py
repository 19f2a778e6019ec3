"""Text logs and models as DataFrames of lines, parsed with built-in expressions.

Every parser takes lines (path, line_no, value), so files, tables and tests share it;
`read_lines` makes them from files. A line's number is its place in the file, found from
one small count per file part rather than by one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?(nan|inf|infinity)$"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, value) of text files, counted from 0 in each file.

    Files are split like any text; a line's number is its place in its split plus the lines of
    the file's splits before it, found from one count a split.
    """
    at = F.col("_metadata.file_block_start")
    raw = spark.read.option("recursiveFileLookup", "true").text(path)
    raw = raw.select(F.col("_metadata.file_path").alias("path"), at.alias("_at"), F.monotonically_increasing_id().alias("_id"), "value")
    splits = raw.groupBy("path", "_at").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    w = Window.partitionBy("path").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)  # one row a split
    base = splits.select("path", "_at", (F.coalesce(F.sum("_n").over(w), F.lit(0)) - F.col("_first")).alias("_base"))
    return raw.join(base, ["path", "_at"]).select("path", (F.col("_id") + F.col("_base")).alias("line_no"), "value")


def numeric_rows(lines: DataFrame, min_cols: int) -> DataFrame:
    """(path, line_no, values): rows of numbers, parted by commas or spaces.

    Blank and # lines, rows with any other token and rows under min_cols are dropped; all
    rows of a file are cut to its narrowest. Null lines are blank; a file without rows gives none.
    """
    v = F.trim(F.coalesce("value", F.lit("")))
    tokens = F.split(F.regexp_replace(v, r"^[,\s]+|[,\s]+$", ""), r"[,\s]+")
    good = lines.where((v != "") & ~v.startswith("#")).select("path", "line_no", tokens.alias("tokens"))
    good = good.where((F.size("tokens") >= min_cols) & F.forall("tokens", lambda t: F.lower(t).rlike(NUMBER)))
    rows = good.select("path", "line_no", F.transform("tokens", lambda t: t.cast("double")).alias("values"))
    width = rows.groupBy("path").agg(F.min(F.size("values")).alias("_w"))
    return rows.join(width, "path").select("path", "line_no", F.slice("values", F.lit(1), F.col("_w")).alias("values"))


def pose_log(lines: DataFrame, offset_s: float = 0.0) -> DataFrame:
    """t (s, shifted), position and scalar-last quaternion of eight-column rows."""
    v = F.col("values")
    return numeric_rows(lines, 8).select(
        "path", "line_no", (v[0] + offset_s).alias("t"), F.struct(v[1].alias("x"), v[2].alias("y"), v[3].alias("z")).alias("p"),
        F.struct(v[7].alias("w"), v[4].alias("x"), v[5].alias("y"), v[6].alias("z")).alias("q"),
    )


def imu_log(lines: DataFrame, offset_s: float = 0.0) -> DataFrame:
    """t from µs, gyro, accelerometer, scalar-first quaternion of fourteen-column rows."""
    v = F.col("values")
    xyz = lambda i: F.struct(*[v[i + k].alias(c) for k, c in enumerate("xyz")])
    return numeric_rows(lines, 14).select(
        "path", "line_no", (v[0] / 1e6 + offset_s).alias("t"), xyz(1).alias("omega"), xyz(4).alias("accel"), F.struct(*[v[10 + k].alias(c) for k, c in enumerate("wxyz")]).alias("quat")
    )


def joint_log(lines: DataFrame, offset_s: float = 0.0) -> DataFrame:
    """t from µs and twelve angles."""
    return numeric_rows(lines, 13).select("path", "line_no", (F.col("values")[0] / 1e6 + offset_s).alias("t"), F.slice("values", 2, 12).alias("angles"))


def frame_pairs(lines: DataFrame) -> DataFrame:
    """(path, rn, rgb_name, depth_name, t, t_depth): the i-th colour image of a file with its i-th depth image.

    All .png tokens count in order; names with `event` are skipped, with `depth` and `rgb` are
    depth, with `rgb` colour. What the longer list has beyond the shorter is left out. t are µs
    stamps at the names' start, in seconds.
    """
    tok = lines.select("path", "line_no", F.posexplode(F.split(F.trim("value"), r"\s+")).alias("pos", "name")).where(F.lower("name").endswith(".png"))
    n = F.lower("name")
    kind = F.when(n.contains("event"), None).when(n.contains("depth") & n.contains("rgb"), "depth").when(n.contains("rgb"), "rgb")
    tok = tok.withColumn("kind", kind).where("kind is not null")
    w = Window.partitionBy("path", "kind").orderBy("line_no", "pos")  # one file's names
    tok = tok.withColumn("rn", F.row_number().over(w))
    a = tok.where("kind = 'rgb'").select("path", "rn", F.col("name").alias("rgb_name"))
    b = tok.where("kind = 'depth'").select("path", "rn", F.col("name").alias("depth_name"))
    t = lambda c: F.regexp_extract(c, r"^([0-9]+)", 1).try_cast("bigint") / 1e6
    return a.join(b, ["path", "rn"]).select("path", "rn", "rgb_name", "depth_name", t("rgb_name").alias("t"), t("depth_name").alias("t_depth"))


def model_images(lines: DataFrame) -> DataFrame:
    """(path, image_id, q, p, camera_id, name) of a text model's image file: world-to-camera poses.

    A pose line has at least ten tokens, the first a whole number and the last no number;
    the point lines between, blank or not, are skipped however they are laid out.
    """
    t = F.split(F.trim("value"), r"\s+")
    rows = lines.where(~F.trim(F.coalesce("value", F.lit(""))).startswith("#")).select("path", "line_no", t.alias("t"))
    rows = rows.where((F.size("t") >= 10) & F.col("t")[0].rlike("^[0-9]+$") & ~F.lower(F.element_at("t", -1)).rlike(NUMBER))
    num = lambda i: F.col("t")[i].try_cast("double")
    return rows.select(
        "path", F.col("t")[0].cast("bigint").alias("image_id"), F.struct(*[num(1 + k).alias(c) for k, c in enumerate("wxyz")]).alias("q"),
        F.struct(*[num(5 + k).alias(c) for k, c in enumerate("xyz")]).alias("p"), F.col("t")[8].try_cast("bigint").alias("camera_id"), F.array_join(F.slice("t", 10, F.size("t")), " ").alias("name"),
    )


def model_cameras(lines: DataFrame) -> DataFrame:
    t = F.split(F.trim("value"), r"\s+")
    rows = lines.where(~F.trim("value").startswith("#") & (F.size(t) >= 5)).select("path", t.alias("t"))
    return rows.select("path", F.col("t")[0].cast("bigint").alias("camera_id"), F.col("t")[1].alias("model"), F.col("t")[2].cast("int").alias("width"), F.col("t")[3].cast("int").alias("height"), F.transform(F.slice("t", 5, F.size("t")), lambda x: x.cast("double")).alias("params"))


def model_points(lines: DataFrame) -> DataFrame:
    t = F.split(F.trim("value"), r"\s+")
    rows = lines.where(~F.trim("value").startswith("#") & (F.size(t) >= 8)).select("path", t.alias("t"))
    num = lambda i, k: F.col("t")[i].cast(k)
    return rows.select("path", num(0, "bigint").alias("point_id"), *[num(i, "double").alias(c) for i, c in ((1, "x"), (2, "y"), (3, "z"))], *[num(i, "int").alias(c) for i, c in ((4, "r"), (5, "g"), (6, "b"))], num(7, "double").alias("error"))


def image_lines(images: DataFrame, by: list[str], name: str = "name") -> DataFrame:
    """(by, image_id, value): two text lines an image, numbered from 1 in order of name; q and p are world to camera."""
    n = images.withColumn("image_id", F.row_number().over(Window.partitionBy(*by).orderBy(name)))
    q, p = F.col("q"), F.col("p")
    pose = F.format_string("%d " + "%.9f " * 7 + "%d %s", "image_id", *[q[c] for c in "wxyz"], *[p[c] for c in "xyz"], "camera_id", name)
    return n.select(*by, "image_id", F.concat(pose, F.lit("\n")).alias("value"))


def html_rows(pages: DataFrame, page: str, html: str) -> DataFrame:
    """(page, row_no, cells): table rows of a page: scripts and styles dropped, anchors kept as text and [address], tags stripped, common entities resolved, space collapsed."""
    t = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", "")
    t = F.regexp_replace(t, r"(?is)<a\b[^>]*?href\s*=\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</a\s*>", "$2 [$1]")
    rows = pages.select(F.col(page), F.posexplode(F.regexp_extract_all(t, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr\s*>"), 1)).alias("row_no", "row"))
    cells = F.regexp_extract_all("row", F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]\s*>"), 1)

    def clean(c):
        c = F.regexp_replace(c, r"(?s)<[^>]*>", " ")
        for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
            c = F.replace(c, F.lit(entity), F.lit(char))
        return F.trim(F.regexp_replace(c, r"\s+", " "))

    return rows.select(page, "row_no", F.transform(cells, clean).alias("cells"))


def sidecar_order(paths: DataFrame, column: str = "path") -> DataFrame:
    """paths with depth (number of slashes): the defined order of files is (depth, path)."""
    return paths.withColumn("depth", F.length(column) - F.length(F.replace(F.col(column), F.lit("/"), F.lit(""))))
