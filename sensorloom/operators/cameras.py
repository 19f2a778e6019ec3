"""What the cameras of a recording see of its points, camera by camera over flat arrays.

Every point is held against every camera of its recording, but points lie in chunks along a
space-filling curve, and a camera passes over the chunks whose sphere lies outside of its
image. Only what is left of a camera's hits (pixels, or counts a point) leaves the task.
A task holds all points of one recording and up to BLOCK of its cameras (per_camera), or a
pack of its points and all of its cameras (per_point).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

BLOCK = 1024
CHUNK = 128
FINEST = 0.05  # metres, of the curve's cells
MOST_COPIES = 1 << 22
MOST_ROWS = 1 << 17
PACK = 4096
POINTS = 8192  # ids of points in a task of per_point
MOST_PAIRS = 1 << 21  # of a chunk and all cameras
AT_ONCE = 1 << 14  # pairs whose arrays stay in the processor's cache
LONG = 256  # values, from which on a row's median is found by itself


@dataclass(frozen=True)
class Camera:
    fx: float
    fy: float
    cx: float
    cy: float
    width: int
    height: int
    min_z: float = 0.05


@dataclass
class Hits:
    """Of one camera: the points' numbers, and their pixel (v·width + u), depth and range."""

    camera: int
    point: np.ndarray
    pixel: np.ndarray
    z: np.ndarray
    range: np.ndarray


def _along_curve(xyz: np.ndarray) -> np.ndarray:
    cell = np.clip(np.floor((xyz - np.nanmin(xyz, axis=0)) / FINEST), 0, (1 << 20) - 1)
    cell = np.nan_to_num(cell).astype(np.int64)
    code = np.zeros(len(xyz), np.int64)
    for bit in range(20):
        for axis in range(3):
            code |= ((cell[:, axis] >> bit) & 1) << (3 * bit + axis)
    return np.argsort(code, kind="stable")


def _matrices(column: pa.ChunkedArray) -> np.ndarray:
    """The first twelve values of each transform; nulls become NaN."""
    out = np.full((len(column), 12), np.nan)
    for i, m in enumerate(column.to_pylist()):
        if m is not None and len(m) >= 12:
            out[i] = [np.nan if v is None else v for v in m[:12]]
    return out


def _local(m: np.ndarray, d: list[np.ndarray], i: int) -> np.ndarray:
    return m[i] * d[0] + m[4 + i] * d[1] + m[8 + i] * d[2]


def _maybe_seen(m: np.ndarray, stretch: np.ndarray, mid: list[np.ndarray], ball: np.ndarray, camera: Camera) -> np.ndarray:
    """Whether a sphere may reach into the image: of many spheres for one transform, or of one for many."""
    fx, fy, cx, cy, width, height = camera.fx, camera.fy, camera.cx, camera.cy, camera.width, camera.height
    sides = [np.hypot(f, c) for f, c in ((fx, cx), (fx, cx - width), (fy, cy), (fy, cy - height))]
    d = [mid[a] - m[4 * a + 3] for a in range(3)]
    x, y, z = (_local(m, d, i) for i in range(3))
    r = ball * (stretch * (1 + 1e-6)) + 1e-6 * (1 + np.abs(x) + np.abs(y) + np.abs(z))
    maybe = (z + r > camera.min_z) & (fx * x + cx * z > -sides[0] * r) & (fx * x + (cx - width) * z < sides[1] * r)
    return maybe & (fy * y + cy * z > -sides[2] * r) & (fy * y + (cy - height) * z < sides[3] * r)


def _stretch(tmat: np.ndarray) -> np.ndarray:
    return np.linalg.norm(tmat.reshape(-1, 3, 4)[:, :, :3], 2, axis=(1, 2))


def each_camera(xyz: np.ndarray, tmat: np.ndarray, camera: Camera) -> Iterator[Hits]:
    """Hits of each camera that sees a point; one whose transform has a value that is not finite sees none."""
    order = _along_curve(xyz)
    chunks = -(-len(order) // CHUNK)
    laid = np.full((chunks * CHUNK, 3), np.nan)
    laid[: len(order)] = xyz[order]
    laid = np.ascontiguousarray(laid.reshape(chunks, CHUNK, 3).transpose(2, 0, 1))
    low, high = np.fmin.reduce(laid, axis=2), np.fmax.reduce(laid, axis=2)
    mid, ball = (low + high) / 2, np.sqrt(((high - low) ** 2).sum(axis=0)) / 2
    finite = np.isfinite(tmat).all(axis=1)
    stretch = _stretch(np.where(finite[:, None], tmat, 0.0))
    fx, fy, cx, cy, width, height = camera.fx, camera.fy, camera.cx, camera.cy, camera.width, camera.height

    with np.errstate(all="ignore"):
        for k in np.flatnonzero(finite):
            m = tmat[k]
            near = np.flatnonzero(_maybe_seen(m, stretch[k], mid, ball, camera))
            if not len(near):
                continue
            d = [laid[a][near] - m[4 * a + 3] for a in range(3)]
            z = _local(m, d, 2)
            x, y = _local(m, d, 0), _local(m, d, 1)
            u, v = np.floor(fx * x / z + cx), np.floor(fy * y / z + cy)
            flat = np.flatnonzero((z > camera.min_z) & (u >= 0) & (u < width) & (v >= 0) & (v < height))
            if not len(flat):
                continue
            x, y, z = x.ravel()[flat], y.ravel()[flat], z.ravel()[flat]
            pixel = (v.ravel()[flat] * width + u.ravel()[flat]).astype(np.int64)
            point = order[near[flat // CHUNK] * CHUNK + flat % CHUNK]
            yield Hits(int(k), point, pixel, z, np.sqrt(x * x + y * y + z * z))


#: Numbers of the rows and columns of out, in parts that are handed on at once.
Parts = Iterator[tuple[np.ndarray, dict[str, np.ndarray]]]


@dataclass(frozen=True)
class Reduce:
    of: str  # "point" or "camera", of which the numbers are
    make: Callable[[Iterator[Hits], np.ndarray, Camera], Parts]


def per_camera(points: DataFrame, cameras: DataFrame, by: list[str], row_id: str, camera_id: str, camera: Camera, reduce: Reduce, out: str, block: int = BLOCK) -> DataFrame:
    """(by, row_id, ..out) or (camera_id, ..out) of what `reduce` makes of the hits of a block of cameras of one `by`.

    A reduction of points gives a row a point and block. Ids of points are whole numbers.
    """
    cams = cameras.select(*by, F.col(camera_id).alias("_c"), F.slice("tmat", 1, 12).alias("_m"))
    n = cams.groupBy(*by).agg(F.ceil(F.count("_c") / block).cast("int").alias("_blocks"))
    cams = cams.join(n, by).withColumn("_block", F.pmod(F.xxhash64("_c"), F.col("_blocks")).cast("int")).drop("_blocks")
    packed = points.groupBy(*by, F.floor(F.col(row_id) / PACK).alias("_p")).agg(F.collect_list(F.struct(F.col(row_id).alias("_i"), "x", "y", "z")).alias("_l"))  # copies are of few wide rows
    p = packed.select(*by, *[F.col(f"_l.{c}").alias(c) for c in ("_i", "x", "y", "z")]).join(n, by).withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_blocks")
    both = p.withColumn("_m", F.lit(None).cast("array<double>")).unionByName(cams, allowMissingColumns=True)
    name, column, kind = (row_id, "_i", points.schema[row_id]) if reduce.of == "point" else (camera_id, "_c", cameras.schema[camera_id])

    kept = by if reduce.of == "point" else []

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, views, key = [], [], {}
        for g in batches:
            key = key or {c: g.column(c).slice(0, 1) for c in kept}
            view = g.column("_m").is_valid()
            rows.append(pa.table({c: g.column(c).flatten() for c in ("_i", *"xyz")}))
            views.append(pa.Table.from_batches([g]).select(["_c", "_m"]).filter(view))
        left, right = pa.concat_tables(rows), pa.concat_tables(views)
        rows = views = None
        if not len(left) or not len(right):
            return
        ids, own = left["_i"].to_numpy(), (left if column == "_i" else right)[column].combine_chunks()
        xyz, tmat = np.stack([left[c].to_numpy() for c in "xyz"], axis=1), _matrices(right["_m"])
        left = right = None
        for at, columns in reduce.make(each_camera(xyz, tmat, camera), ids, camera):
            keys = {c: v.take(pa.array(np.zeros(len(at), np.int64))) for c, v in key.items()}
            yield pa.RecordBatch.from_pydict({**keys, name: own.take(pa.array(at, pa.int64())), **{c: pa.array(v) for c, v in columns.items()}})

    schema = ", ".join([*(f"`{c}` {points.schema[c].dataType.simpleString()}" for c in kept), f"`{name}` {kind.dataType.simpleString()}", out])
    tasks = 4 * int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return both.repartition(tasks, *by, "_block").groupBy(*by, "_block").applyInArrow(seen, schema)


def _joined(parts: list, kind=np.int64) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *parts]).astype(kind)


def _nearest(h: Hits, camera: Camera) -> np.ndarray:
    depth = np.full(camera.width * camera.height, np.inf)
    np.minimum.at(depth, h.pixel, h.z)
    return depth


def _by_pixel(rows: Iterator[tuple], width: int, names: dict[str, type]) -> Parts:
    """rows: (camera, pixels, columns..) of each camera."""
    part, held = [], 0
    for row in rows:
        part.append(row)
        held += len(row[1])
        if held >= MOST_ROWS:
            yield _pixels(part, width, names)
            part, held = [], 0
    if part:
        yield _pixels(part, width, names)


def _pixels(rows: list[tuple], width: int, names: dict[str, type]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    pixel = _joined([r[1] for r in rows])
    at = np.repeat(np.array([r[0] for r in rows], np.int64), [len(r[1]) for r in rows])
    return at, {"u": (pixel % width).astype(np.int32), "v": (pixel // width).astype(np.int32), **{n: _joined([r[2 + i] for r in rows], k) for i, (n, k) in enumerate(names.items())}}


def view_counts(reach: float) -> Reduce:
    def reduce(hits: Iterator[Hits], ids: np.ndarray, camera: Camera):
        views, good = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        for h in hits:
            views[h.point] += 1
            good[h.point[h.range < reach]] += 1
        at = np.flatnonzero(views)
        yield at, {"any_views": views[at], "good_views": good[at]}

    return Reduce("point", reduce)


def visible(tolerance: float = 0.05, hidden: float = 0.15) -> Reduce:
    """Whether any camera sees a point, by the rules surface, open and fill of projective.visibility against its own z-buffer."""

    def reduce(hits: Iterator[Hits], ids: np.ndarray, camera: Camera):
        seen, rules = np.zeros(len(ids), bool), np.zeros((3, len(ids)), bool)
        for h in hits:
            depth = _nearest(h, camera)[h.pixel]
            seen[h.point] = True
            ok = h.z <= depth * (1 + tolerance)
            for rule, yes in zip(rules, (np.abs(h.z - depth) < tolerance * depth, ok, (h.z < depth * (1 + tolerance)) | (h.z < depth + hidden))):
                rule[h.point[yes]] = True
        at = np.flatnonzero(seen)
        yield at, dict(zip(("surface", "open", "fill"), rules[:, at]))

    return Reduce("point", reduce)


def z_buffer(min_hits: int) -> Reduce:
    def reduce(hits: Iterator[Hits], ids: np.ndarray, camera: Camera):
        for h in hits:
            n = np.bincount(h.pixel, minlength=1)
            at = np.flatnonzero(n >= max(1, min_hits))
            yield h.camera, at, _nearest(h, camera)[at], n[at]

    return Reduce("camera", lambda hits, ids, camera: _by_pixel(reduce(hits, ids, camera), camera.width, {"z": float, "hits": np.int64}))


def nearest_row(name: str) -> Reduce:
    """The id of the nearest point of each pixel; of equal depths the smallest."""

    def reduce(hits: Iterator[Hits], ids: np.ndarray, camera: Camera):
        for h in hits:
            first = h.z == _nearest(h, camera)[h.pixel]
            pixel, own = h.pixel[first], ids[h.point[first]]
            best = np.full(camera.width * camera.height, np.iinfo(np.int64).max)
            np.minimum.at(best, pixel, own)
            taken = np.zeros(len(best), bool)
            taken[pixel] = True
            at = np.flatnonzero(taken)
            yield h.camera, at, best[at]

    return Reduce("camera", lambda hits, ids, camera: _by_pixel(reduce(hits, ids, camera), camera.width, {name: np.int64}))


def _splats(h: Hits, camera: Camera, least_z: float, voxel: float, largest: int, weights: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """(place, z, weight) of the copies of all hits to the squares their size covers; places are in an image with largest - 1 more pixels on every side."""
    wide, far = camera.width + 2 * (largest - 1), h.z > least_z
    z, pixel = h.z[far], h.pixel[far]
    place = (pixel // camera.width + largest - 1) * wide + pixel % camera.width + largest - 1
    radius = np.maximum(1, np.minimum(largest, np.ceil(0.5 * camera.fx * voxel / z)))
    batch: list[tuple] = []
    held = 0
    for r in range(1, largest + 1):
        mine = np.flatnonzero(radius == r)
        step = np.arange(1 - r, r)
        move = (step[:, None] * wide + step).ravel()
        weight = np.exp(-((step[:, None] ** 2 + step**2).ravel()) / (2 * (0.5 * r) * (0.5 * r)))
        size = max(1, MOST_COPIES // len(move))
        for start in range(0, len(mine), size):
            part = mine[start : start + size]
            if held and held + len(part) * len(move) > MOST_COPIES:
                yield _batch(batch)
                batch, held = [], 0
            held += len(part) * len(move)
            batch.append(((place[part][:, None] + move).ravel(), np.repeat(z[part], len(move)), np.tile(weight, len(part)) if weights else None))
    if held:
        yield _batch(batch)


def _batch(parts: list[tuple]) -> tuple:
    return tuple(None if p[0] is None else np.concatenate(p) for p in zip(*parts))


def _cropped(image: np.ndarray, camera: Camera, edge: int) -> np.ndarray:
    return image.reshape(camera.height + 2 * edge, -1)[edge : edge + camera.height, edge : edge + camera.width]


def _splat_depth(h: Hits, camera: Camera, least_z: float, voxel: float, largest: int) -> np.ndarray:
    edge = largest - 1
    depth = np.full((camera.height + 2 * edge) * (camera.width + 2 * edge), np.inf)
    for place, z, _ in _splats(h, camera, least_z, voxel, largest, False):
        np.minimum.at(depth, place, z)
    return depth


def surface_depth(least_z: float, voxel: float, slack: float = 1.02, largest: int = 6) -> Reduce:
    """projective.surface_depth of projective.splat: weighted harmonic mean depth of each pixel."""

    def reduce(hits: Iterator[Hits], ids: np.ndarray, camera: Camera):
        for h in hits:
            nearest = _splat_depth(h, camera, least_z, voxel, largest)
            over, under, count = np.zeros(len(nearest)), np.zeros(len(nearest)), np.zeros(len(nearest), np.int64)
            for place, z, weight in _splats(h, camera, least_z, voxel, largest, True):
                near = np.flatnonzero(z <= slack * nearest[place])
                place, z, weight = place[near], z[near], weight[near]
                over += np.bincount(place, weight, len(over))
                under += np.bincount(place, weight / z, len(over))
                count += np.bincount(place, minlength=len(over))
            over, under, count = (_cropped(i, camera, largest - 1).ravel() for i in (over, under, count))
            at = np.flatnonzero(count)
            yield h.camera, at, over[at] / under[at], count[at]

    return Reduce("camera", lambda hits, ids, camera: _by_pixel(reduce(hits, ids, camera), camera.width, {"depth": float, "hits": np.int64}))


def _around(image: np.ndarray, reach: int, fold: np.ufunc, fill) -> np.ndarray:
    """fold over the square of pixels within reach; `fill` beyond the edges."""
    for _ in range(2):
        wide = np.pad(image, ((0, 0), (reach, reach)), constant_values=fill)
        out = wide[:, : image.shape[1]].copy()
        for s in range(1, 2 * reach + 1):
            fold(out, wide[:, s : s + image.shape[1]], out=out)
        image = np.ascontiguousarray(out.T)
    return image


def supported(least_z: float, voxel: float, slack: float = 1.05, support: int = 5, largest: int = 6) -> Reduce:
    """How many pixels of the splatted image projective.supported keeps, of cameras with any."""

    def reduce(hits: Iterator[Hits], ids: np.ndarray, camera: Camera):
        at, pixels = [], []
        for h in hits:
            depth = _cropped(_splat_depth(h, camera, least_z, voxel, largest), camera, largest - 1)
            has = np.isfinite(depth)
            if not has.any():
                continue
            rows, cols = np.flatnonzero(has.any(axis=1)), np.flatnonzero(has.any(axis=0))
            depth = depth[rows[0] : rows[-1] + 1, cols[0] : cols[-1] + 1]
            ok = np.isfinite(depth) & (depth <= slack * _around(depth, 2, np.minimum, np.inf))
            n = int((ok & (_around(ok.astype(np.int8), 1, np.add, 0) > support)).sum())
            if n:
                at.append(h.camera)
                pixels.append(n)
        yield np.array(at, np.int64), {"pixels": np.array(pixels, np.int64)}

    return Reduce("camera", reduce)


def per_point(points: DataFrame, cameras: DataFrame, by: list[str], row_id: str, carried: list[str], reduce: Callable[[dict[str, np.ndarray], np.ndarray], tuple[np.ndarray, dict[str, np.ndarray]]], out: str) -> DataFrame:
    """(by, row_id, ..carried, ..out): reduce gets the other columns (doubles) of a pack of points, and the finite transforms of all cameras of its `by`.

    It gives the numbers of the points that have a row, and their columns. Ids of points are whole numbers.
    """
    p = points.withColumn("_p", F.floor(F.col(row_id) / POINTS))
    values = [c for c in points.columns if c not in (*by, row_id, *carried)]
    names = [row_id, *carried, *values]
    m = F.slice("tmat", 1, 12)
    c = cameras.where((F.size("tmat") >= 12) & F.forall(m, lambda v: v.isNotNull() & (F.abs(v) < float("inf")))).groupBy(*by).agg(F.flatten(F.collect_list(m)).alias("_m"))
    packs = p.groupBy(*by, "_p").agg(F.collect_list(F.struct(*names)).alias("_l")).select(*by, "_p", *[F.col(f"_l.{n}").alias(n) for n in names])
    both = packs.unionByName(p.select(*by, "_p").distinct().join(c, by), allowMissingColumns=True)

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, views, key = [], [], {}
        for g in batches:
            key = key or {c: g.column(c).slice(0, 1) for c in by}
            rows.append(pa.table({c: g.column(c).flatten() for c in names}))
            views.append(g.column("_m").flatten())
        own, tmat = pa.concat_tables(rows), pa.chunked_array(views).to_numpy().reshape(-1, 12)
        if not len(own) or not len(tmat):
            return
        at, columns = reduce({c: own[c].to_numpy() for c in values}, tmat)
        kept = own.select([row_id, *carried]).combine_chunks().take(pa.array(at, pa.int64()))
        keys = {c: v.take(pa.array(np.zeros(len(at), np.int64))) for c, v in key.items()}
        yield from pa.table({**keys, **{c: kept[c] for c in kept.column_names}, **{c: pa.array(v) for c, v in columns.items()}}).to_batches()

    schema = StructType([*(StructField(c, points.schema[c].dataType) for c in (*by, row_id, *carried)), *StructType.fromDDL(out)])
    tasks = 4 * int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return both.repartition(tasks, *by, "_p").groupBy(*by, "_p").applyInArrow(folded, schema)


COVARIANCE = ("xx", "xy", "xz", "yy", "yz", "zz")


def _turned(tmat: np.ndarray, fx: float, fy: float) -> np.ndarray:
    """(cameras, 6, 6): the k-th row times a covariance's six values gives its k-th value along the camera's axes, x and y in units of the focal lengths."""
    c = tmat.reshape(-1, 3, 4)[:, :, :3] * np.array([fx, fy, 1.0])
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    return np.stack([np.stack([c[:, a, i] * c[:, b, j] + (c[:, b, i] * c[:, a, j] if a != b else 0) for a, b in pairs], axis=1) for i, j in pairs], axis=1)


def _row_counts(mask: np.ndarray) -> np.ndarray | int:
    return mask.shape[1] if mask.all() else np.count_nonzero(mask, axis=1)


def _lower_medians(values: np.ndarray, counts: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Of each of the rows the lower median of its `counts` values, which come first by size, NaN last; values are moved."""
    at = (counts[rows] - 1) // 2
    if values.shape[1] > LONG:
        for i, k in zip(rows, at):
            values[i].partition(k)
    else:
        values.sort(axis=1)
    return values[rows, at]


def footprints(camera: Camera, blur: float, least: float, margin: float, culled_share: float):
    """For per_point over x, y, z and COVARIANCE: views, culled, need and ratio of projective.widened_footprints for each point that a camera sees.

    need and ratio are those of points under `least` in more than culled_share of their views, else 0 and 1.
    """
    fx, fy, cx, cy, width, height = camera.fx, camera.fy, camera.cx, camera.cy, camera.width, camera.height
    focal = (0.5 * (fx + fy)) ** 2

    def chunk(p: np.ndarray, cov: np.ndarray, tmat: np.ndarray, turned: np.ndarray) -> tuple[np.ndarray, ...]:
        """Most pairs of a chunk and the cameras near it are hits, so all are worked out and the others masked."""
        n, k = len(p), len(tmat)
        m = tmat.reshape(-1, 3, 4).transpose(1, 2, 0)
        p, m = np.concatenate([p, np.ones((n, 1))], axis=1), np.concatenate([m[:, :3], -(m[:, :3] * m[:, 3:]).sum(axis=0)[None]])
        views, culled = np.zeros(n, np.int64), np.zeros(n, np.int64)
        need, ratio = np.empty((n, k)), np.empty((n, k))
        for start in range(0, k, size := max(1, AT_ONCE // n)):
            part = slice(start, start + size)
            x, y, z = (p @ m[:, i, part] for i in range(3))
            x, y = fx * x / z, fy * y / z
            u, v = np.floor(x + cx), np.floor(y + cy)
            hit = (z > camera.min_z) & (u >= 0) & (u < width) & (v >= 0) & (v < height)
            xx, xy, xz, yy, yz, zz = (cov @ turned[part, i].T for i in range(6))
            g, xr, yr = 1 / (z * z), xz - x * zz, yz - y * zz
            a, b, d = g * (xx - x * (xz + xr)) + blur, g * (xy - y * xz - x * yr), g * (yy - y * (yz + yr)) + blur
            mid, half, bb = (a + d) / 2, (a - d) / 2, b * b
            top = mid + np.sqrt(half * half + bb)
            more = np.maximum(0.0, margin * least - top)
            views += _row_counts(hit)
            culled += _row_counts(hit & (top < least))
            need[:, part] = np.where(hit, more / (focal * g), np.nan)
            ratio[:, part] = np.where(hit, np.sqrt((a * d - bb) / np.maximum((a + more) * (d + more) - bb, 1e-20)), np.nan)
        thin = np.flatnonzero(culled > culled_share * views)
        out = np.zeros(n), np.ones(n)
        for lower, values in zip(out, (need, ratio)):
            lower[thin] = _lower_medians(values, views, thin)
        return views, culled, *out

    def reduce(columns: dict[str, np.ndarray], tmat: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        xyz, cov = np.stack([columns[c] for c in "xyz"], axis=1), np.stack([columns[c] for c in COVARIANCE], axis=1)
        own = np.flatnonzero(np.isfinite(xyz).all(axis=1))
        own = own[_along_curve(xyz[own])] if len(own) else own
        m, stretch, turned = np.ascontiguousarray(tmat.T), _stretch(tmat), _turned(tmat, fx, fy)
        numbers, parts = [np.zeros(0, np.int64)], []
        size = min(CHUNK, max(1, MOST_PAIRS // len(tmat)))
        with np.errstate(all="ignore"):
            for start in range(0, len(own), size):
                at = own[start : start + size]
                low, high = xyz[at].min(axis=0), xyz[at].max(axis=0)
                near = np.flatnonzero(_maybe_seen(m, stretch, (low + high) / 2, np.sqrt(((high - low) ** 2).sum()) / 2, camera))
                if len(near):
                    part = chunk(xyz[at], cov[at], tmat[near], turned[near])
                    seen = part[0] > 0
                    numbers.append(at[seen])
                    parts.append([c[seen] for c in part])
        names = {"views": np.int64, "culled": np.int64, "need": float, "ratio": float}
        return np.concatenate(numbers), {n: _joined([p[i] for p in parts], kind) for i, (n, kind) in enumerate(names.items())}

    return reduce
