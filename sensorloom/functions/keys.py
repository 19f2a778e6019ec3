"""Integer keys of grid cells and curves, and text keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BIAS = 1 << 20  # 21 bits an axis, signed


def cell(x: Column, size: float) -> Column:
    return F.floor(x / size).cast("bigint")


def voxel_key(x: Column, y: Column, z: Column, size: float) -> Column:
    """One bigint of three 21-bit cells; distinct for |cell| < 2^20, null beyond."""
    parts = [cell(v, size) + BIAS for v in (x, y, z)]
    inside = F.lit(True)
    for p in parts:
        inside = inside & p.between(0, 2 * BIAS - 1)
    return F.when(inside, F.shiftleft(parts[0], 42).bitwiseOR(F.shiftleft(parts[1], 21)).bitwiseOR(parts[2]))


def flat_index(ix: Column, iy: Column, iz: Column, nx: int, ny: int, nz: int) -> Column:
    """Index into a dense grid, row by row; null outside."""
    inside = ix.between(0, nx - 1) & iy.between(0, ny - 1) & iz.between(0, nz - 1)
    return F.when(inside, (ix * ny + iy) * nz + iz)


# Shifts and masks that spread ten bits to every third of thirty.
SPREAD = ((16, 0x030000FF), (8, 0x0300F00F), (4, 0x030C30C3), (2, 0x09249249))


def _spread(v: Column) -> Column:
    """Ten bits to every third of thirty, by shifts that halve in width."""
    v = v.bitwiseAND(0x3FF)
    for shift, mask in SPREAD:
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(mask)
    return v


def morton(ix: Column, iy: Column, iz: Column) -> Column:
    """Z-order code of three ten-bit cells, x in the lowest bit."""
    x, y, z = (_spread(c.cast("bigint")) for c in (ix, iy, iz))
    return x.bitwiseOR(F.shiftleft(y, 1)).bitwiseOR(F.shiftleft(z, 2))


def quantise(x: Column, lo: Column, hi: Column, levels: int) -> Column:
    """Code 0..levels of x between lo and hi, halves up; 0 where the range is degenerate."""
    width = hi - lo
    t = F.when(width < 1e-5, 0.0).otherwise((x - lo) / width)
    return F.greatest(F.lit(0), F.least(F.lit(levels), F.floor(t * levels + 0.5))).cast("int")


def leading_integer(name: Column) -> Column:
    return F.regexp_extract(name, r"^\s*([0-9]+)", 1).try_cast("bigint")


def stamp_seconds(digits: Column) -> Column:
    """Seconds of a whole stamp whose unit shows in its length: 10 s, 13 ms, 16 µs, 19 ns; null else."""
    v = digits.try_cast("bigint")
    n = F.length(digits)
    return F.when(n == 10, v * 1.0).when(n == 13, v / 1e3).when(n == 16, v / 1e6).when(n == 19, v / 1e9)


def stem(path: Column) -> Column:
    """Last path part without its last suffix."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def flat_name(path: Column) -> Column:
    return F.translate(path, "/", "_")


def content_key(*parts: Column) -> Column:
    """SHA-256 over the parts, each ended by a zero byte; null counts as empty."""
    return F.sha2(F.concat(*[F.concat(F.coalesce(p.cast("string"), F.lit("")), F.decode(F.unhex(F.lit("00")), "utf-8")) for p in parts]).cast("binary"), 256)


def first_object(text: Column) -> Column:
    """From the first opening to the last closing brace, if it parses as JSON."""
    block = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(block).isNotNull() & (block != ""), block)


def even_rows(n: Column, total: Column) -> Column:
    """n row numbers spread evenly over total rows (0-based), halves to even; all rows if there are no more."""
    step = (total - 1) / F.greatest(n - 1, F.lit(1))
    few = F.sequence(F.lit(0).cast("bigint"), n - 1)
    return F.when(total <= n, F.sequence(F.lit(0).cast("bigint"), total - 1)).when(n == 1, F.array(F.lit(0).cast("bigint"))).otherwise(
        F.array_distinct(F.transform(few, lambda i: F.bround(i * step).cast("bigint")))
    )


def pack_quat(q: Column) -> Column:
    """A unit quaternion in 32 bits: which part is largest (two bits, the first of equal ones), and the other three, in order, in ten bits each."""
    parts = F.array(*[q[c] for c in "wxyz"])

    def word(v: Column) -> Column:
        size = F.transform(v, lambda x: F.abs(x))
        at = (F.array_position(size, F.array_max(size)) - 1).cast("int")
        sign = F.when(v[at] < 0, -1.0).otherwise(1.0)
        codes = F.transform(v, lambda x: F.greatest(F.lit(0), F.least(F.lit(1023), F.floor((x * sign * 0.5**0.5 + 0.5) * 1023 + 0.5))).cast("bigint"))
        rest = F.filter(codes, lambda _, i: i != at)
        return F.aggregate(rest, at.cast("bigint"), lambda s, c: s * 1024 + c)

    return F.element_at(F.transform(F.array(parts), word), 1)


def unpack_quat(word: Column) -> Column:
    """The quaternion of pack_quat's word (signed or not): its largest part is what the others leave of the unit length."""
    w = word.cast("bigint").bitwiseAND(0xFFFFFFFF)
    largest = F.shiftrightunsigned(w, 30).cast("int")
    small = [(F.shiftrightunsigned(w, s).bitwiseAND(1023) / 1023.0 - 0.5) * 2**0.5 for s in (20, 10, 0)]
    left = F.sqrt(F.greatest(F.lit(0.0), 1 - small[0] * small[0] - small[1] * small[1] - small[2] * small[2]))
    # Part i is the largest, or the small one that stands at its place once the largest is left out.
    parts = [F.when(largest == i, left).otherwise(F.when(largest < i, small[i - 1] if i else left).otherwise(small[min(i, 2)])) for i in range(4)]
    return F.struct(*[v.alias(c) for v, c in zip(parts, "wxyz")])
