"""Calibrations and the extrinsic chain from body poses to camera poses."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from sensorloom.functions import geometry as geo

IDENTITY = [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]
# Keys of the stored matrices, of their direction flags, and the flags' defaults.
EXTRINSICS = {"marker": ("T_rgb_marker", "rgb_marker_direction", "cam_to_marker"), "robot": ("T_rgb_robot", "rgb_robot_direction", "cam_to_robot")}
PINHOLE_KEYS = ("fx", "fy", "cx", "cy")


@dataclass(frozen=True)
class Calibration:
    intrinsics: dict[str, float]  # fx, fy, cx, cy
    distortion: tuple[float, ...]
    width: int
    height: int
    body_from_camera: dict[str, list[float]]  # sixteen values for each body frame
    model: str = "opencv"


def _flat(value: Any) -> list[float]:
    return [float(v) for row in value for v in row] if value and isinstance(value[0], (list, tuple)) else [float(v) for v in value]


def invert(m: list[float]) -> list[float]:
    """Inverse of a rigid transform of sixteen values, on the driver."""
    r = [[m[4 * j + i] for j in range(3)] for i in range(3)]
    t = [-sum(r[i][k] * m[4 * k + 3] for k in range(3)) for i in range(3)]
    return [*r[0], t[0], *r[1], t[1], *r[2], t[2], 0.0, 0.0, 0.0, 1.0]


def multiply(a: list[float], b: list[float]) -> list[float]:
    return [sum(a[4 * i + k] * b[4 * k + j] for k in range(4)) for i in range(4) for j in range(4)]


def parse_calibration(stored: dict, config: dict) -> Calibration:
    """A calibration document with its extrinsics turned to camera-to-body.

    The direction of each stored matrix comes from the configuration's frames.extrinsic flags:
    "cam_to_..." is kept, "..._to_cam" is inverted, any other is an error. A missing matrix is
    the identity; sizes that the document lacks come from the configuration.
    """
    flags = config.get("frames", {}).get("extrinsic", {})
    bodies = {}
    for body, (key, flag, default) in EXTRINSICS.items():
        direction = flags.get(flag, default)
        if key not in stored:
            bodies[body] = list(IDENTITY)
        elif direction.startswith("cam_to_"):
            bodies[body] = _flat(stored[key])
        elif direction.endswith("_to_cam"):
            bodies[body] = invert(_flat(stored[key]))
        else:
            raise ValueError(f"unknown direction {direction!r} of {key}")
    k = _flat(stored["K"])
    sizes = config.get("intrinsics", {})
    return Calibration(
        dict(zip(PINHOLE_KEYS, (k[0], k[4], k[2], k[5]))), tuple(_flat(stored.get("dist", [0.0] * 5))), int(stored.get("width", sizes.get("image_width", 640))),
        int(stored.get("height", sizes.get("image_height", 480))), bodies, stored.get("dist_model", "opencv"),
    )


def chain(steps: list[tuple[list[float], bool]]) -> list[float]:
    """Product, left to right, of transforms (sixteen values, whether to invert)."""
    out = list(IDENTITY)
    for m, inverted in steps:
        out = multiply(out, invert(m) if inverted else m)
    return out


def constant(m: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in m])


def world_camera(world_body: Column, calibration: Calibration, config: dict) -> Column:
    """Camera-to-world transform of each body-to-world one, z up.

    The extrinsic and a constant correction (frames.extrinsic.delta_T) are folded into one
    constant; poses given with y up are turned afterwards.
    """
    frames = config.get("frames", {})
    body = frames.get("pose_frame", "marker")
    if body not in calibration.body_from_camera:
        raise ValueError(f"unknown pose frame {body!r}")
    fixed = multiply(calibration.body_from_camera[body], _flat(frames.get("extrinsic", {}).get("delta_T") or IDENTITY))
    return turn_up(geo.compose(world_body, constant(fixed)), frames.get("world_up", "z"), frames.get("target_up", "z"))


def turn_up(m: Column, up: str, target: str = "z") -> Column:
    """A transform to world with its up axis turned from y to z, or back; other axes are an error."""
    if {up, target} - {"y", "z"}:
        raise ValueError("only y and z can be up")
    if up == target:
        return m
    turn = [1, 0, 0, 0, 0, 0, -1, 0, 0, 1, 0, 0, 0, 0, 0, 1] if up == "y" else [1, 0, 0, 0, 0, 0, 1, 0, 0, -1, 0, 0, 0, 0, 0, 1]
    return geo.compose(constant([float(v) for v in turn]), m)
