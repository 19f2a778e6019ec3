"""All core queries by name, and the SQL beside them."""

from __future__ import annotations

from sensorloom.plans import formats, interop, more, relational, scene, timeline, training

MODULES = [formats, interop, more, relational, scene, timeline, training]


def queries() -> dict:
    out = {}
    for m in MODULES:
        out.update(m.QUERIES)
    return out


def oracle_sql() -> dict[str, str]:
    out = {}
    for m in MODULES:
        out.update(m.ORACLE)
    return out
