"""Literal arrays of bounded size (grids, bitmaps) in one constant."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(values: Sequence[float | None]) -> Column:
    return F.from_json(F.lit(json.dumps([None if v is None or math.isnan(v) else float(v) for v in values])), "array<double>")


def longs(values: Sequence[int]) -> Column:
    return F.from_json(F.lit(json.dumps([int(v) for v in values])), "array<bigint>")
