"""Colour names from a file of the usual form: red, green and blue from 0 to 255, then the name, a colour a line."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

LIMIT = 10_000  # names: a table of them travels inside an expression


def read_names(spark: SparkSession, path: str) -> dict[str, tuple[int, int, int]]:
    """Names in lower case; lines of any other form are comments, and the last of equal names counts."""
    pattern = r"^\s*(\d+)\s+(\d+)\s+(\d+)\s+(\S.*?)\s*$"
    parts = [F.regexp_extract("value", pattern, k) for k in range(1, 5)]
    lines = spark.read.text(path).where(F.regexp_like("value", F.lit(pattern))).select(*[p.cast("long") for p in parts[:3]], F.lower(parts[3]))
    rows = lines.limit(LIMIT + 1).collect()
    if len(rows) > LIMIT:
        raise ValueError(f"more than {LIMIT} names")
    return {r[3]: (r[0], r[1], r[2]) for r in rows if max(r[0], r[1], r[2]) <= 255}
