"""A name for each query, with its function and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The pixel relation in SQL: each embedding is an image of 8 by 8 pixels.
PX = """px AS (SELECT image_id, grp, pixel_shift, CAST(i // 8 AS INT) AS y, CAST(i % 8 AS INT) AS x, floor((CAST(e AS DOUBLE) + 1) * 32767.5) AS v
  FROM (SELECT vec_id AS image_id, label AS grp, CAST(vec_id % 31 - 15 AS DOUBLE) AS pixel_shift, unnest(embedding) AS e, unnest(range(0, 64)) AS i FROM embeddings))"""
#: Edge-clamped 3 by 3 boxes in SQL.
BOX = """box AS (SELECT a.image_id, a.y, a.x, a.v, sum(b.v) AS s FROM px a, (VALUES (-1), (0), (1)) dy(dy), (VALUES (-1), (0), (1)) dx(dx), px b
  WHERE b.image_id = a.image_id AND b.y = least(greatest(a.y + dy, 0), 7) AND b.x = least(greatest(a.x + dx, 0), 7) GROUP BY ALL)"""


def query(sql: str | None = None) -> Callable:
    """Registers a function under its name; {px} and {box} in the SQL stand for the relations above."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql.replace("{px}", PX).replace("{box}", BOX)
        return f

    return add


def r4(v: Column) -> Column:
    """Four decimals, halves upward, as floor(v * 10000 + 0.5) / 10000 is in SQL."""
    return F.floor(v * 10000 + 0.5).cast("double") / 10000


def s4(v: str) -> str:
    return f"floor(({v}) * 10000 + 0.5) / 10000"
