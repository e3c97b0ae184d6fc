"""Deterministic layout geometry derived from lineitem: 67 or so rectangles for each (cell, layer) at every scale."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["cell_id", "layer"]
#: of the pairs of neighbouring layers that two-sided operators take
SIDES = "(SELECT cell_id, layer, x1, y1, x2, y2, 0 AS side FROM shapes WHERE layer <= 6 UNION ALL SELECT cell_id, layer - 1 AS layer, x1, y1, x2, y2, 1 AS side FROM shapes WHERE layer >= 2)"
_BOX = "(l_partkey * 37) % 400 AS x1, (l_suppkey * 91 + l_orderkey * 7) % 400 AS y1, (l_partkey * 37) % 400 + 10 + l_partkey % 40 AS x2, (l_suppkey * 91 + l_orderkey * 7) % 400 + 10 + l_suppkey % 40 AS y2"
SHAPES_SQL = f"shapes AS (SELECT DISTINCT l_orderkey // 117 AS cell_id, CAST(l_linenumber AS BIGINT) AS layer, {_BOX} FROM lineitem)"


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    exprs = ["l_orderkey div 117 AS cell_id", "CAST(l_linenumber AS BIGINT) AS layer", *_BOX.split(", ")]
    # a cell has 117 orders at every scale; a fixed number of tasks, since what is done with a shape takes far longer than reading it
    tasks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(*exprs).repartition(tasks, *KEYS).distinct()


def pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Rectangles of layers 1 to 6, and those of the layer above each under the same number."""
    s = shapes(spark, sf_dir)
    return s.where("layer <= 6"), s.where("layer >= 2").withColumn("layer", F.col("layer") - 1)


def numbered(rects: DataFrame) -> DataFrame:
    """With poly_idx, unique within a cell and layer."""
    return rects.withColumn("poly_idx", F.expr("((x1 * 400 + y1) * 64 + (x2 - x1 - 10)) * 64 + (y2 - y1 - 10)"))


RINGS = {
    "box": "x1 y1, x2 y1, x2 y2, x1 y2, x1 y1",
    "ell": "x1 y1, x2 y1, x2 ym, xm ym, xm y2, x1 y2, x1 y1",
    "triangle": "x1 y1, x2 y1, x1 y2, x1 y1",
    "kite": "xm y1, x2 ym, xm y2, x1 ym, xm y1",
}


def polygons(rects: DataFrame, kind: str = "box") -> DataFrame:
    """One polygon in each rectangle: its border, an L, a triangle or a kite."""
    ring = F.array(*(F.struct(F.col(x).cast("int").alias("x"), F.col(y).cast("int").alias("y")) for x, y in (p.split() for p in RINGS[kind].split(", "))))
    middle = numbered(rects).withColumns({"xm": F.expr("(x1 + x2) div 2"), "ym": F.expr("(y1 + y2) div 2")})
    return middle.select("cell_id", "layer", "poly_idx", ring.alias("points"))
