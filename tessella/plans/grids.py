"""Wire grids: rows of abutting wire segments with stubs of varying height on every third, and cuts in the wires. As queries a segment stands for each order
of lineitem, so that the grid grows with it, and some orders plant violations; the benchmark takes sound square grids of fixed size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import bands, boolean, drc

# Fixed values of the scale workload.
WIRE, PITCH, SEGMENT = 230, 700, 1000
TILE = 16384
THIN, TALL, SHIFTED = 97, 101, 103  # of the orders that are multiples, stubs are thin or too tall and cuts too low


def square(spark: SparkSession, n: int) -> DataFrame:
    """r, c and key of n * n segments without violations."""
    return spark.range(n * n).select(F.expr(f"id div {n}").alias("r"), (F.col("id") % n).alias("c"), F.lit(1).cast("long").alias("key"))


def of_orders(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """A segment for each order, n to a row."""
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("l_orderkey AS key").distinct().select(F.expr(f"key div {n}").alias("r"), (F.col("key") % n).alias("c"), "key")


def _box(grid: DataFrame, x1: str, y1: str, x2: str, y2: str) -> DataFrame:
    return grid.select(F.lit(1).alias("layer"), *(F.expr(v).cast("long").alias(k) for k, v in (("x1", x1), ("y1", y1), ("x2", x2), ("y2", y2))))


def wires(grid: DataFrame) -> DataFrame:
    stub = grid.where("(r + c) % 3 = 0").withColumns({"x": F.expr(f"c * {SEGMENT} + if(key % {THIN} = 0, 500, 200)"), "w": F.expr(f"if(key % {THIN} = 0, 200, {WIRE})"), "h": F.expr(f"150 + (r * 31 + c * 17) % 50 + if(key % {TALL} = 0, 100, 0)")})
    return _box(grid, f"c * {SEGMENT}", f"r * {PITCH}", f"c * {SEGMENT} + {SEGMENT}", f"r * {PITCH} + {WIRE}").unionByName(_box(stub, "x", f"r * {PITCH} + {WIRE}", "x + w", f"r * {PITCH} + {WIRE} + h"))


def cuts(grid: DataFrame) -> DataFrame:
    low = f"r * {PITCH} + if(key % {SHIFTED} = 0, 3, 5)"
    return _box(grid.where("(r + c) % 3 = 0"), f"c * {SEGMENT} + 205", low, f"c * {SEGMENT} + 425", f"{low} + {WIRE - 10}")


def merged(grid: DataFrame) -> DataFrame:
    return bands.union_bands(wires(grid), ["layer"], TILE, wide=False).agg(F.count("*").alias("bands"), boolean.area())


def violations(grid: DataFrame) -> DataFrame:
    """check, violations of the three checks on one plane."""
    w = wires(grid)
    found = {"self_space": drc.self_space(w, ["layer"], WIRE, TILE, wide=False), "width": drc.width(w, ["layer"], WIRE, TILE, wide=False), "enclosure": drc.enclosure(w, cuts(grid), ["layer"], 5, TILE, wide=False)}
    out = None
    for name, df in found.items():
        one = df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")
        out = one if out is None else out.unionByName(one)
    return out


def _sql(n: int) -> str:
    return f"g AS (SELECT DISTINCT l_orderkey AS key, l_orderkey // {n} AS r, l_orderkey % {n} AS c FROM lineitem), stubs AS (SELECT * FROM g WHERE (r + c) % 3 = 0)"


def merged_sql(n: int) -> str:
    """Segments that abut are one band, stubs one each; areas by plain sums, since stubs lie on their wires."""
    runs = "SELECT count(*) FROM (SELECT CASE WHEN lag(c) OVER (PARTITION BY r ORDER BY c) = c - 1 THEN 0 ELSE 1 END AS new FROM g) WHERE new = 1"
    stub = f"sum(CASE WHEN key % {THIN} = 0 THEN 200 ELSE {WIRE} END * (150 + (r * 31 + c * 17) % 50 + CASE WHEN key % {TALL} = 0 THEN 100 ELSE 0 END))"
    return f"WITH {_sql(n)} SELECT (({runs}) + (SELECT count(*) FROM stubs))::BIGINT AS bands, ((SELECT count(*) FROM g) * {SEGMENT * WIRE} + (SELECT {stub} FROM stubs))::BIGINT AS area"


def violations_sql(n: int) -> str:
    tall = f"SELECT count(*) FROM stubs s WHERE key % {TALL} = 0 AND EXISTS (SELECT 1 FROM g WHERE g.r = s.r + 1 AND g.c = s.c)"
    return f"WITH {_sql(n)} SELECT 'self_space' AS \"check\", ({tall})::BIGINT AS violations UNION ALL SELECT 'width', count(*) FROM stubs WHERE key % {THIN} = 0 UNION ALL SELECT 'enclosure', count(*) FROM stubs WHERE key % {SHIFTED} = 0"
