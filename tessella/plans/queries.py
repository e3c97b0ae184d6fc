"""Layout queries over the derived shapes, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import rings
from tessella.operators import bands, boolean, connectivity, drc, edges, sizing
from tessella.plans.shapes import KEYS, RINGS, SHAPES_SQL, SIDES, numbered, pair, polygons, shapes

WIDTH, SPACE, ENCLOSURE, NOTCH, GROW = 14, 4, 3, 16, 7
#: Limits for slanted edges: no distance between edges as short as these shapes' is equal to them, so two ways of rounding agree.
EDGE_SPACE, EDGE_ENCLOSURE = 4.123, 3.123
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
K = "cell_id, layer"


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# ---- SQL pieces for DuckDB ------------------------------------------------------------------------------------


def sweep_sql(rects: str, name: str = "") -> str:
    """CTEs ending in cells{name}: elementary cells with coverage a and b of a table with side."""
    n = name
    return f"""r{n} AS (SELECT * FROM {rects} WHERE x1 < x2 AND y1 < y2),
slabs{n} AS (SELECT {K}, y AS lo, lead(y) OVER (PARTITION BY {K} ORDER BY y) AS hi FROM (SELECT {K}, y1 AS y FROM r{n} UNION SELECT {K}, y2 FROM r{n})),
cov{n} AS (SELECT r.*, lo, hi FROM r{n} r JOIN slabs{n} s ON r.cell_id = s.cell_id AND r.layer = s.layer AND r.y1 <= lo AND r.y2 >= hi),
ev{n} AS (SELECT {K}, lo, hi, x, sum(da) AS da, sum(db) AS db FROM (SELECT {K}, lo, hi, x1 AS x, 1 - side AS da, side AS db FROM cov{n} UNION ALL SELECT {K}, lo, hi, x2, side - 1, -side FROM cov{n}) GROUP BY ALL),
cells{n} AS (SELECT * FROM (SELECT {K}, lo AS y1, hi AS y2, x AS x1, lead(x) OVER w AS x2, sum(da) OVER w AS a, sum(db) OVER w AS b FROM ev{n} WINDOW w AS (PARTITION BY {K}, lo ORDER BY x)) WHERE x2 IS NOT NULL)"""


def bands_sql(cells: str, cond: str, name: str) -> str:
    """CTE {name}: canonical bands of the cells for which cond holds."""
    return f"""{name} AS (SELECT {K}, x1, min(y1) AS y1, x2, max(y2) AS y2 FROM (SELECT *, sum(new) OVER (PARTITION BY {K}, x1, x2 ORDER BY y1) AS run FROM (SELECT *, CASE WHEN lag(y2) OVER (PARTITION BY {K}, x1, x2 ORDER BY y1) = y1 THEN 0 ELSE 1 END AS new FROM (
  SELECT {K}, y1, y2, min(x1) AS x1, max(x2) AS x2 FROM (SELECT {K}, y1, y2, x1, x2, sum(new) OVER (PARTITION BY {K}, y1 ORDER BY x1) AS run FROM (SELECT *, CASE WHEN lag(x2) OVER (PARTITION BY {K}, y1 ORDER BY x1) = x1 THEN 0 ELSE 1 END AS new FROM {cells} WHERE {cond})) GROUP BY {K}, y1, y2, run))) GROUP BY {K}, x1, x2, run)"""


SINGLE = "(SELECT *, 0 AS side FROM shapes)"
TURNED = "(SELECT cell_id, layer, y1 AS x1, x1 AS y1, y2 AS x2, x2 AS y2, 0 AS side FROM shapes)"
UNION = f"WITH {SHAPES_SQL}, {sweep_sql(SINGLE)}, {bands_sql('cells', 'a > 0', 'u')}"
BOX_AREA = "(x2 - x1) * (y2 - y1)"


def ring_sql(kind: str) -> str:
    """Edges of the polygons in the shapes: cell_id, layer, id, n, k and the end points."""
    pts = [tuple(q.replace("xm", "((x1 + x2) // 2)").replace("ym", "((y1 + y2) // 2)") for q in p.split()) for p in RINGS[kind].split(", ")]
    rows = " UNION ALL ".join(f"SELECT cell_id, layer, x1 || '_' || y1 || '_' || x2 || '_' || y2 AS id, {len(pts) - 1} AS n, {i} AS edge, {a} AS ex1, {b} AS ey1, {c} AS ex2, {d} AS ey2 FROM shapes" for i, ((a, b), (c, d)) in enumerate(zip(pts, pts[1:])))
    return f"ring AS (SELECT cell_id, layer, id, n, edge, ex1 AS x1, ey1 AS y1, ex2 AS x2, ey2 AS y2 FROM ({rows}))"


PAIR = ", ".join(drc.PAIR)
#: the lesser edge first
ORDERED = f"SELECT DISTINCT {K}, " + ", ".join(f"CASE WHEN (e2x1, e2y1, e2x2, e2y2) < (e1x1, e1y1, e1x2, e1y2) THEN {drc.PAIR[(i + 4) % 8]} ELSE {c} END AS {c}" for i, c in enumerate(drc.PAIR))


# ---- aggregates and booleans ----------------------------------------------------------------------------------


@query(f"WITH {SHAPES_SQL} SELECT {K}, sum({BOX_AREA})::BIGINT AS area, (count(*) * 4)::BIGINT AS edges, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, count(*) AS rectangles FROM shapes GROUP BY {K}")
def polygon_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = polygons(shapes(spark, sf_dir)).withColumn("m", rings.measured(F.col("points")))
    box = [f(f"m.{c}").alias(c) for c, f in (("x1", F.min), ("y1", F.min), ("x2", F.max), ("y2", F.max))]
    return p.groupBy(*KEYS).agg(F.sum("m.area").alias("area"), F.sum("m.edges").alias("edges"), *box, F.count_if("m.rectangle").alias("rectangles"))


@query(f"WITH {SHAPES_SQL}, {sweep_sql(SINGLE)} SELECT {K}, sum({BOX_AREA})::BIGINT AS area FROM cells WHERE a > 0 GROUP BY {K}")
def region_union_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bands.slab_cells(shapes(spark, sf_dir), None, KEYS).where("a > 0").groupBy(*KEYS).agg(boolean.area())


@query(f"WITH {SHAPES_SQL}, {sweep_sql(SIDES)} SELECT {K}, " + ", ".join(f"coalesce(sum({BOX_AREA}) FILTER ({cond}), 0)::BIGINT AS {name}_area" for name, cond in boolean.KEEP.items()) + f" FROM cells GROUP BY {K}")
def region_boolean_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boolean.boolean_areas(*pair(spark, sf_dir), KEYS)


def _boolean_query(operation: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return boolean.boolean(operation, *pair(spark, sf_dir), KEYS)

    run.__name__ = f"region_{operation}"
    query(f"WITH {SHAPES_SQL}, {sweep_sql(SIDES)}, {bands_sql('cells', boolean.KEEP[operation], 'o')} SELECT {K}, x1, y1, x2, y2 FROM o")(run)


for _name in boolean.KEEP:
    _boolean_query(_name)


@query(f"{UNION} SELECT {K}, x1, y1, x2, y2 FROM u")
def region_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bands.union_bands(shapes(spark, sf_dir), KEYS)


_ELL = "(SELECT cell_id, layer, x1, y1, x2, (y1 + y2) // 2 AS y2, 0 AS side FROM shapes UNION ALL SELECT cell_id, layer, x1, (y1 + y2) // 2, (x1 + x2) // 2, y2, 0 FROM shapes)"


@query(f"WITH {SHAPES_SQL}, {sweep_sql(_ELL)} SELECT {K}, sum({BOX_AREA})::BIGINT AS area FROM cells WHERE a > 0 GROUP BY {K}")
def polygon_union_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L-shaped polygons cut into bands by the even-odd rule, then united."""
    p = polygons(shapes(spark, sf_dir), "ell")
    boolean.require_manhattan(p, "left")
    return bands.slab_cells(bands.polygon_bands(p, KEYS), None, KEYS).where("a > 0").groupBy(*KEYS).agg(boolean.area())


# ---- design rules ---------------------------------------------------------------------------------------------


@query(f"WITH {SHAPES_SQL}, {sweep_sql(SINGLE)}, {bands_sql('cells', 'a > 0', 'u')}, {sweep_sql(TURNED, '2')}, {bands_sql('cells2', 'a > 0', 'v')} SELECT DISTINCT * FROM (SELECT {K}, x1 AS e1x1, y1 AS e1y1, x1 AS e1x2, y2 AS e1y2, x2 AS e2x1, y1 AS e2y1, x2 AS e2x2, y2 AS e2y2 FROM u WHERE x2 - x1 < {WIDTH} UNION ALL SELECT {K}, y1, x1, y2, x1, y1, x2, y2, x2 FROM v WHERE x2 - x1 < {WIDTH})")
def width_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drc.width(shapes(spark, sf_dir), KEYS, WIDTH)


def gaps_sql(a: str, b: str, cover: str, limit: int) -> str:
    """Violations between the rectangles of a and b whose gap isn't filled by the disjoint bands of cover."""
    both = f"{a} a JOIN {b} b ON a.cell_id = b.cell_id AND a.layer = b.layer"
    key = "a.cell_id, a.layer"
    lo, hi = "greatest(a.y1, b.y1)", "least(a.y2, b.y2)"
    side = f"SELECT {key}, xa AS e1x1, lo AS e1y1, xa AS e1x2, hi AS e1y2, xb AS e2x1, lo AS e2y1, xb AS e2x2, hi AS e2y2 FROM (SELECT {key}, a.x2 AS xa, b.x1 AS xb, {lo} AS lo, {hi} AS hi FROM {both} WHERE a.x2 < b.x1 UNION ALL SELECT {key}, a.x1, b.x2, {lo}, {hi} FROM {both} WHERE b.x2 < a.x1) a WHERE lo < hi AND abs(xa - xb) < {limit}"
    lo, hi = "greatest(a.x1, b.x1)", "least(a.x2, b.x2)"
    up = f"SELECT {key}, lo AS e1x1, ya AS e1y1, hi AS e1x2, ya AS e1y2, lo AS e2x1, yb AS e2y1, hi AS e2x2, yb AS e2y2 FROM (SELECT {key}, a.y2 AS ya, b.y1 AS yb, {lo} AS lo, {hi} AS hi FROM {both} WHERE a.y2 < b.y1 UNION ALL SELECT {key}, a.y1, b.y2, {lo}, {hi} FROM {both} WHERE b.y2 < a.y1) a WHERE lo < hi AND abs(ya - yb) < {limit}"
    ax, ay, bx, by = "CASE WHEN b.x1 > a.x2 THEN a.x2 ELSE a.x1 END", "CASE WHEN b.y1 > a.y2 THEN a.y2 ELSE a.y1 END", "CASE WHEN b.x1 > a.x2 THEN b.x1 ELSE b.x2 END", "CASE WHEN b.y1 > a.y2 THEN b.y1 ELSE b.y2 END"
    corner = f"SELECT {key}, {ax}, {ay}, {ax}, {ay}, {bx}, {by}, {bx}, {by} FROM {both} WHERE (b.x1 > a.x2 OR a.x1 > b.x2) AND (b.y1 > a.y2 OR a.y1 > b.y2) AND greatest(b.x1 - a.x2, a.x1 - b.x2)**2 + greatest(b.y1 - a.y2, a.y1 - b.y2)**2 < {limit * limit}"
    xs, ys = ("e1x1, e1x2, e2x1, e2x2", "e1y1, e1y2, e2y1, e2y2")
    return f"""gaps AS (SELECT *, least({xs}) AS x1, greatest({xs}) AS x2, least({ys}) AS y1, greatest({ys}) AS y2 FROM (SELECT DISTINCT * FROM ({side} UNION ALL {up} UNION ALL {corner}))),
open AS (SELECT g.* FROM gaps g LEFT JOIN {cover} c ON g.cell_id = c.cell_id AND g.layer = c.layer AND g.x1 < c.x2 AND c.x1 < g.x2 AND g.y1 < c.y2 AND c.y1 < g.y2
  GROUP BY ALL HAVING sum(CASE WHEN c.x1 IS NULL THEN 0 ELSE (least(g.x2, c.x2) - greatest(g.x1, c.x1)) * (least(g.y2, c.y2) - greatest(g.y1, c.y1)) END) < (g.x2 - g.x1) * (g.y2 - g.y1))
{ORDERED} FROM open"""


@query(f"{UNION}, {gaps_sql('u', 'u', 'u', SPACE)}")
def self_space_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drc.self_space(shapes(spark, sf_dir), KEYS, SPACE)


@query(f"WITH {SHAPES_SQL}, lo AS (SELECT * FROM {SIDES} WHERE side = 0), up AS (SELECT * FROM {SIDES} WHERE side = 1), {sweep_sql(SIDES)}, {bands_sql('cells', 'a > 0 OR b > 0', 'u')}, {gaps_sql('lo', 'up', 'u', SPACE)}")
def space_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drc.space(*pair(spark, sf_dir), KEYS, SPACE)


def _margin_sql(n: str, turned: bool) -> str:
    runs = "(SELECT cell_id, layer, y1, y2, min(x1) AS x1, max(x2) AS x2 FROM (SELECT *, sum(new) OVER (PARTITION BY cell_id, layer, y1 ORDER BY x1) AS run FROM (SELECT *, CASE WHEN lag(x2) OVER (PARTITION BY cell_id, layer, y1 ORDER BY x1) = x1 THEN 0 ELSE 1 END AS new FROM cells{n} WHERE {c} > 0)) GROUP BY cell_id, layer, y1, y2, run)"
    met = f"FROM {runs.format(n=n, c='a')} o JOIN {runs.format(n=n, c='b')} i ON o.cell_id = i.cell_id AND o.layer = i.layer AND o.y1 = i.y1 AND o.x1 <= i.x1 AND o.x2 >= i.x2"
    row = "o.cell_id, o.layer, {a}, o.y1, {a}, o.y2, {b}, o.y1, {b}, o.y2" if not turned else "o.cell_id, o.layer, o.y1, {a}, o.y2, {a}, o.y1, {b}, o.y2, {b}"
    return f"SELECT {row.format(a='o.x1', b='i.x1')} {met} WHERE i.x1 - o.x1 < {ENCLOSURE} UNION ALL SELECT {row.format(a='i.x2', b='o.x2')} {met} WHERE o.x2 - i.x2 < {ENCLOSURE}"


_TURN = "(SELECT cell_id, layer, y1 AS x1, x1 AS y1, y2 AS x2, x2 AS y2, side FROM {})"
_INSIDE = f"(SELECT cell_id, layer, x1, y1, x2, y2, 0 AS side FROM {SIDES} WHERE side = 0 UNION ALL SELECT cell_id, layer, x1, y1, x2, y2, 1 FROM inside)"


@query(f"WITH {SHAPES_SQL}, {sweep_sql(SIDES, '0')}, {bands_sql('cells0', 'a > 0 AND b > 0', 'inside')}, {bands_sql('cells0', 'b > 0 AND a = 0', 'bare')}, {sweep_sql(_INSIDE, '1')}, {sweep_sql(_TURN.format(_INSIDE), '2')} SELECT DISTINCT * FROM (SELECT {K}, x1 AS e1x1, y1 AS e1y1, x1 AS e1x2, y2 AS e1y2, x2 AS e2x1, y1 AS e2y1, x2 AS e2x2, y2 AS e2y2 FROM bare UNION ALL {_margin_sql('1', False)} UNION ALL {_margin_sql('2', True)})")
def enclosure_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drc.enclosure(*pair(spark, sf_dir), KEYS, ENCLOSURE)


# ---- edges ----------------------------------------------------------------------------------------------------

_BOTH = "e.x1 AS a_x, e.y1 AS a_y, e.x2 AS b_x, e.y2 AS b_y, f.x1 AS c_x, f.y1 AS c_y, f.x2 AS d_x, f.y2 AS d_y"
_OUT = "a_x AS e1x1, a_y AS e1y1, b_x AS e1x2, b_y AS e1y2, c_x AS e2x1, c_y AS e2y1, d_x AS e2x2, d_y AS e2y2"


def edge_distance_sql(metric: str, pairs: str, carried: str) -> str:
    """CTEs ending in far: the edge pairs (a to b, c to d, with a number no) of a table, the columns carried, and their distance."""
    legs = (("c", "a", "b"), ("d", "a", "b"), ("a", "c", "d"), ("b", "c", "d"))  # a point, and the segment it is seen from
    if metric == "square":
        spots = {s: [(f"{p}_x", f"{p}_y") for p in ends] + [tuple(f"trunc(({ends[0]}_{c} + {ends[1]}_{c}) / 2)::BIGINT" for c in "xy")] for s, ends in (("e", "ab"), ("f", "cd"))}
        apart = ", ".join(f"greatest(abs({px} - {qx}), abs({py} - {qy}))" for px, py in spots["e"] for qx, qy in spots["f"])
        return f"far AS (SELECT {carried}, {_OUT}, least({apart}) AS d FROM {pairs})"
    if metric == "projection":
        leg = lambda p, q, r: f"CASE WHEN {r}_x = {q}_x AND {r}_y = {q}_y THEN abs({p}_y - {q}_y)::DOUBLE ELSE abs(({r}_x - {q}_x) * ({p}_y - {q}_y) - ({r}_y - {q}_y) * ({p}_x - {q}_x)) / sqrt((({r}_x - {q}_x) ** 2 + ({r}_y - {q}_y) ** 2)::DOUBLE) END"
        return f"far AS (SELECT {carried}, {_OUT}, least({', '.join(leg(*x) for x in legs)}) AS d FROM {pairs})"
    rows = " UNION ALL ".join(f"SELECT no, {p}_x - {s}_x AS wx, {p}_y - {s}_y AS wy, {t}_x - {s}_x AS ux, {t}_y - {s}_y AS uy FROM {pairs}" for p, s, t in legs)
    leg = "CASE WHEN ux * wx + uy * wy <= 0 THEN sqrt((wx * wx + wy * wy)::DOUBLE) WHEN ux * wx + uy * wy >= ux * ux + uy * uy THEN sqrt(((wx - ux) * (wx - ux) + (wy - uy) * (wy - uy))::DOUBLE) ELSE abs(ux * wy - uy * wx) / sqrt((ux * ux + uy * uy)::DOUBLE) END"
    side = lambda s, t, p: f"sign(({t}_x - {s}_x) * ({p}_y - {s}_y) - ({t}_y - {s}_y) * ({p}_x - {s}_x))"
    crossing = f"(b_x - a_x) * (d_y - c_y) <> (b_y - a_y) * (d_x - c_x) AND {side('a', 'b', 'c')} * {side('a', 'b', 'd')} <= 0 AND {side('c', 'd', 'a')} * {side('c', 'd', 'b')} <= 0"
    return f"legs AS ({rows}), least_d AS (SELECT no, min({leg}) AS d FROM legs GROUP BY no), far AS (SELECT {carried}, {_OUT}, CASE WHEN {crossing} THEN 0 ELSE d END AS d FROM {pairs} JOIN least_d USING (no))"


def _edge_query(name: str, check: Callable, kind: str, metric: str, least_edges: int, cond: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return check(polygons(shapes(spark, sf_dir), kind), KEYS, NOTCH, metric)

    run.__name__ = f"{name}_{metric}"
    number = "row_number() OVER ()" if metric == "euclidean" else "0"
    pairs = f"pairs AS (SELECT {number} AS no, e.cell_id, e.layer, {_BOTH} FROM ring e JOIN ring f ON e.cell_id = f.cell_id AND e.layer = f.layer AND e.id = f.id AND f.edge - e.edge BETWEEN 2 AND e.n - 1 - CASE WHEN e.edge = 0 THEN 1 ELSE 0 END WHERE e.n >= {least_edges}), kept AS (SELECT * FROM pairs WHERE {cond})"
    query(f"WITH {SHAPES_SQL}, {ring_sql(kind)}, {pairs}, {edge_distance_sql(metric, 'kept', K)} SELECT {K}, {PAIR} FROM far WHERE d > 0 AND d < {NOTCH}")(run)


_AGAINST = "(b_x - a_x) * (d_x - c_x) + (b_y - a_y) * (d_y - c_y) < -0.5 * sqrt(((b_x - a_x) ** 2 + (b_y - a_y) ** 2)::DOUBLE) * sqrt(((d_x - c_x) ** 2 + (d_y - c_y) ** 2)::DOUBLE)"
for _metric in edges.METRICS:
    _edge_query("edge_width", edges.width, "kite" if _metric == "projection" else "ell", _metric, 3, "true")
    _edge_query("notch", edges.notch, "ell", _metric, 4, _AGAINST)


def _separation_query(metric: str, kind: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        a, b = (polygons(x, kind) for x in pair(spark, sf_dir))
        return edges.separation(a, b, KEYS, EDGE_SPACE, metric)

    run.__name__ = f"separation_{metric}"
    close = " AND ".join(f"least({s}.{c}1, {s}.{c}2) < greatest({t}.{c}1, {t}.{c}2) + {EDGE_SPACE}" for c in "xy" for s, t in (("e", "f"), ("f", "e")))
    number = "row_number() OVER ()" if metric == "euclidean" else "0"
    pairs = f"pairs AS (SELECT {number} AS no, e.cell_id, e.layer, {_BOTH} FROM ring e JOIN ring f ON e.cell_id = f.cell_id AND e.layer + 1 = f.layer WHERE e.layer <= 6 AND {close})"
    query(f"WITH {SHAPES_SQL}, {ring_sql(kind)}, {pairs}, {edge_distance_sql(metric, 'pairs', K)} SELECT {K}, {PAIR} FROM far WHERE d > 0 AND d < {EDGE_SPACE}")(run)


for _metric in ("euclidean", "square"):
    _separation_query(_metric, "triangle")


def _edge_enclosure_query(metric: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        outer, inner = (polygons(x, "ell") for x in pair(spark, sf_dir))
        found = edges.enclosure(outer, inner, KEYS, EDGE_ENCLOSURE, metric)
        return found.groupBy(*KEYS, *drc.PAIR[:4]).agg(F.count("*").alias("outer_polygons"))  # which of two edges as near is named depends on rounding

    run.__name__ = f"edge_enclosure_{metric}"
    close = " AND ".join(f"least({s}.{c}1, {s}.{c}2) < greatest({t}.{c}1, {t}.{c}2) + {EDGE_ENCLOSURE}" for c in "xy" for s, t in (("e", "f"), ("f", "e")))
    pairs = f"pairs AS (SELECT row_number() OVER () AS no, f.cell_id, f.layer, e.id AS ip, e.edge AS ie, f.id AS op, f.edge AS oe, {_BOTH} FROM ring e JOIN ring f ON e.cell_id = f.cell_id AND e.layer = f.layer + 1 WHERE f.layer <= 6 AND {close})"
    query(f"WITH {SHAPES_SQL}, {ring_sql('ell')}, {pairs}, {edge_distance_sql(metric, 'pairs', K + ', ip, ie, op, oe')} SELECT {K}, {', '.join(drc.PAIR[:4])}, count(*) AS outer_polygons FROM (SELECT DISTINCT {K}, ip, ie, op, {', '.join(drc.PAIR[:4])} FROM far WHERE d < {EDGE_ENCLOSURE}) GROUP BY ALL")(run)


for _metric in ("euclidean", "square"):
    _edge_enclosure_query(_metric)


@query(f"WITH {SHAPES_SQL}, v AS (SELECT {K}, unnest([x1, x2, x2, x1]) AS x, unnest([y1, y1, y2, y2]) AS y FROM shapes) SELECT {K}, x AS e1x1, y AS e1y1, x AS e1x2, y AS e1y2, (x + 2) // 5 * 5 AS e2x1, (y + 5) // 10 * 10 AS e2y1, (x + 2) // 5 * 5 AS e2x2, (y + 5) // 10 * 10 AS e2y2 FROM v WHERE x % 5 <> 0 OR y % 10 <> 0")
def grid_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.grid(polygons(shapes(spark, sf_dir)), KEYS, 5, 10)


@query(f"WITH {SHAPES_SQL} SELECT {K}, x2 AS e1x1, y1 AS e1y1, x1 AS e1x2, y2 AS e1y2, x2 AS e2x1, y1 AS e2y1, x1 AS e2x2, y2 AS e2y2 FROM shapes WHERE round(degrees(atan2(y2 - y1, x1 - x2))) NOT IN (0, 90, 135)")
def angle_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.angle(polygons(shapes(spark, sf_dir), "triangle"), KEYS, [0, 45, 90, 135])


# ---- sizing, components, containment --------------------------------------------------------------------------


@query(f"WITH {SHAPES_SQL}, {sweep_sql(f'(SELECT cell_id, layer, x1 - {GROW} AS x1, y1 - {GROW} AS y1, x2 + {GROW} AS x2, y2 + {GROW} AS y2, 0 AS side FROM shapes)')}, {bands_sql('cells', 'a > 0', 'o')} SELECT {K}, x1, y1, x2, y2 FROM o")
def region_grown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sizing.sized(shapes(spark, sf_dir), KEYS, GROW)


_FRAME = "(SELECT cell_id, layer, min(x1) - 1 AS x1, min(y1) - 1 AS y1, max(x2) + 1 AS x2, max(y2) + 1 AS y2, 0 AS side FROM shapes GROUP BY cell_id, layer UNION ALL SELECT *, 1 FROM shapes)"
_BITE = f"(SELECT *, 0 AS side FROM shapes UNION ALL SELECT cell_id, layer, x1 - {GROW}, y1 - {GROW}, x2 + {GROW}, y2 + {GROW}, 1 FROM outside)"


@query(f"WITH {SHAPES_SQL}, {sweep_sql(_FRAME, '0')}, {bands_sql('cells0', 'a > 0 AND b = 0', 'outside')}, {sweep_sql(_BITE, '1')}, {bands_sql('cells1', 'a > 0 AND b = 0', 'o')} SELECT {K}, x1, y1, x2, y2 FROM o")
def region_shrunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sizing.sized(shapes(spark, sf_dir), KEYS, -GROW)


def _reach_sql(nodes: str) -> str:
    """CTEs t (links), w (reachable nodes) and c (component of each node) of a table with a numeric id."""
    ox, oy = "least(x.x2, y.x2) - greatest(x.x1, y.x1)", "least(x.y2, y.y2) - greatest(x.y1, y.y1)"
    return f"""t AS (SELECT x.cell_id, x.layer, x.id AS a, y.id AS b FROM {nodes} x JOIN {nodes} y ON x.cell_id = y.cell_id AND x.layer = y.layer AND x.id <> y.id AND {ox} >= 0 AND {oy} >= 0 AND ({ox} > 0 OR {oy} > 0)),
w AS (SELECT {K}, id AS a, id AS c FROM {nodes} UNION SELECT w.cell_id, w.layer, t.a, w.c FROM w JOIN t ON t.cell_id = w.cell_id AND t.layer = w.layer AND t.b = w.a WHERE w.c < t.a),
c AS (SELECT {K}, a, min(c) AS c FROM w GROUP BY {K}, a)"""


@query(f"WITH RECURSIVE {SHAPES_SQL}, n AS (SELECT *, ((x1 * 400 + y1) * 64 + (x2 - x1 - 10)) * 64 + (y2 - y1 - 10) AS id FROM shapes), {_reach_sql('n')} SELECT {K}, count(*) AS shapes, count(DISTINCT c) AS components, sum(c)::BIGINT AS labels FROM c GROUP BY {K}")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = connectivity.components(numbered(shapes(spark, sf_dir)), KEYS, "poly_idx")
    return c.groupBy(*KEYS).agg(F.count("*").alias("shapes"), F.count_distinct("component").alias("components"), F.sum("component").alias("labels"))


_HOLE = "(SELECT *, ((x1 + 1) * 1000 + y1 + 1) * 1000000 + (x2 * 1000 + y2) AS id FROM outside)"


@query(f"WITH RECURSIVE {SHAPES_SQL}, {sweep_sql(_FRAME, '0')}, {bands_sql('cells0', 'a > 0 AND b = 0', 'outside')}, n AS (SELECT * FROM {_HOLE}), {_reach_sql('n')}, p AS (SELECT n.cell_id, n.layer, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, sum({BOX_AREA})::BIGINT AS area FROM n JOIN c ON n.cell_id = c.cell_id AND n.layer = c.layer AND n.id = c.a GROUP BY n.cell_id, n.layer, c) SELECT p.* FROM p JOIN (SELECT {K}, min(x1) AS fx1, min(y1) AS fy1, max(x2) AS fx2, max(y2) AS fy2 FROM shapes GROUP BY {K}) f USING (cell_id, layer) WHERE x1 >= fx1 AND y1 >= fy1 AND x2 <= fx2 AND y2 <= fy2")
def region_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connectivity.holes(shapes(spark, sf_dir), KEYS)


@query(f"WITH {SHAPES_SQL}, p AS (SELECT DISTINCT cell_id, layer, x1 AS x, y2 AS y FROM {SIDES} WHERE side = 1) SELECT p.* FROM p SEMI JOIN {SIDES} s ON p.cell_id = s.cell_id AND p.layer = s.layer AND s.side = 0 AND x BETWEEN x1 AND x2 AND y BETWEEN y1 AND y2")
def contained_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners of the upper layer in or on polygons of the lower."""
    a, b = pair(spark, sf_dir)
    return connectivity.contained(b.select(*KEYS, F.col("x1").alias("x"), F.col("y2").alias("y")).distinct(), polygons(a), KEYS)


_CUT = "sign((r.x1 - r.x2) * (y - r.y2)) * sign(r.y1 - r.y2) * (abs((r.x1 - r.x2) * (y - r.y2)) // abs(r.y1 - r.y2))"


@query(f"WITH {SHAPES_SQL}, {ring_sql('kite')}, p AS (SELECT DISTINCT cell_id, layer - 1 AS layer, (x1 + x2) // 2 AS x, (y1 + y2) // 2 AS y FROM shapes WHERE layer >= 2) SELECT DISTINCT cell_id, layer, x, y FROM (SELECT p.cell_id, p.layer, p.x, p.y, r.id FROM p JOIN ring r ON p.cell_id = r.cell_id AND p.layer = r.layer AND (r.y1 > y) <> (r.y2 > y) AND x < {_CUT} + r.x2 GROUP BY ALL HAVING count(*) % 2 = 1)")
def contained_in_kites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Middles of the upper layer's shapes in slanted polygons of the lower."""
    a, b = pair(spark, sf_dir)
    return connectivity.contained(b.select(*KEYS, F.expr("(x1 + x2) div 2").alias("x"), F.expr("(y1 + y2) div 2").alias("y")).distinct(), polygons(a, "kite"), KEYS)
