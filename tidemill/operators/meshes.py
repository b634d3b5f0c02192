"""Quality and measures of triangle meshes as tables: faces (model, face_id, v) and vertices (model, v_id, x, y, z)."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.operators.ordering import percentiles
from tidemill.sources.store import written


def corners(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Triangles with their corners' coordinates: ax … cz."""
    out = faces.where(F.size("v") == 3).select("model", "face_id", *[F.get("v", F.lit(i)).alias(f"v{i}") for i in range(3)])
    for i, n in enumerate("abc"):
        p = vertices.select("model", F.col("v_id").alias(f"v{i}"), *[F.col(c).alias(n + c) for c in "xyz"])
        out = out.join(p.hint("merge"), ["model", f"v{i}"])  # sizes guessed from Parquet are far too low for a broadcast
    return out


def _minus(a: str, b: str) -> list[Column]:
    return [F.col(a + c) - F.col(b + c) for c in "xyz"]


def _cross(u: list[Column], v: list[Column]) -> list[Column]:
    return [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]


def _dot(u: list[Column], v: list[Column]) -> Column:
    return u[0] * v[0] + u[1] * v[1] + u[2] * v[2]


def edges(faces: DataFrame) -> DataFrame:
    """(model, face_id, a, b) of every face's sides, a < b."""
    n = F.size("v")
    side = F.transform("v", lambda x, i: F.struct(F.least(x, F.get("v", (i + 1) % n)).alias("a"), F.greatest(x, F.get("v", (i + 1) % n)).alias("b")))
    return faces.select("model", "face_id", F.explode(side).alias("e")).select("model", "face_id", "e.a", "e.b")


def mesh_quality(faces: DataFrame, vertices: DataFrame, thr: float) -> DataFrame:
    """A model's counts: small_faces (area below thr), short_edges (length below thr), bad_edges (not of two faces), not_triangles."""
    normal = _cross(_minus("b", "a"), _minus("c", "a"))
    small = corners(faces, vertices).groupBy("model").agg(F.count_if(F.sqrt(_dot(normal, normal)) / 2 < thr).alias("small_faces"))
    uses = edges(faces).groupBy("model", "a", "b").agg(F.count(F.lit(1)).alias("uses"))
    for n in "ab":
        uses = uses.join(vertices.select("model", F.col("v_id").alias(n), *[F.col(c).alias(n + c) for c in "xyz"]), ["model", n])
    d = _minus("a", "b")
    lines = uses.groupBy("model").agg(F.count_if(F.sqrt(_dot(d, d)) < thr).alias("short_edges"), F.count_if(F.col("uses") != 2).alias("bad_edges"))
    odd = faces.groupBy("model").agg(F.count_if(F.size("v") != 3).alias("not_triangles"))
    out = odd.join(small, "model", "left").join(lines, "model", "left")
    return out.select("model", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("small_faces", "short_edges", "bad_edges", "not_triangles")])


def mesh_measures(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """A model's volume, area, down_area (normal's z below -0.707), extents, and how far the middle of its base is from the origin."""
    a, b, c = ([F.col(n + x) for x in "xyz"] for n in "abc")
    normal = _cross(_minus("b", "a"), _minus("c", "a"))
    length = F.sqrt(_dot(normal, normal))
    down = F.when(F.try_divide(normal[2], length) < -0.707, length / 2).otherwise(0.0)
    sums = corners(faces, vertices).groupBy("model").agg((F.sum(_dot(a, _cross(b, c))) / 6).alias("volume"), F.sum(length / 2).alias("area"), F.sum(down).alias("down_area"))
    box = vertices.groupBy("model").agg(*[(F.max(x) - F.min(x)).alias(f"size_{x}") for x in "xyz"], ((F.max("x") + F.min("x")) / 2).alias("off_x"), ((F.max("y") + F.min("y")) / 2).alias("off_y"), F.min("z").alias("off_z"))
    return box.join(sums, "model", "left")


def duplicate_faces(faces: DataFrame) -> DataFrame:
    """Later faces with the same vertices in any order, at edges that more than two faces share."""
    e = edges(faces)
    over = e.groupBy("model", "a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 2")
    suspects = e.join(over, ["model", "a", "b"], "left_semi").select("model", "face_id").distinct()
    rows = faces.join(suspects, ["model", "face_id"], "left_semi").withColumn("key", F.array_sort("v"))
    return rows.withColumn("rn", F.row_number().over(W.partitionBy("model", "key").orderBy("face_id"))).where("rn > 1").select("model", "face_id")


def tolerance_check(deviation: DataFrame, by: list[str], value: str, tol: float, slack: float = 1.1, defects: DataFrame | None = None, extents: DataFrame | None = None, sizes: tuple[float, float] = (10.0, 300.0), ranks: Callable = percentiles) -> DataFrame:
    """A group's p99 and p999 (exact, or by ``sketches.percentiles`` as ``ranks``), the largest value, and a status.

    PASS where p99 is within ``slack`` times tol, p999 within twice that, and the group has no more defects than before, of
    any kind (``defects``: the group's columns, before, after, a row a kind); FAIL elsewhere, also without any value. A group whose greatest extent (``extents``: the group's
    columns, extent) lies outside ``sizes`` is SKIPPED: its scale can't be right.
    """
    rows = deviation.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    out = deviation.groupBy(*by).agg(F.max(value).alias("largest")).join(ranks(rows, by, value, {"p99": 0.99, "p999": 0.999}), by, "left")
    ok = (F.col("p99") <= tol * slack) & (F.col("p999") <= 2 * tol * slack)
    if defects is not None:
        out = out.join(defects.groupBy(*by).agg(F.bool_and(F.col("after") <= F.col("before")).alias("clean@")), by, "left")
        ok = ok & F.coalesce("clean@", F.lit(True))
    status = F.when(F.coalesce(ok, F.lit(False)), "PASS").otherwise("FAIL")
    if extents is not None:
        out = out.join(extents.select(*by, (~F.col("extent").between(*sizes)).alias("odd@")), by, "left")
        status = F.when(F.col("odd@"), "SKIPPED").otherwise(status)
    return out.select(*by, "p99", "p999", "largest", status.alias("status"))


def cell(x: Column, size: float) -> Column:
    return F.floor(x / size).cast("long")


def within_radius(points: DataFrame, seeds: DataFrame, r: float) -> DataFrame:
    """Points (model, p_id, x, y, z) at most r from a seed (model, x, y, z): grid cells of side r make it an equi-join."""
    near = F.transform(F.sequence(F.lit(0), F.lit(26)), lambda k: F.struct(*[(F.floor(k / 3**i).cast("long") % 3 - 1).alias(f"d{c}") for i, c in enumerate("xyz")]))
    s = seeds.select("model", *[F.col(c).alias(f"s{c}") for c in "xyz"], F.explode(near).alias("d"))
    s = s.select("model", "sx", "sy", "sz", *[(cell(F.col(f"s{c}"), r) + F.col(f"d.d{c}")).alias(f"c{c}") for c in "xyz"])
    p = points.withColumns({f"c{c}": cell(F.col(c), r) for c in "xyz"})
    close = sum((F.col(c) - F.col(f"s{c}")) ** 2 for c in "xyz") <= r * r
    on = (p["model"] == s["model"]) & (p["cx"] == s["cx"]) & (p["cy"] == s["cy"]) & (p["cz"] == s["cz"]) & close
    return p.join(s, on, "left_semi").select(*points.columns)


def halo(points: DataFrame, seeds: DataFrame, strength: str, least: float, r: float, cap: float, tries: int = 3) -> tuple[DataFrame, float, float]:
    """Points near seeds stronger than ``least``; while they are more than ``cap`` of all, twice the seeds' threshold and 0.6 of the radius."""
    total = points.count()
    for k in range(tries):
        out = within_radius(points, seeds.where(F.col(strength) > least), r)
        if k == tries - 1 or out.count() <= cap * total:
            break
        least, r = 2 * least, 0.6 * r
    return out, least, r


def _to_triangle(p: list[Column], a: list[Column], b: list[Column], c: list[Column]) -> Column:
    """Squared distance from a point to a triangle: to its plane where the foot lies inside, else to the nearest side."""
    sub = lambda u, v: [x - y for x, y in zip(u, v, strict=True)]
    n = _cross(sub(b, a), sub(c, a))
    nn = _dot(n, n)
    within = F.lit(True)
    sides = []
    for u, v in ((a, b), (b, c), (c, a)):
        edge, rel = sub(v, u), sub(p, u)
        within = within & (_dot(_cross(edge, rel), n) >= 0)
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(_dot(edge, rel), _dot(edge, edge)), F.lit(0.0))))
        d = [r - t * e for r, e in zip(rel, edge, strict=True)]
        sides.append(_dot(d, d))
    h = _dot(sub(p, a), n)
    return F.when((nn > 0) & within, h * h / nn).otherwise(F.least(*sides))


#: Levels of cells: a cell of level L has sides of 2**L.
LEAST_LEVEL, MOST_LEVEL = -60, 60


def _at_level(x: Column, level: Column | int) -> Column:
    return F.floor(x * F.pow(F.lit(2.0), -level if isinstance(level, Column) else F.lit(-level))).cast("long")


def levelled(triangles: DataFrame) -> DataFrame:
    """Triangles with their boxes (lo_, hi_) and the level of the smallest cells that are as wide as the box."""
    out = triangles
    for c in "xyz":
        out = out.withColumns({f"lo_{c}": F.least(*[F.col(n + c) for n in "abc"]), f"hi_{c}": F.greatest(*[F.col(n + c) for n in "abc"])})
    extent = F.greatest(*[F.col(f"hi_{c}") - F.col(f"lo_{c}") for c in "xyz"])
    level = F.when(extent > 2.0**LEAST_LEVEL, F.ceil(F.log2(extent) - 1e-9)).otherwise(LEAST_LEVEL)
    level = level + (extent > F.pow(F.lit(2.0), level)).cast("int")  # where the logarithm's rounding came out too low
    return out.withColumn("level", F.least(level, F.lit(MOST_LEVEL)).cast("int"))


def surface_distance(points: DataFrame, triangles: DataFrame, size: float | None = None, most_rounds: int = 120) -> DataFrame:
    """Each point (model, p_id, x, y, z) with its distance to the nearest of its model's triangles (ax … cz).

    A triangle stands once, in the cell that holds its box's middle, on the level of its own size or, if that is finer, on
    the level twice as wide as the round's radius. Cells are twice as wide as their level, so whatever is within the radius has its
    middle in the one or two cells along each axis around a point, on each level there is. A pair whose box is farther than the radius is dropped before
    its distance is computed. Joins are by sorting: neither points nor triangles are ever broadcast, however small their files look. Points with nothing within the radius look again within twice of it, until none is left.
    The first radius is about ``size``, or half the side of the cells of the middle triangle. Points of models without
    triangles, or without finite coordinates, are left out.
    """
    finite = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in "xyz"]
    known = written(levelled(triangles), "triangles")
    left = points.where(finite[0] & finite[1] & finite[2]).join(known.select("model").distinct(), "model", "left_semi")
    counts = sorted((r["level"], r["count"]) for r in known.groupBy("level").count().collect())  # at most as many rows as there are levels
    if not counts:
        return left.select("model", "p_id", F.lit(None).cast("double").alias("distance"))
    half, levels = sum(n for _, n in counts) / 2, [k for k, _ in counts]
    middle = next(k for i, (k, _) in enumerate(counts) if sum(n for _, n in counts[: i + 1]) >= half)
    least = middle if size is None else max(LEAST_LEVEL, min(MOST_LEVEL, math.ceil(math.log2(size)) + 1))
    d2 = _to_triangle(*[[F.col(n + c) for c in "xyz"] for n in ("", "a", "b", "c")])
    outside = [F.greatest(F.col(f"lo_{c}") - F.col(c), F.col(c) - F.col(f"hi_{c}"), F.lit(0.0)) for c in "xyz"]
    out = None
    for level in range(least, least + most_rounds):
        r = 2.0 ** (level - 1)
        t = known.withColumn("level", F.greatest("level", F.lit(level)))
        p = left.withColumn("level", F.explode(F.array(*[F.lit(k) for k in sorted({max(k, level) for k in levels})])))
        reach = r + F.pow(F.lit(2.0), F.col("level")) / 2
        for c in "xyz":
            t = t.withColumn(f"g{c}", _at_level((F.col(f"lo_{c}") + F.col(f"hi_{c}")) / 2, F.col("level") + 1))
            p = p.withColumn(f"g{c}", F.explode(F.sequence(_at_level(F.col(c) - reach, F.col("level") + 1), _at_level(F.col(c) + reach, F.col("level") + 1))))
        near = p.join(t.hint("merge"), ["model", "level", "gx", "gy", "gz"]).where(_dot(outside, outside) <= r * r)
        near = near.groupBy("model", "p_id").agg(F.sqrt(F.min(d2)).alias("distance"))
        found = written(left.join(near.hint("merge"), ["model", "p_id"], "left"), "distances")
        sure = found.where(F.col("distance") <= r).select("model", "p_id", "distance")
        out = sure if out is None else out.unionByName(sure)
        left = found.where(F.col("distance").isNull() | (F.col("distance") > r)).drop("distance")
        if left.isEmpty():
            return out
    raise RuntimeError("points are too far from every triangle; start with a larger size")


def surface_deviation(faces_a: DataFrame, vertices_a: DataFrame, faces_b: DataFrame, vertices_b: DataFrame, size: float | None = None) -> DataFrame:
    """Both directions: the distance of each vertex of either mesh to the other's surface."""
    a, b = (v.withColumnRenamed("v_id", "p_id") for v in (vertices_a, vertices_b))
    forth = surface_distance(a, corners(faces_b, vertices_b), size).withColumn("direction", F.lit("a to b"))
    back = surface_distance(b, corners(faces_a, vertices_a), size).withColumn("direction", F.lit("b to a"))
    return forth.unionByName(back)


def face_centres(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """(model, p_id, x, y, z): the middle of each triangle's corners, by its face_id."""
    return corners(faces, vertices).select("model", F.col("face_id").alias("p_id"), *[((F.col(f"a{c}") + F.col(f"b{c}") + F.col(f"c{c}")) / 3).alias(c) for c in "xyz"])


def change_deviation(faces_a: DataFrame, vertices_a: DataFrame, faces_b: DataFrame, vertices_b: DataFrame, size: float | None = None) -> DataFrame:
    """What changing mesh a into mesh b did: model, p_id, distance, kind.

    ``drift``: how far each face centre of b is from a's surface. ``loss``: how far each vertex of a is from b's surface, which
    tells of details that are gone and that no point of b can show.
    """
    drift = surface_distance(face_centres(faces_b, vertices_b), corners(faces_a, vertices_a), size).withColumn("kind", F.lit("drift"))
    loss = surface_distance(vertices_a.withColumnRenamed("v_id", "p_id"), corners(faces_b, vertices_b), size).withColumn("kind", F.lit("loss"))
    return drift.unionByName(loss)


def edge_defects(faces: DataFrame) -> DataFrame:
    """A model's edges that are not of exactly two faces (nonmanifold), and those of one face alone (boundary)."""
    uses = edges(faces).groupBy("model", "a", "b").agg(F.count(F.lit(1)).alias("uses"))
    return uses.groupBy("model").agg(F.count_if(F.col("uses") != 2).alias("nonmanifold"), F.count_if(F.col("uses") == 1).alias("boundary"))


def defect_pairs(before: DataFrame, after: DataFrame) -> DataFrame:
    """(model, defect, before, after) of both meshes' edge defects, as ``tolerance_check`` takes them; a model without faces has none."""
    flat = lambda df, name: df.unpivot("model", ["nonmanifold", "boundary"], "defect", name)
    both = flat(edge_defects(before), "before").join(flat(edge_defects(after), "after"), ["model", "defect"], "full")
    return both.select("model", "defect", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("before", "after")])
