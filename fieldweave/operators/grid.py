"""Quadtree cell ids, grids, masks and distances.

A cell id has one base-4 digit per level: 0 north-east, 1 north-west, 2
south-west, 3 south-east. Instead of descending the tree, a point's column and
row numbers are computed and their bits woven together, in plain column
arithmetic. Points out of range give null.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def levels(res: float) -> int:
    """Digits of an id at a resolution in degrees."""
    return max(0, math.ceil(math.log2(180.0 / res) - 1e-12)) + 1


#: Steps that move the bits of a 32-bit number apart: shift, then mask.
_SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def _bound(x: Column, f) -> Column:
    """f(x) with x computed once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _step(shifted, shift: int, mask: int):
    return lambda v: v.bitwiseOR(shifted(v, shift)).bitwiseAND(F.lit(mask))


def _apart(x: Column) -> Column:
    """Bit k of x moved to bit 2k."""
    for shift, mask in _SPREAD:
        x = _bound(x, _step(F.shiftleft, shift, mask))
    return x


def _together(x: Column) -> Column:
    """Bit 2k of x moved to bit k."""
    x = x.bitwiseAND(F.lit(_SPREAD[-1][1]))
    for (shift, _), mask in zip(_SPREAD[::-1], [m for _, m in _SPREAD[-2::-1]] + [0xFFFFFFFF]):
        x = _bound(x, _step(F.shiftright, shift, mask))
    return x


def _weave(ix: Column, iy: Column, n: int) -> Column:
    """A digit's low bit is east xor north, its high bit is south."""
    top = F.lit((1 << n) - 1)
    pair = lambda s: _apart(s["x"].bitwiseXOR(s["y"])).bitwiseOR(F.shiftleft(_apart(s["y"].bitwiseXOR(top)), 1))
    return _bound(F.struct(ix.alias("x"), iy.alias("y")), pair)


def _unweave(code: Column, n: int) -> tuple[Column, Column]:
    iy = _together(F.shiftright(code, 1)).bitwiseXOR(F.lit((1 << n) - 1))
    return _together(code).bitwiseXOR(iy), iy


def _cell(lon: Column, lat: Column, res: float, reach: float, n: int) -> Column:
    top = (1 << n) - 1
    number = lambda x: F.least(F.greatest(F.floor((x + reach) / res), F.lit(0)), F.lit(top)).cast("long")
    return _weave(number(lon), number(lat), n)


def ll_to_qid(lon: Column, lat: Column, res: float = 0.25) -> Column:
    n = levels(res)
    inside = (F.abs(lon) <= 180) & (F.abs(lat) < 90)
    return F.when(inside, _cell(lon, lat, res, res * (1 << (n - 1)), n))


def qid_to_ll(qid: Column, res: float = 0.25) -> tuple[Column, Column]:
    """(lon, lat) of the cell's centre."""
    n = levels(res)
    reach = res * (1 << (n - 1))
    ix, iy = _unweave(qid, n)
    return ix * res - reach + res / 2, iy * res - reach + res / 2


def ll_to_qtid(lon: Column, lat: Column, level: int = 11, offset: float = 128.0, origin_lon: float = 0.0, origin_lat: float = 0.0) -> Column:
    """Ids of a tree with a given number of levels about an origin; the root spans 4 x offset degrees."""
    res = offset * 2.0 ** (2 - level)
    return _cell(lon - origin_lon, lat - origin_lat, res, 2 * offset, level)


def qtid_to_ll(qtid: Column, level: int = 11, offset: float = 128.0, origin_lon: float = 0.0, origin_lat: float = 0.0) -> tuple[Column, Column]:
    res = offset * 2.0 ** (2 - level)
    ix, iy = _unweave(qtid, level)
    return ix * res - 2 * offset + res / 2 + origin_lon, iy * res - 2 * offset + res / 2 + origin_lat


def with_lonlat(df: DataFrame, res: float = 0.25, cell: str = "qid") -> DataFrame:
    """`df` with the centre of its cell as `lon` and `lat`."""
    lon, lat = qid_to_ll(F.col(cell), res)
    return df.withColumns({"lon": lon, "lat": lat})


def make_grid(spark: SparkSession, res: float, lon_bounds: tuple[float, float] = (-180.0, 180.0), lat_bounds: tuple[float, float] = (-90.0, 90.0)) -> DataFrame:
    """(qid, lon, lat) of every cell centre in the bounds; upper bounds are exclusive."""
    nx = math.ceil((lon_bounds[1] - lon_bounds[0]) / res - 1e-9)
    ny = math.ceil((lat_bounds[1] - lat_bounds[0]) / res - 1e-9)
    ids = spark.range(nx * ny)
    lon = F.lit(lon_bounds[0] + res / 2) + (F.col("id") % nx) * res
    lat = F.lit(lat_bounds[0] + res / 2) + F.floor(F.col("id") / nx) * res
    return ids.select(lon.alias("lon"), lat.alias("lat")).select(ll_to_qid(F.col("lon"), F.col("lat"), res).alias("qid"), "lon", "lat")


def cell_polygon(lon: Column, lat: Column, res: float) -> Column:
    """The square around a centre as WKT: north-east, south-east, south-west, north-west and back."""
    h = res / 2
    corner = lambda x, y: F.format_string("%.6f %.6f", lon + x, lat + y)
    ring = [corner(h, h), corner(h, -h), corner(-h, -h), corner(-h, h), corner(h, h)]
    return F.concat(F.lit("POLYGON (("), F.concat_ws(", ", *ring), F.lit("))"))


def spread(d: DataFrame, *keys: str, rows: int = 2000) -> DataFrame:
    """`d` dealt out by `keys`, about `rows` rows to a task: for rows of few bytes and much work, which Spark would put into few tasks."""
    return d.repartition(tasks_of(d, rows), *keys)


def tasks_of(d: DataFrame, rows: int) -> int:
    """Tasks for so many rows each, the session's shuffle partitions at least."""
    return max(int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(math.ceil(d.count() / rows), 10_000))


def polygon_cells(cells: DataFrame, rings: DataFrame, res: float, buff: float = 0.0, name: str = "name", ring: str = "ring", up: int = 3, tile: int = 2000) -> DataFrame:
    """(name, qid, lon, lat) of the cells in each closed ring grown by `buff`, without pairing cells with polygons.

    Every ring is covered with blocks of the quadtree, 2**up cells wide: blocks that
    no edge comes near lie in it or out of it as a whole, others carry the edges of
    their latitudes. A block's number is the upper part of its cells' ids, so cells
    find their blocks by an equality join, and only cells of edge blocks that lie in
    the ring's bounds look at edges. Rings may run over the date line with longitudes
    beyond 180 degrees; a ring is less than 360 degrees wide. Tasks follow from the
    number of rings, which are counted at the call, and a block that more than `tile`
    rings need is parted, its cells once for each part.
    """
    tasks = tasks_of(rings, tile)
    n = levels(res)
    reach, side = res * (1 << (n - 1)), res * (1 << up)
    point = lambda i: F.element_at(ring, i)
    corners = F.size(ring)
    after = lambda i: point(F.when(i == corners, F.lit(1)).otherwise(i + 1))
    # In the cells' longitudes: a ring may lie there once more, a turn to the west or east.
    edge = lambda i: F.struct((point(i)["lon"] - F.col("turn")).alias("x1"), point(i)["lat"].alias("y1"), (after(i)["lon"] - F.col("turn")).alias("x2"), after(i)["lat"].alias("y2"))
    least = lambda c: F.array_min(F.transform(ring, lambda q: q[c]))
    most = lambda c: F.array_max(F.transform(ring, lambda q: q[c]))
    d = rings.repartition(tasks, name).filter(corners > 0).select(name, ring, least("lon").alias("x1"), most("lon").alias("x2"), least("lat").alias("y1"), most("lat").alias("y2"))
    d = d.select("*", F.explode(F.array(F.lit(-360.0), F.lit(0.0), F.lit(360.0))).alias("turn"))
    west, east = F.greatest(F.col("x1") - F.col("turn") - buff, F.lit(-180.0)), F.least(F.col("x2") - F.col("turn") + buff, F.lit(180.0))
    south, north = F.greatest(F.col("y1") - buff, F.lit(-90.0)), F.least(F.col("y2") + buff, F.lit(90.0))
    d = d.select(name, ring, "turn", west.alias("west"), east.alias("east"), south.alias("south"), north.alias("north"))
    number = lambda c: F.floor((F.col(c) + reach) / side)
    bounds = ["west", "east", "south", "north"]
    d = d.filter("west <= east and south <= north").select(name, F.transform(F.sequence(F.lit(1), corners), edge).alias("edges"), *bounds)
    d = d.select("*", F.explode(F.sequence(number("west"), number("east"))).alias("bx"))
    d = d.select("*", F.explode(F.sequence(number("south"), number("north"))).alias("by"))
    block = _weave(F.col("bx").cast("long"), F.col("by").cast("long"), n - up).alias("block")
    # By rows and columns, as their ids cost more than their count.
    dense = d.groupBy("bx", "by").agg(F.ceil(F.count("*") / tile).alias("parts")).filter("parts > 1").select(block, "parts")
    x0, y0 = F.col("bx") * side - reach, F.col("by") * side - reach
    over = lambda a, b, low, high: (F.least(a, b) <= high + buff) & (F.greatest(a, b) >= low - buff)
    beside = F.filter("edges", lambda e: over(e["y1"], e["y2"], y0, y0 + side))
    near = F.exists("edges", lambda e: over(e["x1"], e["x2"], x0, x0 + side) & over(e["y1"], e["y2"], y0, y0 + side))
    d = d.select(name, *bounds, block, F.when(near, beside).alias("some"), _inside(F.col("edges"), x0 + side / 2, y0 + side / 2).alias("whole"))
    cover = d.filter("some is not null or whole").drop("whole")
    cover = cover.join(dense, "block", "left").withColumn("part", F.pmod(F.xxhash64(name), F.coalesce("parts", F.lit(1)))).drop("parts")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)).alias("part")
    asking = cells.select("qid", "lon", "lat", F.shiftright("qid", 2 * up).alias("block")).join(dense, "block", "left").select("qid", "lon", "lat", "block", every)
    found = asking.repartition(tasks, "block", "part").join(cover.repartition(tasks, "block", "part"), ["block", "part"])
    own = _inside(F.col("some"), F.col("lon"), F.col("lat"))
    if buff > 0:
        own = own | F.exists("some", lambda e: _edge_gap(e, F.col("lon"), F.col("lat")) <= buff)
    # Plain comparisons come first; they leave room for the rounding of the exact ones.
    near = F.expr("lon >= west - 1e-9 and lon <= east + 1e-9 and lat >= south - 1e-9 and lat <= north + 1e-9")
    return found.filter(F.col("some").isNull() | (near & own)).select(name, "qid", "lon", "lat")


def _inside(edges: Column, x: Column, y: Column) -> Column:
    """Whether a line to the east crosses the edges an odd number of times."""
    crosses = lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (x < e["x1"] + F.try_divide((y - e["y1"]) * (e["x2"] - e["x1"]), e["y2"] - e["y1"]))
    return F.size(F.filter(edges, crosses)) % 2 == 1


def _edge_gap(e: Column, x: Column, y: Column) -> Column:
    dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
    along = F.least(F.greatest(F.coalesce(F.try_divide((x - e["x1"]) * dx + (y - e["y1"]) * dy, dx * dx + dy * dy), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return F.sqrt(F.pow(x - e["x1"] - along * dx, F.lit(2)) + F.pow(y - e["y1"] - along * dy, F.lit(2)))


def box_ranges(west: float, south: float, east: float, north: float, res: float = 0.25, most: int = 32) -> list[tuple[int, int]]:
    """At most `most` ranges (first, last) of cell ids that hold every cell whose centre is in the box, ends included.

    Blocks of the quadtree that lie in the box are taken whole; of the others, the
    largest is parted first, while there is room. Where west is above east the box
    runs over the date line.
    """
    if west > east:
        halves = box_ranges(west, south, 180.0, north, res, max(most // 2, 1)) + box_ranges(-180.0, south, east, north, res, max(most // 2, 1))
        return _merged(halves)
    reach = res * (1 << (levels(res) - 1))
    first = lambda x: math.ceil((x + reach) / res - 0.5 - 1e-9)
    last = lambda x: math.floor((x + reach) / res - 0.5 + 1e-9)
    x0, x1, y0, y1 = first(west), last(east), first(south), last(north)
    # A block: cells a side, then the column, row and id of its first cell.
    whole, part = [], [(1 << levels(res), 0, 0, 0)]
    while part and len(whole) + len(part) + 3 <= most:
        part.sort()
        side, x, y, code = part.pop()
        half = side // 2
        for digit, (dx, dy) in enumerate(((half, half), (0, half), (0, 0), (half, 0))):
            bx, by = x + dx, y + dy
            if bx > x1 or bx + half - 1 < x0 or by > y1 or by + half - 1 < y0:
                continue
            inside = bx >= x0 and bx + half - 1 <= x1 and by >= y0 and by + half - 1 <= y1
            (whole if inside else part).append((half, bx, by, code + digit * half * half))
    return _merged([(code, code + side * side - 1) for side, _, _, code in whole + part])


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted, with ranges that touch made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def area_weight(lat: Column) -> Column:
    return F.sqrt(F.cos(F.radians(lat)))


def haversine_km(lon_a: Column, lat_a: Column, lon_b: Column, lat_b: Column, radius: float = EARTH_KM) -> Column:
    dlat, dlon = F.radians(lat_b - lat_a), F.radians(lon_b - lon_a)
    h = F.pow(F.sin(dlat / 2), F.lit(2)) + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * F.pow(F.sin(dlon / 2), F.lit(2))
    return F.lit(2 * radius) * F.asin(F.least(F.sqrt(h), F.lit(1.0)))


def distances(a: DataFrame, b: DataFrame, key: str = "id", radius: float = EARTH_KM, tile: int = 2000) -> DataFrame:
    """(id_a, id_b, km) for every pair of two sets; for a full matrix, whose size is its purpose.

    A task has about `tile` points of `a` and as many of `b`. Each set is dealt out
    and stored once, and a task fetches its part of either, so what is stored grows
    with the points and not with their pairs. Points are small and their pairs are
    not, so the number of tasks follows from the counts of both sets, not from
    bytes; both are counted at the call.
    """
    return _with_km(_every_pair(a, b, key, tile), radius).select("id_a", "id_b", "km")


def self_distances(a: DataFrame, key: str = "id", radius: float = EARTH_KM, tile: int = 2000) -> DataFrame:
    """The full matrix of one set, dealt out as in `distances`: one half is computed, then mirrored; one id is at zero from itself."""
    half = _with_km(_every_pair(a, a, key, tile, half=True), radius)
    turned = F.when(F.col("id_a").eqNullSafe(F.col("id_b")), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))
    half = half.select("id_a", "id_b", F.when(F.col("id_a") == F.col("id_b"), F.lit(0.0)).otherwise(F.col("km")).alias("km"), F.explode(turned).alias("turned"))
    return half.select(F.when(F.col("turned"), F.col("id_b")).otherwise(F.col("id_a")).alias("id_a"), F.when(F.col("turned"), F.col("id_a")).otherwise(F.col("id_b")).alias("id_b"), "km")


def _every_pair(a: DataFrame, b: DataFrame, key: str, tile: int, half: bool = False) -> DataFrame:
    """The points of `a` beside those of `b`, 10,000 tasks at most or little more; `half` leaves out the pairs that others mirror.

    A task pairs points of `a` with small blocks of `b`, as a step for each pair
    costs more than half a distance; `half` goes by blocks, and by ids in a block.
    """
    m, n = a.count(), b.count()
    parts_a, parts_b = max(math.ceil(m / tile), 1), max(math.ceil(n / tile), 1)
    tasks = min(max(math.ceil(m * n / tile**2), 1), 10_000)
    parts_a = math.ceil(parts_a * min(math.sqrt(tasks / (parts_a * parts_b)), 1))
    parts_b = min(math.ceil(tasks / parts_a), parts_b)
    of = lambda parts: F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
    block = of(max(math.ceil(n / max(tile // 32, 1)), 1))
    left = a.repartitionById(parts_a, of(parts_a)).select(block.alias("block_a"), *_place(key, "a"))
    right = b.select(block.alias("block_b"), F.struct(*_place(key, "b")).alias("point")).repartition(parts_b, "block_b")
    pairs = left.hint("shuffle_replicate_nl").crossJoin(right.groupBy("block_b").agg(F.collect_list("point").alias("points")))
    pairs = (pairs.filter("block_a <= block_b") if half else pairs).select("block_a", "block_b", "id_a", "lon_a", "lat_a", "cos_a", F.inline("points"))
    return pairs.filter("block_a < block_b or id_a is null or id_a <= id_b") if half else pairs


def _place(key: str, s: str) -> list[Column]:
    return [F.col(key).alias(f"id_{s}"), F.col("lon").alias(f"lon_{s}"), F.col("lat").alias(f"lat_{s}"), F.cos(F.radians("lat")).alias(f"cos_{s}")]


def tiled(a: DataFrame, b: DataFrame, key: str = "id", tile: int = 2000) -> tuple[DataFrame, DataFrame]:
    """Both sets once for every tile (part_a, part_b) of their matrix, dealt out by tile; what this stores grows with the matrix, so `distances` goes without."""
    m, n = a.count(), b.count()
    parts_a, parts_b = max(math.ceil(m / tile), 1), max(math.ceil(n / tile), 1)
    tasks = min(max(math.ceil(m * n / tile**2), 1), 10_000)
    part = lambda parts: F.pmod(F.xxhash64(key), F.lit(parts)).alias("part")
    every = lambda parts: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))
    left = a.select(part(parts_a), *_place(key, "a")).select("*", every(parts_b).alias("part_b")).withColumnRenamed("part", "part_a")
    right = b.select(part(parts_b), *_place(key, "b")).select("*", every(parts_a).alias("part_a")).withColumnRenamed("part", "part_b")
    return left.repartition(tasks, "part_a", "part_b"), right.repartition(tasks, "part_a", "part_b")


#: The arcsine's rational approximation on squares up to a quarter (fdlibm's), highest power first.
_ASIN_P = (3.47933107596021167570e-05, 7.91534994289814532176e-04, -4.00555345006794114027e-02, 2.01212532134862925881e-01, -3.25565818622400915405e-01, 1.66666666666666657415e-01)
_ASIN_Q = (7.70381505559019352791e-02, -6.88283971605453293030e-01, 2.02094576023350569471e00, -2.40339491173441421878e00, 1.0)


def _with_km(pairs: DataFrame, radius: float) -> DataFrame:
    """`haversine_km` of pairs that bring their cosines, with the arcsine in plain arithmetic: the JVM's costs more than all the rest.

    Each step is a column of its own, so that nothing is computed twice.
    """
    across = lambda x: F.sin(F.radians(F.col(f"{x}_b") - F.col(f"{x}_a")) / 2)
    d = pairs.select("id_a", "id_b", across("lat").alias("u"), across("lon").alias("v"), (F.col("cos_a") * F.col("cos_b")).alias("c"))
    d = d.select("id_a", "id_b", F.least(F.expr("u * u + c * (v * v)"), F.lit(1.0)).alias("h")).withColumn("small", F.col("h") < 0.25)
    # Of large angles the rest to a right angle is halved.
    d = d.withColumn("t", F.when(F.col("small"), F.col("h")).otherwise((1 - F.sqrt("h")) / 2)).withColumn("s", F.sqrt("t"))
    power = lambda c: reduce(lambda out, k: out * F.col("t") + k, c[1:], F.lit(c[0]))
    d = d.withColumn("angle", F.col("s") + F.col("s") * (F.col("t") * power(_ASIN_P) / power(_ASIN_Q)))
    return d.select("id_a", "id_b", (F.lit(2 * radius) * F.when(F.col("small"), F.col("angle")).otherwise(F.lit(math.pi / 2) - 2 * F.col("angle"))).alias("km"))


def pairs_within(a: DataFrame, b: DataFrame, km: float, key: str = "id", radius: float = EARTH_KM, tile: int = 2000) -> DataFrame:
    """(id_a, id_b, km) of pairs at most `km` apart, by an equality join on coarse bands.

    Each point of `b` falls in one band of latitude and one bin of longitude that
    is wide enough for the band; each of `a` looks into its neighbours. Near the
    poles, where bins would be too wide, a band has a single bin. A bin with more
    than `tile` points of either set is a grid of tiles, each about `tile` points
    of `a` by as many of `b`, so a city is spread over tasks.
    """
    left, right = binned(a, b, km, key, radius, tile)
    dist = haversine_km(F.col("lon_a"), F.col("lat_a"), F.col("lon_b"), F.col("lat_b"), radius)
    return left.join(right, TILE).withColumn("km", dist).filter(F.col("km") <= km).select("id_a", "id_b", "km")


#: What two points must share to be compared.
TILE = ["band", "bin", "part_a", "part_b"]


def binned(a: DataFrame, b: DataFrame, km: float, key: str = "id", radius: float = EARTH_KM, tile: int = 2000) -> tuple[DataFrame, DataFrame]:
    """Both sets with the bands, bins and tiles in which they meet."""
    step = math.degrees(km / radius)
    band = lambda lat: F.floor((lat + 90) / step).cast("long")
    # The bins of a band fit its edge nearest to a pole.
    reach = lambda b: F.least(F.greatest(F.abs((b + 1) * step - 90), F.abs(b * step - 90)) + step, F.lit(90.0))
    sine = F.lit(math.sin(math.radians(step) / 2))
    bins = lambda b: F.greatest(F.floor(360.0 / F.degrees(2 * F.asin(F.least(sine / F.greatest(F.cos(F.radians(reach(b))), sine), F.lit(1.0))))), F.lit(1)).cast("long")
    right = b.select(F.col(key).alias("id_b"), F.col("lon").alias("lon_b"), F.col("lat").alias("lat_b"), band(F.col("lat")).alias("band"))
    right = right.withColumn("n", bins(F.col("band"))).withColumn("bin", F.floor((F.col("lon_b") + 180) * F.col("n") / 360).cast("long") % F.col("n")).drop("n")
    left = a.select(F.col(key).alias("id_a"), F.col("lon").alias("lon_a"), F.col("lat").alias("lat_a"), band(F.col("lat")).alias("own"))
    left = left.withColumn("band", F.explode(F.array(F.col("own") - 1, F.col("own"), F.col("own") + 1))).drop("own").withColumn("n", bins(F.col("band")))
    at = F.floor((F.col("lon_a") + 180) * F.col("n") / 360).cast("long")
    left = left.withColumn("bin", F.explode(F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.pmod(at + d, F.col("n")))))).drop("n")
    # Bins of more than a tile: how many parts each set has there.
    parts = lambda d, name: d.groupBy("band", "bin").agg(F.ceil(F.count("*") / tile).alias(name))
    dense = parts(left, "parts_a").join(parts(right, "parts_b"), ["band", "bin"], "full").filter("parts_a > 1 or parts_b > 1")
    return _tiled(left, dense, "a", "b"), _tiled(right, dense, "b", "a")


def _tiled(points: DataFrame, dense: DataFrame, own: str, other: str) -> DataFrame:
    """Each point in its own part, once for every part of the other set."""
    d = points.join(dense, ["band", "bin"], "left")
    part = F.pmod(F.xxhash64(f"id_{own}", f"lon_{own}", f"lat_{own}"), F.coalesce(f"parts_{own}", F.lit(1))).alias(f"part_{own}")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(f"parts_{other}", F.lit(1)) - 1)).alias(f"part_{other}")
    return d.select("band", "bin", f"id_{own}", f"lon_{own}", f"lat_{own}", part, every)
