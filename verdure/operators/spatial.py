"""Nearest images, distances, and joins by names and roots."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .catalog import canonical_base, stem

#: Places that a cell may hold unsplit. Bits of a cell's number below 360 degrees, in all and as added by each level.
LEAF, DEEP, STEP = 16, 51, 3


def _levels(places: DataFrame) -> list[DataFrame]:
    """A tree of cells over distinct places (ilat, ilon, filename), from the widest level on: (py, px, children) with the cells
    into which a cell is split, 64 at most.

    A cell has the bounds of the places in it. One of at most LEAF places has these as ``places``; others are split at the
    next level, up to cells of 360 / 2 ** DEEP degrees, so that depth follows the density at each spot."""
    number = lambda c: F.floor(F.col(c) / 360.0 * (1 << DEEP))
    rest, levels = places.withColumns({"qy": number("ilat"), "qx": number("ilon")}), []
    for shift in range(DEEP, -1, -STEP):
        at = rest.withColumns({"cy": F.shiftright("qy", shift), "cx": F.shiftright("qx", shift)})
        ends = [f(c).alias(n) for n, f, c in (("y0", F.min, "ilat"), ("y1", F.max, "ilat"), ("x0", F.min, "ilon"), ("x1", F.max, "ilon"))]
        cells = written(at.groupBy("cy", "cx").agg(F.count("*").alias("n"), *ends))
        dense = cells.filter((F.col("n") > LEAF) & F.lit(shift > 0)).select("cy", "cx")
        few = at.join(dense, ["cy", "cx"], "left_anti").groupBy("cy", "cx").agg(F.collect_list(F.struct("ilat", "ilon", "filename")).alias("places"))
        above = {p: F.shiftright(c, STEP) if levels else F.lit(0).cast("long") for p, c in (("py", "cy"), ("px", "cx"))}
        child = F.struct("cy", "cx", "y0", "y1", "x0", "x1", "places")
        levels.append(written(cells.join(few, ["cy", "cx"], "left").withColumns(above).groupBy("py", "px").agg(F.collect_list(child).alias("children"))))
        if dense.isEmpty():
            break
        rest = written(at.join(dense, ["cy", "cx"], "left_semi").drop("cy", "cx"))
    return levels


def nearest(targets: DataFrame, images: DataFrame) -> DataFrame:
    """(target_index, filename, degrees): the image nearest to each target in plain (latitude, longitude) degrees.

    Images of one place are one place with the least of their names. A target goes down a tree of cells: at each level it keeps
    only cells that are no farther than some place must be, and meets places in cells that hold few. So a cluster of any
    density costs each target a few cells a level, wherever the target lies. Targets of one place go down as one. Ties go to
    the lesser name. Targets without any image, and targets and images without coordinates, are left out."""
    known = lambda rows: rows.filter("latitude is not null and longitude is not null and not isnan(latitude) and not isnan(longitude)")
    places = written(known(images).groupBy(F.col("latitude").alias("ilat"), F.col("longitude").alias("ilon")).agg(F.min("filename").alias("filename")))
    lat, lon = F.col("latitude"), F.col("longitude")
    away = lambda dy, dx: F.sqrt(F.pow(dy, 2) + F.pow(dx, 2))
    outside = lambda v, lo, hi: F.greatest(lo - v, v - hi, F.lit(0.0))
    farthest = lambda v, lo, hi: F.greatest(v - lo, hi - v)

    def cell(c: Column) -> Column:
        least = away(outside(lat, c["y0"], c["y1"]), outside(lon, c["x0"], c["x1"]))
        most = away(farthest(lat, c["y0"], c["y1"]), farthest(lon, c["x0"], c["x1"]))
        return F.struct(c["cy"].alias("cy"), c["cx"].alias("cx"), least.alias("least"), most.alias("most"))

    match = lambda p: F.struct(away(lat - p["ilat"], lon - p["ilon"]).alias("degrees"), p["filename"].alias("filename"))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("struct<degrees:double,filename:string>")
    wanted = known(targets).select("target_index", lat.cast("double").alias("latitude"), lon.cast("double").alias("longitude")).distinct()
    target, done = ["latitude", "longitude"], []
    asked = written(wanted.select(*target).distinct().select(*target, none.alias("best"), F.array(F.struct(zero.alias("cy"), zero.alias("cx"))).alias("cells")))
    for level in _levels(places):
        rows = asked.select(*target, "best", F.inline("cells")).join(level, (F.col("cy") == F.col("py")) & (F.col("cx") == F.col("px")))
        split, whole = F.filter("children", lambda c: c["places"].isNull()), F.filter("children", lambda c: c["places"].isNotNull())
        met = F.array_min(F.transform(F.flatten(F.transform(whole, lambda c: c["places"])), match))
        rows = rows.select(*target, F.array_min(F.array("best", met)).alias("best"), F.transform(split, cell).alias("near"))
        rows = rows.groupBy(*target).agg(F.min("best").alias("best"), F.flatten(F.collect_list("near")).alias("near"))
        bound = F.least("best.degrees", F.array_min(F.transform("near", lambda c: c["most"]))) * (1 + 1e-12)
        kept = F.transform(F.filter("near", lambda c: c["least"] <= F.col("bound")), lambda c: F.struct(c["cy"].alias("cy"), c["cx"].alias("cx")))
        state = written(rows.withColumn("bound", bound).select(*target, "best", kept.alias("cells")))
        done.append(state.filter(F.size("cells") == 0).select(*target, "best.filename", "best.degrees"))
        asked = state.filter(F.size("cells") > 0)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return wanted.join(out, target).select("target_index", "filename", "degrees")


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6371008.8) -> Column:
    """Metres on a sphere."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def geodesic_metres(pairs: DataFrame) -> DataFrame:
    """pairs (lat1, lon1, lat2, lon2 and more columns) with ``metres`` on the WGS-84 ellipsoid, by Vincenty's inverse.

    The iteration has no Column form, so it runs over Arrow batches; use it on winners only. Nearly antipodal pairs for
    which it does not settle get NULL."""
    import numpy as np

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, f = 6378137.0, 1 / 298.257223563
        b = a * (1 - f)
        for batch in batches:
            p1, l1, p2, l2 = (np.radians(batch[c].to_numpy(float)) for c in ("lat1", "lon1", "lat2", "lon2"))
            u1, u2, big = np.arctan((1 - f) * np.tan(p1)), np.arctan((1 - f) * np.tan(p2)), l2 - l1
            lam, su1, cu1, su2, cu2 = big.copy(), np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
            with np.errstate(all="ignore"):
                for _ in range(100):
                    ss = np.hypot(cu2 * np.sin(lam), cu1 * su2 - su1 * cu2 * np.cos(lam))
                    cs = su1 * su2 + cu1 * cu2 * np.cos(lam)
                    sigma = np.arctan2(ss, cs)
                    sa = np.where(ss > 0, cu1 * cu2 * np.sin(lam) / np.where(ss > 0, ss, 1), 0.0)
                    ca2 = 1 - sa**2
                    c2m = np.where(ca2 > 1e-15, cs - 2 * su1 * su2 / np.where(ca2 > 1e-15, ca2, 1), 0.0)
                    c = f / 16 * ca2 * (4 + f * (4 - 3 * ca2))
                    last, lam = lam, big + (1 - c) * f * sa * (sigma + c * ss * (c2m + c * cs * (2 * c2m**2 - 1)))
                    if np.nanmax(np.abs(lam - last), initial=0) < 1e-12:
                        break
            w = ca2 * (a**2 - b**2) / b**2
            aa = 1 + w / 16384 * (4096 + w * (-768 + w * (320 - 175 * w)))
            bb = w / 1024 * (256 + w * (-128 + w * (74 - 47 * w)))
            ds = bb * ss * (c2m + bb / 4 * (cs * (2 * c2m**2 - 1) - bb / 6 * c2m * (4 * ss**2 - 3) * (4 * c2m**2 - 3)))
            out = batch.copy()
            metres = np.where(np.abs(lam - last) < 1e-9, b * aa * (sigma - ds), np.nan)
            out["metres"] = pd.Series(metres, index=out.index).astype(object).where(~np.isnan(metres), None)
            yield out

    return pairs.mapInPandas(run, f"{fields}, metres double")


def best_match(matches: DataFrame) -> DataFrame:
    """The match of least distance of each source file; missing distances come last, the first index on ties."""
    order = F.struct(F.coalesce("distance_meters", F.lit(float("inf"))).alias("d"), F.col("target_index"))
    return matches.groupBy("source").agg(F.min_by(F.struct("target_index", "closest_image", "distance_meters"), order).alias("m")).select("source", "m.*")


def source_polygons(wanted: DataFrame, polygons: DataFrame) -> DataFrame:
    """wanted (grp, base) with the path of its polygon file: the exact base first, else the canonical one (least path)."""
    exact = polygons.groupBy(F.col("grp").alias("g1"), F.lower("base").alias("b1")).agg(F.min("path").alias("p1"))
    canon = polygons.groupBy(F.col("grp").alias("g2"), canonical_base(F.col("base")).alias("b2")).agg(F.min("path").alias("p2"))
    rows = wanted.join(exact, (F.col("grp") == F.col("g1")) & (F.lower("base") == F.col("b1")), "left")
    rows = rows.join(canon, (F.col("grp") == F.col("g2")) & (canonical_base(F.col("base")) == F.col("b2")), "left")
    return rows.select(*wanted.columns, F.coalesce("p1", "p2").alias("path"))


def fan_out(winners: DataFrame, mapping: DataFrame) -> DataFrame:
    """(source, dest, place): all bases of the winner's root and the winner's own, without repeats by case, in order.

    winners has source and base; mapping has root_id, base and ordinal."""
    roots = mapping.groupBy(F.lower("base").alias("lb")).agg(F.max_by("root_id", "ordinal").alias("root_id"))
    rows = winners.join(roots, F.lower("base") == F.col("lb"), "left").select("source", "base", "root_id")
    wide = rows.join(mapping.select("root_id", F.col("base").alias("dest"), "ordinal"), "root_id").select("source", "dest", "ordinal")
    own = rows.select("source", F.col("base").alias("dest"), F.lit(1 << 40).alias("ordinal"))
    first = wide.unionByName(own).groupBy("source", F.lower("dest").alias("k")).agg(F.min(F.struct("ordinal", "dest")).alias("m")).select("source", "m.*")
    return first.select("source", "dest", F.row_number().over(Window.partitionBy("source").orderBy("ordinal")).alias("place"))


def provenance(rows: DataFrame, source_project: Column, target_project: Column) -> DataFrame:
    """rows with ``import_metadata``: where a copied polygon comes from and how far its match was."""
    return rows.withColumn("import_metadata", F.struct(source_project.alias("source_project"), target_project.alias("target_project"), "closest_image", "distance_meters", F.struct("latitude", "longitude").alias("target_coordinates")))


def resolved_images(names: DataFrame, catalog: DataFrame) -> DataFrame:
    """names (name without extension) with the file that it means: the exact stem, else a canonical one that holds it, else any canonical one."""
    files = catalog.select("filename", F.lower(stem(F.col("filename"))).alias("s")).withColumn("c", canonical_base(F.col("s")))
    exact = files.groupBy(F.col("s").alias("k1")).agg(F.min("filename").alias("f1"))
    q = names.withColumns({"__q": F.lower("name"), "__c": canonical_base(F.col("name"))})
    rows = q.join(exact, F.col("__q") == F.col("k1"), "left")
    near = rows.filter("f1 is null").join(files, F.col("__c") == F.col("c")).groupBy("name").agg(F.min(F.struct((~F.contains(F.col("s"), F.col("__q"))).alias("far"), F.col("filename"))).alias("m"))
    near = near.select(F.col("name").alias("n2"), F.col("m.filename").alias("f2"))
    return rows.join(near, F.col("name") == F.col("n2"), "left").select(*names.columns, F.coalesce("f1", "f2").alias("filename"))


def from_dms(degrees: Column, minutes: Column, seconds: Column, ref: Column) -> Column:
    """Signed decimal degrees; south and west are negative."""
    value = degrees + minutes / 60.0 + seconds / 3600.0
    return F.when(F.upper(ref).isin("S", "W"), -value).otherwise(value)


def copied(polygons: DataFrame, groups: list[str], target_root: str, offsets: DataFrame) -> DataFrame:
    """Polygons of the groups' majority root copied to another root; entries already there are kept, not overwritten.

    offsets (image_id, target_image) pairs images of both roots. Ties between roots go to the lesser name."""
    some = polygons.filter(F.col("grp").isin(groups))
    root = some.groupBy("root").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "root").limit(1).select(F.col("root").alias("__root"))
    source = some.join(F.broadcast(root), F.col("root") == F.col("__root")).drop("__root")
    new = source.join(offsets, "image_id").withColumns({"image_id": F.col("target_image"), "root": F.lit(target_root)}).drop("target_image")
    new = new.join(polygons.select("grp", "image_id", "name"), ["grp", "image_id", "name"], "left_anti")
    return polygons.unionByName(new.select(*polygons.columns))


def moved(polygons: DataFrame, groups: list[str], target_root: str, offsets: DataFrame) -> DataFrame:
    """As :func:`copied`, without the source entries."""
    every = copied(polygons, groups, target_root, offsets)
    gone = polygons.filter(F.col("grp").isin(groups) & (F.col("root") != target_root)).join(offsets.select("image_id"), "image_id", "left_semi")
    return every.join(gone.select("grp", "image_id", "name"), ["grp", "image_id", "name"], "left_anti")
