"""The end-to-end jobs: each only composes operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronogrid.operators import curves, entities, frames, keyframes, layers, masks, pages, polygons, raster, regions, scaling, series, tables
from chronogrid.plans import curves as curve_plans
from chronogrid.plans import grid, web
from chronogrid.plans.control import HEIGHT, WIDTH
from chronogrid.plans.state import ASOF, SIGHTINGS
from chronogrid.shared import materialise
from chronogrid.streaming import entity_state
from chronogrid.sources import readers
from chronogrid.sources.views import base, derive, names_in, oracle, view


def _v(name):
    return lambda s, d: view(s, d, name)


def _on(sql):
    return lambda s, d: derive(s, d, sql)


cells, zones, control, dims = map(_v, ("cells", "zones", "control", "zone_dims"))
SAMPLED, MISSING, ZONED_UNTIL = (1995, 1998, 2001), [1996, 1999], 1998
#: Totals of the years, high enough to be kept apart from the zones' own.
WORLD = "SELECT yr, sum(target) * 2 AS target FROM {control} GROUP BY yr"


def text_grids(s, d):
    """(file, value): the sampled years' cells as text grids, a line a row, with -9999 where there is no cell."""
    held = cells(s, d).filter(F.col("yr").isin(*SAMPLED)).groupBy("yr", "r").agg(F.map_from_entries(F.collect_list(F.struct("c", "value"))).alias("m"))
    row = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(WIDTH - 1)), lambda c: F.coalesce(F.try_element_at("m", c), F.lit(-9999.0)).cast("string")), " ")
    lines = held.groupBy("yr").agg(F.map_from_entries(F.collect_list(F.struct("r", row.alias("line")))).alias("m"))
    none = F.lit(" ".join(["-9999"] * WIDTH))
    body = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(HEIGHT - 1)), lambda r: F.coalesce(F.try_element_at("m", r), none)), "\n")
    head = f"ncols {WIDTH}\nnrows {HEIGHT}\nxllcorner -180\nyllcorner -90\ncellsize 1\nNODATA_value -9999\n"
    return lines.select(F.concat(F.lit("popc_"), F.col("yr").cast("string"), F.lit(".asc")).alias("file"), F.concat(F.lit(head), body).alias("value"))


#: Years in which nothing but the zones holds anything.
EXCLUSIVE = (1996, 2023)


def pipe_landuse(s, d):
    """Sampled layers from text grids, the missing years between them, zone totals up to a year, world totals in all."""
    grids = readers.parse_ascii_grids(text_grids(s, d))
    known = layers.ascii_grid_to_cells(grids).select(F.lit("pop").alias("layer"), F.regexp_extract("layer", r"(\d+)$", 1).cast("int").alias("yr"), (F.col("r") * WIDTH + F.col("c")).cast("long").alias("idx"), "value")
    known = materialise(known)
    full = materialise(known.unionByName(series.interpolate_layers(known, MISSING)))
    early = scaling.scale_to_zones(full.filter(F.col("yr") <= ZONED_UNTIL), zones(s, d), control(s, d)).select(*full.columns)
    return scaling.scale_to_global(early.unionByName(full.filter(F.col("yr") > ZONED_UNTIL)), _on(WORLD)(s, d))


def pipe_anthropogenic(s, d):
    """The mean of aligned layers, paired with another, dealt the world's totals, then scaled by zone in three ways and at last
    to the world."""
    grids = materialise(cells(s, d))
    mean = frames.layer_mean([grids, grids.filter("idx % 2 = 0"), grids.filter("idx % 3 = 0")])
    paired = masks.layer_pair_mean(mean, grids.filter("idx % 5 <> 0"), (1995, 1999), (1997, 2001)).withColumn("layer", F.lit("pop"))
    dealt = materialise(scaling.distribute_total(paired, _on(WORLD)(s, d)))
    zoned = materialise(scaling.scale_to_zones(dealt, zones(s, d), control(s, d)).select("layer", "yr", "idx", "value"))
    within = F.col("yr").between(*EXCLUSIVE)
    exclusive = scaling.scale_to_zones_exclusive(zoned.filter(within), zones(s, d), control(s, d))
    exclusive = materialise(exclusive.select(*zoned.columns).unionByName(zoned.filter(~within)))
    ranged = masks.scale_to_zones_domain(exclusive, zones(s, d), control(s, d), dims(s, d))
    return scaling.scale_to_global(materialise(ranged), _on(WORLD)(s, d))


def pipe_outliers(s, d):
    """Outliers out, masks one after another, zones outside the masks in their domains, the world."""
    kept = raster.replace_outliers(cells(s, d), grid._fallback(s, d), k=2.0)
    kept = materialise(kept.select("layer", "yr", (F.col("r") * WIDTH + F.col("c")).cast("long").alias("idx"), "value"))
    targets = _on("SELECT 'north' AS mask, yr, sum(target) AS target FROM {control} GROUP BY yr")(s, d)
    masked = masks.scale_sequential_masks(kept, view(s, d, "area_masks"), targets, ["north", "south"])
    scaled = masks.scale_excluding_masks(masked, zones(s, d), control(s, d), dims(s, d), view(s, d, "mask_cells"), view(s, d, "kept_cells"))
    return scaling.scale_to_global(materialise(scaled), _on(WORLD)(s, d))


def pipe_world_totals(s, d):
    """Estimates of several sources pooled by year, a curve through the years between, in units, rounded, by year."""
    pooled = series.weighted_geomean(_on("SELECT x, y FROM {series_gt} UNION ALL SELECT x - 5 AS x, y FROM {series_rr}")(s, d), ["x"]).select(F.lit(0).alias("series_id"), "x", F.col("gmean").alias("y"))
    asked = frames.filled_domain(pooled)
    whole = curves.spline_interpolate(pooled, asked)
    return whole.select(F.col("x").alias("yr"), F.floor(F.col("y") * 1e6 + 0.5).cast("double").alias("total")).orderBy("yr")


#: The two files' figures of the truth cities; both have some years of a city.
URBAN_FILES = (
    "SELECT series_id, x + 1950 AS x, y FROM (" + curve_plans.GT_SERIES + ")",
    "SELECT city_id AS series_id, x + 1955 AS x, y + 3 AS y FROM {cities_gt} JOIN {series_rr} USING (series_id)",
)
URBAN = " UNION ALL ".join(URBAN_FILES)
#: Years of which the files have a column at least; each other year with a figure has one too.
FILE_YEARS = range(1950, 2031, 5)
LATER = "SELECT series_id, x + 1950 AS x, CASE WHEN x > 30 THEN 0.0 ELSE y END AS y, series_id % 4 <> 0 AS linked FROM (" + curve_plans.RR_SERIES + ")"


def _file_rows(s, d, sql):
    """The rows of a file: cities are dealt, and their nations' few figures sent to them. The engine would send the cities to the figures,
    which are in one part."""
    held = {n: view(s, d, n) for n in names_in(sql)}
    return s.sql(sql, **{n: v.repartition("city_id") if n == "cities_gt" else F.broadcast(v) for n, v in held.items()})


def _year_files(s, d):
    """The cities' figures as two files of a column a year (bc_50, ad_1950, ...), blank where there is none. Figures that a file repeats
    for a city and year stand on lines of their own."""
    first, second = (_file_rows(s, d, sql).select(F.lit(i).alias("file"), "series_id", "x", "y") for i, sql in enumerate(URBAN_FILES))
    rows = materialise(first.unionAll(second).filter("x is not null"))
    years = sorted({*FILE_YEARS, *(r["x"] for r in rows.select("x").distinct().collect())})
    line = F.row_number().over(Window.partitionBy("file", "series_id", "x").orderBy("y"))
    # dealt by city once for all that follows here: the engine would join the parts into few that hold much
    dealt = rows.repartition(8 * max(4, s.sparkContext.defaultParallelism), "series_id")
    wide = dealt.withColumn("line", line).groupBy("file", "series_id", "line").pivot("x", years).agg(F.first("y"))
    return wide.toDF("file", "series_id", "line", *[f"bc_{-y}" if y < 0 else f"ad_{y}" for y in years])


def _table_pages(s, d):
    """A page for each city: a table of its years and values, those that are observed as links."""
    rows = _on(LATER)(s, d)
    value = F.col("y").cast("string")
    cell = F.struct("x", F.concat(F.lit("<th>"), F.col("x").cast("string")).alias("head"), F.concat(F.lit("<td>"), F.when(F.col("linked"), F.concat(F.lit("<a href='#'>"), value, F.lit("</a>"))).otherwise(value), F.lit("</td>")).alias("body"))
    held = rows.groupBy("series_id").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    joined = lambda n: F.array_join(F.transform("cells", lambda c: c[n]), "")
    return held.select("series_id", F.concat(F.lit("<html><table id='tbl'><tr>"), joined("head"), F.lit("<tr>"), joined("body"), F.lit("</table>")).alias("html"))


def pipe_urban_union(s, d):
    """Cities' figures: files of year columns, pooled by year, corrected and cut after 1990; tables of pages, of which the
    linked figures count, of the other cities; both fused."""
    wide = tables.year_columns(_year_files(s, d), ["file", "series_id", "line"])
    pooled = series.weighted_geomean(wide, ["series_id", "x"]).select(F.col("series_id").cast("string").alias("name"), "x", F.floor(F.col("gmean") + 0.5).cast("double").alias("y"))
    truth = pages.correct_records(pooled, _on(PATCHES)(s, d)).select(F.col("name").cast("long").alias("series_id"), "x", "y")
    truth = materialise(series.cut_after(truth, 1990))
    # pages are few bytes and much work: the engine would join them into few parts
    held = _table_pages(s, d).repartition(4 * max(4, s.sparkContext.defaultParallelism), F.xxhash64("series_id"))
    found = materialise(pages.html_table_cells(held, "series_id"))
    years = found.filter("r = 0").select("series_id", "c", F.col("text").try_cast("int").alias("x"))
    later = found.filter("r = 1").join(years, ["series_id", "c"]).select("series_id", "x", F.col("text").try_cast("double").alias("y"), "linked")
    relative = materialise(pages.linked_population_table(later))
    return curves.fuse_city_series(_on(curve_plans.GT_CITIES)(s, d), truth, _on(curve_plans.RR_CITIES)(s, d), relative)


#: Points that are known to be wrong: one goes, one gets another value.
PATCHES = "SELECT 'delete' AS op, CAST(city_id AS VARCHAR(20)) AS name, CAST(NULL AS VARCHAR(20)) AS to, CAST(1970 AS INT) AS x, CAST(NULL AS DOUBLE) AS y FROM {cities_gt} WHERE city_id % 10 = 3 UNION ALL SELECT 'set', CAST(city_id AS VARCHAR(20)), CAST(NULL AS VARCHAR(20)), CAST(1950 AS INT), 77.0 FROM {cities_gt} WHERE city_id % 10 = 4"


def _index_pages(s, d):
    """An index page for each region, with links to its nations' pages of towns, drafts among them."""
    link = F.when(F.col("n_nationkey") % 5 == 0, "/draft/town/").otherwise("/town/")
    item = F.concat(F.lit("<li><a href='"), link, F.col("n_nationkey").cast("string"), F.lit("'>x</a>"))
    held = base(s, d, "nation").groupBy(F.col("n_regionkey").alias("page_id")).agg(F.concat_ws("", F.collect_list(item)).alias("html"))
    return held.withColumn("url", F.lit("https://towns.example/index"))


#: What a country's page says of its names.
NAMES = "SELECT n_nationkey AS id, 'names' AS name, 'Variants: ' || n_name || '; ' || n_name || ' (old)' AS value FROM {nation}"


def pipe_census_text(s, d):
    """Links of index pages, less drafts; the tables of the pages that they name; the countries' names from their fields; a
    town's place unless others share it; all as series of ``town-country`` in units."""
    links = pages.page_links(_index_pages(s, d), allow=["/town/"], deny=["/draft/"])
    wanted = links.select(F.regexp_extract("link", r"(\d+)$", 1).cast("int").alias("page_id")).distinct()
    read = pages.html_table_cells(web._town_pages(s, d).join(wanted, "page_id", "left_semi"))
    records = materialise(pages.parse_census_table(read, ["page_id"]))
    names = pages.populstat_fields(_on(NAMES)(s, d))[1].filter("pos = 0").select(F.col("id").alias("page_id"), F.col("other_name").alias("country"))
    cities = records.join(names, "page_id").groupBy("country", "name").agg(F.map_from_entries(F.collect_list(F.struct("x", "y"))).alias("m"))
    nested_ = cities.groupBy("country").agg(F.map_from_entries(F.collect_list(F.struct("name", "m"))).alias("cities"))
    flat = pages.flatten_country_cities(nested_)
    places = entities.duplicate_coords(_on("SELECT city_id, lat, lng FROM {cities_gt}")(s, d), 0)
    named = base(s, d, "customer").select(F.col("c_name").alias("name"), F.col("c_custkey").alias("city_id")).join(places, "city_id")
    return flat.withColumn("name", F.regexp_extract("key", "^(.*)-", 1)).join(named, "name", "left").select("key", "x", "y", "lat", "lng")


def pipe_gdp_bands(s, d):
    """Bands to yearly layers in hundredths, and their sums."""
    bands = layers.explode_bands(_on(BANDS)(s, d), [1995, 1996, 1998], 0.01)
    return bands.groupBy("yr").agg(F.sum("value").alias("total"), F.count("*").alias("n_cells"))


BANDS = "SELECT idx, array(sum(CASE WHEN yr = 1995 THEN value END), sum(CASE WHEN yr = 1996 THEN value END), sum(CASE WHEN yr = 1998 THEN value END)) AS bands FROM {cells} GROUP BY idx"
POLITIES = "SELECT feature_id, x0, y0, w, h, from_year + 1500 AS from_year, to_year + 1500 AS to_year FROM {features}"
AT_YEAR = 1997


def assign_polity_colours(s, d):
    """Each polity's value: that of the cell of its largest part that lies farthest from its border, in the layer nearest to the
    middle of its years."""
    years = sorted(r["yr"] for r in cells(s, d).select("yr").distinct().collect())
    polities = _on(POLITIES)(s, d)
    corners = F.array(*[F.struct(F.lit(i).alias("seq"), (F.col("x0") + dx * F.col("w")).cast("double").alias("x"), (F.col("y0") + dy * F.col("h")).cast("double").alias("y")) for i, (dx, dy) in enumerate(((0, 0), (1, 0), (1, 1), (0, 1)))])
    covered = polygons.polygon_cells(polities.select("feature_id", F.explode(corners).alias("p")).select("feature_id", "p.*"), WIDTH, HEIGHT)
    inner = regions.interior_pole(covered.withColumnRenamed("feature_id", "zone"), overlapping=True)
    inner = inner.select(F.col("zone").alias("feature_id"), (F.col("r") * WIDTH + F.col("c")).cast("long").alias("idx"))
    middle = polities.select("feature_id", "from_year", "to_year", F.floor((F.col("from_year") + F.col("to_year")) / 2).cast("int").alias("yr")).join(inner, "feature_id")
    there = cells(s, d).select(F.col("yr").alias("layer_year"), "idx", F.col("value").alias("sampled"))
    at = layers.nearest_year_layer(middle, years).join(there, ["layer_year", "idx"], "left")
    return at.select("feature_id", "from_year", "to_year", "layer_year", F.coalesce("sampled", F.lit(0.0)).alias("sampled"))


def pipe_polities(s, d):
    """The polities of one year with their values."""
    active = entities.active_intervals(_on(POLITIES)(s, d), [AT_YEAR])
    return assign_polity_colours(s, d).join(active, "feature_id").select("yr", "feature_id", "layer_year", "sampled")


def pipe_live_events(s, d):
    """Sightings to events, first sighting only; their log as lines, read back; every event's state as of a moment, with the
    edits made by then; those of the ten days before, in the order in which they are drawn."""
    events = keyframes.geometry_events(_on(SIGHTINGS)(s, d))
    kind = F.when(F.col("lng") % 3 == 0, "polygon").when(F.col("lng") % 3 == 1, "line").otherwise("point")
    data = F.create_map(F.lit("kind"), kind, F.lit("region"), F.col("region"), F.lit("seq"), F.col("seq").cast("string"))
    lines = events.select(entity_state.log_line(F.col("event_id"), F.lit("event"), F.col("date"), data).alias("value"))
    read = materialise(entity_state.parse_log_lines(lines))
    log = read.select("id", "date", F.lit(0).cast("long").alias("seq"), F.explode("data").alias("k", "v"))
    # an hour after its sighting, events of one region turn out to be points
    edits = read.filter(F.col("data")["region"] == "r3").select("id", (F.col("date") + F.expr("INTERVAL 1 HOUR")).alias("date"), F.lit(1).cast("long").alias("seq"), F.lit("kind").alias("k"), F.lit("point").alias("v"))
    state = keyframes.resolve_slots(log.unionByName(edits).withColumn("slot", F.lit(1)), ASOF)
    wide = state.groupBy("id").pivot("k", ["kind", "seq"]).agg(F.first("v"))
    recent = keyframes.recent_events(read.select("id", "date").join(wide, "id"), ASOF, 240.0)
    drawn = keyframes.draw_order(recent.withColumn("seq", F.col("seq").cast("long")), "kind", "seq")
    return drawn.select(F.col("id").alias("event_id"), "date", "kind", "rank")


VESSELS = "SELECT user_id, ts AS date, event_id, CAST(user_id % 360 - 180 AS DOUBLE) AS lng, CASE WHEN event_id % 8 = 0 THEN NULL ELSE CAST(user_id % 180 - 90 AS DOUBLE) END AS lat, 'vessel ' || CAST(user_id AS VARCHAR(12)) AS name, event_type AS flag FROM {events}"


def pipe_vessels(s, d):
    """Positions of the last five days, labelled; those without coordinates or time are left out."""
    recent = keyframes.recent_events(_on(VESSELS)(s, d), ASOF, 120.0, keep_undated=False)
    return recent.filter("lat is not null and lng is not null").select("event_id", "lng", "lat", F.concat(F.col("name"), F.lit(" ("), F.col("flag"), F.lit(")")).alias("label"))


QUERIES = {
    "pipe_landuse": pipe_landuse,
    "pipe_anthropogenic": pipe_anthropogenic,
    "pipe_outliers": pipe_outliers,
    "pipe_world_totals": pipe_world_totals,
    "pipe_urban_union": pipe_urban_union,
    "pipe_census_text": pipe_census_text,
    "pipe_gdp_bands": pipe_gdp_bands,
    "assign_polity_colours": assign_polity_colours,
    "pipe_polities": pipe_polities,
    "pipe_live_events": pipe_live_events,
    "pipe_vessels": pipe_vessels,
}


def zone_step(name: str, prev: str, value: str) -> str:
    """A CTE of zone scaling over prev (layer, yr, idx, value)."""
    return f"""{name} AS (WITH zs AS (SELECT p.layer, p.yr, z.zone, sum(p.value) AS total FROM {prev} p JOIN {{zones}} z USING (idx) GROUP BY p.layer, p.yr, z.zone),
 sc AS (SELECT zs.layer, zs.yr, zs.zone, CASE WHEN k.target IS NULL THEN NULL WHEN total = 0 THEN 1.0 ELSE k.target / total END AS scalar FROM zs LEFT JOIN {{control}} k ON k.zone = zs.zone AND k.yr = zs.yr)
 SELECT p.layer, p.yr, p.idx, {value} AS value FROM {prev} p LEFT JOIN {{zones}} z ON z.idx = p.idx LEFT JOIN sc ON sc.layer = p.layer AND sc.yr = p.yr AND sc.zone = z.zone)"""


ROUNDED_UP = "COALESCE(CAST(ceil(p.value * scalar) AS DOUBLE), p.value)"
ONLY_ZONES = f"CASE WHEN p.yr NOT BETWEEN {EXCLUSIVE[0]} AND {EXCLUSIVE[1]} THEN p.value WHEN z.zone IS NULL THEN 0.0 ELSE p.value * COALESCE(scalar, 1.0) END"


def world_step(name: str, prev: str) -> str:
    return f"""{name} AS (SELECT p.layer, p.yr, p.idx, CASE WHEN w.target IS NULL THEN p.value ELSE CAST(ceil(p.value * CASE WHEN t.total = 0 THEN 1.0 ELSE w.target / t.total END) AS DOUBLE) END AS value
 FROM {prev} p JOIN (SELECT layer, yr, sum(value) AS total FROM {prev} GROUP BY layer, yr) t ON t.layer = p.layer AND t.yr = p.yr LEFT JOIN ({WORLD}) w ON w.yr = p.yr)"""


def domain_step(name: str, prev: str, excluded: str | None = None) -> str:
    join = f"LEFT JOIN {excluded} ex ON ex.yr = p.yr AND ex.idx = p.idx" if excluded else ""
    free = "ex.idx IS NULL" if excluded else "TRUE"
    return f"""{name} AS (WITH h AS (SELECT p.layer, p.yr, p.idx, p.value, z.zone, d.first_year, d.last_year, d.scalar AS per, {free} AS free FROM {prev} p LEFT JOIN {{zones}} z ON z.idx = p.idx LEFT JOIN {{zone_dims}} d ON d.zone = z.zone {join}),
 t AS (SELECT layer, yr, zone, first_year, last_year, per, sum(CASE WHEN free AND value > 0 THEN value END) AS total FROM h WHERE zone IS NOT NULL GROUP BY ALL),
 sc AS (SELECT t.layer, t.yr, t.zone, CASE WHEN t.yr BETWEEN first_year AND last_year AND total > 0 THEN COALESCE(k.target, 0.0) * per / total ELSE 1.0 END AS scalar FROM t LEFT JOIN {{control}} k ON k.zone = t.zone AND k.yr = t.yr)
 SELECT h.layer, h.yr, h.idx, CASE WHEN free AND scalar IS NOT NULL AND value <> 0 THEN CAST(ceil(value * scalar) AS DOUBLE) ELSE value END AS value FROM h LEFT JOIN sc ON sc.layer = h.layer AND sc.yr = h.yr AND sc.zone = h.zone)"""


BETWEEN = f"""e AS (SELECT layer, t, x0, x1, idx, COALESCE(max(CASE WHEN yr = x0 THEN value END), 0) AS y0, COALESCE(max(CASE WHEN yr = x1 THEN value END), 0) AS y1 FROM k JOIN (VALUES (1996, 1995, 1998), (1999, 1998, 2001)) AS pr(t, x0, x1) ON yr IN (x0, x1) GROUP BY layer, t, x0, x1, idx),
full_ AS (SELECT layer, yr, idx, value FROM k UNION ALL SELECT layer, t, idx, CAST(greatest(ceil(y0 + (t - x0) * (y1 - y0) / (x1 - x0)), 0) AS DOUBLE) FROM e)"""
UNDER = "SELECT DISTINCT yr, idx FROM {0} JOIN (SELECT DISTINCT yr FROM {{cells}}) y ON yr BETWEEN CAST(regexp_extract(mask, '_(\\d+)_(\\d+)$', 1) AS INT) AND CAST(regexp_extract(mask, '_(\\d+)_(\\d+)$', 2) AS INT)"
NORTH = """masked AS (SELECT p.layer, p.yr, p.idx, CASE WHEN i.idx IS NOT NULL AND s.scalar IS NOT NULL THEN CAST(ceil(p.value * s.scalar) AS DOUBLE) ELSE p.value END AS value FROM kept p
 LEFT JOIN (SELECT DISTINCT idx FROM {area_masks} WHERE mask = 'north') i USING (idx)
 LEFT JOIN (SELECT a.layer, a.yr, t.target / a.total AS scalar FROM (SELECT layer, yr, max(total) AS total FROM (SELECT layer, yr, file, sum(value) AS total FROM kept JOIN {area_masks} m USING (idx) WHERE m.mask = 'north' GROUP BY layer, yr, file) GROUP BY layer, yr) a JOIN (SELECT yr, sum(target) AS target FROM {control} GROUP BY yr) t ON t.yr = a.yr WHERE total > 0 AND t.target <> 0) s ON s.layer = p.layer AND s.yr = p.yr)"""
OUTLIERS = grid.AROUND.replace("FROM cells a", "FROM {cells} a").replace("JOIN cells b", "JOIN {cells} b") + f""", bad AS (SELECT layer, yr, r, c FROM nm WHERE {grid.IS_OUTLIER}),
kept AS (SELECT nm.layer, nm.yr, CAST(nm.r * {WIDTH} + nm.c AS BIGINT) AS idx, CASE WHEN bad.r IS NOT NULL THEN COALESCE(f.value, 0.0) ELSE nm.value END AS value FROM nm LEFT JOIN bad USING (layer, yr, r, c) LEFT JOIN {{cells}} f ON f.layer = nm.layer AND f.yr + 1 = nm.yr AND f.r = nm.r AND f.c = nm.c)"""
GEO = "CASE WHEN count(CASE WHEN y {0} 0 THEN 1 END) = 0 THEN 0 ELSE count(CASE WHEN y {0} 0 THEN 1 END) / count(y)::DOUBLE * exp(avg(CASE WHEN y {0} 0 THEN ln(abs(y)) END)) END"
LINKED = f"WITH f AS (SELECT series_id, x, y FROM ({LATER}) WHERE linked AND y > 0 OR y = 0), h AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM f WINDOW w AS (PARTITION BY series_id ORDER BY x)), e AS (SELECT series_id, x, y FROM f UNION SELECT series_id, px + 1, 0.0 FROM h WHERE y = 0 AND py <> 0 UNION SELECT series_id, nx - 1, 0.0 FROM h WHERE y = 0 AND ny <> 0) SELECT series_id, x, y FROM e JOIN (SELECT series_id, min(x) AS lo, max(x) AS hi FROM e WHERE y <> 0 GROUP BY series_id) USING (series_id) WHERE x BETWEEN lo AND hi"
POOLED_RAW = f"SELECT series_id, x, CAST(floor({GEO.format('>')} - {GEO.format('<')} + 0.5) AS DOUBLE) AS y FROM ({URBAN}) WHERE x <= 1990 GROUP BY series_id, x"
POOLED = f"SELECT series_id, CAST(x AS INT) AS x, y FROM ({POOLED_RAW}) WHERE NOT (series_id % 10 = 3 AND x = 1970) AND NOT (series_id % 10 = 4 AND x = 1950) UNION ALL SELECT city_id AS series_id, CAST(1950 AS INT) AS x, CAST(77 AS DOUBLE) AS y FROM {{cities_gt}} WHERE city_id % 10 = 4"
COLOURED = f"""WITH p AS ({POLITIES}), q AS (SELECT feature_id, from_year, to_year, CAST(floor((from_year + to_year) / 2.0) AS INT) AS yr, CAST(({HEIGHT} - y0 - h + least(w - 1, h - 1) // 2) * {WIDTH} + x0 + least(w - 1, h - 1) // 2 AS BIGINT) AS idx FROM p),
n AS (SELECT feature_id, from_year, to_year, idx, CAST(arg_min(ly, abs(ly - yr) * 10000 + ly) AS INT) AS layer_year FROM q CROSS JOIN (SELECT DISTINCT yr AS ly FROM {{cells}}) GROUP BY ALL),
o AS (SELECT feature_id, from_year, to_year, layer_year, COALESCE(v.value, 0.0) AS sampled FROM n LEFT JOIN {{cells}} v ON v.yr = layer_year AND v.idx = n.idx)"""

WORLD_POOLED = f"SELECT 0 AS series_id, x, {GEO.format('>')} - {GEO.format('<')} AS y FROM (SELECT x, y FROM {{series_gt}} UNION ALL SELECT x - 5 AS x, y FROM {{series_rr}}) GROUP BY x"

ORACLES = {
    k: oracle(sql)
    for k, sql in {
        "pipe_landuse": "WITH k AS (SELECT * FROM {cells} WHERE yr IN (1995, 1998, 2001)), " + BETWEEN + ", early AS (SELECT * FROM full_ WHERE yr <= 1998), " + zone_step("zoned", "early", ROUNDED_UP) + ", both_ AS (SELECT * FROM zoned UNION ALL SELECT * FROM full_ WHERE yr > 1998), " + world_step("done", "both_") + " SELECT * FROM done",
        "pipe_anthropogenic": "WITH m AS (SELECT yr, idx, sum(value) / 3 AS value FROM (SELECT yr, idx, value FROM {cells} UNION ALL SELECT yr, idx, value FROM {cells} WHERE idx % 2 = 0 UNION ALL SELECT yr, idx, value FROM {cells} WHERE idx % 3 = 0) GROUP BY yr, idx), pm AS (SELECT 'pop' AS layer, * FROM (SELECT yr, idx, CASE WHEN yr BETWEEN 1997 AND 1999 THEN (COALESCE(a.value, 0) + COALESCE(b.value, 0)) / 2 WHEN yr BETWEEN 1995 AND 1999 THEN a.value WHEN yr BETWEEN 1997 AND 2001 THEN b.value END AS value FROM m a FULL JOIN (SELECT yr, idx, value FROM {cells} WHERE idx % 5 <> 0) b USING (yr, idx)) WHERE value IS NOT NULL), "
        + f"dealt AS (SELECT p.layer, p.yr, p.idx, p.value * CASE WHEN t.total = 0 THEN 0.0 ELSE w.target / t.total END AS value FROM pm p JOIN (SELECT yr, sum(value) AS total FROM pm GROUP BY yr) t ON t.yr = p.yr JOIN ({WORLD}) w ON w.yr = p.yr), "
        + zone_step("zoned", "dealt", ROUNDED_UP) + ", " + zone_step("excl", "zoned", ONLY_ZONES) + ", " + domain_step("ranged", "excl") + ", " + world_step("done", "ranged") + " SELECT * FROM done",
        "pipe_outliers": OUTLIERS + ", " + NORTH + f", ex AS ({UNDER.format('{mask_cells}')} EXCEPT {UNDER.format('{kept_cells}')}), " + domain_step("scaled", "masked", "ex") + ", " + world_step("done", "scaled") + " SELECT * FROM done",
        "pipe_urban_union": curve_plans.fused_sql(POOLED, LINKED),
        "pipe_census_text": f"WITH c AS ({web.RANKED}), r AS (SELECT page_id, name, 1890 AS x, CAST(replace(replace(a, '.', ''), ',', '.') AS DOUBLE) AS y FROM c UNION ALL SELECT page_id, name, 1900, CAST(b AS DOUBLE) FROM c WHERE b <> 'none'), p AS (SELECT city_id, CASE WHEN n = 1 THEN lat END AS lat, CASE WHEN n = 1 THEN lng END AS lng FROM (SELECT *, count(*) OVER (PARTITION BY round(lat, 0), round(lng, 0)) AS n FROM {{cities_gt}})) SELECT r.name || '-' || n_name AS key, x, y * 1000 AS y, lat, lng FROM r JOIN {{nation}} ON n_nationkey = page_id AND page_id % 5 <> 0 JOIN {{customer}} ON c_name = r.name LEFT JOIN p ON p.city_id = c_custkey",
        "pipe_world_totals": curve_plans.spline_sql(WORLD_POOLED, f"SELECT 0 AS series_id, unnest(range(CAST(min(x) AS BIGINT), CAST(max(x) AS BIGINT) + 1)) AS x FROM ({WORLD_POOLED})") + " SELECT x AS yr, floor(y * 1e6 + 0.5) AS total FROM curve",
        "pipe_gdp_bands": "SELECT yr, sum(value) AS total, count(*) AS n_cells FROM (SELECT idx, yr, CAST(ceil(sum(value) * 0.01::DOUBLE) AS DOUBLE) AS value FROM {cells} WHERE yr IN (1995, 1996, 1998) GROUP BY idx, yr) GROUP BY yr",
        "assign_polity_colours": COLOURED + " SELECT * FROM o",
        "pipe_polities": COLOURED + f" SELECT CAST({AT_YEAR} AS INT) AS yr, feature_id, layer_year, sampled FROM o WHERE {AT_YEAR} BETWEEN from_year AND to_year",
        "pipe_live_events": f"WITH f AS (SELECT *, source || '_' || region || '_' || lower(printf('%x', abs(h))) AS event_id FROM (SELECT *, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(CAST(lng AS VARCHAR) || ',' || CAST(lat AS VARCHAR), ''), lambda c: ord(c)::BIGINT)), lambda h, c: ((h * 31 + c + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648) AS h FROM ({SIGHTINGS})) QUALIFY row_number() OVER (PARTITION BY source, region, lng, lat ORDER BY date, seq) = 1), g AS (SELECT event_id, make_timestamp(epoch_us(date) // 1000 * 1000) AS date, region, lng FROM f), st AS (SELECT event_id, date, CASE WHEN region = 'r3' AND date + INTERVAL 1 HOUR <= TIMESTAMP '{ASOF}' THEN 2 ELSE lng % 3 END AS rank FROM g WHERE date <= TIMESTAMP '{ASOF}') SELECT event_id, date, CASE rank WHEN 0 THEN 'polygon' WHEN 1 THEN 'line' ELSE 'point' END AS kind, CAST(rank AS INT) AS rank FROM st WHERE date >= TIMESTAMP '{ASOF}' - INTERVAL '240 hours'",
        "pipe_vessels": f"SELECT event_id, lng, lat, name || ' (' || flag || ')' AS label FROM ({VESSELS}) WHERE date >= TIMESTAMP '{ASOF}' - INTERVAL '120 hours' AND lat IS NOT NULL",
    }.items()
}
