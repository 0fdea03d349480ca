"""One query for each row of the scalar library."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronogrid.functions import calendar, colours, geo, numbers, strings
from chronogrid.operators.entities import haversine_km
from chronogrid.sources.views import base, derive, oracle

c = F.col
PALETTE = [("red", 255, 0, 0), ("green", 0, 128, 0), ("blue", 0, 0, 255), ("white", 255, 255, 255), ("black", 0, 0, 0), ("grey", 128, 128, 128)]
DATES = "SELECT o_orderkey AS id, CAST(1 + o_orderkey % 3000 AS INT) AS y, CAST(1 + o_orderkey % 12 AS INT) AS mo, CAST(1 + o_orderkey % 28 AS INT) AS d, CAST(o_orderkey % 24 AS INT) AS h, CAST(o_orderkey % 60 AS INT) AS mi FROM {orders}"
TEXTS = "SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 'about ' || CAST(p_size AS VARCHAR(4)) || '.500,25 km' WHEN p_partkey % 4 = 1 THEN '-1.' || lpad(CAST(p_size AS VARCHAR(4)), 3, '0') ELSE p_name END AS t, p_name, p_type, p_brand FROM {part}"
CELL = "SELECT p_partkey AS id, CAST(p_partkey * 37 % 256 AS INT) AS r, CAST(p_partkey * 91 % 256 AS INT) AS g, CAST(p_partkey * 53 % 256 AS INT) AS b FROM {part}"


def _on(sql):
    return lambda s, d: derive(s, d, sql)


def _round(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


def _numbers(s, d):
    p, n = base(s, d, "part"), c("p_size")
    out = p.select(
        c("p_partkey").alias("id"),
        numbers.safe_number(F.concat(n.cast("string"), F.lit(".5 units"))).alias("safe"), numbers.safe_number(c("p_name"), -1.0).alias("unsafe"),
        numbers.unzero((n % 3).cast("double"), 9.0).alias("unzeroed"), numbers.root(25.5 - n, 3).alias("root"), numbers.logarithm(F.lit(3.0), c("p_retailprice")).alias("log"),
        numbers.log_factorial(n % 20).alias("log_fact"), numbers.factorial(n % 11).alias("fact"), numbers.round_to(c("p_retailprice"), 1).alias("rounded"),
        numbers.significant(c("p_retailprice"), 2).alias("figures"), F.radians(n).alias("rad"), F.degrees(n / 10).alias("deg"),
    )
    return _round(out, "root", "log", "log_fact", "figures", "rad", "deg", digits=4)


def _ordinals(s, d):
    n = c("p_partkey") - 50
    text = numbers.ordinalise(n)
    return base(s, d, "part").select(c("p_partkey").alias("id"), text.alias("ordinal"), numbers.deordinalise(text).alias("number"), numbers.digits_to_letters(n).alias("letters"), numbers.letters_to_digits(numbers.digits_to_letters(n)).alias("digits"))


def _ranges(s, d):
    f = derive(s, d, "SELECT feature_id, CAST(w AS DOUBLE) AS p, CAST(h AS DOUBLE) AS q, CAST(w + h AS DOUBLE) AS r FROM {features}")
    a, b = numbers.interval(c("p"), c("q")), numbers.interval(c("r"), c("q"))
    ops = {op: numbers.interval_by_interval(a, b, op) for op in ("add", "subtract", "multiply", "divide", "pow", "root")} | {"shift": numbers.interval_by_number(a, c("r"), "add")}
    out = f.select("feature_id", *[x[e].alias(f"{op}_{e}") for op, x in ops.items() for e in ("low", "high")], numbers.midpoint(a).alias("middle"))
    return _round(out, *out.columns[1:])


def _colours(s, d):
    rgb = c("r"), c("g"), c("b")
    text = colours.to_hex(*rgb)
    out = _on(CELL)(s, d).select("id", text.alias("hex"), colours.from_hex(text)["g"].alias("g_back"), colours.parse_colour(F.concat(F.lit("rgb("), F.concat_ws(", ", *rgb), F.lit(")")))["b"].alias("b_back"), colours.luminance(*rgb).alias("lum"), *[x.alias(n) for x, n in zip(colours.lab(*rgb), ("lab_l", "lab_a", "lab_b"), strict=True)])
    return _round(out, "lum", "lab_l", "lab_a", "lab_b", digits=4)


def _geo(s, d):
    places = derive(s, d, "SELECT city_id, lat, lng FROM {cities_gt}")
    lng, lat = geo.translate_point(c("lng"), c("lat"), (c("city_id") % 100) * 1000.0, (c("city_id") % 70) * -500.0)
    out = places.select("city_id", lng.alias("to_lng"), lat.alias("to_lat"), haversine_km(c("lat"), c("lng"), F.lit(0.0), F.lit(0.0)).alias("km"))
    return _round(out, "to_lng", "to_lat", "km", digits=4)


def _calendar(s, d):
    parts = c("y"), c("mo"), c("d"), c("h"), c("mi")
    stamp = calendar.to_minutes(*parts)
    held = _on(DATES)(s, d).withColumn("minutes", stamp).withColumn("back", calendar.from_minutes(c("minutes")))
    read = calendar.parse_date(F.concat_ws(".", "y", "mo", "d"))
    return held.select("id", "minutes", c("back.year").alias("year"), c("back.month").alias("month"), c("back.day").alias("day"), c("back.hour").alias("hour"), c("back.minute").alias("minute"), read["month"].alias("read_month"), calendar.is_leap(c("y")).alias("leap"), calendar.year_label(c("y") - 1500).alias("label"), calendar.fractional_year(c("y") + 0.5)["month"].alias("half_month"), calendar.to_minutes(c("y"), c("mo") + 30, c("d"), c("h") + 50, c("mi") + 200).alias("over"))


def _ages(s, d):
    e = base(s, d, "events")
    age = {u: calendar.since("2024-02-01 00:00:00", c("ts"), u) for u in ("milliseconds", "minutes", "hours", "days")}
    text = F.when(c("event_id") % 3 == 0, (1700000000000 + c("event_id")).cast("string")).when(c("event_id") % 3 == 1, F.lit("2024-03-01 10:00:00")).otherwise("soon")
    return _round(e.select("event_id", *[x.alias(u) for u, x in age.items()], calendar.to_instant(text).alias("instant")), "milliseconds", "minutes", "hours", "days", digits=3)


def _strings(s, d):
    t, items = c("t"), F.split("p_name", " ")
    return _on(TEXTS)(s, d).select(
        "id", strings.european_number(t).alias("european"), strings.strip_non_numerics(t).alias("numerics"), strings.strip_markdown(F.concat(F.lit("## **"), "p_name", F.lit("** [link](http://x) `c`"))).alias("unmarked"),
        strings.equal_ignoring_case(F.upper(t), c("p_name")).alias("same"), strings.capitalise(c("p_name")).alias("capital"), strings.truncate(c("p_type"), 8).alias("short"), strings.list_phrase(items).alias("phrase"),
        strings.is_url(F.concat(F.lit("http://"), "p_brand")).alias("url"), strings.is_url(c("p_brand")).alias("no_url"), strings.is_image(F.concat(F.lit("https://x/"), "p_brand", F.lit(".png"))).alias("image"),
        strings.js_hash(c("p_name")).alias("hash"), strings.escape_html(F.concat(F.lit("<a href='"), "p_brand", F.lit("'>&"))).alias("escaped"),
    )


QUERIES = {
    "fx_number": _numbers,
    "fx_ordinal": _ordinals,
    "fx_intervals": _ranges,
    "fx_colour": _colours,
    "fx_geo": _geo,
    "fx_calendar": _calendar,
    "fx_age": _ages,
    "fx_string": _strings,
    "nearest_palette": lambda s, d: _on(CELL)(s, d).select("id", colours.nearest_palette(c("r"), c("g"), c("b"), PALETTE).alias("name")),
}

STRAIGHT = "CASE WHEN {0} / 255.0::DOUBLE > 0.04045 THEN pow(({0} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) ELSE {0} / 255.0::DOUBLE / 12.92 END"
CURVE = "CASE WHEN {0} > 0.008856 THEN pow({0}, 1.0::DOUBLE / 3) ELSE 7.787 * {0} + 16.0::DOUBLE / 116 END"
XYZ = ", ".join(f"(lr * {r[0]}::DOUBLE + lg * {r[1]}::DOUBLE + lb * {r[2]}::DOUBLE) / {w}::DOUBLE AS {n}" for r, w, n in zip(colours.TO_XYZ, colours.WHITE, "xyz", strict=True))


def lab_of(source: str) -> str:
    """source (…, r, g, b) with lab_l, lab_a and lab_b."""
    light = ", ".join(f"{STRAIGHT.format(n)} AS l{n}" for n in "rgb")
    return f"SELECT * EXCLUDE (lr, lg, lb, x, y, z, fx, fy, fz), 116 * fy - 16 AS lab_l, 500 * (fx - fy) AS lab_a, 200 * (fy - fz) AS lab_b FROM (SELECT *, {', '.join(f'{CURVE.format(n)} AS f{n}' for n in 'xyz')} FROM (SELECT *, {XYZ} FROM (SELECT *, {light} FROM {source})))"


LUM = " + ".join(f"CASE WHEN {n} / 255.0::DOUBLE <= 0.03928 THEN {n} / 255.0::DOUBLE / 12.92 ELSE pow(({n} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END * {w}" for n, w in zip("rgb", colours.LUMINANCE, strict=True))
HASHED = "lower(printf('%x', abs(list_reduce(list_prepend(0::BIGINT, list_transform(string_split(p_name, ''), lambda c: ord(c)::BIGINT)), lambda h, c: ((h * 31 + c + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648))))"
DELTA = "sqrt(pow(a.lab_l - p.lab_l, 2) + pow((ac - pc) / (1 + 0.045 * ac), 2) + greatest(pow(a.lab_a - p.lab_a, 2) + pow(a.lab_b - p.lab_b, 2) - pow(ac - pc, 2), 0) / pow(1 + 0.015 * ac, 2))"
COLOURS = "(SELECT * FROM (VALUES " + ", ".join(f"({i}, '{n}', {r}, {g}, {b})" for i, (n, r, g, b) in enumerate(PALETTE)) + ") AS t(i, name, r, g, b))"
INTERVALS = {"add": "{0} + {1}", "subtract": "{0} - {1}", "multiply": "{0} * {1}", "divide": "{0} / {1}", "pow": "pow({0}, {1})", "root": "pow({0}, 1 / {1})"}
ENDS = ", ".join(f"round({f}({x.format('lo1', 'lo2')}, {x.format('hi1', 'hi2')}), 6) AS {op}_{e}" for op, x in INTERVALS.items() for e, f in (("low", "least"), ("high", "greatest")))
GREGORIAN = "(date_diff('day', DATE '0001-01-01', {0}) + 366) * 1440"

ORACLES = {
    k: oracle(sql)
    for k, sql in {
        "fx_number": "SELECT p_partkey AS id, p_size + 0.5::DOUBLE AS safe, -1.0 AS unsafe, CASE WHEN p_size % 3 = 0 THEN 9.0 ELSE p_size % 3 END AS unzeroed, round(sign(25.5 - p_size) * pow(abs(25.5::DOUBLE - p_size), 1.0::DOUBLE / 3), 4) AS root, round(ln(p_retailprice) / ln(3), 4) AS log, round(COALESCE(list_sum(list_transform(range(1, p_size % 20 + 1), lambda i: ln(i))), 0), 4) AS log_fact, CAST(factorial(CAST(p_size % 11 AS INT)) AS DOUBLE) AS fact, round(p_retailprice, 1) AS rounded, round(floor(p_retailprice * pow(10.0, 2 - (floor(log10(p_retailprice)) + 1)) + 0.5) / pow(10.0, 2 - (floor(log10(p_retailprice)) + 1)), 4) AS figures, round(radians(p_size), 4) AS rad, round(degrees(p_size / 10.0), 4) AS deg FROM {part}",
        "fx_ordinal": "SELECT p_partkey AS id, CAST(n AS VARCHAR) || CASE WHEN abs(n) % 100 IN (11, 12, 13) THEN 'th' WHEN abs(n) % 10 = 1 THEN 'st' WHEN abs(n) % 10 = 2 THEN 'nd' WHEN abs(n) % 10 = 3 THEN 'rd' ELSE 'th' END AS ordinal, n AS number, translate(CAST(n AS VARCHAR), '0123456789', 'abcdefghij') AS letters, CAST(n AS DOUBLE) AS digits FROM (SELECT p_partkey, p_partkey - 50 AS n FROM {part})",
        "fx_intervals": f"SELECT feature_id, {ENDS}, round(lo1 + r, 6) AS shift_low, round(hi1 + r, 6) AS shift_high, round((lo1 + hi1) / 2, 6) AS middle FROM (SELECT feature_id, CAST(least(w, h) AS DOUBLE) AS lo1, CAST(greatest(w, h) AS DOUBLE) AS hi1, CAST(h AS DOUBLE) AS lo2, CAST(w + h AS DOUBLE) AS hi2, w + h AS r FROM {{features}})",
        "fx_colour": f"SELECT id, '#' || lower(lpad(printf('%x', r), 2, '0') || lpad(printf('%x', g), 2, '0') || lpad(printf('%x', b), 2, '0')) AS hex, g AS g_back, b AS b_back, round({LUM}, 4) AS lum, round(lab_l, 4) AS lab_l, round(lab_a, 4) AS lab_a, round(lab_b, 4) AS lab_b FROM ({lab_of('(' + CELL + ')')})",
        "nearest_palette": f"WITH a AS (SELECT *, sqrt(lab_a * lab_a + lab_b * lab_b) AS ac FROM ({lab_of('(' + CELL + ')')})), p AS (SELECT *, sqrt(lab_a * lab_a + lab_b * lab_b) AS pc FROM ({lab_of(COLOURS)})) SELECT a.id, p.name FROM a CROSS JOIN p QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY {DELTA}, p.i) = 1",
        "fx_geo": "SELECT city_id, round(((lng + degrees((city_id % 100) * 1000 / (6371008.8 * cos(radians(lat)))) + 540 + 360) % 360) - 180, 4) AS to_lng, round(lat + degrees((city_id % 70) * -500 / 6371008.8), 4) AS to_lat, round(2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(-lat) / 2), 2) + cos(radians(lat)) * pow(sin(radians(-lng) / 2), 2)))), 4) AS km FROM {cities_gt}",
        "fx_calendar": f"SELECT id, {GREGORIAN.format('make_date(y, mo, d)')} + h * 60 + mi AS minutes, y AS year, mo AS month, d AS day, h AS hour, mi AS minute, mo AS read_month, (y % 4 = 0 AND y % 100 <> 0) OR y % 400 = 0 AS leap, CAST(abs(y - 1500) AS VARCHAR) || CASE WHEN y >= 1500 THEN 'AD' ELSE 'BC' END AS label, 7 AS half_month, {GREGORIAN.format('CAST(make_date(y, mo, 1) + INTERVAL 30 MONTHS AS DATE)')} + (d - 1) * 1440 + (h + 50) * 60 + mi + 200 AS over FROM ({DATES})",
        "fx_age": "SELECT event_id, round(u / 1e3, 3) AS milliseconds, round(u / 6e7, 3) AS minutes, round(u / 3.6e9, 3) AS hours, round(u / 8.64e10, 3) AS days, CASE event_id % 3 WHEN 0 THEN epoch_ms(1700000000000 + event_id) WHEN 1 THEN TIMESTAMP '2024-03-01 10:00:00' END AS instant FROM (SELECT event_id, epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(ts) AS u FROM {events})",
        "fx_string": f"SELECT id, CASE id % 4 WHEN 0 THEN CAST(regexp_extract(t, '\\d+') AS INT) * 1000 + 500.25 WHEN 1 THEN CAST(replace(t, '.', '') AS DOUBLE) END AS european, regexp_replace(t, '[^0-9.\\-]', '', 'g') AS numerics, p_name || ' link c' AS unmarked, id % 4 > 1 AS same, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS capital, CASE WHEN length(p_type) > 8 THEN p_type[1:5] || '...' ELSE p_type END AS short, CASE WHEN len(string_split(p_name, ' ')) = 1 THEN p_name ELSE array_to_string(string_split(p_name, ' ')[1:-2], ', ') || ' and ' || string_split(p_name, ' ')[-1] END AS phrase, NOT contains(p_brand, ' ') AS url, FALSE AS no_url, TRUE AS image, {HASHED} AS hash, '&lt;a href=&#39;' || p_brand || '&#39;&gt;&amp;' AS escaped FROM ({TEXTS})",
    }.items()
}
