"""Keyframe logs (id, date, k, v, seq): states, edits and events. A row sets key k of an entity at a date; later rows win, seq
breaks ties, and a null value takes the key away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronogrid.functions.strings import js_hash
from chronogrid.shared import materialise


def _at(date: Column | str) -> Column:
    return F.lit(date).cast("timestamp_ntz") if isinstance(date, str) else date


def resolve_slots(history: DataFrame, asof: Column | str) -> DataFrame:
    """(id, slot, k, v): state of every entity at a date, slot by slot and key by key, from (id, date, seq, slot, k, v). Nulls are
    passed over, but in slot 0, the geometry, where the last row holds even if null and then has no row here. Nested variables
    are keys of their own (``variables.name``) and so are merged one by one."""
    counted = history.filter((F.col("date") <= _at(asof)) & ((F.col("slot") == 0) | F.col("v").isNotNull()))
    last = F.max(F.struct("date", "seq", "v"))
    return counted.groupBy("id", "slot", "k").agg(last.alias("m")).filter("m.v is not null").select("id", "slot", "k", "m.v")


def snapshots(log: DataFrame) -> DataFrame:
    """(id, date, seq, k, v): the state after every keyframe, a row for each key that it then has. Each key's changes meet the
    entity's keyframes between them and the next: the result has as many rows as the states have keys."""
    change = Window.partitionBy("id", "k").orderBy("date", "seq")
    frames = log.select("id", F.struct("date", "seq").alias("f"))
    spans = log.select("id", "k", "v", F.struct("date", "seq").alias("since"), F.lead(F.struct("date", "seq")).over(change).alias("until")).filter("v is not null")
    met = frames.join(spans, "id").filter((F.col("f") >= F.col("since")) & (F.col("until").isNull() | (F.col("f") < F.col("until"))))
    return met.select("id", "f.date", "f.seq", "k", "v")


def head_state(log: DataFrame) -> DataFrame:
    """(id, k, v): the latest state; keys whose last value is null are absent."""
    return log.groupBy("id", "k").agg(F.max(F.struct("date", "seq", "v")).alias("m")).filter("m.v is not null").select("id", "k", "m.v")


def resolve_negative(head: DataFrame, diffs: DataFrame, asof: Column | str) -> DataFrame:
    """(id, k, v): the state at a date from the latest state and what each later change replaced (id, date, seq, k, was): of a
    key's changes after the date the first one tells, without any the head; null means the key was not there."""
    later = diffs.filter(F.col("date") > _at(asof)).groupBy("id", "k").agg(F.min(F.struct("date", "seq", "was")).alias("m"))
    both = head.select("id", "k", "v", F.lit(True).alias("held")).join(later, ["id", "k"], "full")
    value = F.when(F.col("m").isNotNull(), F.col("m.was")).otherwise(F.col("v"))
    return both.select("id", "k", value.alias("v")).filter("v is not null")


def first_last_with_property(log: DataFrame, key: str) -> DataFrame:
    """(id, first_date, last_date): the first and last keyframe of an entity at which its state has the key."""
    upto = Window.partitionBy("id").orderBy("date", "seq").rowsBetween(Window.unboundedPreceding, 0)
    own = F.last(F.when(F.col("k") == key, F.struct("v")), ignorenulls=True).over(upto)
    held = log.select("id", "date", own.alias("own")).filter("own.v is not null")
    return held.groupBy("id").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def upsert_keyframe(log: DataFrame, patch: DataFrame) -> DataFrame:
    """The log with the patch's rows; those of one entity, date and key replace the log's. States go on from there."""
    return log.join(patch.select("id", "date", "k"), ["id", "date", "k"], "left_anti").select(*log.columns).unionByName(patch.select(*log.columns))


def delete_keyframe(log: DataFrame, gone: DataFrame) -> DataFrame:
    """The log without the keyframes (id, date)."""
    return log.join(gone.select("id", "date"), ["id", "date"], "left_anti").select(*log.columns)


def move_keyframe(log: DataFrame, moves: DataFrame) -> DataFrame:
    """Keyframes (id, date) move to the date ``to``; rows that stand there under the same key give way."""
    moved = log.join(moves.select("id", "date", "to"), ["id", "date"]).withColumn("date", F.col("to")).select(*log.columns)
    return upsert_keyframe(delete_keyframe(log, moves), moved)


def bulk_patch(log: DataFrame, ids: DataFrame, date: str, patch: dict[str, str | None], seq: int) -> DataFrame:
    """The same keys and values for each of the ids at one date."""
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).cast("string").alias("v")) for k, v in patch.items()]))
    new = ids.select("id").distinct().select("id", rows.alias("p")).select("id", _at(date).alias("date"), "p.k", "p.v", F.lit(seq).cast(log.schema["seq"].dataType).alias("seq"))
    return upsert_keyframe(log, new)


def apply_tag_mutations(tagged: DataFrame, mutations: DataFrame) -> DataFrame:
    """(id, tags) after mutations (id, op, tags): first ``set`` replaces, then ``add`` adds, then ``remove`` takes away; equal
    operations on one id are one, and tags come in order."""
    by = mutations.groupBy("id").pivot("op", ["set", "add", "remove"]).agg(F.when(F.count("tags") > 0, F.array_distinct(F.flatten(F.collect_list("tags")))))
    none = F.array().cast("array<string>")
    both = tagged.join(by, "id", "left")
    tags = F.array_except(F.array_union(F.coalesce("set", "tags", none), F.coalesce("add", none)), F.coalesce("remove", none))
    return both.select("id", F.array_sort(tags).alias("tags"))


def visible_entities(state: DataFrame, zoom: float) -> DataFrame:
    """Entities with coordinates that are not hidden and whose zoom range, open where null, holds ``zoom``."""
    inside = F.coalesce(F.col("min_zoom") <= zoom, F.lit(True)) & F.coalesce(F.col("max_zoom") >= zoom, F.lit(True))
    return state.filter(F.col("coords").isNotNull() & ~F.coalesce("hidden", F.lit(False)) & inside)


def recent_events(df: DataFrame, as_of: str, hours: float, time: str = "date", keep_undated: bool = True) -> DataFrame:
    """Rows of the last hours before ``as_of``; rows without a time stay on demand."""
    age = F.unix_micros(_at(as_of).cast("timestamp")) - F.unix_micros(F.col(time).cast("timestamp"))
    young = age <= int(hours * 3_600_000_000)
    return df.filter(F.coalesce(young, F.lit(keep_undated)))


def variables_to_keyframes(sheet: DataFrame, names: list[str], form: str = "yyyy.MM.dd") -> DataFrame:
    """(id, date, k, v) of a sheet's rows (id, date text, a column for each variable): ``variables.name`` keys; rows without a
    readable date and empty values are left out."""
    held = sheet.select("id", F.try_to_timestamp("date", F.lit(form)).cast("timestamp_ntz").alias("date"), *[F.col(n).cast("string").alias(n) for n in names])
    long = held.unpivot(["id", "date"], names, "name", "v").filter("date is not null and v is not null and trim(v) <> ''")
    return long.select("id", "date", F.concat(F.lit("variables."), "name").alias("k"), "v")


def event_id(source: Column, region: Column, lng: Column, lat: Column) -> Column:
    """``source_region_hash``, the hash being that of the coordinates' text."""
    return F.concat_ws("_", source, region, js_hash(F.concat(lng.cast("string"), F.lit(","), lat.cast("string"))))


def geometry_events(sightings: DataFrame) -> DataFrame:
    """First sightings (source, region, lng, lat, date, seq): one row for each event id, the earliest; later ones repeat it.
    On a stream the same is ``streaming.entity_state.first_sightings`` over the id."""
    held = sightings.withColumn("event_id", event_id(*map(F.col, ("source", "region", "lng", "lat"))))
    first = held.groupBy("event_id").agg(F.min(F.struct("date", "seq", "source", "region", "lng", "lat")).alias("m"))
    return first.select("event_id", "m.*")


def descendants(parents: DataFrame, roots: DataFrame, max_depth: int = 1000) -> DataFrame:
    """(root, id, depth, path): all that lies below the roots (id), from (id, parent, position). path sorts depth first, siblings
    by position and id. A level is one join; what has been reached is not entered again."""
    step = lambda pos, i: F.concat(F.lpad(pos.cast("string"), 10, "0"), F.lit(":"), F.lpad(i.cast("string"), 12, "0"))
    kids = parents.select(F.col("parent").alias("at"), F.col("id").alias("kid"), step(F.col("position"), F.col("id")).alias("step")).filter("at is not null")
    front = roots.select(F.col("id").alias("root"), F.col("id").alias("at"), F.lit("").alias("path"))
    found = None
    for depth in range(1, max_depth + 1):
        new = front.join(kids, "at").select("root", F.col("kid").alias("id"), F.lit(depth).alias("depth"), F.concat_ws("/", F.nullif(F.col("path"), F.lit("")), "step").alias("path"))
        if found is not None:
            new = new.join(found.select("root", "id"), ["root", "id"], "left_anti").select("root", "id", "depth", "path")
        new = materialise(new)
        if new.isEmpty():
            break
        found = new if found is None else found.unionAll(new)
        front = new.select("root", F.col("id").alias("at"), "path")
    return new if found is None else found


def draw_order(df: DataFrame, kind: str, order: str) -> DataFrame:
    """df sorted as drawn: polygons, lines, points, all else; each in the order given. rank tells the four apart."""
    rank = F.when(F.col(kind) == "polygon", 0).when(F.col(kind) == "line", 1).when(F.col(kind) == "point", 2).otherwise(3)
    return df.withColumn("rank", rank).orderBy("rank", order)
