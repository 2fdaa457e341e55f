"""Places by name, URLs, distances as text, GeoJSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed text that is left out of names.
COUNTRY = ", Israel"


def geocode(places: DataFrame, queries: DataFrame, most: int = 5) -> DataFrame:
    """(q, place_id, display_name, r): the best `most` places for each query, by rank, then id.

    A place matches if its name contains the query, whatever the case. Both meet on the query's first three letters,
    or fewer if it has no more: names are looked up under all of theirs, so no query is compared with every name.
    """
    name, begin = F.lower("full_name"), F.lower(F.substring("q", 1, 3))
    starts = F.sequence(F.lit(1), F.greatest(F.char_length(name), F.lit(1)))
    of = lambda n: F.transform(starts, lambda i: F.substring(name, i, F.lit(n)))
    parts = F.array_distinct(F.concat(F.array(F.lit("")), of(1), of(2), of(3)))
    met = places.withColumn("part_", F.explode(parts)).join(queries.distinct().withColumn("begin_", begin), F.col("part_") == F.col("begin_"))
    met = met.where(F.contains(name, F.lower("q"))).drop("part_", "begin_")
    r = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("rank"), "place_id"))
    return met.withColumn("r", r.cast("bigint")).where(F.col("r") <= most).select("q", "place_id", F.replace("full_name", F.lit(COUNTRY), F.lit("")).alias("display_name"), "r")


def scenario_url(lat: Column, lon: Column, base: str = "https://example.org/") -> Column:
    return F.format_string(f"{base}?lat=%.6f&lon=%.6f", lat, lon)


def edit_url(zoom: Column, lat: Column, lon: Column, base: str = "https://www.openstreetmap.org/edit") -> Column:
    """Where the map around a place is edited: the zoom to whole steps, halves up."""
    return F.format_string(f"{base}#map=%d/%.5f/%.5f", F.floor(zoom + 0.5), lat, lon)


def from_url(url: Column) -> tuple[Column, Column]:
    """Latitude and longitude of a URL; null where they are missing or no numbers."""
    return tuple(F.try_parse_url(url, F.lit("QUERY"), F.lit(k)).try_cast("double") for k in ("lat", "lon"))


def distance_text(metres: Column, amah_m: float) -> Column:
    """A distance in amot and metres, halves rounded up."""
    n = lambda c: F.format_number(F.floor(c + 0.5), 0)
    return F.concat(n(metres / amah_m), F.lit(" amot ("), n(metres), F.lit(" m)"))


def sides_text(n: Column, e: Column, s: Column, w: Column) -> Column:
    """'north', 'north and east', 'north, east and south'; empty if no side is set."""
    words = F.array_compact(F.array(*[F.when(c, v) for c, v in ((n, "north"), (e, "east"), (s, "south"), (w, "west"))]))
    k = F.size(words)
    return F.when(k == 0, "").when(k == 1, words[0]).otherwise(F.concat(F.array_join(F.slice(words, 1, F.greatest(k - 1, F.lit(1))), ", "), F.lit(" and "), F.element_at(words, F.when(k > 0, k).otherwise(1))))


def geojson(ring: Column, layer: Column) -> Column:
    """A feature with one polygon from a closed ring of points."""
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(layer.alias("layer")).alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.array(F.transform(ring, lambda p: F.array(p["x"], p["y"]))).alias("coordinates")).alias("geometry")))
