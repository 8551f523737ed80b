"""Places from addresses and addresses from places, by tables of known places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.functions import address, geo

#: Side of the cells that nearby places are looked up in, in degrees.
CELL = 0.5
#: Length of a degree of latitude, a little short.
KM_PER_DEGREE = 111.0


def geocode(rows: DataFrame, *providers: DataFrame, text: str = "location_address") -> DataFrame:
    """Rows without coordinates get those of the first provider (query, lat, lon) that knows their address; provider 0 is the rows' own."""
    out = rows.withColumn("_q", address.comparison_address(F.col(text)))
    lat, lon, source = [F.col("latitude")], [F.col("longitude")], F.when(address.coordinate(F.col("latitude")).isNotNull() & address.coordinate(F.col("longitude")).isNotNull(), 0)
    for i, p in enumerate(providers, 1):
        known = p.groupBy(address.comparison_address(F.col("query")).alias("_q")).agg(F.min(F.struct("lat", "lon")).alias(f"_p{i}"))
        out = out.join(known, "_q", "left")
        lat.append(F.col(f"_p{i}.lat"))
        lon.append(F.col(f"_p{i}.lon"))
        source = F.coalesce(source, F.when(F.col(f"_p{i}").isNotNull(), i))
    out = out.withColumn("geocoded_by", source)
    choose = lambda options: F.get(F.array(*options), F.col("geocoded_by"))
    return out.withColumns({"latitude": choose(lat), "longitude": choose(lon)}).select(*rows.columns, "geocoded_by")


def component(components, kind: str, field: str = "long_name"):
    """The first component of a kind in array<struct<types, long_name, short_name>>."""
    return F.get(F.filter(components, lambda c: F.array_contains(c["types"], kind)), F.lit(0))[field]


def components(rows: DataFrame, column: str = "components") -> DataFrame:
    c = F.col(column)
    city = F.coalesce(component(c, "locality"), component(c, "postal_town"), component(c, "administrative_area_level_2"))
    return rows.select("id", city.alias("city"), component(c, "administrative_area_level_1").alias("state"), component(c, "postal_code").alias("postcode"), component(c, "country", "short_name").alias("country"))


def reverse(rows: DataFrame, places: DataFrame, reach_km: float = 50.0) -> DataFrame:
    """id and the nearest place (name, km to a millimetre) within reach: looked up in the cell of a row and those around it.

    As many cells to either side as the reach takes up at the row's latitude, around the globe; ties go to the
    lesser name. The reach must be under a cell's height.
    """
    if reach_km > CELL * KM_PER_DEGREE:
        raise ValueError("the reach is larger than a cell")
    n = round(360 / CELL)
    row_of = lambda c: F.floor(c / CELL)
    column_of = lambda c: F.floor((c + 180) / CELL)
    # degrees of longitude that the reach takes up, a cell nearer to the pole
    wide = F.lit(reach_km / KM_PER_DEGREE) / F.greatest(F.lit(1e-6), F.cos(F.radians(F.least(F.lit(90.0), F.abs("latitude") + CELL))))
    side = F.least(F.lit(n // 2), F.ceil(wide / CELL) + 1).cast("int")
    own = rows.where("latitude IS NOT NULL AND longitude IS NOT NULL").select("id", "latitude", "longitude", side.alias("side"))
    own = own.select("*", F.explode(F.sequence(-F.col("side"), F.col("side"))).alias("j")).select("*", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("i"))
    own = own.select("id", "latitude", "longitude", (row_of(F.col("latitude")) + F.col("i")).alias("y"), F.pmod(column_of(F.col("longitude")) + F.col("j"), F.lit(n)).alias("x")).distinct()
    known = places.select("name", "lat", "lon", row_of(F.col("lat")).alias("y"), F.pmod(column_of(F.col("lon")), F.lit(n)).alias("x"))
    pairs = own.join(known, ["y", "x"]).withColumn("km", F.round(geo.haversine(F.col("latitude"), F.col("longitude"), F.col("lat"), F.col("lon")), 6)).where(F.col("km") <= reach_km)
    return pairs.groupBy("id").agg(F.min(F.struct("km", "name")).alias("n")).select("id", F.col("n.name").alias("name"), F.col("n.km").alias("km"))
