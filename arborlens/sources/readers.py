"""Readers of the reference's inputs: each names its schema, so nothing is inferred and files are split by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlens.sources.archives import archive_tables, zip_table

TILE_CSV = "geohash string, species_data string, total_occurrences long, species_count long, _bad string"
OCCURRENCE_TSV = "gbifID long, taxonKey long, scientificName string, decimalLatitude double, decimalLongitude double, year int"


def tile_csv(spark: SparkSession, path: str) -> DataFrame:
    """Tiles with their map, and `total_ok`, `count_ok`: whether the declared totals match it. Malformed rows go."""
    rows = spark.read.schema(TILE_CSV).csv(path, header=True, quote='"', escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord="_bad")
    rows = rows.where("_bad is null and geohash is not null").drop("_bad")
    m = F.from_json("species_data", "map<string,long>")
    total = F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda s, x: s + x)
    rows = rows.withColumn("m", m).where("m is not null")
    return rows.select("geohash", F.col("m").alias("species_data"), "total_occurrences", "species_count", (total == F.col("total_occurrences")).alias("total_ok"), (F.size("m") == F.col("species_count")).alias("count_ok"))


def quoted_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with quotes, doubled quotes and line ends inside them (stricter than a split at commas)."""
    return spark.read.schema(schema).csv(path, header=True, quote='"', escape='"', multiLine=True, lineSep="\n")


def na_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV whose nulls are written NA."""
    return spark.read.schema(schema).csv(path, header=True, nullValue="NA")


def tile_parquet(spark: SparkSession, path: str) -> DataFrame:
    """tiles-*.parquet; species_data is a JSON array of {taxon_id, count}, and text that is none an empty map."""
    rows = spark.read.option("pathGlobFilter", "*.parquet").parquet(path)
    entries = F.from_json("species_data", "array<struct<taxon_id:string,count:long>>")
    empty = F.array().cast("array<struct<taxon_id:string,count:bigint>>")
    return rows.withColumn("species_data", F.map_from_entries(F.coalesce(entries, empty)))


def tile_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON arrays of tiles, or single tiles."""
    return spark.read.schema("geohash string, species_data map<string,long>, datetime string").json(path, multiLine=True)


def occurrence_zip(spark: SparkSession, path: str, taxa: DataFrame) -> DataFrame:
    """Tab-separated occurrences in ZIP archives with taxon ids by key; rows without place or year go."""
    rows = zip_table(spark, path, OCCURRENCE_TSV, r"(?:.*/)?occurrence\.txt").drop("archive", "member", "place")
    rows = rows.join(taxa.select(F.col("key").alias("taxonKey"), "taxon_id"), "taxonKey")
    rows = rows.select(
        "taxon_id", F.col("scientificName").alias("species"), F.col("decimalLatitude").alias("latitude"), F.col("decimalLongitude").alias("longitude"),
        "year", F.col("gbifID").alias("gbif_id"),
    )
    return rows.dropna(subset=["latitude", "longitude", "year"])


def occurrence_predicate(rows: DataFrame, keys: list[int], first: int = 2017, last: int = 2024, uncertainty: float = 10.0) -> DataFrame:
    """Keys, with a place, years and uncertainty in range; an unknown uncertainty fails."""
    return rows.where(F.col("taxonKey").isin(keys) & F.col("decimalLatitude").isNotNull() & F.col("decimalLongitude").isNotNull() & F.col("year").between(first, last) & (F.col("uncertainty") <= uncertainty))


def darwin_core(spark: SparkSession, path: str) -> DataFrame:
    """Accepted taxa of a Darwin Core archive with the last row of each extension, in the order of its file."""
    tables = archive_tables(spark, path)
    taxa = tables["core"].where("taxonomicStatus <> 'SYNONYM'").select("id", "scientificName")
    last = lambda name, column, alias: tables[name].groupBy("id").agg(F.max_by(column, "place").alias(alias))
    return taxa.join(last("Distribution", "countryCode", "country"), "id", "left").join(last("SpeciesProfile", "isInvasive", "invasive"), "id", "left")


def kml_polygons(texts: DataFrame, column: str = "value") -> DataFrame:
    """(name, ring) of each placemark of KML documents, one document a row: triples of longitude, latitude and height,
    blank-separated."""
    names = F.xpath(F.col(column), F.lit("//Placemark/name/text()"))
    shapes = F.xpath(F.col(column), F.lit("//Placemark/Polygon/outerBoundaryIs/LinearRing/coordinates/text()"))
    rows = texts.select(F.explode(F.arrays_zip(names.alias("name"), shapes.alias("shape"))).alias("p")).select("p.name", "p.shape")
    point = lambda t: F.struct(F.split(t, ",")[0].cast("double").alias("x"), F.split(t, ",")[1].cast("double").alias("y"))
    return rows.select("name", F.transform(F.split(F.trim("shape"), r"\s+"), point).alias("ring"))


def result_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a line, from files not named summary_*."""
    rows = spark.read.schema(schema).json(path).withColumn("_file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    return rows.where(~F.col("_file").startswith("summary_")).drop("_file")


def best_year(rows: DataFrame, keys: list[str], wanted: int, value: str, year: str = "year") -> DataFrame:
    """The value of the wanted year where there is one, else of the latest."""
    order = F.struct((F.col(year) == wanted).cast("int"), F.col(year))
    return rows.groupBy(*keys).agg(F.max_by(F.struct(value, year), order).alias("_b")).select(*keys, "_b.*")
