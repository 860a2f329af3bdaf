"""The reference entities of the data model, as views over the given tables, and the same views as SQL.

occurrence (tile, taxon, n), tile (header with place and time), species, centroid, claim, image and ledger rows are
plain projections, so filters and column pruning reach the Parquet scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of occurrences in a task's share; about a kilobyte of memory each in the widest stage that follows.
ROWS_A_TASK = 250_000


def occ(spark: SparkSession, sf_dir: str, of: DataFrame | None = None) -> DataFrame:
    """(tile, taxon, n), of the tiles in `of` only where it is given: Catalyst pushes no join below an aggregate, so the
    rows of other tiles are left out before they are added up.

    A task's share is a number of rows, so that its memory does not grow with the table: all that follows by tile keeps
    the partitions made here. A small table is left to Spark."""
    lines = table(spark, sf_dir, "lineitem")
    rows = lines.select(F.col("l_orderkey").alias("tile"), F.col("l_partkey").alias("taxon"), "l_quantity")
    parts = -(-lines.count() // ROWS_A_TASK)
    if parts > spark.sparkContext.defaultParallelism:
        rows = rows.repartition(parts, "tile")
    if of is not None:
        rows = rows.join(of.select("tile"), "tile", "left_semi")
    return rows.groupBy("tile", "taxon").agg(F.sum("l_quantity").cast("long").alias("n"))


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("eco"))
    o = o.select(
        F.col("o_orderkey").alias("tile"), "o_custkey", F.col("o_orderdate").alias("seen"),
        ((F.col("o_orderkey") * 7919 % 18000) / 100.0 - 90.0).alias("lat"), ((F.col("o_orderkey") * 104729 % 36000) / 100.0 - 180.0).alias("lon"),
    )
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("tile", "eco", "seen", "lat", "lon")


def tile_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tile, species_data map<string,long>)."""
    rows = occ(spark, sf_dir).groupBy("tile").agg(F.sort_array(F.collect_list(F.struct(F.col("taxon").cast("string").alias("k"), "n"))).alias("e"))
    return rows.select("tile", F.map_from_entries("e").alias("species_data"))


def species(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    size = F.col("p_size")
    return p.select(
        F.col("p_partkey").alias("taxon"), F.col("p_name").alias("name"), F.col("p_brand").alias("family"), F.col("p_type").alias("genus"), size.alias("size"),
        F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("subsp. "), size.cast("string"))).otherwise("NA").alias("subspecies"),
        F.when(size % 7 != 0, F.concat_ws("; ", "p_type", "p_brand")).alias("native"),
        F.when(size % 3 == 0, F.concat_ws("; ", "p_brand", F.split_part("p_name", F.lit(" "), F.lit(1)))).alias("introduced"),
        F.when(size % 5 == 0, "NA").when(size % 5 == 1, "").when(size % 5 == 2, "NO").when(size % 5 == 3, "NO;YES").otherwise("YES").alias("intact"),
        F.when(size % 2 == 0, F.concat(F.lit("human "), F.col("p_name"))).alias("habit_human"), F.concat(F.lit("ai "), F.col("p_type")).alias("habit_ai"),
        F.col("p_retailprice").alias("price"),
    )


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    i = F.col("vec_id")
    return e.select(
        F.col("label").alias("taxon"), i.alias("cluster"), F.col("embedding").cast("array<double>").alias("v"), (i % 97 + 1).alias("occurrences"),
        F.when(i % 10 != 0, (i * 13) % 2000).alias("elevation"), (i % 8 + 2017).cast("int").alias("year"),
    )


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    return e.select(
        i.alias("id"), F.col("user_id").alias("taxon"), F.col("event_type").alias("claim_type"), F.col("props").alias("claim_value"), "value", F.col("ts").alias("created"),
        ((i * 37 % 100) / 100.0).alias("confidence"), F.when(i % 7 != 0, i % 5).alias("corroboration"), (i % 4).cast("int").alias("n_sources"), (i % 3 != 0).alias("current"),
    )


#: The same views for an independent SQL engine, to stand before a query.
SQL = """
WITH occ AS (SELECT l_orderkey AS tile, l_partkey AS taxon, CAST(sum(l_quantity) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2),
tiles AS (SELECT o_orderkey AS tile, c_nationkey AS eco, o_orderdate AS seen, CAST(o_orderkey * 7919 % 18000 AS DOUBLE) / 100.0 - 90.0 AS lat,
  CAST(o_orderkey * 104729 % 36000 AS DOUBLE) / 100.0 - 180.0 AS lon FROM orders JOIN customer ON o_custkey = c_custkey),
species AS (SELECT p_partkey AS taxon, p_name AS name, p_brand AS family, p_type AS genus, p_size AS size,
  CASE WHEN p_partkey % 4 = 0 THEN 'subsp. ' || p_size ELSE 'NA' END AS subspecies,
  CASE WHEN p_size % 7 <> 0 THEN p_type || '; ' || p_brand END AS native,
  CASE WHEN p_size % 3 = 0 THEN p_brand || '; ' || split_part(p_name, ' ', 1) END AS introduced,
  CASE p_size % 5 WHEN 0 THEN 'NA' WHEN 1 THEN '' WHEN 2 THEN 'NO' WHEN 3 THEN 'NO;YES' ELSE 'YES' END AS intact,
  CASE WHEN p_size % 2 = 0 THEN 'human ' || p_name END AS habit_human, 'ai ' || p_type AS habit_ai, p_retailprice AS price FROM part),
centroids AS (SELECT label AS taxon, vec_id AS cluster, CAST(embedding AS DOUBLE[]) AS v, vec_id % 97 + 1 AS occurrences,
  CASE WHEN vec_id % 10 <> 0 THEN (vec_id * 13) % 2000 END AS elevation, CAST(vec_id % 8 + 2017 AS INTEGER) AS year FROM embeddings),
claims AS (SELECT event_id AS id, user_id AS taxon, event_type AS claim_type, props AS claim_value, value, ts AS created,
  CAST(event_id * 37 % 100 AS DOUBLE) / 100.0 AS confidence, CASE WHEN event_id % 7 <> 0 THEN event_id % 5 END AS corroboration,
  CAST(event_id % 4 AS INTEGER) AS n_sources, event_id % 3 <> 0 AS current FROM events)
"""
