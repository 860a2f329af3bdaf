"""The store of claims: created, superseded and rated again by a stream of commands, with every version kept.

Each micro-batch is merged with the claims that it names and written as a folder of changes, with the batch's number. A
batch that is run again after a failure writes the same folder again, so no command counts twice; the store is the
last change of each claim.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from arborlens.functions.confidence import conf_database
from arborlens.workspace import materialize

SOURCES = "array<struct<url:string,type:string,credibility:double>>"
COMMAND = f"command long, action string, taxon long, claim_type string, claim_value string, confidence double, sources {SOURCES}, at timestamp_ntz"
FIELDS = (
    ("taxon", "long"), ("claim_type", "string"), ("version", "long"), ("id", "long"), ("claim_value", "string"), ("confidence", "double"), ("sources", SOURCES),
    ("created", "timestamp_ntz"), ("updated", "timestamp_ntz"), ("supersedes", "long"), ("is_current", "boolean"),
)
CLAIM = ", ".join(f"{n} {t}" for n, t in FIELDS)
_KEY = ["taxon", "claim_type"]


def current_state(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """Every version of every claim as the batches so far (those below `before`) left it."""
    rows = spark.read.schema(f"{CLAIM}, batch long").parquet(f"{path}/changes")
    if before is not None:
        rows = rows.where(F.col("batch") < before)
    names = [n for n, _ in FIELDS]
    last = F.max_by(F.struct(*[n for n in names if n not in (*_KEY, "version")]), "batch")
    return rows.groupBy(*_KEY, "version").agg(last.alias("_c")).select(*_KEY, "version", "_c.*").select(*names)


def merged(store: DataFrame, commands: DataFrame) -> DataFrame:
    """The claims that commands change. create and supersede make the next version of (taxon, claim_type), which supersedes
    the current one; recalculate rates the version that is current at its turn from its sources. Commands follow `at`,
    then their number; a number that was seen before is left out; commands without taxon or type or of another action
    change nothing."""
    rows = commands.where(F.col("action").isin("create", "supersede", "recalculate") & F.col("taxon").isNotNull() & F.col("claim_type").isNotNull())
    rows = rows.groupBy("command").agg(F.min_by(F.struct(*[c for c in commands.columns if c != "command"]), "at").alias("_r")).select("command", "_r.*")
    touched = rows.select(*_KEY).distinct()
    old = store.join(touched, _KEY, "left_semi")
    made = rows.where("action <> 'recalculate'").join(old.select(F.col("id").alias("command")), "command", "left_anti")
    top = old.groupBy(*_KEY).agg(F.max("version").alias("_v"), F.max_by("id", "version").alias("_top"))
    order = Window.partitionBy(*_KEY).orderBy("at", "command")
    made = made.join(top, _KEY, "left").withColumns({"_n": F.row_number().over(order), "_before": F.lag("command").over(order)})
    new = made.select(
        *_KEY, (F.coalesce("_v", F.lit(0)) + F.col("_n")).cast("long").alias("version"), F.col("command").alias("id"), "claim_value", "confidence", "sources", F.col("at").alias("created"),
        F.col("at").alias("updated"), F.coalesce("_before", "_top").alias("supersedes"), F.lit(False).alias("is_current"),
    )
    both = old.unionByName(new)
    # a rating concerns the last version made before its turn: one walk over claims and ratings of a key in their order, not
    # every pair of them
    rated = rows.where("action = 'recalculate' and at is not null").select(*_KEY, F.col("at").alias("_at"), F.col("command").alias("_c"), F.lit(0).alias("_made"), F.lit(None).cast("long").alias("version"))
    turns = both.where("created is not null").select(*_KEY, F.col("created").alias("_at"), F.col("id").alias("_c"), F.lit(1).alias("_made"), "version").unionByName(rated)
    so_far = Window.partitionBy(*_KEY).orderBy("_at", "_c", "_made").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turns = turns.withColumn("version", F.max("version").over(so_far)).where("_made = 0 and version is not null")
    hit = turns.groupBy(*_KEY, "version").agg(F.max("_at").alias("_rated"))
    last = F.max("version").over(Window.partitionBy(*_KEY))
    out = both.join(hit, [*_KEY, "version"], "left").withColumn("is_current", F.col("version") == last)
    again = F.col("_rated").isNotNull()
    out = out.withColumn("confidence", F.when(again, conf_database(F.coalesce("sources", F.array().cast(SOURCES)))).otherwise(F.col("confidence")))
    return out.withColumn("updated", F.when(again, F.greatest("updated", "_rated")).otherwise(F.col("updated"))).drop("_rated")


def run_commands(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Work off the commands (COMMAND) that there are; path holds the store."""
    spark = stream.sparkSession

    def write(commands: DataFrame, batch: int) -> None:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/changes")
        if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            store = spark.createDataFrame([], CLAIM)
        else:
            store = current_state(spark, path, batch)
        # written aside first, as the store that is read lies in the same folder
        changes = materialize(merged(store, commands), "changes")
        changes.write.mode("overwrite").parquet(f"{path}/changes/batch={batch}")

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
