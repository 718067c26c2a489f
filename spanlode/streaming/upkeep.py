"""File events as a stream: the state of the index after every micro-batch, and quiet periods of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlode.plans.runtime import shared_folder


def new_folder(spark: SparkSession) -> str:
    """A new folder below the one the cluster shares."""
    return f"{shared_folder(spark)}/{spark.sparkContext._jvm.java.util.UUID.randomUUID().toString()}"


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key the row with the greatest ``seq``; full copies are one."""
    rest = ["seq", *[c for c in rows.columns if c not in (*keys, "seq")]]
    return rows.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("r")).select(*keys, "r.*")


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def index_state(spark: SparkSession, source: str, schema: T.StructType, keys: list[str], seq: str, columns: list[str], files_per_batch: int = 1, compact_every: int = 20) -> DataFrame:
    """Reads ``source`` as a stream of late and repeated events and keeps, per key, the latest by ``seq``.

    Every micro-batch is reduced to its latest events and written as one numbered part; a part that a retried batch
    writes again replaces itself, so each event counts once. The state is the latest row over all parts: replaying
    events, late ones and copies change nothing. Every ``compact_every`` batches the parts are merged into one base,
    so the state stays as large as its keys. What a base is made of is deleted only at the next one: a batch that is
    retried finds it again. Files are read once each, and what the source drops later stays.
    """
    folder = new_folder(spark)
    at, _, name = source.rstrip("/").rpartition("/")
    source = f"{at}/[{name[0]}]{name[1:]}"  # as a pattern, a single file will do as well as a folder
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    events = events.select(*keys, F.col(seq).alias("seq"), *columns)
    done = [0]

    def held(upto: int) -> DataFrame:
        """The last base before ``upto`` and the parts after it; batches are numbered from 0 and none is left out."""
        base = upto // compact_every * compact_every
        paths = ([f"{folder}/base={base}"] if base else []) + [f"{folder}/part={n}" for n in range(base, upto)]
        return latest(spark.read.schema(events.schema).parquet(*paths), keys)

    def upsert(batch: DataFrame, number: int) -> None:
        latest(batch, keys).write.mode("overwrite").parquet(f"{folder}/part={number}")
        done[0] = number + 1
        if done[0] % compact_every == 0:
            last = done[0] - compact_every
            whole = spark.read.schema(events.schema).parquet(*([f"{folder}/base={last}"] if last else []), *[f"{folder}/part={n}" for n in range(last, done[0])])
            latest(whole, keys).write.mode("overwrite").parquet(f"{folder}/base={done[0]}")
            for n in range(last - compact_every, last):
                _delete(spark, f"{folder}/part={n}")
            _delete(spark, f"{folder}/base={last - compact_every}")

    query = events.writeStream.option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).foreachBatch(upsert).start()
    query.awaitTermination()
    return held(done[0]) if done[0] else spark.createDataFrame([], events.schema)


def quiet_periods(events: DataFrame, key: str, at: str, gap_seconds: int) -> DataFrame:
    """(key, period, first_at, last_at, n_events): runs of a key's events with no pause longer than the gap; a flush
    follows each. Events are first reduced to one per second, so a key's window holds its seconds, not its events."""
    seconds = events.where(F.col(at).isNotNull()).groupBy(key, F.unix_seconds(F.col(at).cast("timestamp")).alias("s")).agg(F.count("*").alias("n"))
    order = Window.partitionBy(key).orderBy("s")
    new = F.coalesce(F.col("s") - F.lag("s").over(order) > gap_seconds, F.lit(True)).cast("int")
    runs = seconds.withColumn("new", new).withColumn("period", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = runs.groupBy(key, "period").agg(F.min("s").alias("a"), F.max("s").alias("b"), F.sum("n").alias("n_events"))
    kind = events.schema[at].dataType
    return out.select(key, "period", F.timestamp_seconds("a").cast(kind).alias("first_at"), F.timestamp_seconds("b").cast(kind).alias("last_at"), "n_events")
