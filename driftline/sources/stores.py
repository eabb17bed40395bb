"""Readers and writers: yearly JSON track files, resumable writes by part, day snapshots, keyed upserts, a catalog probe.

Files become visible through a manifest, which is written after them. So a run that is killed leaves files that no
reader sees and that the next run overwrites, and a batch that runs twice leaves what one run leaves.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TRACK_FILE = "tracks array<struct<src: string, call: string, hex: string, type: string, points: array<array<double>>>>"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the cluster's checkpoint folder; only on one machine a temporary one will do."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return f"{context.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def read_years(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row per fix of yearly track files: src, call, hex, type, seq, lat, lon, alt, offset in seconds."""
    docs = spark.read.schema(TRACK_FILE).option("multiLine", True).json(paths)
    rows = docs.select(F.explode("tracks").alias("t")).select("t.*").select("src", "call", "hex", "type", F.posexplode("points").alias("seq", "p"))
    at = lambda i: F.get("p", F.lit(i))
    return rows.select("src", "call", "hex", "type", "seq", at(0).alias("lat"), at(1).alias("lon"), at(2).alias("alt"), at(3).alias("offset_s"))


def write_years(tracks: DataFrame, bucket: int = 1000) -> str:
    """Writes tracks (year, hex, points) as yearly files of one document each, about ``bucket`` tracks in it; returns the folder.

    The folder is a new one in the shared checkpoint folder, so that all executors see it.
    """
    path = shared_folder(tracks.sparkSession, "years")
    parts = max(1, -(-tracks.select("hex").distinct().count() // bucket))
    part = F.pmod(F.xxhash64("hex"), F.lit(parts))
    docs = tracks.groupBy("year", part.alias("part")).agg(F.collect_list(F.struct("hex", "points")).alias("tracks"))
    docs.select("year", "tracks").write.option("maxRecordsPerFile", 1).partitionBy("year").json(path)  # a multi-line file is one document
    return path


def write_documents(rows: DataFrame, keys: list[str], outer: str, inner: str, bucket: int = 1000) -> str:
    """Writes rows as documents {outer: [{keys, inner: [the other columns]}]}, each of about ``bucket`` rows; returns the folder.

    A document holds a bucket of hashes, so no key's rows need to meet in one: a key goes on in the next document.
    """
    path = shared_folder(rows.sparkSession, outer)
    rest = [c for c in rows.columns if c not in keys]
    parts = max(1, -(-rows.count() // bucket))
    part = F.pmod(F.xxhash64(*rest), F.lit(parts)).alias("part")
    groups = rows.groupBy(part, *keys).agg(F.collect_list(F.struct(*rest)).alias(inner))
    docs = groups.groupBy("part").agg(F.collect_list(F.struct(*keys, inner)).alias(outer))
    docs.select(outer).write.option("maxRecordsPerFile", 1).json(path)  # a multi-line file is one document
    return path


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """school, airport, tail, type of a nested registry document."""
    schema = "schools array<struct<name: string, airport: string, aircraft: array<struct<tail: string, type: string>>>>"
    docs = spark.read.schema(schema).option("multiLine", True).json(path)
    s = docs.select(F.explode("schools").alias("s")).select("s.name", "s.airport", F.explode("s.aircraft").alias("a"))
    return s.select(F.col("name").alias("school"), "airport", F.trim("a.tail").alias("tail"), "a.type").filter("tail <> ''")


def new_rows(incoming: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """incoming without keys that exist, and one row of each key."""
    return incoming.join(existing.select(key), key, "left_anti").dropDuplicates([key])


def with_random_key(rows: DataFrame, key: str) -> DataFrame:
    """A sampling key from 0 to 999,999 that is the same on every run."""
    return rows.withColumn("rand_key", F.pmod(F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long"), F.lit(1_000_000)))


def append(rows: DataFrame, path: str, partition: str | None = None) -> None:
    """All or nothing: Spark's committer moves files into place when the job ends."""
    writer = rows.write.mode("append")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def committed_parts(spark: SparkSession, path: str) -> set[int]:
    """Parts of a resumable write that are whole; as many as the write has, whatever its rows."""
    return {r["part"] for r in spark.read.parquet(f"{path}/manifest").collect()} if _exists(spark, f"{path}/manifest") else set()


def write_parts(rows: DataFrame, path: str, key: str, parts: int, at_once: int | None = None, most: int | None = None) -> int:
    """Writes rows in ``parts`` by a hash of ``key``; parts that the manifest has are left alone, so a run resumes another.

    ``at_once`` parts (all, if None) are one transaction, and one pass over rows; ``most`` ends the run after
    so many parts. Returns how many were written.
    """
    spark = rows.sparkSession
    done = committed_parts(spark, path)
    todo = [p for p in range(parts) if p not in done][:most]
    numbered = rows.withColumn("part", F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(parts)).cast("int"))
    step = at_once or len(todo)
    for group in (todo[i : i + step] for i in range(0, len(todo), step or 1)):
        own = numbered.filter(F.col("part").isin(group)).repartition("part")
        own.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{path}/data")
        spark.createDataFrame([(p,) for p in group], "part int").coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return len(todo)


def read_parts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of whole parts."""
    done = sorted(committed_parts(spark, path))
    if not done:
        return spark.createDataFrame([], schema)
    return spark.read.schema(f"{schema}, part int").parquet(f"{path}/data").filter(F.col("part").isin(done)).drop("part")


def snapshots(spark: SparkSession, path: str, before: int | None = None) -> dict[int, int]:
    """{day: the last batch that wrote it} (of batches ``before`` one); a row for each day and batch that touched it."""
    if not _exists(spark, f"{path}/manifest"):
        return {}
    rows = spark.read.schema("day long, batch long").parquet(f"{path}/manifest")
    rows = rows if before is None else rows.filter(F.col("batch") < before)
    return {r["day"]: r["last"] for r in rows.groupBy("day").agg(F.max("batch").alias("last")).collect()}


def read_days(spark: SparkSession, path: str, schema: str, days: set[int] | None = None, before: int | None = None, closed: bool = False) -> DataFrame:
    """The last snapshot of every day (of ``days``), or only of those after which another day has begun."""
    found = snapshots(spark, path, before)
    last = max(found, default=None)
    wanted = [(d, b) for d, b in sorted(found.items()) if (days is None or d in days) and not (closed and d == last)]
    if not wanted:
        return spark.createDataFrame([], f"{schema}, day long")
    rows = spark.read.schema(f"{schema}, day long, batch long").parquet(f"{path}/data")
    return rows.filter(F.struct("day", "batch").isin([F.struct(F.lit(d).cast("long").alias("day"), F.lit(b).cast("long").alias("batch")) for d, b in wanted])).drop("batch")


def flush_days(batch: DataFrame, batch_id: int, path: str, keys: list[str], order: list[str]) -> None:
    """Writes whole snapshots of the days that ``batch`` (with a ``day``) touches: what was there, and the batch's later rows by ``keys``.

    A snapshot has its own folder, and counts once the batch's manifest is there: a rerun of the batch starts from
    the same earlier snapshots and overwrites its own. Only rows of the batch are new work; stored ones are
    carried over as they are.
    """
    spark = batch.sparkSession
    batch = batch.withColumn("day", F.col("day").cast("long"))
    days = {r["day"] for r in batch.select("day").distinct().collect()}
    if not days:
        return
    own = batch.drop("day").schema
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own)
    stored = read_days(spark, path, schema, days, before=batch_id)
    merged = upsert(stored, batch.select(*stored.columns), ["day", *keys], order)
    merged = merged.withColumn("batch", F.lit(batch_id).cast("long"))
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(f"{path}/data")
    manifest = spark.createDataFrame([(d,) for d in sorted(days)], "day long").coalesce(1)
    manifest.write.mode("overwrite").parquet(f"{path}/manifest/batch={batch_id}")


def remove_superseded(spark: SparkSession, path: str) -> int:
    """Deletes the snapshots that a later batch of the same day replaced; returns how many."""
    last = snapshots(spark, path)
    every = spark.read.schema("day long, batch long").parquet(f"{path}/manifest").collect()
    old = [(r["day"], r["batch"]) for r in every if r["batch"] < last[r["day"]]]
    for day, batch in old:
        _remove(spark, f"{path}/data/day={day}/batch={batch}")
    return len(old)


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The latest row of every key, incoming ones winning ties."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(*(F.desc(o) if isinstance(o, str) else o for o in order), F.desc("_new"))
    return both.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_new")


def catalog_probe(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """table, rows and columns of every table."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows", F.lit(len(df.columns)).alias("columns"))
        out = row if out is None else out.unionAll(row)
    return out
