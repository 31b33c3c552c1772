"""Incremental ingestion: new rows of a folder, duplicates dropped as they arrive, results kept in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators.ledger import fingerprint, merge_across_files


def new_files(spark: SparkSession, path: str, per_batch: int = 1000) -> DataFrame:
    """A stream of files with their digest."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", per_batch).load(path).select("path", "modificationTime", "length", "content", F.sha2("content", 256).alias("sha256"))


def first_arrivals(files: DataFrame, delay: str = "7 days") -> DataFrame:
    """Files whose bytes haven't arrived before within the delay."""
    return files.withWatermark("modificationTime", delay).dropDuplicatesWithinWatermark(["sha256"])


def rolling_totals(rows: DataFrame, time: str, window: str = "1 day", delay: str = "2 days") -> DataFrame:
    """In and out per account, currency and window of event time; late rows count until the watermark passes."""
    a = F.col("amount")
    grouped = rows.withWatermark(time, delay).groupBy(F.window(time, window), "account", "currency")
    return grouped.agg(F.sum(F.when(a >= 0, a).otherwise(0)).alias("total_in"), F.sum(F.when(a < 0, -a).otherwise(0)).alias("total_out"), F.count(F.lit(1)).alias("n"))


def merge_arrivals(rows: DataFrame, table: str, checkpoint: str, buckets: int = 64) -> None:
    """Keep a table of all rows (row_id, file and what a fingerprint needs) with `kept` as if all had come at once.

    Each arrival is merged with the rows of its own fingerprints: only the
    buckets that it touches are read, merged again and replaced, so a late file
    can displace earlier rows. A row that is sent again replaces what it was,
    also where its fingerprint is another now: beside the table stands where
    each row is, bucketed by row, and the bucket that the row leaves is merged
    again too. An arrival that is run again changes nothing.
    """
    spark = rows.sparkSession
    places = f"{table}-places"
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")

    def write(batch: DataFrame, epoch: int) -> None:
        # Of a row that comes twice in an arrival one stays, whichever way the arrival is read.
        kept = [F.col(c) for c in batch.columns if c != "row_id"]
        new = batch.groupBy("row_id").agg(F.max(F.struct(*kept)).alias("r")).select("row_id", "r.*").select(*batch.columns)
        new = new.withColumn("bucket", bucket(F.coalesce(fingerprint(), F.col("row_id").cast("string"))))
        came = new.select("row_id", "bucket", bucket("row_id").alias("at"))
        touched = [came.select("bucket")]
        if exists(spark, places):
            known = spark.read.parquet(places).join(F.broadcast(came.select("at").distinct()), "at", "left_semi")  # `buckets` rows at most
            touched.append(known.join(came.select("row_id"), "row_id", "left_semi").select("bucket"))
            came = came.unionByName(known.join(came.select("row_id"), "row_id", "left_anti"))
        hit = sorted({r.bucket for t in touched for r in t.distinct().collect()})  # `buckets` numbers at most
        merged = new
        if exists(spark, table):
            old = spark.read.parquet(table).drop("kept").filter(F.col("bucket").isin(hit))
            merged = new.unionByName(old.join(new.select("row_id"), "row_id", "left_anti"))
        staged = f"{table}-arrival-{epoch}"
        merge_across_files(merged).write.mode("overwrite").parquet(f"{staged}/rows")
        came.write.mode("overwrite").parquet(f"{staged}/places")
        done = spark.read.parquet(f"{staged}/rows")
        left = {r.bucket for r in done.select("bucket").distinct().collect()}
        replace_buckets(done, table, "bucket")
        for empty in set(hit) - left:
            remove(spark, f"{table}/bucket={empty}")
        replace_buckets(spark.read.parquet(f"{staged}/places"), places, "at")
        remove(spark, staged)

    rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def replace_buckets(rows: DataFrame, table: str, bucket: str) -> None:
    """Put rows in the place of those of their own buckets."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(bucket).parquet(table)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def latest_pages(pages: DataFrame, file: str = "file_id") -> DataFrame:
    """Early results of recognised files: of each file the rows read from the most pages so far, which later ones replace."""
    return pages.groupBy(file).agg(F.max_by(F.struct("pages_done", "n_rows"), "pages_done").alias("r")).select(file, "r.pages_done", "r.n_rows")


def ingest(rows: DataFrame, table: str, checkpoint: str) -> None:
    """Append the stream's rows to a Parquet table by batch; a batch that is run again replaces itself."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("fingerprint", fingerprint()).withColumn("batch", F.lit(epoch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(table)

    rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
