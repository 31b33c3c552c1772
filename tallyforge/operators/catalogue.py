"""Saved profiles and sessions as keyed tables: every change gives the table's next state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DELETE_AFTER, WARN_AFTER = 30, 25


def upsert(table: DataFrame, incoming: DataFrame, key: str = "id") -> DataFrame:
    """Incoming rows replace those of the same key."""
    return table.join(incoming.select(key), key, "left_anti").unionByName(incoming, allowMissingColumns=True)


def patch(table: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Columns of `changes` that aren't null replace the old values of the same key."""
    fields = [c for c in changes.columns if c != key]
    renamed = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in fields])
    joined = table.join(renamed, key, "left")
    return joined.select(*[F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in fields else F.col(c) for c in table.columns])


def delete(table: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    return table.join(keys.select(key), key, "left_anti")


def duplicate(table: DataFrame, keys: DataFrame, new_id: Column, suffix: str = " (copy)", key: str = "id") -> DataFrame:
    """The table and a copy of the rows of those keys, under new ids and names."""
    copies = table.join(keys.select(key), key, "left_semi").withColumns({key: new_id, "name": F.concat("name", F.lit(suffix))})
    return table.unionByName(copies)


def add_version(table: DataFrame, versions: DataFrame, key: str = "id") -> DataFrame:
    """Append a version (a struct column `version` by key) to the profiles' arrays."""
    joined = table.join(versions.select(key, "version"), key, "left")
    return joined.withColumn("versions", F.when(F.col("version").isNotNull(), F.array_append("versions", F.col("version"))).otherwise(F.col("versions"))).select(*table.columns)


def sessions_due(sessions: DataFrame, now: Column, opened: str = "last_opened") -> DataFrame:
    """Sessions with `fate`: delete after 30 days without use, warn from 25 on, else keep; and the days that remain."""
    age = (now.cast("double") - F.col(opened).cast("double")) / 86400
    return sessions.withColumns({"fate": F.when(age > DELETE_AFTER, "delete").when(age >= WARN_AFTER, "warn").otherwise("keep"), "days_left": F.greatest(F.ceil(DELETE_AFTER - age), F.lit(0)).cast("int")})


def storage_split(documents: DataFrame, kind: str) -> DataFrame:
    """Bytes of JSON by kind of document."""
    return documents.groupBy(kind).agg(F.sum(F.octet_length(F.to_json(F.struct(*[c for c in documents.columns if c != kind])))).cast("long").alias("bytes"))
