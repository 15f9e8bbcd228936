"""Keyed merges, deletes, status changes and counts over snapshot tables. Each operator gives the next snapshot;
``publish`` writes it beside the current one and swaps a pointer, so a table that is read is never overwritten."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def merge(existing: DataFrame, incoming: DataFrame, keys: list[str], policy: dict[str, str]) -> DataFrame:
    """Upsert by key with a policy a column (O, C, K, +; O where none is given): one full outer join."""
    e, i = existing.alias("e"), incoming.withColumn("__in", F.lit(True)).alias("i")
    both = e.withColumn("__old", F.lit(True)).alias("e").join(i, keys, "full_outer")
    out = [F.col(k) for k in keys]
    for c in existing.columns:
        if c in keys:
            continue
        if c not in incoming.columns:
            out.append(F.col(f"e.{c}"))
            continue
        old, new = F.col(f"e.{c}"), F.col(f"i.{c}")
        kind = policy.get(c, "O")
        had, got = F.col("__old").isNotNull(), F.col("__in").isNotNull()
        value = {"O": F.when(got, new).otherwise(old), "C": F.coalesce(new, old), "K": F.when(had, old).otherwise(new), "+": F.when(got & had, F.coalesce(old, F.lit(0)) + F.coalesce(new, F.lit(0))).when(got, new).otherwise(old)}[kind]
        out.append(value.alias(c))
    return both.select(*out)


def patch(existing: DataFrame, updates: DataFrame, keys: list[str], forced: tuple[str, ...] = ()) -> DataFrame:
    """Partial update: only non-null values overwrite, and nulls too in ``forced`` columns; no key is added."""
    u = updates.withColumn("__in", F.lit(True)).alias("u")
    both = existing.alias("e").join(u, keys, "left")
    value = lambda c: F.when(F.col("__in").isNotNull(), F.col(f"u.{c}")).otherwise(F.col(f"e.{c}")) if c in forced else F.coalesce(F.col(f"u.{c}"), F.col(f"e.{c}"))
    return both.select(*[F.col(c) if c in keys else (value(c).alias(c) if c in updates.columns else F.col(f"e.{c}")) for c in existing.columns])


def delete(df: DataFrame, doomed: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(doomed.select(*keys).distinct(), keys, "left_anti")


def cascade(parents: DataFrame, children: dict[str, tuple[DataFrame, str, str]], doomed: DataFrame, key: str) -> dict[str, DataFrame]:
    """Deletes parents and, children first, the rows that refer to them. children: name to (frame, its key to the parent, the parent's key)."""
    out = {}
    for name, (frame, fk, pk) in children.items():
        out[name] = frame.join(doomed.select(F.col(pk).alias(fk)).distinct(), fk, "left_anti")
    out["parents"] = delete(parents, doomed, [key])
    return out


def keep_only(df: DataFrame, scope: str, keep: DataFrame, key: str) -> DataFrame:
    """Within the scopes that ``keep`` (scope, key) names, drops the rows whose key is not in it."""
    of = df.join(keep.select(scope).distinct(), scope, "left_semi").join(keep.select(scope, key), [scope, key], "left_semi")
    return df.join(keep.select(scope).distinct(), scope, "left_anti").unionByName(of)


def transition(df: DataFrame, before: list[str], after: str, when: Column | None = None) -> DataFrame:
    ok = F.col("status").isin(before) & (F.lit(True) if when is None else F.coalesce(when, F.lit(False)))
    return df.withColumn("status", F.when(ok, after).otherwise(F.col("status")))


def by_status(df: DataFrame, status: str, source: str | None = None) -> DataFrame:
    """Rows of a status in reading order; an index that is missing comes first."""
    out = df.where(F.col("status") == status)
    return (out if source is None else out.where(F.col("source_id") == source)).orderBy("source_id", F.col("chunk_index").asc_nulls_first())


def added(existing: DataFrame, deltas: DataFrame, key: str, counters: list[str]) -> DataFrame:
    """Adds the deltas to the counters of their rows; a counter or delta that is null counts as nothing, and deltas without
    a row are dropped. Deltas are summed before they meet the table."""
    more = deltas.groupBy(key).agg(*(F.sum(F.coalesce(c, F.lit(0))).alias(f"__{c}") for c in counters))
    got = existing.join(more, key, "left")
    return got.withColumns({c: (F.coalesce(c, F.lit(0)) + F.coalesce(f"__{c}", F.lit(0))).cast(existing.schema[c].dataType) for c in counters}).select(existing.columns)


def duplicate_counts(found: DataFrame) -> DataFrame:
    """(run_id, file, content, semantic): the duplicates that each run found; another kind is an error."""
    kind = F.when(F.col("kind").isin("file", "content", "semantic"), F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("unknown kind of duplicate: "), F.coalesce("kind", F.lit("null")))))
    of = found.select("run_id", kind.alias("kind"))
    return of.groupBy("run_id").agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("file", "content", "semantic")))


def coverage(expected: DataFrame, actual: DataFrame, scope: str, key: str) -> DataFrame:
    """(scope, missing, complete): how many expected keys each scope lacks; nothing expected is complete."""
    lack = expected.join(actual.select(scope, key).distinct(), [scope, key], "left_anti").groupBy(scope).agg(F.count("*").alias("missing"))
    return expected.select(scope).distinct().join(lack, scope, "left").select(scope, F.coalesce("missing", F.lit(0)).alias("missing")).withColumn("complete", F.col("missing") == 0)


def usage_rollup(events: DataFrame) -> DataFrame:
    """(source, is_total, calls, cache_hits, tokens, cost_usd): by source and in all; a null source is only in the total."""
    part = events.groupBy("source", "kind").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"))
    roll = part.rollup("source").agg(
        F.grouping("source").cast("int").alias("is_total"),
        F.sum(F.when(F.col("kind") == "llm", F.col("n")).otherwise(0)).alias("calls"),
        F.sum(F.when(F.col("kind") == "cache_hit", F.col("n")).otherwise(0)).alias("cache_hits"),
        F.sum(F.when(F.col("kind") != "cache_hit", F.col("tokens")).otherwise(0)).alias("tokens"),
        F.round(F.sum(F.when(F.col("kind") != "cache_hit", F.col("cost")).otherwise(0.0)), 6).alias("cost_usd"),
    )
    return roll.where((F.col("is_total") == 1) | F.col("source").isNotNull())


def entity_counts(frames: dict[str, DataFrame]) -> DataFrame:
    every = None
    for name, df in frames.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("entity"), "n")
        every = one if every is None else every.unionByName(one)
    return every


def _pointers(spark: SparkSession, root: str, name: str) -> list[int]:
    """The numbers of a table's whole pointers, in order."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}/pointers")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    found = [s.getPath() for s in fs.listStatus(folder)]
    return sorted(int(p.getName()) for p in found if p.getName().isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def publish(df: DataFrame, root: str, name: str) -> str:
    """Writes a snapshot to a new version of a table and then a pointer with the next number; returns the version's path. A
    crash before the pointer is whole leaves the version before; of two writers of one number one fails."""
    spark = df.sparkSession
    path = f"{root}/{name}/v-{uuid.uuid4().hex}"
    df.write.parquet(path)
    n = max(_pointers(spark, root, name), default=0) + 1
    spark.createDataFrame([(path,)], "path string").coalesce(1).write.json(f"{root}/{name}/pointers/{n}")
    return path


def published(spark: SparkSession, root: str, name: str) -> bool:
    return bool(_pointers(spark, root, name))


def current(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The snapshot that the pointer with the largest number names."""
    n = _pointers(spark, root, name)[-1]
    return spark.read.parquet(spark.read.schema("path string").json(f"{root}/{name}/pointers/{n}").first()["path"])
