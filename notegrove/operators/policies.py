"""Decisions of an ingest that a flag or a default settles, and listings of the note store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notegrove.functions import biblio

DUPLICATE_ACTIONS = ("skip", "continue", "abort")


def duplicate_action(skip: bool = False, force: bool = False, default: str = "skip") -> str:
    """What happens to a suspected duplicate; the two flags exclude each other."""
    if skip and force:
        raise ValueError("skip and force exclude each other")
    if default not in DUPLICATE_ACTIONS:
        raise ValueError(f"unknown action {default!r}")
    return "skip" if skip else "continue" if force else default


def after_duplicates(files: DataFrame, action: str, kind: str = "dup_kind") -> DataFrame:
    """Files (with their dup_kind) that go on: new ones, and suspected duplicates by meaning if the action is to continue; with
    ``abort`` any of those is an error. Duplicates of bytes or text never go on."""
    if action == "abort":
        suspect = F.when(F.col(kind) == "semantic", F.raise_error(F.lit("a file repeats a source by meaning"))).otherwise(F.col(kind))
        return files.withColumn(kind, suspect).where(F.col(kind) == "new")
    return files.where(F.col(kind).isin("new", "semantic") if action == "continue" else F.col(kind) == "new")


def content_paging(found_file: Column, found_book: Column, interactive: bool = False, start_file: int | None = None, start_book: int | None = None, skip: bool = False) -> tuple[Column, Column, Column]:
    """(first page of the file, its number in the book, confidence). An explicit page is confirmed; the page that was found
    counts only where someone can confirm it, all else starts at (1, 1)."""
    if start_file is not None:
        return F.lit(start_file), F.lit(1 if start_book is None else start_book), F.lit("confirmed")
    if skip or not interactive:
        return F.lit(1), F.lit(1), F.lit("skipped")
    return F.coalesce(found_file, F.lit(1)), F.coalesce(found_book, F.lit(1)), F.when(found_file.isNotNull(), "heuristic").otherwise("skipped")


def bibliography(kind: Column, confidence: Column, fields: Column, skip: bool = False) -> Column:
    """``keep`` complete metadata, ``keep_incomplete`` with the skip flag, else ``drop`` the source."""
    return F.when(biblio.complete(kind, confidence, fields), "keep").otherwise("keep_incomplete" if skip else "drop")


def newest(df: DataFrame, at: str, key: str) -> DataFrame:
    """A listing, newest first; ties by key, undated rows last."""
    return df.orderBy(F.col(at).desc_nulls_last(), key)


def numbered_newest(df: DataFrame, group: str, at: str, key: str) -> DataFrame:
    """Rows with their place, from 1, in the listing of their group."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(F.col(at).desc_nulls_last(), key)))


def lookup(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Each wanted key with its row, or nulls: any number of point lookups as one join."""
    return wanted.select(key).distinct().join(df, key, "left")


def without_notes(concepts: DataFrame, notes: DataFrame, key: str = "note_id") -> DataFrame:
    """Concepts whose note is not set or not there; rows are kept whole."""
    return concepts.join(notes.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def batch_sample(df: DataFrame, order: list[str], most: int = 20) -> DataFrame:
    """The first rows of a batch, which are all that a review shows."""
    return df.orderBy(*order).limit(most)


def start_run(runs: DataFrame, signature: str, at: Column) -> DataFrame:
    """The ledger with one more run, numbered after the last."""
    row = runs.agg((F.coalesce(F.max("run_id"), F.lit(0)) + 1).alias("run_id"))  # one row
    new = row.withColumns({"pipeline_signature": F.lit(signature), "status": F.lit("running"), "started_at": at})
    return runs.unionByName(new, allowMissingColumns=True)


def finish_runs(runs: DataFrame, done: DataFrame, totals: list[str]) -> DataFrame:
    """The ledger after runs (run_id, status, finished_at and totals) ended: totals that are given overwrite, null ones leave what
    is there."""
    d = done.select("run_id", F.col("status").alias("__s"), F.col("finished_at").alias("__f"), *(F.col(t).alias(f"__{t}") for t in totals))
    out = runs.join(d, "run_id", "left").withColumns({"status": F.coalesce("__s", "status"), "finished_at": F.coalesce("__f", "finished_at"), **{t: F.coalesce(f"__{t}", t) for t in totals}})
    return out.select(runs.columns)
