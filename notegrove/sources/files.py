"""Scans of inbox and vault folders, and the text sinks."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notegrove.functions.biblio import year_of

#: What an inbox takes, and the vault's folders by note type.
EXTENSIONS = (".pdf", ".md", ".markdown", ".txt")
FOLDERS = {"source": "10_Sources", "literature": "20_Literature", "permanent": "30_Permanent", "moc": "40_MOCs"}


def inbox(spark: SparkSession, path: str) -> DataFrame:
    """(path, origin_type, file_checksum, content) of the files of known suffixes below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return files.where(ext.isin(*EXTENSIONS)).select("path", F.when(ext == ".pdf", "pdf").otherwise("md").alias("origin_type"), F.sha2("content", 256).alias("file_checksum"), "content")


def markdown(files: DataFrame) -> DataFrame:
    """Adds frontmatter (map), body, title and year: the title is the frontmatter's, else a heading at the very start, else the
    file's name. YAML needs Python; one pass over files, no shuffle."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import yaml

        for b in batches:
            rows = []
            for raw in b.column("content").to_pylist():
                text = (raw or b"").decode("utf-8", "replace").replace("\r\n", "\n")
                meta, body = {}, text
                if text.startswith("---"):
                    parts = text.split("---", 2)
                    if len(parts) == 3:
                        try:
                            got = yaml.safe_load(parts[1])
                        except yaml.YAMLError:
                            got = None
                        meta, body = (got if isinstance(got, dict) else {}), parts[2].lstrip("\n")
                flat = {str(k): ", ".join(map(str, v)) if isinstance(v, list) else str(v) for k, v in meta.items() if v is not None}
                rows.append((list(flat.items()), body))
            yield pa.RecordBatch.from_arrays([b.column("path"), b.column("file_checksum"), pa.array([m for m, _ in rows], pa.map_(pa.string(), pa.string())), pa.array([t for _, t in rows], pa.string())], names=["path", "file_checksum", "frontmatter", "body"])

    out = files.where("origin_type = 'md'").select("path", "file_checksum", "content").mapInArrow(parse, "path string, file_checksum string, frontmatter map<string,string>, body string")
    head, stem = F.regexp_extract("body", r"\A#\s+([^\n]+)", 1), F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    title = F.coalesce(F.col("frontmatter")["title"], F.when(head != "", F.btrim(head)), stem)
    return out.withColumn("title", title).withColumn("year", F.coalesce(F.col("frontmatter")["year"].try_cast("int"), year_of(F.col("frontmatter")["date"])))


def vault(spark: SparkSession, path: str) -> DataFrame:
    """Markdown notes of the vault's four folders with their note_type."""
    found = None
    for kind, folder in FOLDERS.items():
        one = spark.read.format("binaryFile").option("recursiveFileLookup", kind == "literature").option("pathGlobFilter", "*.md").load(f"{path}/{folder}")
        one = one.select("path", F.lit("md").alias("origin_type"), F.sha2("content", 256).alias("file_checksum"), "content", F.lit(kind).alias("note_type"))
        found = one if found is None else found.unionByName(one)
    return found


def html_text(html) -> F.Column:
    """Headings of a page as Markdown and its text without tags."""
    x = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", "")
    for level in range(1, 7):
        x = F.regexp_replace(x, rf"(?is)<h{level}\b[^>]*>(.*?)</h{level}>", "\n" + "#" * level + " $1\n")
    x = F.regexp_replace(F.regexp_replace(x, r"(?i)<(br|/p|/div|/li|/tr)\b[^>]*>", "\n"), r"(?s)<[^>]*>", "")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(char))
    return F.btrim(F.regexp_replace(F.regexp_replace(x, r"[ \t]+", " "), r"\s*\n\s*", "\n"), F.lit(" \n"))


def compose(frontmatter, body) -> F.Column:
    """A note: YAML header of string fields in name order, then the body."""
    lines = F.transform(F.array_sort(F.map_entries(frontmatter)), lambda e: F.concat(e["key"], F.lit(": '"), F.replace(e["value"], F.lit("'"), F.lit("''")), F.lit("'")))
    return F.concat(F.lit("---\n"), F.array_join(lines, "\n"), F.lit("\n---\n\n"), body)


def plan_writes(notes: DataFrame, existing: DataFrame, force: bool = False) -> DataFrame:
    """(path, content, action): write where there is no file; force overwrites all but manual notes. A dry run only looks
    at this frame. notes: (path, content, origin); existing: (path)."""
    have = existing.select("path", F.lit(True).alias("there")).distinct()
    action = F.when(F.col("content").isNull(), "no_body").when(F.col("there").isNull(), "write").when(F.lit(force) & (F.col("origin") != "manual"), "overwrite").otherwise("keep")
    return notes.join(have, "path", "left").select("path", "content", action.alias("action"))


def write_files(plan: DataFrame, root: str) -> DataFrame:
    """Writes the planned files below a folder that driver and executors share; returns (action, n). Files are replaced
    whole, so a retried task leaves the same; nothing is deleted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = []
            for path, content, action in zip(*(b.column(c).to_pylist() for c in ("path", "content", "action")), strict=True):
                if action in ("write", "overwrite"):
                    target = os.path.normpath(os.path.join(root, path))
                    if not target.startswith(os.path.normpath(root) + os.sep):
                        raise ValueError(f"{path} leaves the folder")
                    os.makedirs(os.path.dirname(target), exist_ok=True)
                    with open(f"{target}.{os.getpid()}", "w", encoding="utf-8") as f:
                        f.write(content)
                    os.replace(f"{target}.{os.getpid()}", target)
                done.append(action)
            yield pa.RecordBatch.from_pydict({"action": done})

    return plan.mapInArrow(run, "action string").groupBy("action").agg(F.count("*").alias("n"))
