"""Sources, streaming ingest and the workflows, end to end on small inputs."""

from pyspark.sql import functions as F

from notegrove.operators import fusion
from notegrove.plans import queries_store as q
from notegrove.plans import workflows
from notegrove.sources import files
from notegrove.streaming import ingest

TEXT = "# One\n\n" + "alpha beta. " * 60 + "\n### Sub\n" + "gamma delta. " * 150 + "\n## Two\n\nend of it\n"


def test_markdown_scan(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\ntitle: T\ndate: 2001-05-06\nauthors: [A B, C]\n---\n# H\nbody", encoding="utf-8")
    (tmp_path / "b.TXT").write_text("# Head\nx", encoding="utf-8")
    (tmp_path / "c.png").write_bytes(b"no")
    got = {r["title"]: (r["year"], r["frontmatter"]) for r in files.markdown(files.inbox(spark, str(tmp_path))).collect()}
    assert got["T"][0] == 2001 and got["T"][1]["authors"] == "A B, C" and got["Head"] == (None, {})


def test_writes(spark, tmp_path):
    notes = spark.createDataFrame([("a.md", "x", "auto"), ("d/b.md", "y", "manual"), ("c.md", None, "auto")], "path string, content string, origin string")
    plan = files.plan_writes(notes, spark.createDataFrame([("d/b.md",)], "path string"), force=True)
    assert {r["path"]: r["action"] for r in plan.collect()} == {"a.md": "write", "d/b.md": "keep", "c.md": "no_body"}
    files.write_files(plan, str(tmp_path)).collect()
    assert (tmp_path / "a.md").read_text() == "x" and not (tmp_path / "d").exists()


def test_html(spark):
    d = spark.createDataFrame([("<html><script>x</script><h2 class='a'>Top</h2><p>a &amp; b</p></html>",)], "h string")
    assert d.select(files.html_text(F.col("h")).alias("t")).first()["t"] == "## Top\na & b"


def test_harvest_and_paging(spark):
    s = spark.createDataFrame([("s", TEXT)], "source_id string, text string")
    got = workflows.harvest(s)
    chunks = got["chunks"].collect()
    assert {c["title"] for c in chunks} == {"One", "Two"} and any(" > Sub" in c["section_path"] for c in chunks)
    again = workflows.harvest(s, known_chapters=got["chapters"])
    assert again["chunks"].count() == 0
    paged = spark.createDataFrame([("a", 1, "pending"), ("b", 1, "persisted"), ("c", 40, "pending")], "chunk_id string, page_in_file int, status string")
    assert {r["chunk_id"]: r["page_in_book"] for r in workflows.set_paging(paged, 35, 10).collect()} == {"b": None, "c": 15}


def test_stream_is_idempotent(spark, tmp_path):
    box = tmp_path / "in"
    box.mkdir()
    (box / "a.md").write_text(TEXT)
    root = f"file://{tmp_path}/tables"
    ingest.ingest(spark, str(box), root, str(tmp_path / "cp")).awaitTermination()
    n = ingest.table(spark, root, "chunks").count()
    (box / "b.md").write_text(TEXT.replace(" beta", "  beta"))
    (box / "c.md").write_text(TEXT)
    ingest.ingest(spark, str(box), root, str(tmp_path / "cp")).awaitTermination()
    for checkpoint in ("cp", "other"):  # a new run over the same files adds nothing
        ingest.ingest(spark, str(box), root, str(tmp_path / checkpoint)).awaitTermination()
        rows = [(r["path"][-4:], r["dup_kind"]) for r in ingest.table(spark, root, "files").collect()]
        assert sorted(rows) == [("a.md", "new"), ("b.md", "content"), ("c.md", "file")] and ingest.table(spark, root, "chunks").count() == n > 0


def test_windows(spark, tmp_path):
    """Totals by window of a stream of events, each counted once."""
    rows = [(1, "a", "2024-01-01 00:01:00", 1.0), (1, "a", "2024-01-01 00:01:00", 1.0), (2, "a", "2024-01-01 00:09:59", 2.0), (3, "a", "2024-01-01 00:10:00", 4.0), (4, "b", "2024-01-01 00:02:00", 8.0)]
    spark.createDataFrame(rows, "event_id long, event_type string, t string, value double").selectExpr("event_id", "event_type", "cast(t as timestamp) as ts", "value").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("event_id long, event_type string, ts timestamp, value double").parquet(f"{tmp_path}/in")
    out = ingest.usage_by_window(stream.dropDuplicates(["event_id", "ts"]))
    out.writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    got = {(r["window"]["start"].minute, r["event_type"]): (r["n"], r["value"]) for r in spark.table("windows").collect()}
    assert got == {(0, "a"): (2, 3.0), (10, "a"): (1, 4.0), (0, "b"): (1, 8.0)}
    once = ingest.unseen(stream, ["event_id"]).writeStream.format("memory").queryName("once").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp2").trigger(availableNow=True).start()
    once.awaitTermination()
    assert sorted(r["event_id"] for r in spark.table("once").collect()) == [1, 2, 3, 4]


def test_ask(spark, sf):
    cache = spark.createDataFrame([], "call_checksum string, response string")
    quiet = fusion.Floor(similarity=2.0, bypass_rank=None)
    answers, _ = workflows.ask(q.questions(spark, sf), q.notes(spark, sf), q.table(spark, sf, "embeddings"), cache, floor=quiet)
    assert {r["answer"] for r in answers.collect()} == {workflows.NO_EVIDENCE}
    out, additions = workflows.ask(q.questions(spark, sf), q.notes(spark, sf), q.table(spark, sf, "embeddings"), cache, q.edges(spark, sf), floor=q.FLOOR)
    got = out.collect()
    again, none = workflows.ask(q.questions(spark, sf), q.notes(spark, sf), q.table(spark, sf, "embeddings"), additions, q.edges(spark, sf), floor=q.FLOOR)
    assert additions.count() == 2 and none.count() == 0 and all(r["cached"] for r in again.collect())
    assert sorted(r["query_id"] for r in got) == [0, 20] and all(r["answer"].startswith("{") for r in got)


def test_retry_failed(spark):
    rows = spark.createDataFrame([("a", "failed"), ("b", "failed"), ("a", "approved")], "source_id string, status string")
    assert sorted(map(tuple, workflows.retry_failed(rows, "a").collect())) == [("a", "approved"), ("a", "pending"), ("b", "failed")]
    assert workflows.retry_failed(rows).where("status = 'failed'").isEmpty()
