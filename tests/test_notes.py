"""The vector store, images, search index, topic names and commands on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from notegrove import cli
from notegrove.operators import cluster, images, index, lexical, policies, review, store, vectors
from notegrove.plans import phases, workflows
from notegrove.plans.queries_notes import extractor
from notegrove.schemas import SCHEMAS, align
from notegrove.sources import files


def test_embedding_spaces(spark):
    row = lambda model: spark.createDataFrame([("a", "doc", {"k": "v"}, [1.0], "p", model)], "id string, document string, metadata map<string,string>, embedding array<float>, provider string, model string")
    held = index.upsert(spark.createDataFrame([], index.SCHEMA), row("m"), "mocs")
    assert index.identity(held).count() == 1 and index.export(held, "mocs").first()["document"] == "doc"
    with pytest.raises(vectors.EmbeddingSpaceMismatch):
        index.upsert(held, row("other"), "mocs")
    assert index.upsert(held, row("other"), "chunks").count() == 2
    with pytest.raises(ValueError, match="unknown collection"):
        index.reset(held, "other")
    empty = index.hashed_vectors(spark.createDataFrame([(1, None), (2, "a a b")], "k long, t string"), "k", "t", 8).collect()
    assert {r["k"]: round(sum(x * x for x in r["embedding"]), 6) for r in empty} == {1: 0.0, 2: 1.0}


def test_knn_edges(spark):
    """Ties go to the smaller id, left-out ids do not count, equal query ids and more neighbours than vectors are no trouble."""
    v = spark.createDataFrame([(i, [float(i // 2), 0.0]) for i in range(9, -1, -1)] + [(None, [0.0, 0.0]), (50, None)], "vec_id long, embedding array<double>").repartition(3)
    q = spark.createDataFrame([(1, [0.0, 0.0], None), (2, [0.0, 0.0], 0), (2, None, 0)], "query_id long, vector array<double>, exclude long")
    got = {}
    for r in vectors.knn(v, q, 3).orderBy("query_id", "vector_rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    assert got == {1: [0, 1, 2], 2: [1, 2, 3]}
    assert vectors.knn(v, q, 30).where("query_id = 1").count() == 10 and vectors.knn(v, q.limit(0), 3).count() == 0


def test_knn_in_blocks(spark, sf, monkeypatch):
    """Several scans give what one does."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    q = e.where("vec_id % 7 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    ask = lambda: sorted((r["query_id"], r["id"], r["vector_rank"]) for r in vectors.knn(e, q, 4, exclude_self=True).collect())
    once = ask()
    monkeypatch.setattr(vectors, "SCAN_BYTES", 5000)
    assert ask() == once and not any(a == b for a, b, _ in once)


def test_search_folds_diacritics(spark):
    d = spark.createDataFrame([(1, "Uma ação rápida"), (2, "outra coisa"), (3, None)], "id long, text string")
    q = spark.createDataFrame([(0, "ACAO"), (1, "ação coisa"), (2, "de")], "query_id long, query_text string")
    got = {(r["query_id"], r["doc"]) for r in lexical.bm25(d, q, "id", F.col("text"), 5).collect()}
    assert got == {(0, 1), (1, 1), (1, 2)}
    assert lexical.bm25(d.limit(0), q, "id", F.col("text"), 5).count() == 0


def test_topics_and_outlines(spark):
    t = spark.createDataFrame([("Arte",), ("xbiologiax",), ("",), (None,), ("q",)], "topic string")
    allowed = spark.createDataFrame([(f"name{i}", i) for i in range(300)] + [("Biologia", 301), ("arte moderna", 302), (" ", -1), ("Q&A", 303)], "allowed string, rank int")
    got = {r["topic"]: r["allowed"] for r in review.topic_matches(t, allowed).collect()}
    assert got == {"Arte": "arte moderna", "xbiologiax": "Biologia", "": "name0", None: None, "q": "Q&A"}
    many = allowed.select(F.col("rank").alias("id")).unionByName(spark.range(2000, 5000).select(F.col("id").cast("int")))
    s = spark.createDataFrame([(0, [4999, 7, 4999, -5]), (1, [-7]), (9, [7])], "section int, note_ids array<int>")
    assert {r["section"]: r["note_ids"] for r in review.sanitized_outline(s, many).collect()} == {0: [4999, 7], 1: [-1, 0, 1]}
    maps = spark.createDataFrame([("m1", "Arte", "2024-01-01"), ("m2", "arte moderna", "2024-02-01"), ("m3", "", "2023-01-01")], "moc_id string, topic string, d string").withColumn("created_at", F.col("d").cast("timestamp"))
    assert {r["topic"]: r["moc_id"] for r in review.existing_map(t.where("topic in ('Arte', 'q')"), maps).collect()} == {"Arte": "m2", "q": "m3"}


def test_image_files(spark, tmp_path):
    rows = [("c" * 64, ".png", b"x"), ("c" * 64, ".png", b"x"), ("d" * 64, ".JPG", b"y")]
    d = spark.createDataFrame(rows, "checksum string, extension string, content binary")
    first = {r["path"]: r["written"] for r in images.write_images(d, str(tmp_path)).collect()}
    assert first == {f"90_Assets/img-{'c' * 16}.png": True, f"90_Assets/img-{'d' * 16}.jpg": True}
    assert not any(r["written"] for r in images.write_images(d, str(tmp_path)).collect())
    assert (tmp_path / "90_Assets" / f"img-{'d' * 16}.jpg").read_bytes() == b"y"


def test_described_assets(spark):
    pending = spark.createDataFrame([(f"a{i}", "p", str(i)) for i in range(9)], "asset_id string, path string, context string")

    def model(path, context):
        if context == "1":
            raise ValueError("bad")
        if int(context) >= 3:
            raise images.RateLimited
        return context

    got = images.described(pending, model, most_failures=2)
    assert [(a, s) for a, s, _ in got[:3]] == [("a0", "described"), ("a1", "failed"), ("a2", "described")] and all(s == "pending" for _, s, _ in got[3:])


def test_abort_on_duplicates(spark):
    d = spark.createDataFrame([("a", "new"), ("b", "semantic"), ("c", "file")], "p string, dup_kind string")
    assert policies.after_duplicates(d, "skip").count() == 1 and policies.after_duplicates(d, "continue").count() == 2
    with pytest.raises(Exception, match="repeats a source"):
        policies.after_duplicates(d, "abort").collect()
    with pytest.raises(ValueError, match="exclude"):
        policies.duplicate_action(skip=True, force=True)


def test_extract_asks_once(spark):
    """Repeated runs with the cache ask nothing; an answer that no repair helps is a failed chunk."""
    asked = spark.sparkContext.accumulator(0)

    def model(prompt):
        asked.add(1)
        return extractor(prompt)

    chunks = spark.createDataFrame([(str(i), "s", "t" * i, "pending") for i in range(12)] + [("z", "s", "t", "approved")], "chunk_id string, source_id string, text string, status string")
    got = phases.extract(chunks, spark.createDataFrame([], "call_checksum string, response string"), "Extraia conceitos.\n{text}", model)
    n = asked.value
    status = {r["chunk_id"]: r["status"] for r in got["chunks"].collect()}
    assert n == 12 + 2 == got["cache"].count() and set(status.values()) == {"awaiting_review", "failed"} and "z" not in status
    again = phases.extract(chunks, got["cache"], "Extraia conceitos.\n{text}", model)
    assert {r["chunk_id"]: r["status"] for r in again["chunks"].collect()} == status and asked.value == n and again["cache"].count() == 0


def test_publish_survives_a_crash(spark, tmp_path):
    """A version whose pointer was not finished does not count."""
    root = f"file://{tmp_path}"
    store.publish(spark.createDataFrame([(1,)], "k int"), root, "t")
    (tmp_path / "t" / "pointers" / "2").mkdir()
    assert store.current(spark, root, "t").count() == 1 and not store.published(spark, root, "none")


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 51)], "a long, b long")
    got = {r["id"]: r["cluster"] for r in cluster.components(links, spark.range(60)).collect()}
    assert got == {i: 0 if i <= 30 else 50 if i in (50, 51) else i for i in range(60)}


def test_commands(spark, tmp_path, capsys):
    box, root = tmp_path / "in", f"file://{tmp_path}/store"
    box.mkdir()
    (box / "a.md").write_text("# One\n\n" + "alpha beta. " * 120 + "\n## Two\n\n" + "gamma. " * 80)
    (box / "b.md").write_text((box / "a.md").read_text())
    assert len(cli.init(spark, root)["tables"]) == 11 and cli.init(spark, root)["tables"] == []
    first = cli.harvest(spark, root, str(box))
    assert first["sources"] == 1 and first["chapters"] == 2 and first["chunks"] >= 3
    assert cli.harvest(spark, root, str(box)) == {"sources": 0, "chapters": 0, "chunks": 0}
    assert cli.extract(spark, root, lambda p: json.dumps({"chunk_status": "ok", "summary": "w " * 25, "key_concepts": ["a", "b", "c"], "candidates": [{"relevance": 5, "thesis": "a b c d e " + p[-9:], "definition": "x " * 12, "anchor_quote": "q"}]}))["awaiting_review"] == first["chunks"]
    after = cli.review_chunks(spark, root)
    assert after["chunks"] == first["chunks"] and after["chunks:approved"] == first["chunks"]
    health = cli.doctor(spark, root)
    assert health["tables"] and health["one_embedding_space"] and health["chapters_without_chunks"] == 0 == health["chunks_without_chapter"]
    source = cli.read(spark, root, "sources").first()["source_id"]
    text = spark.createDataFrame([(source, (box / "a.md").read_text().replace("gamma", "delta"))], "source_id string, text string")
    changed = cli.rechunk(spark, root, text)
    assert changed["added"] == changed["removed"] >= 1
    index_ = [r["chunk_index"] for r in cli.read(spark, root, "chunks").orderBy("chunk_index").collect()]
    assert len(index_) == len(set(index_)) == first["chunks"]
    assert cli.set_paging(spark, root, source, 3, 1)["chunks"] >= 1
    cli.main(["--root", root, "status"])
    assert json.loads(capsys.readouterr().out)["sources"] == 1


def test_commands_to_linked_notes(spark, tmp_path, capsys):
    box, vault, root = tmp_path / "in", tmp_path / "vault" / "vault", f"file://{tmp_path}/store"
    box.mkdir()
    vault.mkdir(parents=True)
    (box / "a.md").write_text("# One\n\n" + "alpha beta. " * 120 + "\n## Two\n\n" + "gamma delta. " * 120)
    state = {}

    def model(prompt):
        if prompt.startswith("Proponha conexões"):
            return json.dumps({"connections": [{"target": state.get("target", "nowhere"), "relation_type": "supports", "description": prompt.split("\n\n")[1][:5]}]})
        word = "alpha" if "alpha" in prompt else "gamma"
        return json.dumps({"average": 9, "chunk_status": "ok", "summary": "w " * 25, "key_concepts": ["a", "b", "c"], "candidates": [{"relevance": 5, "thesis": f"{word} is what this is about", "definition": f"{word} " * 12, "anchor_quote": "q"}]})

    cli.init(spark, root)
    got = cli.run_all(spark, root, str(box), model=model)
    n = got["connect"]["notes"]
    assert n == got["harvest"]["chunks"] == got["connect"]["embedded"] and got["connect"]["connections"] == 0
    rows = cli.read(spark, root, "notes").collect()
    assert all("## Conexões" in r["body"] and "is what this is about" in r["title"] for r in rows)
    assert cli.connect(spark, root, model=model) == {"notes": 0, "connections": 0, "embedded": 0}
    assert {r["status"] for r in cli.read(spark, root, "concepts").collect()} == {"noted"}

    # a second source: its notes link to a stored one, and one is judged a duplicate of it
    state["target"] = rows[0]["note_id"]
    (box / "b.md").write_text("# Three\n\n" + "epsilon zeta gamma. " * 100)
    assert cli.harvest(spark, root, str(box))["sources"] == 1
    cli.extract(spark, root, model)
    cli.review_chunks(spark, root)
    new = [r["concept_id"] for r in cli.read(spark, root, "concepts").where("status = 'extracted'").collect()]
    decide = spark.createDataFrame([(new[0], "ignore", None)], "concept_id string, decision string, target_note_id string")
    second = cli.connect(spark, root, model=model, decide=decide)
    assert second["notes"] == len(new) - 1 == second["connections"]
    edges = cli.read(spark, root, "note_connections").collect()
    title = {r["note_id"]: r["title"] for r in cli.read(spark, root, "notes").collect()}
    assert all((r["target_note_id"], r["relation_type"], r["description"]) == (state["target"], "supports", title[r["source_note_id"]][:5]) for r in edges)
    assert cli.read(spark, root, "concepts").where("status = 'duplicate'").count() == 1

    # the vault: files are written once, manual notes join the store and stay
    assert cli.rebuild(spark, root, str(vault), dry_run=True)["write"] == cli.rebuild(spark, root, str(vault))["write"] >= n
    assert set(cli.rebuild(spark, root, str(vault))) == {"keep"}
    own = vault / files.FOLDERS["permanent"] / "mine.md"
    own.write_text("# Mine\n\nkappa lambda mu\n")
    assert cli.sync_manual(spark, root, str(vault))["new"] == 1
    assert set(cli.sync_manual(spark, root, str(vault))) == {"skipped"}
    own.write_text("# Mine\n\nkappa lambda nu\n")
    assert cli.sync_manual(spark, root, str(vault))["updated"] == 1
    assert cli.rebuild(spark, root, str(vault), force=True)["keep"] == 1

    # answers come from the notes, and a question is asked once
    seen = []
    tell = lambda p: seen.append(p) or "kappa it is"
    assert cli.ask(spark, root, "kappa lambda nu", model=tell) == {"answer": "kappa it is", "cached": False}
    assert cli.ask(spark, root, "kappa lambda nu", model=tell)["cached"]
    assert cli.ask(spark, root, "unheard", model=tell)["answer"] == workflows.NO_EVIDENCE
    done = cli.article(spark, root, "gamma", ["alpha"], model=model)
    assert done["ended"] == "approved" and done["score"] == 9.0 and done["warnings"] == []
    assert cli.article(spark, root, "gamma", model=model, outline_only=True)["ended"] == "outline"
    assert cli.reindex(spark, root, "permanent_notes", force=True)["permanent_notes"] == cli.read(spark, root, "notes").count()
    cli.main(["--root", root, "reindex", "--collection", "chunks"])
    assert json.loads(capsys.readouterr().out)["chunks"] == cli.read(spark, root, "chunks").count()


def test_garden_command(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    rows = [(f"N{i}", f"kappa title {i}", f"kappa lambda mu nu xi {i}") for i in range(6)] + [("X", "alone", "omicron pi rho"), ("E", "empty", None)]
    store.publish(align(spark.createDataFrame(rows, "note_id string, title string, body string"), SCHEMAS["notes"]), root, "notes")
    assert cli.reindex(spark, root, "permanent_notes") == {"permanent_notes": 7}
    assert cli.garden(spark, root) == {"maps": 1, "grown": 0, "merged": 0, "embedded": 1}
    made = cli.read(spark, root, "mocs").first()
    assert all(f"[[PERM - N{i} - " in made["body"] for i in range(6)) and "[[PERM - X" not in made["body"] and "kappa" in made["topic"]
    assert cli.garden(spark, root) == {"maps": 0, "grown": 0, "merged": 0, "embedded": 0}

    # two more notes of the cluster go into its map, one where it was placed, one nowhere; a map whose notes are all in it points to it
    more = [(f"N{i}", f"kappa title {i}", f"kappa lambda mu nu xi {i}") for i in range(6, 9)]
    cli._put(spark.createDataFrame(more, "note_id string, title string, body string"), root, "notes")
    cli.reindex(spark, root, "permanent_notes")
    side = "# side\n\nbeside\n\n## Old\n\n- [[PERM - N0 - kappa-title-0]]\n- [[PERM - N1]]\n"
    other = [("M2", "side", side, "auto"), ("M3", "hand", side, "manual")]
    cli._put(spark.createDataFrame(other, "moc_id string, topic string, body string, origin string"), root, "mocs")
    place = spark.createDataFrame([("N7", "Later"), ("N8", "Ignorar")], "note_id string, subsection string")
    out = cli.garden(spark, root, place=place)
    assert (out["maps"], out["grown"], out["merged"]) == (0, 1, 1)
    after = {r["moc_id"]: r for r in cli.read(spark, root, "mocs").collect()}
    grown = after[made["moc_id"]]["body"]
    assert len(after) == 3 and after["M3"]["body"] == side and f"[[MOC - {made['moc_id']} - " in after["M2"]["body"] and "N0" not in after["M2"]["body"]
    assert grown.index("[[PERM - N6") < grown.index("## Later") < grown.index("[[PERM - N7") and "N8" not in grown
    assert grown.startswith(made["body"].rstrip("\n")) and after[made["moc_id"]]["cluster_signature"] != made["cluster_signature"]
    assert cli.garden(spark, root, place=place)["grown"] == 0


def test_vault_folders(spark, tmp_path):
    for kind, folder in files.FOLDERS.items():
        (tmp_path / folder / "deep").mkdir(parents=True)
        (tmp_path / folder / f"{kind}.md").write_text(f"# {kind}")
        (tmp_path / folder / "deep" / "x.md").write_text("x")
    found = files.vault(spark, str(tmp_path)).groupBy("note_type").count().collect()
    assert {r["note_type"]: r["count"] for r in found} == {"source": 1, "literature": 2, "permanent": 1, "moc": 1}
