"""Small cases with expectations worked out by hand."""

import pytest
from pyspark.sql import functions as F

from notegrove import schemas
from notegrove.functions import biblio, paging, pricing
from notegrove.functions import text as tx
from notegrove.operators import chunking, cluster, dedup, fusion, graph, lexical, memo, review, store, vectors
from notegrove.plans.registry import QUERIES


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_normalize(spark):
    assert one(spark, tx.normalize(F.col("t")), t=" a\t b \r\n c\n\n\n\nhy-\nphen ") == "a b\nc\n\nhyphen"
    assert one(spark, tx.normalize(F.col("t"), compose=True), t="ﬁn") == "fin"
    assert one(spark, tx.fold_diacritics(F.col("t")), t="Ação É") == "acao e"


def test_graph_weights(spark):
    edges = spark.createDataFrame([(1, 2, "supports"), (3, 2, "contradicts"), (1, 9, "other")], "source long, target long, relation_type string")
    seeds = spark.createDataFrame([(0, 1, 0.5)], "query_id long, id long, weight double")
    got = {r["id"]: (round(r["weight"], 6), r["hop"]) for r in graph.expand(seeds, edges, hops=2).collect()}
    assert got == {2: (0.4, 1), 9: (0.25, 1), 3: (0.2, 2)}


@pytest.mark.parametrize(("distance", "rank", "code"), [(0.7, None, "dissimilar"), (0.2, None, "similar"), (1.8, 1, "below_absolute"), (0.9, 5, "strong_lexical"), (None, 9, "weak_lexical"), (None, None, "no_signal")])
def test_floor(spark, distance, rank, code):
    d = spark.createDataFrame([(distance, rank)], "d double, r int")
    assert d.select(fusion.floor_code(fusion.Floor(), F.col("d"), F.col("r")).alias("x")).first()["x"] == code


def test_pages(spark):
    rows = spark.createDataFrame([("s", i, p) for i, p in enumerate([None, 10, None, None, 16, None])], "s string, i int, p int")
    got = [r["page_inferred"] for r in chunking.interpolated_pages(rows, "s", "i", "p").orderBy("i").collect()]
    assert got == [None, 10, 12, 14, 16, 16]
    assert one(spark, paging.book_page(F.lit(40), F.lit(35), F.lit(10))) == 15
    assert one(spark, paging.book_page(F.lit(3), F.lit(35), F.lit(10))) is None
    assert one(spark, pricing.embed_tokens(F.lit("x" * 40))) == 10


def test_sections():
    text = "intro " * 50 + "\n### A\nshort\n#### B\n" + "body " * 60 + "\n### C\nend"
    got = chunking.sections("Ch", text, 200)
    assert [p for p, _ in got] == ["Ch", "Ch > A > B"]
    assert got[1][1].startswith("short\n\nbody") and got[1][1].endswith("end")
    pieces = chunking.split("word " * 500, 200, 50)
    assert all(len(p) <= 200 for p in pieces) and len(pieces) > 12


def test_merge_policies(spark):
    old = spark.createDataFrame([(1, "a", "x", 1), (2, "b", None, 2)], "k int, o string, c string, n int")
    new = spark.createDataFrame([(1, None, None, 5), (3, "z", "w", 7)], "k int, o string, c string, n int")
    got = {r["k"]: tuple(r)[1:] for r in store.merge(old, new, ["k"], {"c": "C", "n": "+"}).collect()}
    assert got == {1: (None, "x", 6), 2: ("b", None, 2), 3: ("z", "w", 7)}
    aligned = schemas.align(old.select("k"), schemas.SCHEMAS["chapters"], {"title": "t"})
    assert aligned.columns == schemas.SCHEMAS["chapters"].fieldNames() and aligned.first()["title"] == "t"


def test_publish(spark, tmp_path):
    first = spark.createDataFrame([(1,)], "k int")
    store.publish(first, f"file://{tmp_path}", "t")
    now = store.current(spark, f"file://{tmp_path}", "t")
    store.publish(now.unionByName(now), f"file://{tmp_path}", "t")
    assert store.current(spark, f"file://{tmp_path}", "t").count() == 2


def test_dedup_and_sample(spark):
    rows = spark.createDataFrame([("g", i) for i in range(12)], "g string, i int")
    assert sorted(r["i"] for r in dedup.even_sample(rows, "g", "i", 5).collect()) == [0, 2, 4, 7, 9]


def test_references(spark):
    assert one(spark, biblio.inverted(F.lit("Ana Maria Silva"))) == "SILVA, Ana Maria"
    assert one(spark, biblio.accessed(F.lit("5/3/2024"))) == "05 mar. 2024"
    assert one(spark, biblio.in_text(F.array(F.lit("A B"), F.lit("C D")), F.lit(1999))) == "(B; D, 1999)"
    assert one(spark, biblio.suffix(F.lit(3))) == "b"


def test_suffixes_of_many_equal_keys(spark):
    """Every place of a base has its own suffix, as chr of the code points gives it, beyond 256 too."""
    places = [1, 2, 27, 28, 703, 704, 4187, 4188, 20000]
    got = [r["s"] for r in spark.createDataFrame([(i, n) for i, n in enumerate(places)], "i int, n int").select("i", biblio.suffix(F.col("n")).alias("s")).orderBy("i").collect()]
    assert got == ["", "a", "z"] + [chr(96 + (n - 2) // 26) + chr(97 + (n - 2) % 26) for n in places[3:]]


def test_postings_are_not_sent(spark):
    """An index is made and refreshed by document: texts are dealt before they are split, terms are not dealt again; documents of
    one id in several rows count together."""
    rows = [(1, "a b a"), (1, "b c"), (2, "ação x"), (3, None), (None, "q")]
    docs = spark.createDataFrame(rows, "doc long, text string").repartition(3)
    index = lexical.refreshed(lexical.postings(docs, "doc", F.col("text")), docs.where("doc = 2").withColumn("text", F.lit("y y")), "doc", F.col("text"), docs.where("doc = 3"))
    got = sorted(((r["doc"], r["term"], r["tf"]) for r in index.collect()), key=str)
    assert got == sorted([(1, "a", 2), (1, "b", 2), (1, "c", 1), (1, None, 2), (2, "y", 2), (2, None, 1), (None, "q", 1), (None, None, 1)], key=str)
    plan = index.select("doc", "term", "tf")._jdf.queryExecution().sparkPlan().toString()
    full = index._jdf.queryExecution().executedPlan().toString()
    shuffled = [line for line in full.split("\n") if "Exchange hashpartitioning" in line]
    assert "Generate" in plan and not any("term" in line for line in shuffled)


def test_review(spark):
    reason = review.reject_reason(F.lit("new"), F.lit(4), F.lit("a b c d e"), F.lit("one two three"), F.lit("q"))
    assert one(spark, reason) == "short_definition"


def test_guard():
    assert vectors.guard_space(None, "p", "m") and vectors.guard_space(("p", "m"), "p", "m")
    with pytest.raises(vectors.EmbeddingSpaceMismatch):
        vectors.guard_space(("p", "x"), "p", "m")
    assert vectors.sanitized({"a": [1, 2], "b": None, "c": 1.5}) == {"a": "1, 2", "c": "1.5"}


def test_memo_calls_once(spark):
    calls = spark.createDataFrame([("h1", "p1"), ("h1", "p1"), ("h2", "p2")], "call_checksum string, prompt string")
    cache = spark.createDataFrame([("h2", "old")], "call_checksum string, response string")
    answers, made = memo.memoised(calls, cache)
    assert made.count() == 1
    assert {(r["call_checksum"], r["cached"]) for r in answers.collect()} == {("h1", False), ("h2", True)}


def test_blocks(spark):
    body = "x\n\n<!-- note:auto-connections:start -->\nold\n<!-- note:auto-connections:end -->\ny"
    put = tx.put_block(F.col("t"), "auto-connections", F.lit("new"))
    assert one(spark, tx.read_block(put, "auto-connections"), t=body) == "new"
    assert one(spark, tx.read_block(put, "auto-connections"), t="plain") == "new"
    assert "old" not in one(spark, tx.strip_blocks(F.col("t")), t=body)


def test_counters_and_duplicates(spark):
    held = spark.createDataFrame([("a", None, 1), ("b", 2.0, 2)], "id string, cost double, n long")
    more = spark.createDataFrame([("a", 0.5, None), ("a", None, 4), ("z", 1.0, 1)], "id string, cost double, n long")
    assert {tuple(r) for r in store.added(held, more, "id", ["cost", "n"]).collect()} == {("a", 0.5, 5), ("b", 2.0, 2)}
    found = spark.createDataFrame([(1, "file"), (1, "semantic"), (1, "file")], "run_id long, kind string")
    assert [tuple(r) for r in store.duplicate_counts(found).collect()] == [(1, 2, 0, 1)]
    with pytest.raises(Exception, match="unknown kind of duplicate: other"):
        store.duplicate_counts(spark.createDataFrame([(1, "other")], "run_id long, kind string")).collect()


def test_map_structure(spark):
    body = "# T\n\nSum one\ntwo\n\n## First \nsome\n- [[NOTE - 7 - a b]]\n- item\nmore\n## Empty"
    got = one(spark, tx.map_sections(F.col("t")), t=body)
    assert [tuple(x) for x in got] == [("First", "some more", ["7"]), ("Empty", "", [])]
    assert one(spark, tx.map_summary(F.col("t")), t=body) == "Sum one\ntwo"
    assert one(spark, tx.map_sections(F.col("t")), t="no heading") == [] and one(spark, tx.map_summary(F.col("t")), t="") == ""


def test_chunks_of_whole_lines(spark, tmp_path):
    """Every word of a long line reaches the chunks and the merged sections."""
    line = " ".join(f"w{i:04d}" for i in range(500))
    spark.createDataFrame([(1, f"head\n{line}")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    merged = QUERIES["q_small_section_merge"](spark, str(tmp_path)).collect()
    assert [r["n"] for r in merged] == [len(line)]
    got = QUERIES["q_chunk_split"](spark, str(tmp_path)).collect()
    assert len(got) >= 3 and sum(r["n"] for r in got) >= len(line) - len(got)


def test_kmeans_has_no_cap(spark):
    """The number of clusters follows the number of vectors, above 256 too."""
    x = spark.createDataFrame([(i, [float(i), float(i % 7)]) for i in range(600)], "vec_id long, embedding array<double>")
    got = cluster.kmeans(x, least=1).agg(F.countDistinct("cluster").alias("k"), F.count("*").alias("n")).first()
    assert got["k"] > 256 and got["n"] == 600
