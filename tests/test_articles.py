"""The article table: every route, many topics at once, and a run that goes on where another stopped."""

import json

import pytest

from notegrove.operators import index
from notegrove.plans import articles, workflows
from notegrove.session import stored

NOTES = [(i, f"{w} {i}", f"{w} fact number {i}") for i, w in enumerate(["kappa"] * 3 + ["lambda"] * 3 + ["omega"] * 3)]


def model(prompt):
    """A scripted model: what it says follows from the prompt alone."""
    if prompt.startswith("Proponha buscas"):
        return json.dumps({"queries": ["lambda"]}) if "kappa" in prompt else "no json"
    if prompt.startswith("Proponha o esboço"):
        if "sobre omega" in prompt:
            return "nothing"
        return json.dumps({"title": "T2" if "better" in prompt else "T", "sections": [{"title": "One", "notes": ["0"]}, {"title": "Two"}, {"title": " "}]})
    if prompt.startswith("Escreva a seção"):
        return ("mended " if "too thin" in prompt else "raw ") + ("0" if "fact number 0" in prompt else "-") + ("1" if "fact number 1" in prompt else "-")
    if prompt.startswith("Reescreva"):
        return "warm: " + prompt.split("\n\n", 1)[1]
    if "mended" in prompt or "warm" in prompt:
        return json.dumps({"fidelity": 8, "coverage": 8, "references": 8, "naturalness": 9, "verdict": "APPROVED"})
    return json.dumps({"average": 3, "verdict": "APPROVED", "feedback": "too thin"})


@pytest.fixture(scope="module")
def library(spark):
    notes = spark.createDataFrame(NOTES, "id long, title string, document string")
    vectors = stored(index.hashed_vectors(notes, "id", "document").withColumnRenamed("id", "vec_id"))
    embed = lambda q: index.hashed_vectors(q, "query_id", "query_text").withColumnRenamed("embedding", "vector")
    return {"notes": notes, "vectors": vectors}, embed


TOPICS = [(1, "kappa", "neutral", False), (2, "kappa", "warm", False), (3, "omega", "neutral", False), (4, "omega", "neutral", True), (5, "zzz", "neutral", False), (6, " ", "neutral", False), (7, "kappa", "neutral", False), (8, "kappa", "neutral", False), (9, "lambda", "neutral", False)]


def go(spark, library, seen=None, **more):
    lib, embed = library
    state = articles.start(spark.createDataFrame(TOPICS, "topic_id long, topic string, personality string, outline_only boolean"), "bigint")
    looks = spark.createDataFrame([(7, 0, "abort", []), (9, 0, "enrich", ["omega", "lambda"]), (9, 1, "enrich", ["omega"])], "topic_id long, look int, decision string, extra array<string>")
    choices = spark.createDataFrame([(8, 0, "regenerate", "better")], "topic_id long, attempt int, decision string, feedback string")
    cache = more.pop("cache", spark.createDataFrame([], "call_checksum string, response string"))
    return articles.run(more.pop("state", state), lib, embed, cache, model, looks=looks, choices=choices, **more)


def test_routes(spark, library):
    state, new = go(spark, library)
    got = {r["topic_id"]: r for r in state.collect()}
    assert {i: r["ended"] for i, r in got.items()} == {1: "approved", 2: "approved", 3: "approved", 4: "outline", 5: "no_evidence", 6: "no_evidence", 7: "aborted", 8: "approved", 9: "approved"}
    assert got[1]["executed"] == ["kappa", "lambda"] and got[1]["iteration"] == 1 and got[1]["average"] == 8.25
    # the first section has the note that it names, the second, which names none, has all of them
    assert got[1]["body"] == "# T\n\n## One\n\nmended 0-\n\n## Two\n\nmended 01"
    assert got[2]["body"].startswith("warm: # T") and got[2]["iteration"] == 0
    assert got[3]["body"].startswith("# omega\n\n## omega\n\nmended") and got[4]["body"].startswith("# omega\n\n## omega")
    assert got[5]["body"] == workflows.NO_EVIDENCE and got[8]["outline"]["title"] == "T2" and got[8]["attempts"] == 2
    assert got[9]["executed"] == ["lambda", "omega"] and got[9]["looks"] == 2 and {h["id"] for h in got[9]["hits"]} == set(range(3, 9))
    assert new.count() == new.select("call_checksum").distinct().count()


def test_rejected_at_the_end(spark, library):
    state, _ = go(spark, library, rounds=1)
    got = {r["topic_id"]: r["ended"] for r in state.collect()}
    assert got[1] == "rejected" and got[2] == "approved"
    sources = spark.createDataFrame([("s", ["Ana Sur"], 2001, "(SUR, 2001)", "SUR, Ana. X. 2001.")], "source_id string, authors array<string>, year int, in_text_cite string, reference string")
    cites = state.selectExpr("*", "if(topic_id = 2, concat(body, ' (SUR, 2001) ![[90_Assets/none.png]]'), body) AS b").drop("body").withColumnRenamed("b", "body")
    out = {r["topic_id"]: r for r in articles.report(cites, spark.createDataFrame([], "path string"), sources).collect()}
    assert out[1]["warnings"] == ["Artigo rejeitado pelo juiz."] and "Referências" not in out[1]["body"]
    assert out[2]["body"].endswith("## Referências\n\n- SUR, Ana. X. 2001.") and out[2]["warnings"] == ["Embed inexistente: 90_Assets/none.png"]


def test_goes_on_after_a_stop(spark, library):
    """A run that breaks after some kept rounds, then goes on from the kept states and answers, ends as an unbroken one."""
    kept, answers = [], []

    def keep(state, new):
        if len(kept) == 4:
            raise RuntimeError("cut off")
        kept.append(stored(state))
        if new is not None:
            answers.append(new)
        return kept[-1]

    with pytest.raises(RuntimeError):
        go(spark, library, keep=keep)
    cache = answers[0]
    for a in answers[1:]:
        cache = cache.unionByName(a)
    whole, _ = go(spark, library)
    rest, _ = go(spark, library, state=kept[-1], cache=cache)
    cols = ["topic_id", "ended", "body", "average", "iteration"]
    assert sorted(map(tuple, whole.select(cols).collect())) == sorted(map(tuple, rest.select(cols).collect()))


def test_no_topics(spark, library):
    lib, embed = library
    state = articles.start(spark.createDataFrame([], "topic_id long, topic string"), "bigint")
    assert articles.run(state, lib, embed, spark.createDataFrame([], "call_checksum string, response string"), model)[0].count() == 0
