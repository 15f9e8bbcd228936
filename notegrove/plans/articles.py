"""Articles as a table of states: many topics go through search, outline, sections, style and judge at once.

A topic's row holds its node and what it has so far. A round is one plan: every topic that waits for the model puts its
prompts (one a section where sections are written), all prompts share one memoised call, and the routes are expressions over the
answers. Rows are kept between rounds, so a run that was cut off goes on from the last kept round.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notegrove.config import Config
from notegrove.functions import text as tx
from notegrove.operators import fusion, memo, notes, review
from notegrove.plans.workflows import NO_EVIDENCE
from notegrove.session import stored

QUERIES = "Proponha buscas sobre {topic} para um artigo {style}, em JSON com o campo queries."
OUTLINE = "Proponha o esboço de um artigo {style} sobre {topic}, em JSON com title e sections (title, notes).\n\n{feedback}\n\nNotas:\n{context}"
SECTION = "Escreva a seção {section} do artigo {title} ({style}) com base nas notas.\n\n{feedback}\n\n{context}"
STYLE = "Reescreva o artigo no tom {personality}.\n\n{draft}"
JUDGE = "Avalie o artigo de 0 a 10 em fidelity, coverage, references e naturalness, em JSON com verdict e feedback.\n\n{body}\n\nNotas:\n{context}"
SCORES = ("fidelity", "coverage", "references", "naturalness")
MODEL_NODES = ("queries", "outline", "draft", "style", "judge")
_OUTLINE = "struct<title:string,sections:array<struct<title:string,notes:array<string>>>>"
_JUDGED = "struct<" + ",".join(f"{s}:double" for s in SCORES) + ",average:double,verdict:string,feedback:string>"


def start(topics: DataFrame, ids: str, most: int = 5) -> DataFrame:
    """States of topics (topic_id, topic[, extras, style, personality, outline_only]); ids: the type of the notes' ids. A topic id
    that repeats is an error of the caller's: the first by topic stays. A topic without text ends without evidence."""
    have = lambda c, kind, default: (F.coalesce(F.col(c), F.lit(default)) if c in topics.columns else F.lit(default)).cast(kind).alias(c)
    extras = F.coalesce("extras", F.array().cast("array<string>")) if "extras" in topics.columns else F.array().cast("array<string>")
    one = topics.withColumn("__r", F.row_number().over(Window.partitionBy("topic_id").orderBy("topic"))).where("__r = 1")
    empty = F.trim(F.coalesce("topic", F.lit(""))) == ""
    null = lambda c, kind: F.lit(None).cast(kind).alias(c)
    return one.select(
        "topic_id", F.trim(F.coalesce("topic", F.lit(""))).alias("topic"), have("style", "string", "blog"), have("personality", "string", "neutral"), have("outline_only", "boolean", False),
        F.when(empty, "end").otherwise("queries").alias("node"), F.lit(most).alias("most"), extras.alias("pending"), F.array().cast("array<string>").alias("executed"), F.array().cast(f"array<struct<score:double,id:{ids}>>").alias("hits"),
        F.array().cast("array<struct<id:string,block:string>>").alias("blocks"), F.lit(0).alias("looks"), F.lit(0).alias("attempts"), F.lit(0).alias("iteration"), null("outline", _OUTLINE), F.lit("").alias("feedback"),
        null("draft", "string"), null("body", "string"), null("average", "double"), null("verdict", "string"), F.when(empty, "no_evidence").alias("ended"),
    )


def _context(keep: Column | None = None) -> Column:
    """The blocks of a topic's notes, or of those that a section names and that are there."""
    blocks = F.col("blocks")
    if keep is not None:
        named = F.filter(blocks, lambda b: F.array_contains(keep, b["id"]))
        blocks = F.when(F.coalesce(F.size(named), F.lit(0)) > 0, named).otherwise(blocks)
    return F.array_join(F.transform(blocks, lambda b: b["block"]), "\n\n")


def _prompts() -> Column:
    """What a row asks in its node."""
    c = F.col
    both = {"topic": c("topic"), "style": c("style"), "feedback": c("feedback")}
    section = lambda s: memo.filled(SECTION, both | {"section": s["title"], "title": c("outline.title"), "context": _context(F.coalesce(s["notes"], F.array().cast("array<string>")))})
    return (
        F.when(c("node") == "queries", F.array(memo.filled(QUERIES, both)))
        .when(c("node") == "outline", F.array(memo.filled(OUTLINE, both | {"context": _context()})))
        .when(c("node") == "draft", F.transform("outline.sections", section))
        .when(c("node") == "style", F.array(memo.filled(STYLE, {"personality": c("personality"), "draft": c("draft")})))
        .when(c("node") == "judge", F.array(memo.filled(JUDGE, {"body": c("body"), "context": _context()})))
    )


def _queries(answer: Column) -> Column:
    """The topic first unless it is among the others, the user's queries, the model's; no more than the row's ``most``, but all of the user's."""
    clean = lambda a: F.filter(F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    own = F.array_distinct(clean(F.col("pending")))
    every = F.array_distinct(F.concat(own, clean(F.from_json(tx.json_payload(answer), "queries array<string>")["queries"])))
    led = F.when(F.array_contains(every, F.col("topic")), every).otherwise(F.concat(F.array("topic"), every))
    return F.slice(led, 1, F.greatest(F.col("most"), F.size(own) + 1))


def _outline(answer: Column) -> Column:
    """The model's outline; one that cannot be read or has no sections is one section over all notes."""
    got = F.from_json(tx.json_payload(answer), _OUTLINE)
    parts = F.filter(got["sections"], lambda s: F.trim(F.coalesce(s["title"], F.lit(""))) != "")
    none = F.array(F.struct(F.col("topic").alias("title"), F.array().cast("array<string>").alias("notes")))
    usable = F.coalesce(F.size(parts), F.lit(0)) > 0
    return F.struct(F.coalesce(got["title"], F.col("topic")).alias("title"), F.when(usable, parts).otherwise(none).alias("sections"))


def _shown(outline: Column) -> Column:
    lines = F.transform(outline["sections"], lambda s: F.concat(F.lit("## "), s["title"], F.lit("\n\n"), F.array_join(F.transform(F.coalesce(s["notes"], F.array().cast("array<string>")), lambda i: F.concat(F.lit("- "), i)), "\n")))
    return F.concat(F.lit("# "), outline["title"], F.lit("\n\n"), F.array_join(lines, "\n\n"))


def asked(state: DataFrame, cache: DataFrame, model: Callable[[str], str], choices: DataFrame, rounds: int = 3, least: float = 7.0, skip_judge: bool = False) -> tuple[DataFrame, DataFrame]:
    """(states, cache additions) after all rows in nodes of the model moved on. choices (topic_id, attempt, decision, feedback):
    what a reviewer says of the outline of an attempt; approve where nothing is said."""
    calls = state.where(F.col("node").isin(*MODEL_NODES)).select("topic_id", F.posexplode(_prompts()).alias("part", "prompt")).withColumn("call_checksum", F.sha2("prompt", 256))
    answers, new = memo.memoised(calls, cache, model)
    got = answers.groupBy("topic_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("part", F.coalesce("response", F.lit("")).alias("r")))), lambda x: x["r"]).alias("__a"))  # one a section
    said = choices.select("topic_id", F.col("attempt").alias("attempts"), F.col("decision").alias("__d"), F.col("feedback").alias("__f"))
    s = state.join(got, "topic_id", "left").join(said, ["topic_id", "attempts"], "left")
    node, one = F.col("node"), F.get("__a", F.lit(0))
    decision = F.coalesce("__d", F.lit("approve"))
    s = s.withColumn("__outline", F.when(node == "outline", _outline(one)))
    marks = F.from_json(tx.json_payload(one), _JUDGED)
    average, verdict = review.judged([F.coalesce(marks[k], F.lit(0.0)) for k in SCORES], marks["average"], marks["verdict"], least)
    if skip_judge:
        average, verdict = F.lit(10.0), F.lit("APPROVED")
    s = s.withColumn("__average", F.when(node == "judge", F.coalesce(average, F.lit(0.0)))).withColumn("__verdict", F.when(node == "judge", F.coalesce(verdict, F.lit("REJECTED"))))
    bad = F.col("__verdict") == "REJECTED"
    again = bad & (F.col("iteration") + 1 < rounds)
    texts = F.zip_with("outline.sections", "__a", lambda x, a: F.concat(F.lit("## "), x["title"], F.lit("\n\n"), F.trim(a)))
    draft = F.when(node == "draft", F.concat(F.lit("# "), F.col("outline.title"), F.lit("\n\n"), F.array_join(texts, "\n\n"))).otherwise(F.col("draft"))
    plain = F.col("personality") == "neutral"
    after_outline = F.when(F.col("outline_only"), "end").when(decision == "abort", "end").when(decision == "regenerate", "outline").otherwise("draft")
    only = (node == "outline") & F.col("outline_only")
    out = s.withColumns({
        "node": F.when(node == "queries", "search").when(node == "outline", after_outline).when(node == "draft", F.when(plain, "judge").otherwise("style")).when(node == "style", "judge").when((node == "judge") & again, "draft").when(node == "judge", "end").otherwise(node),
        "pending": F.when(node == "queries", _queries(one)).otherwise(F.col("pending")),
        "outline": F.coalesce("__outline", "outline"),
        "attempts": F.col("attempts") + F.when(node == "outline", 1).otherwise(0),
        "feedback": F.when(node == "outline", F.when(decision == "regenerate", F.coalesce("__f", F.lit(""))).otherwise("")).when(node == "judge", F.when(bad, F.coalesce(marks["feedback"], F.lit(""))).otherwise("")).otherwise(F.col("feedback")),
        "draft": draft,
        "body": F.when(only, _shown(F.col("__outline"))).when(node == "draft", draft).when((node == "style") & (F.trim(one) != ""), F.trim(one)).otherwise(F.col("body")),
        "iteration": F.col("iteration") + F.when((node == "judge") & bad, 1).otherwise(0),
        "average": F.coalesce("__average", "average"),
        "verdict": F.coalesce("__verdict", "verdict"),
        "ended": F.when(only, "outline").when((node == "outline") & (decision == "abort"), "aborted").when((node == "judge") & ~again, F.when(bad, "rejected").otherwise("approved")).otherwise(F.col("ended")),
    })
    return out.select(state.columns), new


def searched(state: DataFrame, library: dict, embed: Callable[[DataFrame], DataFrame], choices: DataFrame, cfg: Config, mode: str = "hybrid") -> DataFrame:
    """States after the pending queries of all rows in node search ran as one batch, and their notes were merged with those that a
    row had: the best score of a note counts, the best ``article_notes`` stay. library: notes (id, title, document[, note_id]),
    vectors, edges, and, where there are, boost (topic_id, id), notes of a topic's map, and lexical, a stored index.
    choices (topic_id, look, decision, extra): what a reviewer says of the notes after a look; enrich searches the extra
    queries that have not run. Queries are known by 64-bit hashes of their topic and place."""
    a, here = cfg.answer, state.where("node = 'search'")
    todo = stored(here.select("topic_id", F.posexplode(F.array_except("pending", "executed")).alias("seq", "query_text")).withColumn("query_id", F.xxhash64("topic_id", F.lit("query"), "seq")))
    every = library["notes"]
    hits = fusion.search(todo.select("query_id", "query_text").join(embed(todo), "query_id"), every.select("id", "title", "document"), library["vectors"], a.topk_article, mode, library.get("floor"), library.get("edges"), cfg.graph.article_hops, cfg.graph.decay, cfg.graph.most, lexical=library.get("lexical") if mode == "hybrid" else None)
    found = hits.select("query_id", "id", "score").join(todo.select("query_id", "topic_id"), "query_id").select("topic_id", "id", F.round("score", 9).alias("score"))
    found = found.unionByName(here.select("topic_id", F.explode("hits").alias("h")).select("topic_id", "h.id", "h.score"))
    if "boost" in library:
        linked = library["boost"].join(here.select("topic_id"), "topic_id", "left_semi").join(every.select("id"), "id", "left_semi")
        some = found.select("topic_id").distinct()
        found = found.unionByName(linked.join(some, "topic_id", "left_semi").select("topic_id", "id", F.lit(1.0).alias("score")))
    best = found.groupBy("topic_id", "id").agg(F.max("score").alias("score"))
    top = best.withColumn("r", F.row_number().over(Window.partitionBy("topic_id").orderBy(F.col("score").desc(), "id"))).where(F.col("r") <= a.article_notes)
    link = F.col("note_id").cast("string") if "note_id" in every.columns else F.col("id").cast("string")
    text = F.coalesce("document", F.lit(""))
    body = F.when(F.length(text) > a.article_chars, F.concat(F.substring(text, 1, a.article_chars), F.lit("..."))).otherwise(text)
    named = every.select("id", link.alias("__link"), F.concat(F.lit("### "), F.coalesce("title", F.lit("")), F.lit("\n[[PERM-"), link, F.lit("]]\n\n"), body).alias("__block"))
    lists = top.join(named, "id").groupBy("topic_id").agg(F.array_sort(F.collect_list(F.struct("r", F.struct("score", "id").alias("h"), F.struct(F.col("__link").alias("id"), F.col("__block").alias("block")).alias("b")))).alias("__x"))  # at most article_notes
    said = choices.select("topic_id", F.col("look").alias("looks"), F.col("decision").alias("__d"), F.col("extra").alias("__e"))
    s = state.join(lists, "topic_id", "left").join(said, ["topic_id", "looks"], "left")
    at, none = F.col("node") == "search", F.coalesce(F.size("__x"), F.lit(0)) <= 0
    ran = F.array_distinct(F.concat("executed", "pending"))
    extra = F.array_except(F.filter(F.transform(F.coalesce("__e", F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != ""), ran)
    more = (F.col("__d") == "enrich") & (F.size(extra) > 0)
    stop = F.coalesce(F.col("__d") == "abort", F.lit(False))
    out = s.withColumns({
        "node": F.when(at, F.when(none | stop, "end").when(more, "search").otherwise("outline")).otherwise(F.col("node")),
        "executed": F.when(at, ran).otherwise(F.col("executed")),
        "pending": F.when(at, F.when(more, extra).otherwise(F.array().cast("array<string>"))).otherwise(F.col("pending")),
        "hits": F.when(at & ~none, F.transform("__x", lambda x: x["h"])).otherwise(F.col("hits")),
        "blocks": F.when(at & ~none, F.transform("__x", lambda x: x["b"])).otherwise(F.col("blocks")),
        "looks": F.col("looks") + F.when(at, 1).otherwise(0),
        "body": F.when(at & none, NO_EVIDENCE).otherwise(F.col("body")),
        "ended": F.when(at & none, "no_evidence").when(at & stop, "aborted").otherwise(F.col("ended")),
    })
    return out.select(state.columns)


def run(state: DataFrame, library: dict, embed: Callable[[DataFrame], DataFrame], cache: DataFrame, model: Callable[[str], str] = memo.stub, cfg: Config | None = None, looks: DataFrame | None = None, choices: DataFrame | None = None, rounds: int = 3, least: float = 7.0, skip_judge: bool = False, mode: str = "hybrid", keep: Callable[[DataFrame, DataFrame | None], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(states in their end, cache additions): rounds until no topic is on its way. keep(states, new answers or null) stores a round
    and gives its states back; a later call with these states goes on from there. The driver sees one count of nodes a round."""
    cfg, spark = cfg or Config(), state.sparkSession
    keep = keep or (lambda s, _: stored(s))
    kind = state.schema["topic_id"].dataType.simpleString()
    looks = spark.createDataFrame([], f"topic_id {kind}, look int, decision string, extra array<string>") if looks is None else looks
    choices = spark.createDataFrame([], f"topic_id {kind}, attempt int, decision string, feedback string") if choices is None else choices
    state, made = keep(state, None), cache.select("call_checksum", "response").limit(0)
    while True:
        live = {r["node"] for r in state.where("node <> 'end'").select("node").distinct().collect()}  # at most six names
        if not live:
            return state, made.dropDuplicates(["call_checksum"])
        if "search" in live:
            state = keep(searched(state, library, embed, looks, cfg, mode), None)
        if live & set(MODEL_NODES):
            state, new = asked(state, cache.select("call_checksum", "response").unionByName(made), model, choices, rounds, least, skip_judge)
            state = keep(state, new)
            made = made.unionByName(new.select("call_checksum", "response"))


def report(state: DataFrame, files: DataFrame, sources: DataFrame) -> DataFrame:
    """(topic_id, topic, ended, average, rounds, body, warnings): bodies of articles with the references of the sources that they cite
    (source_id, authors, year, in_text_cite, reference) at the end, and their warnings in order; one that was rejected says so."""
    written = F.col("ended").isin("approved", "rejected")
    texts = state.where(written).select(F.col("topic_id").alias("article_id"), F.coalesce("body", F.lit("")).alias("body"))
    cited = notes.cited_sources(texts.withColumnRenamed("body", "text"), sources)
    listed = notes.reading_list(cited, sources).select(F.col("article_id").alias("topic_id"), F.col("body").alias("__refs"))
    wrong = notes.article_warnings(texts, files, sources, NO_EVIDENCE).groupBy(F.col("article_id").alias("topic_id")).agg(F.array_sort(F.collect_set("warning")).alias("__w"))  # of one article
    late = F.when(F.col("ended") == "rejected", F.array(F.lit("Artigo rejeitado pelo juiz."))).otherwise(F.array().cast("array<string>"))
    out = state.join(listed, "topic_id", "left").join(wrong, "topic_id", "left")
    body = F.when(F.col("__refs").isNotNull(), F.concat("body", F.lit("\n\n## Referências\n\n"), "__refs")).otherwise(F.coalesce("body", F.lit("")))
    return out.select("topic_id", "topic", "ended", "average", F.col("iteration").alias("rejections"), body.alias("body"), F.concat(F.coalesce("__w", F.array().cast("array<string>")), late).alias("warnings"))
