"""Note bodies, links between notes, topic maps and articles, as columns and frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notegrove.functions import text as tx

#: Headings of the notes.
NO_LINKS = "_Nenhuma nota granular aprovada ainda._"
NO_NOTES = "Nenhuma nota existente encontrada."


def _has(x: Column) -> Column:
    return F.coalesce(F.trim(x.cast("string")), F.lit("")) != ""


def _part(head: str, x: Column) -> Column:
    return F.when(_has(x), F.concat(F.lit(f"## {head}\n\n"), x, F.lit("\n")))


def figures(images: Column) -> Column:
    """Embeds of (path, description), each with its description below."""
    one = lambda i: F.concat(F.lit("![["), i["path"], F.lit("]]\n"), F.when(_has(i["description"]), F.concat(F.lit("\n"), i["description"], F.lit("\n"))).otherwise(""))
    return F.when(F.size(images) > 0, F.array_join(F.transform(images, one), "\n"))


def connection_lines(connections: Column) -> Column:
    """A line for each (wiki_link, relation_type, description)."""
    one = lambda c: F.concat(F.lit("- "), c["wiki_link"], F.lit(" ("), F.coalesce(c["relation_type"], F.lit("related")), F.lit(")"), F.when(_has(c["description"]), F.concat(F.lit(" -- "), c["description"])).otherwise(""))
    return F.when(F.size(connections) > 0, F.array_join(F.transform(connections, one), "\n"))


def permanent_note(thesis: Column, definition: Column, intuition: Column, example: Column, limits: Column, literature: Column, locator: Column, images: Column, connections: Column) -> Column:
    """Body of a permanent note; optional parts that are missing are left out."""
    shown, linked = figures(images), connection_lines(connections)
    return F.concat_ws(
        "\n",
        F.concat(F.lit("> **Tese**: "), thesis, F.lit("\n")),
        F.concat(F.lit("## Definição\n\n"), definition, F.lit("\n")),
        _part("Intuição", intuition), _part("Exemplo", example), _part("Limites", limits),
        F.when(shown.isNotNull(), F.concat(F.lit("## Figuras\n\n"), shown)),
        F.concat(F.lit("## Fonte\n\n- Ref. literatura: "), F.coalesce(literature, F.lit(""))),
        F.when(_has(locator), F.concat(F.lit("- Localizador: "), locator)),
        F.lit(""),
        F.when(linked.isNotNull(), F.concat(F.lit("## Conexões\n\n"), linked, F.lit("\n"))),
    )


def literature_index_note(title: Column, links: Column, mark: str = "note") -> Column:
    """Body of a source's index: links to its approved literature notes, in a managed block."""
    lines = F.when(F.size(links) > 0, F.array_join(F.transform(links, lambda x: F.concat(F.lit("- "), x)), "\n")).otherwise(NO_LINKS)
    head = F.concat(F.lit("# "), title, F.lit(" — Indice de Literatura\n\n← [[SRC - "), tx.slug(title), F.lit("]]\n\n## Notas de Literatura aprovadas\n\n"))
    return F.concat(head, F.lit(f"<!-- {mark}:auto-lit-index:start -->\n"), lines, F.lit(f"\n<!-- {mark}:auto-lit-index:end -->\n"))


def source_note(title: Column, authors: Column, reference: Column, summary: Column) -> Column:
    """Body of a source note: title, authors, its reference and what it is about."""
    return F.concat_ws("\n", F.concat(F.lit("# "), title, F.lit("\n")), F.when(F.size(authors) > 0, F.concat(F.lit("**Autores**: "), F.array_join(authors, ", "), F.lit("\n"))), _part("Referência", reference), _part("Resumo", summary))


def literature_note(summary: Column, concepts: Column, quotes: Column, locator: Column) -> Column:
    """Body of a chunk's literature note: summary, concepts, quotes and where it stands."""
    items = lambda x, mark: F.when(F.size(x) > 0, F.array_join(F.transform(x, lambda i: F.concat(F.lit(mark), i)), "\n"))
    return F.concat_ws("\n", _part("Resumo", summary), _part("Conceitos", items(concepts, "- ")), _part("Citações", items(quotes, "> ")), F.when(_has(locator), F.concat(F.lit("- Localizador: "), locator)))


def topic_map(topic: Column, summary: Column, sections: Column) -> Column:
    """Body of a map from (title, description, links) sections, as ``text.map_sections`` reads it."""
    one = lambda s: F.concat(F.lit("## "), s["title"], F.lit("\n\n"), F.when(_has(s["description"]), F.concat(s["description"], F.lit("\n\n"))).otherwise(""), F.array_join(F.transform(s["links"], lambda x: F.concat(F.lit("- "), x)), "\n"), F.lit("\n"))
    return F.concat(F.lit("# "), topic, F.lit("\n\n"), F.coalesce(summary, F.lit("")), F.lit("\n\n"), F.array_join(F.transform(sections, one), "\n"))


def wiki_link(identifier: Column, title: Column, prefix: str = "PERM") -> Column:
    """A link to a note, with the slug of its title where that is known."""
    return F.concat(F.lit(f"[[{prefix} - "), identifier.cast("string"), F.when(_has(title), F.concat(F.lit(" - "), tx.slug(title))).otherwise(""), F.lit("]]"))


def resolved(connections: DataFrame, notes: DataFrame, prefix: str = "PERM") -> DataFrame:
    """Connections (source, target, relation_type, description) with the link to their target; notes: (id, title). One join for
    all notes; a note that is not there has a link without title."""
    known = notes.select(F.col("id").alias("target"), F.col("title").alias("__t"))
    return connections.join(known, "target", "left").withColumn("wiki_link", wiki_link(F.col("target"), F.col("__t"), prefix)).drop("__t")


def with_refinements(connections: DataFrame, refines: DataFrame, reason: str = "refines") -> DataFrame:
    """Connections with an ``extends`` edge from each refining note (source, target[, reason]) to the one that it refines, unless
    they are connected already."""
    new = refines.where("target is not null").select("source", "target", F.lit("extends").alias("relation_type"), (F.col("reason") if "reason" in refines.columns else F.lit(reason)).alias("description"))
    fresh = new.join(connections.select("source", "target").distinct(), ["source", "target"], "left_anti")
    return connections.select(fresh.columns).unionByName(fresh)


def gathered(resolved_: DataFrame) -> DataFrame:
    """(source, connections): the links of each note in order of target and relation, for ``permanent_note``. A note's own
    connections only, which its author wrote."""
    rows = resolved_.select("source", F.struct("target", F.coalesce("relation_type", F.lit("related")).alias("relation_type"), "wiki_link", "description").alias("s"))
    return rows.groupBy("source").agg(F.transform(F.array_sort(F.collect_set("s")), lambda s: F.struct(s["wiki_link"].alias("wiki_link"), s["relation_type"].alias("relation_type"), s["description"].alias("description"))).alias("connections"))


def rag_context(hits: DataFrame, prefix: str = "PERM", chars: int = 150) -> DataFrame:
    """(query_id, context): found notes (query_id, id, hop, title, document, via_from, via_relation, rank) as two lists, those of
    the search and those of the graph."""
    link = wiki_link(F.col("id"), F.coalesce("title", F.lit("Sem titulo")), prefix)
    via = F.when(F.col("via_from").isNotNull(), F.concat(F.lit(f" a partir de [[{prefix} - "), F.col("via_from").cast("string"), F.lit("]]"))).otherwise("")
    how = F.when(F.col("hop") == 0, F.lit("**")).otherwise(F.concat(F.lit("** (relacao: "), F.coalesce("via_relation", F.lit("related")), via, F.lit(")")))
    line = F.concat(F.lit("- **"), link, how, F.lit(": "), F.substring(F.coalesce("document", F.lit("")), 1, chars), F.lit("..."))
    rows = hits.select("query_id", F.struct((F.col("hop") > 0).alias("graph"), "rank", "id", line.alias("line")).alias("s"))
    lines = lambda graph: F.transform(F.filter("s", lambda x: x["graph"] == graph), lambda x: x["line"])
    block = lambda head, x: F.when(F.size(x) > 0, F.concat(F.lit(head + "\n"), F.array_join(x, "\n")))
    by = rows.groupBy("query_id").agg(F.array_sort(F.collect_list("s")).alias("s"))
    return by.select("query_id", F.concat_ws("\n\n", block("### Similares por embedding", lines(False)), block("### Vizinhas por conexao no grafo", lines(True))).alias("context"))


def placed(maps: DataFrame, placements: DataFrame, ignore: str = "ignorar") -> DataFrame:
    """Sections of maps (moc_id, at, title, note_ids) after notes were placed (moc_id, seq, subsection, note_id): known
    subsections get the notes that they lack appended, new ones follow in the order of their first note, and placements under
    ``ignore``, whatever its case, are dropped."""
    real = placements.where(F.lower("subsection") != ignore).groupBy("moc_id", "subsection", "note_id").agg(F.min("seq").alias("seq"))
    by = real.groupBy("moc_id", F.col("subsection").alias("title")).agg(F.min("seq").alias("first"), F.transform(F.array_sort(F.collect_list(F.struct("seq", "note_id"))), lambda x: x["note_id"]).alias("new"))
    last = maps.groupBy("moc_id").agg(F.max("at").alias("last"))
    both = maps.join(by, ["moc_id", "title"], "full_outer")
    added = both.where("at is null").join(last, "moc_id", "left")
    nth = F.row_number().over(Window.partitionBy("moc_id").orderBy("first", "title"))
    old = both.where("at is not null").select("moc_id", "at", "title", F.concat("note_ids", F.coalesce(F.array_except("new", "note_ids"), F.array().cast(maps.schema["note_ids"].dataType))).alias("note_ids"))
    return old.unionByName(added.select("moc_id", (F.coalesce("last", F.lit(-1)) + nth).cast(maps.schema["at"].dataType).alias("at"), "title", F.col("new").alias("note_ids")))


def article_queries(topic: DataFrame, extras: DataFrame, made: DataFrame, most: int) -> DataFrame:
    """(topic_id, at, query): the user's queries, then the model's, each once in order, the topic before them unless it is among
    them; at most the larger of ``most`` and one more than the user's. Frames: topic (topic_id, topic), others (topic_id, seq, query)."""
    clean = lambda d, rank: d.select("topic_id", F.lit(rank).alias("rank"), "seq", F.trim("query").alias("query")).where("query <> ''")
    every = clean(extras, 1).unionByName(clean(made, 2))
    first = every.groupBy("topic_id", "query").agg(F.min(F.struct("rank", "seq")).alias("o"))
    own = topic.select("topic_id", F.trim("topic").alias("query")).where("query <> ''").join(first.select("topic_id", "query"), ["topic_id", "query"], "left_anti")
    out = first.unionByName(own.withColumn("o", F.struct(F.lit(0).alias("rank"), F.lit(0).cast(every.schema["seq"].dataType).alias("seq"))))
    n = clean(extras, 1).groupBy("topic_id").agg(F.count("*").alias("n"))
    out = out.withColumn("at", F.row_number().over(Window.partitionBy("topic_id").orderBy("o", "query")) - 1).join(n, "topic_id", "left")
    return out.where(F.col("at") < F.greatest(F.lit(most), F.coalesce("n", F.lit(0)) + 1)).select("topic_id", "at", "query")


def _surname(authors: Column) -> Column:
    return F.upper(F.element_at(F.split(F.trim(F.get(authors, F.lit(0))), r"\s+"), -1))


def _capitals(text: Column) -> Column:
    """The upper-case words after an opening bracket of a text, each with what follows up to the closing one."""
    return F.regexp_extract_all(text, F.lit(r"\(([^()]*)\)"), F.lit(1))


def cited_sources(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """(article_id, source_id): sources (source_id, authors, year, in_text_cite) that a text (article_id, text) cites: by the exact
    citation, or by a bracket that starts with the first author's surname and holds the year. Brackets and sources meet by surname."""
    brackets = articles.select("article_id", F.explode(F.array_distinct(_capitals(F.col("text")))).alias("inner"))
    brackets = brackets.withColumn("key", F.regexp_extract("inner", r"^([^\s,;.]+)", 1))
    s = sources.select("source_id", _surname(F.col("authors")).alias("key"), F.col("year").cast("string").alias("y"), "in_text_cite")
    met = brackets.join(s, "key").where((F.concat(F.lit("("), "inner", F.lit(")")) == F.col("in_text_cite")) | (F.col("y").isNotNull() & F.col("inner").contains(F.col("y"))))
    return met.select("article_id", "source_id").distinct()


def article_warnings(articles: DataFrame, files: DataFrame, sources: DataFrame, no_evidence: str) -> DataFrame:
    """(article_id, warning): of an empty article only that; else embeds of files (path) that are not there and citations whose
    brackets hold no surname of a source (authors)."""
    empty = F.trim("body").isin("", no_evidence) | F.col("body").isNull()
    out = articles.where(empty).select("article_id", F.lit("Corpo do artigo vazio ou sem evidencia.").alias("warning"))
    some = articles.where(~empty)
    embeds = some.select("article_id", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(r"!\[\[([^\]|]+)"), F.lit(1)))).alias("path"))
    out = out.unionByName(embeds.join(files.select("path").distinct(), "path", "left_anti").select("article_id", F.concat(F.lit("Embed inexistente: "), "path").alias("warning")))
    cites = some.select("article_id", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(r"\(([A-ZÀ-Ú][^)]*?,\s*(?:s\.d\.|\d{4}))"), F.lit(1)))).alias("cite"))
    words = cites.select("article_id", "cite", F.explode(F.split(F.upper("cite"), r"[^\p{L}\p{N}_'-]+")).alias("word"))
    known = words.join(sources.select(_surname(F.col("authors")).alias("word")).distinct(), "word", "left_semi").select("article_id", "cite").distinct()
    orphans = cites.join(known, ["article_id", "cite"], "left_anti")
    return out.unionByName(orphans.select("article_id", F.concat(F.lit("Citacao possivelmente orfa: ("), "cite", F.lit("...)")).alias("warning")))


def reading_list(cited: DataFrame, sources: DataFrame) -> DataFrame:
    """(article_id, body): the references of the cited sources, sorted without regard to case."""
    rows = cited.join(sources.select("source_id", "reference"), "source_id").where("reference is not null").select("article_id", F.struct(F.upper("reference").alias("u"), "reference").alias("s"))
    return rows.groupBy("article_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set("s")), lambda s: F.concat(F.lit("- "), s["reference"])), "\n").alias("body"))


def to_record(hits: DataFrame) -> DataFrame:
    """Hits as JSON records; the rank of the vector search is not kept."""
    return hits.select("query_id", F.to_json(F.struct(*[c for c in hits.columns if c not in ("query_id", "vector_rank")])).alias("record"))


def from_record(records: DataFrame, schema: str) -> DataFrame:
    return records.select("query_id", F.from_json("record", schema).alias("r")).select("query_id", "r.*")


def costs(sources: DataFrame, usage: DataFrame) -> DataFrame:
    """Sources with the six cost fields of their usage (source_id, kind, tokens_in, tokens_out, cost_usd), dollars in six
    decimals; no usage is 0."""
    llm = F.col("kind") == "llm"
    total = usage.where("kind <> 'cache_hit'").groupBy("source_id").agg(
        F.round(F.sum("cost_usd"), 6).alias("cost_usd_total"),
        F.round(F.sum(F.when(llm, F.col("cost_usd")).otherwise(0.0)), 6).alias("cost_usd_llm"),
        F.round(F.sum(F.when(~llm, F.col("cost_usd")).otherwise(0.0)), 6).alias("cost_usd_embedding"),
        F.sum(F.when(llm, F.col("tokens_in")).otherwise(0)).alias("tokens_prompt"),
        F.sum(F.when(llm, F.col("tokens_out")).otherwise(0)).alias("tokens_completion"),
        F.sum(F.when(~llm, F.col("tokens_in")).otherwise(0)).alias("tokens_embedding"),
    )
    fields = total.columns[1:]
    return sources.join(total, "source_id", "left").withColumns({c: F.coalesce(c, F.lit(0).cast(total.schema[c].dataType)) for c in fields})
