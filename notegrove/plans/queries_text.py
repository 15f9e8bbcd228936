"""Queries over text functions, ids, chunking, paging and citations, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from notegrove.functions import biblio, ids, paging, pricing
from notegrove.functions import text as tx
from notegrove.operators import chunking, review
from notegrove.session import table

_W = r"[\p{L}\p{N}_]"
_NORM = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '\r\n?', E'\n', 'g'), '[ \t]+', ' ', 'g'), ' *\n *', E'\n', 'g'), '\n{{3,}}', E'\n\n', 'g'), '([\p{{L}}\p{{N}}_])-\n([\p{{L}}\p{{N}}_])', '\1\2', 'g'), E' \t\n\r\f' || chr(11))"""
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def norm(x: str) -> str:
    return _NORM.format(x=x)


_MESSY = "replace(replace(text, '. ', E'.  \\t'), ', ', E',\\r\\n')"


@query(f"SELECT doc_id, sha256({norm(_MESSY)}) AS checksum, length({norm(_MESSY)})::BIGINT AS n FROM documents")
def q_normalize_hash(spark, sf):
    messy = F.replace(F.replace(F.col("text"), F.lit(". "), F.lit(".  \t")), F.lit(", "), F.lit(",\r\n"))
    x = tx.normalize(messy)
    return table(spark, sf, "documents").select("doc_id", F.sha2(x, 256).alias("checksum"), F.length(x).cast("long").alias("n"))


@query(f"""
WITH c AS (SELECT doc_id, source || '::ch' || lpad((doc_id % 7)::VARCHAR, 3, '0') AS chapter_id, source, sha256({norm("text")}) AS checksum FROM documents)
SELECT doc_id, source || '::' || chapter_id || '::' || substr(sha256(checksum), 1, 8) AS chunk_id,
       source || '::concept::' || substr(sha256(sha256(source || '|' || chapter_id || '|' || checksum)), 1, 8) AS concept_id,
       sha256('p|' || checksum || '|m|0.2|pt|r') AS call_checksum FROM c""")
def q_chunk_ids(spark, sf):
    d = table(spark, sf, "documents").withColumn("chapter_id", ids.chapter_id(F.col("source"), F.col("doc_id") % 7)).withColumn("checksum", ids.chunk_checksum(F.col("text")))
    return d.select(
        "doc_id",
        ids.chunk_id(F.col("source"), F.col("chapter_id"), F.col("checksum")).alias("chunk_id"),
        ids.concept_id(F.col("source"), F.col("chapter_id"), F.col("checksum")).alias("concept_id"),
        ids.call_checksum(F.lit("p"), F.col("checksum"), F.lit("m"), F.lit(0.2), F.lit("pt"), F.lit("r")).alias("call_checksum"),
    )


_BODY = "'---' || E'\\n' || 'title: x' || E'\\n' || '---' || E'\\n' || text || E'\\n' || '<!-- note:auto-backlinks:start -->' || E'\\n' || source || E'\\n' || '<!-- note:auto-backlinks:end -->' || CASE WHEN doc_id % 3 = 0 THEN '<!-- note:auto-x:start -->' || lang ELSE '' END"


@query("SELECT doc_id, sha256(" + norm(rf"""regexp_replace(regexp_replace(regexp_replace({_BODY}, '(?s)\A---\n.*?\n---\n?', ''), '(?s)<!-- [a-z]+:auto-[a-z-]+:start -->.*?<!-- [a-z]+:auto-[a-z-]+:end -->\n?', '', 'g'), '(?s)<!-- [a-z]+:auto-[a-z-]+:start -->.*', '')""") + ") AS checksum FROM documents")
def q_embeddable_text(spark, sf):
    body = F.concat(F.lit("---\ntitle: x\n---\n"), "text", F.lit("\n<!-- note:auto-backlinks:start -->\n"), "source", F.lit("\n<!-- note:auto-backlinks:end -->"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("<!-- note:auto-x:start -->"), "lang")).otherwise(""))
    return table(spark, sf, "documents").select("doc_id", F.sha2(tx.embeddable(body), 256).alias("checksum"))


_STOP = """['a', 'o', 'as', 'os', 'um', 'uma', 'uns', 'umas', 'de', 'da', 'do', 'das', 'dos', 'em', 'na', 'no', 'nas', 'nos', 'por', 'para', 'com', 'sem', 'sobre', 'entre', 'ate', 'apos', 'e', 'ou', 'mas', 'que', 'se', 'como', 'quando', 'onde', 'porque', 'pois',
 'eu', 'tu', 'ele', 'ela', 'voces', 'eles', 'elas', 'seu', 'sua', 'seus', 'suas', 'este', 'esta', 'esse', 'essa', 'isso', 'aquele', 'aquela', 'aquilo', 'sao', 'foi', 'foram', 'ser', 'estar', 'estao', 'tem', 'teve', 'ha', 'nao', 'sim', 'mais', 'muito', 'muitos', 'muitas', 'ja', 'ainda', 'tambem', 'qual', 'quais']"""
TOKENS_SQL = r"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]+')"
QUERY_TOKENS_SQL = "list_filter(" + TOKENS_SQL + f", lambda t: length(t) >= 2 AND NOT list_contains({_STOP}, t))[1:32]"


@query(f"SELECT item_id, CASE WHEN len(t) > 0 THEN array_to_string(list_transform(t, lambda x: '\"' || x || '\"'), ' OR ') END AS expr FROM (SELECT item_id, {QUERY_TOKENS_SQL.format(x='text')} AS t FROM benchmark)")
def q_tokens_match_expr(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", tx.match_expression(F.col("text")).alias("expr"))


@query(rf"""
SELECT doc_id, rtrim(substr(regexp_replace(regexp_replace(trim(lower(text), E' \t\n\r\f' || chr(11)), '[^\p{{L}}\p{{N}}_\s-]', '', 'g'), '[\s_]+', '-', 'g'), 1, 50), '-') AS slug,
  source || '-' || doc_id::VARCHAR || '-' || rtrim(substr(regexp_replace(regexp_replace(trim(lower(text), E' \t\n\r\f' || chr(11)), '[^\p{{L}}\p{{N}}_\s-]', '', 'g'), '[\s_]+', '-', 'g'), 1, 50), '-') || '.md' AS filename FROM documents""".replace("{{", "{").replace("}}", "}"))
def q_slug_filename(spark, sf):
    title = F.col("text")
    return table(spark, sf, "documents").select("doc_id", tx.slug(title).alias("slug"), tx.note_filename(F.col("source"), F.col("doc_id").cast("string"), title).alias("filename"))


@query("""
SELECT doc_id, n_markers, n_markers >= 3 AS needs_fix FROM (SELECT doc_id, (""" + " + ".join(f"contains(lower(text), '{m} ')::INT" for m in "the and this that with from which where".split()) + ")::INT AS n_markers FROM documents)")
def q_language_guard(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.english_markers(F.col("text")).alias("n_markers")).withColumn("needs_fix", F.col("n_markers") >= 3)


@query(r"""
SELECT doc_id, CASE WHEN length(x) > 72 THEN substr(x, 1, 69) || '...' ELSE x END AS clip,
 trim(regexp_replace(substr(text, greatest(n_chars // 2 - 40, 1), 80), '\s+', ' ', 'g')) AS snippet
FROM (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS x FROM documents)""")
def q_clip_snippet(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.clip(F.col("text")).alias("clip"), tx.snippet(F.col("text"), F.expr("cast(n_chars div 2 as int)"), 40).alias("snippet"))


@query(r"""
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN trim(props) WHEN event_id % 3 = 1 THEN props ELSE props END AS payload, json_extract_string(props, '$.k')::INT AS k FROM events""")
def q_json_extract(spark, sf):
    e = table(spark, sf, "events")
    answer = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```\n"))).when(F.col("event_id") % 3 == 1, F.col("props")).otherwise(F.concat(F.lit("Here it is: "), "props", F.lit(" as asked")))
    p = tx.json_payload(answer)
    return e.select("event_id", p.alias("payload"), F.from_json(p, "k int")["k"].alias("k"))


@query("""
SELECT 'doc' AS kind, doc_id AS id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END::BIGINT AS tokens,
  round(CASE WHEN doc_id % 4 = 0 THEN 0.0 ELSE (CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END) * 0.02 / 1e6 END, 6)::DOUBLE AS cost_usd FROM documents
UNION ALL SELECT 'turn', conv_id * 1000 + turn, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END::BIGINT,
  round(CASE WHEN (conv_id * 1000 + turn) % 4 = 0 THEN 0.0 ELSE (CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END) * 0.02 / 1e6 END, 6)::DOUBLE FROM conversations""")
def q_token_cost(spark, sf):
    d = table(spark, sf, "documents").select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), "text")
    c = table(spark, sf, "conversations").select(F.lit("turn").alias("kind"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    use = d.unionByName(c).select("kind", "id", F.when(F.col("id") % 4 == 0, "ollama").otherwise("remote").alias("provider"), F.lit("small").alias("model"), pricing.embed_tokens(F.col("text")).alias("tokens_in"), F.lit(0).alias("tokens_out"))
    prices = spark.createDataFrame([("small", 0.02, 0.0)], "model string, usd_in double, usd_out double")
    return pricing.priced(use, prices).select("kind", "id", F.col("tokens_in").alias("tokens"), "cost_usd")


# --- structure -------------------------------------------------------------------------------------------------

_LINES = "SELECT doc_id, (i - 1)::INT AS line_no, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, E'\\n') AS l FROM documents))"
_MD = f"SELECT doc_id, line_no, CASE WHEN line_no = 0 THEN '# ' WHEN line_no % 7 = 3 THEN '#### ' WHEN line_no % 5 = 2 THEN '### ' WHEN line_no % 11 = 10 THEN '## ' ELSE '' END || line AS line FROM ({_LINES})"


def _lines(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def _markdown(spark, sf):
    """Lines with a heading mark before some of them."""
    n = F.col("line_no")
    mark = F.when(n == 0, "# ").when(n % 7 == 3, "#### ").when(n % 5 == 2, "### ").when(n % 11 == 10, "## ").otherwise("")
    return _lines(spark, sf).select("doc_id", "line_no", F.concat(mark, F.col("line")).alias("line"))


def _markdown_text(spark, sf):
    return _markdown(spark, sf).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))


@query(rf"""
WITH m AS ({_MD}), h AS (SELECT *, regexp_matches(line, '^#{{1,2}}[ \t]+\S') AS head FROM m),
g AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS part FROM h),
p AS (SELECT doc_id, part, any_value(trim(regexp_extract(line, '^#{{1,2}}[ \t]+(.*)$', 1))) FILTER (head) AS title,
      trim(coalesce(string_agg(line, E'\n' ORDER BY line_no) FILTER (NOT head), ''), E' \t\n\r') AS text, max(part) OVER (PARTITION BY doc_id) AS parts FROM g GROUP BY doc_id, part),
k AS (SELECT *, max((title IS NOT NULL)::INT) OVER (PARTITION BY doc_id) AS headed FROM p)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1)::INT AS chapter, coalesce(title, CASE WHEN headed = 1 THEN 'Introdução' ELSE 'Documento completo' END) AS title, length(text)::INT AS n FROM k WHERE text <> ''""")
def q_chapter_split(spark, sf):
    return chunking.chapters(_markdown_text(spark, sf), "doc_id", "text").select("doc_id", "chapter", "title", F.length("text").alias("n"))


def _section_sql() -> str:
    at = ", ".join(f"last_value(CASE WHEN level = {i} THEN {{'o': line_no, 'h': heading}} END IGNORE NULLS) OVER w AS a{i}, max(CASE WHEN level < {i} THEN line_no END) OVER w AS b{i}" for i in range(1, 7))
    path = ", ".join(f"CASE WHEN a{i}.o > coalesce(b{i}, -1) THEN a{i}.h END" for i in range(1, 7))
    return rf"""
WITH m AS ({_MD}), h AS (SELECT *, nullif(length(regexp_extract(line, '^(#{{1,6}})[ \t]+\S', 1)), 0) AS level, trim(regexp_extract(line, '^#{{1,6}}[ \t]+(.*)$', 1)) AS heading FROM m),
s AS (SELECT doc_id, line_no, {at} FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING))
SELECT doc_id, line_no, concat_ws(' > ', {path}) AS section_path FROM s"""


@query(_section_sql())
def q_section_paths(spark, sf):
    return chunking.section_paths(_markdown(spark, sf), "doc_id", "line_no", "line").select("doc_id", "line_no", "section_path")


@query()
def q_chunk_split(spark, sf):
    ch = chunking.chapters(_markdown_text(spark, sf), "doc_id", "text")
    # measured before the chunks are numbered, so that their texts are not shuffled for it
    pieces = chunking.chunks(ch, "doc_id").withColumn("n", F.length("text"))
    return chunking.chunk_rows(pieces, "doc_id").select("doc_id", "chapter", "chunk_index", "section_path", "chunk_id", "n")


@query()
def q_small_section_merge(spark, sf):
    ch = chunking.chapters(_markdown_text(spark, sf), "doc_id", "text")
    return chunking.chunks(ch, "doc_id", size=1 << 30, least=400).select("doc_id", "chapter", "piece", "section_path", F.length("text").alias("n"))


_PAGE_SQL = (r"(?m)^\s*(\d{1,4})\s*$", r"\n\s*(\d{1,4})\s*\n", r"(?i)p[aá]gina\s+(\d+)", r"(?m)^\s*(\d{1,4})\s+[\p{L}\p{N}_]")


@query(rf"""
WITH t AS (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN (doc_id % 300)::VARCHAR || E'\n' || text WHEN 1 THEN text || E'\n' || 'Página ' || (doc_id % 90 + 12000)::VARCHAR || ' fim' WHEN 2 THEN '  12 ' || text WHEN 3 THEN '12 34 ' || text WHEN 4 THEN 'PÁGINA 7 ' || text ELSE text END AS text, CASE WHEN doc_id % 5 = 0 THEN doc_id % 2 * 7 END AS known FROM documents),
e AS (SELECT doc_id, known, substr(text, 1, 200) AS a, right(text, 200) AS b FROM t)
SELECT doc_id, coalesce(CASE WHEN known > 0 THEN known END, {", ".join(f"try_cast(nullif(regexp_extract({e}, '{p}', 1), '') AS INT)" for p in _PAGE_SQL for e in "ab")})::INT AS page FROM e""")
def q_page_hint(spark, sf):
    i = F.col("doc_id")
    shape = (F.concat((i % 300).cast("string"), F.lit("\n"), "text"), F.concat("text", F.lit("\nPágina "), (i % 90 + 12000).cast("string"), F.lit(" fim")), F.concat(F.lit("  12 "), "text"), F.concat(F.lit("12 34 "), "text"), F.concat(F.lit("PÁGINA 7 "), "text"))
    text = F.when(i % 7 == 0, shape[0])
    for k, x in enumerate(shape[1:], 1):
        text = text.when(i % 7 == k, x)
    return table(spark, sf, "documents").select("doc_id", paging.page_hint(text.otherwise(F.col("text")), F.when(i % 5 == 0, i % 2 * 7)).alias("page"))


_PAGED = f"SELECT doc_id, line_no, CASE WHEN line_no % 4 = 0 AND line_no > 0 THEN line_no // 3 + 1 END AS page FROM ({_LINES})"


def _paged(spark, sf):
    n = F.col("line_no")
    return _lines(spark, sf).select("doc_id", "line_no", F.when((n % 4 == 0) & (n > 0), F.floor(n / 3).cast("int") + 1).alias("page"))


@query(f"""
WITH p AS (SELECT *, last_value(CASE WHEN page IS NOT NULL THEN {{'i': line_no, 'p': page}} END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b,
 first_value(CASE WHEN page IS NOT NULL THEN {{'i': line_no, 'p': page}} END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM ({_PAGED}))
SELECT doc_id, line_no, CASE WHEN page IS NOT NULL THEN page WHEN b IS NOT NULL AND a IS NOT NULL THEN round_even(b.p + (a.p - b.p) * (line_no - b.i) / (a.i - b.i), 0)::INT ELSE b.p END::INT AS page_inferred,
 CASE WHEN page IS NOT NULL THEN 'explicit' WHEN b IS NOT NULL THEN 'inferred' ELSE 'unknown' END AS page_confidence FROM p""")
def q_page_interpolate(spark, sf):
    return chunking.interpolated_pages(_paged(spark, sf), "doc_id", "line_no", "page").select("doc_id", "line_no", "page_inferred", "page_confidence")


@query(f"""
SELECT doc_id, line_no, CASE WHEN page >= 3 THEN page - 3 + 5 END::INT AS page_in_book, concat_ws(' / ', CASE WHEN page >= 3 THEN 'p.' || (page - 3 + 5)::VARCHAR WHEN page IS NOT NULL THEN 'p.arquivo.' || page::VARCHAR END, 'S' || (line_no % 3)::VARCHAR) AS locator
FROM ({_PAGED}) WHERE page IS NULL OR page >= 2""")
def q_book_page(spark, sf):
    book = paging.book_page(F.col("page"), F.lit(3), F.lit(5))
    p = _paged(spark, sf).where(F.col("page").isNull() | (F.col("page") >= 2))
    return p.select("doc_id", "line_no", book.cast("int").alias("page_in_book"), paging.locator(book, F.concat(F.lit("S"), (F.col("line_no") % 3).cast("string")), F.col("page")).alias("locator"))


_START_SQL = (r"#+\s*cap[ií]tulo\s+1\b", r"#+\s*chapter\s+1\b", r"#+\s*1[\.\)]\s+[\p{L}\p{N}_]", r"#+\s*introduction\b", r"#+\s*introdu[cç][aã]o\b", r"cap[ií]tulo\s+1\b", r"chapter\s+1\b", r"introduction\b", r"introdu[cç][aã]o\b")
_OPENERS = ("# Introdução", "#### CHAPTER 1", "# 1) Foo", "# 1.", "  Introduction", "Capítulo  1", "Chapters 1", "## 1. Uma", "introducao")


@query(rf"""
SELECT doc_id, min(line_no)::INT AS start_line FROM (SELECT doc_id, line_no, CASE WHEN line_no = doc_id % 3 THEN [{", ".join(f"'{x}'" for x in _OPENERS)}][doc_id % 9 + 1] || E'\n' || line ELSE line END AS t FROM ({_LINES}))
WHERE {" OR ".join(f"regexp_matches(substr(t, 1, 1200), '(?im)^{chr(92)}s*{p}')" for p in _START_SQL)} GROUP BY doc_id""")
def q_content_start(spark, sf):
    opener = F.element_at(F.array(*map(F.lit, _OPENERS)), (F.col("doc_id") % 9 + 1).cast("int"))
    t = F.when(F.col("line_no") == F.col("doc_id") % 3, F.concat(opener, F.lit("\n"), "line")).otherwise(F.col("line"))
    return _lines(spark, sf).where(paging.is_content_start(t)).groupBy("doc_id").agg(F.min("line_no").alias("start_line"))


# --- citations -------------------------------------------------------------------------------------------------


def _works(spark, sf):
    """Orders as works, customers as authors."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    name = F.concat(F.lit("Ana Maria "), F.regexp_replace("c_name", "[^A-Za-z]", ""), F.lit(" Silva"), F.col("c_nationkey").cast("string"))
    more = F.when(F.col("o_orderkey") % 3 == 0, F.array(name, F.lit("Rui Costa"))).when(F.col("o_orderkey") % 3 == 1, F.array(name)).otherwise(F.array(name, F.lit("Rui Costa"), F.lit("Eva Luz"), F.lit("Plato")))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", more.alias("authors"), F.year("o_orderdate").alias("year"), F.concat(F.lit("the "), F.lower("o_orderpriority"), F.lit(" study of things")).alias("title"))


_WORKS = """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN [n, 'Rui Costa'] WHEN o_orderkey % 3 = 1 THEN [n] ELSE [n, 'Rui Costa', 'Eva Luz', 'Plato'] END AS authors, year, title
FROM (SELECT o_orderkey, 'Ana Maria ' || regexp_replace(c_name, '[^A-Za-z]', '', 'g') || ' Silva' || c_nationkey::VARCHAR AS n, year(o_orderdate)::INT AS year, 'the ' || lower(o_orderpriority) || ' study of things' AS title FROM orders JOIN customer ON o_custkey = c_custkey)"""
_CAP = "upper(substr({w}, 1, 1)) || lower(substr({w}, 2))"


@query(rf"""
WITH w AS ({_WORKS}), b AS (SELECT o_orderkey, list_filter(list_transform(regexp_split_to_array(trim(title), '\s+'), lambda x: {_CAP.format(w="regexp_replace(x, '[^\\p{L}\\p{N}_]', '', 'g')")}), lambda x: x <> '') AS t,
 regexp_split_to_array(trim(authors[1]), '\s+')[-1] AS s, year FROM w),
k AS (SELECT o_orderkey, {_CAP.format(w="s")} || year::VARCHAR || array_to_string(t[1:2], '') AS base FROM b),
r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY o_orderkey) AS nth FROM k)
SELECT o_orderkey, base || CASE WHEN nth <= 1 THEN '' WHEN nth <= 27 THEN chr((97 + nth - 2)::INT) ELSE chr((96 + (nth - 2) // 26)::INT) || chr((97 + (nth - 2) % 26)::INT) END AS citekey FROM r""")
def q_citekey(spark, sf):
    w = _works(spark, sf).select("o_orderkey", biblio.citekey_base(F.col("authors"), F.col("year"), F.col("title")).alias("base"))
    return review.numbered_keys(w, "base", "o_orderkey").select("o_orderkey", F.concat("base", biblio.suffix(F.col("nth"))).alias("citekey"))


_INV = r"CASE WHEN len(regexp_split_to_array(trim({a}), '\s+')) > 1 THEN upper(regexp_split_to_array(trim({a}), '\s+')[-1]) || ', ' || array_to_string(regexp_split_to_array(trim({a}), '\s+')[1:-2], ' ') ELSE upper(trim({a})) END"
_AUTH = f"CASE WHEN len(authors) > 3 THEN {_INV.format(a='authors[1]')} || ' et al.' ELSE array_to_string(list_transform(authors, lambda a: {_INV.format(a='a')}), '; ') END"


@query(rf"""
WITH w AS ({_WORKS})
SELECT o_orderkey, '(' || CASE WHEN len(authors) > 3 THEN upper(regexp_split_to_array(trim(authors[1]), '\s+')[-1]) || ' et al.' ELSE array_to_string(list_transform(authors, lambda a: upper(regexp_split_to_array(trim(a), '\s+')[-1])), '; ') END || ', ' || year::VARCHAR || ')' AS cite,
 CASE WHEN len(authors) = 1 THEN authors[1] WHEN len(authors) = 2 THEN authors[1] || ' e ' || authors[2] ELSE authors[1] || ' et al.' END AS natural_name FROM w""")
def q_citation(spark, sf):
    a, y = F.col("authors"), F.col("year")
    return _works(spark, sf).select("o_orderkey", biblio.in_text(a, y).alias("cite"), biblio.natural(a).alias("natural_name"))


@query(rf"""
WITH w AS ({_WORKS})
SELECT o_orderkey, {_AUTH} || '. ' || title || '. Lisboa: Casa, ' || year::VARCHAR || '.' AS livro,
 replace(replace({_AUTH} || '. ' || title || '. Revista, v. 3, p. 1-9, ' || year::VARCHAR || '. DOI: 10.1/x.', ' ,', ','), '..', '.') AS artigo,
 {_AUTH} || '. ' || title || '. ' || year::VARCHAR || '. Tese — Univ, Porto, ' || year::VARCHAR || '.' AS tese,
 {_AUTH} || '. ' || title || '. Site, ' || year::VARCHAR || '. Disponivel em: http://x.org. Acesso em: 05 mar. 2024.' AS internet FROM w""")
def q_reference(spark, sf):
    m = {"authors": F.col("authors"), "title": F.col("title"), "year": F.col("year")}
    lit = lambda **k: {n: F.lit(v) for n, v in k.items()}
    return _works(spark, sf).select(
        "o_orderkey",
        biblio.reference("livro", m | lit(place="Lisboa", publisher="Casa")).alias("livro"),
        biblio.reference("artigo_periodico", m | lit(journal="Revista", volume="3", pages="1-9", doi="10.1/x")).alias("artigo"),
        biblio.reference("tese", m | lit(institution="Univ", place="Porto")).alias("tese"),
        biblio.reference("artigo_internet", m | lit(site="Site", url="http://x.org", accessed_at="2024-03-05")).alias("internet"),
    )


_SAMPLE = "CASE doc_id % 9 WHEN 0 THEN 'Tese (doutorado) ' WHEN 1 THEN 'Plano de aula ' WHEN 2 THEN 'Anais do congresso ' WHEN 3 THEN 'Texto. In: livro ' WHEN 4 THEN 'Revista X vol. 2 ' WHEN 5 THEN 'see http://x.org ' WHEN 6 THEN 'Technical report ' ELSE '' END || text"


@query(rf"""
WITH s AS (SELECT doc_id, lower(substr({_SAMPLE}, 1, 5000)) AS s, doc_id % 9 = 5 AS has_url, lang = 'en' AS who FROM documents),
k AS (SELECT doc_id, who, CASE WHEN contains(s, 'tese (') OR contains(s, 'disserta') OR contains(s, 'trabalho de conclus') THEN 'tese'
 WHEN contains(s, 'disciplina') OR contains(s, 'plano de aula') OR contains(s, 'material did') THEN 'material_curso'
 WHEN contains(s, 'anais') OR contains(s, 'congresso') OR contains(s, 'simpósio') OR contains(s, 'simposio') OR contains(s, 'proceedings') THEN 'anais_evento'
 WHEN regexp_matches(s, '\bin:\s') OR contains(s, 'capítulo') OR contains(s, 'capitulo') THEN 'capitulo_livro'
 WHEN contains(s, 'revista') OR contains(s, 'journal') OR contains(s, 'vol.') OR contains(s, 'v. ') OR contains(s, 'n. ') OR contains(s, 'doi:') THEN 'artigo_periodico'
 WHEN has_url AND contains(substr(s, 1, 500), 'http') THEN 'artigo_internet'
 WHEN contains(s, 'relatório') OR contains(s, 'relatorio tecnico') OR contains(s, 'technical report') THEN 'relatorio' ELSE 'livro' END AS document_type FROM s)
SELECT doc_id, document_type, CASE document_type WHEN 'tese' THEN 0.55 WHEN 'capitulo_livro' THEN 0.45 WHEN 'relatorio' THEN 0.45 WHEN 'livro' THEN CASE WHEN who THEN 0.4 ELSE 0.3 END ELSE 0.5 END::DOUBLE AS confidence FROM k""")
def q_doc_type_infer(spark, sf):
    k = F.col("doc_id") % 9
    heads = ("Tese (doutorado) ", "Plano de aula ", "Anais do congresso ", "Texto. In: livro ", "Revista X vol. 2 ", "see http://x.org ", "Technical report ")
    head = F.when(k == 0, heads[0])
    for i, h in enumerate(heads[1:], 1):
        head = head.when(k == i, h)
    kind, conf = biblio.document_type(F.concat(head.otherwise(""), "text"), F.lit("file.pdf"), k == 5, F.col("lang") == "en", F.lit(True))
    return table(spark, sf, "documents").select("doc_id", kind.alias("document_type"), conf.alias("confidence"))


@query("""
SELECT o_orderkey, kind, array_to_string(list_filter(need, lambda f: NOT (f = 'title' OR (f = 'year' AND o_orderkey % 2 = 0) OR (f = 'authors' AND o_orderkey % 3 = 0))), ',') AS missing FROM (
 SELECT o_orderkey, kind, string_split(CASE kind WHEN 'livro' THEN 'authors title place publisher year' WHEN 'tese' THEN 'authors title year institution degree' WHEN 'relatorio' THEN 'title year institution' ELSE 'document_type' END, ' ') AS need
 FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'livro' WHEN 1 THEN 'tese' WHEN 2 THEN 'relatorio' ELSE 'outro' END AS kind FROM orders))""")
def q_required_fields(spark, sf):
    k = F.col("o_orderkey")
    kind = F.when(k % 4 == 0, "livro").when(k % 4 == 1, "tese").when(k % 4 == 2, "relatorio").otherwise("outro")
    fields = F.create_map(F.lit("title"), F.lit("t"), F.lit("year"), F.when(k % 2 == 0, "1999").otherwise(""), F.lit("authors"), F.when(k % 3 == 0, "A"))
    return table(spark, sf, "orders").select("o_orderkey", kind.alias("kind"), F.array_join(biblio.missing_fields(kind, fields), ",").alias("missing"))


@query(rf"""
SELECT doc_id, len(l)::INT AS n_links, array_to_string(l, ',') AS links, array_to_string(list_filter(list_transform(string_split(regexp_extract(b, '<!--\s*cites:\s*([^>]*?)\s*-->', 1), ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS cites FROM (
 SELECT doc_id, b, regexp_extract_all(b, '\[\[[^\]]*?PERM-([0-9A-HJKMNP-TV-Z]{{26}})', 1) AS l FROM (
  SELECT doc_id, 'x [[10/PERM-' || '01ABCDEFGHJKMNPQRSTVWXYZ' || lpad((doc_id % 90)::VARCHAR, 2, '0') || '-a|t]] y ' || CASE WHEN doc_id % 2 = 0 THEN '[[PERM-01ABCDEFGHJKMNPQRSTVWXYZ77]]' ELSE '[[PERM-lower]]' END || ' <!-- cites: a' || doc_id::VARCHAR || ', b -->' AS b FROM documents))""")
def q_wikilinks(spark, sf):
    i = F.col("doc_id")
    body = F.concat(F.lit("x [[10/PERM-01ABCDEFGHJKMNPQRSTVWXYZ"), F.lpad((i % 90).cast("string"), 2, "0"), F.lit("-a|t]] y "), F.when(i % 2 == 0, "[[PERM-01ABCDEFGHJKMNPQRSTVWXYZ77]]").otherwise("[[PERM-lower]]"), F.lit(" <!-- cites: a"), i.cast("string"), F.lit(", b -->"))
    links = tx.wikilinks(body)
    return table(spark, sf, "documents").select("doc_id", F.size(links).alias("n_links"), F.array_join(links, ",").alias("links"), F.array_join(tx.cited_ids(body), "|").alias("cites"))


_MAP = "concat('before', chr(10), '# Map ', doc_id::VARCHAR, chr(10), 'About ', lang, '.', chr(10), '## In ', coalesce(source, ''), ' ', chr(10), 'Some ', chr(10), '- [[NOTE - A', doc_id::VARCHAR, ' - x]] and [[NOTE - Z - y]]', chr(10), '- plain', chr(10), 'prose', chr(10), CASE WHEN doc_id % 2 = 0 THEN concat('## Second', chr(10), '- [[NOTE-B', doc_id::VARCHAR, '-t]]', chr(10), '# Again', chr(10), 'tail') ELSE '' END)"


@query(rf"""WITH b AS (SELECT doc_id, string_split({_MAP}, chr(10)) AS lines FROM documents), l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS k FROM b),
m AS (SELECT *, coalesce(max(CASE WHEN starts_with(line, '# ') THEN k END) OVER w, 0) AS h1, coalesce(max(CASE WHEN starts_with(line, '## ') THEN k END) OVER w, 0) AS h2, regexp_extract(line, '\[\[[A-Z]+\s*-\s*(\S+)\s*-\s*[^\]]*\]\]', 1) AS note FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY k))
SELECT doc_id, trim(coalesce(string_agg(CASE WHEN h1 > h2 AND k > h1 THEN line END, chr(10) ORDER BY k), ''), chr(10) || ' ') AS summary, string_agg(CASE WHEN k = h2 THEN trim(line[4:]) END, '|' ORDER BY k) AS titles,
string_agg(CASE WHEN h2 > h1 AND k > h2 AND note = '' AND trim(line) <> '' AND NOT starts_with(trim(line), '-') THEN trim(line) END, ' ' ORDER BY k) AS descriptions, string_agg(CASE WHEN h2 > h1 AND k > h2 AND note <> '' THEN note END, ',' ORDER BY k) AS note_ids FROM m GROUP BY doc_id""")
def q_map_structure(spark, sf):
    i = F.col("doc_id").cast("string")
    second = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("## Second\n- [[NOTE-B"), i, F.lit("-t]]\n# Again\ntail"))).otherwise("")
    body = F.concat(F.lit("before\n# Map "), i, F.lit("\nAbout "), F.coalesce("lang", F.lit("")), F.lit(".\n## In "), F.coalesce("source", F.lit("")), F.lit(" \nSome \n- [[NOTE - A"), i, F.lit(" - x]] and [[NOTE - Z - y]]\n- plain\nprose\n"), second)
    of = table(spark, sf, "documents").select("doc_id", tx.map_summary(body).alias("summary"), tx.map_sections(body).alias("s"))
    return of.select("doc_id", "summary", F.array_join("s.title", "|").alias("titles"), F.array_join(F.filter("s.description", lambda x: x != ""), " ").alias("descriptions"), F.array_join(F.flatten("s.note_ids"), ",").alias("note_ids"))
