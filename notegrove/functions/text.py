"""Text functions as column expressions; all stay in the JVM unless said otherwise."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Query stopwords, unaccented as they are compared.
STOPWORDS = (
    "a", "o", "as", "os", "um", "uma", "uns", "umas",
    "de", "da", "do", "das", "dos", "em", "na", "no", "nas", "nos",
    "por", "para", "com", "sem", "sobre", "entre", "ate", "apos",
    "e", "ou", "mas", "que", "se", "como", "quando", "onde", "porque", "pois",
    "eu", "tu", "ele", "ela", "voces", "eles", "elas",
    "seu", "sua", "seus", "suas", "este", "esta", "esse", "essa", "isso",
    "aquele", "aquela", "aquilo",
    "sao", "foi", "foram", "ser", "estar", "estao", "tem", "teve", "ha",
    "nao", "sim", "mais", "muito", "muitos", "muitas",
    "ja", "ainda", "tambem", "qual", "quais",
)
WORD = r"[\p{L}\p{N}_]"
#: Markers of English text.
ENGLISH = ("the ", "and ", "this ", "that ", "with ", "from ", "which ", "where ")
#: Relation types with the label of their inverse.
INVERSE = {"supports": "suportado por", "contradicts": "contradiz", "extends": "estendido por", "depends_on": "base para", "exemplifies": "exemplificado por", "related": "relacionado"}
#: The prefix of managed-block marks; any lower-case word is read.
MARK = "[a-z]+"
_BLANK = " \t\n\r\f\v"


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility composition; no built-in has it."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def _accents() -> tuple[str, str]:
    """Small letters with marks and the letters below them, by canonical decomposition, then combining marks, which have none."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x2000)) if unicodedata.normalize("NFD", chr(c))[1:]]
    pairs = [(x, y) for x, y in pairs if x == x.lower()]
    return "".join(x for x, _ in pairs) + "".join(map(chr, range(0x300, 0x370))), "".join(y for _, y in pairs)


_MARKED, _PLAIN = _accents()


def fold_diacritics(text: Column) -> Column:
    """Lower case without marks on Latin and Greek letters, and without combining marks; in the JVM."""
    return F.translate(F.lower(text), _MARKED, _PLAIN)


def normalize(text: Column, compose: bool = False) -> Column:
    """Canonical form for hashing: line ends, blanks, blank lines and hyphenated line breaks. compose: with
    NFKC first, which costs a Python pass."""
    x = nfkc(text) if compose else text
    for pattern, to in ((r"\r\n?", "\n"), (r"[ \t]+", " "), (r" *\n *", "\n"), (r"\n{3,}", "\n\n"), (rf"({WORD})-\n({WORD})", "$1$2")):
        x = F.regexp_replace(x, pattern, to)
    return F.btrim(x, F.lit(_BLANK))


def digest(*parts: Column) -> Column:
    """sha256 of the parts joined by a bar."""
    return F.sha2(F.concat_ws("|", *parts), 256)


def short(hex_digest: Column, n: int = 8) -> Column:
    return F.substring(hex_digest, 1, n)


def embeddable(body: Column) -> Column:
    """Text to embed: without frontmatter at the very start and without managed blocks; a block that is not
    closed runs to the end."""
    x = F.regexp_replace(body, r"(?s)\A---\n.*?\n---\n?", "")
    x = F.regexp_replace(x, rf"(?s)<!-- {MARK}:auto-[a-z-]+:start -->.*?<!-- {MARK}:auto-[a-z-]+:end -->\n?", "")
    x = F.regexp_replace(x, rf"(?s)<!-- {MARK}:auto-[a-z-]+:start -->.*", "")
    return normalize(x)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(rf"({WORD}+)"), F.lit(1))


def folded_tokens(text: Column) -> Column:
    """Tokens as the search index has them: without diacritics."""
    return F.regexp_extract_all(fold_diacritics(text), F.lit(rf"({WORD}+)"), F.lit(1))


def query_tokens(text: Column, least: int = 2, most: int = 32) -> Column:
    """Tokens of a query: long enough, no stopwords, the first ``most``."""
    stop = F.array(*map(F.lit, STOPWORDS))
    return F.slice(F.filter(tokens(text), lambda t: (F.length(t) >= least) & ~F.array_contains(stop, t)), 1, most)


def match_expression(text: Column, least: int = 2, most: int = 32) -> Column:
    """Quoted tokens joined by OR; null without tokens."""
    t = query_tokens(text, least, most)
    return F.when(F.size(t) > 0, F.array_join(F.transform(t, lambda x: F.concat(F.lit('"'), x, F.lit('"'))), " OR "))


def slug(text: Column, most: int = 50) -> Column:
    x = F.btrim(F.lower(text), F.lit(_BLANK))
    x = F.regexp_replace(x, rf"[^\p{{L}}\p{{N}}_\s-]", "")
    return F.rtrim(F.substring(F.regexp_replace(x, r"[\s_]+", "-"), 1, most), F.lit("-"))


def note_filename(prefix: Column, identifier: Column, title: Column) -> Column:
    """Source notes leave the identifier out."""
    return F.when(prefix == "SRC", F.concat(prefix, F.lit("-"), slug(title), F.lit(".md"))).otherwise(F.concat(prefix, F.lit("-"), identifier, F.lit("-"), slug(title), F.lit(".md")))


def chunk_filename(index: Column, draft: bool) -> Column:
    return F.concat(F.lit("draft-" if draft else "chunk-"), F.lpad(index.cast("string"), 4, "0"), F.lit(".md"))


def clip(text: Column, most: int = 72) -> Column:
    """One line, cut to ``most`` with three dots."""
    x = F.btrim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, most - 3), F.lit("..."))).otherwise(x)


def json_payload(text: Column) -> Column:
    """The JSON in a model's answer: a fenced block, else the whole text, else from the first { to the last }."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*\n?(.*?)```", 1)
    bare = F.btrim(text, F.lit(_BLANK))
    span = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(fenced != "", F.btrim(fenced, F.lit(_BLANK))).when(bare.rlike(r"^[\[{]"), bare).when(span != "", span)


def read_block(body: Column, name: str) -> Column:
    """Inner text of a managed block, trimmed; null without one."""
    got = F.regexp_extract(body, rf"(?s)<!-- {MARK}:{name}:start -->(.*?)<!-- {MARK}:{name}:end -->", 1)
    return F.when(body.rlike(rf"<!-- {MARK}:{name}:start -->"), F.btrim(got, F.lit(_BLANK)))


def put_block(body: Column, name: str, inner: Column, prefix: str = "note") -> Column:
    """Replaces a managed block of this prefix, or appends it."""
    start, end = f"<!-- {prefix}:{name}:start -->", f"<!-- {prefix}:{name}:end -->"
    block = F.concat(F.lit(start + "\n"), inner, F.lit("\n" + end))
    at, stop = F.instr(body, start), F.instr(body, end)
    return F.when((at > 0) & (stop > at), F.concat(body.substr(F.lit(1), at - 1), block, body.substr(stop + len(end), F.length(body)))).otherwise(F.concat(F.rtrim(body, F.lit(_BLANK)), F.lit("\n\n"), block, F.lit("\n")))


def strip_blocks(body: Column, names: tuple[str, ...] = ("auto-backlinks", "auto-connections")) -> Column:
    for n in names:
        body = F.regexp_replace(body, rf"(?s)<!-- {MARK}:{n}:start -->.*?<!-- {MARK}:{n}:end -->", "")
    return body


def wikilinks(body: Column) -> Column:
    """Ids of permanent notes that a body links to, in order."""
    return F.regexp_extract_all(body, F.lit(r"\[\[[^\]]*?PERM-([0-9A-HJKMNP-TV-Z]{26})"), F.lit(1))


def _map_parts(body: Column) -> Column:
    """The lines of what stands before the first second-level heading, and of each section with its heading first."""
    return F.transform(F.split(body, r"(?:^|\n)## "), lambda x: F.split(x, "\n"))


def _until_title(lines: Column) -> Column:
    """How many lines come before the first top-level heading."""
    at = F.array_position(F.transform(lines, lambda x: x.startswith("# ")), True)
    return F.when(at > 0, at - 1).otherwise(F.size(lines)).cast("int")


def map_summary(body: Column) -> Column:
    """The lines between a top-level heading of a map and its next section."""
    after = F.transform(_map_parts(body), lambda x: F.filter(F.slice(x, _until_title(x) + 1, F.size(x)), lambda y: ~y.startswith("# ")))
    return F.btrim(F.array_join(F.flatten(after), "\n"), F.lit(_BLANK))


def map_sections(body: Column, link: str = r"\[\[[A-Z]+\s*-\s*(\S+)\s*-\s*[^\]]*\]\]") -> Column:
    """(title, description, note_ids) of each section of a map, in order: the first link of a line is a note, other
    lines that are no list items make the description. A row's own text only, so nothing is shuffled."""

    def section(lines: Column) -> Column:
        own = F.slice(lines, 2, F.greatest(_until_title(lines) - 1, F.lit(0)))
        prose = F.transform(F.filter(own, lambda x: ~x.rlike(link)), lambda x: F.btrim(x, F.lit(_BLANK)))
        ids = F.filter(F.transform(own, lambda x: F.regexp_extract(x, link, 1)), lambda x: x != "")
        text = F.array_join(F.filter(prose, lambda x: (x != "") & ~x.startswith("-")), " ")
        return F.struct(F.btrim(F.element_at(lines, 1), F.lit(_BLANK)).alias("title"), text.alias("description"), ids.alias("note_ids"))

    parts = _map_parts(body)
    return F.transform(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), section)


def figure_paths(body: Column) -> Column:
    return F.regexp_extract_all(body, F.lit(r"!\[\[(90_Assets/[^\]|]+)"), F.lit(1))


def cited_ids(body: Column) -> Column:
    """Ids of the first cites comment."""
    got = F.regexp_extract(body, r"<!--\s*cites:\s*([^>]*?)\s*-->", 1)
    return F.filter(F.transform(F.split(got, ","), lambda x: F.trim(x)), lambda x: x != "")


def snippet(text: Column, at: Column, radius: int = 200) -> Column:
    return F.btrim(F.regexp_replace(text.substr(F.greatest(at - radius, F.lit(1)), F.lit(2 * radius)), r"\s+", " "))


def extra_queries(raw: Column) -> Column:
    return F.filter(F.transform(F.split(raw, r"[\n;]"), lambda x: F.btrim(x, F.lit(_BLANK))), lambda x: x != "")


def english_markers(text: Column) -> Column:
    """How many of the markers of English occur."""
    low = F.lower(text)
    return sum((low.contains(m).cast("int") for m in ENGLISH[1:]), low.contains(ENGLISH[0]).cast("int"))


def inverse_relation(relation: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in INVERSE.items() for x in kv])[relation], F.lit("relacionado"))


def origin_label(hop: Column, via: Column) -> Column:
    """``busca`` for a direct hit, else the last relation of the path and the note that it came from."""
    last = F.element_at(via, -1)
    return F.when(hop == 0, "busca").otherwise(F.concat(last["relation_type"], F.lit(" de "), last["from"]))


def progress(kind: Column, step: Column, total: Column) -> Column:
    return F.concat(kind, F.lit(" "), step.cast("string"), F.lit("/"), total.cast("string"))


def word_count(text: Column) -> Column:
    """Runs of anything but white space; 0 for null."""
    x = F.btrim(F.coalesce(text, F.lit("")), F.lit(_BLANK))
    return F.when(x == "", 0).otherwise(F.size(F.split(x, r"\s+"))).cast("int")


def retry_after(message: Column, attempt: Column, most: float = 60.0) -> Column:
    """Seconds to wait: the hint of a message in ms, s or m (at least 0.6), else two to the attempt; capped."""
    n = F.regexp_extract(message, r"(?i)(?:try again in|retry after)\s*([0-9.]+)\s*(ms|s|m)?", 1)
    unit = F.lower(F.regexp_extract(message, r"(?i)(?:try again in|retry after)\s*([0-9.]+)\s*(ms|s|m)?", 2))
    hint = F.expr("1.0d") * F.when(n != "", n.try_cast("double")) * F.when(unit == "ms", 0.001).when(unit == "m", 60.0).otherwise(1.0)
    return F.least(F.lit(most), F.when(hint.isNotNull(), F.greatest(hint, F.lit(0.6))).otherwise(F.pow(F.lit(2.0), attempt)))
