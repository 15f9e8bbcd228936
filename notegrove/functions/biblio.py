"""Citation keys, author names, references and document types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fields a document type needs to be complete.
REQUIRED = {
    "livro": ("authors", "title", "place", "publisher", "year"),
    "capitulo_livro": ("chapter_authors", "chapter_title", "book_title", "place", "publisher", "year", "pages"),
    "artigo_periodico": ("authors", "title", "journal", "year"),
    "artigo_internet": ("title", "url", "accessed_at"),
    "material_curso": ("title", "institution"),
    "tese": ("authors", "title", "year", "institution", "degree"),
    "anais_evento": ("authors", "title", "event_name", "year", "place"),
    "relatorio": ("title", "year", "institution"),
}
#: Month abbreviations.
MONTHS = ("jan.", "fev.", "mar.", "abr.", "maio", "jun.", "jul.", "ago.", "set.", "out.", "nov.", "dez.")
YEAR = r"\b((?:19|20)\d\d)\b"


def year_of(text: Column) -> Column:
    got = F.regexp_extract(text, YEAR, 1)
    return F.when(got != "", got.cast("int"))


def pdf_year(date: Column) -> Column:
    got = F.regexp_extract(date, r"^D:(\d{4})", 1)
    return F.when(got != "", got.cast("int"))


def _capitalized(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(word.substr(F.lit(2), F.length(word))))


def _clean(word: Column) -> Column:
    return F.regexp_replace(word, r"[^\p{L}\p{N}_]", "")


def surname(name: Column) -> Column:
    return F.element_at(F.split(F.btrim(name), r"\s+"), -1)


def citekey_base(authors: Column, year: Column, title: Column) -> Column:
    """Surname, year and the title's first words, by what is known."""
    has_author, has_year = F.coalesce(F.size(authors) > 0, F.lit(False)), year.isNotNull()
    words = F.filter(F.transform(F.split(F.btrim(F.coalesce(title, F.lit(""))), r"\s+"), lambda w: _capitalized(_clean(w))), lambda w: w != "")
    n = F.when(has_author & has_year, 2).when(has_author | has_year, 3).otherwise(4)
    head = F.array_join(F.slice(words, F.lit(1), n), "")
    head = F.when(head == "", "Untitled").otherwise(head)
    return F.concat(F.when(has_author, _capitalized(_clean(surname(F.get(authors, F.lit(0)))))).otherwise(""), F.when(has_year, year.cast("string")).otherwise(""), head)


def suffix(nth: Column) -> Column:
    """Nothing for the first, then a, b, c and so on, two characters after z. The first of the two goes on beyond z by code point, so
    every place has its own suffix."""
    k = nth - 2
    # Spark's chr keeps the lower 8 bits only; the mark before the text is what a decoder takes away
    code = lambda x: F.lpad(F.hex(x.cast("long")), 8, "0")
    two = F.decode(F.unhex(F.concat(F.lit("0000FEFF"), code(F.lit(96) + F.floor(k / 26)), code(F.lit(97) + k % 26))), "UTF-32")
    return F.when(nth <= 1, "").when(nth <= 27, F.chr(F.lit(97) + k)).otherwise(two)


def inverted(name: Column) -> Column:
    """``SURNAME, Given``; a single name in capitals."""
    parts = F.split(F.btrim(name), r"\s+")
    given = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), " ")
    return F.when(F.size(parts) > 1, F.concat(F.upper(F.element_at(parts, -1)), F.lit(", "), given)).otherwise(F.upper(F.element_at(parts, -1)))


def author_list(authors: Column) -> Column:
    """Up to three inverted names; more than three: the first and et al."""
    return F.when(F.size(authors) > 3, F.concat(inverted(F.get(authors, F.lit(0))), F.lit(" et al."))).otherwise(F.array_join(F.transform(authors, inverted), "; "))


def in_text(authors: Column, year: Column) -> Column:
    """(SURNAME; SURNAME, year), et al. beyond three; empty without author and year."""
    n = F.size(authors)
    names = F.when(n > 3, F.concat(F.upper(surname(F.get(authors, F.lit(0)))), F.lit(" et al."))).otherwise(F.array_join(F.transform(authors, lambda a: F.upper(surname(a))), "; "))
    body = F.concat_ws(", ", F.when(n > 0, names), year.cast("string"))
    return F.when(body == "", "").otherwise(F.concat(F.lit("("), body, F.lit(")")))


def natural(authors: Column) -> Column:
    """One name, two joined by ``e``, or et al."""
    first, second = (F.get(authors, F.lit(i)) for i in (0, 1))
    n = F.size(authors)
    return F.when(n == 1, first).when(n == 2, F.concat(first, F.lit(" e "), second)).when(n > 2, F.concat(first, F.lit(" et al."))).otherwise("")


def accessed(date: Column) -> Column:
    """ISO and D/M/Y dates as ``DD mon YYYY``; anything else as it is."""
    months = F.array(*map(F.lit, MONTHS))
    iso = date.rlike(r"^\d{4}-\d{2}-\d{2}")
    dmy = date.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$")
    form = lambda d, m, y: F.concat(F.lpad(d, 2, "0"), F.lit(" "), F.element_at(months, m.cast("int")), F.lit(" "), y)
    i = [F.regexp_extract(date, r"^(\d{4})-(\d{2})-(\d{2})", k) for k in (3, 2, 1)]
    d = [F.regexp_extract(date, r"^(\d{1,2})/(\d{1,2})/(\d{4})$", k) for k in (1, 2, 3)]
    return F.when(iso, form(*i)).when(dmy, form(*d)).otherwise(date)


def _end(x: Column) -> Column:
    return F.when(F.coalesce(x, F.lit("")) != "", F.concat(x, F.lit(".")))


def _label(before: str, x: Column, after: str = ".") -> Column:
    return F.when(F.coalesce(x.cast("string"), F.lit("")) != "", F.concat(F.lit(before), x.cast("string"), F.lit(after)))


def reference(kind: str, m: dict[str, Column]) -> Column:
    """The reference of a document type from its fields; missing ones (null or absent) leave out their part."""
    none = F.lit(None).cast("string")
    g = lambda k: m.get(k, none)
    authors = _end(author_list(m["authors"])) if "authors" in m else none
    title = F.concat(g("title"), F.coalesce(F.concat(F.lit(": "), g("subtitle")), F.lit("")), F.lit("."))
    year = g("year").cast("string")
    link, seen = _label("Disponivel em: ", g("url")), _label("Acesso em: ", accessed(g("accessed_at")))
    place = lambda a, b: F.when(a.isNotNull() | b.isNotNull(), F.concat_ws(": ", a, b))
    out = {
        "livro": [authors, title, _label("Traducao: ", g("translator")), _label("", g("edition"), " ed."), _end(F.concat_ws(", ", place(g("place"), g("publisher")), year))],
        "capitulo_livro": [_end(author_list(m["chapter_authors"])) if "chapter_authors" in m else authors, _end(g("chapter_title")), F.lit("In:"), F.when(F.coalesce(g("editors"), F.lit("")) != "", F.concat(g("editors"), F.lit(" (org.)."))), _end(g("book_title")), _label("", g("edition"), " ed."), _end(F.concat_ws(", ", place(g("place"), g("publisher")), year)), _label("p. ", g("pages"))],
        "artigo_periodico": [authors, title, _end(F.concat_ws(", ", g("journal"), g("place"), _label("v. ", g("volume"), ""), _label("n. ", g("issue"), ""), _label("p. ", g("pages"), ""), year)), _label("DOI: ", g("doi"))],
        "artigo_internet": [authors, title, _end(F.concat_ws(", ", g("site"), F.coalesce(year, g("published_at")))), link, seen],
        "material_curso": [authors, title, _end(F.concat_ws(" — ", g("discipline"), g("course"))), _end(F.concat_ws(", ", g("institution"), g("place"), year)), link, seen],
        "tese": [authors, title, _end(year), _end(F.concat_ws(" — ", F.coalesce(g("degree"), F.lit("Tese")), F.concat_ws(", ", g("institution"), g("place"), year))), _label("Orientacao: ", g("advisor")), _label("", g("total_pages"), " p.")],
        "anais_evento": [authors, title, F.lit("In:"), _end(F.concat_ws(", ", g("event_name"), year, g("place"))), _end(F.concat_ws(", ", g("publisher"), F.when(g("publisher").isNotNull(), year))), _label("p. ", g("pages"))],
        "relatorio": [authors, title, _label("Relatorio ", g("number")), _end(F.concat_ws(", ", place(g("place"), g("institution")), year)), link],
    }[kind]
    text = F.concat_ws(" ", *out)
    return F.replace(F.replace(text, F.lit(" ,"), F.lit(",")), F.lit(".."), F.lit(".")) if kind == "artigo_periodico" else text


def document_type(sample: Column, name: Column, has_url: Column, has_author: Column, has_year: Column, declared: Column | None = None) -> tuple[Column, Column]:
    """(type, confidence) by ordered keyword rules; a declared type that is known wins."""
    s, n = F.lower(F.substring(sample, 1, 5000)), F.lower(name)
    any_of = lambda x, *keys: _or([x.contains(k) for k in keys])
    # fixed values: the key words of each type and its confidence, in order
    rules = [
        ("tese", 0.55, any_of(s, "tese (", "disserta", "trabalho de conclus") | any_of(n, "tese")),
        ("material_curso", 0.5, any_of(s, "disciplina", "plano de aula", "material did") | any_of(n, "aula", "curso", "disciplina")),
        ("anais_evento", 0.5, any_of(s, "anais", "congresso", "simpósio", "simposio", "proceedings")),
        ("capitulo_livro", 0.45, s.rlike(r"\bin:\s") | any_of(s, "capítulo", "capitulo")),
        ("artigo_periodico", 0.5, any_of(s, "revista", "journal", "vol.", "v. ", "n. ", "doi:")),
        ("artigo_internet", 0.5, has_url & (n.contains(".html") | F.substring(s, 1, 500).contains("http"))),
        ("relatorio", 0.45, any_of(s, "relatório", "relatorio tecnico", "technical report")),
    ]
    kind, conf = F.when(rules[0][2], rules[0][0]), F.when(rules[0][2], rules[0][1])
    for k, c, rule in rules[1:]:
        kind, conf = kind.when(rule, k), conf.when(rule, c)
    kind, conf = kind.otherwise("livro"), conf.otherwise(F.when(has_author & has_year, 0.4).otherwise(0.3))
    if declared is not None:
        known = F.coalesce(declared.isin(list(REQUIRED)), F.lit(False))
        kind, conf = F.when(known, declared).otherwise(kind), F.when(known, F.greatest(conf, F.lit(0.85))).otherwise(conf)
    return kind, conf


def _or(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def missing_fields(kind: Column, fields: Column) -> Column:
    """Required fields that a map of fields lacks; ``document_type`` for an unknown type."""
    need = F.create_map(*[x for k, v in REQUIRED.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    lacking = F.filter(need[kind], lambda f: F.coalesce(fields[f], F.lit("")) == "")
    return F.coalesce(lacking, F.array(F.lit("document_type")))


def merged(seed: Column, found: Column) -> Column:
    """Field-wise merge of maps: what was found and is not blank wins."""
    return F.map_zip_with(seed, found, lambda _, a, b: F.when(F.trim(F.coalesce(b, F.lit(""))) != "", b).otherwise(a))


def merged_confidence(seed: Column, found: Column, kind: Column, fields: Column) -> Column:
    """The higher of both confidences; at least 0.85 if the type's required fields are there, 0.6 if only the type is."""
    best = F.greatest(seed, F.coalesce(found, F.lit(0.0)))
    lacking = F.size(missing_fields(kind, fields))
    return F.when(kind.isNull(), best).when(lacking == 0, F.greatest(best, F.lit(0.85))).otherwise(F.greatest(best, F.lit(0.6)))


def complete(kind: Column, confidence: Column, fields: Column, least: float = 0.7) -> Column:
    """A known type, enough confidence and no required field missing."""
    return F.coalesce(kind.isin(list(REQUIRED)) & (confidence >= least) & (F.size(missing_fields(kind, fields)) == 0), F.lit(False))


def filled(fields: Column) -> Column:
    """The fields of a map that are not blank."""
    return F.map_filter(fields, lambda _, v: F.trim(F.coalesce(v, F.lit(""))) != "")


def primary(kind: Column, fields: Column, name: str, fallback: str = "") -> Column:
    """Title or authors of a work: those of the chapter where it is one and has them."""
    own = F.when((kind == "capitulo_livro") & (F.coalesce(fields[f"chapter_{name}"], F.lit("")) != ""), fields[f"chapter_{name}"])
    rest = F.trim(F.coalesce(fields[name], F.lit("")))
    return F.coalesce(own, F.when(rest != "", rest), F.lit(fallback))


def shown_fields(fields: Column) -> Column:
    """Filled fields that a note shows beside its type, title, authors and year, which it writes itself."""
    return F.map_filter(filled(fields), lambda k, _: ~k.isin("document_type", "title", "authors", "year"))
