"""The subpackage's queries, and SQL for those that SQL can express."""

from __future__ import annotations

from notegrove.llm.byte_bpe import op12_byte_bpe
from notegrove.llm.conversation_trie import op13_conversation_trie
from notegrove.llm.decontamination import op5_decontamination
from notegrove.llm.kd_clusters import op11_kd_clusters
from notegrove.llm.license_scan import op10_license_scan
from notegrove.llm.mixing import op9_mixing
from notegrove.llm.ngram_join import op2_ngram_join
from notegrove.llm.quality_classifier import op8_quality_classifier
from notegrove.llm.quality_rules import op3_quality_rules
from notegrove.llm.secret_scan import op4_secret_scan
from notegrove.llm.substring_dedup import op6_substring_dedup
from notegrove.llm.token_counts import op1_token_counts
from notegrove.llm.warc_fixity import op7_warc_fixity

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_ngram_join": op2_ngram_join,
    "op3_quality_rules": op3_quality_rules,
    "op4_secret_scan": op4_secret_scan,
    "op5_decontamination": op5_decontamination,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_warc_fixity": op7_warc_fixity,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_mixing": op9_mixing,
    "op10_license_scan": op10_license_scan,
    "op11_kd_clusters": op11_kd_clusters,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_conversation_trie": op13_conversation_trie,
}

_WORDS = r"regexp_extract_all({x}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"regexp_extract_all({x}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_PLAIN = _WORDS.format(x="coalesce(text, '')")



def _kmeans_sql(rounds: int = 5, k: int = 40) -> str:
    """Exact rounds, each a join of all components with those of all centroids."""
    nearest = "SELECT r, arg_min(n, d * {k} + n) AS n, min(d) AS d FROM (SELECT r, n, sum((e.x - c.x) * (e.x - c.x)) AS d FROM e JOIN c{j} c ON e.i = c.i GROUP BY r, n) GROUP BY r"
    parts = [
        """v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS p
            FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64)""",
        "e AS MATERIALIZED (SELECT r, unnest(range(64)) AS i, unnest(p) AS x FROM v)",
        f"c0 AS MATERIALIZED (SELECT n, unnest(range(64)) AS i, unnest(p) AS x FROM (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), p) - 1 AS n, p FROM v WHERE vec_id IS NOT NULL) WHERE n < {k})",
    ]
    for j in range(rounds):
        parts.append(f"a{j} AS MATERIALIZED ({nearest.format(j=j, k=k)})")
        parts.append(f"""c{j + 1} AS MATERIALIZED (SELECT c.n, c.i, coalesce((s.s - ((s.s % s.m) + s.m) % s.m) // s.m, c.x) AS x
            FROM c{j} c LEFT JOIN (SELECT n, i, sum(x)::BIGINT AS s, count(*) AS m FROM e JOIN a{j} a ON a.r = e.r GROUP BY n, i) s ON s.n = c.n AND s.i = c.i)""")
    parts.append(f"z AS MATERIALIZED ({nearest.format(j=rounds, k=k)})")
    return f"""WITH {", ".join(parts)}, h AS (SELECT n, sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY n)
        SELECT vec_id, z.n::INTEGER AS cluster, z.d::BIGINT AS distance, (sum(z.d) OVER (PARTITION BY z.n))::BIGINT AS cluster_inertia, (sum(z.d) OVER ())::BIGINT AS inertia, h AS centroid_sha256
        FROM v JOIN z ON z.r = v.r JOIN h ON h.n = z.n"""


ORACLE_SQL = {
    "op11_kd_clusters": _kmeans_sql(),
    "op13_conversation_trie": rf"""
        WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p, {{'r': coalesce(role, ''), 't': coalesce(text, '')}} AS x FROM conversations WHERE conv_id IS NOT NULL),
        o AS (SELECT c, list(x ORDER BY p) AS s FROM t GROUP BY c),
        -- a crc is a fold: a number from 1000 on is a byte to mix in, 0 a shift by one bit
        k AS (SELECT c, s, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(c::VARCHAR, ''), lambda y: [1000 + ord(y), 0, 0, 0, 0, 0, 0, 0, 0]))),
            lambda a, b: CASE WHEN b >= 1000 THEN xor(a, b - 1000) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) % 4 AS h FROM o),
        r AS (SELECT k.c, list_concat(coalesce(b.s[1:k.h], []), k.s[k.h + 1:]) AS s FROM k LEFT JOIN o b ON b.c = k.c - k.c % 20),
        m AS MATERIALIZED (SELECT c, d, s[1:d] AS g, s[d].t AS t, len(s) = d AS e FROM (SELECT c, s, unnest(range(len(s) + 1)) AS d FROM r)),
        n AS MATERIALIZED (SELECT g, d, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * len(regexp_extract_all(coalesce(any_value(t), ''), '[^ 	-]+')) AS own, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (e) AS ends FROM m GROUP BY g, d),
        -- the smallest member of a node lies below exactly the nodes above it
        q AS (SELECT n.conv_id, n.d, n.own, u.conv_id AS up, u.d AS ud FROM n JOIN m ON m.c = n.conv_id AND m.d <= n.d JOIN n u ON u.d = m.d AND u.g = m.g),
        z AS (SELECT up, ud, count(*) AS kids FROM q WHERE d = ud + 1 GROUP BY up, ud),
        w AS (SELECT q.up, q.ud, sum(q.own) AS saved, count(*) FILTER (z.kids IS NULL) AS leaves FROM q LEFT JOIN z ON z.up = q.conv_id AND z.ud = q.d GROUP BY q.up, q.ud)
        SELECT n.conv_id, n.d AS depth, q.up AS parent_conv_id, n.n_convs, coalesce(z.kids, 0) AS n_children, w.leaves AS n_leaves, w.saved::BIGINT AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
        FROM n JOIN w ON w.up = n.conv_id AND w.ud = n.d LEFT JOIN z ON z.up = n.conv_id AND z.ud = n.d LEFT JOIN q ON q.conv_id = n.conv_id AND q.d = n.d AND q.ud = n.d - 1
    """,
    "op2_ngram_join": f"""
        WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(x=_LOWER)} AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(CASE WHEN len(w) >= 5 THEN range(1, len(w) - 3) WHEN len(w) > 0 THEN [1] ELSE [] END) AS i FROM w)),
        z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM o JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
        r AS (SELECT doc_id AS d, doc_id AS c FROM w UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.d)
        SELECT w.doc_id, coalesce(z.n, 0)::BIGINT AS n_shingles, (SELECT min(c) FROM r WHERE r.d = w.doc_id) AS component_id FROM w LEFT JOIN z ON z.doc_id = w.doc_id
    """,
    "op3_quality_rules": rf"""
        WITH w AS (SELECT doc_id, coalesce(text, '') AS t, {_PLAIN} AS w FROM documents),
        g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w))),
        rw AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n > 1) GROUP BY doc_id),
        ln AS (SELECT doc_id, count(*) AS n, count(DISTINCT l) AS u FROM (SELECT doc_id, unnest(string_split(t, E'\n')) AS l FROM w) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
        tw AS (SELECT doc_id, max(n) AS n FROM (SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest(w) AS x FROM w) GROUP BY 1, 2) GROUP BY doc_id),
        f AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
            coalesce(ln.n - ln.u, 0)::BIGINT AS n_dup_lines, coalesce(rw.n, 0)::BIGINT AS n_repeat_words, coalesce(ln.n, 0) AS n_lines, coalesce(tw.n, 0) AS top_word,
            length(regexp_replace(t, '[^!?]+', '', 'g')) AS bangs, length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS uppers, length(regexp_replace(t, '[^A-Za-z]+', '', 'g')) AS letters
            FROM w LEFT JOIN rw ON rw.doc_id = w.doc_id LEFT JOIN ln ON ln.doc_id = w.doc_id LEFT JOIN tw ON tw.doc_id = w.doc_id),
        b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
            NOT (base_failed OR 100 * n_symbols > 20 * n_words OR 100 * bangs > 40 * n_words OR 100 * uppers > 60 * letters OR word_chars < 2 * n_words OR word_chars > 20 * n_words
                 OR 100 * n_dup_lines > 30 * n_lines OR 100 * top_word > 30 * n_words) AS kept FROM b
    """,
    "op5_decontamination": f"""
        WITH d AS (SELECT doc_id, {_ALNUM.format(x=_LOWER)} AS w FROM documents), q AS (SELECT item_id, {_ALNUM.format(x=_LOWER)} AS w FROM benchmark),
        x AS (SELECT DISTINCT item_id, least(len(w), 10) AS z, array_to_string(w[k:k + 9], ' ') AS g FROM (SELECT item_id, w, unnest(CASE WHEN len(w) > 0 THEN range(1, greatest(len(w) - 9, 1) + 1) ELSE [] END) AS k FROM q)),
        p AS (SELECT doc_id, i, z, array_to_string(w[i:i + z - 1], ' ') AS g FROM (SELECT doc_id, w, z, unnest(range(1, len(w) - z + 2)) AS i FROM d, (SELECT DISTINCT z FROM x))),
        h AS (SELECT doc_id, i, p.z, item_id FROM p JOIN x ON p.g = x.g AND p.z = x.z),
        c AS (SELECT doc_id, count(DISTINCT u) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + z)) AS u FROM h) GROUP BY doc_id),
        t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
    """,
    "op6_substring_dedup": f"""
        WITH w AS (SELECT doc_id, {_PLAIN} AS w FROM documents),
        p AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50)),
        m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS f FROM p),
        r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS u FROM m WHERE f < doc_id),
        k AS (SELECT e.doc_id, count(*) FILTER (r.u IS NOT NULL) AS gone, string_agg(e.x, ' ' ORDER BY e.u) FILTER (r.u IS NULL) AS kept FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS u FROM w) e LEFT JOIN r ON r.doc_id = e.doc_id AND r.u = e.u GROUP BY e.doc_id)
        SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON k.doc_id = w.doc_id
    """,
    "op7_warc_fixity": """
        SELECT page_id, page_id // 256 AS segment, octet_length(encode(coalesce(html, ''))) AS n_bytes,
               sha256(coalesce(html, '')) AS payload_sha256, page_id % 97 = 5 AS corrupt
        FROM pages
    """,
}
