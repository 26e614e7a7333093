"""DuckDB statements of the queries that SQL can express, over whole tables: other engines' ways to the same rows."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from .codes import ENTRIES, PARTS, ROUNDS, SCALE
from .privacy import GENERALISE, LETTERS, REMOVE, SUPPORT
from .search import BEST
from .templates import HOSTILE

#: Terms of the lexical search.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Rows by conversation. Escaping adds a character for each of ``\``, ``<``, ``[`` and ``]``; a turn has 11 of its own.
OP2 = rf"""
WITH c AS (
    SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '{HOSTILE}' UNION ALL SELECT -7, 1, 'assistant', '{HOSTILE}'
), l AS (
    SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS learnt, length(role) + length(text) + 11
        + length(regexp_replace(role || text, '[^\\<\[\]]', '', 'g')) AS chars FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    CAST(sum(length(learnt)) AS BIGINT) AS loss_chars, sha256(string_agg(learnt, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
    CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM l GROUP BY conv_id
"""

#: Sets as rows of shingles, pairs by a join on them, and the transitive closure of links.
OP6 = rf"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
    SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) END) AS s FROM w
), rows_ AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
pairs AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM rows_ a JOIN rows_ b ON a.x = b.x AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach(a, b) AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(min(r.b), s.doc_id)) AS component_id
FROM sets s LEFT JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, s.s
"""

BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "len(list_filter(string_split(v, '.'), lambda p: length(ltrim(p, '0')) > 3 OR (length(ltrim(p, '0')) = 3 AND ltrim(p, '0') > '255'))) = 0"),
    "card": (
        r"[0-9](?:[\x20-]?[0-9])+",
        "length(d) BETWEEN 16 AND 19 AND list_sum(list_transform(range(1, length(d) + 1), lambda k: CASE WHEN k % 2 = 1 THEN CAST(d[length(d) - k + 1] AS INTEGER) "
        "WHEN CAST(d[length(d) - k + 1] AS INTEGER) > 4 THEN 2 * CAST(d[length(d) - k + 1] AS INTEGER) - 9 ELSE 2 * CAST(d[length(d) - k + 1] AS INTEGER) END)) % 10 = 0",
    ),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "length(d) BETWEEN 8 AND 15"),
}


def matches(pattern: str, source: str) -> str:
    """doc_id, k, v, o: matches of a pattern and their offsets, by the lengths of the gaps before them."""
    return (
        f"SELECT doc_id, k, m[k] AS v, list_sum(list_transform(g[1 : k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1 : k - 1], lambda x: length(x))), 0) AS o "
        f"FROM (SELECT doc_id, m, g, unnest(range(1, len(m) + 1)) AS k FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS g FROM {source}))"
    )


def spans(kind: str) -> str:
    pattern, holds = BASE[kind]
    found = f"SELECT doc_id, CAST(o AS BIGINT) AS a, CAST(o + length(v) AS BIGINT) AS b, v, regexp_replace(v, '[^0-9]', '', 'g') AS d FROM ({matches(pattern, 'docs')})"
    value = {"email": "translate(v, '" + ascii_uppercase + "', '" + ascii_lowercase + "')", "ip": "v"}.get(kind, "d")
    return f"SELECT doc_id, {list(BASE).index(kind)} AS ord, '{kind}' AS kind, a, b, '{kind}:' || {value} AS entity FROM ({found}) WHERE {holds}"


#: A term is what starts a run of letters, digits and the signs of addresses, if a full stop or nothing ends it.
RUN = r"[\p{L}\p{N}@._%+-]+"
TERM = rf"^(\p{{L}}{{{LETTERS},}})(?:\.(?:[@._%+-].*)?)?$"

OP10 = rf"""
WITH docs AS (SELECT row_number() OVER () AS doc_id, id, text FROM (SELECT DISTINCT doc_id AS id, coalesce(text, '') AS text FROM documents)),
base AS ({" UNION ALL ".join(map(spans, BASE))}),
runs AS ({matches(RUN, "docs")}),
places AS (
    SELECT doc_id, lower(t) AS term, CAST(o AS BIGINT) AS a, CAST(o + length(t) AS BIGINT) AS b
    FROM (SELECT doc_id, o, regexp_extract(v, '{TERM}', 1, 's') AS t FROM runs) WHERE t <> ''
),
n AS (SELECT CAST(greatest(2, count(*)) AS DOUBLE) AS n FROM docs),
held AS (SELECT DISTINCT doc_id, term FROM places),
df_t AS (SELECT term, count(*) AS t FROM held GROUP BY term),
entities AS (SELECT DISTINCT doc_id, entity FROM base),
df_e AS (SELECT entity, count(*) AS e FROM entities GROUP BY entity HAVING count(*) >= {SUPPORT}),
pairs AS (SELECT entity, term, e, t, count(*) AS te FROM entities JOIN df_e USING (entity) JOIN held USING (doc_id) JOIN df_t USING (term) GROUP BY ALL HAVING count(*) >= {SUPPORT}),
told AS (SELECT entity, term, log2(n * te / (t * e)) / log2(n / least(e, n / 2)) AS d FROM pairs CROSS JOIN n),
marked AS (SELECT doc_id, term, max(d) AS d FROM entities JOIN held USING (doc_id) JOIN told USING (entity, term) WHERE d >= {GENERALISE} GROUP BY ALL),
terms AS (SELECT doc_id, 9 AS ord, CASE WHEN d >= {REMOVE} THEN 'removed' ELSE 'generalised' END AS kind, a, b FROM places JOIN marked USING (doc_id, term)),
every AS (SELECT doc_id, ord, kind, a, b FROM base UNION ALL SELECT * FROM terms),
spelt AS (
    SELECT doc_id, {", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in BASE)}, count(*) FILTER (WHERE ord = 9) AS n_terms,
        string_agg(kind || ':' || a || ':' || b, ',' ORDER BY ord, a) FILTER (WHERE ord < 9) AS base, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY ord, a) AS spans
    FROM every GROUP BY doc_id
)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_terms, 0) AS n_terms
FROM documents d JOIN docs k ON d.doc_id IS NOT DISTINCT FROM k.id AND coalesce(d.text, '') = k.text LEFT JOIN spelt s ON s.doc_id = k.doc_id
"""

def rounds_of(n: int) -> str:
    """Assignments a0 to an by codebooks c0 to cn: parts of vectors as lists of whole doubles."""
    out = []
    for k in range(n + 1):
        out.append(
            f"a{k} AS MATERIALIZED (SELECT r, p, min({{'d': list_inner_product(v.x, v.x) - 2 * list_inner_product(v.x, c.x) + list_inner_product(c.x, c.x), 'e': c.e}}) AS m FROM parts v JOIN c{k} c USING (p) GROUP BY r, p)"
        )
        if k < n:
            out.append(f"s{k} AS (SELECT p, a.m.e AS e, generate_subscripts(x, 1) AS j, unnest(x) AS v FROM a{k} a JOIN parts USING (r, p))")
            out.append(f"m{k} AS (SELECT p, e, list(v ORDER BY j) AS x FROM (SELECT p, e, j, floor(sum(v) / count(*)) AS v FROM s{k} GROUP BY ALL) GROUP BY p, e)")
            out.append(f"c{k + 1} AS MATERIALIZED (SELECT c.p AS p, c.e AS e, coalesce(m.x, c.x) AS x FROM c{k} c LEFT JOIN m{k} m ON m.p = c.p AND m.e = c.e)")
    return ",\n".join(out)


OP12 = f"""
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS q FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
parts AS MATERIALIZED (SELECT r, p, q[p * (len(q) // {PARTS}) + 1 : (p + 1) * (len(q) // {PARTS})] AS x FROM (SELECT *, unnest(range({PARTS})) AS p FROM kept)),
c0 AS MATERIALIZED (SELECT p, r - 1 AS e, x FROM parts WHERE r <= {ENTRIES}),
{rounds_of(ROUNDS)},
rows_ AS (
    SELECT r, string_agg(printf('%02x', a.m.e), '' ORDER BY p) AS code, CAST(sum(a.m.d) AS BIGINT) AS error FROM a{ROUNDS} a GROUP BY r
),
books AS (SELECT sha256(string_agg(array_to_string(list_transform(x, lambda v: CAST(v AS BIGINT)), ','), ',' ORDER BY p, e)) AS h FROM c{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM kept JOIN rows_ USING (r) CROSS JOIN books
"""

#: Terms of documents by number of row, and of items.
OP11 = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '{WORD}'), lambda t: translate(t, '{ascii_uppercase}', '{ascii_lowercase}')) AS t FROM documents),
i AS (SELECT DISTINCT item_id, coalesce(text, '') AS text FROM benchmark),
q AS MATERIALIZED (
    SELECT DISTINCT item_id, text, term
    FROM (SELECT item_id, text, unnest(list_transform(regexp_extract_all(text, '{WORD}'), lambda t: translate(t, '{ascii_uppercase}', '{ascii_lowercase}'))) AS term FROM i)
),
s AS (SELECT count(*) FILTER (WHERE len(t) > 0) AS n, coalesce(sum(len(t)), 0) AS l FROM d),
p AS MATERIALIZED (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p CROSS JOIN s GROUP BY term, n),
m AS (SELECT r, doc_id, 100 - 90 + (90 * CAST(len(t) AS BIGINT) * n) // l AS m FROM d CROSS JOIN s WHERE len(t) > 0),
c AS (SELECT item_id, text, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (r) GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM c WHERE score > 0) WHERE rank <= {BEST}
"""

ORACLE_SQL = {"op2_chat_template": OP2, "op6_jaccard_join": OP6, "op10_disclosure_sanitisation": OP10, "op11_lexical_search": OP11, "op12_vector_codes": OP12}
