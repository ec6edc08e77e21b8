"""DuckDB SQL for those queries of this subpackage that SQL can express."""

from __future__ import annotations

#: (kind, expression in RE2 syntax, group whose length counts, least length), in the order of equal starts.
SECRET_SQL_RULES = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
    ("github", r"gh[oprsu]_[A-Za-z0-9]{30,}", 0, 0),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    ("google", r"AIza[A-Za-z0-9_-]{35}", 0, 0),
    ("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+", 0, 0),
)


def op7_secrets() -> str:
    """Starts are the lengths of what precedes: the pieces between matches, and the matches."""
    parts, spans = [], []
    for k, (kind, pattern, group, least) in enumerate(SECRET_SQL_RULES):
        parts.append(f"regexp_extract_all(t, '{pattern}', 0) AS m{k}, regexp_extract_all(t, '{pattern}', {group}) AS g{k}, string_split_regex(t, '{pattern}') AS r{k}")
        start = f"list_sum(list_transform(r{k}[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m{k}[1:i-1], lambda x: length(x))), 0)"
        spans.append(f"list_transform(list_filter(range(1, len(m{k}) + 1), lambda i: length(g{k}[i]) >= {least}), lambda i: {{'s': CAST({start} AS BIGINT), 'o': {k}, 'k': '{kind}', 'e': CAST({start} + length(m{k}[i]) AS BIGINT)}})")
    text = lambda a: f"coalesce(array_to_string(list_transform({a}, lambda x: x.k || ':' || x.s || ':' || x.e), ','), '')"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT doc_id, {', '.join(parts)} FROM d),
s AS (SELECT doc_id, list_sort(list_concat({', '.join(spans)})) AS a FROM m),
b AS (SELECT doc_id, a, list_filter(a, lambda x: x.o <= 2) AS base FROM s)
SELECT doc_id, CAST(len(list_filter(a, lambda x: x.o = 0)) AS BIGINT) AS n_assign,
  CAST(len(list_filter(a, lambda x: x.o = 1)) AS BIGINT) AS n_access, CAST(len(list_filter(a, lambda x: x.o = 2)) AS BIGINT) AS n_hex,
  sha256({text('base')}) AS base_sha256, {text('a')} AS spans FROM b"""


OP2 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q, v d WHERE q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id AND len(q.v) = len(d.v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""


OP9 = """WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE CAST([] AS VARCHAR[]) END) AS s FROM w),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles FROM l),
e AS (SELECT doc_id, unnest(s) AS s FROM l),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
k AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n_shingles + y.n_shingles - k)),
g AS (SELECT a, b FROM k UNION ALL SELECT b, a FROM k),
r AS (SELECT doc_id, doc_id AS r FROM n UNION SELECT g.b, r.r FROM r JOIN g ON g.a = r.doc_id),
c AS (SELECT doc_id, min(r) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c USING (doc_id)"""


#: Bytes are pairs of hexadecimal digits; a window that has come before starts a stretch of 100 that goes.
OP5 = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, p, md5_number(substr(x, CAST(2 * p + 1 AS BIGINT), 200)) AS h FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 99)) AS p FROM d)),
r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) AS k FROM w),
f AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 100 THEN 0 ELSE 1 END AS fresh FROM r WHERE k > 1),
g AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS n FROM f),
s AS (SELECT doc_id, n, min(p) AS a, max(p) + 100 AS b FROM g GROUP BY doc_id, n),
l AS (SELECT doc_id, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b FROM s GROUP BY doc_id),
k AS (SELECT d.doc_id, x, coalesce(a, []) AS a, coalesce(b, []) AS b FROM d LEFT JOIN l ON d.doc_id = l.doc_id)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(list_sum(b), 0) - coalesce(list_sum(a), 0) AS BIGINT) AS n_removed, CAST(len(a) AS BIGINT) AS n_spans,
  sha256(from_hex(array_to_string(list_transform(range(0, len(a) + 1), lambda i: CASE WHEN len(a) = 0 THEN x WHEN i = 0 THEN substr(x, 1, 2 * a[1])
    WHEN i = len(a) THEN substr(x, 2 * b[i] + 1) ELSE substr(x, 2 * b[i] + 1, 2 * (a[i + 1] - b[i])) END), ''))) AS kept_sha256,
  array_to_string(list_transform(list_zip(a, b), lambda z: z[1] || ':' || z[2]), ',') AS spans FROM k"""


def oracle_sql() -> dict[str, str]:
    return {"op2_cover_tree": OP2, "op5_suffix_array": OP5, "op7_secrets": op7_secrets(), "op9_minhash": OP9}
