"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import importlib

#: Module and function of each query.
_QUERIES = {
    "op1_tiff": "tiff",
    "op2_best_two_fit": "packing",
    "op3_mix": "mixing",
    "op4_global_orders": "jaccard",
    "op5_novelty": "secrets",
    "op6_difference_cover": "substrings",
    "op7_simhash_lines": "lines",
    "op8_licenses": "licenses",
    "op9_boosted": "quality",
    "op10_url_models": "urls",
    "op11_divergence": "divergence",
    "op12_vector_codes": "vectorcodes",
    "op13_token_counts": "tokencounts",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"{__package__}.{module}"), name) for name, module in _QUERIES.items()}


_SPLIT = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_SQL = {
    "op4_global_orders": f"""
    WITH RECURSIVE d AS (SELECT doc_id, {_SPLIT.format(_LOWER)} AS w FROM documents),
    sh AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 3], ' ') END AS s FROM d, unnest(range(1, greatest(len(w) - 2, 2))) AS t(i) WHERE len(w) > 0),
    n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS x FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * x >= 85 * (na.n + nb.n - x)),
    r(doc_id, reached) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.reached = e.a),
    c AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY 1)
    SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.doc_id = d.doc_id""",
    "op6_difference_cover": f"""
    WITH d AS (SELECT doc_id, {_SPLIT.format("coalesce(text, '')")} AS w FROM documents),
    s AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS k FROM d, unnest(range(1, len(w) - 48)) AS t(i)),
    m AS (SELECT k, min(doc_id) AS low FROM s GROUP BY k),
    h AS (SELECT DISTINCT s.doc_id, unnest(range(s.i, s.i + 50)) AS j FROM s JOIN m ON m.k = s.k AND m.low < s.doc_id),
    g AS (SELECT doc_id, list(j) AS gone FROM h GROUP BY 1),
    a AS (SELECT d.doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN g ON g.doc_id = d.doc_id)
    SELECT doc_id, len(w) AS n_words, len(gone) AS n_removed, sha256(array_to_string(list_filter(w, lambda x, j: NOT list_contains(gone, j)), ' ')) AS kept_sha256 FROM a""",
}

_LETTERS = r"regexp_extract_all({}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')"


def _share(n: str, total: str, v: str) -> str:
    return f"CAST(1 + (1000000000::HUGEINT * (({n}) + 1)) // nullif({total} + {v}, 0) AS HUGEINT)"


def _apart(p: str, q: str) -> str:
    return f"(({p}) - ({q})) * (({p}) - ({q})) // ({q})"


_SQL["op11_divergence"] = f"""
    WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LETTERS.format(_LOWER)} AS w FROM documents),
    t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
    kept AS (SELECT lang, term FROM t GROUP BY 1, 2 HAVING count(DISTINCT r) >= 3),
    n AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
    g AS (SELECT DISTINCT lang, source FROM d),
    tot AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN n USING (lang, source) GROUP BY 1, 2),
    v AS (SELECT g.lang, count(DISTINCT kept.term) AS v FROM g LEFT JOIN kept USING (lang) GROUP BY 1),
    p AS (SELECT g.lang, g.source, kept.term, coalesce(n, 0) AS n, {_share("coalesce(n, 0)", "total", "v")} AS p FROM g JOIN kept ON kept.lang = g.lang JOIN v ON v.lang = g.lang JOIN tot ON tot.lang = g.lang AND tot.source = g.source LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = kept.term),
    q AS (SELECT lang, term, {_share("sum(n)", "(SELECT sum(total) FROM tot WHERE tot.lang = n.lang)", "(SELECT v FROM v WHERE v.lang = n.lang)")} AS q FROM n GROUP BY 1, 2),
    f AS (SELECT a.lang, a.source, b.source AS item, sum({_apart("a.p", "b.p")}) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
    pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
    terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, CAST({_apart("p", "q")} AS BIGINT) AS value FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE n > 0 AND p > q),
    ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
    SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200"""


def _rounds() -> str:
    """Seven assignments with six codebook updates between them, one table expression each."""
    near = "SELECT id, pos, x, arg_min(e, (dist, e)) AS e, min(dist) AS dist FROM (SELECT x.id, x.pos, x.x, b.e, list_sum(list_transform(list_zip(x.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS dist FROM x JOIN b{k} b USING (pos)) GROUP BY 1, 2, 3"
    mean = """SELECT b.pos, b.e, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN (SELECT pos, e, list(m ORDER BY j) AS c FROM (
      SELECT pos, e, j, CAST((sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS m FROM (SELECT pos, e, unnest(x) AS v, unnest(range(len(x))) AS j FROM a{k}) GROUP BY 1, 2, 3) GROUP BY 1, 2) m USING (pos, e)"""
    return ",\n    ".join(f"a{k} AS MATERIALIZED ({near.format(k=k)}), b{k + 1} AS MATERIALIZED ({mean.format(k=k)})" for k in range(7))


_SQL["op12_vector_codes"] = f"""
    WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS id, vec_id, label, list_transform(embedding, lambda c: CAST(floor(4096 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
      FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
    x AS MATERIALIZED (SELECT id, pos, x[pos * (len(x) // 8) + 1:(pos + 1) * (len(x) // 8)] AS x FROM v, unnest(range(8)) AS t(pos)),
    b0 AS MATERIALIZED (SELECT pos, id - 1 AS e, x AS c FROM x WHERE id <= 16),
    {_rounds()},
    s AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY pos, e)) AS codebooks_sha256 FROM b6),
    r AS (SELECT id, string_agg(printf('%02x', e), '' ORDER BY pos) AS code, CAST(sum(dist) AS BIGINT) AS error FROM a6 GROUP BY 1)
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN r USING (id), s"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries whose whole result it can express; tests hold the others against brute force."""
    return dict(_SQL)
