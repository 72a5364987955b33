"""DuckDB twins of the corpus queries that SQL can express; used only to check results."""

from __future__ import annotations


def linked_sql(size: int, percent: int, kept: bool) -> str:
    """Classes of texts linked by their word shingles (operators 3 and 13)."""
    columns = "d.doc_id, CAST(coalesce(z.n, 0) AS BIGINT) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id"
    return f"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    s AS MATERIALIZED (SELECT DISTINCT doc_id, hash(list_slice(w, k, k + {size - 1})) AS g FROM w, unnest(range(1, greatest(len(w) - {size - 1}, 1) + 1)) r(k) WHERE len(w) > 0),
    z AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
    l AS MATERIALIZED (SELECT a, b FROM p JOIN z x ON x.doc_id = a JOIN z y ON y.doc_id = b WHERE 100 * shared >= {percent} * (x.n + y.n - shared)),
    e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    r AS (SELECT DISTINCT a AS id, a AS seen FROM e UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.seen),
    c AS (SELECT id, min(seen) AS component_id FROM r GROUP BY id)
    SELECT {columns}{', coalesce(c.component_id, d.doc_id) = d.doc_id AS kept' if kept else ''}
    FROM documents d LEFT JOIN z ON z.doc_id = d.doc_id LEFT JOIN c ON c.id = d.doc_id"""


NEGATIVES = """
    WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
          list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
          CAST(list_sum(list_transform(a.v, lambda x, i: x * b.v[i])) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
    p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
    WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5"""


def clusters_sql(k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024) -> str:
    """The rounds of operator 12, one pair of tables each: assignment, then centroids."""
    far = "list_sum(list_transform(x.v, lambda y, i: (y - c.c[i]) * (y - c.c[i])))"
    nearest = f"SELECT x.vec_id, arg_min(c.j, CAST({far} AS HUGEINT) * {k} + c.j) AS j, min(CAST({far} AS HUGEINT)) AS far FROM v x CROSS JOIN c{{r}} c GROUP BY x.vec_id"
    steps = [f"""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
        WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
             f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS j, v AS c FROM (SELECT sha256('3:' || vec_id) AS h, v FROM v ORDER BY h LIMIT {k}))"]
    for r in range(rounds):
        steps.append(f"a{r} AS MATERIALIZED ({nearest.format(r=r)})")
        steps.append(f"""m{r} AS (SELECT j, list(CAST(floor(s / n) AS BIGINT) - CASE WHEN floor(s / n) * n > s THEN 1 ELSE 0 END ORDER BY i) AS c FROM
            (SELECT j, i, sum(y) AS s, count(*) AS n FROM (SELECT j, unnest(v) AS y, unnest(range({dim})) AS i FROM a{r} JOIN v USING (vec_id)) GROUP BY j, i) GROUP BY j)""")
        steps.append(f"c{r + 1} AS MATERIALIZED (SELECT j, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (j))")
    return f"""WITH {', '.join(steps)}, last AS MATERIALIZED ({nearest.format(r=rounds)})
    SELECT vec_id, CAST(j AS INTEGER) AS cluster, CAST(far AS BIGINT) AS distance, CAST(sum(far) OVER (PARTITION BY j) AS BIGINT) AS cluster_inertia,
           CAST(sum(far) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM last JOIN c{rounds} USING (j)"""


ORACLES = {
    "op3_pivot_regions": linked_sql(4, 85, False),
    "op11_coordinate_pruning": NEGATIVES,
    "op12_equal_average": clusters_sql(),
    "op13_setsketch": linked_sql(5, 85, True),
}
