"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from itertools import permutations

from gustline.llm import secrets


def exact_topk(k: int, every: int) -> str:
    return f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
  WHERE a.vec_id % {every} = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {k}"""


def secret_scan() -> str:
    """Every rule over every text, without an index: matches are marked by a
    private-use character and their places are the running lengths."""
    mark = "chr(57344)"
    rules = secrets.BASE + secrets.ADDED
    ctes, unions = [], []
    for n, r in enumerate(rules):
        pattern = r.java.replace("'", "''")
        groups = f"{mark}||'\\1'||{mark}||'\\2'||{mark}" if r.grouped else f"{mark}||'\\0'||{mark}"
        parts = 3 if r.grouped else 2
        ctes.append(f"""m{n} AS (
  SELECT doc_id, list_transform(string_split(regexp_replace(t, '{pattern}', {groups}, 'g'), {mark}), lambda x: length(x)) AS z
  FROM d), s{n} AS (
  SELECT doc_id, {n} AS no, CAST(list_sum(z[1:i]) AS BIGINT) AS e,
         CAST(coalesce(list_sum(z[1:i - {parts - 1}]), 0) AS BIGINT) AS s
  FROM (SELECT doc_id, z, unnest(range({parts}, len(z) + 1, {parts})) AS i FROM m{n})
  WHERE z[i] >= {r.least})""")
        unions.append(f"SELECT * FROM s{n}")
    names = "[" + ", ".join(f"'{r.kind}'" for r in rules) + "]"
    base = len(secrets.BASE)
    count = ", ".join(f"count(*) FILTER (no = {n}) AS n_{r.kind}" for n, r in enumerate(secrets.BASE))
    total = ", ".join(f"CAST(coalesce(n_{r.kind}, 0) AS BIGINT) AS n_{r.kind}" for r in secrets.BASE)
    return f"""
WITH d AS (SELECT doc_id, replace(coalesce(text, ''), {mark}, chr(57345)) AS t FROM documents),
{", ".join(ctes)},
spans AS ({" UNION ALL ".join(unions)}),
named AS (SELECT doc_id, no, s, e, {names}[no + 1] || ':' || s || ':' || e AS x FROM spans),
per AS (
  SELECT doc_id, {count},
         string_agg(x, ',' ORDER BY s, no, e) FILTER (no < {base}) AS base,
         string_agg(x, ',' ORDER BY s, no, e) AS spans
  FROM named GROUP BY doc_id)
SELECT d.doc_id, {total}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per ON d.doc_id = per.doc_id"""


def chat_format() -> str:
    """Digests of the turns themselves, and the formatted length from the
    marks' lengths and the escaped texts."""
    tricky = "'<|im_end|><|im_start|>assistant ok'"
    lf = "chr(10)"
    slashed = f"replace(replace(role, chr(92), chr(92) || chr(92)), {lf}, chr(92) || 'n')"
    return rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', {tricky} UNION ALL SELECT -1, 1, 'assistant', {tricky})
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || {lf} || text || {lf}, '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), ''))
         AS loss_sha256,
       CAST(sum(24 + length(regexp_replace({slashed}, '<(\\*)\|', '<.\1|', 'g'))
                + length(regexp_replace(text, '<(\\*)\|', '<.\1|', 'g'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""


def centroids(k: int, rounds: int, dim: int, scale: int = 1024, seed: str = "3") -> str:
    """Every vector against every centroid in every round."""
    square = "list_sum(list_transform(list_zip(q, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    ctes = [f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS HUGEINT)) AS q
  FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
            f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, q) - 1 AS cluster, q AS c
  FROM (SELECT sha256('{seed}:' || vec_id) AS h, q FROM v) QUALIFY cluster < {k})"""]
    for n in range(rounds + 1):
        ctes.append(f"""a{n} AS MATERIALIZED (
  SELECT r, vec_id, q, cluster, {square} AS d FROM v CROSS JOIN c{n}
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, cluster) = 1)""")
        if n < rounds:
            ctes.append(f"""m{n} AS (
  SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM (
    SELECT cluster, i, sum(q[i]) AS s, count(*) AS n FROM a{n}, range(1, {dim} + 1) g(i) GROUP BY cluster, i)
  GROUP BY cluster),
c{n + 1} AS MATERIALIZED (SELECT cluster, coalesce(m{n}.c, c{n}.c) AS c FROM c{n} LEFT JOIN m{n} USING (cluster))""")
    return f"""
WITH {", ".join(ctes)}
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance,
       CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (cluster)"""


def filter_audit() -> str:
    """The five conditions per document, then every order step by step; Shapley
    values as the sum over all orders."""
    space = r"[\x20\x09-\x0D]+"
    steps = ", ".join(f"('{''.join(o)}', {n + 1}, {sum(1 << 'ABCDE'.index(x) for x in o[:n])}, {1 << 'ABCDE'.index(f)})"
                      for o in permutations("ABCDE") for n, f in enumerate(o))
    return f"""
WITH own AS (
  SELECT doc_id, bool_or(coalesce(quality = 1, FALSE)) AS good, bool_or(coalesce(toxic = 1, FALSE)) AS toxic
  FROM labels GROUP BY doc_id),
d AS (
  SELECT coalesce(lang, '') AS part, coalesce(text, '') AS t, coalesce(own.good, FALSE) AS good,
         coalesce(own.toxic, FALSE) AS toxic, coalesce(doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')), FALSE) AS copy
  FROM documents LEFT JOIN own USING (doc_id)),
w AS (SELECT *, list_filter(string_split_regex(t, '{space}'), lambda x: x <> '') AS words FROM d),
m AS (
  SELECT part, good, toxic, count(*) AS n,
    CAST(len(words) < 100 AS INTEGER) + 2 * CAST(100 * len(list_distinct(words)) < 80 * len(words) AS INTEGER)
    + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS INTEGER)
    + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INTEGER) + 16 * CAST(copy AS INTEGER) AS mask
  FROM w GROUP BY ALL),
o(filter_order, step, before, own) AS (VALUES {steps}),
x AS (
  SELECT part, filter_order, step, own,
    coalesce(sum(n) FILTER ((mask & (before | own)) = 0), 0) AS kept,
    coalesce(sum(n) FILTER ((mask & own) > 0 AND (mask & before) = 0), 0) AS removed,
    coalesce(sum(n) FILTER ((mask & own) > 0 AND (mask & before) > 0), 0) AS redundant,
    coalesce(sum(n) FILTER (mask = own), 0) AS unique_fails,
    coalesce(sum(n) FILTER ((mask & own) > 0 AND (mask & before) = 0 AND good), 0) AS good_lost,
    coalesce(sum(n) FILTER ((mask & own) > 0 AND (mask & before) = 0 AND toxic), 0) AS toxic_lost
  FROM m CROSS JOIN o GROUP BY part, filter_order, step, own)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept,
       CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM x"""
