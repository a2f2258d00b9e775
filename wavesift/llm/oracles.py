"""DuckDB SQL for the exact operators over documents.

Windows and shingles are compared by 128-bit digests of their words or bytes. A word
holds no space, so words joined by one space stay apart.
"""

from __future__ import annotations

_WORD = r"'[^\x20\x09-\x0D]+'"

#: 200-byte strings that start in two places or more; spans are runs of starts at most 200 apart.
SUFFIX_ARRAY = """
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
starts AS (SELECT r, unnest(range(1, octet_length(b) - 198)) AS i, b FROM d WHERE octet_length(b) >= 200),
keyed AS MATERIALIZED (SELECT r, i, md5_number(b[i:i + 199]) AS k FROM starts),
again AS (SELECT r, i FROM keyed WHERE k IN (SELECT k FROM keyed GROUP BY k HAVING count(*) > 1)),
steps AS (SELECT r, i, coalesce(i > max(i) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 200, true) AS new FROM again),
runs AS (SELECT r, i, count(*) FILTER (new) OVER (PARTITION BY r ORDER BY i) AS run FROM steps),
spans AS (SELECT r, min(i) AS s, max(i) + 200 AS e FROM runs GROUP BY r, run),
cut AS (SELECT r, s, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s), 1) AS f FROM spans),
parts AS (SELECT r, sum(e - s) AS n, count(*) AS m, max(e) AS z, string_agg(hex(b[f:s - 1]), '' ORDER BY s) AS h FROM cut JOIN d USING (r) GROUP BY r)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(m, 0)::BIGINT AS n_spans,
  sha256(CASE WHEN n IS NULL THEN b ELSE unhex(h || hex(b[z:octet_length(b)])) END) AS kept_sha256
FROM d LEFT JOIN parts USING (r)
"""

#: 35-word windows that start in two places or more.
SUBSTRINGS = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents),
starts AS (SELECT r, unnest(range(1, len(w) - 33)) AS i, w FROM d WHERE len(w) >= 35),
keyed AS MATERIALIZED (SELECT r, i, md5_number(array_to_string(w[i:i + 34], ' ')) AS k FROM starts),
again AS (SELECT r, i FROM keyed WHERE k IN (SELECT k FROM keyed GROUP BY k HAVING count(*) > 1)),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS i FROM again),
items AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n FROM items ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

#: Classes of equal shingle sets, links between them by shared shingles, and what each class reaches.
JACCARD = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORD}) AS w FROM documents),
starts AS (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0),
s AS MATERIALIZED (SELECT DISTINCT r, md5_number(array_to_string(w[i:i + 4], ' ')) AS g FROM starts),
sets AS MATERIALIZED (SELECT r, count(*) AS n, md5(string_agg(g::VARCHAR, ' ' ORDER BY g)) AS k FROM s GROUP BY r),
one AS MATERIALIZED (SELECT k, min(r) AS r, any_value(n) AS n FROM sets GROUP BY k),
m AS MATERIALIZED (SELECT k, n, g FROM one JOIN s USING (r)),
links AS MATERIALIZED (SELECT a.k AS u, b.k AS v FROM m a JOIN m b ON a.g = b.g AND a.k <> b.k AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
  GROUP BY a.k, b.k HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
least AS MATERIALIZED (SELECT k, min(doc_id) AS c FROM sets JOIN d USING (r) GROUP BY k),
reach AS (SELECT k, c FROM least UNION SELECT v, c FROM reach JOIN links ON u = k)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(c, doc_id) AS component_id FROM d LEFT JOIN sets USING (r)
LEFT JOIN (SELECT k, min(c) AS c FROM reach GROUP BY k) USING (k)
"""

#: Lines of each text, cut at two places drawn from the id.
FILL_IN_MIDDLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS MATERIALIZED (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS w FROM d),
drawn AS (SELECT *, len(w)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM u),
placed AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
cut AS (SELECT doc_id, t, n, form, array_to_string(w[1:a], '') AS p, array_to_string(w[a + 1:b], '') AS m, array_to_string(w[b + 1:], '') AS s FROM placed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM cut
"""


def ball_tree(k: int = 40, rounds: int = 5) -> str:
    """Rounds of k-means over integer components, one after the other."""
    parts = [
        """WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS p FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT r, generate_subscripts(p, 1) AS d, unnest(p) AS x FROM kept)""",
        f"c0 AS MATERIALIZED (SELECT n, generate_subscripts(p, 1) AS d, unnest(p) AS y FROM (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), p) - 1 AS n, p FROM kept QUALIFY n < {k}))",
    ]
    for i in range(rounds + 1):
        parts.append(
            f"a{i} AS MATERIALIZED (SELECT r, arg_min(n, (s, n)) AS n, min(s) AS s FROM (SELECT r, n, sum((x - y) * (x - y))::BIGINT AS s FROM v JOIN c{i} USING (d) GROUP BY r, n) GROUP BY r)"
        )
        if i < rounds:
            parts.append(
                f"c{i + 1} AS MATERIALIZED (SELECT n, d, coalesce(m, y) AS y FROM c{i} LEFT JOIN (SELECT n, d, ((t - ((t % c) + c) % c) // c)::BIGINT AS m "
                f"FROM (SELECT n, d, sum(x)::BIGINT AS t, count(*) AS c FROM a{i} JOIN v USING (r) GROUP BY n, d)) USING (n, d))"
            )
    last = f"a{rounds}"
    return (
        ",\n".join(parts)
        + f""",
h AS (SELECT n, sha256(string_agg(y::VARCHAR, ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY n)
SELECT vec_id, n::INTEGER AS cluster, s AS distance, (sum(s) OVER (PARTITION BY n))::BIGINT AS cluster_inertia, (sum(s) OVER ())::BIGINT AS inertia, centroid_sha256
FROM kept JOIN {last} USING (r) JOIN h USING (n)
"""
    )


def oracle_sql() -> dict[str, str]:
    return {"op6_suffix_array": SUFFIX_ARRAY, "op7_substrings": SUBSTRINGS, "op9_jaccard": JACCARD, "op11_ball_tree": ball_tree(), "op12_fill_in_middle": FILL_IN_MIDDLE}
