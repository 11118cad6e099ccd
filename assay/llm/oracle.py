"""SQL statements with the same results as the queries, where SQL can state them."""

from assay.llm.catalog import URL_RULES

_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)

_WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), w -> w <> '')"

_LEAF = " || ".join(
    f"CASE WHEN {v} IS NULL THEN '-' ELSE octet_length(encode({v}::VARCHAR)) || ':' || {v} END" for v in ("doc_id", "source", "lang", "n_chars", "{text}")
)

# CRC-32 of a decimal, a byte at a time; its table comes from the polynomial.
_CRC = """
    xor(list_reduce(
        list_concat([4294967295::UBIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::UBIGINT)),
        lambda r, c: xor(bytes.t[(xor(r, c) & 255)::BIGINT + 1], r >> 8)), 4294967295::UBIGINT)
"""

# Levels of one tree per source ``s`` over nodes (s, pos, n, d): every run of three becomes a node until one is left.
_LEVELS = """
    SELECT 0 AS lvl, s, pos, n, d FROM {nodes}
    UNION ALL
    SELECT lvl + 1, s, pos // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY pos)) FROM {levels} WHERE n > 1 GROUP BY lvl, s, pos // 3, n
"""


def _centroid_rounds(steps: int) -> str:
    """One assignment and one update of the centroids for each round, then the last assignment."""
    parts = []
    for i in range(steps + 1):
        parts.append(f"""
        a{i} AS (
            SELECT r, arg_min(j, d * 64 + j) AS j, min(d) AS d FROM (
                SELECT k.r, c.j, (k.xx - 2 * list_inner_product(k.x, c.x) + list_inner_product(c.x, c.x))::BIGINT AS d FROM kept k CROSS JOIN c{i} c
            ) GROUP BY r
        )""")
        if i < steps:
            parts.append(f"""
        m{i} AS (
            SELECT j, list(m ORDER BY i) AS x FROM (
                SELECT a.j, p.i, floor(sum(k.x[p.i]) / count(*)) AS m FROM a{i} a JOIN kept k USING (r) CROSS JOIN (SELECT unnest(range(1, 65)) AS i) p GROUP BY a.j, p.i
            ) GROUP BY j
        ),
        c{i + 1} AS (SELECT c.j, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN m{i} m USING (j))""")
    return ",".join(parts)


ORACLE: dict[str, str] = {
    "op4_url_filters": rf"""
        WITH rules(verdict, host, path) AS (VALUES {_RULES}),
        cut AS (
            SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
        ),
        parts AS (
            SELECT row_number() OVER () AS n, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
            FROM cut
        ),
        fits AS (
            SELECT p.n, r.host || r.path AS rule, r.verdict, row_number() OVER (PARTITION BY p.n ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS place
            FROM parts p JOIN rules r ON (p.host = r.host OR p.host LIKE '%.' || r.host) AND starts_with(p.path, r.path)
        )
        SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
        FROM parts p LEFT JOIN fits f ON f.n = p.n AND f.place = 1
    """,
    "op9_warc": """
        WITH rows AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        facts AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM rows),
        firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM facts)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
        FROM firsts
    """,
    "op11_merkle": f"""
        WITH RECURSIVE bits AS (
            SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i::UBIGINT], [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]),
                lambda r, z: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384::UBIGINT) ELSE r >> 1 END)) AS t
        ),
        bytes AS MATERIALIZED (SELECT t FROM bits),
        docs AS (
            SELECT row_number() OVER () AS k, doc_id, source, {_LEAF.format(text="text")} AS own,
                   {_LEAF.format(text="(CASE WHEN " + _CRC + " % 2 = 0 THEN replace(text, chr(10), '') ELSE text END)")} AS seen
            FROM documents, bytes
        ),
        leaves AS (
            SELECT *, source AS s, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, d) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n
            FROM (SELECT k, doc_id, source, sha256(own) AS d, sha256(seen) AS tampered FROM docs)
        ),
        levels AS ({_LEVELS.format(nodes="leaves", levels="levels")}),
        subroots AS (
            SELECT 0 AS s, s AS source, d, row_number() OVER (ORDER BY encode(s) NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM levels WHERE n = 1
        ),
        tops AS ({_LEVELS.format(nodes="subroots", levels="tops")}),
        steps AS (
            SELECT l.k, v.lvl, string_agg(v.d, '' ORDER BY v.pos) FILTER (WHERE v.pos < l.pos // (3 ** v.lvl)::BIGINT) AS a,
                   string_agg(v.d, '' ORDER BY v.pos) FILTER (WHERE v.pos > l.pos // (3 ** v.lvl)::BIGINT) AS b
            FROM leaves l JOIN levels v ON l.s IS NOT DISTINCT FROM v.s AND v.n > 1 AND v.pos // 3 = l.pos // (3 ** (v.lvl + 1))::BIGINT
            GROUP BY l.k, v.lvl
            UNION ALL
            SELECT l.k, 100 + v.lvl, string_agg(v.d, '' ORDER BY v.pos) FILTER (WHERE v.pos < r.pos // (3 ** v.lvl)::BIGINT),
                   string_agg(v.d, '' ORDER BY v.pos) FILTER (WHERE v.pos > r.pos // (3 ** v.lvl)::BIGINT)
            FROM leaves l JOIN subroots r ON l.s IS NOT DISTINCT FROM r.source JOIN tops v ON v.n > 1 AND v.pos // 3 = r.pos // (3 ** (v.lvl + 1))::BIGINT
            GROUP BY l.k, v.lvl
        ),
        numbered AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY lvl) AS turn, coalesce(a, '') AS a, coalesce(b, '') AS b FROM steps),
        folds AS (
            SELECT k, 0 AS turn, tampered AS d FROM leaves
            UNION ALL
            SELECT f.k, f.turn + 1, sha256(n.a || f.d || n.b) FROM folds f JOIN numbered n ON n.k = f.k AND n.turn = f.turn + 1
        ),
        ends AS (SELECT k, arg_max(d, turn) AS folded_root FROM folds GROUP BY k),
        proofs AS (SELECT k, string_agg(a || b, '' ORDER BY turn) AS p FROM numbered GROUP BY k)
        SELECT l.doc_id, l.d AS leaf, r.d AS subroot, t.d AS root, sha256(coalesce(p.p, '')) AS proof_sha256, e.folded_root, e.folded_root = t.d AS verified
        FROM leaves l JOIN subroots r ON l.s IS NOT DISTINCT FROM r.source JOIN tops t ON t.n = 1 JOIN ends e USING (k) LEFT JOIN proofs p USING (k)
    """,
    "op12_centroids": f"""
        WITH given AS (
            SELECT vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = 64
        ),
        kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, x, list_inner_product(x, x) AS xx FROM given),
        c0 AS (SELECT j, x FROM (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, x) - 1 AS j, x FROM kept) WHERE j < 40),
        {_centroid_rounds(5)},
        sums AS (SELECT j, sum(d)::BIGINT AS s FROM a5 GROUP BY j)
        SELECT k.vec_id, a.j::INTEGER AS cluster, a.d AS distance, s.s AS cluster_inertia, (SELECT sum(s)::BIGINT FROM sums) AS inertia,
               sha256(array_to_string(list_transform(c.x, lambda v: v::BIGINT), ',')) AS centroid_sha256
        FROM kept k JOIN a5 a USING (r) JOIN sums s ON s.j = a.j JOIN c5 c ON c.j = a.j
    """,
}
