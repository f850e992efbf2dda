"""DuckDB SQL of the queries that it can express on whole tables."""

_SPACES = r"'[\x20\x09-\x0D]'"

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ITEM_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _clusters_sql(k=8, rounds=10, dim=64):
    """Rounds of assignment and exact floors of means, one pair of tables each."""
    near = """
        a{r} AS MATERIALIZED (
            SELECT rid, least % {k} AS c, least // {k} AS d FROM (
                SELECT rid, min(list_sum(list_transform(list_zip(v.q, c.q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))
                                ::HUGEINT * {k} + c.c) AS least
                FROM v, c{r} c GROUP BY rid)),"""
    move = """
        c{s} AS MATERIALIZED (
            WITH m AS (
                SELECT c, list((t - ((t % n) + n) % n) // n ORDER BY i)::BIGINT[] AS q FROM (
                    SELECT c, i, sum(q[i])::HUGEINT AS t, count(*) AS n
                    FROM a{r} JOIN v USING (rid), range(1, {dim} + 1) x(i) GROUP BY c, i) GROUP BY c)
            SELECT c.c, coalesce(m.q, c.q) AS q FROM c{r} c LEFT JOIN m ON m.c = c.c),"""
    steps = "".join(near.format(r=r, k=k) + move.format(r=r, s=r + 1, dim=dim) for r in range(rounds))
    return f"""
        WITH e AS (
            SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE len(embedding) = {dim}),
        v AS MATERIALIZED (
            SELECT row_number() OVER () AS rid, vec_id, list_transform(e, lambda x: floor(1024 * x)::BIGINT) AS q
            FROM e WHERE len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = {dim}),
        c0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY h, q) - 1 AS c, q
            FROM (SELECT sha256('3:' || coalesce(vec_id::VARCHAR, '')) AS h, q FROM v ORDER BY h, q LIMIT {k})),
        {steps}
        {near.format(r=rounds, k=k).strip().rstrip(',')}
        SELECT vec_id, a.c::INTEGER AS cluster, d::BIGINT AS distance,
               (sum(d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
               sha256(array_to_string(list_transform(c.q, lambda x: x::VARCHAR), ',')) AS centroid_sha256
        FROM a{rounds} a JOIN v USING (rid) JOIN c{rounds} c ON c.c = a.c
    """


SQL = {
    "op11_simplex_clusters": _clusters_sql(),
    "op2_substring_dedup": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
        s AS (
            SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS seq
            FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d)),
        m AS (SELECT seq, min(doc_id) AS least FROM s GROUP BY seq),
        gone AS (
            SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i
            FROM s JOIN m USING (seq) WHERE least < doc_id),
        kept AS (
            SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text
            FROM w ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
        SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed,
               sha256(coalesce(text, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)
    """,
    "op6_decontamination": f"""
        WITH d AS (SELECT doc_id, {_ITEM_WORDS} AS ws FROM documents),
        b AS (SELECT item_id, {_ITEM_WORDS} AS ws FROM benchmark),
        bw AS (
            SELECT DISTINCT item_id, n, ws[i:i + n - 1] AS win
            FROM (SELECT item_id, ws, least(10, len(ws)) AS n, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i
                  FROM b WHERE len(ws) > 0)),
        hit AS (
            SELECT DISTINCT doc_id, i, s.n, item_id
            FROM (SELECT doc_id, n, ws[i:i + n - 1] AS win, i
                  FROM (SELECT doc_id, n, ws, unnest(range(1, len(ws) - n + 2)) AS i
                        FROM d, (SELECT DISTINCT n FROM bw))) s
            JOIN bw ON bw.win = s.win),
        c AS (
            SELECT doc_id, count(DISTINCT i) AS n_hit
            FROM (SELECT doc_id, unnest(range(i, i + n)) AS i FROM hit) GROUP BY doc_id),
        t AS (
            SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM hit GROUP BY doc_id)
        SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items,
               sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
    """,
    "op3_exact_dedup": f"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS points,
                   regexp_replace(coalesce(text, ''), {_SPACES}, '', 'g') AS norm
            FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER same AS keep_id,
               count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = first_value(doc_id) OVER same AS kept,
               sha256(norm) AS text_sha256
        FROM d
        WINDOW same AS (PARTITION BY norm ORDER BY points DESC, doc_id)
    """,
    "op4_chat_format": """
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, 'unknown') AS role,
                   CAST((row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'),
                                            coalesce(text, '')) - 1) // 256 AS BIGINT) AS block,
                   replace(coalesce(text, ''), '<|', '< |') || '<|im_end|>' AS body
            FROM conversations),
        r AS (
            SELECT t.*, s.speaker, t.role = s.speaker AS own,
                   CASE WHEN t.role = s.speaker THEN '<|im_start|>assistant' || chr(10)
                        ELSE '<|im_start|>user name='
                             || replace(regexp_replace(t.role, '\\s+', '_', 'g'), '<|', '< |') || chr(10) END AS head
            FROM t JOIN (SELECT DISTINCT conv_id, role AS speaker FROM t) s
                ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
        n AS (
            SELECT *, row_number() OVER (
                PARTITION BY conv_id, speaker, block ORDER BY turn NULLS FIRST, role, body) AS k
            FROM r),
        p AS (
            SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (
                PARTITION BY conv_id, speaker, block ORDER BY k
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
            FROM n),
        b AS (
            SELECT conv_id, speaker, block, CAST(count(*) AS INTEGER) AS n_turns,
                   CAST(count(*) FILTER (own) AS INTEGER) AS n_own,
                   string_agg(head || body || chr(10), '' ORDER BY k) AS rendered,
                   coalesce(list({'first': CAST(place + length(head) AS INTEGER),
                         'past': CAST(place + length(head) + length(body) AS INTEGER)} ORDER BY k)
                       FILTER (own), []) AS mask
            FROM p GROUP BY ALL)
        SELECT *, CAST(coalesce(sum(length(rendered)) OVER (
                   PARTITION BY conv_id, speaker ORDER BY block
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
        FROM b
    """,
}
