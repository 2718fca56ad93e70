"""SQL twins (DuckDB) of the corpus queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"



def _codes_sql(rounds: int) -> str:
    """Assignments and updates in turn, as common table expressions."""
    steps = []
    for r in range(rounds + 1):
        if r:
            steps.append(f"""
        moved{r} AS (
            SELECT p, e, list(x ORDER BY j) AS w FROM (
                SELECT p, e, j, CAST(floor_div AS BIGINT) AS x FROM (
                    SELECT p, e, j, sum(x) AS s, count(*) AS n,
                           CASE WHEN sum(x) >= 0 THEN sum(x) // count(*) ELSE -((-sum(x) + count(*) - 1) // count(*)) END AS floor_div
                    FROM (SELECT p, e, unnest(range(0, len(v))) AS j, unnest(v) AS x FROM assigned{r - 1}) GROUP BY p, e, j))
            GROUP BY p, e),
        book{r} AS (SELECT b.p, b.e, coalesce(m.w, b.w) AS w FROM book{r - 1} b LEFT JOIN moved{r} m USING (p, e))""")
        steps.append(f"""
        assigned{r} AS (
            SELECT vec_id, label, p, v, found.e AS e, found.d AS d FROM (
                SELECT vec_id, label, p, any_value(v) AS v, min(struct_pack(d := d, e := e)) AS found FROM (
                    SELECT vec_id, label, parts.p, v, e, CAST(list_sum([(v[i] - w[i]) * (v[i] - w[i]) for i in range(1, len(v) + 1)]) AS BIGINT) AS d
                    FROM parts JOIN book{r} USING (p)) GROUP BY vec_id, label, p))""")
    return f"""
        WITH kept AS (
            SELECT vec_id, label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
        parts AS (
            SELECT vec_id, label, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS v
            FROM (SELECT vec_id, label, v, unnest(range(0, 16)) AS p FROM kept)),
        book0 AS (
            SELECT p, rank() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v AS w FROM parts QUALIFY e < 64), {", ".join(steps)},
        coded AS (
            SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error
            FROM assigned{rounds} GROUP BY vec_id, label)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
               (SELECT sha256(string_agg(array_to_string(w, ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256
        FROM coded"""


ORACLE: dict[str, str] = {
    "op2_exact_dedup": f"""
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
        FROM (SELECT doc_id, {_LOWER} AS norm FROM documents)
        WINDOW same AS (PARTITION BY norm)""",
    "op8_substring_dedup": r"""
        WITH split AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        windows AS (
            SELECT doc_id, s, array_to_string(ws[s + 1 : s + 20], ' ') AS k
            FROM (SELECT doc_id, ws, unnest(range(0, len(ws) - 19)) AS s FROM split WHERE len(ws) >= 20)),
        later AS (
            SELECT doc_id, s FROM windows QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, s) > 1),
        gone AS (
            SELECT DISTINCT doc_id, s + j AS i FROM later, (SELECT unnest(range(0, 20)) AS j)),
        words AS (
            SELECT doc_id, unnest(ws) AS word, unnest(range(0, len(ws))) AS i FROM split),
        kept AS (
            SELECT doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY i) AS text
            FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
        SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n_kept, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
        FROM split LEFT JOIN kept USING (doc_id)""",
    "op11_lexical_search": r"""
        WITH split AS (
            SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents WHERE text IS NOT NULL),
        docs AS (SELECT doc_id, ts, len(ts) AS n FROM split WHERE len(ts) > 0),
        totals AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM docs),
        held AS (
            SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, n, unnest(ts) AS t FROM docs) GROUP BY ALL),
        weights AS (
            SELECT t, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
            FROM held, totals GROUP BY t),
        wanted AS (
            SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark WHERE text IS NOT NULL),
        asked AS (SELECT item_id, t, count(*) AS times FROM wanted GROUP BY ALL),
        scores AS (
            SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms)))) AS BIGINT) AS score
            FROM asked JOIN weights USING (t) JOIN held USING (t), totals GROUP BY item_id, doc_id)
        SELECT item_id, CAST(row_number() OVER best AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0
        WINDOW best AS (PARTITION BY item_id ORDER BY score DESC, doc_id)
        QUALIFY row_number() OVER best <= 10""",
    "op12_vector_codes": _codes_sql(rounds=2),
    "op13_warc": """
        WITH paid AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
        digests AS (SELECT page_id, payload, sha1(payload) AS hex, max(page_id) OVER (PARTITION BY payload) AS last FROM paid),
        bits AS (
            SELECT page_id, payload, last, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((
                       CAST('0x' || substr(hex, 5 * (i // 4) + 1, 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31), 1)
                   for i in range(0, 32)], '') AS digest
            FROM digests)
        SELECT page_id, strlen(payload) AS payload_bytes, digest AS payload_digest,
               CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> last THEN last END AS refers_to
        FROM bits""",
}
