"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations


def either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


WORDS = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
KEYWORDS = "|".join(map(either_case, ("password", "passwd", "secret", "token", "api_?key")))

#: kind, pattern, group whose length counts, least length
SECRETS = (
    ("assign", rf"""({KEYWORDS})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
    ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("forge", "gh[pousr]_[A-Za-z0-9]+", 0, 40),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
)
HITS = " UNION ALL ".join(
    f"SELECT doc_id, {rank} AS rank, '{kind}' AS kind, {least} AS least, regexp_extract_all(t, '{pattern}', 0) AS hits, "
    f"regexp_extract_all(t, '{pattern}', {group}) AS parts, string_split_regex(t, '{pattern}') AS pieces FROM d"
    for rank, (kind, pattern, group, least) in enumerate(SECRETS))

ORACLE: dict[str, str] = {
    "op1_lm_scoring": f"""
        WITH w AS (SELECT doc_id, {WORDS.format("lower(coalesce(text, ''))")} AS words FROM documents),
             t AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM w),
             v AS (SELECT word, row_number() OVER (ORDER BY n DESC, word) + 1 AS id
                   FROM (SELECT word, count(*) AS n FROM t GROUP BY 1) WHERE n * 4000 >= (SELECT count(*) FROM t)),
             size AS (SELECT count(*) + 2 AS size FROM v),
             chain AS (SELECT doc_id, pos, coalesce(v.id, 0) AS id FROM t LEFT JOIN v USING (word)
                       UNION ALL SELECT doc_id, 0, 1 FROM w
                       UNION ALL SELECT doc_id, len(words) + 1, 1 FROM w),
             pairs AS (SELECT * FROM (SELECT doc_id, lag(id) OVER (PARTITION BY doc_id ORDER BY pos) AS a, id AS b FROM chain)
                       WHERE a IS NOT NULL),
             good AS (SELECT doc_id FROM labels GROUP BY 1 HAVING min(quality) = 1 AND coalesce(max(toxic), 0) = 0),
             c AS (SELECT a, b, count(*) AS n_all, count(good.doc_id) AS n_target FROM pairs LEFT JOIN good USING (doc_id) GROUP BY 1, 2),
             total AS (SELECT CASE WHEN sum(n_target) > 0 THEN sum(n_target)::DOUBLE / sum(n_all) ELSE 1 END AS scale FROM c),
             m AS (SELECT a, b, n_target::DOUBLE AS target, n_all * (SELECT scale FROM total) AS back FROM c),
             after AS (SELECT a, sum(target) AS target, sum(back) AS back FROM m GROUP BY 1),
             alone AS (SELECT b, (sum(target) + 1) / ((SELECT sum(target) FROM m) + (SELECT size FROM size)) AS target,
                              (sum(back) + 1) / ((SELECT sum(back) FROM m) + (SELECT size FROM size)) AS back FROM m GROUP BY 1),
             loss AS (SELECT m.a, m.b, -ln((m.target + 2 * alone.target) / (after.target + 2)) AS target,
                             -ln((m.back + 2 * alone.back) / (after.back + 2)) AS back
                      FROM m JOIN after ON m.a = after.a JOIN alone ON m.b = alone.b),
             s AS (SELECT doc_id, count(*) AS n_tokens, sum(target) AS target, sum(back) AS back FROM pairs JOIN loss USING (a, b) GROUP BY 1),
             o AS (SELECT doc_id, word, count(*) AS times FROM t ANTI JOIN v USING (word) GROUP BY 1, 2),
             u AS (SELECT word, sum(times) FILTER (good.doc_id IS NOT NULL) AS n_target, sum(times) AS n_all
                   FROM o LEFT JOIN good USING (doc_id) GROUP BY 1),
             all_u AS (SELECT coalesce(sum(n_target), 0) AS n_target, sum(n_all) AS n_all, count(*) AS words FROM u),
             l AS (SELECT word, -ln((coalesce(u.n_target, 0) + 1)::DOUBLE / (all_u.n_target + all_u.words)) AS target,
                          -ln((u.n_all * scale + 1) / (all_u.n_all * scale + all_u.words)) AS back FROM u, all_u, total),
             within AS (SELECT doc_id, sum(times * target) AS target, sum(times * back) AS back FROM o JOIN l USING (word) GROUP BY 1),
             f AS (SELECT doc_id, n_tokens, (s.target + coalesce(within.target, 0)) / n_tokens AS target,
                          (s.back + coalesce(within.back, 0)) / n_tokens AS back FROM s LEFT JOIN within USING (doc_id))
        SELECT doc_id, n_tokens, round(target, 6) AS target_loss, round(back, 6) AS background_loss, round(target - back, 6) AS score FROM f""",
    "op2_secret_scan": f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
             h AS ({HITS}),
             s AS (SELECT doc_id, rank, kind, length(hits[i]) AS size, length(parts[i]) >= least AS holds,
                          list_sum(list_transform(pieces[1:i], lambda x: length(x)))
                          + list_sum(list_transform(hits[1:i], lambda x: length(x))) AS stop
                   FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM h)),
             f AS (SELECT doc_id, rank, kind, (stop - size)::BIGINT AS start,
                          kind || ':' || (stop - size)::BIGINT || ':' || stop::BIGINT AS span FROM s WHERE holds),
             g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
                          count(*) FILTER (kind = 'hex') AS n_hex,
                          string_agg(span, ',' ORDER BY start, rank) FILTER (rank < 3) AS base,
                          string_agg(span, ',' ORDER BY start, rank) AS spans FROM f GROUP BY 1)
        SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
               sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, sha256(t) AS blob
        FROM d LEFT JOIN g USING (doc_id)""",
    "op4_warc_bundles": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
             d AS (SELECT page_id, octet_length(encode(payload)) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
             f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY 1)
        SELECT d.page_id, d.payload_bytes, d.payload_digest,
               CASE WHEN f.first IS NULL OR f.first = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN f.first <> d.page_id THEN f.first END AS refers_to
        FROM d LEFT JOIN f USING (payload_digest)""",
    "op8_minhash_dedup": f"""
        WITH RECURSIVE
             w AS (SELECT doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS words
                   FROM documents),
             s AS (SELECT doc_id, CASE WHEN len(words) < 2 THEN words ELSE list_distinct(list_transform(range(1, len(words)),
                          lambda i: words[i] || ' ' || words[i + 1])) END AS parts FROM w),
             e AS (SELECT doc_id, unnest(parts) AS part, len(parts) AS n FROM s),
             l AS (SELECT x.doc_id AS a, y.doc_id AS b FROM e x JOIN e y
                   ON x.part = y.part AND x.doc_id < y.doc_id AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
                   GROUP BY 1, 2, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
             ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
             reach AS (SELECT doc_id AS a, doc_id AS b FROM documents
                       UNION SELECT reach.a, ways.b FROM reach JOIN ways ON reach.b = ways.a),
             c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
        SELECT doc_id, len(parts) AS n_shingles, component_id, component_id = doc_id AS kept FROM s JOIN c USING (doc_id)""",
    "op12_ranked_search": """
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                          '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS words FROM documents),
             n AS (SELECT doc_id, len(words) AS n FROM d WHERE len(words) > 0),
             total AS (SELECT count(*) AS N, sum(n)::BIGINT AS L FROM n),
             t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(words) AS term FROM d) GROUP BY 1, 2),
             w AS (SELECT term, floor(1000 * ln((2 * (SELECT N FROM total) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM t GROUP BY 1),
             q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                          '[0-9a-z\\x{80}-\\x{10FFFF}]+')) AS term FROM benchmark),
             s AS (SELECT item_id, doc_id, sum(w.w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n.n * total.N) // total.L))))::BIGINT AS score
                   FROM q JOIN t USING (term) JOIN w USING (term) JOIN n USING (doc_id), total GROUP BY 1, 2)
        SELECT item_id, rank::INTEGER AS rank, doc_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 20""",
    "op13_vector_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
             s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
                   FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
        SELECT query_id, rank::INTEGER AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
}
