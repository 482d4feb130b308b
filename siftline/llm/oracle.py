"""DuckDB SQL of the queries that SQL can express.

Not expressed: language ID, language model, packing, quality rules, paragraph dedup and mixing (hash functions, models, placements,
draws); they are tested against brute force.
"""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = {
    "op1_top_k": """
        WITH v AS (
            SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.id AS query_id, c.id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.id % 100 = 0 AND q.id <> c.id
        ), r AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10""",
    "op3_minhash_dedup": f"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, unnest(CASE
                WHEN len(w) = 0 THEN []
                WHEN len(w) = 1 THEN [w[1]]
                ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS shingle
            FROM w
        ), n AS (
            SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
        ), rare AS (
            SELECT shingle, count(*) AS f FROM s GROUP BY shingle
        ), ranked AS (
            -- two sets with 80 percent in common share one of the first fifth (and one more) in any common order
            SELECT s.doc_id, s.shingle, n.n,
                row_number() OVER (PARTITION BY s.doc_id ORDER BY f, s.shingle) AS place
            FROM s JOIN n USING (doc_id) JOIN rare USING (shingle)
        ), pairs AS (
            SELECT DISTINCT a.doc_id AS a, b.doc_id AS b
            FROM ranked a JOIN ranked b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
            WHERE a.place <= a.n - ceil(0.8 * a.n) + 1 AND b.place <= b.n - ceil(0.8 * b.n) + 1
        ), common AS (
            SELECT a, b, count(*) AS c FROM pairs JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b AND x.shingle = y.shingle
            GROUP BY a, b
        ), links AS (
            SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
            WHERE 100 * c >= 80 * (x.n + y.n - c)
        ), both_ways AS (
            SELECT a, b FROM links UNION SELECT b, a FROM links
        ), reach AS (
            SELECT doc_id AS a, doc_id AS b FROM documents
            UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a
        ), component AS (
            SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
        )
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
        FROM component LEFT JOIN n USING (doc_id)""",
    "op8_chat_format": r"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
            UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
        )
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn, r, t)) AS turns_sha256,
            CAST(sum(CASE WHEN r = 'assistant' THEN length(t) ELSE 0 END) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(t, '' ORDER BY turn, r, t) FILTER (WHERE r = 'assistant'), '')) AS loss_sha256,
            CAST(sum(length('<|im_start|>' || r || chr(10) || regexp_replace(t, '<(\\*)\|', '<\1\\|', 'g') || '<|im_end|>' || chr(10))) AS BIGINT)
                AS formatted_chars
        FROM c GROUP BY conv_id""",
    "op9_decontamination": f"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
        ), b AS (
            SELECT item_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
        ), win AS (
            SELECT DISTINCT item_id, least(len(w), 10) AS size,
                unnest(list_transform(range(1, greatest(len(w) - 10, 0) + 2), lambda i: array_to_string(w[i : i + 9], ' '))) AS phrase
            FROM b WHERE len(w) > 0
        ), sizes AS (
            SELECT DISTINCT size FROM win
        ), runs AS (
            SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS place,
                unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i : i + size - 1], ' '))) AS phrase
            FROM d, sizes WHERE len(w) >= size
        ), hits AS (
            SELECT r.doc_id, r.place, r.size, x.item_id FROM runs r JOIN win x ON r.phrase = x.phrase AND r.size = x.size
        ), hit_words AS (
            SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(place, place + size)) AS p FROM hits) GROUP BY doc_id
        ), hit_items AS (
            SELECT doc_id, count(*) AS n, string_agg(i, ',' ORDER BY i) AS items
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id
        )
        SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(i.n, 0) AS n_items,
            sha256(coalesce(i.items, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
        FROM d LEFT JOIN hit_words h USING (doc_id) LEFT JOIN hit_items i USING (doc_id)""",
    "op10_warc": """
        WITH p AS (
            SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
        ), f AS (
            SELECT h, payload_bytes, min(page_id) AS first FROM p GROUP BY h, payload_bytes
        )
        SELECT page_id, payload_bytes,
            array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                CAST(((CAST('0x' || substr(h, CAST(i // 8 * 10 + 1 AS INTEGER), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS INTEGER)) & 31) + 1 AS INTEGER), 1)), '')
                AS payload_digest,
            CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> first THEN first END AS refers_to
        FROM p JOIN f USING (h, payload_bytes)""",
    "op11_fill_in_middle": """
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
                regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u
            FROM documents
        ), k AS (
            SELECT *, len(u) AS n, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT)) AS k FROM d
        ), f AS (
            SELECT *, least(k[1] % (n + 1), k[2] % (n + 1)) AS a, greatest(k[1] % (n + 1), k[2] % (n + 1)) AS b,
                CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR k[3] % 100 >= 90 THEN 'plain'
                    WHEN k[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
            FROM k
        ), p AS (
            SELECT *, array_to_string(u[1 : a], '') AS prefix, array_to_string(u[a + 1 : b], '') AS middle,
                array_to_string(u[b + 1 :], '') AS suffix
            FROM f
        )
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
            CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN text
                WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
            sha256(text) AS restored_sha256
        FROM p""",
    "op12_importance_resampling": f"""
        WITH RECURSIVE bits AS (
            SELECT range AS b, range AS c, 0 AS k FROM range(256)
            UNION ALL
            SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
        ), crc AS (
            SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8
        ), both_tables AS (
            SELECT 0 AS kind, doc_id, text FROM documents UNION ALL SELECT 1, NULL, text FROM benchmark
        ), w AS (
            SELECT row_number() OVER () AS i, kind, doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
            FROM both_tables
        ), g AS (
            SELECT i, kind, unnest(list_concat(w, list_transform(range(1, len(w)), lambda j: w[j] || ' ' || w[j + 1]),
                list_transform(range(1, len(w) - 1), lambda j: w[j] || ' ' || w[j + 1] || ' ' || w[j + 2]))) AS feature
            FROM w
        ), words AS (
            SELECT DISTINCT feature, hex(encode(feature)) AS x FROM g
        ), hashed AS (
            SELECT feature, xor(4294967295, list_reduce(
                list_transform(range(0, len(x) // 2), lambda j: CAST('0x' || substr(x, 2 * j + 1, 2) AS BIGINT)),
                lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295)) % 10000 AS bucket
            FROM words, crc
        ), f AS (
            SELECT i, kind, bucket, count(*) AS n FROM g JOIN hashed USING (feature) GROUP BY ALL
        ), sums AS (
            SELECT bucket, coalesce(sum(n) FILTER (WHERE kind = 0), 0) AS s, coalesce(sum(n) FILTER (WHERE kind = 1), 0) AS t FROM f GROUP BY bucket
        ), totals AS (
            SELECT sum(s) AS all_s, sum(t) AS all_t FROM sums
        ), gains AS (
            SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (all_s + 10000)::DOUBLE / ((s + 1)::DOUBLE * (all_t + 10000)::DOUBLE))) AS gain
            FROM sums, totals
        ), weights AS (
            SELECT i, sum(n) AS n_features, sum(n * gain) AS weight FROM f JOIN gains USING (bucket) WHERE kind = 0 GROUP BY i
        ), scored AS (
            SELECT doc_id, len(w) AS n_words, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
                CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
            FROM w LEFT JOIN weights USING (i) WHERE kind = 0
        ), noisy AS (
            SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM scored
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS r,
                count(*) FILTER (WHERE n_words >= 20) OVER () AS n
            FROM noisy
        )
        SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND r <= n * 5 // 100 THEN r END AS rank FROM ranked""",
}
