"""DuckDB SQL for those llm queries that SQL can express."""

_BARE = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')"

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_DIGITS = " || ".join(
    f"substr('{_BASE32}', 1 + CAST((CAST('0x' || substr(h, {5 * j + 1}, 5) AS BIGINT) >> {s}) & 31 AS INT), 1)" for j in range(8) for s in (15, 10, 5, 0)
)



def _crc32(number: str) -> str:
    """Unsigned CRC-32 of the decimal digits of ``number``: each byte is mixed in, then eight times a bit is shifted out (-1)."""
    bits = f"flatten(list_transform(string_split(CAST({number} AS VARCHAR), ''), lambda x: [ascii(x), -1, -1, -1, -1, -1, -1, -1, -1]))"
    step = "CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END"
    return f"xor(4294967295, list_reduce(CAST({bits} AS BIGINT[]), lambda a, x: {step}, CAST(4294967295 AS BIGINT)))"


def _field(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE octet_length(encode(CAST({column} AS VARCHAR))) || ':' || CAST({column} AS VARCHAR) END"


_HEAD = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))

ORACLE = {
    "op1_ngram_join": f"""
        WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        c AS (SELECT w, min(doc_id) AS cls, count(*) AS n_copies FROM d GROUP BY w),
        s AS (SELECT DISTINCT cls, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                            WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM c),
        n AS (SELECT cls, count(*) AS n FROM s GROUP BY cls),
        i AS (SELECT a.cls AS a, b.cls AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.cls <> b.cls GROUP BY ALL),
        e AS (SELECT a, b FROM i JOIN n x ON x.cls = a JOIN n y ON y.cls = b WHERE k >= 0.8 * (x.n + y.n - k) - 1e-6),
        reach(node, low) AS (SELECT cls, cls FROM c UNION SELECT e.b, r.low FROM reach r JOIN e ON e.a = r.node),
        g AS (SELECT node AS cls, min(low) AS grp FROM reach GROUP BY node),
        l AS (SELECT a AS cls, count(*) AS n_links FROM e GROUP BY a)
        SELECT d.doc_id, CASE WHEN len(d.w) = 0 THEN d.doc_id ELSE grp END AS class_id, c.cls AS copy_of, n_copies, coalesce(n_links, 0) AS n_links
        FROM d JOIN c USING (w) JOIN g ON g.cls = c.cls LEFT JOIN l ON l.cls = c.cls""",
    "op4_warc": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
        d AS (SELECT page_id, octet_length(encode(t)) AS payload_bytes, sha1(t) AS h, max(page_id) OVER (PARTITION BY t) AS last FROM p)
        SELECT page_id, payload_bytes, {_DIGITS} AS payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> last THEN last END AS refers_to
        FROM d""",
    "op7_substring_dedup": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        p AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS p FROM d),
        k AS (SELECT doc_id, p, array_to_string(w[p:p + 34], ' ') AS k FROM p),
        t AS (SELECT k FROM k GROUP BY k HAVING count(*) > 1),
        g AS (SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS i FROM k JOIN t USING (k)),
        l AS (SELECT doc_id, list(i) AS gone FROM g GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
               sha256(array_to_string(list_filter(w, lambda x, i: NOT list_contains(coalesce(gone, []), i)), ' ')) AS kept_sha256
        FROM d LEFT JOIN l USING (doc_id)""",
    "op8_exact_dedup": f"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, {_BARE} AS norm FROM documents),
        k AS (SELECT norm, count(*) AS group_size, first(doc_id ORDER BY n DESC, doc_id) AS keep_id FROM d GROUP BY norm)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
        FROM d JOIN k USING (norm)""",
    "op12_conversation_trie": f"""
        WITH t AS (SELECT conv_id AS c, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
        o AS (SELECT c, list({{'r': r, 'x': x}} ORDER BY turn NULLS FIRST, sha256(octet_length(encode(r)) || ':' || r || x)) AS w, {_crc32("c")} % 9 AS h FROM t GROUP BY c),
        b AS (SELECT o.c, list_concat(coalesce(f.w, [])[1:o.h], o.w[o.h + 1:]) AS w FROM o LEFT JOIN o f ON f.c = o.c - o.c % 5),
        p AS (SELECT c, len(w) AS size, w, unnest(range(0, len(w) + 1)) AS depth FROM b),
        n AS (SELECT depth, w[1:depth] AS k, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(c, ',' ORDER BY c) FILTER (size = depth), '') AS ends FROM p GROUP BY ALL),
        m AS (SELECT n.*, u.conv_id AS parent_conv_id, (n.n_convs - 1) * coalesce(octet_length(encode(n.k[n.depth].x)), 0) AS own
              FROM n LEFT JOIN n u ON u.depth = n.depth - 1 AND u.k = n.k[1:n.depth - 1]),
        s AS (SELECT a.conv_id, a.depth, sum(d.own) AS saved_tokens, count(*) FILTER (d.depth = a.depth + 1) AS n_children,
                     count(*) FILTER (NOT EXISTS (SELECT 1 FROM n e WHERE e.depth = d.depth + 1 AND e.k[1:d.depth] = d.k)) AS n_leaves
              FROM m a JOIN m d ON d.depth >= a.depth AND d.k[1:a.depth] = a.k GROUP BY ALL)
        SELECT m.conv_id, m.depth, parent_conv_id, n_convs, n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(ends) AS ends_sha256
        FROM m JOIN s ON s.conv_id = m.conv_id AND s.depth = m.depth""",
    "op13_merkle_manifest": f"""
        WITH RECURSIVE d AS (
            SELECT doc_id, source, coalesce('=' || source, '') AS g, sha256({_HEAD} || {_field("text")}) AS leaf, {_HEAD} AS head,
                   CASE WHEN {_crc32("doc_id")} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS shown FROM documents),
        a AS (SELECT doc_id, g, leaf, sha256(head || {_field("shown")}) AS changed, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY g) AS n
              FROM d WINDOW w AS (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf)),
        t(lev, g, pos, n, h) AS (
            SELECT 0, g, pos, n, leaf FROM a
            UNION ALL
            SELECT DISTINCT lev + 1, g, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos) OVER (PARTITION BY g, pos // 3 ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
            FROM t WHERE n > 1),
        roots AS (SELECT g, h AS subroot, lev AS height, row_number() OVER (ORDER BY g) - 1 AS place, count(*) OVER () AS many FROM t WHERE n = 1),
        u(lev, pos, n, h) AS (
            SELECT 0, place, many, subroot FROM roots
            UNION ALL
            SELECT DISTINCT lev + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos) OVER (PARTITION BY pos // 3 ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
            FROM u WHERE n > 1),
        s AS (SELECT g, lev, pos, coalesce(string_agg(h, '' ORDER BY pos) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') || '|' ||
                     coalesce(string_agg(h, '' ORDER BY pos) OVER (r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS sib
              FROM (SELECT * FROM t WHERE n > 1) WINDOW r AS (PARTITION BY g, lev, pos // 3 ORDER BY pos)),
        v AS (SELECT lev, pos, coalesce(string_agg(h, '' ORDER BY pos) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') || '|' ||
                     coalesce(string_agg(h, '' ORDER BY pos) OVER (r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS sib
              FROM (SELECT * FROM u WHERE n > 1) WINDOW r AS (PARTITION BY lev, pos // 3 ORDER BY pos)),
        low AS (SELECT a.g, a.pos, list(s.sib ORDER BY s.lev) AS p FROM a JOIN s ON s.g = a.g AND s.pos = a.pos // CAST(pow(3, s.lev) AS BIGINT) GROUP BY ALL),
        high AS (SELECT roots.g, list(v.sib ORDER BY v.lev) AS p FROM roots JOIN v ON v.pos = roots.place // CAST(pow(3, v.lev) AS BIGINT) GROUP BY ALL),
        e AS (SELECT a.*, subroot, list_concat(coalesce(low.p, []), coalesce(high.p, [])) AS proof
              FROM a JOIN roots ON roots.g = a.g LEFT JOIN low ON low.g = a.g AND low.pos = a.pos LEFT JOIN high ON high.g = a.g),
        f AS (SELECT *, (SELECT h FROM u WHERE n = 1) AS root, list_reduce(proof, lambda h, x: sha256(split_part(x, '|', 1) || h || split_part(x, '|', 2)), changed) AS folded_root FROM e)
        SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(proof, ''), '|', '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM f""",
}
