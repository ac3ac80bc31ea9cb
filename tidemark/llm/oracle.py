"""DuckDB SQL of those corpus queries that SQL can express."""

#: A table of the CRC-32 of single bytes, and the CRC-32 of a text given that table.
_CRC_TABLE = """SELECT list(c ORDER BY n) AS crc FROM (
        SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(n))"""


def _crc32(text: str) -> str:
    return f"""xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: CAST('0x' || x AS BIGINT))),
        lambda c, b: xor(crc[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"""


def _least(*ways: str) -> str:
    """The least of several (cost, audit, text) that are not null."""
    return f"list_sort(list_filter([{', '.join(ways)}], lambda w: w IS NOT NULL))[1]"


def _way(item: str, cost: int | str, edit: str, line: str | None = None) -> str:
    """A way that goes on from another: NULL where that is."""
    text = f"{item}.txt" if line is None else f"CASE WHEN {item}.audit = translate({item}.audit, 'IKR', '') THEN {line} ELSE {item}.txt || chr(10) || {line} END"
    return f"CASE WHEN {item} IS NOT NULL THEN {{'cost': {item}.cost + {cost}, 'audit': {item}.audit || '{edit}', 'txt': {text}}} END"


def _kept(item: str, initial: str) -> str:
    return f"CASE WHEN r.ok AND r.role[1] = '{initial}' THEN {_way(item, 'r.late', 'K', 'r.role || chr(58) || r.text')} END"


def _reroled(item: str, role: str) -> str:
    return f"CASE WHEN r.ok THEN {_way(item, '2 + r.late', 'R', f"'{role}:' || r.text")} END"

ORACLE_SQL = {
    "op4_sharding": """
        WITH contest AS (
            SELECT doc_id, text, s.shard,
                   substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || CAST(s.shard AS VARCHAR)), 1, 13) AS score
            FROM documents CROSS JOIN (SELECT CAST(range AS INTEGER) AS shard FROM range(41)) s
        ), crc_table AS (
            SELECT list(c ORDER BY n) AS crc FROM (
                SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, k:
                    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
                FROM range(256) r(n))
        ), spelled AS (
            SELECT doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
                                          lambda x: CAST('0x' || x AS BIGINT)) AS bytes
            FROM documents
        ), sums AS (
            SELECT doc_id, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda c, b:
                       xor(crc[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS text_crc32
            FROM spelled, crc_table
        ), won AS (
            SELECT doc_id, any_value(text) AS text,
                   arg_max(shard, score || printf('%02d', 40 - shard)) FILTER (WHERE shard < 40) AS shard,
                   arg_max(shard, score || printf('%02d', 40 - shard)) AS grown_shard
            FROM contest GROUP BY doc_id
        )
        SELECT doc_id, CAST(strlen(coalesce(text, '')) + 16 AS BIGINT) AS size,
               CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, shard,
               CAST(row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS BIGINT) AS slot, grown_shard
        FROM won JOIN sums USING (doc_id)
    """,
    "op3_minhash": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS ws FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL
        ), docs AS (SELECT count(*) AS n FROM documents WHERE text IS NOT NULL),
        tokens AS (SELECT doc_id, i, ws[i] AS word, len(ws) AS n FROM (SELECT doc_id, ws, CAST(unnest(range(1, len(ws) + 1)) AS BIGINT) AS i FROM words)),
        spans AS (
            SELECT doc_id, n, i, list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS shingle FROM tokens
        ), tf AS (SELECT doc_id, shingle, count(*) AS tf FROM spans WHERE i <= greatest(1, n - 4) GROUP BY doc_id, shingle),
        df AS (SELECT shingle, count(*) AS df FROM tf GROUP BY shingle),
        sets AS (
            SELECT doc_id, shingle, tf * (ln(n / greatest(df, n / 10000)) + 1) AS w
            FROM tf JOIN df USING (shingle), docs
        ), total AS (SELECT doc_id, sum(w) AS t FROM sets GROUP BY doc_id),
        shared AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.w, b.w)) AS s FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
        near AS (
            SELECT a, b FROM shared JOIN total x ON x.doc_id = a JOIN total y ON y.doc_id = b WHERE s >= 0.8 * (x.t + y.t - s)
            UNION SELECT a.doc_id, b.doc_id FROM documents a JOIN documents b ON a.text = b.text AND a.doc_id < b.doc_id
        ), links AS (SELECT a, b FROM near UNION SELECT b, a FROM near),
        reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a)
        SELECT doc_id, min(other) AS class_id, min(other) = doc_id AS kept FROM reach GROUP BY doc_id
    """,
    "op6_vectors": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            WHERE list_cosine_similarity(a.e, b.e) >= 0.93
        ), reach(vec_id, other) AS (
            SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a
        ), counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
        SELECT e.vec_id, coalesce(any_value(n), 0) AS n_links, min(other) AS component_id, min(other) = e.vec_id AS kept
        FROM embeddings e JOIN reach USING (vec_id) LEFT JOIN counts USING (vec_id) GROUP BY e.vec_id
    """,
    "op9_repeats": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
        starts AS (SELECT doc_id, h, CAST(unnest(range(n - 99)) AS BIGINT) AS s FROM d WHERE n >= 100),
        windows AS (SELECT doc_id, s, md5(substr(h, 2 * s + 1, 200)) AS w FROM starts),
        again AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY w ORDER BY doc_id, s) AS k FROM windows) WHERE k > 1),
        marked AS (SELECT doc_id, s, CASE WHEN s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 1 ELSE 0 END AS fresh FROM again),
        runs AS (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM marked),
        gone AS (SELECT doc_id, run, min(s) AS a, max(s) + 100 AS b FROM runs GROUP BY doc_id, run),
        kept AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS f, a AS t FROM gone
                 UNION ALL SELECT doc_id, max(b), NULL FROM gone GROUP BY doc_id),
        cut AS (SELECT k.doc_id, string_agg(substr(h, 2 * f + 1, 2 * (coalesce(t, n) - f)), '' ORDER BY f) AS h FROM kept k JOIN d USING (doc_id) GROUP BY k.doc_id),
        sums AS (SELECT doc_id, count(*) AS spans, CAST(sum(b - a) AS BIGINT) AS removed FROM gone GROUP BY doc_id)
        SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(cut.h, d.h))) AS kept_sha256
        FROM d LEFT JOIN cut USING (doc_id) LEFT JOIN sums USING (doc_id)
    """,
    "op2_language": r"""
        WITH crc_table AS (
            SELECT list(c ORDER BY n) AS crc FROM (
                SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
                FROM range(256) r(n))
        ), d AS (
            SELECT doc_id, text, lang, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
                       list_transform(regexp_extract_all(hex(encode(CAST(doc_id AS VARCHAR))), '..'), lambda x: CAST('0x' || x AS BIGINT))),
                       lambda c, b: xor(crc[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 3 = 1 AS held_out
            FROM documents, crc_table
        ), words AS (
            SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS word FROM d) GROUP BY 1, 2
        ), spelled AS (
            SELECT word, substr('_' || word || '_', CAST(i AS INTEGER) + 1, k) AS g
            FROM (SELECT word, k, unnest(range(length(word) + 3 - k)) AS i FROM (SELECT DISTINCT word FROM words), (VALUES (1), (2), (3), (4)) t(k))
        ), grams AS (
            SELECT doc_id, g, sum(n * m) AS c FROM words JOIN (SELECT word, g, count(*) AS m FROM spelled WHERE g <> '_' GROUP BY 1, 2) USING (word) GROUP BY 1, 2
        ), known AS (
            SELECT doc_id, lang, CAST('0x' || substr(md5('sample:' || CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) / pow(16, 13) * count(*) OVER (PARTITION BY lang) AS place
            FROM d WHERE NOT held_out AND lang IS NOT NULL AND text IS NOT NULL
        ), profiles AS (
            SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY c DESC, g) AS place
            FROM (SELECT lang, g, sum(c) AS c FROM grams JOIN known USING (doc_id) WHERE known.place < 1500 GROUP BY 1, 2) QUALIFY place <= 400
        ), own AS (
            SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, g) AS place FROM grams QUALIFY place <= 400
        ), far AS (
            SELECT doc_id, l.lang, CAST(sum(coalesce(abs(o.place - p.place), 400)) AS BIGINT) AS away
            FROM own o CROSS JOIN (SELECT DISTINCT lang FROM profiles) l LEFT JOIN profiles p ON p.lang = l.lang AND p.g = o.g GROUP BY 1, 2
        ), best AS (
            SELECT doc_id, first(lang ORDER BY away, lang) AS lang_pred, list(away ORDER BY away) AS sums FROM far GROUP BY doc_id
        )
        SELECT d.doc_id, held_out, coalesce(lang_pred, 'und') AS lang_pred, coalesce(1 - sums[1] / sums[2], 0) AS score
        FROM d LEFT JOIN best USING (doc_id)
    """,
    "op11_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        )
        SELECT q.vec_id AS query_id, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.e, c.e) DESC, c.vec_id) AS INTEGER) AS rank,
               c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
        FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 100 = 0 QUALIFY rank <= 10
    """,
    "op12_filter_audit": r"""
        WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
        worded AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY text) AS least FROM d),
        marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
        judged AS (
            SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                   list_filter([CASE WHEN len(ws) < 200 THEN 'A' END, CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' END,
                                CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 'C' END,
                                CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' END, CASE WHEN least < doc_id THEN 'E' END], lambda x: x IS NOT NULL) AS fails
            FROM worded LEFT JOIN marks USING (doc_id)
        ), kinds AS (SELECT part, fails, count(*) AS n, CAST(sum(good) AS BIGINT) AS g, CAST(sum(toxic) AS BIGINT) AS t FROM judged GROUP BY 1, 2),
        letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
        orders AS (
            SELECT a.x || b.x || c.x || e.x || f.x AS filter_order FROM letters a, letters b, letters c, letters e, letters f
            WHERE len(list_distinct([a.x, b.x, c.x, e.x, f.x])) = 5
        ), steps AS (SELECT filter_order, CAST(unnest(range(1, 6)) AS INTEGER) AS step FROM orders),
        told AS (
            SELECT part, filter_order, step, n, g, t, fails, filter_order[step] AS own, list_has_any(fails, string_split(left(filter_order, step - 1), '')) AS gone FROM kinds, steps
        ), counted AS (
            SELECT part, filter_order, step, any_value(own) AS own, coalesce(sum(n) FILTER (NOT gone AND NOT list_contains(fails, own)), 0) AS kept,
                   coalesce(sum(n) FILTER (NOT gone AND list_contains(fails, own)), 0) AS removed, coalesce(sum(n) FILTER (gone AND list_contains(fails, own)), 0) AS redundant,
                   coalesce(sum(n) FILTER (fails = [own]), 0) AS unique_fails, coalesce(sum(g) FILTER (NOT gone AND list_contains(fails, own)), 0) AS good_lost,
                   coalesce(sum(t) FILTER (NOT gone AND list_contains(fails, own)), 0) AS toxic_lost
            FROM told GROUP BY 1, 2, 3
        )
        SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
               CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM counted
    """,
    "op13_conversation_repair": rf"""
        WITH RECURSIVE crc_table AS ({_CRC_TABLE}),
        named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
        hashed AS (SELECT n.*, {_crc32('name')} % 20 AS kind FROM named n, crc_table),
        damaged AS (
            SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS again,
                   CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM hashed WHERE kind <> 0
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS k,
                   lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before FROM damaged
        ), judged AS (
            SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN k > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM placed
        ), r AS (SELECT *, fault NOT IN ('blank', 'duplicate') AS ok, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS late FROM judged),
        chart AS (
            SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, {{'cost': 0, 'audit': '', 'txt': ''}} AS z, CAST(NULL AS STRUCT(cost INTEGER, audit VARCHAR, txt VARCHAR)) AS s,
                   CAST(NULL AS STRUCT(cost INTEGER, audit VARCHAR, txt VARCHAR)) AS u, CAST(NULL AS STRUCT(cost INTEGER, audit VARCHAR, txt VARCHAR)) AS a FROM conversations
            UNION ALL
            SELECT conv_id, i, {_least(_way('z', 3, 'D'))}, {_least(_way('s', 3, 'D'), _kept('z', 's'))},
                   {_least(_way('u', 3, 'D'), *[f(x, y) for x in ('z', 's', 'a1') for f, y in ((_kept, 'u'), (_reroled, 'user'))])},
                   {_least(_way('a', 3, 'D'), _kept('u1', 'a'), _reroled('u1', 'assistant'))}
            FROM (
                SELECT r.conv_id, r.i, z, s, u, a, u1, {_least('a', _way('u1', 2, 'I', "'assistant:'"))} AS a1, r
                FROM (SELECT *, {_least('u', *[_way(x, 2, 'I', "'user:'") for x in 'zsa'])} AS u1 FROM chart) c JOIN r ON r.conv_id IS NOT DISTINCT FROM c.conv_id AND r.i = c.i + 1
            ) q
        ), last AS (SELECT *, {_least('u', *[_way(x, 2, 'I', "'user:'") for x in 'zsa'])} AS u1 FROM chart QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
        won AS (SELECT conv_id, {_least('z', 'a', _way('u1', 2, 'I', "'assistant:'"))} AS w FROM last),
        counts AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                   count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i > 1 AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id
        )
        SELECT w.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               CAST(w.w.cost AS BIGINT) AS cost, w.w.audit AS audit, sha256(w.w.txt) AS repaired_sha256 FROM won w LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id
    """,
}
