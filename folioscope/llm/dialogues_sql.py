"""The SQL twin of conversation repair: the same grammar as a table of states, folded over each conversation's turns."""

#: crc32 of the bytes of ASCII text as a fold: a byte is mixed in, then eight steps (-1) follow.
CRC32 = """xor(list_reduce(flatten(list_transform(string_split({0}, ''), lambda ch: [CAST(ascii(ch) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) ELSE xor(c >> 1, (c & 1) * 3988292384) END, CAST(4294967295 AS BIGINT)), 4294967295)"""

#: States: 0 nothing yet, 1 after the system's turn, 2 after a user's, 3 after an assistant's; 0 and 3 may end.
SQL = (
    r"""
    WITH RECURSIVE
    given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        """
    + CRC32.format("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")
    + r""" % 20 AS kind FROM conversations),
    turns AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
        CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
        FROM given, (VALUES (0), (1)) copies(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS final FROM turns),
    faulty AS MATERIALIZED (SELECT *, left(role, 1) AS initial, CASE WHEN final = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN final NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
        lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM numbered),
    steps(a, initial, b) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
    inserts(a, n, b) AS (VALUES (0, 0, 0), (1, 0, 1), (2, 0, 2), (3, 0, 3), (0, 1, 2), (1, 1, 2), (3, 1, 2), (2, 1, 3), (0, 2, 3), (1, 2, 3), (3, 2, 3), (2, 2, 2)),
    moves AS MATERIALIZED (
        SELECT f.conv_id, f.i, m.a, m.b, m.cost, m.letter FROM faulty f, (
            SELECT a, b, 0 AS cost, 'K' AS letter, initial FROM steps UNION ALL SELECT a, b, 1, 'R', NULL FROM steps WHERE initial <> 's'
            UNION ALL SELECT s, s, 2, 'D', NULL FROM (VALUES (0), (1), (2), (3)) v(s)) m
        WHERE CASE m.letter WHEN 'D' THEN true ELSE f.fault NOT IN (1, 2) AND (m.letter = 'R' OR m.initial = f.initial) END),
    chart AS (
        SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS state, CAST(0 AS BIGINT) AS cost, '' AS audit FROM (SELECT DISTINCT conv_id FROM faulty)
        UNION ALL
        SELECT conv_id, i, state, best.cost, best.audit FROM (
            SELECT c.conv_id, c.i + 1 AS i, m.b AS state, min({'cost': c.cost + 5 * n.n + m.cost + CASE WHEN f.fault = 3 AND m.letter <> 'D' THEN 5 ELSE 0 END, 'audit': c.audit || repeat('I', n.n) || m.letter}) AS best
            FROM chart c JOIN inserts n ON n.a = c.state JOIN moves m ON m.conv_id IS NOT DISTINCT FROM c.conv_id AND m.i = c.i + 1 AND m.a = n.b JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM c.conv_id AND f.i = c.i + 1
            GROUP BY c.conv_id, c.i, m.b)),
    ends AS (SELECT conv_id, max(i) AS i FROM faulty GROUP BY conv_id),
    parsed AS MATERIALIZED (SELECT c.conv_id, min({'cost': c.cost + 5 * n.n, 'audit': c.audit || repeat('I', n.n)}) AS best
        FROM chart c JOIN ends e ON e.conv_id IS NOT DISTINCT FROM c.conv_id AND e.i = c.i JOIN inserts n ON n.a = c.state WHERE n.b IN (0, 3) GROUP BY c.conv_id),
    letters AS (SELECT conv_id, best.audit AS audit, unnest(range(1, CAST(length(best.audit) AS BIGINT) + 1)) AS k FROM parsed),
    placed AS (SELECT conv_id, k, audit[k] AS letter, sum(CASE WHEN audit[k] <> 'I' THEN 1 ELSE 0 END) OVER w AS i, sum(CASE WHEN audit[k] <> 'D' THEN 1 ELSE 0 END) OVER w AS place,
        length(replace(audit, 'D', '')) % 2 AS headed FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
    repaired AS (SELECT p.conv_id, string_agg(CASE WHEN letter = 'K' THEN f.role WHEN (place - headed) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE f.text END, chr(10) ORDER BY k) AS whole
        FROM placed p LEFT JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i WHERE letter <> 'D' GROUP BY p.conv_id),
    counted AS (SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
        count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY conv_id)
    SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
        CAST(coalesce(p.best.cost, 0) AS BIGINT) AS cost, coalesce(p.best.audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
    LEFT JOIN parsed p ON p.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM o.conv_id
"""
)
