"""DuckDB SQL of the operators whose rows recursion or unrolled rounds can give."""

from __future__ import annotations


def crc32_sql(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes, four bits at a step; the steps' table follows from the polynomial."""

    def after_four_bits(n: int) -> int:
        for _ in range(4):
            n = (n >> 1) ^ (0xEDB88320 if n & 1 else 0)
        return n

    steps = "[" + ", ".join(f"{after_four_bits(n)}::UINTEGER" for n in range(16)) + "]"
    step = lambda c, n: f"xor(({steps})[CAST(xor({c}, {n}) & 15 AS INTEGER) + 1], {c} >> 4)"
    both = step(f"({step('c', 'b')})", "(b >> 4)")
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '[0-9A-F]{{2}}'), lambda h: CAST('0x' || h AS UINTEGER))"
    return f"xor(list_reduce({octets}, lambda c, b: {both}, 4294967295::UINTEGER), 4294967295::UINTEGER)"


def repair_sql() -> str:
    """From the last row to the first: for each of the states start, after s, u and a the cheapest (cost, edits, lines) of the rest."""
    line = "chr(10) || '{role}:' || {text}"
    user, assistant = line.format(role="user", text="''"), line.format(role="assistant", text="''")
    own = "chr(10) || role || ':' || text"
    as_user, as_assistant = line.format(role="user", text="text"), line.format(role="assistant", text="text")
    way = lambda cost, edit, lines, to: f"{{'c': v[{to}].c + {cost}, 'a': '{edit}' || v[{to}].a, 'l': {lines} || v[{to}].l}}"

    def read(state: int) -> str:
        """The best way from a state (from 1) that reads the row; structs compare by cost, then edits."""
        to, given = (4, as_assistant) if state == 3 else (3, as_user)
        ways = [way(3, "D", "''", state)]
        ways += [f"CASE WHEN initial = '{i}' AND NOT gone THEN {way('more', 'K', own, t)} END" for i, t in {1: [("s", 2), ("u", 3)], 2: [("u", 3)], 3: [("a", 4)], 4: [("u", 3)]}[state]]
        ways += [f"CASE WHEN NOT gone THEN {way('2 + more', 'R', given, to)} END"]
        return f"list_min([{', '.join(ways)}])"

    put = lambda x, role: f"{{'c': {x}.c + 2, 'a': 'I' || {x}.a, 'l': {role} || {x}.l}}"
    after = {1: [3, 4], 2: [3, 4], 3: [4], 4: [3]}

    def with_inserted(state: int) -> str:
        one = put(f"w[{after[state][0]}]", assistant if state == 3 else user)
        two = [f"{{'c': w[4].c + 4, 'a': 'II' || w[4].a, 'l': {user} || {assistant} || w[4].l}}"] if len(after[state]) > 1 else []
        return f"list_min([{', '.join([f'w[{state}]', one, *two])}])"

    both = f"{user} || {assistant}"
    closing = f"[{{'c': 0, 'a': '', 'l': ''}}, {{'c': 4, 'a': 'II', 'l': {both}}}, {{'c': 2, 'a': 'I', 'l': {assistant}}}, {{'c': 0, 'a': '', 'l': ''}}]"
    blank = r"[ \t\n\x0b\x0c\r]"
    return f"""
WITH RECURSIVE raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind FROM conversations),
hurt AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy FROM raw WHERE kind <> 0),
placed AS (SELECT *, left(role, 1) AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, left(text, 32), sha256(text), copy) AS n,
                  regexp_replace(text, '{blank}+$', '') AS trimmed FROM hurt),
faults AS (SELECT *, trimmed = '' AS blank, trimmed <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS duplicate,
                  lag(initial) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM placed),
coded AS (SELECT *, blank OR duplicate AS gone, NOT blank AND NOT duplicate AND right(trimmed, 1) NOT IN ('.', '!', '?') AS cut FROM faults),
rows_ AS (SELECT *, CASE WHEN cut THEN 1 ELSE 0 END AS more FROM coded),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(duplicate) AS duplicate, count_if(cut) AS truncated,
                  count_if(n > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(n) AS n FROM rows_ GROUP BY conv_id),
best AS (SELECT conv_id, n + 1 AS n, {closing} AS v FROM counts
         UNION ALL
         SELECT conv_id, n, [{', '.join(map(with_inserted, range(1, 5)))}] AS v FROM (
           SELECT b.conv_id AS conv_id, r.n AS n, [{', '.join(map(read, range(1, 5)))}] AS w
           FROM best b JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.n = b.n - 1)),
done AS (SELECT conv_id, v[1].c AS cost, v[1].a AS audit, sha256(substr(v[1].l, 2)) AS repaired_sha256 FROM best WHERE n = 1)
SELECT i.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal,
       coalesce(d.cost, 0) AS cost, coalesce(d.audit, '') AS audit, coalesce(d.repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM i.conv_id
"""


def codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Lloyd's rounds written out. Whole numbers that doubles hold exactly; an assignment is the least of 16 * distance + entry."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
near{r} AS MATERIALIZED (SELECT a.vec_id, a.p, min(CAST(list_dot_product(a.x, a.x) - 2 * list_dot_product(a.x, b.c) + list_dot_product(b.c, b.c) AS BIGINT) * {entries} + b.e) AS m
  FROM parts a JOIN book{r} b ON b.p = a.p GROUP BY ALL)""")
        if r < rounds:
            steps.append(f"""
sum{r} AS (SELECT p, e, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT a.p, n.m % {entries} AS e, unnest(a.x) AS x, unnest(range(len(a.x))) AS i FROM parts a JOIN near{r} n ON n.vec_id = a.vec_id AND n.p = a.p) GROUP BY ALL),
mean{r} AS (SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY i) AS c FROM sum{r} GROUP BY ALL),
book{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{r} b LEFT JOIN mean{r} m ON m.p = b.p AND m.e = b.e)""")
    return f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * CAST(x AS DOUBLE))) AS v FROM embeddings
              WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS x FROM kept, range({parts}) t(p)),
book0 AS MATERIALIZED (SELECT p, dense_rank() OVER (ORDER BY vec_id) - 1 AS e, x AS c FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {entries})),{','.join(steps)},
coded AS (SELECT vec_id, string_agg(printf('%02x', m % {entries}), '' ORDER BY p) AS code, CAST(sum(m // {entries}) AS BIGINT) AS error FROM near{rounds} GROUP BY vec_id),
books AS (SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM (SELECT p, e, unnest(c) AS x, unnest(range(len(c))) AS i FROM book{rounds}))
SELECT c.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, b.codebooks_sha256 FROM coded c JOIN kept k ON k.vec_id = c.vec_id CROSS JOIN books b
"""
