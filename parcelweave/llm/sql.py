"""SQL equivalents of operators that need more than a few lines of it."""

from __future__ import annotations

from parcelweave.llm import near, quality

_WORD = r"[^\x20\x09-\x0D]"

_QUALITY = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT r, unnest(range(len(l))) AS i, unnest(l) AS word
  FROM (SELECT r, regexp_extract_all(text, '__WORD__+') AS l FROM d)
),
g AS (
  SELECT r, i, length(word) AS n, __GRAMS__ FROM w WINDOW o AS (PARTITION BY r ORDER BY i)
),
f AS (SELECT r, i, n, __FLAGS__ FROM g),
c AS (SELECT r, i, n, __COVERED__ FROM f WINDOW o AS (PARTITION BY r ORDER BY i)),
words AS (SELECT r, count(*) AS n_words, sum(n) AS word_chars, __SUMS__ FROM c GROUP BY r),
tops AS (SELECT r, __TOPS__ FROM f GROUP BY r),
lines AS (
  SELECT r, line, row_number() OVER (PARTITION BY r, line) > 1 AS later,
    list_sum(list_transform(regexp_extract_all(line, '__WORD__+'), lambda x: length(x))) AS n
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '__WORD__')
),
dup AS (SELECT r, count(*) FILTER (later) AS n_dup_lines, sum(n) FILTER (later) AS dup_line_chars FROM lines GROUP BY r),
m AS (
  SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(dup_line_chars, 0)::BIGINT AS dup_line_chars, __MEASURES__
  FROM d LEFT JOIN words USING (r) LEFT JOIN tops USING (r) LEFT JOIN dup USING (r)
)
SELECT *, __BASE__ AS base_failed,
  NOT (__BASE__ OR __OVER__ OR 100 * dup_line_chars > __LINES__ * word_chars) AS kept
FROM m
"""


def quality_sql(rules: quality.Rules) -> str:
    """Measures and verdict of every document: windows over words, one column for each n-gram length."""
    later, top = rules.repeated, rules.top

    def gram(k: int) -> str:
        words = ", ".join(["word", *[f"lead(word, {j}) OVER o" for j in range(1, k)]])
        return f"CASE WHEN lead(i, {k - 1}) OVER o IS NOT NULL THEN concat_ws(' ', {words}) END AS g{k}"

    def size(k: int) -> str:
        return " + ".join(["length(word)", *[f"lead(length(word), {j}) OVER o" for j in range(1, k)]]) + f" AS c{k}"

    def times(k: int) -> str:
        return f"count(*) OVER (PARTITION BY r, g{k})"

    def covered(flag: str, k: int) -> str:
        return f"max({flag}::INT) OVER (o ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"

    names = [f"dup_{k}_chars" for k in later] + [f"top_{k}_chars" for k in top]
    limits = [*later.values(), *top.values()]
    parts = {
        "GRAMS": [*map(gram, sorted({3, *later, *top})), *map(size, top)],
        "FLAGS": [
            f"g3 IS NOT NULL AND {times(3)} > 1 AS again",
            *[f"g{k} IS NOT NULL AND row_number() OVER (PARTITION BY r, g{k} ORDER BY i) > 1 AS later{k}" for k in later],
            *[f"CASE WHEN g{k} IS NOT NULL AND {times(k)} > 1 THEN {times(k)} * c{k} ELSE 0 END AS t{k}" for k in top],
        ],
        "COVERED": [f"{covered('again', 3)} AS v", *[f"{covered(f'later{k}', k)} AS v{k}" for k in later]],
        "SUMS": ["sum(v) AS n_repeat_words", *[f"sum(n * v{k}) AS dup_{k}_chars" for k in later]],
        "TOPS": [f"max(t{k}) AS top_{k}_chars" for k in top],
        "MEASURES": [f"coalesce({name}, 0)::BIGINT AS {name}" for name in names],
    }
    sql = _QUALITY
    for mark, columns in parts.items():
        sql = sql.replace(f"__{mark}__", ", ".join(columns))
    over = " OR ".join(f"100 * {name} > {limit} * word_chars" for name, limit in zip(names, limits))
    base = f"n_words < {rules.least_words} OR 100 * n_repeat_words > {rules.most_repeat_words} * n_words"
    sql = sql.replace("__OVER__", over).replace("__BASE__", base).replace("__LINES__", str(rules.repeated_lines))
    return sql.replace("__WORD__", _WORD)


_NEAR = r"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
g AS (
  SELECT r, doc_id, CASE WHEN len(w) >= __N__ THEN list_sort(list_distinct(list_transform(range(1, len(w) - __N__ + 2), lambda i: array_to_string(w[i:i + __N__ - 1], ' '))))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] END AS s FROM d
),
k AS (SELECT *, md5(array_to_string(s, chr(10))) AS key FROM g),
sets AS (SELECT key, any_value(s) AS s, min(doc_id) AS head, count(*) AS n_copies FROM k WHERE s IS NOT NULL GROUP BY key),
u AS (SELECT key, len(s) AS n, unnest(s) AS x FROM sets),
pairs AS (
  SELECT a.key AS a, b.key AS b FROM u a JOIN u b ON a.x = b.x AND a.key < b.key GROUP BY ALL
  HAVING count(*) >= __THRESHOLD__::DOUBLE * (any_value(a.n) + any_value(b.n) - count(*))
),
edges AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT key AS a, key AS b FROM sets UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
class AS (SELECT r.a AS key, min(s.head) AS class_id FROM reach r JOIN sets s ON s.key = r.b GROUP BY r.a),
links AS (SELECT a AS key, count(*) AS n_links FROM edges GROUP BY a)
SELECT k.doc_id, CASE WHEN k.s IS NULL THEN k.doc_id ELSE class_id END AS class_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(n_copies, 1)::BIGINT AS n_copies
FROM k LEFT JOIN sets USING (key) LEFT JOIN class USING (key) LEFT JOIN links USING (key)
"""


def near_sql(settings: near.Settings) -> str:
    """Classes and links by comparing all sets that share an n-gram."""
    return _NEAR.replace("__N__", str(settings.n)).replace("__THRESHOLD__", str(settings.threshold))


def crc32_sql(text: str) -> str:
    """Unsigned crc32 of an ASCII text, bit by bit."""
    byte = "list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))"
    codes = f"list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda a, b: {byte}), 4294967295)"


def merkle_sql(fields: list[str], fan: int = 16, levels: int = 5) -> str:
    """Leaves, trees and folded proofs level by level; ``levels`` bounds the rows of a group at ``fan`` to its power."""

    def leaf(replaced: dict[str, str]) -> str:
        values = [f"({replaced.get(f, f)})::VARCHAR" for f in fields]
        return "sha256(" + " || ".join(f"coalesce(strlen({v})::VARCHAR || ':' || {v}, '-')" for v in values) + ")"

    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    parts = [
        "d AS (SELECT row_number() OVER () AS r, * FROM documents)",
        f"""e AS (SELECT r, doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s, {leaf({})} AS leaf,
  CASE WHEN doc_id IS NOT NULL AND {crc32_sql("doc_id::VARCHAR")} % 5 = 0
    THEN {leaf({"text": f"translate(text, '{capitals}', '{capitals.lower()}')"})} ELSE leaf END AS changed FROM d)""",
        """placed AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY s) AS n FROM e)""",
        "l0 AS (SELECT s, pos, n, leaf AS node FROM placed)",
        "w0 AS (SELECT r, s, pos, n, changed AS cur, '' AS proof FROM placed)",
    ]

    def climb(level: str, walk: str) -> None:
        for h in range(levels):
            parts.append(f"""{level}{h + 1} AS (SELECT s, run AS pos, (n + {fan - 1}) // {fan} AS n, sha256(string_agg(node, '' ORDER BY pos)) AS node
  FROM (SELECT *, pos // {fan} AS run FROM {level}{h}) WHERE n > 1 GROUP BY s, run, n UNION ALL SELECT * FROM {level}{h} WHERE n = 1)""")
            parts.append(f"""{walk}{h + 1} AS (SELECT w.r, w.s, w.pos // {fan} AS pos, (w.n + {fan - 1}) // {fan} AS n,
    sha256(string_agg(CASE WHEN c.pos = w.pos THEN w.cur ELSE c.node END, '' ORDER BY c.pos)) AS cur,
    any_value(w.proof) || coalesce(string_agg(c.node, '' ORDER BY c.pos) FILTER (c.pos <> w.pos), '') AS proof
  FROM {walk}{h} w JOIN {level}{h} c ON c.s = w.s AND c.pos // {fan} = w.pos // {fan} WHERE w.n > 1 GROUP BY w.r, w.s, w.pos, w.n
  UNION ALL SELECT * FROM {walk}{h} WHERE n = 1)""")

    climb("l", "w")
    parts.append(f"t0 AS (SELECT 0 AS s, s AS pos, count(*) OVER () AS n, node FROM l{levels})")
    parts.append(f"v0 AS (SELECT r, 0 AS s, s AS pos, (SELECT count(*) FROM l{levels}) AS n, cur, proof FROM w{levels})")
    climb("t", "v")
    return f"""WITH {", ".join(parts)}
SELECT e.doc_id, e.leaf, l.node AS subroot, t.node AS root, sha256(v.proof) AS proof_sha256, v.cur AS folded_root, v.cur = t.node AS verified
FROM e JOIN l{levels} l USING (s) JOIN v{levels} v USING (r) CROSS JOIN t{levels} t"""


def trie_sql() -> str:
    """Nodes by the digests of whole paths; subtrees through the path of each node's smallest member."""
    said = "sha256(strlen(role)::VARCHAR || ':' || role || text)"
    return f"""WITH said AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
turns AS (SELECT *, {said} AS digest, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, {said}) - 1 AS p FROM said),
convs AS (SELECT c, {crc32_sql("c::VARCHAR")} % 4 AS h FROM (SELECT DISTINCT c FROM said)),
rebuilt AS (
  SELECT k.c, 0 AS side, p, digest, text FROM convs k JOIN turns t ON t.c = k.c - k.c % 20 AND p < h
  UNION ALL SELECT t.c, 1, p, digest, text FROM turns t JOIN convs USING (c) WHERE p >= h),
paths AS (SELECT c, row_number() OVER o AS d, len(regexp_extract_all(text, '{_WORD}+')) AS words, sha256(string_agg(digest, '') OVER o) AS key
  FROM rebuilt WINDOW o AS (PARTITION BY c ORDER BY side, p)),
members AS (
  SELECT c, d, words, key, coalesce(lag(key) OVER (PARTITION BY c ORDER BY d), 'root') AS parent FROM paths
  UNION ALL SELECT c, 0, 0, 'root', NULL FROM convs),
ends AS (SELECT c, max(d) AS final FROM members GROUP BY c),
nodes AS (SELECT key, d, any_value(parent) AS parent, min(c) AS conv_id, count(*) AS n, any_value(words) AS words,
    coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (d = final), '') AS own FROM members JOIN ends USING (c) GROUP BY key, d),
children AS (SELECT parent AS key, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY parent),
below AS (SELECT m.key, m.d, count(*) FILTER (k.key IS NULL) AS n_leaves, sum((u.n - 1) * u.words) AS saved
  FROM nodes u JOIN members m ON m.c = u.conv_id AND m.d <= u.d LEFT JOIN children k ON k.key = u.key GROUP BY m.key, m.d)
SELECT x.conv_id, x.d::BIGINT AS depth, y.conv_id AS parent_conv_id, x.n::BIGINT AS n_convs, coalesce(n_children, 0)::BIGINT AS n_children,
  n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(x.own) AS ends_sha256
FROM nodes x JOIN below USING (key, d) LEFT JOIN children USING (key) LEFT JOIN nodes y ON y.key = x.parent"""
