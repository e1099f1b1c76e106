"""DuckDB SQL for the queries that SQL can express."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def quality_rules(table: str = "documents", min_words: int = 50, repeat: float = 0.5, line_docs: int = 4, line_share: float = 0.08, left: float = 0.5) -> str:
    """The verdicts of the quality rules on ``table``; lines are compared as text, not by hash."""
    return rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM {table}),
w AS (SELECT doc_id, text, source, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
      list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS n FROM p),
r AS (SELECT doc_id, count(DISTINCT pos) AS n_repeat FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS pos FROM g WHERE n > 1) GROUP BY doc_id),
l AS (SELECT doc_id, source, text, unnest(list_transform(ls, lambda x: translate(array_to_string(list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda y: y <> ''), ' '), '{UPPER}', '{LOWER}'))) AS line FROM w),
h AS (SELECT source, count(DISTINCT doc_id) AS host_docs FROM w GROUP BY source),
f AS (SELECT l.source, line FROM l JOIN h ON l.source IS NOT DISTINCT FROM h.source GROUP BY l.source, line
      HAVING count(DISTINCT doc_id) > {line_docs} AND count(DISTINCT doc_id) > {line_share} * max(host_docs)),
c AS (SELECT doc_id, sum(len(string_split(l.line, ' '))) AS lost FROM l JOIN f ON l.line = f.line AND l.source IS NOT DISTINCT FROM f.source GROUP BY doc_id),
o AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
      CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
      CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
      CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
      CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(lost, 0) AS BIGINT) AS n_frequent_words
      FROM w LEFT JOIN r USING (doc_id) LEFT JOIN c USING (doc_id))
SELECT *, n_words < {min_words} OR n_repeat_words > {repeat} * n_words AS base_failed,
  NOT (n_words < {min_words} OR n_repeat_words > {repeat} * n_words) AND n_words - n_frequent_words >= greatest({left} * n_words, {min_words}) AS kept
FROM o"""


def fill_middle(table: str = "documents", plain: int = 10, suffix_first: int = 20) -> str:
    """Fill-in-the-middle on lists of units, which the operator never makes."""
    group = "CAST('0x' || substr(h, {0}, 8) AS BIGINT)"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM {table}),
u AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units, {", ".join(f"{group.format(8 * i + 1)} AS h{i + 1}" for i in range(4))} FROM d),
k AS (SELECT *, CAST(len(units) AS BIGINT) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b FROM u),
p AS (SELECT doc_id, n, text, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= {100 - plain} THEN 'plain' WHEN h4 % 100 < {suffix_first} THEN 'spm' ELSE 'psm' END AS form,
      array_to_string(list_slice(units, 1, a), '') AS prefix, array_to_string(list_slice(units, a + 1, b), '') AS middle, array_to_string(list_slice(units, b + 1, n), '') AS suffix FROM k)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p"""


def spelling(table: str = "documents", every: int = 97, min_chars: int = 5, min_count: int = 3, ratio: int = 2) -> str:
    """Spelling variants by words with one character taken out, which meet; crc32 by its table of bytes."""
    return rf"""
WITH RECURSIVE bits(byte, c, k) AS (SELECT b, b, 0 FROM range(256) t(b) UNION ALL SELECT byte, CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY byte) AS steps FROM bits WHERE k = 8),
r AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM {table}) GROUP BY ALL),
b AS (SELECT *, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM r),
h AS (SELECT run, n, xor(list_reduce(list_transform(range(0, length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT)), lambda s, y: xor(s >> 8, steps[xor(s & 255, y) + 1]), 4294967295), 4294967295) AS h FROM b, crc),
s AS (SELECT CASE WHEN h % {every} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM s WHERE length(word) >= {min_chars} GROUP BY word HAVING sum(n) >= {min_count}),
o AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM o a JOIN o b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
  UNION SELECT o.word, w.word, w.n FROM o JOIN w ON o.less = w.word UNION SELECT w.word, o.word, o.n FROM o JOIN w ON o.less = w.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= {ratio} * w.n THEN other END AS form, CASE WHEN other_n >= {ratio} * w.n THEN other_n END AS form_n FROM w LEFT JOIN best USING (word)),
way(word, root, form) AS (SELECT word, word, form FROM f UNION ALL SELECT way.word, way.form, f.form FROM way JOIN f ON f.word = way.form)
SELECT f.word, f.form, way.root, f.n, f.n_near, f.form_n FROM f JOIN way ON way.word = f.word AND way.form IS NULL"""
