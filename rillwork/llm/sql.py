"""DuckDB SQL for the training-data operators that SQL can express."""

from __future__ import annotations

from . import audit, licenses, quality, secretscan

_WORD = r"[^\x20\x09-\x0D]+"

QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '{_WORD}') AS ws FROM d),
p AS (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w WHERE len(ws) > 0),
g AS (SELECT rid, pos, word, lag(word) OVER o AS prior, lead(word, 7) OVER o AS last_word,
        concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o, lead(word, 5) OVER o, lead(word, 6) OVER o, lead(word, 7) OVER o) AS k
      FROM p WINDOW o AS (PARTITION BY rid ORDER BY pos)),
twice AS (SELECT rid, pos FROM (SELECT rid, pos, count(*) OVER (PARTITION BY rid, k) AS c FROM g WHERE last_word IS NOT NULL) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest(range(pos, pos + 8)) AS j FROM twice) GROUP BY rid),
echo AS (SELECT rid, count(*) FILTER (WHERE word = prior) AS n FROM g GROUP BY rid),
l AS (SELECT rid, count(*) AS n, count(*) - count(DISTINCT x) AS dup FROM (SELECT rid, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY rid),
f AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, coalesce(l.dup, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
        length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS n_upper, length(regexp_replace(t, '[\x00-\x40\x5B-\x60\x7B-\x7F]+', '', 'g')) AS n_letters, coalesce(l.n, 0) AS n_lines, coalesce(echo.n, 0) AS n_echoes
      FROM w LEFT JOIN l USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN echo USING (rid)),
b AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.REPEAT_PCT} * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 100 * n_symbols <= {quality.SYMBOL_PCT} * n_words AND 100 * n_upper <= {quality.UPPER_PCT} * n_letters AND 100 * n_letters >= {quality.LETTER_PCT} * word_chars
  AND 100 * n_dup_lines <= {quality.DUP_LINE_PCT} * n_lines AND 100 * n_echoes <= {quality.ECHO_PCT} * n_words AND word_chars <= {quality.MAX_WORD_CHARS} * n_words AS kept
FROM b"""

EXACT = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, row_number() OVER (PARTITION BY t ORDER BY doc_id, rid) = 1 AS kept, sha256(t) AS text_sha256
FROM d"""


def _licenses() -> str:
    known = ", ".join(f"('{s}', {i})" for i, s in licenses.SENTENCES.items())
    steps = [
        rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
known AS (SELECT * FROM (VALUES {known}) AS v(s, i)),
cut AS (SELECT rid, unnest(string_split_regex(regexp_replace(t, '([.!?;:])[\x20\t]+', '\1' || chr(10), 'g'), '[\r\n]+')) AS x FROM d),
numbered AS (SELECT rid, x, row_number() OVER (PARTITION BY rid) AS place FROM cut),
hit AS (SELECT rid, place, i FROM (SELECT rid, place, trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g')) AS s FROM numbered) JOIN known USING (s)),
ids AS (SELECT rid, list(i ORDER BY place) AS ids FROM hit GROUP BY rid),
r0 AS (SELECT d.rid, d.doc_id, coalesce(ids, []) AS ids, coalesce(list_reduce(list_transform(ids, lambda i: '|' || i || '|'), lambda a, b: a || b), '') AS l, []::VARCHAR[] AS names, 0::BIGINT AS n FROM d LEFT JOIN ids USING (rid))"""
    ]
    for k, (name, run) in enumerate(licenses.RULES):
        text = "".join(f"|{i}|" for i in run)
        times = f"(length(l) - length(replace(l, '{text}', ''))) // {len(text)}"
        steps.append(f"r{k + 1} AS (SELECT rid, doc_id, ids, replace(l, '{text}', '/') AS l, CASE WHEN contains(l, '{text}') THEN list_append(names, '{name}') ELSE names END AS names, n + {times} AS n FROM r{k})")
    return ",\n".join(steps) + f"\nSELECT doc_id, len(ids)::BIGINT AS n_sentences, array_to_string(ids, ' ') AS sentence_ids, array_to_string(list_sort(list_distinct(names)), ',') AS licenses, n::BIGINT AS n_matches FROM r{len(licenses.RULES)}"


def _secrets() -> str:
    quote = lambda x: x.replace("'", "''")
    extra = {
        "assign": f"length(regexp_extract(piece, '{quote(secretscan.ASSIGN)}', 2)) >= 8",
        "secret": "regexp_matches(piece, '[0-9]') AND regexp_matches(piece, '[A-Z]') AND regexp_matches(piece, '[a-z]')",
    }
    steps = ["WITH d AS (SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), chr(1), chr(2)) AS t FROM documents)"]
    kinds = [*secretscan.BASE, *secretscan.WEAK]
    for r, (kind, pattern, _) in enumerate(kinds):
        steps.append(f"p{r} AS (SELECT rid, unnest(l) AS piece, generate_subscripts(l, 1) AS i FROM (SELECT rid, string_split(regexp_replace(t, '{quote(pattern)}', chr(1) || '\\0' || chr(1), 'g'), chr(1)) AS l FROM d))")
        steps.append(f"m{r} AS (SELECT rid, stop - length(piece) AS start, {r} AS rank, stop, '{kind}' AS kind FROM (SELECT *, sum(length(piece)) OVER (PARTITION BY rid ORDER BY i)::BIGINT AS stop FROM p{r}) WHERE i % 2 = 0 AND {extra.get(kind, 'true')})")
    steps.append("parts AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY start, rank, stop, kind) AS place FROM (" + " UNION ALL ".join(f"SELECT * FROM m{r}" for r in range(len(kinds))) + "))")
    flags = {"id": "kind IN ('access', 'ident')", "sec": "kind IN ('assign', 'hex', 'secret')", "fin": "kind = 'endpoint'"}
    scope = secretscan.SCOPE
    cols = ", ".join(f"max(CASE WHEN {f} THEN {{'stop': stop, 'start': start, 'kind': kind}} END) OVER b AS b_{n}, min(CASE WHEN {f} THEN {{'start': start, 'stop': stop, 'kind': kind}} END) OVER a AS a_{n}" for n, f in flags.items())
    steps.append(f"seen AS (SELECT *, {cols} FROM parts WINDOW b AS (PARTITION BY rid ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY rid ORDER BY place ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))")
    shown = lambda x: f"{x}.kind || ':' || {x}.start || ':' || {x}.stop"
    near = ", ".join(f"CASE WHEN start - b_{n}.stop <= {scope} THEN {shown('b_' + n)} WHEN a_{n}.start - stop <= {scope} THEN {shown('a_' + n)} END AS near_{n}" for n in flags)
    steps.append(f"linked AS (SELECT *, {near} FROM seen)")
    steps.append(f"""kept AS (SELECT *, kind || ':' || start || ':' || stop AS span,
CASE WHEN {flags['id']} THEN coalesce(near_sec, '') WHEN {flags['sec']} THEN concat_ws('+', near_id, near_fin) ELSE concat_ws('+', near_id, near_sec) END AS partners FROM linked
WHERE rank < 3 OR (kind = 'ident' AND near_sec IS NOT NULL) OR (kind = 'secret' AND (near_id IS NOT NULL OR near_fin IS NOT NULL)) OR (kind = 'endpoint' AND near_id IS NOT NULL AND near_sec IS NOT NULL))""")
    steps.append("""g AS (SELECT rid, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
string_agg(span, ',' ORDER BY place) FILTER (WHERE rank < 3) AS base, string_agg(span, ',' ORDER BY place) AS spans, string_agg(span || '>' || partners, ',' ORDER BY place) FILTER (WHERE partners <> '') AS links FROM kept GROUP BY rid)""")
    return ",\n".join(steps) + "\nSELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(links, '') AS links FROM d LEFT JOIN g USING (rid)"


AUDIT = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS part, doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS again FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{_WORD}') AS ws FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, CASE WHEN len(ws) < {audit.MIN_WORDS} THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < {audit.DISTINCT_PCT} * len(ws) THEN 'B' ELSE '' END
        || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > {audit.UPPER_PCT} * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN again THEN 'E' ELSE '' END AS mask
      FROM w LEFT JOIN l USING (doc_id)),
m AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
x AS (SELECT * FROM (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) AS v(x)),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a JOIN x b ON b.x <> a.x JOIN x c ON c.x NOT IN (a.x, b.x) JOIN x d ON d.x NOT IN (a.x, b.x, c.x) JOIN x e ON e.x NOT IN (a.x, b.x, c.x, d.x)),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS f, substr(filter_order, 1, step - 1) AS earlier FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (SELECT part, filter_order, step, f, n, good, toxic, contains(mask, f) AS fails, mask = f AS alone, translate(mask, earlier, '') <> mask AS gone FROM m, s),
g AS (SELECT part, filter_order, step::INT AS step, f, coalesce(sum(n) FILTER (WHERE NOT gone AND NOT fails), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE NOT gone AND fails), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER (WHERE gone AND fails), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (WHERE alone), 0)::BIGINT AS unique_fails,
        coalesce(sum(good) FILTER (WHERE NOT gone AND fails), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (WHERE NOT gone AND fails), 0)::BIGINT AS toxic_lost FROM r GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM g"""


def _conversations() -> str:
    """The damage (with a CRC-32 by bytes), then the cheapest edits row by row, with a least (cost, audit) for each state that the output can end in, then the rows that an audit makes."""
    table = ["t0 AS (SELECT i, i::BIGINT AS c FROM range(256) r(i))"]
    table += [f"t{k + 1} AS (SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END AS c FROM t{k})" for k in range(8)]
    add = lambda s, cost, letter: f"{{'c': {s}.c + {cost}, 'a': {s}.a || '{letter}'}}"
    kept = lambda s, x: f"CASE WHEN x = '{x}' THEN {add(s, 'm', 'K')} ELSE {far} END"
    moved = lambda s: f"CASE WHEN x <> 'd' THEN {add(s, '3 + m', 'R')} ELSE {far} END"
    least = lambda *x: f"list_sort([{', '.join(x)}])[1]"
    far = "{'c': 1000000000000::BIGINT, 'a': ''}"
    steps = {"s0": [add("s0", 4, "D")], "ss": [add("ss", 4, "D"), kept("s0", "s")], "su": [add("su", 4, "D"), *[f(s) for s in ("s0", "ss", "sa") for f in (lambda s: kept(s, "u"), moved)]], "sa": [add("sa", 4, "D"), kept("su", "a"), moved("su")]}
    stepped = ", ".join(f"{least(*v)} AS {k}" for k, v in steps.items())
    inserted = f"s0, ss, {least('su', add('s0', 3, 'I'), add('ss', 3, 'I'), add('sa', 3, 'I'))} AS su, sa"
    return rf"""WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS t, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
{", ".join(table)},
crc AS (SELECT DISTINCT key, 1 AS pos, 4294967295::BIGINT AS c FROM k UNION ALL SELECT key, pos + 1, xor(crc.c >> 8, t8.c) FROM crc JOIN t8 ON t8.i = (xor(crc.c, ascii(substr(key, pos, 1))::BIGINT) & 255) WHERE pos <= length(key)),
h AS (SELECT key, xor(c, 4294967295) % 20 AS h FROM crc WHERE pos = length(key) + 1),
d AS (SELECT coalesce(conv_id::VARCHAR, '') AS cid, turn, CASE h WHEN 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(t, '[.!?]', '', 'g') ELSE t END AS t, unnest(range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM k JOIN h USING (key)),
o AS (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY turn NULLS FIRST, role, t) AS pos, row_number() OVER (PARTITION BY cid, role, t ORDER BY turn NULLS FIRST) > 1 AS again FROM d),
f AS (SELECT *, left(role, 1) AS i, lag(left(role, 1)) OVER (PARTITION BY cid ORDER BY pos) AS before, NOT regexp_matches(t, '[^ 	-
]') AS blank, NOT regexp_matches(t, '[.!?][ 	-
]*$') AS cut FROM o),
r AS (SELECT *, CASE WHEN blank OR again THEN 'd' WHEN i IN ('u', 'a', 's') THEN i ELSE 'x' END AS x, CASE WHEN cut THEN 3 ELSE 0 END AS m FROM f),
w AS (SELECT DISTINCT cid, 0::BIGINT AS pos, {{'c': 0::BIGINT, 'a': ''}} AS s0, {far} AS ss, {{'c': 3::BIGINT, 'a': 'I'}} AS su, {{'c': 6::BIGINT, 'a': 'II'}} AS sa FROM r
  UNION ALL SELECT cid, pos, s0, ss, su, {least('sa', add('su', 3, 'I'))} AS sa FROM (SELECT cid, pos, {inserted} FROM (SELECT w.cid, r.pos, {stepped} FROM w JOIN r ON r.cid = w.cid AND r.pos = w.pos + 1))),
best AS (SELECT cid, {least('s0', 'sa')} AS s FROM (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY pos DESC) AS last FROM w) WHERE last = 1),
walk AS (SELECT cid, s.a AS audit, 1 AS spot, 1::BIGINT AS pos, '' AS tail, NULL::VARCHAR AS line FROM best
  UNION ALL SELECT walk.cid, audit, spot + 1, walk.pos + CASE WHEN substr(audit, spot, 1) = 'I' THEN 0 ELSE 1 END, CASE substr(audit, spot, 1) WHEN 'D' THEN tail WHEN 'K' THEN r.i ELSE CASE WHEN tail = 'u' THEN 'a' ELSE 'u' END END,
    CASE substr(audit, spot, 1) WHEN 'D' THEN NULL WHEN 'K' THEN r.role || ':' || r.t ELSE CASE WHEN tail = 'u' THEN 'assistant:' ELSE 'user:' END || CASE substr(audit, spot, 1) WHEN 'R' THEN r.t ELSE '' END END
  FROM walk LEFT JOIN r ON r.cid = walk.cid AND r.pos = walk.pos WHERE spot <= length(audit)),
made AS (SELECT cid, string_agg(line, chr(10) ORDER BY spot) AS lines FROM walk GROUP BY cid),
n AS (SELECT cid, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE again AND NOT blank) AS duplicate, count(*) FILTER (WHERE cut AND NOT blank AND NOT again) AS truncated,
  count(*) FILTER (WHERE before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY cid)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(s.c, 0)::BIGINT AS cost,
  coalesce(s.a, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN n ON n.cid = coalesce(c.conv_id::VARCHAR, '') LEFT JOIN best ON best.cid = n.cid LEFT JOIN made ON made.cid = n.cid"""


ORACLES = {"op2_quality": QUALITY, "op4_exact_dedup": EXACT, "op7_licenses": _licenses(), "op9_secrets": _secrets(), "op11_conversation_repair": _conversations(), "op12_filter_audit": AUDIT}
