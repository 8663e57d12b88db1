"""DuckDB statements for the queries of this folder; they restate the contracts on their own."""

CHAT_SQL = r"""
WITH rows AS (
  SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, NULL, 0, 'user', '</s>[INST] ok [/INST]'), (-7, NULL, 1, 'assistant', '</s>[INST] ok [/INST]')),
marked AS (
  SELECT *, '<|im_start|>'
    || regexp_replace(role, '([<\[])(\\*)(\|endoftext\|>|\|im_start\|>|\|im_end\|>|\|im_sep\|>|/INST\]|INST\]|/SYS\]|SYS\]|/s>|s>)', '\1\2\\\3', 'g') || '<|im_sep|>'
    || regexp_replace(text, '([<\[])(\\*)(\|endoftext\|>|\|im_start\|>|\|im_end\|>|\|im_sep\|>|/INST\]|INST\]|/SYS\]|SYS\]|/s>|s>)', '\1\2\\\3', 'g') || '<|im_end|>' AS piece
  FROM rows),
joined AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS whole,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    string_agg(piece, '' ORDER BY turn NULLS FIRST, role, text) AS formatted,
    list_reduce(list_concat(['start'], list(role ORDER BY turn NULLS FIRST, role, text)), lambda s, r: CASE
      WHEN s = 'start' AND r = 'system' THEN 'system' WHEN s IN ('start', 'system', 'assistant') AND r = 'user' THEN 'user'
      WHEN s = 'user' AND r = 'assistant' THEN 'assistant' ELSE 'invalid' END) AS state
  FROM marked GROUP BY conv_id, alone)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  length(formatted) AS formatted_chars, state, state = 'assistant' AS valid, 3 * n_turns AS segments
FROM joined
"""

URL_SQL = r"""
WITH parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^?#]*\?([^#]*)', 1) AS query FROM pages),
canon AS (
  SELECT *, list_sort(list_filter(string_split(query, '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref)(=|$)'))) AS kept FROM parts),
urls AS (
  SELECT page_id, host, path, regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '')
    || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canonical FROM canon),
articles AS (
  SELECT u.canonical, u.host, u.page_id, regexp_extract(coalesce(p.html, ''), '(?s)<article>(.*)</article>', 1) AS body FROM urls u JOIN pages p USING (page_id)),
copied AS (  -- articles that pages of several hosts carry: the first page keeps its url
  SELECT body, min(page_id) AS first FROM articles WHERE body <> '' GROUP BY body HAVING min(host) <> max(host)),
listed AS (
  SELECT canonical FROM urls WHERE regexp_matches(host, '(^|\.)(ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm)\.')
  UNION SELECT canonical FROM articles a JOIN copied c ON a.body = c.body AND a.page_id > c.first),
rules(h, p, say) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
best AS (
  SELECT u.page_id, u.host, u.path, max_by(r.h || r.p, length(r.h || r.p)) AS rule, max_by(r.say, length(r.h || r.p)) AS say, any_value(u.canonical) AS canonical
  FROM (SELECT *, row_number() OVER () AS rid FROM urls) u
  LEFT JOIN rules r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p)
  GROUP BY u.rid, u.page_id, u.host, u.path)
SELECT page_id, host, path, rule,
  coalesce(say, CASE WHEN host <> '' AND canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
FROM best
"""

LICENSE_SQL = r"""
WITH templates(k, label, words) AS (VALUES
  (0, 'apache-2.0', 'licensed under the apache license version 2 0'),
  (1, 'mit', 'released under the mit license'),
  (2, 'mit', 'permission is hereby granted free of charge to any person obtaining a copy of this software'),
  (3, 'gpl-3.0', 'this work is licensed under the gnu general public license version 3'),
  (4, 'gpl-3.0', 'this program is free software you can redistribute it and or modify it under the terms of the gnu general public license'),
  (5, 'lgpl-3.0', 'licensed under the gnu lesser general public license version 3'),
  (6, 'mpl-2.0', 'this source code form is subject to the terms of the mozilla public license v 2 0'),
  (7, 'bsd', 'redistribution and use in source and binary forms with or without modification are permitted'),
  (8, 'cc-by-4.0', 'this work is licensed under a creative commons attribution 4 0 international license'),
  (9, 'cc-by-nc-4.0', 'licensed under cc by nc 4 0'),
  (10, 'cc0-1.0', 'to the extent possible under law the author has waived all copyright and related rights'),
  (11, 'unlicense', 'this is free and unencumbered software released into the public domain'),
  (12, 'all-rights-reserved', 'all rights reserved')),
docs AS (
  SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
worded AS (
  SELECT rid, doc_id, low, list_filter(string_split(regexp_replace(low, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda w: w <> '') AS w FROM docs),
phrases(label, pw) AS (VALUES ('gpl', ['gnu', 'general', 'public', 'license']), ('apache', ['apache', 'license']), ('cc-by', ['cc', 'by']), ('mit', ['mit', 'license'])),
places AS (
  SELECT rid, label, unnest(list_filter(range(len(w)), lambda i: list_slice(w, i + 1, i + len(pw)) = pw)) AS place
  FROM (SELECT * FROM worded WHERE regexp_matches(low, 'license|by')) x, phrases),
base AS (
  SELECT rid, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list_sort(list(DISTINCT label)) AS base_labels FROM places GROUP BY rid),
sized AS (  -- templates in classes of 4, 8, 16, ... words; windows of twice as many
  SELECT label, list_distinct(string_split(words, ' ')) AS own, greatest(4, pow(2, ceil(log2(len(string_split(words, ' '))))))::INT AS u FROM templates),
blocks AS (
  SELECT rid, u, list_distinct(list_slice(w, place + 1, place + 2 * u)) AS held
  FROM (SELECT rid, w, u, unnest(range(0, len(w), u)) AS place FROM worded, (SELECT DISTINCT u FROM sized) c WHERE len(w) > 0) x),
met AS (
  SELECT rid, label, len(list_intersect(held, own)) / len(own) AS containment
  FROM blocks JOIN sized USING (u) WHERE len(list_intersect(held, own)) >= ceil(0.8 * len(own))),
joined AS (SELECT rid, list(DISTINCT label) AS labels, max(containment) AS score FROM met GROUP BY rid)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(b.n_base, 0) AS n_base, b.first_word, b.last_word,
  coalesce(array_to_string(b.base_labels, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.base_labels, []), coalesce(j.labels, [])))), ','), '') AS labels,
  greatest(CASE WHEN b.n_base > 0 THEN 1.0 ELSE 0.0 END, coalesce(j.score, 0.0))::DOUBLE AS score
FROM worded d LEFT JOIN base b USING (rid) LEFT JOIN joined j USING (rid)
"""

LEAK_SQL = r"""
WITH words AS (
  SELECT rid, id, kind, list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda w: w <> '') AS w
  FROM (SELECT row_number() OVER () AS rid, item_id AS id, text, 'i' AS kind FROM benchmark
        UNION ALL SELECT row_number() OVER (), doc_id, text, 'd' FROM documents)),
grams AS (
  SELECT DISTINCT rid, id, kind, array_to_string(list_slice(w, i + 1, i + 5), ' ') AS s
  FROM (SELECT rid, id, kind, w, unnest(range(len(w) - 4)) AS i FROM words WHERE len(w) >= 5)),
items AS (SELECT rid, id, count(*) AS q FROM grams WHERE kind = 'i' GROUP BY rid, id),
held AS (
  SELECT d.rid, d.id AS doc_id, t.id AS item_id, count(*) / any_value(t.q) AS containment
  FROM grams d JOIN grams g ON d.s = g.s AND g.kind = 'i' JOIN items t ON t.rid = g.rid WHERE d.kind = 'd' GROUP BY d.rid, d.id, t.rid, t.id)
SELECT doc_id, item_id, max(containment) AS containment FROM held WHERE containment >= 0.8 GROUP BY doc_id, item_id
"""

REPEAT_SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
wins AS (
  SELECT rid, doc_id, i, md5(array_to_string(list_slice(w, i + 1, i + 50), ' ')) AS m
  FROM (SELECT rid, doc_id, w, unnest(range(len(w) - 49)) AS i FROM words WHERE len(w) >= 50)),
firsts AS (SELECT m, min(doc_id) AS first FROM wins GROUP BY m),
gone AS (
  SELECT DISTINCT rid, p FROM (SELECT rid, unnest(range(i, i + 50)) AS p FROM wins JOIN firsts USING (m) WHERE doc_id > first)),
kept AS (
  SELECT rid, string_agg(word, ' ' ORDER BY p) AS text
  FROM (SELECT rid, unnest(w) AS word, unnest(range(len(w))) AS p FROM words) x ANTI JOIN gone USING (rid, p) GROUP BY rid),
counts AS (SELECT rid, count(*) AS n FROM gone GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM words LEFT JOIN counts USING (rid) LEFT JOIN kept USING (rid)
"""

TRIE_SQL = r"""
WITH turns AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, text) AS t
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL) GROUP BY conv_id),
shared AS (  -- crc32 of the decimal id, bit by bit, as an unsigned number modulo 4
  SELECT conv_id, t, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''),
    lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END), 4294967295::BIGINT) % 4 AS h
  FROM turns),
rebuilt AS (
  SELECT s.conv_id, list_concat(coalesce(b.t[1:s.h], []), s.t[s.h + 1:]) AS t
  FROM shared s LEFT JOIN turns b ON b.conv_id = s.conv_id - s.conv_id % 20),
prefixes AS (SELECT conv_id, len(t) AS whole, d, t[1:d] AS p, t[1:d - 1] AS up FROM (SELECT conv_id, t, unnest(range(len(t) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT p, d, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n,
    coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE whole = d), '') AS ends,
    CASE WHEN d > 0 THEN len(list_filter(string_split_regex(any_value(p)[d].text, '[\x20\x09-\x0D]+'), lambda w: w <> '')) ELSE 0 END AS words
  FROM prefixes GROUP BY p, d),
kids AS (SELECT up AS p, d - 1 AS d, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY up, d),
counted AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k USING (p, d)),
below AS (
  SELECT p[1:a] AS p, a AS d, sum((n_children = 0)::BIGINT) AS n_leaves, sum((n - 1) * words) AS saved
  FROM (SELECT *, unnest(range(d + 1)) AS a FROM counted) GROUP BY 1, 2)
SELECT c.conv_id, c.d AS depth, u.conv_id AS parent_conv_id, c.n AS n_convs, c.n_children, b.n_leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens,
  sha256(c.ends) AS ends_sha256
FROM counted c JOIN below b USING (p, d) LEFT JOIN nodes u ON u.p = c.up AND u.d = c.d - 1
"""
