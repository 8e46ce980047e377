"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

from nearloom.llm.licenses import template_rows

OP4 = r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS place
  FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
         CASE place % 3 WHEN 0 THEN 1.25::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS t0,
         CASE place % 3 WHEN 0 THEN 0.75::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 1.5::DOUBLE END AS t1
  FROM sources),
levels AS (
  SELECT 3 * source_size AS bound, w,
         (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0))::DOUBLE
           / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level,
         row_number() OVER (ORDER BY 3.0 * source_size / w, place) AS k
  FROM weighed
  WINDOW before AS (ORDER BY 3.0 * source_size / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
final AS (SELECT min_by(level, k) FILTER (WHERE bound > level * w) AS level FROM levels),
targets AS (
  SELECT weighed.*, least((3 * source_size)::DOUBLE, coalesce(level, 0) * w) AS target FROM weighed, final),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.t0, t.t1, CAST(round(t.target) AS BIGINT) AS demand,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
curve AS (SELECT *, t0 * 2 / (t0 + t1) AS a, t1 * 2 / (t0 + t1) AS b,
                 off::DOUBLE / nullif(demand, 0) AS u FROM placed)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(greatest(0, least(demand - off, size)) + greatest(0, least(demand - source_size - off, size))
            + greatest(0, least(demand - 2 * source_size - off, size)) AS BIGINT) AS taken,
       CASE WHEN least(demand - off, size) > 0 THEN round(2.0::DOUBLE * u / (a + sqrt(a * a + 2.0::DOUBLE * (b - a) * u)), 9) END AS first_position
FROM curve
"""


OP9 = r"""
WITH templates(license, template) AS (VALUES @ROWS@),
passages AS (
  SELECT row_number() OVER () AS r, doc_id, kind, number, content FROM (
    SELECT doc_id, 'line' AS kind, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS number
    FROM documents
    UNION ALL
    SELECT doc_id, 'paragraph' AS kind, unnest(regexp_split_to_array(text, '\n[ \t\r]*\n')) AS content,
           generate_subscripts(regexp_split_to_array(text, '\n[ \t\r]*\n'), 1) - 1 AS number
    FROM documents)
  WHERE kind = 'line' OR contains(content, chr(10))),
words AS (
  SELECT r, doc_id, kind, number,
         string_split(trim(regexp_replace(translate(content, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w
  FROM passages),
grams AS (
  SELECT r, doc_id, kind, number,
         list_distinct(CASE WHEN len(w) > 1 THEN [w[i] || ' ' || w[i + 1] for i in range(1, len(w))] ELSE w END) AS g
  FROM words WHERE w[1] <> ''),
scored AS (
  SELECT r, doc_id, kind, number, license, 2.0::DOUBLE * len(list_intersect(g, template)) / (len(g) + len(template)) AS dice
  FROM grams JOIN templates ON len(g) <= len(template) * 1.5000001 AND len(template) <= len(g) * 1.5000001)
SELECT doc_id, kind, CAST(number AS INTEGER) AS number, license, dice FROM scored WHERE dice >= 0.8
QUALIFY row_number() OVER (PARTITION BY r ORDER BY dice DESC, license) = 1
"""


OP12 = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
  FROM conversations),
hashed AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(k, ''),
           lambda c: [(ascii(c) >> b) & 1 for b in [0, 1, 2, 3, 4, 5, 6, 7]]))),
         lambda s, b: CASE WHEN (xor(s, b) & 1) = 1 THEN xor(s >> 1, 3988292384::BIGINT) ELSE s >> 1 END), 4294967295::BIGINT) % 20 AS kind
  FROM keyed),
hurt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM hashed WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) - 1 AS seat,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
         lag(CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'o' END) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS before,
         CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'o' END AS initial
  FROM hurt),
faulty AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN nth > 1 THEN 'duplicate'
                 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' END AS fault
  FROM placed),
turns AS (
  SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 'd' WHEN fault = 'truncated' THEN upper(initial) ELSE initial END AS symbol FROM faulty),
counted AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM turns GROUP BY conv_id),
-- Edits before a turn are at most two insertions; a label is the cost in eight digits and the initials.
inserted(q, r, cost, letters) AS (VALUES
  (0, 0, 0, ''), (0, 2, 5, 'I'), (0, 3, 10, 'II'), (1, 1, 0, ''), (1, 2, 5, 'I'), (1, 3, 10, 'II'), (2, 2, 0, ''), (2, 3, 5, 'I'), (3, 3, 0, ''), (3, 2, 5, 'I')),
edits(symbol, q, r, cost, letter) AS (
  SELECT s, q, q, 2, 'D' FROM (SELECT unnest(string_split('suaoSUAOd', '')) AS s), (SELECT unnest([0, 1, 2, 3]) AS q)
  UNION ALL
  SELECT CASE WHEN cut THEN upper(s) ELSE s END, q, r, CASE WHEN cut THEN 5 ELSE 0 END, 'K'
  FROM (VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('a', 2, 3), ('u', 3, 2)) AS k(s, q, r), (SELECT unnest([true, false]) AS cut)
  UNION ALL
  SELECT s, q, r, CASE WHEN s = upper(s) THEN 6 ELSE 1 END, 'R'
  FROM (SELECT unnest(string_split('suaoSUAO', '')) AS s), (VALUES (0, 2), (1, 2), (2, 3), (3, 2)) AS k(q, r)),
walk(conv_id, seat, q, label) AS (
  SELECT conv_id, 0::BIGINT, 0, '00000000' FROM counted
  UNION ALL
  SELECT w.conv_id, w.seat + 1, e.r, min(lpad(CAST(CAST(left(w.label, 8) AS INTEGER) + i.cost + e.cost AS VARCHAR), 8, '0') || w.label[9:] || i.letters || e.letter)
  FROM walk w JOIN turns t ON w.conv_id IS NOT DISTINCT FROM t.conv_id AND w.seat = t.seat JOIN inserted i ON i.q = w.q JOIN edits e ON e.symbol = t.symbol AND e.q = i.r
  GROUP BY w.conv_id, w.seat, e.r),
best AS (
  SELECT w.conv_id, min(lpad(CAST(CAST(left(w.label, 8) AS INTEGER) + i.cost AS VARCHAR), 8, '0') || w.label[9:] || i.letters) AS label
  FROM walk w JOIN counted c ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.seat = c.n JOIN inserted i ON i.q = w.q AND i.r IN (0, 3) GROUP BY w.conv_id),
letters AS (
  SELECT conv_id, unnest(string_split(label[9:], '')) AS letter, generate_subscripts(string_split(label[9:], ''), 1) AS k FROM best WHERE length(label) > 8),
numbered AS (
  SELECT *, count(*) FILTER (letter <> 'I') OVER before - 1 AS seat, count(*) FILTER (letter <> 'D') OVER before AS place
  FROM letters WINDOW before AS (PARTITION BY conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
made AS (
  SELECT n.conv_id, n.k, n.letter, n.place, t.role, CASE WHEN n.letter = 'I' THEN '' ELSE t.text END AS text,
         max(CASE WHEN n.place = 1 AND n.letter = 'K' AND t.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY n.conv_id) AS led
  FROM numbered n LEFT JOIN turns t ON n.letter <> 'I' AND n.conv_id IS NOT DISTINCT FROM t.conv_id AND n.seat = t.seat
  WHERE n.letter <> 'D'),
digests AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (place - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY k)) AS h
  FROM made GROUP BY conv_id)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(left(label, 8), '0') AS BIGINT) AS cost,
       coalesce(label[9:], '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON o.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best b ON o.conv_id IS NOT DISTINCT FROM b.conv_id
LEFT JOIN digests d ON o.conv_id IS NOT DISTINCT FROM d.conv_id
"""


OP13 = r"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM texts),
words AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, d, array_to_string(w[i : i + d - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, d, w, unnest(range(1, len(w) - d + 2)) AS i FROM words, (SELECT unnest([1, 2, 3, 4]) AS d) WHERE len(w) >= d)
  GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM grams WHERE d = 1 GROUP BY lang),
held AS (SELECT * FROM grams WHERE f >= 30),
parts AS (SELECT lang, d, phrase, f AS a, string_split(phrase, ' ') AS w FROM held WHERE d > 1),
cuts AS (
  SELECT lang, d, phrase, a, w, k, array_to_string(w[1 : k], ' ') AS head, array_to_string(w[k + 1 : d], ' ') AS tail
  FROM (SELECT *, unnest(range(1, d)) AS k FROM parts)),
scored AS (
  SELECT c.lang, c.d, c.phrase, c.w, c.a, h.f AS l, t.f AS r, CAST((2000000::HUGEINT * c.a) // (h.f + t.f) AS BIGINT) AS score, c.k
  FROM cuts c JOIN held h ON c.lang = h.lang AND c.head = h.phrase JOIN held t ON c.lang = t.lang AND c.tail = t.phrase
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, c.k) = 1),
inside AS (
  SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, max(a) AS f
  FROM (SELECT *, unnest(range(1, d - m + 2)) AS i FROM parts, (SELECT unnest([2, 3]) AS m) WHERE m < d) GROUP BY ALL)
SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY s.score DESC, s.a DESC, s.phrase) AS rank, s.phrase, CAST(s.a AS BIGINT) AS a,
       CAST(s.l AS BIGINT) AS l, CAST(s.r AS BIGINT) AS r, n, s.score
FROM scored s LEFT JOIN inside i ON s.lang = i.lang AND s.phrase = i.phrase JOIN totals t ON s.lang = t.lang
WHERE i.f IS NULL OR 100::HUGEINT * i.f < 80::HUGEINT * s.a
QUALIFY rank <= 2000
"""


def build() -> dict[str, str]:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({quoted(name)}, [{', '.join(map(quoted, grams))}])" for name, grams in template_rows())
    return {"op4_curriculum_mix": OP4, "op9_license_scan": OP9.replace("@ROWS@", rows), "op12_conversation_repair": OP12, "op13_phrase_collocations": OP13}
