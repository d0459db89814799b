"""SQL that gives the rows of the registered queries, where SQL can express them: straight from their contracts."""

from __future__ import annotations

# The base patterns as documented, and the white space that ends a word.
_BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_WORD = r"[^\x20\x09-\x0D]+"

EXACT = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents
), k AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id ASC NULLS LAST) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM k
"""

# Every two documents that share a shingle are compared; the least id spreads along the links. doc_ids are unique.
NEAR = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS words
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct([array_to_string(words[i:i + 4], ' ') FOR i IN range(1, len(words) - 3)]) END AS shingles
  FROM w
), e AS MATERIALIZED (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS h FROM s),
l AS MATERIALIZED (
  SELECT a.doc_id AS u, b.doc_id AS v FROM e a JOIN e b ON a.h = b.h AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (min(a.n) + min(b.n) - count(*))
), r AS (
  SELECT doc_id, doc_id AS c FROM s UNION SELECT l.v, r.c FROM r JOIN l ON l.u = r.doc_id WHERE r.c < l.v
), c AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, len(shingles) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c USING (doc_id)
"""


def _found(kind: int, name: str) -> str:
    """The matches of one base pattern: positions from the lengths of the matches and of the gaps between them."""
    pattern = _BASE[name]
    return rf"""SELECT rid, {kind} AS kind, m, "end" - length(m) AS start, "end" FROM (
    SELECT rid, m, sum(length(gap) + length(m)) OVER (PARTITION BY rid ORDER BY i) AS "end" FROM (
      SELECT rid, generate_subscripts(ms, 1) AS i, unnest(ms) AS m, unnest(gaps[1:len(ms)]) AS gap FROM (
        SELECT rid, regexp_extract_all(text, '{pattern}') AS ms, string_split_regex(text, '{pattern}') AS gaps FROM d) WHERE len(ms) > 0))"""


def _patterns(source: str) -> str:
    return f"SELECT pattern, sum(score) / (count(*) + 1) AS mean, count(kind) AS seeds FROM {source} GROUP BY pattern"


def _scores(means: str) -> str:
    return f"""SELECT pattern, e.instance, kind, score FROM e JOIN (
    SELECT instance, CASE WHEN max(kind) IS NOT NULL THEN 1.0 ELSE greatest(avg(mean) FILTER (pattern[1] = 's'), avg(mean) FILTER (pattern[1] = 'c')) END AS score
    FROM e JOIN {means} USING (pattern) GROUP BY instance) x ON x.instance = e.instance"""


# Words, instances (words with a digit or an at sign; runs of two or more between blanks), their patterns, three rounds of
# scores, and what patterns of a mean of 0.8 and five seeds name.
PII = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
m AS ({" UNION ALL ".join(_found(i, name) for i, name in enumerate(_BASE))}),
digits AS (SELECT *, regexp_replace(m, '[^0-9]', '', 'g') AS ds FROM m),
base AS MATERIALIZED (
  SELECT rid, kind, start::BIGINT AS start, "end"::BIGINT AS "end" FROM digits WHERE CASE kind
    WHEN 0 THEN true
    WHEN 1 THEN len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(try_cast(nullif(right(ltrim(p, '0'), 4), '') AS INT), 0) > 255)) = 0
    WHEN 2 THEN length(ds) BETWEEN 13 AND 19 AND list_sum([CASE WHEN i % 2 = 1 THEN ds[-i]::INT WHEN ds[-i]::INT > 4 THEN 2 * ds[-i]::INT - 9 ELSE 2 * ds[-i]::INT END FOR i IN range(1, length(ds) + 1)]) % 10 = 0
    ELSE length(ds) BETWEEN 9 AND 15 END
), split AS (SELECT rid, regexp_extract_all(text, '{_WORD}') AS ws, string_split_regex(text, '{_WORD}') AS gaps FROM d),
w AS (
  SELECT rid, i, word, gap, last, regexp_matches(word, '[0-9@]') AS found, sum(length(gap) + length(word)) OVER (PARTITION BY rid ORDER BY i) AS "end"
  FROM (SELECT rid, generate_subscripts(ws, 1) AS i, unnest(ws) AS word, unnest(gaps[1:len(ws)]) AS gap, len(ws) AS last FROM split WHERE len(ws) > 0)
), joined AS (
  SELECT *, found AND coalesce(lag(found) OVER o, false) AND regexp_full_match(gap, '[\x20\x09]+') AS goes_on FROM w WINDOW o AS (PARTITION BY rid ORDER BY i)
), numbered AS MATERIALIZED (SELECT *, sum((NOT goes_on)::INT) OVER (PARTITION BY rid ORDER BY i) AS run FROM joined),
long AS (SELECT rid, run, min(i) AS i, max(i) AS j, string_agg(CASE WHEN goes_on THEN gap || word ELSE word END, '' ORDER BY i) AS token, max("end") AS "end" FROM numbered WHERE found GROUP BY rid, run HAVING count(*) > 1),
named AS MATERIALIZED (SELECT n.rid, n.i, n.word, n.last, n.found, n."end", long.run IS NOT NULL AND n.found AS inside FROM numbered n LEFT JOIN long ON long.rid = n.rid AND long.run = n.run),
item AS (
  SELECT rid, i, i AS j, word AS token, "end", false AS whole FROM named WHERE found
  UNION ALL SELECT rid, i, j, token, "end", true FROM long
), around AS (
  SELECT item.rid, item."end" - length(token) AS start, item."end", token,
    CASE WHEN CASE WHEN whole THEN before.inside ELSE before.found END THEN '' ELSE coalesce(before.word, '') END AS "left",
    CASE WHEN item.i = 1 THEN '^' WHEN CASE WHEN whole THEN before.inside ELSE before.found END THEN '' ELSE before.word END AS b,
    CASE WHEN after.word IS NULL THEN '$' WHEN CASE WHEN whole THEN after.inside ELSE after.found END THEN '' ELSE after.word END AS a
  FROM item LEFT JOIN named before ON before.rid = item.rid AND before.i = item.i - 1 LEFT JOIN named after ON after.rid = item.rid AND after.i = item.j + 1
), marked AS (
  SELECT t.rid, t.start::BIGINT AS start, t."end"::BIGINT AS "end", any_value(token) AS token, any_value("left") AS "left", any_value(b) AS b, any_value(a) AS a, min(kind) AS kind
  FROM around t LEFT JOIN base ON base.rid = t.rid AND base.start < t."end" AND base."end" > t.start GROUP BY t.rid, t.start, t."end"
), seen AS MATERIALIZED (
  SELECT rid, start, "end", kind, lower(token) AS instance, 's ' || regexp_replace(lower("left"), '[0-9]', '9', 'g') || ' ' || regexp_replace(regexp_replace(lower(token), '[0-9]', '9', 'g'), '\p{{L}}+', 'a', 'g') AS pattern FROM marked
  UNION ALL SELECT rid, start, "end", kind, lower(token), 'c ' || regexp_replace(lower(b || ' ' || a), '[0-9]', '9', 'g') FROM marked WHERE b <> '' AND a <> '' AND (b <> '^' OR a <> '$')
), e AS MATERIALIZED (SELECT pattern, instance, max(kind) AS kind FROM seen GROUP BY pattern, instance),
e0 AS (SELECT *, CASE WHEN kind IS NULL THEN 0.0 ELSE 1.0 END AS score FROM e), p0 AS MATERIALIZED ({_patterns("e0")}),
e1 AS ({_scores("p0")}), p1 AS MATERIALIZED ({_patterns("e1")}),
e2 AS ({_scores("p1")}), p2 AS ({_patterns("e2")}),
kinds AS (SELECT pattern, kind, row_number() OVER (PARTITION BY pattern ORDER BY count(*) DESC, kind) AS place FROM e WHERE kind IS NOT NULL GROUP BY pattern, kind),
more AS (
  SELECT rid, start, "end", max(row(p2.seeds, kinds.kind))[2] AS kind
  FROM seen JOIN p2 USING (pattern) JOIN kinds ON kinds.pattern = seen.pattern AND place = 1 WHERE seen.kind IS NULL AND p2.mean >= 0.8 AND p2.seeds >= 5 GROUP BY rid, start, "end"
), listed AS (
  SELECT rid, kind, start, "end", true AS is_base FROM base UNION ALL SELECT rid, kind, start, "end", false FROM more
), texts AS (
  SELECT *, ['email', 'ip', 'card', 'phone'][kind + 1] || ':' || start || ':' || "end" AS t FROM listed
), done AS (
  SELECT rid, count(*) FILTER (is_base AND kind = 0) AS n_email, count(*) FILTER (is_base AND kind = 1) AS n_ip, count(*) FILTER (is_base AND kind = 2) AS n_card, count(*) FILTER (is_base AND kind = 3) AS n_phone,
    string_agg(t, ',' ORDER BY kind, start, "end") FILTER (is_base) AS base, string_agg(t, ',' ORDER BY kind, start, "end") AS spans
  FROM texts GROUP BY rid
)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN done USING (rid)
"""

# Windows are told apart by their MD5. Blocks of 1,000 windows keep the cost of finding a window's place low.
REPEATS = """
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
block AS (SELECT rid, b, substr(x, 2 * b + 1, 2 * 1199) AS part FROM (SELECT rid, x, unnest(range(0, length(x) // 2, 1000)) AS b FROM d)),
win AS MATERIALIZED (SELECT rid, b + k AS p, md5_number(substr(part, 2 * k + 1, 400)) AS h FROM (SELECT rid, b, part, unnest(range(0, least(1000, length(part) // 2 - 199))) AS k FROM block)),
hit AS (SELECT rid, p FROM win JOIN (SELECT h FROM win GROUP BY h HAVING count(*) > 1) USING (h)),
edge AS (SELECT rid, p, coalesce(p - lag(p) OVER (PARTITION BY rid ORDER BY p) > 200, true) AS opens FROM hit),
island AS (SELECT rid, p, sum(opens::INT) OVER (PARTITION BY rid ORDER BY p) AS n FROM edge),
span AS (SELECT rid, min(p) AS lo, max(p) + 200 AS hi FROM island GROUP BY rid, n),
before AS (SELECT rid, lo, hi, coalesce(lag(hi) OVER (PARTITION BY rid ORDER BY lo), 0) AS since FROM span),
cut AS (
  SELECT d.rid, count(*) AS n_spans, sum(hi - lo) AS n_removed, string_agg(substr(x, 2 * since + 1, 2 * (lo - since)), '' ORDER BY lo) || substr(any_value(x), 2 * max(hi) + 1) AS kept
  FROM before JOIN d USING (rid) GROUP BY d.rid
)
SELECT doc_id, length(x) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM d LEFT JOIN cut USING (rid)
"""
