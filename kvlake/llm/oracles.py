"""SQL that gives the rows of the queries that SQL can express: all by plain definitions, over whole tables."""

from __future__ import annotations

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

#: Windows of 200 bytes as hexadecimal text; spans are the unions of repeated ones.
SUBSTRINGS = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
n AS (SELECT *, length(h) // 2 AS n_bytes FROM d),
win AS (SELECT r, p, md5(substr(h, 2 * p + 1, 400)) AS w FROM (SELECT r, h, unnest(range(0, n_bytes - 199)) AS p FROM n WHERE n_bytes >= 200)),
often AS (SELECT w FROM win GROUP BY w HAVING count(*) > 1),
rep AS (SELECT r, p, CASE WHEN p - lag(p) OVER (PARTITION BY r ORDER BY p) <= 200 THEN 0 ELSE 1 END AS new FROM win SEMI JOIN often USING (w)),
isle AS (SELECT r, p, sum(new) OVER (PARTITION BY r ORDER BY p) AS k FROM rep),
span AS (SELECT r, k, min(p) AS a, max(p) + 200 AS b FROM isle GROUP BY r, k),
part AS (SELECT n.r, a, substr(h, 2 * coalesce(lag(b) OVER (PARTITION BY n.r ORDER BY a), 0) + 1, 2 * (a - coalesce(lag(b) OVER (PARTITION BY n.r ORDER BY a), 0))) AS x FROM n JOIN span USING (r)),
kept AS (SELECT r, string_agg(x, '' ORDER BY a) AS x FROM part GROUP BY r),
sums AS (SELECT r, sum(b - a) AS gone, count(*) AS spans, max(b) AS last FROM span GROUP BY r)
SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(x, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM n LEFT JOIN sums USING (r) LEFT JOIN kept USING (r)"""

JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
x AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
run AS (SELECT doc_id, string_agg(x, ' ') OVER five AS s, count(*) OVER five AS n FROM x WINDOW five AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
s AS (SELECT DISTINCT doc_id, s FROM run WHERE n = 5 UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
half AS (SELECT a, b FROM shared JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
link AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
reach AS (SELECT DISTINCT a, a AS b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)"""

#: The shortest run of 50 characters from each line on, and the shortest up to each line: those that stand earlier too go.
LINES = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
line AS (SELECT doc_id, unnest(ls) AS x, generate_subscripts(ls, 1) AS l FROM d WHERE text IS NOT NULL),
c AS (SELECT *, sum(length(x)) OVER (PARTITION BY doc_id ORDER BY l) AS after, sum(length(x)) OVER (PARTITION BY doc_id ORDER BY l) - length(x) AS before FROM line),
ahead AS (SELECT a.doc_id, a.l AS first, min(b.l) AS last FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.l >= a.l AND b.after - a.before >= 50 GROUP BY ALL),
back AS (SELECT b.doc_id, max(a.l) AS first, b.l AS last FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.l >= a.l AND b.after - a.before >= 50 GROUP BY b.doc_id, b.l),
run AS (SELECT * FROM ahead UNION SELECT * FROM back),
named AS (SELECT r.doc_id, first, last, last - first AS n, string_agg(x, chr(10) ORDER BY l) AS t FROM run r JOIN line i ON i.doc_id = r.doc_id AND l BETWEEN first AND last GROUP BY r.doc_id, first, last),
later AS (SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY n, t ORDER BY doc_id, first) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS l FROM later),
kept AS (SELECT i.doc_id, count(g.l) AS n_removed, string_agg(x, chr(10) ORDER BY i.l) FILTER (g.l IS NULL) AS t FROM line i LEFT JOIN gone g ON g.doc_id = i.doc_id AND g.l = i.l GROUP BY i.doc_id)
SELECT d.doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""

PASSAGES = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
x AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
run AS (SELECT r, p, md5(string_agg(x, ' ') OVER win) AS t, count(*) OVER win AS n FROM x WINDOW win AS (PARTITION BY r ORDER BY p ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
often AS (SELECT t FROM run WHERE n = 35 GROUP BY t HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(p, p + 35)) AS p FROM run SEMI JOIN often USING (t) WHERE n = 35),
kept AS (SELECT x.r, count(g.p) AS n_removed, string_agg(x, ' ' ORDER BY x.p) FILTER (g.p IS NULL) AS t FROM x LEFT JOIN gone g ON g.r = x.r AND g.p = x.p GROUP BY x.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)"""

SQL = {"op1_substrings": SUBSTRINGS, "op2_jaccard": JACCARD, "op5_lines": LINES, "op8_passages": PASSAGES}
