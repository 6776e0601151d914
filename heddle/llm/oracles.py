"""DuckDB statements that give the rows of those queries which SQL can express."""

OP9 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, regexp_replace(regexp_replace(replace(text, '\', '\\'), '<(/?s>|</?SYS>>)', '<\\\1', 'g'), '\[(/?INST\])', '[\\\1', 'g') AS kept FROM t
)
SELECT conv_id,
  count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<s>' || role || chr(10) || kept || '</s>' || chr(10))) AS BIGINT) AS formatted_chars,
  regexp_full_match(string_agg(role, ',' ORDER BY turn, role, text), '(system,)?user(,assistant,user)*(,assistant)?') AS valid
FROM e GROUP BY conv_id
"""

_FORM = "CASE WHEN regexp_full_match({0}, '[0-9a-f]{{8,}}') AND regexp_matches({0}, '[0-9]') THEN '*' ELSE regexp_replace({0}, '[0-9]+', '*', 'g') END"

_LEVEL = """
c{i} AS (SELECT host, done, segs[{i}] AS here, sum(n) AS n FROM t{p} WHERE segs[{i}] IS NOT NULL GROUP BY 1, 2, 3),
n{i} AS (SELECT host, done, sum(n) AS pages, count(DISTINCT CASE WHEN form = here THEN here END) AS plain, sum(n) FILTER (form = here) AS plain_pages FROM (SELECT *, {form} AS form FROM c{i}) GROUP BY 1, 2),
k{i} AS (SELECT c.host, c.done, c.here FROM c{i} c JOIN n{i} n ON c.host = n.host AND c.done = n.done WHERE c.n >= 5 AND c.n * 4 >= n.pages),
w{i} AS (SELECT host, done FROM n{i} WHERE plain >= 20 AND plain_pages < 5 * plain),
t{i} AS (SELECT t.host, t.segs, t.n, t.labelled, t.bad, CASE WHEN t.segs[{i}] IS NULL THEN t.done ELSE list_append(t.done,
    CASE WHEN k.here IS NOT NULL THEN t.segs[{i}] WHEN w.host IS NOT NULL AND {tform} = t.segs[{i}] THEN '*' ELSE {tform} END) END AS done
  FROM t{p} t LEFT JOIN k{i} k ON t.host = k.host AND t.done = k.done AND t.segs[{i}] = k.here LEFT JOIN w{i} w ON t.host = w.host AND t.done = w.done),"""

OP2 = (
    r"""
WITH a AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
v AS (SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule,
  CASE WHEN rule IS NULL THEN NULL WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' ELSE 'block' END AS verdict,
  list_transform(list_filter(string_split(path, '/'), lambda x: x != ''), lambda x: lower(x)) AS segs FROM b),
t0 AS (SELECT host, segs, count(*) AS n, count(verdict) AS labelled, count(*) FILTER (verdict = 'block') AS bad, CAST([] AS VARCHAR[]) AS done FROM v GROUP BY 1, 2),"""
    + "".join(_LEVEL.format(i=i, p=i - 1, form=_FORM.format("here"), tform=_FORM.format(f"t.segs[{i}]")) for i in (1, 2, 3, 4))
    + """
f AS (SELECT host, segs, n, labelled, bad, done || list_transform(list_slice(segs, 5, len(segs)), lambda x: """
    + _FORM.format("x")
    + r""") AS done FROM t4),
template AS (SELECT host, done, coalesce(done[1], '') AS branch, array_to_string(list_slice(done, 2, len(done)), '/') AS rest, sum(n) AS n, sum(labelled) AS labelled, sum(bad) AS bad FROM f GROUP BY 1, 2),
branch AS (SELECT host, branch, sum(n) AS n, sum(labelled) AS labelled, sum(bad) AS bad FROM template GROUP BY 1, 2),
host_rest AS (SELECT host, rest, sum(n) AS m FROM template GROUP BY 1, 2),
host AS (SELECT host, sum(m) AS n, count(*) AS kinds FROM host_rest GROUP BY 1),
unlike AS (SELECT t.host, branch, sum(t.n * t.n * h.n / r.m) AS s FROM template t JOIN host_rest r ON t.host = r.host AND t.rest = r.rest JOIN host h ON t.host = h.host GROUP BY 1, 2),
alike AS (SELECT b.host, b.branch, b.labelled, b.bad, u.s / b.n - b.n <= h.kinds - 1 + 3 * sqrt(2 * (h.kinds - 1)) + 1e-6 AS alike FROM branch b JOIN unlike u ON b.host = u.host AND b.branch = u.branch JOIN host h ON b.host = h.host),
first AS (SELECT host, coalesce(sum(bad) / nullif(sum(labelled), 0), 0.5) AS rate FROM alike WHERE alike GROUP BY 1),
agree AS (SELECT a.*, a.alike AND abs(a.bad - a.labelled * f.rate) <= 3 * sqrt(a.labelled * f.rate * (1 - f.rate)) + 0.5 AS pooled FROM alike a LEFT JOIN first f ON a.host = f.host),
pool AS (SELECT host, sum(labelled) AS labelled, sum(bad) AS bad FROM agree WHERE pooled GROUP BY 1),
hosts AS (SELECT host, CASE WHEN regexp_matches(host, '^[0-9.]*$') THEN host ELSE regexp_extract(host, '([^.]*\.?[^.]*)$', 1) END AS domain, sum(labelled) AS labelled, sum(bad) AS bad FROM branch GROUP BY 1),
domains AS (SELECT domain, (sum(bad) + 1) / (sum(labelled) + 2) AS prior FROM hosts GROUP BY 1),
prior AS (SELECT a.host, a.branch, (CASE WHEN a.pooled THEN p.bad ELSE a.bad END + 2 * (h.bad + 2 * d.prior) / (h.labelled + 2)) / (CASE WHEN a.pooled THEN p.labelled ELSE a.labelled END + 2) AS prior
  FROM agree a JOIN hosts h ON a.host = h.host JOIN domains d ON h.domain = d.domain LEFT JOIN pool p ON a.host = p.host),
score AS (SELECT t.host, t.done, (t.bad + 2 * p.prior) / (t.labelled + 2) AS purity FROM template t JOIN prior p ON t.host = p.host AND t.branch = p.branch)
SELECT v.page_id, v.host, v.path, v.rule, coalesce(v.verdict, CASE WHEN round(s.purity, 6) >= 0.8 THEN 'block' ELSE 'allow' END) AS verdict, '/' || array_to_string(f.done, '/') AS template, round(s.purity, 6) AS purity
FROM v JOIN f ON v.host = f.host AND v.segs = f.segs JOIN score s ON f.host = s.host AND f.done = s.done
"""
)

OP10 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, h, unnest(range(0, (length(h) // 2 + 499) // 500)) AS c FROM d),
p AS (SELECT doc_id, c, substr(h, 1000 * c + 1, 1098) AS s FROM c),
b AS (SELECT doc_id, c, s, unnest(range(1, least(500, length(s) // 2) + 1)) AS i FROM p),
w AS (SELECT doc_id, 500 * c + i AS i, substr(s, 2 * i - 1, 2) AS byte, CASE WHEN 2 * i + 98 <= length(s) THEN md5(substr(s, 2 * i - 1, 100)) END AS win FROM b),
m AS (SELECT win, min(doc_id) AS least FROM w WHERE win IS NOT NULL GROUP BY 1),
f AS (SELECT w.doc_id, i, byte, coalesce(m.least < w.doc_id, false) AS start FROM w LEFT JOIN m USING (win)),
g AS (SELECT doc_id, i, byte, max(start::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM f),
e AS (SELECT *, lag(gone, 1, 0) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM g),
k AS (SELECT doc_id, CAST(sum(gone) AS BIGINT) AS n_removed, count(*) FILTER (gone = 1 AND before = 0) AS n_spans, string_agg(byte, '' ORDER BY i) FILTER (gone = 0) AS kept FROM e GROUP BY 1)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
