"""Queries of the remaining operators: stores and logs, scoring, text functions, graphs, change sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from heddle.functions import globs, hashing, text
from heddle.functions.severity import LEVELS
from heddle.operators import changes, graph, relate, scoring, state
from heddle.operators import feedback as fb
from heddle.plans import views as v
from heddle.plans.code import CODE, PATHS, code_lines
from heddle.plans.tables import durable
from heddle.sources import diffs, sinks

QUERIES: dict = {}
SQL: dict[str, str] = {}
AS_OF = "2024-02-01 00:00:00"
_ORD = "list_position(" + str(list(LEVELS)) + ", severity)"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql.replace("count_if(", "count(*) FILTER (")
        return f

    return add


# Diffs: each order's file as a patch

_BODY = "CASE op WHEN 'add' THEN '+' WHEN 'delete' THEN '-' ELSE ' ' END || content"


@query(f"""WITH {CODE}, o AS (SELECT *, pos - 1 + 10 - count(*) FILTER (op = 'delete') OVER w AS new_line, pos - 1 + 5 - count(*) FILTER (op = 'add') OVER w AS old_line FROM cl WINDOW w AS (PARTITION BY change_set, path ORDER BY pos))
SELECT change_set, path, CASE WHEN status = 'modified' THEN 'modified' ELSE status END AS status, op, pos, CASE WHEN op != 'delete' THEN new_line END AS line, CASE WHEN op != 'add' THEN old_line END AS old_line, content FROM o""")
def parsed_patches(spark, d):
    sign = F.when(F.col("op") == "add", "+").when(F.col("op") == "delete", "-").otherwise(" ")
    one = code_lines(spark, d).groupBy("change_set", "path", "status").agg(F.array_sort(F.collect_list(F.struct("pos", F.concat(sign, "content").alias("t")))).alias("body"))
    old, new = F.when(F.col("status") == "added", "/dev/null").otherwise(F.concat(F.lit("a/"), "path")), F.when(F.col("status") == "deleted", "/dev/null").otherwise(F.concat(F.lit("b/"), "path"))
    mark = F.when(F.col("status") == "added", "\nnew file mode 100644").when(F.col("status") == "deleted", "\ndeleted file mode 100644").otherwise("")
    head = F.concat(F.lit("diff --git a/"), "path", F.lit(" b/"), "path", mark, F.lit("\n--- "), old, F.lit("\n+++ "), new, F.lit("\n@@ -5,8 +10,8 @@\n"))
    patch = one.select("change_set", "path", F.concat(head, F.array_join(F.transform("body", lambda x: x["t"]), "\n")).alias("p"))
    whole = patch.groupBy("change_set").agg(F.array_join(F.array_sort(F.collect_list("p")), "\n").alias("patch"))
    return diffs.parse_diff(whole).drop("hunk")


@query(f"""WITH {CODE} SELECT change_set, count(DISTINCT path) AS files, count_if(op = 'add') AS additions, count_if(op = 'delete') AS deletions FROM cl GROUP BY 1""")
def patch_totals(spark, d):
    return diffs.totals(code_lines(spark, d).withColumn("hunk", F.lit(1)))


@query(f"""WITH {CODE} SELECT DISTINCT change_set, path AS file, line FROM cl WHERE op != 'delete'""")
def commentable_lines(spark, d):
    return diffs.valid_lines(code_lines(spark, d))


@query(f"""WITH {CODE}, e AS (SELECT change_set, line, regexp_replace(path, '\\.[A-Za-z0-9]+$', '') AS source, ltrim(regexp_replace(path, '/?[^/]*$', '') || '/' || regexp_extract(content, 'from ''\\./([^'']*)''', 1), '/') AS target FROM cl WHERE op = 'add' AND regexp_matches(content, '^\\s*import\\s+.*from\\s+''\\./'))
SELECT DISTINCT change_set, source, target, 'import' AS kind, line FROM e WHERE source != target""")
def import_graph(spark, d):
    return diffs.import_edges(code_lines(spark, d))


# Stores

_STORED = "st AS (SELECT o_orderkey % 2000 AS id, max(o_custkey) AS owner, max(o_totalprice) AS total, max(o_orderdate) AS seen FROM orders WHERE o_orderstatus = 'O' GROUP BY 1), nw AS (SELECT o_orderkey % 2000 AS id, max(o_custkey) AS owner, max(o_totalprice) AS total, max(o_orderdate) AS seen FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)"


def _stored(spark, d, status):
    o = v.table(spark, d, "orders").where(F.col("o_orderstatus") == status)
    return o.groupBy((F.col("o_orderkey") % 2000).alias("id")).agg(F.max("o_custkey").alias("owner"), F.max("o_totalprice").alias("total"), F.max("o_orderdate").alias("seen"))


@query(f"WITH {_STORED} SELECT * FROM st WHERE id NOT IN (SELECT id FROM nw) UNION ALL SELECT * FROM nw")
def upsert_by_key(spark, d):
    return state.upsert(_stored(spark, d, "O"), _stored(spark, d, "F"), ["id"])


@query(f"WITH {_STORED} SELECT * FROM st UNION ALL SELECT * FROM nw WHERE id NOT IN (SELECT id FROM st)")
def insert_unless_present(spark, d):
    return state.insert_new(_stored(spark, d, "O"), _stored(spark, d, "F"), ["id"])


@query(f"WITH {_STORED} SELECT id, owner, total, seen FROM st WHERE seen >= TIMESTAMP '1998-01-01' - INTERVAL 365 DAYS")
def expired_log(spark, d):
    return state.expire(_stored(spark, d, "O"), "seen", "1998-01-01 00:00:00", 365)


@query(f"WITH {_STORED} SELECT id, owner, total, seen FROM (SELECT *, row_number() OVER (PARTITION BY owner % 10 ORDER BY seen DESC, id) AS n FROM (SELECT *, owner % 10 AS k FROM st)) WHERE n <= 20")
def capped_log(spark, d):
    s = _stored(spark, d, "O").withColumn("k", F.col("owner") % 10)
    return state.evict(s, [F.desc("seen"), "id"], 20, ["k"]).drop("k")


@query(f"""WITH {_STORED}, h AS (SELECT o_orderkey % 2000 AS id, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) SELECT id, owner + coalesce(n, 0) AS hit_count, CASE WHEN n > 0 THEN TIMESTAMP '{AS_OF}' ELSE seen END AS last_hit_at FROM st LEFT JOIN h USING (id)""")
def hit_counters(spark, d):
    m = _stored(spark, d, "O").select("id", F.col("owner").alias("hit_count"), F.col("seen").alias("last_hit_at"))
    hits = v.table(spark, d, "orders").where("o_orderstatus = 'P'").select((F.col("o_orderkey") % 2000).alias("id"))
    return state.count_hits(m, hits, AS_OF)


@query(f"""WITH {_STORED} SELECT coalesce(st.id, nw.id) AS id, coalesce(nw.total, st.total) AS confidence, coalesce(nw.owner, st.owner) AS total, coalesce(st.seen, nw.seen) AS created_at, coalesce(st.owner % 2 = 0, true) AS enabled FROM st FULL JOIN nw ON st.id = nw.id""")
def merged_rules(spark, d):
    s, m = (_stored(spark, d, x).select("id", F.col("total").alias("confidence"), F.col("owner").alias("total"), F.col("seen").alias("created_at")) for x in "OF")
    return fb.merge_rules(s.withColumn("enabled", F.col("total") % 2 == 0), m)


_SUGGEST = f"sg AS (SELECT *, 'h' || id % 500 AS message_hash FROM fb), up AS (SELECT 'h' || o_custkey % 700 AS message_hash, max(CASE WHEN o_orderstatus = 'F' THEN 'unhelpful' ELSE 'helpful' END) AS o FROM orders GROUP BY 1)"


@query(f"""WITH {v.FEEDBACK}, {_SUGGEST} SELECT id, sg.message_hash, CASE WHEN outcome = 'pending' AND o IS NOT NULL THEN o ELSE outcome END AS outcome, outcome = 'pending' AND o IS NOT NULL AS changed FROM sg LEFT JOIN up ON sg.message_hash = up.message_hash""")
def resolved_outcomes(spark, d):
    s = v.feedback(spark, d).select("id", F.concat(F.lit("h"), F.col("id") % 500).alias("message_hash"), "outcome")
    u = v.table(spark, d, "orders").select(F.concat(F.lit("h"), F.col("o_custkey") % 700).alias("message_hash"), F.when(F.col("o_orderstatus") == "F", "unhelpful").otherwise("helpful").alias("outcome"))
    return fb.resolve_outcomes(s, u)


@query(f"""WITH {v.FEEDBACK} SELECT repo, count(*) AS n, min(created_at) AS first_seen, max(created_at) AS last_seen FROM fb GROUP BY 1""")
def history_by_repo(spark, d):
    return v.feedback(spark, d).groupBy("repo").agg(F.count(F.lit(1)).alias("n"), F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"))


# Scores of findings

_CONF = "CASE category WHEN 'security' THEN 'promote' WHEN 'style' THEN 'demote' WHEN 'bug' THEN 'neutral' END"


@query(f"""WITH {v.FINDINGS}, w AS (SELECT *, {_CONF} AS w, {_ORD} AS n FROM fi), m AS (SELECT *, CASE WHEN w = 'demote' AND n > 1 THEN -1 WHEN w = 'promote' AND n < 5 THEN 1 ELSE 0 END AS step FROM w)
SELECT change_set, file, line, category, {list(LEVELS)}[n + step] AS severity, greatest(0, least(100, confidence + 10 * step)) AS confidence FROM m""")
def learned_findings(spark, d):
    f = v.findings(spark, d).select("change_set", "file", "line", "category", "severity", "confidence")
    return fb.apply_learning(f, spark.createDataFrame([("security", "promote"), ("style", "demote"), ("bug", "neutral")], "category string, weight string"))


@query(f"""WITH {v.FINDINGS} SELECT change_set, file, line, category, severity, CASE WHEN category = 'style' AND severity IN ('low', 'nitpick') AND confidence > 50 THEN greatest(50, confidence - 25) ELSE confidence END AS confidence FROM fi""")
def quieter_findings(spark, d):
    f = v.findings(spark, d).select("change_set", "file", "line", "category", "severity", "confidence")
    return fb.reduce_noise(f, spark.createDataFrame([("style", "low"), ("style", "nitpick")], "category string, severity string"))


@query(f"""WITH {v.FINDINGS} SELECT change_set, file, line, category, CASE WHEN category = 'style' THEN least(confidence, greatest(10, confidence - 30)) ELSE confidence END AS confidence FROM fi""")
def attributed_findings(spark, d):
    f = v.findings(spark, d).select("change_set", "file", "line", "category", "confidence")
    return fb.apply_attribution(f, spark.createDataFrame([("style", 30, True), ("bug", 40, False), ("security", 0, True)], "category string, penalty int, reliable boolean"))


@query(f"""WITH {v.FINDINGS} SELECT change_set, file, greatest(line, 1) AS line, CAST(CASE WHEN confidence IS NULL THEN 50 ELSE greatest(0, least(100, confidence)) END AS INT) AS confidence FROM (SELECT change_set, file, line - 3 AS line, CASE WHEN size % 9 = 0 THEN NULL ELSE confidence * 2 - 40 END AS confidence FROM fi)""")
def repaired_findings(spark, d):
    f = v.findings(spark, d)
    return scoring.repair(f.select("change_set", "file", (F.col("line") - 3).alias("line"), F.when(F.col("size") % 9 != 0, F.col("confidence") * 2 - 40).alias("confidence")))


_SIGNALS = ("ci", "test", "lint", "formatter", "container", "dependency", "env", "ownership", "docs", "security")


@query(f"""WITH w AS (SELECT unnest(['ci', 'test', 'lint', 'formatter', 'container', 'dependency', 'env', 'ownership', 'docs', 'security']) AS signal, unnest([1.0, 1.2, 0.8, 0.5, 0.6, 1.0, 0.7, 0.8, 0.6, 1.0]::DOUBLE[]) AS w),
s AS (SELECT o_custkey AS repo, {list(_SIGNALS)}[1 + o_orderkey % 10] AS signal, o_orderkey % 11 AS score, 10 AS most FROM orders),
h AS (SELECT repo, CAST(floor(sum(score * w) * 100 / sum(most * w) + 0.5) AS INT) AS health FROM s JOIN w USING (signal) GROUP BY 1)
SELECT repo, health, CASE WHEN health >= 90 THEN 'A' WHEN health >= 80 THEN 'B' WHEN health >= 70 THEN 'C' WHEN health >= 60 THEN 'D' WHEN health >= 50 THEN 'E' ELSE 'F' END AS grade FROM h""")
def repo_health(spark, d):
    o = v.table(spark, d, "orders")
    name = F.get(F.array(*map(F.lit, _SIGNALS)), (F.col("o_orderkey") % 10).cast("int"))
    return scoring.health(o.select(F.col("o_custkey").alias("repo"), name.alias("signal"), (F.col("o_orderkey") % 11).alias("score"), F.lit(10).alias("most"), "o_orderkey"), "o_orderkey")


@query(f"""WITH {v.FINDINGS}, l AS (SELECT change_set, list_sort(list_filter([CASE WHEN bool_or(category = 'security') THEN 'needs-security-review' END, CASE WHEN bool_or(category = 'bug') THEN 'has-bugs' END, CASE WHEN bool_or(category = 'performance') THEN 'performance' END, CASE WHEN bool_or(severity = 'critical') THEN 'critical-findings' END], lambda x: x IS NOT NULL)) AS want,
  CASE WHEN change_set % 2 = 0 THEN ['has-bugs', 'old'] ELSE ['performance'] END AS have FROM fi GROUP BY 1)
SELECT change_set, array_to_string(list_filter(want, lambda x: NOT list_contains(have, x)), ',') AS added, array_to_string(list_filter(have, lambda x: NOT list_contains(want, x)), ',') AS removed FROM l""")
def label_changes(spark, d):
    want = F.filter(F.split("labels", ","), lambda x: x != "")
    have = F.when(F.col("change_set") % 2 == 0, F.array(F.lit("has-bugs"), F.lit("old"))).otherwise(F.array(F.lit("performance")))
    add, gone = scoring.label_delta(want, have)
    return scoring.labels(v.findings(spark, d)).select("change_set", F.array_join(add, ",").alias("added"), F.array_join(gone, ",").alias("removed"))


@query(f"""WITH {CODE}, f AS (SELECT change_set, path, count_if(op = 'add') * 90 AS plus, count_if(op = 'delete') AS minus FROM cl GROUP BY 1, 2), t AS (SELECT change_set, sum(plus) AS plus, sum(minus) AS minus FROM f GROUP BY 1),
fam AS (SELECT change_set, max(n) AS family FROM (SELECT change_set, regexp_extract('part' || path, '^(.*\\D)\\d+\\.\\w+$', 1) AS stem, count(*) AS n FROM f GROUP BY 1, 2) WHERE stem != '' GROUP BY 1),
c AS (SELECT change_set, repeat(content, 5) || CASE WHEN pos = 3 THEN ' in conclusion' ELSE '' END AS content FROM cl WHERE op = 'add'), g AS (SELECT change_set, content, count(*) AS n FROM c GROUP BY 1, 2),
s AS (SELECT change_set, sum(n) AS every, sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS again, sum(length(content) * n) / sum(n) AS mean, {' + '.join(f"CAST(bool_or(regexp_matches(content, '{m.replace(chr(39), chr(39) * 2)}')) AS INT)" for m in scoring.MARKERS)} AS marks FROM g GROUP BY 1),
x AS (SELECT change_set, CASE WHEN plus > 500 AND (minus = 0 OR plus > 10 * minus) THEN 30 ELSE 0 END + CASE WHEN mean > 120 THEN 25 ELSE 0 END + CASE WHEN again > 0.2 * every THEN 30 ELSE 0 END + coalesce(least(20 * marks, 40), 0) + CASE WHEN family > 5 THEN 20 ELSE 0 END AS score FROM t LEFT JOIN s USING (change_set) LEFT JOIN fam USING (change_set))
SELECT change_set, score, score >= 60 AS slop FROM x""")
def slop_scores(spark, d):
    c = code_lines(spark, d)
    files = c.groupBy("change_set", "path").agg((F.count_if(F.col("op") == "add") * 90).alias("additions"), F.count_if(F.col("op") == "delete").alias("deletions"))
    added = c.where("op = 'add'").select("change_set", F.concat(F.repeat("content", F.lit(5)), F.when(F.col("pos") == 3, " in conclusion").otherwise("")).alias("content"))
    return scoring.slop(files.withColumn("path", F.concat(F.lit("part"), "path")), added)


# Text functions

_NAMES = ("@acme/kit/sub", "lodash/fp", "react", "./near", "@scope/x")


@query(f"""SELECT o_orderkey, CASE WHEN n LIKE '@%' THEN array_to_string(string_split(n, '/')[1:2], '/') ELSE split_part(n, '/', 1) END AS root, 'a/b/' || CASE o_orderkey % 3 WHEN 0 THEN 'c' WHEN 1 THEN 'x/y' ELSE 'd' END AS near, CASE o_orderkey % 3 WHEN 0 THEN 'a/up' WHEN 1 THEN 'up2' ELSE 'a/b/c' END AS far
FROM (SELECT o_orderkey, {list(_NAMES)}[1 + o_orderkey % 5] AS n FROM orders)""")
def import_paths(spark, d):
    pick = lambda items, k: F.get(F.array(*map(F.lit, items)), (F.col("o_orderkey") % k).cast("int"))
    o = v.table(spark, d, "orders")
    base = F.lit("a/b")
    return o.select("o_orderkey", text.package_root(pick(_NAMES, 5)).alias("root"), text.resolve_relative(base, pick(("./c", "x/y", "./e/../d"), 3)).alias("near"), text.resolve_relative(base, pick(("../up", "../../up2", "././c"), 3)).alias("far"))


@query("""SELECT doc_id, replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS html, format('{:,}', n) AS exact,
 CASE WHEN n >= 1000000 THEN printf('%.1fM', floor(n / 100000.0 + 0.5) / 10) WHEN n >= 1000 THEN printf('%.1fK', floor(n / 100.0 + 0.5) / 10) ELSE CAST(n AS VARCHAR) END AS brief
FROM (SELECT doc_id, '<a href="x">' || source || '</a> & ''q''' AS t, CAST(doc_id * 1237 AS BIGINT) AS n FROM documents)""")
def shown_texts(spark, d):
    t = F.concat(F.lit('<a href="x">'), "source", F.lit("</a> & 'q'"))
    n = (F.col("doc_id") * 1237).cast("bigint")
    return v.table(spark, d, "documents").select("doc_id", text.escape_html(t).alias("html"), text.thousands(n).alias("exact"), text.short_number(n).alias("brief"))


@query("""SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE left(text, 140) || chr(10) || '...' || chr(10) || right(text, 60) END AS short FROM documents""")
def shortened_texts(spark, d):
    return v.table(spark, d, "documents").select("doc_id", text.head_and_tail(F.col("text"), 200).alias("short"))


@query("""WITH t AS (SELECT o_orderkey, 'fixes #' || o_custkey || ' and AB-' || o_orderkey || ', see #' || o_custkey AS t FROM orders) SELECT o_orderkey, array_to_string(list_sort(['#' || split_part(split_part(t, '#', 2), ' ', 1), 'AB-' || o_orderkey]), ',') AS refs FROM t""")
def issue_links(spark, d):
    t = F.concat(F.lit("fixes #"), "o_custkey", F.lit(" and AB-"), "o_orderkey", F.lit(", see #"), "o_custkey")
    return v.table(spark, d, "orders").select("o_orderkey", F.array_join(F.array_sort(text.issue_references(t)), ",").alias("refs"))


@query("""WITH n AS (SELECT DISTINCT p_name AS a, split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) AS b FROM part), t AS (SELECT a, b, list_sort(list_distinct(string_split(lower(a), ' '))) AS x, list_sort(list_distinct(string_split(lower(b), ' '))) AS y FROM n WHERE regexp_full_match(a, '\\w+ \\w+'))
SELECT a, b, CASE WHEN x = y THEN 1.0::DOUBLE END AS ratio FROM t WHERE x = y""")
def token_sets(spark, d):
    n = v.table(spark, d, "part").select(F.col("p_name").alias("a"), F.concat_ws(" ", F.split_part("p_name", F.lit(" "), F.lit(2)), F.split_part("p_name", F.lit(" "), F.lit(1))).alias("b")).distinct()
    return n.where(F.col("a").rlike(r"\A\w+ \w+\z")).select("a", "b", text.token_set_ratio(F.col("a"), F.col("b")).alias("ratio")).where("ratio = 1")


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '[REDACTED]' WHEN 1 THEN 'v' || o_custkey ELSE '[REDACTED]' END AS value FROM orders""")
def redacted_settings(spark, d):
    key = F.get(F.array(F.lit("api_KEY"), F.lit("region"), F.lit("authToken")), (F.col("o_orderkey") % 3).cast("int"))
    m = sinks.redact_config(F.create_map(key, F.concat(F.lit("v"), "o_custkey")))
    return v.table(spark, d, "orders").select("o_orderkey", F.get(F.map_values(m), F.lit(0)).alias("value"))


@query("""SELECT o_orderkey, least(5, 1 + CAST(o_custkey > 500 AS INT) + CAST(o_custkey > 1500 AS INT) + CAST(o_orderkey % 30 > 5 AS INT) + CAST(o_orderkey % 30 > 15 AS INT)) AS effort FROM orders""")
def review_effort(spark, d):
    return v.table(spark, d, "orders").select("o_orderkey", changes.effort(F.col("o_custkey"), F.col("o_orderkey") % 30).alias("effort"))


@query("""WITH s AS (SELECT o_custkey AS run_id, count(*) AS stages, count_if(o_orderstatus = 'F') AS failed FROM orders GROUP BY 1), c AS (SELECT o_custkey AS run_id, ['anthropic', 'openai', 'local'][1 + o_orderkey % 3] AS provider, o_orderkey % 1000 AS i, o_orderkey % 700 AS o FROM orders),
t AS (SELECT run_id, CAST(sum(i + o) AS BIGINT) AS tokens, sum(i / 1000 * CASE provider WHEN 'anthropic' THEN 0.003::DOUBLE WHEN 'openai' THEN 0.002 ELSE 0.001 END + o / 1000 * CASE provider WHEN 'anthropic' THEN 0.015::DOUBLE WHEN 'openai' THEN 0.008 ELSE 0.003 END) AS cost FROM c GROUP BY 1)
SELECT run_id, stages, failed, tokens, floor(cost * 1000000 + 0.5) / 1000000 AS cost FROM s JOIN t USING (run_id)""")
def run_costs(spark, d):
    o = v.table(spark, d, "orders")
    provider = F.get(F.array(F.lit("anthropic"), F.lit("openai"), F.lit("local")), (F.col("o_orderkey") % 3).cast("int"))
    calls = o.select(F.col("o_custkey").alias("run_id"), provider.alias("provider"), (F.col("o_orderkey") % 1000).alias("input_tokens"), (F.col("o_orderkey") % 700).alias("output_tokens"))
    out = changes.run_summary(o.select(F.col("o_custkey").alias("run_id"), F.when(F.col("o_orderstatus") == "F", "failed").otherwise("ok").alias("status")), calls)
    return out.withColumn("cost", F.floor(F.col("cost") * 1000000 + 0.5) / 1000000)


@query("""SELECT p_partkey, CAST(list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(p_name, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda h, x: ((h * 31 + x + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648) AS BIGINT) AS signed FROM part""")
def rolling_hashes(spark, d):
    codes = F.transform(F.filter(F.split("p_name", ""), lambda x: x != ""), lambda x: F.ascii(x).cast("bigint"))
    return v.table(spark, d, "part").select("p_partkey", F.aggregate(codes, F.lit(0).cast("bigint"), lambda h, x: hashing._int32(h * 31 + x)).alias("signed"))


# Globs, change sets

_GLOBS = {"star": "src/*.ts", "double": "**/*.json", "owners": "docs/", "path": "{src,lib}/**/*.{ts,js}"}


@query(f"""WITH {CODE}, p AS (SELECT DISTINCT path FROM cl) SELECT path, regexp_matches(path, '^src/[^/]*\\.ts$') AS star, regexp_matches(path, '^.*/[^/]*\\.json$') AS double, regexp_matches(path, '^(.*/)?docs/.*$') AS owners, regexp_matches(path, '^(src|lib)/([^./][^/]*/)*[^./][^/]*\\.(ts|js)$') AS path_glob FROM p""")
def glob_dialects(spark, d):
    p = code_lines(spark, d).select("path").distinct()
    return p.select("path", *[globs.matches_any(F.col("path"), [g], k).alias("path_glob" if k == "path" else k) for k, g in _GLOBS.items()])


@query(f"""WITH {CODE}, a AS (SELECT DISTINCT change_set, path, CASE WHEN regexp_matches(path, '(?i)(^|/)(types?|config|schema|shared|common|lib)/') THEN 'foundation' ELSE regexp_extract(path, '^([^/]*/?[^/]*)/[^/]*$', 1) END AS area FROM cl),
n AS (SELECT change_set, area, count(*) AS files FROM a GROUP BY 1, 2), r AS (SELECT *, least(row_number() OVER (PARTITION BY change_set ORDER BY area != 'foundation', files DESC, area) - 1, 1) AS part FROM n),
p AS (SELECT change_set, part, array_to_string(list_sort(list(area)), '+') AS area, CAST(sum(files) AS BIGINT) AS files FROM r GROUP BY 1, 2)
SELECT change_set, CAST(part AS INT) AS part, area, files FROM p WHERE change_set IN (SELECT change_set FROM p GROUP BY 1 HAVING count(*) > 1)""")
def split_suggestions(spark, d):
    return changes.split_suggestions(code_lines(spark, d), most=2).select("change_set", F.col("part").cast("int").alias("part"), "area", "files")


@query(f"""WITH {v.FINDINGS}, n AS (SELECT category, 'f' || file AS path, count(*) AS n FROM fi GROUP BY 1, 2) SELECT * FROM n WHERE n >= 3""")
def mined_skills(spark, d):
    f = v.findings(spark, d)
    note = F.concat(F.lit("- ["), "category", F.lit("] f"), F.col("file").cast("string"), F.lit(": "), "message")
    return changes.mine_skills(f.groupBy("change_set").agg(F.array_join(F.collect_list(note), "\n").alias("text")))


@query(f"""WITH {v.FEEDBACK}, l AS (SELECT pr AS repo, category || ' in ' || file || ' ' || bucket AS text, max(id) AS pos FROM fb GROUP BY 1, 2), u AS (SELECT *, sum(length(text) + 1) OVER (PARTITION BY repo ORDER BY pos DESC ROWS UNBOUNDED PRECEDING) AS used FROM l) SELECT repo, text, pos FROM u WHERE used <= 320""")
def consolidated_memory(spark, d):
    f = v.feedback(spark, d)
    return changes.consolidate(f.select(F.col("pr").alias("repo"), F.col("id").alias("pos"), F.concat("category", F.lit(" in "), "file", F.lit(" "), "bucket").alias("text")), capacity=400)


@query(f"""WITH {v.FINDINGS} SELECT dir AS cohort, count(*) AS n, count(DISTINCT change_set) AS sets, count_if(severity = 'critical') AS critical, count_if(severity = 'high') AS high, count_if(severity = 'medium') AS medium, count_if(severity = 'low') AS low, count_if(severity = 'nitpick') AS nitpick FROM fi GROUP BY 1""")
def cohort_severities(spark, d):
    f = v.findings(spark, d)
    return f.groupBy(F.col("dir").alias("cohort")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("change_set").alias("sets"), *[F.count_if(F.col("severity") == s).alias(s) for s in reversed(LEVELS)])


@query("""SELECT conv_id, count(*) AS criteria, count_if(turn % 2 = 0) AS met, CAST(floor(count_if(turn % 2 = 0) * 100 / count(*) + 0.5) AS INT) AS coverage FROM conversations GROUP BY 1""")
def spec_coverage(spark, d):
    c = v.table(spark, d, "conversations")
    met = F.count_if(F.col("turn") % 2 == 0)
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("criteria"), met.alias("met"), F.floor(met * 100 / F.count(F.lit(1)) + 0.5).cast("int").alias("coverage"))


# Graphs


@query(f"""WITH RECURSIVE {v.EDGES}, nd AS (SELECT source AS n FROM ed UNION SELECT target FROM ed), r AS (SELECT source AS a, target AS b FROM ed UNION SELECT r.a, e.target FROM r JOIN ed e ON e.source = r.b)
SELECT x.a AS node, greatest(x.a, max(x.b)) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY 1 HAVING count_if(x.a != x.b) > 0""")
def cycle_components(spark, d):
    return graph.strong_components(v.edges(spark, d), durable)


@query(f"""WITH RECURSIVE {v.EDGES}, rev AS (SELECT DISTINCT target AS at, source AS node FROM ed WHERE source > 2), walk AS (SELECT s AS seed, s AS node, 0 AS depth FROM (SELECT unnest([0, 1, 2]) AS s) UNION SELECT walk.seed, rev.node, walk.depth + 1 FROM walk JOIN rev ON rev.at = walk.node WHERE walk.depth < 2),
w AS (SELECT seed, node, min(depth) AS depth FROM walk WHERE node > 2 GROUP BY 1, 2) SELECT CAST(seed AS BIGINT) AS seed, depth, count(*) AS nodes, CAST(min(node) AS BIGINT) AS first_node FROM w GROUP BY 1, 2""")
def blast_totals(spark, d):
    seeds = spark.range(3).select(F.col("id").alias("node"))
    b = graph.blast_radius(v.edges(spark, d), seeds, depth=2, keep=durable)
    return b.groupBy("seed", "depth").agg(F.count(F.lit(1)).alias("nodes"), F.min("node").alias("first_node")).orderBy("depth", "seed")


@query(f"""WITH {v.EDGES}, m AS (SELECT DISTINCT o_custkey AS n FROM orders WHERE o_orderkey % 7 = 0), t AS (SELECT DISTINCT o_custkey AS n FROM orders WHERE o_orderkey % 7 = 1) SELECT source, target, kind FROM ed WHERE source IN (SELECT n FROM m) AND target IN (SELECT n FROM t WHERE n NOT IN (SELECT n FROM m))""")
def export_conflicts(spark, d):
    o = v.table(spark, d, "orders")
    side = lambda k: o.where(F.col("o_orderkey") % 7 == k).select(F.col("o_custkey").alias("path")).distinct()
    return graph.export_conflicts(v.edges(spark, d), side(0), side(1))


@query(f"""WITH {CODE}, f AS (SELECT change_set, path, count_if(op = 'add') AS additions, count_if(op = 'delete') AS deletions FROM cl GROUP BY 1, 2) SELECT change_set,
 CASE WHEN bool_or(path LIKE 'src/auth%') THEN 'thorough' WHEN sum(additions + deletions) < 50 AND count(*) < 3 THEN 'light' ELSE 'standard' END AS tier FROM f GROUP BY 1""")
def review_tiers(spark, d):
    c = code_lines(spark, d)
    return changes.tier(c.groupBy("change_set", "path").agg(F.count_if(F.col("op") == "add").alias("additions"), F.count_if(F.col("op") == "delete").alias("deletions")), ["src/auth*"])


@query(f"""WITH {CODE}, f AS (SELECT change_set, path, count_if(op = 'add') AS additions, count_if(op = 'delete') AS deletions FROM cl GROUP BY 1, 2) SELECT change_set, CASE WHEN bool_and(regexp_matches(path, '(?i)\\.(json|ya?ml)$|(^|/)\\.github/')) THEN 'config' WHEN bool_or(path LIKE 'nothing%') THEN 'security' ELSE 'logic' END AS kind FROM (SELECT * FROM f WHERE NOT regexp_matches(path, 'Dockerfile|\\.env|\\.md|test|eslint|jest|\\.tf|auth')) GROUP BY 1""")
def change_kinds(spark, d):
    c = code_lines(spark, d).where(~F.col("path").rlike(r"Dockerfile|\.env|\.md|test|eslint|jest|\.tf|auth"))
    return changes.classify(c.groupBy("change_set", "path").agg(F.count_if(F.col("op") == "add").alias("additions"), F.count_if(F.col("op") == "delete").alias("deletions")))


@query(f"""WITH {v.FINDINGS} SELECT f.change_set, f.file, f.line, f.category, f.severity, f.confidence, CASE WHEN f.category = 'style' AND f.file % 10 = 3 THEN 1 WHEN f.category = 'bug' THEN 2 WHEN f.category = 'security' AND contains(f.message, 'steel') THEN 4 END AS suppressed_by FROM fi f""")
def suppressed_findings(spark, d):
    f = v.findings(spark, d).select("change_set", "file", "line", "category", "severity", "confidence", "message").withColumns({"repo": F.lit(1), "key": F.col("file"), "file": F.concat(F.lit("src/f"), F.col("file").cast("string"))})
    m = spark.createDataFrame([(1, 1, "style", "src/*3", "a"), (2, 1, "bug", "src/*", None), (3, 2, "bug", "*", None), (4, 1, "security", "src/*", "steel")], "id int, repo int, category string, file_pattern string, message_pattern string")
    out = relate.suppress(f.distinct(), m)
    return f.join(out.select(*f.columns, "suppressed_by"), f.columns).select("change_set", F.col("key").alias("file"), "line", "category", "severity", "confidence", "suppressed_by")
