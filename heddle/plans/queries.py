"""The registered queries over the driver's tables, each with its DuckDB statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.functions import hashing, numbers, text
from heddle.functions.severity import LEVELS, ordinal
from heddle.operators import feedback as fb
from heddle.operators import frames, graph, relate, scoring, state
from heddle.plans import code, more
from heddle.plans import views as v
from heddle.plans.tables import durable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
AS_OF = "2024-02-01 00:00:00"


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql.replace("count_if(", "count(*) FILTER (")  # a BIGINT, as in Spark
        return f

    return add


def r6(c):
    return numbers.round_half_up(c, 6)


H31 = "(list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split({0}, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda h, x: ((h * 31 + x + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648))"
FNV = "lpad(lower(to_base(list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split({0}, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda h, x: (xor(h, x) * 16777619) % 4294967296), 16)), 8, '0')"

# Feedback


@query(f"WITH {v.FEEDBACK} SELECT category, count(*) AS total, count_if(outcome = 'helpful') AS accepted, floor(count_if(outcome = 'helpful') / count(*) * 1000000 + 0.5) / 1000000 AS rate FROM fb WHERE outcome != 'pending' GROUP BY 1")
def feedback_acceptance(spark, d):
    return fb.acceptance(v.feedback(spark, d), ["category"]).withColumn("rate", r6(F.col("rate")))


@query(f"WITH {v.FEEDBACK} SELECT category, severity, count(*) AS total, count_if(outcome = 'helpful') AS accepted FROM fb WHERE outcome != 'pending' GROUP BY 1, 2 HAVING count(*) >= 5 AND count_if(outcome = 'helpful') / count(*) < 0.3")
def suppressed_patterns(spark, d):
    return fb.suppressed(v.feedback(spark, d)).drop("rate")


@query(f"""WITH {v.FEEDBACK}, a AS (SELECT category, count(*) AS total, count_if(outcome = 'helpful') / count(*) AS rate FROM fb WHERE outcome != 'pending' GROUP BY 1)
SELECT category, total, CASE WHEN total < 5 THEN 'neutral' WHEN rate < 0.3 THEN 'demote' WHEN rate > 0.9 THEN 'promote' ELSE 'neutral' END AS weight FROM a""")
def learning_weights(spark, d):
    return fb.learning_class(v.feedback(spark, d)).select("category", "total", "weight")


@query(f"""WITH {v.FEEDBACK}, a AS (SELECT category, outcome, pow(0.5, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(created_at)) / 86400000000 / 30) AS w FROM fb WHERE outcome != 'pending'),
b AS (SELECT category, count(*) AS n, sum(CASE WHEN outcome != 'helpful' THEN w ELSE 0 END) / sum(w) AS rate FROM a GROUP BY 1)
SELECT category, n, floor(rate * 100 + 0.5) / 100 AS rate, CAST(CASE WHEN rate > 0.4 THEN least(floor(rate * 75 + 0.5), 75) ELSE 0 END AS INT) AS penalty, n >= 10 AS reliable FROM b""")
def attribution_decay(spark, d):
    return fb.attribution(v.feedback(spark, d), AS_OF)


@query(f"""WITH {v.FEEDBACK}, a AS (SELECT category, substr(lower(to_base(abs({H31.format("m")}), 36)), 1, 4) AS pattern, outcome FROM (SELECT *, category || ' ' || bucket AS m FROM fb WHERE outcome != 'pending')),
b AS (SELECT category, pattern, count(*) AS total, count_if(outcome != 'helpful') / count(*) AS x FROM a GROUP BY 1, 2)
SELECT category, pattern, total, floor(x * 1000000 + 0.5) / 1000000 AS dismissal FROM b WHERE total >= 3 AND x >= 0.6 ORDER BY x DESC, total DESC, category, pattern LIMIT 20""")
def negative_rules_topk(spark, d):
    return fb.negative_rules(v.feedback(spark, d), F.concat_ws(" ", "category", "bucket")).withColumn("dismissal", r6(F.col("dismissal")))


FATIGUE = """fa AS (SELECT category, count(*) AS total, count_if(outcome = 'helpful') AS helpful, count_if(outcome = 'unhelpful') AS unhelpful FROM fb GROUP BY 1),
fs AS (SELECT *, CASE WHEN helpful + unhelpful = 0 THEN 0.5 ELSE helpful / (helpful + unhelpful) END AS acc, floor(CASE WHEN helpful + unhelpful = 0 THEN 0 ELSE unhelpful / (helpful + unhelpful) END * log10(total + 1) * 100 + 0.5) / 10 AS fatigue FROM fa)"""


@query(f"WITH {v.FEEDBACK}, {FATIGUE} SELECT category, total, helpful, unhelpful, floor(acc * 1000000 + 0.5) / 1000000 AS acceptance, fatigue FROM fs")
def fatigue_scores(spark, d):
    return fb.fatigue(v.feedback(spark, d)).withColumn("acceptance", r6(F.col("acceptance")))


@query(f"WITH {v.FEEDBACK}, {FATIGUE} SELECT CAST(floor(sum(helpful) * 100 / sum(helpful + unhelpful) + 0.5) AS BIGINT) AS overall, CASE WHEN max(fatigue) > 5 THEN max_by(category, fatigue) END AS noisiest FROM fs")
def fatigue_overview(spark, d):
    return fb.fatigue_summary(fb.fatigue(v.feedback(spark, d)))


@query(f"""WITH {v.FEEDBACK}, r AS (SELECT category, pr % 10 AS g, (outcome = 'helpful')::INT AS ok, row_number() OVER (PARTITION BY category, pr % 10 ORDER BY created_at, id) AS i, count(*) OVER (PARTITION BY category, pr % 10) AS n FROM fb WHERE outcome != 'pending'),
a AS (SELECT category, g, max(n) AS n, avg(ok) FILTER (i > floor(n / 2)) - avg(ok) FILTER (i <= floor(n / 2)) AS x FROM r GROUP BY 1, 2)
SELECT category, g, n, CASE WHEN n < 6 THEN 'stable' WHEN x > 0.15 THEN 'improving' WHEN x < -0.15 THEN 'declining' ELSE 'stable' END AS trend FROM a""")
def trend_split_half(spark, d):
    return fb.trend(v.feedback(spark, d).withColumn("g", F.col("pr") % 10), ["category", "g"], ["created_at", "id"])


@query(f"""WITH {v.FEEDBACK}, w AS (SELECT *, year(created_at) || '-W' || lpad(CAST(CAST(ceil((epoch_us(created_at) - epoch_us(date_trunc('year', created_at)::TIMESTAMP)) / 86400000000 / 7 + (dayofweek(date_trunc('year', created_at)) + 1) / 7) AS INT) AS VARCHAR), 2, '0') AS week FROM fb),
c AS (SELECT week, category, count(*) AS n, count_if(outcome = 'helpful') AS helpful FROM w GROUP BY 1, 2)
SELECT * FROM c WHERE week IN (SELECT DISTINCT week FROM c ORDER BY week DESC LIMIT 4)""")
def weekly_volume_last4(spark, d):
    c = v.feedback(spark, d).groupBy(numbers.week_key(F.col("created_at")).alias("week"), "category").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("outcome") == "helpful").alias("helpful"))
    return frames.last_periods(c, "week", 4)


RULES = """ru AS (SELECT file, category, count(*) AS total, count_if(outcome = 'helpful') AS accepted, arg_max(severity, (created_at, id)) AS severity, max(created_at) AS last_matched_at, min(created_at) AS first_at FROM fb WHERE outcome != 'pending' GROUP BY 1, 2),
rules AS (SELECT 'discovered-' || regexp_replace(file, '[^A-Za-z0-9]', '-', 'g') || '-' || category AS id, file, category, severity, regexp_replace(file, '/[^/]*$', '') || '/**.ts' AS "glob", total, accepted, CAST(floor(60 + 25 * (accepted / total) + 0.5) AS INT) AS confidence, last_matched_at FROM ru WHERE total >= 3 AND accepted / total >= 0.4)"""


@query(f"WITH {v.FEEDBACK}, {RULES} SELECT id, file, category, severity, \"glob\", total, accepted, confidence FROM rules ORDER BY total DESC, file, category LIMIT 20")
def rule_mining(spark, d):
    return fb.mine_rules(v.feedback(spark, d)).drop("created_at", "last_matched_at")


@query(f"""WITH {v.FEEDBACK}, {RULES.replace(">= 0.4", ">= 0.1")}, st AS (SELECT category, count(*) AS t, count_if(outcome = 'helpful') / count(*) AS r FROM fb WHERE outcome != 'pending' GROUP BY 1),
x AS (SELECT rules.*, CASE WHEN t >= 20 AND r < 0.3 THEN CAST(least(floor((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(last_matched_at)) / 86400000000) * 5, 50) AS INT) ELSE 0 END AS decay FROM rules LEFT JOIN st USING (category))
SELECT id, category, decay, greatest(confidence - decay, 0) AS confidence, greatest(confidence - decay, 0) >= 30 AS enabled FROM x""")
def rule_decay(spark, d):
    f = v.feedback(spark, d)
    return fb.decay_rules(fb.mine_rules(f, at=0.1, top=None), fb.acceptance(f, ["category"]), AS_OF).select("id", "category", "decay", "confidence", "enabled")


# Spend and reports


@query(f"""WITH {v.SPEND} SELECT provider, model, grouping(provider) + grouping(model) AS depth, count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens, floor(sum(cached) * 10000 / nullif(sum(tokens), 0) + 0.5) / 100 AS cached_pct FROM sp GROUP BY ROLLUP (provider, model)""")
def spend_digest_rollup(spark, d):
    a = v.spend(spark, d).rollup("provider", "model").agg((F.grouping("provider").cast("bigint") + F.grouping("model")).alias("depth"), F.count(F.lit(1)).alias("calls"), F.sum("tokens").alias("tokens"), F.sum("cached").alias("c"))
    return a.select("provider", "model", "depth", "calls", "tokens", (F.floor(F.col("c") * 10000 / F.nullif(F.col("tokens"), F.lit(0)) + 0.5) / 100).alias("cached_pct"))


@query(f"""WITH {v.SPEND}, w AS (SELECT provider, strftime(paid, '%G-W%V') AS week, tokens, risk FROM sp), c AS (SELECT week, provider, count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens, floor(avg(risk) * 100 + 0.5) / 100 AS risk FROM w GROUP BY 1, 2)
SELECT * FROM c WHERE week IN (SELECT DISTINCT week FROM c ORDER BY week DESC LIMIT 8)""")
def spend_weekly(spark, d):
    s = v.spend(spark, d).groupBy(numbers.iso_week_key(F.col("at")).alias("week"), "provider").agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens").alias("tokens"), numbers.round_half_up(F.avg("risk"), 2).alias("risk"))
    return frames.last_periods(s, "week", 8)


@query(f"WITH {v.FINDINGS} SELECT dir, count(*) AS findings, count(DISTINCT file) AS files, {', '.join(f'''count_if(severity = '{s}') AS {s}''' for s in LEVELS)} FROM fi GROUP BY 1")
def severity_pivot_by_dir(spark, d):
    f = v.findings(spark, d)
    return f.groupBy("dir").agg(F.count(F.lit(1)).alias("findings"), F.count_distinct("file").alias("files"), *[F.count_if(F.col("severity") == s).alias(s) for s in LEVELS])


_W = "CASE severity WHEN 'critical' THEN 10.0 WHEN 'high' THEN 5.0 WHEN 'medium' THEN 2.0 WHEN 'low' THEN 1.0 WHEN 'nitpick' THEN 0.5 ELSE 1.0 END"
_G = "CASE WHEN {0} = 0 THEN 'A' WHEN {0} <= 1 THEN 'B' WHEN {0} <= 3 THEN 'C' WHEN {0} <= 7 THEN 'D' ELSE 'F' END"
_DIMS = {"security": "'security'", "reliability": "'bug', 'compliance'", "complexity": "'architecture'", "hygiene": "'style', 'performance'"}
_RISK = "max(CASE severity WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 ELSE 1 END)"


@query(f"""WITH {v.FINDINGS}, a AS (SELECT change_set, {', '.join(f"sum(CASE WHEN category IN ({c}) THEN {_W} ELSE 0 END) AS {n}" for n, c in _DIMS.items())}, CASE WHEN {_RISK} >= 4 THEN 3.0 WHEN {_RISK} >= 3 THEN 1.5 ELSE 0 END AS coverage FROM fi GROUP BY 1),
g AS (SELECT change_set, {', '.join(f"{_G.format(n)} AS {n}" for n in [*_DIMS, 'coverage'])} FROM a),
m AS (SELECT *, ({' + '.join(f"CASE {n} WHEN 'A' THEN 5 WHEN 'B' THEN 4 WHEN 'C' THEN 3 WHEN 'D' THEN 2 ELSE 1 END" for n in [*_DIMS, 'coverage'])}) / 5 AS x FROM g)
SELECT change_set, security, reliability, complexity, hygiene, coverage, CASE WHEN x >= 4.5 THEN 'A' WHEN x >= 3.5 THEN 'B' WHEN x >= 2.5 THEN 'C' WHEN x >= 1.5 THEN 'D' ELSE 'F' END AS overall FROM m""")
def report_card(spark, d):
    return scoring.report_card(v.findings(spark, d), F.max(ordinal(F.col("severity")) + 1))


_PRI = """CAST(least(greatest(floor(CASE severity WHEN 'critical' THEN 10 WHEN 'high' THEN 8 WHEN 'medium' THEN 5 WHEN 'low' THEN 2 WHEN 'nitpick' THEN 1 ELSE 3 END * (confidence / 100)
 * CAST(CASE category WHEN 'security' THEN 1.5 WHEN 'bug' THEN 1.3 WHEN 'compliance' THEN 1.2 WHEN 'performance' THEN 1.1 WHEN 'architecture' THEN 1.0 WHEN 'style' THEN 0.8 ELSE 1.0 END AS DOUBLE) * 7 / 15 + least(size % 4, 3) + 0.5), 1), 10) AS INT)"""


@query(f"""WITH {v.FINDINGS}, p AS (SELECT *, {_PRI} AS priority FROM fi)
SELECT category, severity, CASE WHEN priority >= 8 THEN 'critical' WHEN priority >= 6 THEN 'high' WHEN priority >= 3 THEN 'medium' ELSE 'low' END AS level, count(*) AS n, CAST(sum(priority) AS BIGINT) AS points FROM p GROUP BY 1, 2, 3""")
def priority_score(spark, d):
    p = scoring.priority(v.findings(spark, d).withColumn("recurrence", F.col("size") % 4))
    return p.groupBy("category", "severity", "level").agg(F.count(F.lit(1)).alias("n"), F.sum("priority").alias("points"))


_S = "CASE severity WHEN 'critical' THEN 25 WHEN 'high' THEN 10 WHEN 'medium' THEN 5 WHEN 'low' THEN 2 ELSE 1 END"


@query(f"WITH {v.FINDINGS} SELECT change_set, CAST(least(greatest(100 - sum({_S}) - CASE WHEN count(DISTINCT file) > 10 THEN 10 WHEN count(DISTINCT file) > 5 THEN 5 ELSE 0 END - CASE WHEN {_RISK} >= 4 THEN 10 WHEN {_RISK} >= 3 THEN 5 ELSE 0 END, 0), 100) AS INT) AS safety FROM fi GROUP BY 1")
def safety_score(spark, d):
    return scoring.safety(v.findings(spark, d), F.count_distinct("file"), F.max(ordinal(F.col("severity")) + 1))


@query(f"""WITH {v.FINDINGS}, a AS (SELECT change_set, CAST(sum(size) AS BIGINT) AS l, count(DISTINCT file) AS f, count_if(category = 'bug') AS e, count_if(category = 'architecture') AS c, count(DISTINCT dir) AS p, count_if(category = 'security') AS t FROM fi GROUP BY 1),
s AS (SELECT *, least(greatest(floor((least(l / 100, 3.0) + least(f / 10, 2.0) + least(e / 3, 2.0) + least(CAST(c AS DOUBLE) * 0.5::DOUBLE, 1.5) + least(p / 5, 1.5) + least(t / 3, 1.5)) * 10 + 0.5) / 10, 1.0), 10.0) AS score,
 CAST(greatest(2, floor((2 + l * 0.15::DOUBLE + f * 1.5::DOUBLE) * CASE WHEN c > 0 THEN 1.8::DOUBLE ELSE 1.0 END * CASE WHEN t > 0 THEN 1.5::DOUBLE ELSE 1.0 END + 0.5)) AS INT) AS minutes FROM a)
SELECT change_set, score, minutes, CASE WHEN score <= 2 THEN 'trivial' WHEN score <= 4 THEN 'simple' WHEN score <= 6 THEN 'moderate' WHEN score <= 8 THEN 'complex' ELSE 'critical' END AS kind FROM s""")
def complexity_score(spark, d):
    has = lambda c: F.count_if(F.col("category") == c)
    a = v.findings(spark, d).groupBy("change_set").agg(F.sum("size").alias("l"), F.count_distinct("file").alias("f"), has("bug").alias("e"), has("architecture").alias("c"), F.count_distinct("dir").alias("p"), has("security").alias("t"))
    score, minutes, kind = scoring.complexity(*(F.col(x) for x in "lfecpt"))
    return a.select("change_set", score.alias("score"), minutes.alias("minutes"), kind.alias("kind"))


@query(f"""WITH {v.FINDINGS} SELECT change_set, bool_or(severity IN ('critical', 'high')) AS blocked, count_if(severity IN ('critical', 'high')) AS hits,
 array_to_string(list_sort(list_filter([CASE WHEN bool_or(category = 'security') THEN 'needs-security-review' END, CASE WHEN bool_or(category = 'bug') THEN 'has-bugs' END, CASE WHEN bool_or(category = 'performance') THEN 'performance' END, CASE WHEN bool_or(severity = 'critical') THEN 'critical-findings' END], lambda x: x IS NOT NULL)), ',') AS labels
FROM fi GROUP BY 1""")
def gate_and_labels(spark, d):
    f = v.findings(spark, d)
    return scoring.gate(f).join(scoring.labels(f), "change_set")


@query(f"WITH {v.FINDINGS} SELECT change_set, CASE WHEN bool_or(confidence >= 60 AND severity IN ('critical', 'high')) THEN 'request_changes' WHEN bool_or(confidence >= 60) THEN 'comment' ELSE 'approve' END AS decision, count_if(confidence >= 60) AS kept FROM fi GROUP BY 1")
def confidence_decisions(spark, d):
    return scoring.decisions(v.findings(spark, d), 60)


@query(f"""WITH {v.FINDINGS}, c AS (SELECT CASE WHEN confidence BETWEEN 60 AND 80 AND size % 2 = 0 THEN 'high' WHEN confidence BETWEEN 60 AND 80 THEN 'low' WHEN confidence > 80 THEN 'high' WHEN confidence > 50 THEN 'medium' ELSE 'low' END AS level,
 CASE WHEN confidence BETWEEN 60 AND 80 AND size % 2 = 0 THEN least(confidence + 15, 100) WHEN confidence BETWEEN 60 AND 80 THEN greatest(confidence - 20, 0) ELSE confidence END AS confidence FROM fi)
SELECT level, count(*) AS n, CAST(sum(confidence) AS BIGINT) AS points FROM c GROUP BY 1""")
def borderline_calibration(spark, d):
    return scoring.calibrate(v.findings(spark, d), F.col("size") % 2 == 0).groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.sum("confidence").alias("points"))


@query(f"""WITH {v.FINDINGS}, c AS (SELECT unnest(['low confidence critical', 'certain nitpick', 'line below 1', 'empty message', 'confidence out of range']) AS "check", unnest([count_if(severity = 'critical' AND confidence < 30), count_if(severity = 'nitpick' AND confidence >= 95), count_if(line < 1), count_if(length(trim(message)) = 0), count_if(confidence NOT BETWEEN 0 AND 100)]) AS n FROM fi) SELECT * FROM c WHERE n > 0""")
def anomaly_checks(spark, d):
    return scoring.anomalies(v.findings(spark, d))


# Deduplication and similarity


@query(f"""WITH {v.FINDINGS} SELECT file, line, category, {FNV.format("message")} AS message_hash, arg_max(severity, list_position(['nitpick','low','medium','high','critical'], severity)) AS severity, max(confidence) AS confidence, message, count(*) AS merged FROM fi GROUP BY file, line, category, message""")
def dedup_exact_merge(spark, d):
    return relate.merge_duplicates(v.findings(spark, d))


@query(f"""WITH {v.FINDINGS}, r AS (SELECT change_set, file, line, category, severity, confidence, row_number() OVER (PARTITION BY file, line, category ORDER BY confidence DESC, change_set, severity) AS n FROM (SELECT file, line, category, confidence, change_set, min(severity) AS severity FROM fi GROUP BY ALL)) SELECT file, line, category, confidence, change_set, severity FROM r WHERE n = 1""")
def dedup_best_confidence(spark, d):
    f = v.findings(spark, d).groupBy("file", "line", "category", "confidence", "change_set").agg(F.min("severity").alias("severity"))
    return relate.best_confidence(f, ["file", "line", "category"], ["change_set"])


@query(f"""WITH RECURSIVE {v.FINDINGS}, s AS (SELECT *, row_number() OVER (PARTITION BY file, category ORDER BY line, message, sev, confidence) AS n FROM (SELECT DISTINCT file, line, category, CAST(5 - list_position({v.LEVELS}, severity) AS INT) AS sev, confidence, message FROM fi)),
f AS (SELECT file, category, n, line, message, sev, confidence, 1 AS merged, 1 AS k FROM s WHERE n = 1 UNION ALL
  SELECT file, category, n, CASE WHEN j THEN l ELSE line END, CASE WHEN j AND length(m) >= length(message) THEN m ELSE message END, CASE WHEN j THEN greatest(sev, v) ELSE sev END, CASE WHEN j THEN greatest(confidence, c) ELSE confidence END, CASE WHEN j THEN merged + 1 ELSE 1 END, CASE WHEN j THEN k ELSE k + 1 END
  FROM (SELECT s.file, s.category, s.n, s.line, s.message, s.sev, s.confidence, f.line AS l, f.message AS m, f.sev AS v, f.confidence AS c, f.merged, f.k, abs(s.line - f.line) <= 5 AND (s.message = f.message OR 1 - levenshtein(s.message, f.message) / greatest(length(s.message), length(f.message)) >= 0.56) AS j FROM f JOIN s ON s.file = f.file AND s.category = f.category AND s.n = f.n + 1))
SELECT file, category, line, message, sev, confidence, merged FROM (SELECT *, row_number() OVER (PARTITION BY file, category, k ORDER BY n DESC) AS z FROM f) WHERE z = 1""")
def dedup_proximity_fold(spark, d):
    return relate.fold_nearby(v.findings(spark, d).select("file", "line", "category", "severity", "confidence", "message").distinct())


@query("""WITH n AS (SELECT DISTINCT p_name AS name, split_part(p_name, ' ', 2) AS k FROM part)
SELECT a.name AS a, b.name AS b FROM n a JOIN n b ON a.k = b.k AND a.name < b.name WHERE 1 - levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name)) >= 0.7""")
def fuzzy_pairs_blocked(spark, d):
    return relate.fuzzy_pairs(v.table(spark, d, "part").select(F.col("p_name").alias("name")), F.split_part("name", F.lit(" "), F.lit(2)))


@query("""WITH n AS (SELECT DISTINCT p_name AS a FROM part) SELECT x.a, y.a AS b FROM n x JOIN n y ON x.a != y.a AND abs(length(x.a) - length(y.a)) <= 2 WHERE levenshtein(x.a, y.a) <= 2""")
def typosquat_names(spark, d):
    n = v.table(spark, d, "part").select(F.col("p_name").alias("name"))
    return relate.within_edits(n, n)


_SETS = "cs AS (SELECT DISTINCT l_orderkey AS change_set, p_brand || '/' || l_partkey AS file FROM lineitem JOIN part ON l_partkey = p_partkey)"


@query(f"""WITH {_SETS}, cur AS (SELECT change_set AS current, file FROM cs WHERE change_set % 100 = 0), hn AS (SELECT change_set, count(*) AS hn FROM cs GROUP BY 1), cn AS (SELECT current, count(*) AS cn FROM cur GROUP BY 1),
e AS (SELECT current, change_set, cs.file, true AS exact FROM cs JOIN cur ON cs.file = cur.file WHERE change_set != current),
n AS (SELECT current, change_set, cs.file, false AS exact FROM cs JOIN (SELECT DISTINCT current, split_part(file, '/', 1) AS dd FROM cur) c ON split_part(cs.file, '/', 1) = c.dd WHERE change_set != current),
p AS (SELECT current, change_set, file, bool_or(exact) AS exact FROM (SELECT * FROM e UNION ALL SELECT * FROM n) GROUP BY 1, 2, 3),
a AS (SELECT current, change_set, count_if(exact) AS shared, count_if(NOT exact) AS near FROM p GROUP BY 1, 2),
s AS (SELECT current, change_set, shared, near, (shared + 0.3::DOUBLE * near) / (hn + cn - shared) AS x FROM a JOIN hn USING (change_set) JOIN cn USING (current)),
r AS (SELECT current, change_set, shared, near, floor(x * 100 + 0.5) / 100 AS similarity FROM s WHERE x >= 0.1),
t AS (SELECT *, row_number() OVER (PARTITION BY current ORDER BY similarity DESC, shared DESC, change_set) AS rank FROM r)
SELECT current, change_set, shared, near, similarity, rank FROM t WHERE rank <= 5""")
def similar_change_sets(spark, d):
    p = v.table(spark, d, "part").select("p_partkey", "p_brand")
    li = v.table(spark, d, "lineitem")
    h = li.join(p, li["l_partkey"] == p["p_partkey"]).select(F.col("l_orderkey").alias("change_set"), F.concat_ws("/", "p_brand", "l_partkey").alias("file")).distinct()
    return relate.similar_change_sets(h, h.where("change_set % 100 = 0")).withColumn("rank", F.col("rank").cast("bigint"))


# Snapshots and differences

_WEEK = "CASE WHEN ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15' THEN 1 WHEN ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-22' THEN 2 END"


def _weeks(spark, d):
    e = v.table(spark, d, "events").withColumn("week", F.expr(_WEEK))
    return e.where("week = 1"), e.where("week = 2")


@query(f"""WITH e AS (SELECT *, {_WEEK} AS week FROM events) SELECT user_id, event_type, CASE WHEN bool_or(week = 1) AND bool_or(week = 2) THEN 'persisted' WHEN bool_or(week = 1) THEN 'resolved' ELSE 'new' END AS status FROM e WHERE week IS NOT NULL GROUP BY 1, 2""")
def lifecycle_diff(spark, d):
    return relate.lifecycle(*_weeks(spark, d), ["user_id", "event_type"])


@query(f"""WITH e AS (SELECT *, {_WEEK} AS week, CAST(json_extract_string(props, '$.k') AS INT) % 3 AS k FROM events), a AS (SELECT user_id, event_type, arg_max(k, (ts, event_id)) FILTER (week = 1) AS x, arg_max(k, (ts, event_id)) FILTER (week = 2) AS y FROM e WHERE week IS NOT NULL GROUP BY 1, 2)
SELECT user_id, event_type, CASE WHEN x IS NULL THEN 'added' WHEN y IS NULL THEN 'removed' WHEN x != y THEN 'changed' ELSE 'same' END AS status FROM a""")
def run_compare(spark, d):
    a, b = (x.withColumn("k", F.get_json_object("props", "$.k").cast("int") % 3) for x in _weeks(spark, d))
    return relate.compare_runs(a, b, ["user_id", "event_type"], ["ts", "event_id"], ["k"])


@query(f"""WITH {v.VERSIONS} SELECT name, old.version AS old_version, new.version AS new_version,
 CASE WHEN old.q IS NULL THEN 'added' WHEN new.q IS NULL THEN 'removed' WHEN new.q < old.q THEN 'downgraded' WHEN new.q // 10 > old.q // 10 THEN 'bumped-major' ELSE 'bumped-minor' END AS kind
FROM old FULL JOIN new USING (name) WHERE old.q IS DISTINCT FROM new.q""")
def dependency_diff(spark, d):
    return relate.dependency_diff(*v.versions(spark, d))


@query(f"""WITH {v.VERSIONS}, k AS (SELECT name % 50 AS grp, CASE WHEN old.q IS NULL THEN 'added' WHEN new.q IS NULL THEN 'removed' WHEN new.q < old.q THEN 'downgraded' WHEN new.q // 10 > old.q // 10 THEN 'bumped-major' ELSE 'bumped-minor' END AS kind FROM old FULL JOIN new USING (name) WHERE old.q IS DISTINCT FROM new.q)
SELECT grp, CASE WHEN count_if(kind = 'bumped-major') > 0 OR count_if(kind = 'downgraded') > 0 OR count_if(kind = 'added') >= 3 THEN 'high' WHEN count_if(kind IN ('added', 'removed')) > 0 THEN 'medium' ELSE 'low' END AS risk FROM k GROUP BY 1""")
def dependency_risk(spark, d):
    return relate.dependency_risk(relate.dependency_diff(*v.versions(spark, d)).withColumn("grp", F.col("name") % 50), ["grp"])


@query(f"""WITH {v.FEEDBACK}, p AS (SELECT category || ':' || regexp_extract(file, '^[^/]*/[^/]*') || ':' || bucket AS key, pr AS change_set, created_at AS seen FROM fb WHERE created_at > TIMESTAMP '{AS_OF}' - INTERVAL 30 DAYS),
g AS (SELECT key, change_set, max(seen) AS seen FROM p GROUP BY 1, 2)
SELECT key, count(*) AS sets, array_to_string(list_slice(list(CAST(change_set AS VARCHAR) ORDER BY seen DESC, change_set DESC), 1, 5), ',') AS latest FROM g GROUP BY 1 HAVING count(*) >= 3""")
def cross_pattern_recurrence(spark, d):
    f = v.feedback(spark, d)
    return relate.recurrence(f.select(F.concat_ws(":", "category", text.first_segments(F.col("file"), 2), "bucket").alias("key"), F.col("pr").alias("change_set"), F.col("created_at").alias("at")), AS_OF)


# Paths and lines

OWNERS = [("*.example.com", ["@web"]), ("/*.example.net/en/", ["@net-en"]), ("**/es/*", ["@es", "@net"]), ("*.html", ["@legacy"]), ("/m.*/fr/*", [])]
_OWN = [r"^(.*/)?[^/]*\.example\.com(/.*)?$", r"^[^/]*\.example\.net/en/.*$", r"^(.*/)?es/[^/]*(/.*)?$", r"^(.*/)?[^/]*\.html(/.*)?$", r"^m\.[^/]*/fr/[^/]*(/.*)?$"]


@query(f"""WITH {v.PATHS} SELECT id, path, CASE WHEN regexp_matches(path, '{_OWN[4]}') THEN '' WHEN regexp_matches(path, '{_OWN[3]}') THEN '@legacy' WHEN regexp_matches(path, '{_OWN[2]}') THEN '@es,@net' WHEN regexp_matches(path, '{_OWN[1]}') THEN '@net-en' WHEN regexp_matches(path, '{_OWN[0]}') THEN '@web' END AS owners FROM pa""")
def owner_last_match(spark, d):
    return v.paths(spark, d).withColumn("owners", F.array_join(relate.last_match(F.col("path"), OWNERS), ","))


LAYERS = [("edge", ["m.*/**", "blog.*/**"]), ("web", ["www.*/**"]), ("core", ["*.example.com/**"])]


@query(f"""WITH {v.PATHS} SELECT CASE WHEN regexp_matches(path, '^(m|blog)\\.[^/]*/.*$') THEN 'edge' WHEN regexp_matches(path, '^www\\.[^/]*/.*$') THEN 'web' WHEN regexp_matches(path, '^[^/]*\\.example\\.com/.*$') THEN 'core' ELSE 'none' END AS layer, count(*) AS files FROM pa GROUP BY 1""")
def layer_first_match(spark, d):
    p = v.paths(spark, d)
    return p.groupBy(F.coalesce(relate.first_match(F.col("path"), LAYERS), F.lit("none")).alias("layer")).agg(F.count(F.lit(1)).alias("files"))


@query(f"""WITH {v.PATHS}, o AS (SELECT unnest(CASE WHEN regexp_matches(path, '{_OWN[4]}') THEN ['unowned'] WHEN regexp_matches(path, '{_OWN[3]}') THEN ['@legacy'] WHEN regexp_matches(path, '{_OWN[2]}') THEN ['@es', '@net'] WHEN regexp_matches(path, '{_OWN[1]}') THEN ['@net-en'] WHEN regexp_matches(path, '{_OWN[0]}') THEN ['@web'] ELSE ['unowned'] END) AS owner FROM pa) SELECT owner, count(*) AS files FROM o GROUP BY 1""")
def owner_coverage(spark, d):
    return relate.owner_coverage(v.paths(spark, d), OWNERS)


PATTERNS = [
    {"name": "license", "pattern": r"licen[sc]ed? under", "severity": "low", "category": "compliance"},
    {"name": "url", "pattern": r"https?://[a-z]", "severity": "nitpick", "category": "style"},
    {"name": "address", "pattern": r"[a-z0-9.]+@[a-z0-9]+\.[a-z]+", "severity": "high", "category": "security"},
    {"name": "disabled", "pattern": r"the", "severity": "low", "category": "style", "enabled": False},
    {"name": "unsure", "pattern": r"the", "severity": "low", "category": "style", "confidence": 20},
]


@query(f"""WITH {v.LINES}, r AS (SELECT unnest(['license', 'url', 'address']) AS rule, unnest(['licen[sc]ed? under', 'https?://[a-z]', '[a-z0-9.]+@[a-z0-9]+\\.[a-z]+']) AS p, unnest(['low', 'nitpick', 'high']) AS severity, unnest(['compliance', 'style', 'security']) AS category)
SELECT file, pos, rule, severity, category FROM ln JOIN r ON regexp_matches(content, p, 'i')""")
def glob_rule_hits(spark, d):
    return relate.regex_rule_hits(v.lines(spark, d), PATTERNS)


_SECRET = r"(password|passwd|secret|api[_-]?key|token)[ ]*[:=][ ]*[^ ]{6,}"


@query(f"""WITH {v.LINES} SELECT file, pos, CAST(length(content) AS INT) AS n FROM ln WHERE regexp_matches(content, '{_SECRET}', 'i') AND NOT regexp_matches(content, 'env', 'i')""")
def secret_line_scan(spark, d):
    c = F.col("content")
    return v.lines(spark, d).where(c.rlike("(?i)" + _SECRET) & ~c.rlike("(?i)env")).select("file", "pos", F.length("content").alias("n"))


def _redact_sql(c: str) -> str:
    for pattern, by in text.REDACTIONS:
        if pattern == text.OUTSIDE:  # no look-ahead here: allowed hosts are hidden from the pattern and shown again
            c = f"regexp_replace({c}, 'http(s?)://(github\\.com|docs\\.github\\.com)', 'http\\1' || chr(1) || '\\2', 'g')"
            c = f"replace(regexp_replace({c}, 'https?://[^ \\t\\n\\x0b\\f\\r)\\]]+', '{by}', 'g'), chr(1), '://')"
        else:
            c = f"regexp_replace({c}, '{pattern}', '{by}', 'g')"
    return c


_PLANTED = "'<img src=x> key AKIA' || lpad(CAST(doc_id AS VARCHAR), 16, '0') || ' at https://github.com/a and https://x.example/' || doc_id || chr(10) || 'curl -d @' || doc_id || chr(10) || text"


@query(f"SELECT doc_id, sha256({_redact_sql('t')}) AS redacted FROM (SELECT doc_id, {_PLANTED} AS t FROM documents)")
def redact_text(spark, d):
    t = F.concat(
        F.lit("<img src=x> key AKIA"), F.lpad(F.col("doc_id").cast("string"), 16, "0"), F.lit(" at https://github.com/a and https://x.example/"), "doc_id", F.lit("\ncurl -d @"), "doc_id", F.lit("\n"), "text"
    )
    return v.table(spark, d, "documents").select("doc_id", F.sha2(text.redact(t), 256).alias("redacted"))


@query("""WITH RECURSIVE t AS (SELECT doc_id, '<!-- a' || repeat('<!-- b -->', CAST(doc_id % 4 AS INT)) || ' --> <!' || '<!-- x -->-- gone -->' || coalesce(split_part(text, chr(10), 1), '') || '<!-- open' AS c FROM documents),
w AS (SELECT doc_id, c, 0 AS n FROM t UNION ALL SELECT doc_id, regexp_replace(c, '(?s)<!--.*?-->', '', 'g'), n + 1 FROM w WHERE regexp_matches(c, '(?s)<!--.*?-->'))
SELECT doc_id, arg_max(c, n) AS clean FROM w GROUP BY 1""")
def comments_stripped(spark, d):
    first = F.split_part(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(1))
    t = F.concat(F.lit("<!-- a"), F.repeat(F.lit("<!-- b -->"), (F.col("doc_id") % 4).cast("int")), F.lit(" --> <!<!-- x -->-- gone -->"), first, F.lit("<!-- open"))
    return v.table(spark, d, "documents").select("doc_id", text.strip_html_comments(t).alias("clean"))


_HEADERS = "'commit ' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 40) || chr(10) || 'Author: A <a@b.c>' || chr(10) || 'Date: now' || chr(10) || 'index 12ab..34cd 100644' || chr(10) || ' From: kept' || chr(10) || coalesce(split_part(text, chr(10), 1), '')"


@query(rf"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '(?m)^index [0-9a-f]+\.\.[0-9a-f]+.*$', 'index [REDACTED]', 'g'), '(?m)^(From|Author|Date): .*$\n?', '', 'g'), '(?m)^commit [0-9a-f]{{7,40}}$', 'commit [REDACTED]', 'g') AS patch
FROM (SELECT doc_id, {_HEADERS} AS t FROM documents)""")
def patch_without_people(spark, d):
    first = F.split_part(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(1))
    t = F.concat(F.lit("commit "), F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 40), F.lit("\nAuthor: A <a@b.c>\nDate: now\nindex 12ab..34cd 100644\n From: kept\n"), first)
    return v.table(spark, d, "documents").select("doc_id", text.strip_people(t).alias("patch"))


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\*\*\[\w+\]\s*\w+\*\*:\s*', '', 'g'), '(?s)```suggestion.*?```', '', 'g'), '\[Open in VS Code\].*', '', 'g'), '<[^>]*>', '', 'g')) AS body
FROM (SELECT doc_id, ' <!-- mark --> **[' || source || '] high**: ' || 'see <b>' || doc_id || '</b> ```suggestion' || chr(10) || 'x```' || '[Open in VS Code](u) ' AS t FROM documents WHERE regexp_full_match(source, '\w+'))""")
def comment_bodies(spark, d):
    t = F.concat(F.lit(" <!-- mark --> **["), "source", F.lit("] high**: see <b>"), "doc_id", F.lit("</b> ```suggestion\nx```[Open in VS Code](u) "))
    return v.table(spark, d, "documents").where(F.col("source").rlike(r"\A\w+\z")).select("doc_id", text.strip_markers(t).alias("body"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN 'not read' ELSE role END AS summary, CASE WHEN turn % 3 = 2 THEN 3 ELSE CAST(turn AS INT) END AS risk, CASE WHEN turn % 3 = 2 THEN 0 ELSE 1 END AS comments FROM conversations""")
def fenced_answers(spark, d):
    body = F.to_json(F.struct(F.col("role").alias("summary"), F.col("turn").cast("int").alias("riskScore"), F.array(F.struct(F.col("role").alias("message"))).alias("comments")))
    n = F.col("turn") % 3
    t = F.when(n == 0, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```\nDone."))).when(n == 1, F.concat(F.lit("  "), body)).otherwise(F.concat(F.lit("```\n{broken "), "role", F.lit("\n```")))
    got = text.fenced_json(t, "summary string, riskScore int, comments array<struct<message:string>>")
    return v.table(spark, d, "conversations").select(
        "conv_id", "turn", F.coalesce(got["summary"], F.lit("not read")).alias("summary"), F.coalesce(got["riskScore"], F.lit(3)).alias("risk"), F.coalesce(F.size(got["comments"]), F.lit(0)).alias("comments")
    )


@query(f"""WITH {v.LINES}, c AS (SELECT file, content, count(*) AS n FROM ln GROUP BY 1, 2) SELECT file, CAST(sum(n) AS BIGINT) AS lines, CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS repeated, floor(sum(CASE WHEN n > 1 THEN n ELSE 0 END) / sum(n) * 1000000 + 0.5) / 1000000 AS ratio FROM c GROUP BY 1""")
def duplicate_line_ratio(spark, d):
    c = v.lines(spark, d).groupBy("file", "content").agg(F.count(F.lit(1)).alias("n"))
    again = F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0))
    return c.groupBy("file").agg(F.sum("n").alias("lines"), again.alias("repeated"), r6(again / F.sum("n")).alias("ratio"))


@query(f"""WITH {v.LINES}, k AS (SELECT content AS key, file, min(pos) AS pos FROM ln WHERE length(content) > 20 GROUP BY 1, 2), m AS (SELECT key, count(*) AS files, min((file, pos)) AS x FROM k GROUP BY 1 HAVING count(*) >= 3) SELECT key, files, x[1] AS first_file, x[2] AS first_pos FROM m""")
def repeated_lines(spark, d):
    return frames.repeated_across(v.lines(spark, d), F.when(F.length("content") > 20, F.col("content")))


@query(f"""WITH {v.LINES}, w AS (SELECT file, pos, list_filter(regexp_split_to_array(content, '[ \t]+'), lambda x: x != '') AS w FROM ln), s AS (SELECT file, pos, unnest(range(1, len(w) - 2)) AS i, w FROM w WHERE len(w) >= 4), k AS (SELECT array_to_string(list_slice(w, i, i + 3), ' ') AS key, file, min(pos) AS pos FROM s GROUP BY 1, 2), m AS (SELECT key, count(*) AS files, min((file, pos)) AS x FROM k GROUP BY 1 HAVING count(*) >= 3)
SELECT key, files, x[1] AS first_file, x[2] AS first_pos FROM m""")
def shingle_copy_paste(spark, d):
    s = v.lines(spark, d).select("file", "pos", F.explode(text.word_grams(F.filter(F.split("content", "[ \t]+"), lambda x: x != ""), 4)).alias("gram"))
    return frames.repeated_across(s, F.col("gram"))


@query("SELECT doc_id, floor(e * 1000000 + 0.5) / 1000000 AS entropy FROM (SELECT doc_id, -sum(p * log2(p)) AS e FROM (SELECT doc_id, n / sum(n) OVER (PARTITION BY doc_id) AS p FROM (SELECT doc_id, c, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents) GROUP BY 1, 2)) GROUP BY 1)")
def text_entropy(spark, d):
    c = v.table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "")).alias("c")).where("c != ''").groupBy("doc_id", "c").agg(F.count(F.lit(1)).alias("n"))
    # -sum(p log p) = log N - sum(n log n) / N, so counts need no second pass.
    a = c.groupBy("doc_id").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    return a.select("doc_id", r6(F.log2("t") - F.col("s") / F.col("t")).alias("entropy"))


# Frames


@query(f"""WITH {v.USER_EVENTS} SELECT a.event_id FROM ue a WHERE a.kind = 'click' AND EXISTS (SELECT 1 FROM ue b WHERE b.file = a.file AND b.pos BETWEEN a.pos + 1 AND a.pos + 5 AND b.kind = 'error' AND NOT EXISTS (SELECT 1 FROM ue c WHERE c.file = a.file AND c.pos > a.pos AND c.pos < b.pos AND c.kind = 'purchase'))""")
def lookahead_pair(spark, d):
    k = F.col("kind")
    return frames.lookahead(v.user_events(spark, d), k == "click", k == "error", 5, k == "purchase").select("event_id")


@query(f"""WITH {v.USER_EVENTS}, g AS (SELECT *, max((kind = 'view')::INT) OVER (PARTITION BY file ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS x FROM ue) SELECT event_id FROM g WHERE kind = 'purchase' AND coalesce(x, 0) = 0""")
def lookbehind_guard(spark, d):
    return frames.lookbehind_absent(v.user_events(spark, d), F.col("kind") == "purchase", F.col("kind") == "view", 5).select("event_id")


@query(f"""WITH {v.USER_EVENTS}, g AS (SELECT *, lead(kind) OVER (PARTITION BY file ORDER BY pos) AS x FROM ue) SELECT event_id FROM g WHERE kind = 'signup' AND x = 'error'""")
def adjacent_pair(spark, d):
    return frames.adjacent(v.user_events(spark, d), F.col("kind") == "signup", F.col("kind") == "error").select("event_id")


@query("""WITH k AS (SELECT DISTINCT o_orderkey AS k, o_orderstatus AS s FROM orders), g AS (SELECT s, k, k - row_number() OVER (PARTITION BY s ORDER BY k) AS x FROM k) SELECT s AS status, min(k) AS first, max(k) AS last, count(*) AS length FROM g GROUP BY s, x""")
def islands_ranges(spark, d):
    return frames.islands(v.table(spark, d, "orders").select(F.col("o_orderstatus").alias("status"), "o_orderkey"), "o_orderkey", ["status"])


@query("""SELECT event_id, n AS guards FROM (SELECT event_id, event_type, CAST(sum((event_type = 'view')::INT) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN 500 PRECEDING AND 500 FOLLOWING) AS BIGINT) AS n FROM events) WHERE event_type = 'error'""")
def range_window_near(spark, d):
    e = v.table(spark, d, "events").select(F.col("user_id").alias("file"), "event_id", "event_type")
    return frames.near_by_value(e, "event_id", 500, F.col("event_type") == "error", F.col("event_type") == "view").select("event_id", "guards")


@query("""WITH p AS (SELECT DISTINCT user_id AS file, event_id AS line FROM events WHERE event_type = 'error'), x AS (SELECT DISTINCT user_id AS file, event_id AS v FROM events WHERE event_type = 'view')
SELECT file, line, coalesce((SELECT arg_min(v, abs(v - p.line) * 1000000000 + v) FROM x WHERE x.file = p.file AND abs(v - p.line) <= 40), -1) AS placed FROM p""")
def nearest_line(spark, d):
    e = v.table(spark, d, "events").select(F.col("user_id").alias("file"), F.col("event_id").alias("line"), "event_type")
    return relate.nearest(e.where("event_type = 'error'"), e.where("event_type = 'view'"), 40).fillna(-1, ["placed"])


@query("SELECT user_id, event_type, epoch_us(max(ts)) AS us, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2")
def latest_per_key(spark, d):
    e = v.table(spark, d, "events").select("user_id", "event_type", "ts", "event_id")
    return frames.latest(e, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", numbers.micros(F.col("ts")).alias("us"), "event_id")


@query("""WITH u AS (SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type FROM events) SELECT user_id, day, count_if(event_type = 'signup') AS acquired FROM u GROUP BY 1, 2 HAVING count_if(event_type = 'signup') > 0 AND NOT bool_or(event_type = 'purchase')""")
def acquire_without_release(spark, d):
    e = v.table(spark, d, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type")
    return frames.without_release(e, F.col("event_type") == "signup", F.col("event_type") == "purchase", ["user_id", "day"])


_KIND = "CASE" + "".join(f" WHEN regexp_matches(last, '{p.replace(chr(39), chr(39) * 2)}', 'i') THEN '{k}'" for k, p in relate.DISMISSALS) + " END"
_LAST = "[" + ", ".join(f"'{x}'" for x in ("By design.", "tracked in 12", "This is unnecessary", "a known issue", "n/a", "lateral thinking", "thanks")) + "]"


@query(f"""WITH c AS (SELECT conv_id AS thread, role AS author, turn, {_LAST}[1 + (conv_id + turn) % 7] || ' ' || coalesce(text, '') AS text FROM conversations), r AS (SELECT thread, author FROM c WHERE turn = 0),
l AS (SELECT thread, author, count(*) AS replies, arg_max(text, turn) AS last FROM c WHERE turn > 0 GROUP BY 1, 2)
SELECT r.thread, r.author, coalesce(replies, 0) AS replies, {_KIND} AS kind FROM r LEFT JOIN l ON r.thread = l.thread AND r.author = l.author""")
def thread_replies(spark, d):
    words = F.array(*map(F.lit, ("By design.", "tracked in 12", "This is unnecessary", "a known issue", "n/a", "lateral thinking", "thanks")))
    said = F.concat(F.get(words, ((F.col("conv_id") + F.col("turn")) % 7).cast("int")), F.lit(" "), F.coalesce("text", F.lit("")))
    c = v.table(spark, d, "conversations").select(F.col("conv_id").alias("thread"), F.col("turn").alias("pos"), F.col("role").alias("author"), said.alias("text"))
    return relate.replies(c)


# Graph


@query(f"""WITH RECURSIVE {v.EDGES}, rev AS (SELECT DISTINCT target AS at, source AS node FROM ed WHERE source > 2), walk AS (SELECT s AS seed, s AS node, 0 AS depth FROM (SELECT unnest([0, 1, 2]) AS s) UNION SELECT walk.seed, rev.node, walk.depth + 1 FROM walk JOIN rev ON rev.at = walk.node WHERE walk.depth < 5)
SELECT CAST(seed AS BIGINT) AS seed, CAST(node AS BIGINT) AS node, min(depth) AS depth FROM walk WHERE node > 2 GROUP BY 1, 2""")
def blast_radius(spark, d):
    seeds = spark.range(3).select(F.col("id").alias("node"))
    return graph.blast_radius(v.edges(spark, d), seeds, keep=durable)


@query(f"""WITH {v.EDGES}, two AS (SELECT [a.source, a.target] AS nodes FROM ed a JOIN ed b ON a.target = b.source AND b.target = a.source WHERE a.source < a.target),
three AS (SELECT DISTINCT list_sort([a.source, a.target, b.target]) AS nodes FROM ed a JOIN ed b ON a.target = b.source JOIN ed c ON b.target = c.source AND c.target = a.source WHERE a.source != b.target)
SELECT array_to_string(nodes, ',') AS nodes, len(nodes) AS length, CASE len(nodes) WHEN 2 THEN 'direct-cycle' ELSE 'indirect-cycle' END AS kind FROM (SELECT * FROM two UNION SELECT * FROM three)""")
def cycles_len_2_3(spark, d):
    c = graph.cycles(v.edges(spark, d))
    return c.select(F.array_join(F.transform("nodes", lambda x: x.cast("string")), ",").alias("nodes"), F.col("length").cast("bigint").alias("length"), graph.cycle_kind(F.col("length"))[0].alias("kind"))


@query(f"""WITH RECURSIVE {v.EDGES}, up AS (SELECT source AS node, min(target) AS parent FROM ed GROUP BY 1), walk AS (SELECT node, parent AS at, 1 AS depth, [node, parent] AS seen FROM up UNION ALL SELECT w.node, u.parent, w.depth + 1, list_append(w.seen, u.parent) FROM walk w JOIN up u ON u.node = w.at WHERE w.depth < 6 AND NOT list_contains(w.seen, u.parent))
SELECT node, max(depth) AS depth FROM walk GROUP BY 1""")
def chain_depth(spark, d):
    return graph.chain_depth(v.edges(spark, d).groupBy(F.col("source").alias("node")).agg(F.min("target").alias("parent")))


@query(f"""WITH {v.EDGES}, l AS (SELECT source, target, ['ui', 'service', 'data'][source % 3 + 1] AS from_layer, ['ui', 'service', 'data'][target % 3 + 1] AS to_layer FROM ed)
SELECT source, target, from_layer, to_layer, CASE WHEN from_layer = 'ui' AND to_layer = 'data' OR from_layer = 'data' THEN 'not-allowed' ELSE 'upward' END AS rule FROM l WHERE from_layer != to_layer AND NOT (from_layer = 'ui' AND to_layer = 'service') AND NOT (from_layer = 'service' AND to_layer = 'data')""")
def layer_violations(spark, d):
    names = F.array(F.lit("ui"), F.lit("service"), F.lit("data"))
    return graph.layer_violations(v.edges(spark, d), lambda c: F.get(names, (c % 3).cast("int")), {"ui": ["service"], "service": ["data", "ui"], "data": []}, ["ui", "service", "data"])


# State


@query("""WITH s AS (SELECT user_id, event_type FROM events WHERE ts < TIMESTAMP '2024-01-03'), b AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-03')
SELECT user_id, event_type, event_id FROM b WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM s WHERE s.user_id = b.user_id AND s.event_type = b.event_type)""")
def idempotent_dedup(spark, d):
    e = v.table(spark, d, "events").select("user_id", "event_type", "event_id", "ts")
    return state.idempotent(e.where("ts >= '2024-01-03'"), e.where("ts < '2024-01-03'"), ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("""WITH f AS (SELECT doc_id AS file, substr(sha256(CAST(doc_id AS VARCHAR) || chr(0) || text), 1, 16) AS content_hash FROM documents)
SELECT file, content_hash, CASE WHEN file % 4 = 3 THEN 'miss' WHEN file % 15 <= 7 THEN 'hit' ELSE 'stale' END AS plan FROM f""")
def ttl_cache_plan(spark, d):
    f = v.table(spark, d, "documents").select(F.col("doc_id").alias("file"), hashing.sha16(F.col("doc_id").cast("string"), F.col("text")).alias("content_hash"))
    cache = f.where("file % 4 != 3").withColumn("reviewed_at", F.lit(AS_OF).cast("timestamp") - F.make_dt_interval((F.col("file") % 15).cast("int")))
    return state.cache_plan(f, cache, AS_OF)


@query("""WITH c AS (SELECT doc_id AS file, CAST(ceil(length(text) / 4) AS BIGINT) AS tokens FROM documents) SELECT count(*) AS files, count_if(file % 3 != 0) AS same, CAST(floor(count_if(file % 3 != 0) * 100 / count(*) + 0.5) AS INT) AS files_saved, CAST(floor(sum(CASE WHEN file % 3 != 0 THEN tokens ELSE 0 END) * 100 / sum(tokens) + 0.5) AS INT) AS tokens_saved FROM c""")
def delta_savings(spark, d):
    c = v.table(spark, d, "documents").select(F.col("doc_id").alias("file"), F.sha2("text", 256).alias("content_hash"), text.token_estimate(F.col("text")).alias("tokens"))
    return state.delta_savings(c.where("file % 3 != 0"), c)


@query("""WITH t AS (SELECT source AS area, doc_id AS file, CAST(ceil(length(text) / 4) AS BIGINT) AS tokens FROM documents)
SELECT area, file, tokens, CAST(coalesce(sum(tokens) OVER (PARTITION BY area ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 8000 AS BIGINT) AS chunk FROM t""")
def token_budget_chunks(spark, d):
    t = v.table(spark, d, "documents").select(F.col("source").alias("area"), F.col("doc_id").alias("file"), text.token_estimate(F.col("text")).alias("tokens"))
    return state.budget_chunks(t, "area", "file", 8000)


QUERIES.update(code.queries() | more.QUERIES)
SQL.update(code.statements() | more.SQL)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
