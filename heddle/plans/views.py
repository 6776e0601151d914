"""The driver's tables as the canonical relations (feedback, findings, spend, lines, edges ...), for Spark and for DuckDB.

Each view is given twice, as a DataFrame and as the body of a common table expression, so that queries and their
reference statements start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEVELS = "['critical','high','medium','low','nitpick']"
_levels = ("critical", "high", "medium", "low", "nitpick")


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def feedback(spark: SparkSession, d: str) -> DataFrame:
    """id, repo, pr, file, category, severity, outcome, bucket, created_at."""
    k = F.get_json_object("props", "$.k").cast("int")
    rank = F.expr("CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END")
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"),
        (F.col("user_id") % 3).alias("repo"),
        F.col("user_id").alias("pr"),
        F.concat(F.lit("src/mod"), F.col("user_id") % 12, F.lit("/f"), "user_id", F.lit(".ts")).alias("file"),
        F.col("event_type").alias("category"),
        F.get(F.array(*map(F.lit, _levels)), (F.col("user_id") % 5).cast("int")).alias("severity"),
        F.when(k % 10 == 0, "pending").when(k < 15 + 20 * rank, "helpful").otherwise("unhelpful").alias("outcome"),
        (k % 7).alias("bucket"),
        F.col("ts").alias("created_at"),
    )


FEEDBACK = f"""fb AS (
  SELECT event_id AS id, user_id % 3 AS repo, user_id AS pr, 'src/mod' || (user_id % 12) || '/f' || user_id || '.ts' AS file,
    event_type AS category, {LEVELS}[CAST(user_id % 5 AS INT) + 1] AS severity,
    CASE WHEN k % 10 = 0 THEN 'pending'
         WHEN k < 15 + 20 * CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END THEN 'helpful'
         ELSE 'unhelpful' END AS outcome,
    k % 7 AS bucket, ts AS created_at
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events))"""


def spend(spark: SparkSession, d: str) -> DataFrame:
    """provider, model, tokens, cached, risk, at."""
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    o = table(spark, d, "orders")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select(
        F.col("c_mktsegment").alias("provider"),
        F.col("o_orderstatus").alias("model"),
        F.floor("o_totalprice").alias("tokens"),
        F.floor(F.col("o_totalprice") * (F.col("o_custkey") % 4) / 10).alias("cached"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("risk"),
        F.col("o_orderdate").alias("at"),
    )


SPEND = """sp AS (
  SELECT c_mktsegment AS provider, o_orderstatus AS model, CAST(floor(o_totalprice) AS BIGINT) AS tokens,
    CAST(floor(o_totalprice * (o_custkey % 4) / 10) AS BIGINT) AS cached, CAST(substr(o_orderpriority, 1, 1) AS INT) AS risk, o_orderdate AS paid
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def findings(spark: SparkSession, d: str) -> DataFrame:
    """change_set, file, dir, line, severity, category, confidence, message: one row for each line item of an order."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_discount", "l_quantity")
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_brand")
    category = F.get(F.array(*map(F.lit, ("security", "bug", "compliance", "performance", "architecture", "style"))), ((F.ascii("l_returnflag") + F.ascii("l_linestatus") + F.col("l_linenumber")) % 6).cast("int"))
    return (
        li.join(o, li["l_orderkey"] == o["o_orderkey"])
        .join(p, li["l_partkey"] == p["p_partkey"])
        .select(
            F.col("l_orderkey").alias("change_set"),
            F.col("l_partkey").alias("file"),
            F.col("p_brand").alias("dir"),
            F.col("l_linenumber").alias("line"),
            F.get(F.array(*map(F.lit, _levels)), F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("severity"),
            category.alias("category"),
            F.least(F.floor(F.col("l_discount") * 1000 + 0.5), F.lit(100)).cast("int").alias("confidence"),
            F.col("p_name").alias("message"),
            F.floor("l_quantity").cast("int").alias("size"),
        )
    )


FINDINGS = f"""fi AS (
  SELECT l_orderkey AS change_set, l_partkey AS file, p_brand AS dir, l_linenumber AS line,
    {LEVELS}[CAST(substr(o_orderpriority, 1, 1) AS INT)] AS severity,
    ['security','bug','compliance','performance','architecture','style'][(ascii(l_returnflag) + ascii(l_linestatus) + l_linenumber) % 6 + 1] AS category,
    CAST(least(floor(l_discount * 1000 + 0.5), 100) AS INT) AS confidence, p_name AS message, CAST(floor(l_quantity) AS INT) AS size
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""


def lines(spark: SparkSession, d: str) -> DataFrame:
    """file, area, pos (from 1), content: the documents' lines."""
    return table(spark, d, "documents").select(F.col("doc_id").alias("file"), F.col("source").alias("area"), F.posexplode(F.split("text", "\n")).alias("at", "content")).select("file", "area", (F.col("at") + 1).cast("bigint").alias("pos"), "content")


LINES = """ln AS (
  SELECT doc_id AS file, source AS area, unnest(range(1, len(s) + 1)) AS pos, unnest(s) AS content
  FROM (SELECT doc_id, source, string_split(text, chr(10)) AS s FROM documents))"""


def edges(spark: SparkSession, d: str) -> DataFrame:
    """source, target, kind: a sparse cyclic graph over customers, with an edge for every order."""
    n = table(spark, d, "customer").agg(F.count(F.lit(1)).alias("n"))
    o = table(spark, d, "orders").crossJoin(F.broadcast(n))  # one row
    return o.select(F.col("o_custkey").alias("source"), (F.col("o_orderkey") % F.col("n")).alias("target"), F.col("o_orderstatus").alias("kind")).where("source != target").groupBy("source", "target").agg(F.min("kind").alias("kind"))


EDGES = """ed AS (
  SELECT source, target, min(kind) AS kind FROM (
    SELECT o_custkey AS source, o_orderkey % (SELECT count(*) FROM customer) AS target, o_orderstatus AS kind FROM orders) WHERE source != target GROUP BY 1, 2)"""


def paths(spark: SparkSession, d: str) -> DataFrame:
    """id, path: the path of each page's address without its leading slash, under its host."""
    return table(spark, d, "pages").select(F.col("page_id").alias("id"), F.regexp_extract("url", r"^[a-z]+://([^?#]*)", 1).alias("path"))


PATHS = """pa AS (SELECT page_id AS id, regexp_extract(url, '^[a-z]+://([^?#]*)', 1) AS path FROM pages)"""


def versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Old and new `name, version` relations: parts shipped in 1997 and 1998."""
    li = table(spark, d, "lineitem")

    def of(year: int) -> DataFrame:
        q = F.floor(F.avg("l_quantity"))
        return li.where(F.year("l_shipdate") == year).groupBy(F.col("l_partkey").alias("name")).agg(F.concat(F.floor(q / 10), F.lit("."), q % 10, F.lit(".0")).alias("version"))

    return of(1997), of(1998)


VERSIONS = """vs AS (
  SELECT year(l_shipdate) AS y, l_partkey AS name, CAST(floor(avg(l_quantity)) AS BIGINT) AS q FROM lineitem GROUP BY 1, 2),
old AS (SELECT name, (q // 10) || '.' || (q % 10) || '.0' AS version, q FROM vs WHERE y = 1997),
new AS (SELECT name, (q // 10) || '.' || (q % 10) || '.0' AS version, q FROM vs WHERE y = 1998)"""


def user_events(spark: SparkSession, d: str) -> DataFrame:
    """file (user), pos (in time), kind, value: an ordered line relation for frames."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select(F.col("user_id").alias("file"), F.row_number().over(w).alias("pos"), F.col("event_type").alias("kind"), "event_id", "ts")


USER_EVENTS = """ue AS (
  SELECT user_id AS file, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, event_type AS kind, event_id, ts FROM events)"""
