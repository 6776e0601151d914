"""JSON, JSON-lines and directory stores, read tolerantly and written with a capacity."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The canonical schemas; timestamps are UTC.
SCHEMAS = {
    "feedback": "id bigint, repo string, pr bigint, comment_id bigint, file string, line int, category string, severity string, message_hash string, outcome string, created_at timestamp",
    "suggestions": "id bigint, repo string, file string, line int, category string, severity string, message_hash string, outcome string, created_at timestamp",
    "rules": "id string, name string, description string, source string, type string, pattern string, file_glob string, severity string, category string, message string, confidence int, created_at timestamp, last_matched_at timestamp, match_count int, enabled boolean",
    "spend": "timestamp timestamp, repo string, pr bigint, provider string, model string, input_tokens bigint, output_tokens bigint, cached_tokens bigint, total_tokens bigint, tier string, finding_count int, risk_score int",
    "snapshots": "pr_key string, sha string, iteration int, ts timestamp, findings array<struct<key:string,file:string,line:int,category:string,severity:string,message_hash:string>>",
    "patterns": "key string, pr_key string, ts timestamp, severity string, file string, message string",
    "cache": "file string, content_hash string, findings array<string>, reviewed_at timestamp, risk_score int, summary string",
    "history": "repo string, pr_number int, title string, files string, finding_categories string, finding_count int, risk_score int, summary string, reviewed_at timestamp",
    "suppressions": "id bigint, repo string, file_pattern string, category string, message_pattern string, reason string, hit_count int, created_at timestamp, last_hit_at timestamp",
    "deliveries": "key string, seen_at timestamp",
}


def _empty_if_missing(spark: SparkSession, read, schema: str) -> DataFrame:
    try:
        return read()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A document store: one array or object a file; a missing path or malformed documents give no rows."""
    return _empty_if_missing(spark, lambda: spark.read.schema(schema).option("mode", "DROPMALFORMED").option("multiLine", True).json(path), schema)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A log of one object a line; malformed lines are skipped."""
    return _empty_if_missing(spark, lambda: spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path), schema)


def read_runs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A folder of one JSON document a run, with the run's id from the file's name, ordered by it."""
    runs = _empty_if_missing(spark, lambda: spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(f"{path}/*.json"), schema)
    return runs.withColumn("run_id", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)).orderBy("run_id")


def write_log(df: DataFrame, path: str, order: list, capacity: int | None = None) -> None:
    """Writes JSON lines to a new path, the first `capacity` rows in the given order."""
    (df.orderBy(*order).limit(capacity) if capacity else df).write.mode("errorifexists").json(path)


def packed_list(column: str, separator: str = ","):
    """A comma- or space-packed text as an array."""
    return F.filter(F.transform(F.split(F.coalesce(F.col(column), F.lit("")), separator), F.trim), lambda x: x != "")


def eslint_findings(reports: DataFrame) -> DataFrame:
    """reports: report (a JSON array of files with messages). Rows file, line, severity, rule, message."""
    kind = "array<struct<filePath:string,messages:array<struct<line:int,severity:int,ruleId:string,message:string>>>>"
    f = reports.select(F.explode(F.from_json("report", kind)).alias("f")).select("f.filePath", F.explode("f.messages").alias("m"))
    return f.select(F.col("filePath").alias("file"), "m.line", F.when(F.col("m.severity") == 2, "high").otherwise("low").alias("severity"), F.col("m.ruleId").alias("rule"), "m.message")


def compiler_findings(output: DataFrame) -> DataFrame:
    """output: text lines `file(line,column): error TS1234: message`."""
    p = r"^(.+?)\((\d+),(\d+)\): (error|warning) (\w+): (.*)$"
    x = output.where(F.col("text").rlike(p))
    g = lambda i: F.regexp_extract("text", p, i)
    return x.select(g(1).alias("file"), g(2).cast("int").alias("line"), F.when(g(4) == "error", "high").otherwise("low").alias("severity"), g(5).alias("rule"), g(6).alias("message"))


def audit_findings(reports: DataFrame) -> DataFrame:
    """reports: report (a package audit's JSON with a `vulnerabilities` map). Rows name, severity, range."""
    kind = "struct<vulnerabilities:map<string,struct<severity:string,range:string>>>"
    v = reports.select(F.explode(F.from_json("report", kind)["vulnerabilities"]).alias("name", "v"))
    level = F.when(F.col("v.severity") == "moderate", "medium").when(F.col("v.severity") == "info", "nitpick").otherwise(F.col("v.severity"))
    return v.select("name", level.alias("severity"), F.col("v.range").alias("range"))


def scan_workspace(spark: SparkSession, path: str, depth: int = 3, a_folder: int = 20, most: int = 200) -> DataFrame:
    """path, folder, bytes of the files of a workspace, down to `depth` folders, hidden ones left out: the first of each folder by
    name, and of all, as many as a project index lists. Only names and sizes are read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("bytes"))
    root = F.lit(path.rstrip("/").removeprefix("file://") + "/")
    f = f.withColumn("path", F.substring_index(F.regexp_replace("path", "^file:/+", "/"), root, -1)).where(~F.col("path").rlike(r"(^|/)\."))
    f = f.withColumn("folder", F.regexp_replace("path", "/?[^/]*$", "")).where(F.size(F.split("path", "/")) <= depth + 1)
    w = Window.partitionBy("folder").orderBy("path")
    return f.withColumn("n", F.row_number().over(w)).where(F.col("n") <= a_folder).drop("n").orderBy("path").limit(most)
