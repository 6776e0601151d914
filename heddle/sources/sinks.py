"""Documents made of relations: SARIF, run records, batches of annotations, digests, diagrams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions.hashing import h31_base36
from heddle.functions.severity import SARIF, lookup


def sarif(findings: DataFrame, tool: str = "heddle") -> DataFrame:
    """findings: change_set, file, line, severity, category, message. One row change_set, document for each change set."""
    print_of = h31_base36(F.concat_ws(":", "file", F.col("line").cast("string"), "category", "message"))
    result = F.struct(
        F.col("category").alias("ruleId"),
        lookup(SARIF, F.col("severity"), "note").alias("level"),
        F.struct(F.col("message").alias("text")).alias("message"),
        F.array(F.struct(F.struct(F.struct(F.col("file").cast("string").alias("uri")).alias("artifactLocation"), F.struct(F.greatest(F.col("line"), F.lit(1)).alias("startLine")).alias("region")).alias("physicalLocation"))).alias("locations"),
        F.struct(print_of.alias("primaryLocationLineHash")).alias("partialFingerprints"),
    )
    g = findings.groupBy("change_set").agg(F.array_sort(F.collect_set("category")).alias("kinds"), F.array_sort(F.collect_list(result)).alias("results"))
    rules = F.transform("kinds", lambda k: F.struct(k.alias("id"), F.struct(k.alias("text")).alias("shortDescription")))
    run = F.struct(F.struct(F.struct(F.lit(tool).alias("name"), rules.alias("rules")).alias("driver")).alias("tool"), F.col("results"))
    return g.select("change_set", F.to_json(F.struct(F.lit("https://json.schemastore.org/sarif-2.1.0.json").alias("$schema"), F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("document"))


def annotation_batches(findings: DataFrame, order: list[str], size: int = 50) -> DataFrame:
    """Numbers batches of `size` rows within each change set."""
    w = Window.partitionBy("change_set").orderBy(*order)
    return findings.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("int"))


# Parts of a key's name that mark its value as secret.
SECRET_KEYS = r"(?i)key|token|secret|password|credential"


def redact_config(config: Column) -> Column:
    """Values whose key names a secret are replaced."""
    return F.transform_values(config, lambda k, v: F.when(k.rlike(SECRET_KEYS), F.lit("[REDACTED]")).otherwise(v))


def write_runs(runs: DataFrame, path: str) -> None:
    """One folder for each run_id."""
    runs.write.mode("append").partitionBy("run_id").json(path)


def markdown_table(df: DataFrame, most: int = 1000) -> str:
    """A small aggregate as a markdown table; more than `most` rows are an error rather than cut off."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    line = lambda xs: "| " + " | ".join("" if x is None else str(x).replace("|", "\\|") for x in xs) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *map(line, rows)])


def mermaid(edges: DataFrame, most: int = 200) -> str:
    """A flow chart of a small edge relation."""
    rows = edges.select("source", "target").distinct().orderBy("source", "target").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} edges")
    names = {n: f'n{i}["{n}"]' for i, n in enumerate(sorted({str(x) for r in rows for x in r}))}
    return "\n".join(["graph LR", *(f"  {names[str(a)]} --> {names[str(b)]}" for a, b in rows)])


def html_page(title: str, tables: dict[str, DataFrame]) -> str:
    """A page of small tables, all text escaped."""
    import html

    parts = [f"<h1>{html.escape(title)}</h1>"]
    for name, df in tables.items():
        rows = df.limit(1001).collect()
        if len(rows) > 1000:
            raise ValueError(f"{name}: more than 1000 rows")
        cells = lambda xs, tag: "<tr>" + "".join(f"<{tag}>{html.escape('' if x is None else str(x))}</{tag}>" for x in xs) + "</tr>"
        parts.append(f"<h2>{html.escape(name)}</h2><table>{cells(df.columns, 'th')}{''.join(cells(r, 'td') for r in rows)}</table>")
    return "<!DOCTYPE html><html><body>" + "".join(parts) + "</body></html>"
