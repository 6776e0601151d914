"""Feedback analytics: acceptance, suppression, learning, attribution, mining, fatigue, trend and decay.

Relations: feedback (category, severity, outcome, created_at ...). Outcome `pending` never counts; `accepted`,
`fixed` and `helpful` are acceptances. Each operator is one aggregation with partial sums on the map side, so hot
categories do not skew; results are small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions.hashing import h31_base36
from heddle.functions.numbers import age_days, half_life_weight, linear_decay, ratio, round_half_up
from heddle.functions.severity import ordinal, shift

ACCEPTED = ("accepted", "fixed", "helpful")


def _ok():
    return F.col("outcome").isin(*ACCEPTED)


def acceptance(feedback: DataFrame, keys: list[str]) -> DataFrame:
    """total, accepted and rate of each key over resolved rows."""
    return feedback.where("outcome != 'pending'").groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.count_if(_ok()).alias("accepted")).withColumn("rate", ratio(F.col("accepted"), F.col("total"), 0.0))


def suppressed(feedback: DataFrame, least: int = 5, below: float = 0.3) -> DataFrame:
    """category and severity pairs with enough resolved rows and too low a rate."""
    return acceptance(feedback, ["category", "severity"]).where((F.col("total") >= least) & (F.col("rate") < below))


def learning_class(feedback: DataFrame) -> DataFrame:
    """demote, promote or neutral for each category."""
    a = acceptance(feedback, ["category"])
    kind = F.when(F.col("total") < 5, "neutral").when(F.col("rate") < 0.3, "demote").when(F.col("rate") > 0.9, "promote").otherwise("neutral")
    return a.withColumn("weight", kind)


def apply_learning(findings: DataFrame, classes: DataFrame) -> DataFrame:
    """Moves severities one step and confidences by ten, as the category's class says; unknown severities stay."""
    by = F.when(F.col("weight") == "demote", F.lit(-1)).when(F.col("weight") == "promote", F.lit(1)).otherwise(F.lit(0))
    at = ordinal(F.col("severity"))
    moves = ((by < 0) & (at > 0)) | ((by > 0) & (at < 4))
    c = F.col("confidence") + F.when(moves, by * 10).otherwise(0)
    out = findings.join(classes.select("category", "weight"), "category", "left")
    return out.withColumns({"severity": shift(F.col("severity"), by), "confidence": F.least(F.greatest(c, F.lit(0)), F.lit(100))}).drop("weight")


def reduce_noise(findings: DataFrame, suppressed_pairs: DataFrame) -> DataFrame:
    """A suppressed pair's confidence above 50 loses 25, down to 50."""
    flag = suppressed_pairs.select("category", "severity", F.lit(True).alias("__hd_flag"))
    c = F.when(F.col("__hd_flag") & (F.col("confidence") > 50), F.greatest(F.lit(50), F.col("confidence") - 25)).otherwise(F.col("confidence"))
    return findings.join(flag, ["category", "severity"], "left").withColumn("confidence", c).drop("__hd_flag")


def attribution(feedback: DataFrame, as_of: str, half_life: float = 30.0) -> DataFrame:
    """Recency-weighted dismissal rate of each category, its penalty, and whether ten rows support it."""
    w = half_life_weight(age_days(as_of, F.col("created_at")), half_life)
    a = feedback.where("outcome != 'pending'").groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("w"), F.sum(F.when(~_ok(), w).otherwise(0.0)).alias("bad"))
    rate = F.col("bad") / F.col("w")
    return a.select("category", "n", round_half_up(rate, 2).alias("rate"), F.when(rate > 0.4, F.least(round_half_up(rate * 75), F.lit(75))).otherwise(0).cast("int").alias("penalty"), (F.col("n") >= 10).alias("reliable"))


def apply_attribution(findings: DataFrame, penalties: DataFrame) -> DataFrame:
    """Reliable penalties lower confidence, not below ten."""
    p = penalties.where("reliable and penalty > 0").select("category", F.col("penalty").alias("__hd_p"))
    c = F.least(F.col("confidence"), F.greatest(F.lit(10), F.col("confidence") - F.coalesce("__hd_p", F.lit(0))))
    return findings.join(p, "category", "left").withColumn("confidence", c).drop("__hd_p")


def negative_rules(feedback: DataFrame, message, least: int = 3, at: float = 0.6, top: int = 20) -> DataFrame:
    """(category, first four characters of the message's hash) that are mostly dismissed."""
    a = acceptance(feedback.withColumn("pattern", F.substring(h31_base36(message), 1, 4)), ["category", "pattern"])
    bad = (F.col("total") - F.col("accepted")) / F.col("total")
    return a.select("category", "pattern", "total", bad.alias("dismissal")).where((F.col("total") >= least) & (F.col("dismissal") >= at)).orderBy(F.desc("dismissal"), F.desc("total"), "category", "pattern").limit(top)


def fatigue(feedback: DataFrame) -> DataFrame:
    """Counts, acceptance and fatigue score of each category, pending rows in the total."""
    good, bad = F.count_if(_ok()), F.count_if(F.col("outcome") == "unhelpful")
    a = feedback.groupBy("category").agg(F.count(F.lit(1)).alias("total"), good.alias("helpful"), bad.alias("unhelpful"))
    n = F.col("helpful") + F.col("unhelpful")
    rate = ratio(F.col("unhelpful"), n, 0.0)
    return a.select("category", "total", "helpful", "unhelpful", ratio(F.col("helpful"), n, 0.5).alias("acceptance"), (round_half_up(rate * F.log10(F.col("total") + 1) * 100) / 10).alias("fatigue"))


def fatigue_summary(scores: DataFrame) -> DataFrame:
    """Overall acceptance in percent and the noisiest category, named only above a score of five."""
    n = F.sum(F.col("helpful") + F.col("unhelpful"))
    top = F.max_by(F.struct("category", "fatigue"), F.struct("fatigue", "category"))
    return scores.agg(round_half_up(F.sum("helpful") * 100 / n).alias("overall"), top.alias("t")).select("overall", F.when(F.col("t.fatigue") > 5, F.col("t.category")).alias("noisiest"))


def trend(feedback: DataFrame, keys: list[str], order: list[str], least: int = 6, step: float = 0.15) -> DataFrame:
    """improving, declining or stable: the newer half's rate against the older half's, each key on its own.

    order: a timestamp and what breaks its ties. Ranks are counted by day and then inside a day, so that a key with
    most of the rows is as many tasks as it has days.
    """
    r = feedback.where("outcome != 'pending'").select(*keys, *order, _ok().cast("int").alias("ok"), F.date_trunc("day", order[0]).alias("__hd_day"))
    days = r.groupBy(*keys, "__hd_day").agg(F.count(F.lit(1)).alias("__hd_n"))
    by_day = Window.partitionBy(*keys).orderBy("__hd_day")
    days = days.select(*keys, "__hd_day", (F.sum("__hd_n").over(by_day) - F.col("__hd_n")).alias("__hd_before"), F.sum("__hd_n").over(Window.partitionBy(*keys)).alias("n"))
    ranked = r.withColumn("i", F.row_number().over(Window.partitionBy(*keys, "__hd_day").orderBy(*order)))
    i = F.col("i") + F.col("__hd_before")
    both = ranked.join(days, [ranked[c].eqNullSafe(days[c]) for c in (*keys, "__hd_day")]).select(*[ranked[c] for c in keys], "ok", "n", (i <= F.floor(F.col("n") / 2)).alias("old"))
    a = both.groupBy(*keys).agg(F.max("n").alias("n"), F.avg(F.when(F.col("old"), F.col("ok"))).alias("older"), F.avg(F.when(~F.col("old"), F.col("ok"))).alias("newer"))
    d = F.col("newer") - F.col("older")
    return a.select(*keys, "n", F.when(F.col("n") < least, "stable").when(d > step, "improving").when(d < -step, "declining").otherwise("stable").alias("trend"))


def mine_rules(feedback: DataFrame, least: int = 3, at: float = 0.4, top: int | None = 20) -> DataFrame:
    """Rules from (file, category) groups that are often accepted: severity of the latest row, confidence by rate."""
    a = (
        feedback.where("outcome != 'pending'")
        .groupBy("file", "category")
        .agg(F.count(F.lit(1)).alias("total"), F.count_if(_ok()).alias("accepted"), F.max_by("severity", F.struct("created_at", "id")).alias("severity"), F.max("created_at").alias("last_matched_at"), F.min("created_at").alias("created_at"))
    )
    rate = F.col("accepted") / F.col("total")
    glob = F.concat(F.regexp_replace("file", "/[^/]*$", ""), F.lit("/**"), F.regexp_extract("file", r"(\.[A-Za-z0-9]+)$", 1))
    a = a.where((F.col("total") >= least) & (rate >= at)).select(
        F.concat(F.lit("discovered-"), F.regexp_replace("file", "[^A-Za-z0-9]", "-"), F.lit("-"), "category").alias("id"),
        "file", "category", "severity", glob.alias("glob"), "total", "accepted", round_half_up(60 + 25 * rate).cast("int").alias("confidence"), "created_at", "last_matched_at",
    )
    return a.orderBy(F.desc("total"), "file", "category").limit(top) if top else a


def decay_rules(rules: DataFrame, stats: DataFrame, as_of: str, least: int = 20, below: float = 0.3) -> DataFrame:
    """Linear decay by idle days for rules of categories that are seldom accepted; under 30 they are disabled.

    rules: id, category, confidence, last_matched_at, created_at; stats: category, total, rate. Computed from the
    base confidence, so applying it twice changes nothing.
    """
    days = F.floor(age_days(as_of, F.coalesce("last_matched_at", "created_at")))
    amount = F.when((F.col("cat_total") >= least) & (F.col("cat_rate") < below), linear_decay(F.greatest(days, F.lit(0)))).otherwise(F.lit(0))
    s = stats.select("category", F.col("total").alias("cat_total"), F.col("rate").alias("cat_rate"))
    out = rules.join(s, "category", "left").withColumn("decay", F.coalesce(amount, F.lit(0)).cast("int"))
    return out.withColumn("confidence", F.greatest(F.col("confidence") - F.col("decay"), F.lit(0)).cast("int")).withColumn("enabled", F.col("confidence") >= 30).drop("cat_total", "cat_rate")


def merge_rules(stored: DataFrame, mined: DataFrame, revive: bool = False) -> DataFrame:
    """Upsert by id: mined confidence and counts win, creation stays; a disabled rule stays disabled unless revive is set."""
    s = stored.select("id", *[F.col(c).alias(f"s_{c}") for c in ("confidence", "total", "created_at", "enabled")])
    m = mined.select("id", *[F.col(c).alias(f"m_{c}") for c in ("confidence", "total", "created_at")])
    on = F.coalesce("s_enabled", F.lit(True))
    return s.join(m, "id", "full_outer").select(
        "id",
        F.coalesce("m_confidence", "s_confidence").alias("confidence"),
        F.coalesce("m_total", "s_total").alias("total"),
        F.coalesce("s_created_at", "m_created_at").alias("created_at"),
        (F.lit(True) if revive else on).alias("enabled"),
    )


def resolve_outcomes(suggestions: DataFrame, updates: DataFrame) -> DataFrame:
    """UPDATE ... SET outcome WHERE message_hash matches and outcome is pending. updates: message_hash, outcome."""
    u = updates.groupBy("message_hash").agg(F.max("outcome").alias("__hd_o"))
    new = F.when((F.col("outcome") == "pending") & F.col("__hd_o").isNotNull(), F.col("__hd_o")).otherwise(F.col("outcome"))
    return suggestions.join(u, "message_hash", "left").withColumn("changed", new != F.col("outcome")).withColumn("outcome", new).drop("__hd_o")
