"""Scorecards and portfolios.

Scores: (repo_id, repo_name, connection_id, score, max_score, checks array of
(check_id, name, passed, message, category)). A null or empty connection is none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Shares that pass and fail, and tiers' lower bounds.
PASSING, FAILING = 0.8, 0.5
UNKNOWN_CONNECTION = "__unknown__"


def share(score: Column, most: Column) -> Column:
    """score / max, null unless max is above 0 (Q22)."""
    return F.when(most > 0, score / most)


def fleet_average(scores: DataFrame) -> DataFrame:
    """F16: (repos, average); repos without a maximum add nothing, but count."""
    return scores.agg(F.count("*").alias("repos"), F.coalesce(F.try_divide(F.sum(F.coalesce(share(F.col("score"), F.col("max_score")), F.lit(0.0))), F.count("*")), F.lit(0.0)).alias("average"))


def fleet_metrics(scores: DataFrame) -> DataFrame:
    """one row of totals; the minimum starts at 1, the maximum at 0."""
    pct = share(F.col("score"), F.col("max_score"))
    passed = F.size(F.filter("checks", lambda c: c["passed"]))
    every = F.size(F.coalesce("checks", F.array().cast(scores.schema["checks"].dataType)))
    return scores.agg(
        F.count("*").alias("total_repos"),
        F.when(F.count("*") > 0, F.least(F.coalesce(F.min(pct), F.lit(1.0)), F.lit(1.0))).otherwise(0.0).alias("min_score"),
        F.greatest(F.coalesce(F.max(pct), F.lit(0.0)), F.lit(0.0)).alias("max_score"),
        F.count_if(pct >= PASSING).alias("passing_repos"),
        F.count_if(pct < FAILING).alias("failing_repos"),
        F.count_distinct(F.when(F.col("connection_id") != "", F.col("connection_id"))).alias("connections"),
        F.coalesce(F.sum(every.cast("long")), F.lit(0)).alias("total_checks"),
        F.coalesce(F.sum(F.coalesce(passed, F.lit(0)).cast("long")), F.lit(0)).alias("passing_checks"),
    ).withColumn("failing_checks", F.col("total_checks") - F.col("passing_checks"))


def by_connection(scores: DataFrame) -> DataFrame:
    """(connection, repos, score, max_score)."""
    name = F.when(F.coalesce("connection_id", F.lit("")) == "", UNKNOWN_CONNECTION).otherwise(F.col("connection_id"))
    return scores.groupBy(name.alias("connection")).agg(F.count("*").alias("repos"), F.sum("score").alias("score"), F.sum("max_score").alias("max_score"))


def moved(before: DataFrame, after: DataFrame) -> DataFrame:
    """(repo_id, old, new) of repos in both snapshots whose connection changed; of repeated ids before, the last by ``seq``."""
    old = before.groupBy("repo_id").agg(F.max_by("connection_id", "seq").alias("old"))
    return after.select("repo_id", F.col("connection_id").alias("new")).join(old, "repo_id").where(~F.col("old").eqNullSafe(F.col("new"))).select("repo_id", "old", "new")


def remediation_summary(results: DataFrame) -> DataFrame:
    """(total, succeeded, failed, skipped, is_complete, is_partial, failed_repos) of one remediation each."""
    n = lambda s: F.count_if(F.col("status") == s)
    out = results.groupBy("remediation_id").agg(F.count("*").alias("total"), n("success").alias("succeeded"), n("failed").alias("failed"), n("skipped").alias("skipped"))
    return out.select("*", (F.col("failed") == 0).alias("is_complete"), ((F.col("failed") > 0) & (F.col("succeeded") > 0)).alias("is_partial"))


def failed_repos(results: DataFrame) -> DataFrame:
    """the failed rows themselves."""
    return results.where("status = 'failed'")


def is_transient(message: Column) -> Column:
    """F22. Fixed values."""
    return message.rlike("timeout|connection reset|EOF|broken pipe")


PERSONAS = ("security", "performance", "reliability", "maintainability", "compliance")
SEVERITIES = ("critical", "high", "medium", "low", "info")


def council_report(findings: DataFrame, personas: tuple[str, ...] = PERSONAS) -> DataFrame:
    """(total, critical, high, medium, low, info) over the personas asked for; an unknown one raises ValueError."""
    if unknown := set(personas) - set(PERSONAS):
        raise ValueError(f"unknown persona: {', '.join(sorted(unknown))}")
    asked = findings.where(F.col("persona").isin(*personas))
    return asked.agg(F.count("*").alias("total"), *[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])


def standards_gaps(findings: DataFrame, category: str = "standards-gap") -> DataFrame:
    """(id, adr_title, adr_summary, adr_context, proposed) of findings of one category."""
    context = F.concat(F.lit("Detected by "), F.col("persona"), F.lit(" persona during governance review"))
    return findings.where(F.col("category") == category).select("id", F.concat(F.lit("ADR: "), "title").alias("adr_title"), F.col("message").alias("adr_summary"), context.alias("adr_context"), F.col("remediation").alias("proposed"))


def tier(score: Column) -> Column:
    """Fixed values: .8 and .5."""
    return F.when(score >= PASSING, "healthy").when(score >= FAILING, "degraded").otherwise("critical")


def portfolio_summary(repos: DataFrame) -> DataFrame:
    """(total, healthy, degraded, critical, unknown, average) of ``repos`` (path, health_tier, score)."""
    n = lambda t: F.count_if(F.col("health_tier") == t)
    known = F.col("health_tier").isin("healthy", "degraded", "critical")
    return repos.agg(F.count("*").alias("total"), n("healthy").alias("healthy"), n("degraded").alias("degraded"), n("critical").alias("critical"), F.count_if(~F.coalesce(known, F.lit(False))).alias("unknown"), F.coalesce(F.avg("score"), F.lit(0.0)).alias("average"))


def in_tier(repos: DataFrame, health_tier: str) -> DataFrame:
    """the repos of a tier, best first, ties by seq."""
    return repos.where(F.col("health_tier") == health_tier).orderBy(F.desc("score"), "seq")


def cross_repo_health(results: DataFrame, top: int = 5) -> DataFrame:
    """(overall_score, overall_tier, best, worst) of ``results`` (seq, name, score); best and worst hold ``top`` names, ties by seq."""
    overall = results.agg(F.avg("score").alias("s"))
    best = results.orderBy(F.desc("score"), "seq").limit(top).agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("k"), "seq", "name"))).alias("b"))
    worst = results.orderBy("score", "seq").limit(top).agg(F.sort_array(F.collect_list(F.struct(F.col("score").alias("k"), "seq", "name"))).alias("w"))
    names = lambda c: F.transform(c, lambda x: x["name"])
    return overall.crossJoin(best).crossJoin(worst).select(F.coalesce("s", F.lit(0.0)).alias("overall_score"), tier(F.coalesce("s", F.lit(0.0))).alias("overall_tier"), names("b").alias("best"), names("w").alias("worst"))


def portfolio_query(repos: DataFrame, health_tier: str | None = None, min_score: float | None = None, label: tuple[str, str] | None = None, order_by: str = "score", descending: bool = True, limit: int = 100, offset: int = 0) -> DataFrame:
    """a page of ``repos``; the limit is the query's own."""
    found = repos
    if health_tier:
        found = found.where(F.col("health_tier") == health_tier)
    if min_score is not None:
        found = found.where(F.col("score") >= min_score)
    if label:
        found = found.where(F.try_element_at("labels", F.lit(label[0])) == label[1])
    return found.orderBy(F.desc(order_by) if descending else F.asc(order_by), "path").offset(offset).limit(limit)
