"""Queries on quotas and usage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.catalog import query, table
from paperloom.operators import billing, pages

#: Quotas: customers' balances in two variants; those of one segment are unlimited, some are missing.
QUOTA_SQL = """
SELECT user_id, quota, is_unlimited FROM (SELECT c_custkey AS user_id, 'coin' AS asset, v AS variant, c_mktsegment = 'BUILDING' AS is_unlimited,
  CASE WHEN c_custkey % 10 <> 3 THEN cast(cast(c_acctbal AS VARCHAR) AS DECIMAL(38,18)) + CASE v WHEN 'ocr' THEN 0 ELSE 1000 END END AS quota FROM customer, (VALUES ('ocr'), ('other')) t(v))
WHERE asset = 'coin' AND variant = 'ocr'
"""


def quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, asset, variant, quota, is_unlimited: two variants of each customer."""
    variant = F.explode(F.array(F.lit("ocr"), F.lit("other"))).alias("variant")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.lit("coin").alias("asset"), variant, "c_acctbal", (F.col("c_mktsegment") == "BUILDING").alias("is_unlimited"))
    balance = billing.exact_decimal(F.col("c_acctbal")) + F.when(F.col("variant") == "ocr", 0).otherwise(1000)
    return rows.select("user_id", "asset", "variant", F.when(F.col("user_id") % 10 != 3, balance).cast(billing.DECIMAL).alias("quota"), "is_unlimited")


COIN = {"asset": "coin", "variant": "ocr"}


@query(f"SELECT event_id, e.user_id, coalesce(is_unlimited, false) OR coalesce(quota >= cast(floor(value * 10) AS BIGINT), false) AS allowed FROM events e LEFT JOIN ({QUOTA_SQL}) q ON q.user_id = e.user_id")
def quota_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = table(spark, sf_dir, "events").select("event_id", "user_id", F.floor(F.col("value") * 10).alias("pages"))
    return billing.gate(tasks, quotas(spark, sf_dir), "user_id", F.col("pages"), **COIN).select("event_id", "user_id", "allowed")


@query(f"SELECT event_id, e.user_id, coalesce(is_unlimited, false) OR coalesce(quota >= 1, false) AS allowed FROM events e LEFT JOIN ({QUOTA_SQL}) q ON q.user_id = e.user_id")
def quota_gate_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return billing.gate(table(spark, sf_dir, "events").select("event_id", "user_id"), quotas(spark, sf_dir), "user_id", F.lit(1), **COIN).select("event_id", "user_id", "allowed")


OCR_SQL = f"""
SELECT event_id, CASE WHEN kind = 'direct' THEN 'completed' WHEN pages = 0 OR NOT allowed THEN 'error' ELSE 'processing' END AS task_status,
  CASE WHEN kind = 'direct' THEN NULL WHEN pages = 0 THEN 'Failed to prepare pages for file type: ' || mime WHEN NOT allowed THEN 'insufficient_quota' END AS message,
  kind <> 'direct' AND pages > 0 AND allowed AS metered
FROM (SELECT event_id, pages, kind, mime, coalesce(is_unlimited, false) OR coalesce(quota >= pages, false) AS allowed FROM
  (SELECT event_id, user_id, cast(floor(value * 10) AS BIGINT) % 400 AS pages, CASE WHEN event_type = 'signup' THEN 'direct' ELSE 'ocr' END AS kind, CASE WHEN event_type = 'view' THEN 'image/png' ELSE 'application/pdf' END AS mime FROM events) e
  LEFT JOIN ({QUOTA_SQL}) q ON q.user_id = e.user_id)
"""


@query(OCR_SQL)
def ocr_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each recognition task before a model is called: direct files are not gated, empty ones and missing quota are errors."""
    kind = F.col("event_type")
    route = F.when(kind == "signup", "direct").otherwise("ocr").alias("route")
    mime = F.when(kind == "view", "image/png").otherwise("application/pdf").alias("mime")
    tasks = table(spark, sf_dir, "events").select("event_id", "user_id", (F.floor(F.col("value") * 10) % 400).alias("pages"), route, mime)
    gated = billing.gate(tasks, quotas(spark, sf_dir), "user_id", F.col("pages"), **COIN, bypass=F.col("route") == "direct")
    return pages.task_outcomes(gated).select("event_id", "task_status", "message", "metered")


ARCHIVE_SQL = "SELECT conv_id, conv_id % 150 AS user_id, cast(sum(coalesce(CASE WHEN turn % 3 <> 0 THEN turn END, 0)) AS BIGINT) AS pages FROM conversations GROUP BY 1, 2"


def archive_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", (F.col("conv_id") % 150).alias("user_id"), F.when(F.col("turn") % 3 != 0, F.col("turn")).alias("pages"))


@query(ARCHIVE_SQL)
def archive_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return billing.archive_gate(archive_members(spark, sf_dir), quotas(spark, sf_dir), "conv_id", "user_id", **COIN).select("conv_id", "user_id", "pages")


@query(f"SELECT conv_id, a.user_id, pages, coalesce(is_unlimited, false) OR coalesce(quota >= pages, false) AS allowed FROM ({ARCHIVE_SQL}) a LEFT JOIN ({QUOTA_SQL}) q ON q.user_id = a.user_id")
def archive_quota_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return billing.archive_gate(archive_members(spark, sf_dir), quotas(spark, sf_dir), "conv_id", "user_id", **COIN).select("conv_id", "user_id", "pages", "allowed")


#: Usage records: events; some without a user, enrollment or positive amount.
USAGE_SQL = """
SELECT event_id AS usage_id, CASE WHEN event_id % 11 <> 0 THEN user_id END AS user_id, CASE WHEN event_id % 22 = 0 THEN event_id END AS enrollment_id, event_type AS asset,
  cast(cast(CASE WHEN event_id % 13 = 0 THEN -value ELSE value END AS VARCHAR) AS DECIMAL(38,18)) AS amount FROM events
"""


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    return table(spark, sf_dir, "events").select(n.alias("usage_id"), F.when(n % 11 != 0, F.col("user_id")).alias("user_id"), F.when(n % 22 == 0, n).alias("enrollment_id"), F.col("event_type").alias("asset"), billing.exact_decimal(F.when(n % 13 == 0, -F.col("value")).otherwise(F.col("value"))).alias("amount"))


@query(f"SELECT usage_id, CASE WHEN user_id IS NULL AND enrollment_id IS NULL THEN 'no owner' WHEN amount <= 0 THEN 'amount not positive' END AS problem FROM ({USAGE_SQL})")
def usage_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage(spark, sf_dir).select("usage_id", billing.usage_problem(F.col("user_id"), F.col("enrollment_id"), F.col("amount")).alias("problem"))


@query(f"SELECT usage_id, user_id, asset, amount FROM ({USAGE_SQL}) WHERE amount > 0 AND (user_id IS NOT NULL OR enrollment_id IS NOT NULL)")
def usage_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usage(spark, sf_dir)
    return rows.where(billing.usage_problem(F.col("user_id"), F.col("enrollment_id"), F.col("amount")).isNull()).select("usage_id", "user_id", "asset", "amount")


@query(f"SELECT usage_id, amount FROM ({USAGE_SQL}) WHERE usage_id NOT IN (SELECT event_id FROM events WHERE event_type = 'error')")
def usage_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    cancelled = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("event_id").alias("usage_id"))
    return billing.net_usage(usage(spark, sf_dir), cancelled).select("usage_id", "amount")


@query(f"SELECT user_id, asset, cast(sum(amount) AS DECIMAL(38,18)) AS amount, count(*) AS n FROM ({USAGE_SQL}) GROUP BY user_id, asset")
def usage_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return billing.usage_totals(usage(spark, sf_dir), "user_id", "asset")
