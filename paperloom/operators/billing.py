"""Quota gates and the usage ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DECIMAL = "decimal(38,18)"


def exact_decimal(value: Column) -> Column:
    """A float's shortest text as a decimal."""
    return value.cast("string").cast(DECIMAL)


def passes_quota(quota: Column, is_unlimited: Column, needed: Column) -> Column:
    """False for a missing quota or one below what is needed; unlimited always passes."""
    return F.coalesce(is_unlimited, F.lit(False)) | F.coalesce(quota >= needed, F.lit(False))


def quota_of(quotas: DataFrame, key: str, asset: str | None = None, variant: str | None = None) -> DataFrame:
    """key, quota, is_unlimited: those of one asset and variant. Two rows of a key fail the query rather than count twice."""
    for name, value in (("asset", asset), ("variant", variant)):
        if value is not None:
            quotas = quotas.where(F.col(name) == F.lit(value))
    one = quotas.groupBy(key).agg(F.count("*").alias("n"), F.max(F.struct("quota", "is_unlimited")).alias("q"))
    single = F.when(F.col("n") == 1, F.col("q")).otherwise(F.raise_error(F.lit("more than one quota for a user, asset and variant")))
    return one.select(key, single.alias("q")).select(key, "q.quota", "q.is_unlimited")


def gate(tasks: DataFrame, quotas: DataFrame, key: str, needed: Column, asset: str | None = None, variant: str | None = None, bypass: Column | None = None) -> DataFrame:
    """Tasks with `allowed`. A task without a quota row has no quota; those of `bypass` (direct files) are not gated."""
    joined = tasks.join(quota_of(quotas, key, asset, variant), key, "left")
    passes = passes_quota(F.col("quota"), F.col("is_unlimited"), needed)
    return joined.withColumn("allowed", passes if bypass is None else F.coalesce(bypass, F.lit(False)) | passes)


def required(gated: DataFrame, needed: Column) -> DataFrame:
    """The same rows; one that is not allowed fails the query and says what is missing."""
    message = F.concat(F.lit("You have only "), F.coalesce(F.col("quota").cast("string"), F.lit("None")), F.lit(" coins, while you need "), needed.cast("string"), F.lit(" coins."))
    return gated.withColumn("allowed", F.when(F.col("allowed"), F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))


def archive_gate(members: DataFrame, quotas: DataFrame, archive: str, key: str, asset: str | None = None, variant: str | None = None) -> DataFrame:
    """One row an archive: pages summed over members, missing ones as 0, against the owner's quota."""
    pages = members.groupBy(archive, key).agg(F.sum(F.coalesce("pages", F.lit(0))).cast("long").alias("pages"))
    return gate(pages, quotas, key, F.col("pages"), asset, variant)


def usage_problem(user_id: Column, enrollment_id: Column, amount: Column) -> Column:
    """Why a usage record is rejected; null if it is not."""
    return F.when(user_id.isNull() & enrollment_id.isNull(), F.lit("no owner")).when(F.coalesce(amount, F.lit(0)) <= 0, F.lit("amount not positive"))


def net_usage(usage: DataFrame, cancelled: DataFrame) -> DataFrame:
    """Usage without cancelled records; a null id cancels nothing."""
    return usage.join(cancelled.where("usage_id IS NOT NULL").select("usage_id").distinct(), "usage_id", "left_anti")


def usage_totals(usage: DataFrame, *keys: str) -> DataFrame:
    return usage.groupBy(*keys).agg(F.sum("amount").cast(DECIMAL).alias("amount"), F.count("*").alias("n"))
