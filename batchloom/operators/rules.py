"""Data quality: constraints as queries for what breaks them; health; file manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import digests


def outside(df: DataFrame, column: str, allowed: tuple[str, ...]) -> DataFrame:
    """Values that are not allowed, null among them, and how often."""
    return df.where(~F.coalesce(F.col(column).isin(*allowed), F.lit(False))).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are there more than once; a null in a key is no value and can't repeat."""
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(df: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose key has no parent; a null key needs none."""
    p = parents.select(F.col(parent_key).alias("p_"))
    return df.where(F.col(key).isNotNull()).join(p, F.col(key) == F.col("p_"), "left_anti")


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n) for each rule: rows where it doesn't hold; null holds, as in a CHECK."""
    counts = df.agg(*(F.count_if(~F.coalesce(c, F.lit(True))).alias(n) for n, c in rules.items()))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("n")) for n in rules))).alias("x")).select("x.*")


def backfilled(states: DataFrame, default_tenant: str) -> DataFrame:
    """Old rows brought up: a tenant where there is none, a total that is known if it is positive."""
    return states.withColumns({"tenant_scope": F.coalesce("tenant_scope", F.lit(default_tenant)), "total_requests_known": F.coalesce("total_requests_known", F.col("total_requests") > 0)})


def health(components: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """(component, is_ready) -> a row per required component: how often it reported, and whether it is ready: once, and ready."""
    spark: SparkSession = components.sparkSession
    need = spark.createDataFrame([(c,) for c in required], "component string")
    seen = components.groupBy("component").agg(F.count("*").alias("n"), F.every(F.coalesce("is_ready", F.lit(False))).alias("all_ready"))
    return need.join(seen, "component", "left").select("component", F.coalesce("n", F.lit(0)).alias("reports"), ((F.coalesce("n", F.lit(0)) == 1) & F.coalesce("all_ready", F.lit(False))).alias("is_ready"))


def health_report(components: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """One row: ready, and the names that are missing, repeated or not ready, sorted."""
    h = health(components, required)
    names = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("component"))))
    return h.agg(F.every("is_ready").alias("ready"), names(F.col("reports") == 0).alias("missing"), names(F.col("reports") > 1).alias("repeated"), names(~F.col("is_ready")).alias("not_ready"))


def manifest(spark: SparkSession, path: str, max_bytes: int = digests.LARGEST) -> DataFrame:
    """(path, length, sha256) of the files in a folder, streamed; one above the bound, or that changes meanwhile, is an error."""
    return digests.whole(digests.listed(spark, path), max_bytes).select("path", "length", "sha256")


def same_manifest(a: DataFrame, b: DataFrame) -> bool:
    x, y = a.select("length", "sha256"), b.select("length", "sha256")
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()
