"""Typed settings over stored text, and secrets."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError, ValidationError
from ..sources.store import Merge, Store, upsert

# Fixed default settings.
DEFAULTS: dict[str, dict[str, object]] = {
    "batch_size": {"min": 100, "default": 50_000, "max": 50_000},
    "token_limits": {"per_batch": 5_000_000_000, "per_request": 128_000, "buffer_percentage": 5},
    "azure_limits": {"max_records_per_file": 100_000, "max_bytes_per_file": 209_715_200, "max_files_per_job": 500},
    "optimization": {"auto_split": True, "smart_batching": True},
}
TRUE, FALSE = ("true", "1", "yes", "on"), ("false", "0", "no", "off")


def defaults(spark, tree: dict[str, dict[str, object]] = DEFAULTS) -> DataFrame:  # noqa: ANN001
    """(config_key, kind, default_value): types come from the tree, never from what is stored."""
    rows = [(f"{c}.{k}", "bool" if isinstance(v, bool) else "int" if isinstance(v, int) else "float" if isinstance(v, float) else "json" if isinstance(v, dict | list) else "text", json.dumps(v) if not isinstance(v, str) else v) for c, t in tree.items() for k, v in t.items()]
    return spark.createDataFrame(rows, "config_key string, kind string, default_value string")


def typed(stored: DataFrame, tree: dict[str, dict[str, object]] = DEFAULTS) -> DataFrame:
    """All settings by key with category, name, value (as text) and whether it is stored; a bad value gives the default."""
    d = defaults(stored.sparkSession, tree)
    s = stored.select(F.col("config_key").alias("k_"), F.col("config_value").alias("v_"))
    v = F.lower("v_")
    value = (
        F.when(F.col("kind") == "bool", F.when(v.isin(*TRUE), "true").when(v.isin(*FALSE), "false"))
        .when(F.col("kind") == "int", F.trim("v_").try_cast("long").cast("string"))
        .when(F.col("kind") == "float", F.trim("v_").try_cast("double").cast("string"))
        .when(F.col("kind") == "json", F.when(F.try_parse_json("v_").isNotNull(), F.col("v_")))
        .otherwise(F.col("v_"))
    )
    both = d.join(s, F.col("config_key") == F.col("k_"), "full").withColumn("key_", F.coalesce("config_key", "k_"))
    dot = F.instr("key_", ".")
    return both.select(
        F.col("key_").alias("config_key"),
        F.when(dot > 0, F.substring_index("key_", ".", 1)).otherwise("global").alias("category"),
        F.when(dot > 0, F.expr("substring(key_, instr(key_, '.') + 1)")).otherwise(F.col("key_")).alias("name"),
        F.coalesce(value, "default_value").alias("value"),
        F.col("k_").isNotNull().alias("is_stored"),
    ).orderBy("config_key")


def seeded(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored rows, and of the fresh ones those with a new key."""
    return stored.unionByName(fresh.join(stored, "config_key", "left_anti"))


def upserted(changes: DataFrame) -> DataFrame:
    """(config_key, config_value, change) -> each key's value by its last change."""
    return changes.groupBy("config_key").agg(F.max_by("config_value", "change").alias("config_value"))


def effective_limit(settings: DataFrame) -> DataFrame:
    """Typed settings -> (per_batch, effective_limit), one row: a batch's stored token limit, and what its buffer leaves of it."""
    value = lambda name: F.max(F.when(F.col("config_key") == f"token_limits.{name}", F.col("value").cast("long")))
    found = settings.agg(value("per_batch").alias("per_batch"), value("buffer_percentage").alias("buffer_"))
    return found.select("per_batch", F.expr("per_batch * (100 - buffer_) DIV 100").alias("effective_limit"))


STORED = "config_key string, config_value string"


def put(store: Store, changes: DataFrame, table: str = "com_config", tree: dict[str, dict[str, object]] = DEFAULTS) -> None:
    """Write (config_key, config_value) settings to a stored table in the form that reading gives: bools as true or false, numbers
    without blanks, a bad value as its default. A key that comes twice, or is null, is an error and nothing is written."""
    store.create(table, STORED, ["config_key"], buckets=8)
    if changes.where("config_key IS NULL").head() is not None:
        raise ValidationError("a setting has no key")
    canonical = typed(changes, tree).where("is_stored").select("config_key", F.col("value").alias("config_value"))
    store.merge({table: Merge(canonical, upsert(["config_key"]))})


def stored_secrets(secrets: DataFrame, key: bytes | None = None) -> DataFrame:
    """(secret_key, secret_value in clear) -> stored: encrypted under a 16, 24 or 32 byte key, else base64."""
    value = F.base64(F.aes_encrypt(F.col("secret_value").cast("binary"), F.lit(bytearray(key)))) if key else F.base64(F.col("secret_value").cast("binary"))
    return secrets.select("secret_key", value.alias("secret_value"), F.lit(bool(key)).alias("is_encrypted"))


def clear_secrets(stored: DataFrame, key: bytes | None = None) -> DataFrame:
    """Secrets in clear; null where the key is missing or wrong."""
    raw = F.unbase64("secret_value")
    opened = F.try_aes_decrypt(raw, F.lit(bytearray(key))) if key else F.lit(None).cast("binary")
    return stored.select("secret_key", F.when(F.col("is_encrypted"), opened).otherwise(raw).cast("string").alias("secret_value"))


def require_secret(clear: DataFrame, name: str) -> str:
    row = clear.where(F.col("secret_key") == name).head()
    if row is None or row["secret_value"] is None:
        raise ConfigError("secret is missing", name=name)
    return row["secret_value"]


def gateway(settings: DataFrame, secrets: DataFrame, alias: str) -> tuple[str | None, str | None]:
    """The alias's own URL, else the common one, and the alias's key."""
    found = {r.config_key: r.value for r in settings.where(F.col("config_key").isin(f"gateway_url.{alias}", "gateway.base_url")).collect()}
    key = secrets.where(F.col("secret_key") == f"gateway_api_key.{alias}").head()
    return found.get(f"gateway_url.{alias}") or found.get("gateway.base_url"), key and key["secret_value"]
