from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from batchloom.errors import ConfigError, ReconciliationError, ValidationError
from batchloom.operators import config, reconcile, rules
from batchloom.operators.tenancy import visible

STATES = "tenant_scope string, endpoint_alias string, remote_batch_id string, last_observed_at timestamp, batch_status string"


def states(spark, rows):
    at = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    return spark.createDataFrame([(t, a, b, at + dt.timedelta(seconds=s), st) for t, a, b, s, st in rows], STATES)


def test_candidates_are_the_oldest_of_the_tenant(spark):
    s = states(spark, [("a", "gw", "2", 5, "completed"), ("a", "gw", "1", 5, "in_progress"), ("a", "fw", "3", 5, "x"), ("b", "gw", "4", 0, "x"), ("a", "gw", "5", 1, "x")])
    assert [r.remote_batch_id for r in reconcile.candidates(s, "a", 3).collect()] == ["5", "3", "1"]
    assert reconcile.candidates(s, None).count() == visible(s, "").count() == 0
    for bad in (0, 401, True):
        with pytest.raises(ValidationError):
            reconcile.candidates(s, "a", bad)


def test_unique_prefix(spark):
    rows = lambda ids: spark.createDataFrame([(i, "gw", x) for i, x in enumerate(ids)], "position long, endpoint_alias string, remote_batch_id string")
    assert [r.remote_batch_id for r in reconcile.unique_prefix(rows("aabc"), 2).orderBy("position").collect()] == ["a", "b"]
    with pytest.raises(ReconciliationError):
        reconcile.unique_prefix(rows("a" * 400 + "b"), 2)
    assert reconcile.unique_prefix(rows("a" * 400), 2).count() == 1


def test_outcomes_and_report(spark):
    s = states(spark, [("t", "gw", "a", 0, "completed"), ("t", "gw", "b", 0, "in_progress"), ("t", "gw", "c", 0, "failed")])
    chosen = spark.createDataFrame([(i, "gw", x) for i, x in enumerate("abcd")], "position long, endpoint_alias string, remote_batch_id string")
    got = reconcile.outcomes(chosen, s, s.where("remote_batch_id = 'a'"))
    assert [r.outcome for r in got.orderBy("position").collect()] == ["retrieved", "polled", "deferred", "failed"]
    assert tuple(reconcile.report(got).first()) == (4, 1, 1)


def test_single_flight(spark):
    c = spark.createDataFrame([(2, "w2", "t", "gw", "a"), (1, "w1", "t", "gw", "a"), (3, "w2", "t", "gw", "b")], "claim_order long, worker string, tenant_scope string, endpoint_alias string, remote_batch_id string")
    got = reconcile.single_flight(c).orderBy("claim_order").collect()
    assert [r.holds for r in got] == [True, False, True]
    assert got[0].flight_key == got[1].flight_key != got[2].flight_key


def test_typed_settings(spark):
    tree = {"a": {"flag": False, "n": 3, "x": 1.5, "tree": {"k": 1}, "text": "t"}}
    stored = spark.createDataFrame([("a.flag", "YES"), ("a.n", "four"), ("a.x", "2.5"), ("a.tree", "{bad"), ("a.text", "own"), ("alone", "v"), ("a.b.c", "deep")], "config_key string, config_value string")
    got = {r.config_key: (r.category, r.name, r.value) for r in config.typed(stored, tree).collect()}
    assert got == {"a.flag": ("a", "flag", "true"), "a.n": ("a", "n", "3"), "a.x": ("a", "x", "2.5"), "a.tree": ("a", "tree", '{"k": 1}'), "a.text": ("a", "text", "own"), "alone": ("global", "alone", "v"), "a.b.c": ("a", "b.c", "deep")}
    fresh = spark.createDataFrame([("alone", "new"), ("more", "1")], "config_key string, config_value string")
    assert {r.config_key: r.config_value for r in config.seeded(stored, fresh).collect()}["alone"] == "v"


def test_secrets(spark):
    s = spark.createDataFrame([("gateway_api_key.gw", "k1")], "secret_key string, secret_value string")
    sealed = config.stored_secrets(s, b"0" * 16)
    assert sealed.first().secret_value != "k1" and sealed.first().is_encrypted
    clear = config.clear_secrets(sealed, b"0" * 16)
    assert config.require_secret(clear, "gateway_api_key.gw") == "k1"
    for other in (config.clear_secrets(sealed), config.clear_secrets(sealed, b"1" * 16)):
        with pytest.raises(ConfigError):
            config.require_secret(other, "gateway_api_key.gw")
    settings = config.typed(spark.createDataFrame([("gateway_url.gw", "https://own"), ("gateway.base_url", "https://all")], "config_key string, config_value string"))
    assert config.gateway(settings, clear, "gw") == ("https://own", "k1")
    assert config.gateway(settings, clear, "other") == ("https://all", None)


def test_rules(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (2, None, 3), (3, "z", None), (3, None, 9)], "k int, s string, p int")
    assert {(r.value, r.n) for r in rules.outside(df, "s", ("a",)).collect()} == {(None, 2), ("z", 1)}
    assert [(r.k, r.s, r.n) for r in rules.repeated(df, ["k", "s"]).collect()] == [(1, "a", 2)]
    parents = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    assert [r.p for r in rules.orphans(df, "p", parents, "id").collect()] == [9]
    assert {r.rule: r.n for r in rules.violations(df, {"small": F.col("p") < 3, "fine": F.lit(True)}).collect()} == {"small": 2, "fine": 0}


def test_health(spark):
    c = spark.createDataFrame([("a", True), ("b", True), ("b", True), ("c", None), ("other", False)], "component string, is_ready boolean")
    r = rules.health_report(c, ("a", "b", "c", "d")).first()
    assert (r.ready, r.missing, r.repeated, r.not_ready) == (False, ["d"], ["b"], ["b", "c", "d"])
    assert rules.health_report(c, ("a",)).first().ready


def test_manifest(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"abc")
    m = rules.manifest(spark, str(tmp_path))
    assert m.first().sha256.startswith("ba7816bf") and rules.same_manifest(m, m)
    assert not rules.same_manifest(m, m.limit(0))
    with pytest.raises(Exception, match="size bound"):
        rules.manifest(spark, str(tmp_path), 2).collect()
