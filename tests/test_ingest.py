import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from tests.conftest import plan_of, rows_of

from checks import fixtures as fx
from pagetally.model import BEACON_SCHEMA, DIMENSIONS
from pagetally.operators import ingest as ing
from pagetally.operators import lookups as lk
from pagetally.operators import registry as reg
from pagetally.sources import beacons as beacons_source

CHROME = "Mozilla/5.0 (Windows NT 10.0) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Safari/537.36"


def small_registry(spark, matchers):
    services = spark.createDataFrame([("a", "A", True), ("hidden", "H", False), ("bare", "B", True)],
                                     "service_id string, name string, published boolean")
    rows = [(f"m{i}", s, t, v) for i, (s, t, v) in enumerate(matchers)]
    return reg.Registry(services, spark.createDataFrame(rows, "matcher_id string, service_id string, type string, value string"))


REGISTRY = [("a", "exact", "example.org"), ("hidden", "regex", ".*"), ("a", "regex", "(broken")]


def beacon(**fields):
    base = dict(beacon_id=1, instance="main", received_at=datetime(2024, 1, 1, 10, 0, 0, 999999), user_agent=CHROME,
                b="0", p="/x", q=None, r=None, o="https://www.example.org", i="a", z=None)
    base.update(fields)
    return tuple(base[name] for name in BEACON_SCHEMA.names)


def reason(spark, **fields):
    beacons = spark.createDataFrame([beacon(**fields)], BEACON_SCHEMA)
    return ing.ingest(beacons, small_registry(spark, REGISTRY), fx.lookups(spark)).first()


@pytest.mark.parametrize(
    "fields, want",
    [
        ({}, None),
        ({"b": None}, None),
        ({"b": "  "}, None),
        ({"b": "yes"}, "invalid_params"),
        ({"b": "150", "user_agent": None}, "invalid_params"),
        ({"b": "true"}, "is_bot"),
        ({"b": "1", "user_agent": None}, "is_bot"),
        ({"user_agent": None}, "missing_user_agent"),
        ({"user_agent": "Googlebot", "o": "https://spam-farm.example.org"}, "is_bot"),
        ({"o": "https://spam-farm.example.org", "i": "nobody"}, "spam_host"),
        ({"o": None, "i": "nobody"}, "no_origin"),
        ({"o": "", "i": "a"}, "no_origin"),
        ({"i": "nobody"}, "service_not_found"),
        ({"i": None}, "service_not_found"),
        ({"i": "bare"}, "no_pattern_match"),
        ({"o": "https://example.com"}, "no_pattern_match"),
        ({"i": "hidden", "o": "https://any.host"}, None),
        ({"o": "https://my-example.org.evil"}, None),
        ({"p": "?x"}, "invalid_path"),
        ({"p": None}, None),
    ],
)
def test_reason(spark, fields, want):
    assert reason(spark, **fields)["reason"] == want


def test_columns_of_an_accepted_beacon(spark):
    row = reason(spark, p="page?x#y", q="?utm_source=a&utm_source=b+c&utm_medium", r="https://mail.google.com/x", z="Europe/Paris")
    assert row["timestamp"] == datetime(2024, 1, 1, 10, 0, 0)
    assert {d: row[d] for d in DIMENSIONS} == {
        "namespace": "www.example.org", "path": "/page", "referrer": "mail.google.com", "referrer_source": "Gmail",
        "utm_medium": "", "utm_source": "b+c", "utm_campaign": None, "utm_content": None, "country_code": "FR",
        "operating_system": "Windows", "operating_system_version": "10.0", "browser": "Chrome",
        "browser_version": "120.0.0.0",
    }


def test_blank_properties(spark):
    beacons = spark.createDataFrame([beacon(q="utm_medium")], BEACON_SCHEMA)
    rows = ing.ingest(beacons, small_registry(spark, REGISTRY), fx.lookups(spark))
    assert ing.to_events(rows).first()["properties"]["utm_medium"] is None
    assert ing.to_events(rows, blank_as_null=False).first()["properties"]["utm_medium"] == ""


def test_accepted_and_rejected_make_the_input(spark):
    sf_dir = "/root/testdata/sf0.01"  # the smallest set with listed spam hosts, hence with every reason
    beacons = fx.beacons(spark, sf_dir)
    rows = ing.ingest(beacons, fx.registry(spark, sf_dir), fx.lookups(spark))
    n_accepted, n_rejected = ing.accepted(rows).count(), ing.rejected(rows, beacons.columns).count()
    assert n_accepted > 0 and n_rejected > 0 and n_accepted + n_rejected == beacons.count()
    counted = {r["reason"]: r["count"] for r in ing.reject_counts(rows).collect()}
    assert sum(counted.values()) == n_rejected and set(counted) == set(ing.REASONS) - {"missing_instance"}


def test_joins_agree(spark, sf_dir):
    """Without any broadcast of lookups the same rows come out."""
    args = fx.beacons(spark, sf_dir), fx.registry(spark, sf_dir), fx.lookups(spark)
    want = rows_of(ing.ingest(*args))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert want == rows_of(ing.ingest(*args))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_plan_is_joins_and_projections_only(spark, sf_dir):
    rows = ing.ingest(fx.beacons(spark, sf_dir), fx.registry(spark, sf_dir), fx.lookups(spark))
    plan = plan_of(rows)
    for word in ("Python", "Cartesian", "NestedLoop", "Window ("):
        assert word not in plan


def test_one_plan_for_every_registry_size(spark, sf_dir):
    """Twenty or 200,000 matchers: the same operators, and no job before the result is asked for."""
    tracker = spark.sparkContext.statusTracker()
    beacons, lookups = fx.beacons(spark, sf_dir), fx.lookups(spark)
    plans = []
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.sparkContext.setJobGroup("building", "no job expected")
    try:
        for n in (20, 200_000):
            ids = spark.range(n).select(F.concat(F.lit("svc-"), F.col("id").cast("string")).alias("service_id"))
            services = ids.select("service_id", F.col("service_id").alias("name"), F.lit(True).alias("published"))
            matchers = ids.select(
                F.col("service_id").alias("matcher_id"), "service_id", F.lit("exact").alias("type"), F.lit("example").alias("value")
            )
            rows = ing.ingest(beacons, reg.Registry(services, matchers), lookups)
            plans.append(re.findall(r"^\([0-9]+\) (\w+)", plan_of(rows), re.M))
        assert plans[0] == plans[1]
        assert list(tracker.getJobIdsForGroup("building")) == []
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("mode", ["reference", "strict"])
def test_matched_hosts_equal_patterns(spark, mode):
    kinds = [("exact", "example.org"), ("exact", "a.b"), ("wildcard", "*.example.com"), ("regex", "^www[.]"), ("regex", "(broken"), ("glob", "x")]
    rows = spark.createDataFrame([("s", h) for h in HOSTS + ["a.b", "xa.b.c"]], "service_id string, namespace string")
    for kind, value in kinds:
        services = spark.createDataFrame([("s", "s", True)], "service_id string, name string, published boolean")
        matchers = spark.createDataFrame([("m", "s", kind, value)], "matcher_id string, service_id string, type string, value string")
        got = {r["namespace"] for r in ing.matched_hosts(rows, reg.Registry(services, matchers), mode).collect()}
        tested = rows.select("namespace", F.regexp_like("namespace", reg.matcher_pattern(F.lit(kind), F.lit(value), mode)).alias("m"))
        assert got == {r["namespace"] for r in tested.collect() if r["m"]}


def test_missing_instance_and_broken_text(spark):
    rows = ing.ingest(spark.createDataFrame([beacon(instance=None)], BEACON_SCHEMA), small_registry(spark, REGISTRY), fx.lookups(spark))
    assert rows.first()["reason"] == "missing_instance"
    texts = ['{"beacon_id": 1, "o": "http://www.example.org"}', "{broken", "", None, "[1]", '{"beacon_id": "x"}']
    messages = spark.createDataFrame([(t, "agent") for t in texts], "value string, header string")
    read = beacons_source.from_messages(messages, user_agent=F.col("header"), instance=F.lit("main"))
    found = ing.ingest(read, small_registry(spark, REGISTRY), fx.lookups(spark)).collect()
    assert [r["broken"] for r in found][1:5] == ["{broken", "", "", "[1]"] and found[0]["broken"] is None
    assert [r["reason"] == "invalid_params" for r in found] == [False, True, True, True, True, True]
    assert {r["user_agent"] for r in found} == {"agent"} and {r["instance"] for r in found} == {"main"}


def test_generated_code_can_be_compiled(spark, sf_dir, tmp_path):
    """The JVM does not compile methods above 8000 bytes; one that large runs several times slower."""
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
    fx.beacons(spark, sf_dir).write.parquet(str(tmp_path / "beacons"))
    beacons = spark.read.parquet(str(tmp_path / "beacons"))
    args = beacons, fx.registry(spark, sf_dir), fx.lookups(spark)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = ing.ingest(*args)
        for frame in (rows, ing.to_events(rows), ing.rejected(rows, args[0].columns)):
            text = frame._jdf.queryExecution().explainString(mode)
            sizes = [int(n) for n in re.findall("maxMethodCodeSize:([0-9]+)", text)]
            assert sizes and max(sizes) < 8000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_drop_local(spark):
    beacons = spark.createDataFrame([beacon(o="http://localhost:4000"), beacon(o="http://10.0.0.7"), beacon()], BEACON_SCHEMA)
    rows = ing.ingest(beacons, small_registry(spark, REGISTRY), fx.lookups(spark), drop_local=True)
    assert [r["namespace"] for r in rows.collect()] == ["www.example.org"]


def test_duplicate_lookups_do_not_multiply(spark):
    looks = fx.lookups(spark)
    doubled = lk.Lookups(looks.spam_hosts.union(looks.spam_hosts), looks.zones.union(looks.zones), looks.sources.union(looks.sources))
    beacons = spark.createDataFrame([beacon(z="Europe/Paris", r="https://t.co/x")], BEACON_SCHEMA)
    rows = ing.ingest(beacons, small_registry(spark, REGISTRY), doubled).collect()
    assert len(rows) == 1 and rows[0]["referrer_source"] == "Twitter"


def test_registry_per_tenant(spark):
    services = spark.createDataFrame([("main", "a", "A", True)], "instance string, service_id string, name string, published boolean")
    matchers = spark.createDataFrame([("main", "m", "a", "regex", ".*")],
                                     "instance string, matcher_id string, service_id string, type string, value string")
    beacons = spark.createDataFrame([beacon(beacon_id=1), beacon(beacon_id=2, instance="acme")], BEACON_SCHEMA)
    rows = ing.ingest(beacons, reg.Registry(services, matchers), fx.lookups(spark))
    assert dict(rows_of(rows, "beacon_id", "reason")) == {1: None, 2: "service_not_found"}


HOSTS = ["example.org", "www.example.org", "example-org", "xexampleyorg", "a.b.example.com", "-a.b.example.com",
         "a.example.com", "a.b.c.example.com", "aaXexample.com", f"{'x' * 63}.b.example.com", f"{'x' * 64}.b.example.com"]


@pytest.mark.parametrize(
    "kind, value, mode, pattern",
    [
        ("exact", "example.org", "reference", re.escape("example.org")),
        ("exact", "example.org", "strict", "^" + re.escape("example.org") + "$"),
        ("wildcard", "*.*.example.com", "reference", "^(?!-)[A-Za-z0-9-]{1,63}(?<!-).(?!-)[A-Za-z0-9-]{1,63}(?<!-).example.com$"),
        ("wildcard", "*.*.example.com", "strict", "^(?!-)[A-Za-z0-9-]{1,63}(?<!-)[.](?!-)[A-Za-z0-9-]{1,63}(?<!-)[.]example[.]com$"),
        ("regex", "^www[.]", "reference", "^www[.]"),
        ("regex", "(broken", "reference", None),
        ("glob", "*", "reference", None),
    ],
)
def test_matcher_patterns(spark, kind, value, mode, pattern):
    rows = spark.createDataFrame([(h, kind, value) for h in HOSTS], "host string, type string, value string")
    found = rows.select("host", F.regexp_like("host", reg.matcher_pattern(F.col("type"), F.col("value"), mode)).alias("m"))
    want = {h: bool(re.search(pattern, h)) if pattern else None for h in HOSTS}
    assert {r["host"]: r["m"] for r in found.collect()} == want


def test_referrer_source_takes_the_longest_rule(spark):
    rules = spark.createDataFrame([("example.com", "short"), ("news.example.com", "long"), ("com", "top")], "host string, source string")
    hosts = ["example.com", "a.news.example.com", "xexample.com", "other.org", None]
    rows = spark.createDataFrame([(h,) for h in hosts], "h string")
    got = {r["h"]: r["referrer_source"] for r in lk.with_referrer_source(rows, F.col("h"), rules).collect()}
    assert got == {"example.com": "short", "a.news.example.com": "long", "xexample.com": "top", "other.org": None, None: None}


def test_no_source_rules(spark):
    empty = spark.createDataFrame([], "host string, source string")
    rows = spark.createDataFrame([("a.b",)], "h string")
    assert lk.with_referrer_source(rows, F.col("h"), empty).first()["referrer_source"] is None
