"""Rules found by an index of their text: agents, host matchers, referrers with paths."""

import random
import re

import pytest
from pyspark.sql import functions as F
from tests.conftest import plan_of

from pagetally.functions import agents as builtin
from pagetally.functions.literals import ascii_lower, pieces, required_literal
from pagetally.operators import agents, literal_index, run_index
from pagetally.operators import lookups as lk
from pagetally.operators import registry as reg
from tests.test_functions import AGENTS

PATTERNS = {
    "^www[.]": "www", r"example\.org": "example.org", "(?i)GoogleBot": "googlebot", "a|bcd": "", "colou?red": "colo", "ab+cde": "cde",
    "x{2}yzz": "yzz", "(foo)+barr": "barr", "((((deep))))tail": "", r"\(abc": "abc", r"Chrome/(\d+)": "chrome/", "": "",
    r"\x41bcd": "", "[a[b]]cde": "", "(?s)abc": "", "foo.*barbaz": "barbaz", r"a\|bcd": "", "ab*?cde": "cde", "one.two+?three": "three",
}


def test_required_literals(spark):
    rows = spark.createDataFrame([(p,) for p in [*PATTERNS, None]], "p string")
    got = dict(rows.select("p", required_literal(F.col("p"))).collect())
    assert got == {**PATTERNS, None: ""}


def test_required_literals_are_in_every_match(spark):
    draw = random.Random(3)
    atoms = ["a", "B", "cd", r"\.", "[ab]", "x?", "y+", "z*", "(e|f)", "(gh)", ".", "k{1,2}", "-", r"\d"]
    patterns = ["".join(draw.choices(atoms, k=draw.randint(1, 7))) for _ in range(150)]
    texts = ["".join(draw.choices("aBcdxyzefghk.-1", k=draw.randint(1, 14))) for _ in range(300)]
    rows = spark.createDataFrame([(p,) for p in set(patterns)], "p string")
    for p, literal in rows.select("p", required_literal(F.col("p"))).collect():
        assert all(literal in t.lower() for t in texts if re.search(p, t))


def test_pieces(spark):
    rows = spark.createDataFrame([("abcabC",), ("ab",), ("é😀x",), (None,)], "t string")
    assert [r[0] and sorted(r[0]) for r in rows.select(pieces(F.col("t"))).collect()] == [["abc", "bca", "cab"], [], ["é😀x"], None]


def test_rare_pieces_tell_rules_apart(spark):
    rules = spark.createDataFrame([("s", f"tenant{i}.example.com") for i in range(300)] + [("t", "ab"), ("t", "")], "site string, value string")
    found = literal_index.with_piece(rules, F.col("value"), ["site"])
    assert found.count() == 302 and found.where("piece in ('exa', 'ten', 'com')").count() == 0
    assert {r.piece for r in found.where("site = 't'").collect()} == {""}
    local = literal_index.local_pieces([f"tenant{i}.example.com" for i in range(300)] + ["ab"])
    assert local == [r.piece for r in found.where("site = 's'").collect()] + [""] or local[-1] == ""


def test_builtin_rules_equal_their_expressions(spark):
    texts = [*AGENTS, "Googlebot/2.1", "my-CRAWLER", "HeadlessChrome/1", "curl/8.0", "x" * 5000, "", "Opera/9.80 (X11) Version/12.1", None]
    rows = spark.createDataFrame([(t,) for t in [*texts, *texts]], "user_agent string")
    got = {tuple(r) for r in agents.agent_columns(rows).select("user_agent", *agents.AGENT_COLUMNS, "bot_agent").collect()}
    a = F.col("user_agent")
    columns = builtin.browser(a), builtin.browser_version(a), builtin.operating_system(a), builtin.operating_system_version(a)
    want = rows.select("user_agent", *columns, F.coalesce(builtin.is_bot(a), F.lit(False)))
    assert got == {tuple(r) for r in want.collect()} and agents.agent_columns(rows).count() == len(rows.collect())


def test_agent_rules_that_cannot_be_used(spark):
    rules = agents.rule_table(spark, [
        {"kind": "browser", "position": 2, "literal": "Late", "family": "late", "version": "(broken"},
        {"kind": "browser", "position": 1, "pattern": "(broken", "family": "broken"},
        {"kind": "browser", "position": 0, "family": "nothing to find it by"},
        {"kind": "system", "position": 0, "pattern": "^..$", "family": "two letters", "version": "(.)$"},
        {"kind": "other", "position": 0, "literal": "Late", "family": "no such kind"},
    ]).drop("piece")
    rows = spark.createDataFrame([("Late 1",), ("ab",), ("none of it",)], "user_agent string")
    got = {r.user_agent: r for r in agents.agent_columns(rows, rules).collect()}
    assert got["Late 1"].browser == "late" and got["Late 1"].browser_version is None
    assert (got["ab"].operating_system, got["ab"].operating_system_version) == ("two letters", "b")
    assert got["none of it"].browser is None and not any(r.bot_agent for r in got.values())


def test_rows_carry_no_rule_chain(spark):
    """Agents are read where they are distinct; the rows only join them."""
    rows = spark.range(10).select(F.lit("Chrome/1").alias("user_agent"), "id")
    plan = plan_of(agents.agent_columns(rows))
    assert "CASE WHEN Contains(user_agent" not in plan and "Python" not in plan and "Cartesian" not in plan


def test_agents_meet_few_of_many_rules(spark):
    """2,000 agents and 20,000 rules that differ in a number only: each agent is tested by a few."""
    n = F.col("id").cast("string")
    rules = spark.range(20_000).select(
        F.lit("browser").alias("kind"), F.col("id").cast("int").alias("position"), F.concat(F.lit("App"), n, F.lit("/")).alias("literal"),
        F.lit(None).cast("string").alias("pattern"), n.alias("family"), F.lit(None).cast("string").alias("version"))
    bots = rules.select(F.lit("bot").alias("kind"), "position", F.lit(None).cast("string").alias("literal"),
        F.concat(F.lit("(?i)fetch-"), "family", F.lit("-")).alias("pattern"), "family", "version")
    seen = spark.range(2_000).select(F.concat(F.lit("Mozilla/5.0 (X) App"), (F.col("id") * 10).cast("string"), F.lit("/1.2 FETCH-"), n, F.lit("-x")).alias("user_agent"))
    table = rules.unionByName(bots)
    found = run_index.found_rules(seen, "user_agent", agents.indexed_rules(table))
    assert found.count() < 20 * 2_000
    told = agents.agent_table(seen, table).select(F.col("browser") == F.regexp_extract("user_agent", "App([0-9]+)/", 1), "is_bot").collect()
    assert len(told) == 2_000 and all(all(r) for r in told)


def test_runs_find_what_contains_finds(spark):
    """A literal that a text contains shares a key with it, whatever stands around and in it."""
    draw = random.Random(5)
    atoms = ["a", "B", "7", "xy", "Zz", "é", "Ж", "/", "-", " ", ".", "_", "\n", "q" * 40]
    texts = ["".join(draw.choices(atoms, k=draw.randint(0, 12))) for _ in range(200)]
    cuts = [(t, *sorted(draw.choices(range(len(t) + 1), k=2))) for t in texts for _ in range(4)]
    rows = spark.createDataFrame([(t, t[a:b]) for t, a, b in cuts], "t string, l string")
    rules = rows.select("l").distinct()
    got = run_index.found_rules(rows.select("t").distinct(), "t", run_index.with_key(rules, ascii_lower(F.col("l"))))
    found = {(r.t, r.l) for r in got.collect()}
    assert all((t, t[a:b]) in found for t, a, b in cuts)


KINDS = "exact", "wildcard", "regex"


def matchers_and_hosts(n_matchers, n_hosts, seed=1):
    draw = random.Random(seed)
    names = ["alpha", "beta", "shop", "www", "a", "example", "x-1", "com", "org", "co.uk"]
    def host():
        return ".".join(draw.choices(names, k=draw.randint(1, 5)))

    def matcher():
        kind = draw.choice(KINDS)
        value = host()
        if kind == "wildcard":
            value = ".".join("*" if draw.random() < 0.3 else label for label in value.split("."))
        if kind == "regex":
            value = draw.choice(["^" + value, value + "$", "alpha|beta", "(broken", "[.]co", "sh?op", value.replace("a", ".")])
        return kind, value

    return [("s", *matcher()) for _ in range(n_matchers)], [("s", host()) for _ in range(n_hosts)]


@pytest.mark.parametrize("mode", ["reference", "strict"])
def test_index_finds_what_all_pairs_find(spark, mode):
    matchers, hosts = matchers_and_hosts(120, 400)
    m = spark.createDataFrame(matchers, "service_id string, type string, value string")
    pairs = spark.createDataFrame(hosts, "service_id string, namespace string").distinct()
    got = reg.matcher_candidates(pairs, m, ["service_id"], mode).where(reg.accepts(mode)).select("namespace", "type", "value")
    patterns = reg.compile_matchers(m, mode).where("pattern is not null").drop("service_id")
    want = pairs.crossJoin(patterns).where(reg.accepts(mode)).select("namespace", "type", "value")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}


@pytest.mark.parametrize("mode", ["reference", "strict"])
def test_a_large_site_tests_few_of_its_pairs(spark, mode):
    """100,000 hosts and 10,000 matchers of one site: below one pair in a hundred."""
    i = F.col("id").cast("string")
    value = F.when(F.col("id") % 3 == 0, F.concat(F.lit("*.tenant-"), i, F.lit(".example.com"))).when(
        F.col("id") % 3 == 1, F.concat(F.lit("shop"), i, F.lit(".example.com"))
    ).otherwise(F.concat(F.lit("^blog-"), i, F.lit("[.]example")))
    kind = F.element_at(F.array(F.lit("wildcard"), F.lit("exact"), F.lit("regex")), (F.col("id") % 3 + 1).cast("int"))
    matchers = spark.range(10_000).select(F.lit("s").alias("service_id"), kind.alias("type"), value.alias("value"))
    j = (F.col("id") % 20_000).cast("string")
    start = F.element_at(F.array(*map(F.lit, ["a.tenant-", "shop", "blog-", "www.tenant-", "other"])), (F.col("id") / 20_000 + 1).cast("int"))
    hosts = spark.range(100_000).select(F.lit("s").alias("service_id"), F.concat(start, j, F.lit(".example.com")).alias("namespace"))
    found = reg.matcher_candidates(hosts, matchers, ["service_id"], mode)
    assert found.count() < 0.01 * 100_000 * 10_000
    accepted = found.where(reg.accepts(mode)).select("namespace").distinct()
    # every third id of the first 10,000 has a matcher of each kind
    assert accepted.count() == 2 * 3334 + 3333 + 3333


def test_path_rules(spark):
    rules = spark.createDataFrame(
        [("example.org", "all"), ("example.org/shop", "shop"), ("example.org/shop/a/", "a"), ("www.example.org/x", "x"), ("b.org/only", "only"),
         ("example.org/shop", "zz"), (None, "none"), ("/rooted", "no host")], "host string, source string")
    places = {
        ("example.org", None): "all", ("example.org", "/"): "all", ("example.org", "/shopping"): "all", ("example.org", "/shop"): "shop",
        ("sub.example.org", "/shop/b"): "shop", ("example.org", "/shop/a/b/c"): "a", ("www.example.org", "/x/1"): "x",
        ("www.example.org", "/shop"): "shop", ("b.org", "/"): None, ("b.org", "/only/1"): "only", (None, "/shop"): None, ("", "/rooted"): "no host",
        ("example.org", "//shop//a"): "a",
    }
    rows = spark.createDataFrame(list(places), "h string, p string")
    got = lk.with_referrer_source(rows, F.col("h"), rules, F.col("p")).collect()
    assert {(r.h, r.p): r.referrer_source for r in got} == places and len(got) == len(places)
    # host-only rules read no path
    alone = lk.with_referrer_source(rows, F.col("h"), rules.where("host = 'example.org'"), F.col("p")).collect()
    assert {r.referrer_source for r in alone if r.h and r.h.endswith("example.org")} == {"all"}
