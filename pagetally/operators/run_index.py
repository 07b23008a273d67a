"""An index of rules by the runs of letters and digits in a text that whatever they match must contain.

Where a literal goes on behind a run or before it, the text's run ends or begins there too:
a rule is filed under the whole run, its end or its start, and only a literal that is a
single run without neighbours under three characters of it. Far more rules are told apart than
by three characters, and a text's runs are far fewer than its characters. Runs are looked up
where they are distinct. A rule without any run has the key '', which every text has too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetally.functions.literals import ascii_lower, pieces
from pagetally.operators.joins import join_on

# Runs: what stands between ASCII characters that are no letters or digits.
_RUN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"

# Characters of a run's start or end that count; whole runs count in full.
EDGE = 32


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), 0)


def _whole(run: Column) -> Column:
    return F.concat(F.lit("="), run)


def _start(run: Column, size: Column) -> Column:
    return F.concat(F.lit("<"), F.substr(run, F.lit(1), size))


def _end(run: Column, size: Column) -> Column:
    return F.concat(F.lit(">"), F.substr(run, F.length(run) - size + 1, size))


def _edge(run: Column) -> Column:
    return F.least(F.length(run), F.lit(EDGE))


def _inside(run: Column) -> Column:
    return F.transform(pieces(run), lambda piece: F.concat(F.lit("~"), piece))


def literal_keys(literal: Column) -> Column:
    """The keys that a literal in ``ascii_lower`` can be filed under; none for one without a run."""
    kinds = [
        F.transform(_all(literal, f"(?<={_GAP}){_RUN}(?={_GAP})"), _whole),
        F.transform(_all(literal, f"^{_RUN}(?={_GAP})"), lambda run: _end(run, _edge(run))),
        F.transform(_all(literal, f"(?<={_GAP}){_RUN}$"), lambda run: _start(run, _edge(run))),
        F.flatten(F.transform(_all(literal, rf"\A{_RUN}\z"), _inside)),
    ]
    return F.array_distinct(F.concat(*kinds))


def runs(text: Column) -> Column:
    """The distinct runs of a text, in ``ascii_lower``, and ''."""
    return F.array_distinct(F.concat(F.array(F.lit("")), _all(ascii_lower(text), _RUN)))


def run_keys(run: Column) -> Column:
    """All keys under which a rule can be filed that is found by this run of a text; '' for ''."""
    sizes = F.when(F.length(run) > 0, F.sequence(F.lit(1), _edge(run))).otherwise(F.array().cast("array<int>"))
    edges = [F.transform(sizes, lambda n: _start(run, n)), F.transform(sizes, lambda n: _end(run, n))]
    own = F.concat(F.array(_whole(run)), *edges, _inside(run))
    return F.when(run == "", F.array(F.lit(""))).otherwise(F.array_distinct(own))


def with_key(rules: DataFrame, literal: Column) -> DataFrame:
    """Rules with ``key``: of the keys of their literal the one that fewest rules have to choose from, '' without any.

    Only rules with a choice are counted.
    """
    own = rules.columns
    # in steps, so that the literal and its keys are found once; the number of keys is a generated
    # column, as a test of it would otherwise be moved down to the rules and find them again
    filed = rules.select("*", literal.alias("__literal")).select(*own, literal_keys(F.col("__literal")).alias("__keys"))
    filed = filed.withColumn("__keys", F.when(F.size("__keys") > 0, F.col("__keys")).otherwise(F.array(F.lit(""))))
    several = F.transform("__keys", lambda key: F.struct(key.alias("key"), (F.size("__keys") > 1).alias("__several")))
    spread = filed.select(*own, F.inline(several))
    sure = spread.where("not __several").drop("__several")
    spread = spread.where("__several").drop("__several")
    counted = spread.groupBy("key").agg(F.count(F.lit(1)).alias("__n"))
    # of equally rare ones the longest
    rarest = F.min(F.struct("__n", (-F.length("key")).alias("__long"), "key"))["key"]
    chosen = join_on(spread, counted, ["key"]).groupBy(*own).agg(rarest.alias("key"))
    return sure.unionByName(chosen)


def found_rules(texts: DataFrame, text: str, rules: DataFrame) -> DataFrame:
    """Distinct ``texts`` with each rule (``key`` and more) whose key one of their runs has; a pair may come twice."""
    told = texts.select(text, F.explode(runs(F.col(text))).alias("__run"))
    known = told.select("__run").distinct().select("__run", F.explode(run_keys(F.col("__run"))).alias("key"))
    met = join_on(known, rules, ["key"], "inner").drop("key")
    return join_on(told, met, ["__run"], "inner").drop("__run")
