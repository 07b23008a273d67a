"""User agents by a table of rules: every distinct agent is read once."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagetally.functions import agents as builtin
from pagetally.functions.literals import ascii_lower, required_literal
from pagetally.operators.joins import join_on
from pagetally.operators.literal_index import local_pieces, with_pieces
from pagetally.operators.run_index import found_rules, with_key

# What a rule can tell.
KINDS = ("browser", "system", "bot")

RULE_SCHEMA = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("position", T.IntegerType()),
        T.StructField("literal", T.StringType()),
        T.StructField("pattern", T.StringType()),
        T.StructField("family", T.StringType()),
        T.StructField("version", T.StringType()),
        T.StructField("piece", T.StringType()),
    ]
)

AGENT_COLUMNS = ("browser", "browser_version", "operating_system", "operating_system_version")


def rule_table(spark: SparkSession, rules: list[dict]) -> DataFrame:
    """Rules given as dictionaries; a small table whose size Spark knows."""
    text, kind = F.lit(json.dumps(rules)), T.ArrayType(RULE_SCHEMA)
    return spark.range(1).select(F.inline(F.from_json(text, kind)))


def builtin_rules(spark: SparkSession) -> DataFrame:
    """The built-in rules as a table, with the piece that finds each of them."""
    rows = []
    for kind, rules in (("browser", builtin.BROWSER_RULES), ("system", builtin.SYSTEM_RULES)):
        for i, rule in enumerate(rules):
            number = f"(?s)^.*\\Q{rule.marker}\\E([0-9]+(?:[._][0-9]+)*)?"
            rows.append({"kind": kind, "position": i, "literal": rule.token, "family": rule.family, "version": number})
    for i, token in enumerate(builtin.BOT_TOKENS):
        rows.append({"kind": "bot", "position": i, "pattern": f"(?i){builtin.quoted(token)}", "family": token})
    found_by = local_pieces([row.get("literal") or row["family"] for row in rows])
    return rule_table(spark, [{**row, "piece": piece} for row, piece in zip(rows, found_by, strict=True)])


def indexed_rules(rules: DataFrame) -> DataFrame:
    """Usable rules with the ``key`` that finds them (see ``run_index``); a broken pattern drops its rule."""
    # compiling costs far more than reading: spread over all tasks, however small the file
    tasks = rules.sparkSession.sparkContext.defaultParallelism
    rules = rules.repartition(tasks, "kind", "position", "literal", "pattern")
    compiled = {c: F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), F.col(c)) for c in ("pattern", "version")}
    pattern, literal = F.col("pattern"), F.col("literal")
    usable = (literal.isNotNull() | pattern.isNotNull()) & (pattern.isNull() | compiled["pattern"].isNotNull())
    named = [compiled[c].alias(c) if c == "version" else F.col(c) for c in RULE_SCHEMA.names if c != "piece"]
    needed = F.when(literal.isNotNull(), ascii_lower(literal)).otherwise(required_literal(pattern))
    return with_key(rules.where(usable).select(*named), needed)


def agent_table(agents: DataFrame, rules: DataFrame | None = None, bot: str = "is_bot") -> DataFrame:
    """What the rules tell of every distinct ``user_agent``: browser, system, their versions, ``is_bot``.

    ``rules`` has kind (browser, system, bot), position, literal, pattern, family, version. A
    rule fires when the agent contains the literal and matches the pattern, where given; of each
    kind the first by position decides. ``version`` is a pattern whose group 1 is the version.
    Rules are found by a rare run of letters and digits of their literal (or of what their pattern
    must contain), the built-in ones by a rare piece of three characters, in a join, and only
    those found are tested. Agents without any rule have NULLs.
    """
    rules = builtin_rules(agents.sparkSession) if rules is None else rules
    known = agents.where(F.col("user_agent").isNotNull()).select("user_agent").distinct()
    agent = F.col("user_agent")
    if "piece" in rules.columns:
        found = join_on(with_pieces(known, agent), rules, ["piece"], "inner")
    else:
        found = found_rules(known, "user_agent", indexed_rules(rules))
    fires = F.coalesce(agent.contains(F.col("literal")), F.lit(True))
    fires = fires & F.when(F.col("pattern").isNull(), F.lit(True)).otherwise(F.regexp_like(agent, F.col("pattern")))
    verified = found.where(fires)

    def first(kind: str):
        return F.min(F.when(F.col("kind") == kind, F.struct("position", "family", "version"))).alias(kind)

    told = verified.groupBy("user_agent").agg(*[first(kind) for kind in KINDS])

    def version(kind: str):
        number = F.call_function("regexp_extract", agent, F.col(f"{kind}.version"), F.lit(1))
        return F.nullif(F.translate(number, "_", "."), F.lit(""))

    return told.select(
        "user_agent",
        F.col("browser.family").alias("browser"),
        version("browser").alias("browser_version"),
        builtin.system_name(F.col("system.family")).alias("operating_system"),
        version("system").alias("operating_system_version"),
        F.col("bot").isNotNull().alias(bot),
    )


def agent_columns(rows: DataFrame, rules: DataFrame | None = None, seen: DataFrame | None = None) -> DataFrame:
    """The four columns and ``bot_agent`` for every row; agents are read once and joined back.

    ``seen`` is a frame that has all agents of ``rows`` and takes less work to read.
    """
    table = agent_table(rows if seen is None else seen, rules, "bot_agent")
    joined = join_on(rows, table, ["user_agent"])
    return joined.withColumn("bot_agent", F.coalesce("bot_agent", F.lit(False)))
