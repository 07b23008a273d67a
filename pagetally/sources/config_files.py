"""Declarative registry files: one service and its matchers per file."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagetally.operators.registry import MATCHER_TYPES
from pagetally.session import exists

# Texts that mean "published".
PUBLISHED_TEXTS = ("true", "yes", "1")


def read_config_files(spark: SparkSession, *folders: str) -> DataFrame:
    """(file, content, layer) of the ``*.conf`` files; later folders override earlier ones.

    An absent folder counts as empty.
    """
    frames = [spark.createDataFrame([], "file string, content string, layer int")]
    frames += [
        spark.read.text(folder, wholetext=True, pathGlobFilter="*.conf")
        .select(
            F.substring_index(F.input_file_name(), "/", -1).alias("file"),
            F.col("value").alias("content"),
            F.lit(layer).alias("layer"),
        )
        for layer, folder in enumerate(folders)
        if exists(spark, folder)
    ]
    return reduce(DataFrame.unionByName, frames)


def override(files: DataFrame) -> DataFrame:
    """One row per file name, the one of the highest layer."""
    newest = Window.partitionBy("file").orderBy(F.desc("layer"))
    return files.withColumn("n", F.row_number().over(newest)).where(F.col("n") == 1).drop("n")


def sections(files: DataFrame) -> DataFrame:
    """(file, section_no, section, keys): one row per section, keys in lower case."""
    blocks = F.posexplode(F.split("content", "(?m)^[ \t]*\\[")).alias("section_no", "block")
    split = files.select("file", blocks).where(F.col("section_no") > 0)

    def entry(line):
        at = F.instr(line, "=")
        return F.struct(
            F.lower(F.trim(F.substring_index(line, "=", 1))).alias("key"),
            F.trim(F.substr(line, at + F.lit(1))).alias("value"),
        )

    lines = F.filter(
        F.split("block", "\r?\n"), lambda line: line.contains("=") & ~F.regexp_like(line, F.lit("^[ \t]*[#;]"))
    )
    return split.select(
        "file",
        "section_no",
        F.trim(F.substring_index("block", "]", 1)).alias("section"),
        F.transform(lines, entry).alias("keys"),
    )


def _key(name: str):
    return F.try_element_at(F.filter("keys", lambda k: k["key"] == name), F.lit(-1))["value"]


def parse_config_files(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Services (file, name, published), matchers (file, matcher_no, type, value) and errors (file, error).

    A file without a [Service] section or without a name gives no service; a
    matcher without value or with an unknown type is left out. Both are reported.
    """
    parts = sections(override(files))
    heads = (
        parts.where(F.col("section") == "Service")
        .groupBy("file")
        .agg(F.max_by(F.struct(_key("name").alias("name"), _key("published").alias("published")), "section_no").alias("s"))
        .select("file", F.col("s.name").alias("name"), F.col("s.published").alias("published"))
    )
    services = heads.where(F.col("name").isNotNull()).withColumn(
        "published", F.coalesce(F.col("published"), F.lit("true")).isin(*PUBLISHED_TEXTS)
    )
    found = parts.where(F.col("section") == "Matcher").select(
        "file", "section_no", _key("type").alias("type"), _key("value").alias("value")
    )
    usable = F.col("type").isin(*MATCHER_TYPES) & F.col("value").isNotNull()
    usable = F.coalesce(usable, F.lit(False))
    matchers = (
        found.where(usable)
        .join(services.select("file"), "file", "left_semi")
        .select("file", F.col("section_no").alias("matcher_no"), "type", "value")
    )
    no_service = files.select("file").distinct().join(heads, "file", "left_anti")
    errors = (
        no_service.select("file", F.lit("missing service section").alias("error"))
        .unionByName(heads.where(F.col("name").isNull()).select("file", F.lit("missing name").alias("error")))
        .unionByName(found.where(~usable).select("file", F.lit("invalid matcher").alias("error")))
    )
    return services, matchers, errors
