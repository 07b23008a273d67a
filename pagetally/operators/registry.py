"""Sites and their host matchers."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetally.functions.literals import ascii_lower, required_literal
from pagetally.operators.literal_index import with_piece, with_pieces

# The kinds of host matchers.
MATCHER_TYPES = ("regex", "exact", "wildcard")

# One DNS label: letters, digits and inner hyphens, at most 63 characters.
LABEL_PATTERN = "[A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?"


@dataclass(frozen=True)
class Registry:
    """``services``: service_id, name, published. ``matchers``: matcher_id, service_id, type, value.

    Both may have a leading ``instance`` column when tenants keep separate registries.
    """

    services: DataFrame
    matchers: DataFrame

    @property
    def keys(self) -> list[str]:
        return [c for c in ("instance", "service_id") if c in self.services.columns]


def published(services: DataFrame) -> DataFrame:
    return services.where(F.col("published"))


def select_services(
    services: DataFrame,
    ids: Sequence[str] | None = None,
    name: str | None = None,
    shared: bool = False,
) -> DataFrame:
    """Services by id, name or visibility; an empty id list is no filter."""
    if ids:
        services = services.where(F.col("service_id").isin(list(ids)))
    if name is not None:
        services = services.where(F.col("name") == name)
    return published(services) if shared else services


def with_matchers(registry: Registry) -> DataFrame:
    """Every service with each of its matchers; matcher columns are NULL when it has none.

    An inner join plus the services without matchers: unlike in a left join, Spark
    can split a service that owns most of the matchers over several tasks.
    """
    services, matchers, keys = registry.services, registry.matchers, registry.keys
    bare = services.join(matchers.select(*keys).distinct(), keys, "left_anti")
    return services.join(matchers, keys).unionByName(bare, allowMissingColumns=True)


def matcher_counts(registry: Registry) -> DataFrame:
    """Number of matchers per service, 0 for none."""
    counted = with_matchers(registry).groupBy(*registry.keys)
    return counted.agg(F.count("matcher_id").alias("n"))


def insert_absent(new: DataFrame, current: DataFrame) -> DataFrame:
    """Rows of ``new`` whose name no current service has.

    A name is unique among all services, hidden ones included.
    """
    return new.join(current.select("name"), "name", "left_anti")


def name_conflicts(new: DataFrame, current: DataFrame) -> DataFrame:
    """Rows of ``new`` that cannot be inserted because an unpublished service has the name."""
    hidden = current.where(~F.col("published"))
    return new.join(hidden.select("name"), "name", "left_semi")


def stable_uuid(*parts: Column) -> Column:
    """The same UUID text for the same parts, so a repeated load gives the same ids."""
    digest = F.md5(F.concat_ws("/", *parts))
    return F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def register_new(services: DataFrame, matchers: DataFrame, current: DataFrame) -> Registry:
    """Declared services (file, name, published) and matchers (file, matcher_no, type, value) that are new.

    Of several files with one name the first by file name counts.
    """
    first = services.groupBy("name").agg(F.min(F.struct("file", "published")).alias("s"))
    added = insert_absent(first.select("s.file", "name", "s.published"), current)
    added = added.withColumn("service_id", stable_uuid(F.lit("service"), F.col("name")))
    matcher_id = stable_uuid(F.lit("matcher"), F.col("service_id"), F.col("value"))
    # a value counts once per service
    owned = matchers.join(added.select("file", "service_id"), "file").groupBy("service_id", "value")
    chosen = owned.agg(F.min_by("type", "matcher_no").alias("type"))
    return Registry(
        added.select("service_id", "name", "published"),
        chosen.select(matcher_id.alias("matcher_id"), "service_id", "type", "value"),
    )


def escape_pattern(text: Column) -> Column:
    """Regular expression that matches exactly this text."""
    return F.regexp_replace(text, r"([.^$*+?()\[\]{}|\\])", r"\\$1")


def matcher_pattern(kind: Column, value: Column, mode: str = "reference") -> Column:
    """Regular expression of a matcher.

    ``reference``: an exact matcher is a substring test and the characters around
    the ``*`` of a wildcard are taken as they are. ``strict``: both are escaped
    and anchored. An unusable regular expression gives NULL.
    """
    if mode not in ("reference", "strict"):
        raise ValueError(f"unknown mode: {mode!r}")
    literal = escape_pattern(value)
    if mode == "strict":
        exact = F.concat(F.lit("^"), literal, F.lit("$"))
        body = F.replace(literal, F.lit("\\*"), F.lit(LABEL_PATTERN))
    else:
        exact = literal
        body = F.replace(value, F.lit("*"), F.lit(LABEL_PATTERN))
    pattern = (
        F.when(kind == "regex", value)
        .when(kind == "exact", exact)
        .when(kind == "wildcard", F.concat(F.lit("^"), body, F.lit("$")))
    )
    return F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), pattern)


def compile_matchers(matchers: DataFrame, mode: str = "reference") -> DataFrame:
    """Add ``pattern``; it is NULL for an unknown type or a broken expression."""
    return matchers.withColumn("pattern", matcher_pattern(F.col("type"), F.col("value"), mode))


# A pattern's ``$`` also matches before the line break that ends a text.
_LINE_END = "(\r\n|[\n\r\u0085\u2028\u2029])$"


def _labels_key(count: Column, labels: Column) -> Column:
    return F.concat(count.cast("string"), F.lit("/"), F.array_join(labels, "."))


def indexed_matchers(matchers: DataFrame, keys: list[str], mode: str = "reference") -> DataFrame:
    """Usable matchers (site keys, type, value, pattern) with the ``piece`` a host must have to be tested.

    ``strict``: an exact matcher is found by the whole host, a wildcard by the number of labels and
    the literal labels at the end. All else, and in ``reference`` mode every matcher, is
    found by the rarest three characters of what its matches must contain; a regular
    expression without any such text meets all hosts of its site.
    """
    # compiling costs far more than reading: spread over all tasks, however small the file
    tasks = matchers.sparkSession.sparkContext.defaultParallelism
    spread = matchers.select(*keys, "type", "value").repartition(tasks, *keys, "value")
    compiled = compile_matchers(spread, mode).where(F.col("pattern").isNotNull())
    kind, value = F.col("type"), F.col("value")
    literal = F.when(kind == "exact", ascii_lower(value)).otherwise(required_literal(F.col("pattern")))
    if mode != "strict":
        return with_piece(compiled, literal, keys)
    labels = F.split(value, "[.]", -1)
    starred = F.transform(labels, lambda label, i: F.when(F.contains(label, F.lit("*")), i + 1).otherwise(F.lit(0)))
    tail = F.slice(labels, F.array_max(starred) + 1, F.size(labels))
    direct = F.when(kind == "exact", F.concat(F.lit("="), value)).when(
        (kind == "wildcard") & (F.size(tail) > 0), _labels_key(F.size(labels), tail)
    )
    told = compiled.withColumn("piece", direct)
    rest = with_piece(told.where(F.col("piece").isNull()).drop("piece"), literal, keys)
    return told.where(F.col("piece").isNotNull()).unionByName(rest)


def matcher_candidates(pairs: DataFrame, matchers: DataFrame, keys: list[str], mode: str = "reference") -> DataFrame:
    """(site, host) pairs with each matcher of their site that has a piece in common with the host."""
    host = F.regexp_replace("namespace", _LINE_END, "")
    more = []
    if mode == "strict":
        labels = F.split(host, "[.]", -1)
        ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: _labels_key(F.size(labels), F.slice(labels, -n, n)))
        more = [F.array(F.concat(F.lit("="), F.col("namespace"))), ends]
    return with_pieces(pairs, F.col("namespace"), *more).join(indexed_matchers(matchers, keys, mode), [*keys, "piece"])


def accepts(mode: str = "reference") -> Column:
    """Whether the matcher of a candidate accepts its host; an exact one is a plain text test."""
    host, value = F.col("namespace"), F.col("value")
    exact = host == value if mode == "strict" else host.contains(value)
    return F.when(F.col("type") == "exact", exact).otherwise(F.regexp_like(host, F.col("pattern")))
