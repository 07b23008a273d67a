"""Line dedup by a deletion-neighbourhood join: exact and one-word-edit copies of lines.

DataFrame functions only; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetally.llm.common import WORD, WORD_GAP, free_name, stored

LEAST_WORDS = 5  # one edit in this many words is a similarity of 0.8
_PLACE = ("missing", "id", "line_no")


def _words(line: Column) -> Column:
    return F.array_remove(F.split(line, WORD_GAP), "")


def _place(prefix: str = "") -> Column:
    """Position in the corpus; rows without an identifier come last."""
    return F.struct(*(F.col(prefix + c).alias(c) for c in _PLACE))


def _without(words: Column, at: Column) -> Column:
    """The words but the one at a place counted from 1."""
    return F.concat(F.slice(words, F.lit(1), at - 1), F.slice(words, at + 1, F.greatest(F.size(words) - at, F.lit(0))))


def line_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(missing, id, line_no, line, row_key) of every line that has a word."""
    # the key is made below the explode, so once a row and not once a line
    rows = docs.select(F.col(id_col).alias("id"), _row_key(id_col, text_col).alias("row_key"), F.col(text_col).alias("text"))
    lines = rows.select(
        F.col("id").isNull().alias("missing"), "id", "row_key", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")
    )
    return lines.where(F.col("line").rlike(WORD))


def _row_key(id_col: str, text_col: str) -> Column:
    """Rows that agree in identifier and text have the same lines and the same result."""
    return F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.col(text_col)))


def _near_candidates(lines: DataFrame) -> DataFrame:
    """k of the lines that share their first or last half with a line of about their length.

    One edit leaves the first or the last half of the words alone, half of the shorter
    line. A line of n words is filed under halves of n and of n - 1 words, rounded down, which are the
    same for an odd n; any two lines that differ by at most a word in length have one size in common.
    So no two lines within an edit are lost here.
    """
    n = F.size("w")

    def ends(k: Column) -> list[Column]:
        first, last = F.slice("w", F.lit(1), k), F.slice("w", n - k + 1, k)
        return [F.xxhash64(F.lit(side), k, part) for side, part in (("first", first), ("last", last))]

    half, less = F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")
    keys = F.when(n % 2 == 1, F.array(*ends(half))).otherwise(F.array(*ends(half), *ends(less)))
    # no filter on the words: it would move below and split every line once more
    keyed = lines.select("k", _words(F.col("line")).alias("w"))
    keyed = stored(keyed.select("k", F.explode(F.when(n >= LEAST_WORDS - 1, keys)).alias("key")), "line-halves")
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    return keyed.join(shared, "key").select("k").distinct()


def _variants(lines: DataFrame) -> DataFrame:
    """(key, role, at, turn): hashed keys of each line and of each line less a word.

    Role 0: a line of n words less its word ``at``, keyed by n and ``at`` too: all lines
    with that key differ in that word only. Role 1: the same without n and ``at``; role 2:
    the whole line. A role 1 meets the role 2 that it becomes by one deletion.
    A hash of words and places is the exclusive or over its words, so each variant takes
    two of them and no copy of the line.
    """

    def folded(shift: int) -> Column:
        zero = F.array(F.lit(0).cast("long"))
        each = F.transform("w", lambda word, j: F.xxhash64(word, (j + 1 - shift).cast("int")))
        return F.aggregate(each, zero, lambda have, h: F.concat(have, F.array(F.element_at(have, -1).bitwiseXOR(h))))

    summed = lines.select("turn", _words(F.col("line")).alias("w"))
    summed = summed.select("turn", F.size("w").alias("n"), folded(0).alias("p"), folded(1).alias("q"))
    last, i = F.col("n"), F.col("i")
    # exploded first, so that the keys are made by generated code and not in a lambda
    each = summed.select("*", F.explode(F.sequence(F.lit(0), F.when(last >= LEAST_WORDS, last).otherwise(0))).alias("i"))
    whole, before = F.get("p", last), F.get("p", i - 1)
    one = F.get("p", i).bitwiseXOR(before)
    rest = before.bitwiseXOR(F.get("q", last)).bitwiseXOR(F.get("q", i))

    def variant(role: int, *key: Column) -> Column:
        return F.struct(F.xxhash64(*key).alias("key"), F.lit(role).alias("role"), i.alias("at"))

    own = variant(2, F.lit(1), last, whole)
    swapped, deleted = variant(0, F.lit(0), last, i, whole.bitwiseXOR(one)), variant(1, F.lit(1), last - 1, rest)
    return each.select("turn", F.inline(F.when(i == 0, F.array(own)).otherwise(F.array(swapped, deleted))))


def _near_copies(lines: DataFrame) -> DataFrame:
    """k of the lines that are one word edit away from an earlier line."""
    some = lines.join(_near_candidates(lines), "k", "left_semi").select("k", "line", *_PLACE).orderBy(*_PLACE)
    # turns rise with places: the least turn of a key is its earliest line
    some = stored(some.select("*", F.monotonically_increasing_id().alias("turn")), "line-candidates")
    variants = stored(_variants(some), "line-variants")
    # each group is known by its earliest members only: no pair of a group is formed
    of = {r: F.when(F.col("role") == r, F.col("turn")) for r in (0, 1, 2)}
    earliest = variants.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), *(F.min(of[r]).alias(f"first{r}") for r in of), F.min_by("at", of[1]).alias("at1")
    )
    met = variants.join(earliest.where("n > 1").drop("n"), "key")
    partner = F.when(F.col("role") == 0, F.col("first0")).when(F.col("role") == 1, F.col("first2")).otherwise(F.col("first1"))
    pairs = met.withColumn("other", partner).where("other < turn")
    pairs = stored(pairs.select("turn", "role", "at", "other", F.col("at1").alias("other_at")).distinct(), "line-pairs")
    texts = some.select("turn", "k", _place().alias("place"), _words(F.col("line")).alias("a"))
    others = texts.select(F.col("turn").alias("other"), F.col("place").alias("other_place"), F.col("a").alias("b"))
    both = pairs.join(texts, "turn").join(others, "other").where("other_place < place")
    edit = (
        F.when(F.col("role") == 0, _without(F.col("a"), F.col("at")) == _without(F.col("b"), F.col("at")))
        .when(F.col("role") == 1, _without(F.col("a"), F.col("at")) == F.col("b"))
        .otherwise(F.col("a") == _without(F.col("b"), F.col("other_at")))
    )
    return both.where(edit).select("k").distinct()


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row_key, lines): the numbers, from 0, of the lines to drop; see ``dedup_lines``."""
    occurrences = line_table(docs, id_col, text_col)
    groups = occurrences.groupBy("line").agg(F.min(_place()).alias("first"), F.count(F.lit(1)).alias("copies"))
    distinct = groups.select(F.monotonically_increasing_id().alias("k"), "line", "first.*", "copies")
    distinct = stored(distinct, "lines")
    near = stored(_near_copies(distinct), "near-lines")
    decided = distinct.join(near.withColumn("near", F.lit(True)), "k", "left").where("copies > 1 or near").select(
        F.md5("line").alias("digest"), F.coalesce("near", F.lit(False)).alias("near"), _place().alias("first")
    )
    places = occurrences.select("row_key", *_PLACE, F.md5("line").alias("digest")).join(decided, "digest")
    late = places.where(F.col("near") | (_place() != F.col("first")))
    return late.groupBy("row_key").agg(F.collect_set("line_no").alias("lines"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated lines taken out of the text, and their number as ``n_removed``.

    Lines end at a line feed. A line goes if an earlier line has the same text, or is one
    word edit away (a word more, less or another) where the longer of the two has at least
    ``LEAST_WORDS`` words, a similarity of 0.8. Earlier is by identifier, then by line
    number; what an earlier line is, is judged on the given texts, also if that line goes
    itself. Lines without words always stay. A document of which all lines go stays, with
    an empty text.

    Rows without identifier come after all others. Rows that share an identifier share
    places: equal lines at equal places are the same line, and none of them goes. Null
    texts stay null. An empty table gives no rows. A column that is already named n_removed
    is replaced. Lines are told apart by 128 bits, variants by 64 and then by comparison.
    """
    gone = stored(dropped_lines(docs, id_col, text_col), "dropped-lines")
    row, dropped = free_name(docs, "_row_key"), free_name(docs, "_gone")
    keyed = docs.drop("n_removed").withColumn(row, _row_key(id_col, text_col))
    joined = keyed.join(gone.select(F.col("row_key").alias(row), F.col("lines").alias(dropped)), row, "left")
    # a column of its own: inside the lambda the text would be split once a line
    split = free_name(joined, "_parts")
    joined = joined.withColumn(split, F.when(F.col(dropped).isNotNull(), F.split(text_col, "\n", -1)))
    stay = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(dropped))  # keeps the order
    left = F.when(F.size(stay) > 0, F.array_join(F.transform(stay, lambda i: F.get(split, i)), "\n")).otherwise("")
    removed = F.coalesce(F.size(dropped), F.lit(0)).cast("long")
    text = F.when(F.col(dropped).isNull(), F.col(text_col)).otherwise(left)
    return joined.withColumn("n_removed", removed).withColumn(text_col, text).select(
        *(F.col(f"`{c}`") for c in docs.columns if c != "n_removed"), "n_removed"
    )
