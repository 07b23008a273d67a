"""What a regular expression's matches must contain, and the three-letter pieces of a text."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

PIECE = 3

# Stand for what is cut out of a pattern, and for an escaped dot.
_GAP, _DOT = "\uE000", "\uE001"

# Options but a leading (?i), alternatives, numeric escapes, quotations, odd or nested classes.
_UNCLEAR = r"\(\?|\||\\[xucpPQEkNRXG0-9]|\[\^?\]|\[[^\]]*\[|&&"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case. Unlike Unicode lower case, it changes no other character and no length."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def required_literal(pattern: Column) -> Column:
    """A text, in ``ascii_lower``, that every match of the pattern contains; '' where none is known.

    Cautious: alternatives, options other than a leading ``(?i)``, numeric escapes and nested
    classes give ''. What is in groups or classes, optional or escaped (but for dots) does not
    count. Of the rest the longest run is taken.
    """
    text = F.replace(F.regexp_replace(pattern, r"^\(\?i\)", ""), F.lit("\\."), F.lit(_DOT))
    text = F.when(~F.regexp_like(text, F.lit(_UNCLEAR)), text)
    text = F.regexp_replace(text, r"(?s)\\.|\[[^\]]*\]", _GAP)
    for _ in range(3):
        text = F.regexp_replace(text, r"\([^()]*\)", _GAP)
    text = F.regexp_replace(text, r"(?s).(?:[?*]|\{[^}]*\})[?+]?|\+[?+]?|[.^$]", _GAP)
    runs = F.transform(F.split(text, _GAP), lambda run: F.struct(F.length(run).alias("n"), run.alias("run")))
    longest = F.regexp_extract(F.array_max(runs)["run"], r"^[^()\[\]\\]*$", 0)
    return F.coalesce(ascii_lower(F.translate(longest, _DOT, ".")), F.lit(""))


def pieces(text: Column) -> Column:
    """The distinct runs of three characters of a text, overlapping, in ``ascii_lower``."""
    return F.array_distinct(F.regexp_extract_all(ascii_lower(text), F.lit(f"(?s)(?=(.{{{PIECE}}}))"), 1))
