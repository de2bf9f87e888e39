"""Fold a name to a form that joins across sources.

Underscores become spaces, a trailing number goes, accents go (compatibility
decomposition without combining marks), letters turn lower case, letters that do
not decompose are spelled out, and runs of white space become one space.

All of it runs in the JVM. Decomposition is that of the ICU library, which Spark brings
along for its collations; a combining mark is a character with a combining class, listed
here as ranges from Python's own tables.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.fixed_values import UNDECOMPOSED_LETTERS

_SPACE = r"[\s\x1c-\x1f]"


@functools.cache
def _marks() -> str:
    """A pattern of one or more combining marks."""
    ranges: list[list[int]] = []
    for point in range(sys.maxunicode + 1):
        if unicodedata.combining(chr(point)):
            if ranges and ranges[-1][1] == point - 1:
                ranges[-1][1] = point
            else:
                ranges.append([point, point])
    listed = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges)
    # Ordinary letters lie below the first mark and are settled by one comparison.
    return f"[\\x{{{ranges[0][0]:X}}}-\\x{{{ranges[-1][1]:X}}}&&[{listed}]]+"


def strip_marks(text: Column) -> Column:
    """Compatibility decomposition without its combining marks."""
    decomposed = F.java_method(
        F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), text, F.lit(True))
    # Most texts have nothing to decompose.
    plain = F.length(text) == F.octet_length(text)
    return F.when(text.isNull() | plain, text).otherwise(F.regexp_replace(decomposed, _marks(), ""))


def fold_name(name: Column) -> Column:
    spaced = F.replace(name, F.lit("_"), F.lit(" "))
    bare = F.regexp_replace(spaced, rf"(?U){_SPACE}+\d+(?=\n?\z)", "")
    spelled = F.lower(strip_marks(bare))
    for letter, spelling in UNDECOMPOSED_LETTERS.items():
        spelled = F.replace(spelled, F.lit(letter), F.lit(spelling))
    return F.trim(F.regexp_replace(spelled, rf"(?U){_SPACE}+", " "))
