"""Names, codes and globs as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = ("advisory", "warning", "error")


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "error", 3).when(severity == "warning", 2).when(severity == "advisory", 1)


def severity_of(rank: Column) -> Column:
    return F.when(rank == 3, "error").when(rank == 2, "warning").when(rank == 1, "advisory")


def glob(name: Column, pattern: str) -> Column:
    """``*`` is any text, ``?`` any character."""
    return name.rlike("(?s)^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern) + "$")


def normal_name(name: Column) -> Column:
    """Ink name in lower case with single spaces and no other separators."""
    return F.trim(F.regexp_replace(F.lower(name), r"[\s_-]+", " "))


def close_names(one: Column, two: Column, most: int = 2) -> Column:
    """Edit distance, or null above ``most``."""
    found = F.levenshtein(one, two, most)
    return F.when(found >= 0, found)


def check_digit(body: Column) -> Column:
    """Modulo-10 check digit of a code without it: weights 3 and 1 from the right."""
    digits = F.reverse(F.split(body, ""))
    total = F.aggregate(F.transform(digits, lambda c, i: c.cast("int") * F.when(i % 2 == 0, 3).otherwise(1)), F.lit(0), lambda s, x: s + x)
    return F.pmod(10 - total % 10, F.lit(10))


def token_similarity(one: Column, two: Column) -> Column:
    """Shared words over all words, in lower case."""
    words = [F.array_distinct(F.filter(F.split(F.lower(x), r"[^\p{L}\p{N}]+"), lambda w: w != "")) for x in (one, two)]
    every = F.size(F.array_union(*words))
    return F.when(every > 0, F.size(F.array_intersect(*words)) / every).otherwise(0.0)
