"""Text predicates and small clean-ups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(or_, conditions)


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(and_, conditions)


def ilike_any(col: Column, patterns: Sequence[str]) -> Column:
    return any_of([col.ilike(p) for p in patterns])


def external(email: Column, patterns: Sequence[str], keep_null: bool, match_case: bool = False) -> Column:
    """Address is not one of our own or a test address.

    ``keep_null`` decides whether rows without an address stay.
    """
    tests = [~(email.like(p) if match_case else email.ilike(p)) for p in patterns]
    clean = all_of(tests)
    return email.isNull() | clean if keep_null else clean


def short_id(col: Column) -> Column:
    """The 15-character form of an 18-character record id."""
    return F.left(col, F.lit(15))


def referrer_name(col: Column, names: Mapping[str, str]) -> Column:
    """First known name contained in a referrer, else its address without query and closing slash.

    ``names`` maps the text to look for to the name to report, in order of priority.
    """
    result = F.when(col.isNull(), F.lit("null"))
    for text, name in names.items():
        result = result.when(col.ilike(f"%{text}%"), F.lit(name))
    address = F.split_part(col, F.lit("?"), F.lit(1))
    return result.otherwise(F.regexp_replace(address, "/$", ""))


def is_true(col: Column) -> Column:
    return col.eqNullSafe(True)
