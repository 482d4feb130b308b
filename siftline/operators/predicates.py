"""Row predicates over parsed lines.

Predicates are plain comparisons, so they reach the scan of a stored table. On
rows without level or timestamp they may be NULL, which ``where`` drops; use
``definite`` or ``inverted`` wherever the value itself counts.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline.functions import plaintext
from siftline.functions.patterns import any_pattern, is_literal
from siftline.functions.timestamps import parse_bound


def definite(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def level_in(levels: Sequence[str], column: str = "level") -> Column:
    """Level is one of ``levels``, ignoring case (records hold levels in upper case).

    No levels: everything passes.
    """
    if not levels:
        return F.lit(True)
    return F.col(column).isin(sorted({lv.upper() for lv in levels}))


def matches(patterns: str | Sequence[str] | None, regex_mode: bool = False, column: str = "raw") -> Column:
    """The raw line contains one of ``patterns``. No patterns: everything passes."""
    return any_pattern(F.col(column), patterns, regex_mode)


def in_range(
    from_: str | datetime | None = None,
    to: str | datetime | None = None,
    column: str = "ts",
    once: bool = False,
) -> Column:
    """Wall clock within both bounds, ends included. A row without timestamp fails a set bound.

    ``once`` evaluates the column a single time, for clocks that are still to be
    parsed; the plain form is the one a stored table can push down.
    """
    low, high = (None if b is None else F.lit(b).cast("timestamp_ntz") for b in (parse_bound(from_), parse_bound(to)))
    ts = F.col(column)
    if low is not None and high is not None:
        if once:
            return F.exists(F.array(ts), lambda t: (t >= low) & (t <= high))
        return (ts >= low) & (ts <= high)
    if low is not None:
        return ts >= low
    return ts <= high if high is not None else F.lit(True)


def python_predicate(test: Callable[[str], bool]) -> Callable[[Column], Column]:
    """Wrap a Python function on one line as a column predicate evaluated on Arrow batches."""

    @F.pandas_udf("boolean")
    def run(lines: pd.Series) -> pd.Series:
        return lines.map(lambda line: bool(test(line)), na_action="ignore").astype("boolean")

    return run


def all_of(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def build(
    levels: Sequence[str] = (),
    patterns: str | Sequence[str] | None = (),
    from_: str | datetime | None = None,
    to: str | datetime | None = None,
    regex_mode: bool = False,
    extra: Sequence[Column] = (),
    plain: bool = False,
    lazy: bool = False,
) -> Column:
    """The AND of all given filters, cheapest test first.

    ``lazy`` says that the record columns are expressions over ``raw``, not stored.
    With ``plain`` (plain text lines) a substring test in front of the level
    test skips the level expression for lines that cannot have the level.
    """
    chosen = [patterns] if isinstance(patterns, str) else list(patterns or [])
    cheap, dear = [], []
    if chosen:
        literal = not regex_mode and all(is_literal(p) for p in chosen)
        (cheap if literal else dear).append(matches(chosen, regex_mode))
    if levels:
        if plain:
            cheap.append(plaintext.may_have_level(F.col("raw"), list(levels)))
        cheap.append(level_in(levels))
    if from_ or to:
        cheap.append(in_range(from_, to, once=lazy))
    return all_of([*cheap, *dear, *extra])


def inverted(test: Column) -> Column:
    """Rows the whole filter does not match, rows without level or timestamp included."""
    return ~definite(test)
