"""logfmt lines: ``key=value`` and ``key="quoted value"`` pairs.

A key is everything up to the next ``=``, a bare value ends at the next blank,
a quoted one at the next quote or the end of the line. The last pair of a key
wins. Functions take the name of a column and return an expression over it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Key spellings, in lookup order.
LEVEL_KEYS = ["level", "lvl", "severity"]
TIME_KEYS = ["time", "ts", "timestamp"]
MESSAGE_KEYS = ["msg", "message"]
RESERVED = LEVEL_KEYS + TIME_KEYS + MESSAGE_KEYS

# Shape of a pair, and of a pair as counted by format detection.
# Each match starts where the last one ended and never gives back, so a line takes linear time.
PAIR = r'\G *[^=]*+=(?:"[^"]*+(?:"|\z)|[^ ]*+)'
COUNTED_PAIR = r'(?U)(?:^|\s)\w+=(?:"[^"]*"|\S+)'

_KEY = "substring_index(p, '=', 1)"
_VALUE = """CASE WHEN substr(p, instr(p, '=') + 1) LIKE '"%' THEN split_part(substr(p, instr(p, '=') + 1), '"', 2)
    ELSE substr(p, instr(p, '=') + 1) END"""


def pairs(raw: str) -> Column:
    """Array of ``key=value`` texts in line order."""
    return F.expr(f"transform(regexp_extract_all({raw}, r'{PAIR}', 0), p -> ltrim(p))")


def _first_usable(pair_list: str, keys: list[str]) -> str:
    """Value of the first key whose last pair has a value."""
    last = ", ".join(f"try_element_at(filter({pair_list}, p -> startswith(p, '{k}=')), -1)" for k in keys)
    return f"try_element_at(filter(transform(array({last}), p -> {_VALUE}), v -> v <> ''), 1)"


def level(pair_list: str) -> Column:
    return F.expr(f"upper({_first_usable(pair_list, LEVEL_KEYS)})")


def stamp(pair_list: str) -> Column:
    return F.expr(_first_usable(pair_list, TIME_KEYS))


def message(pair_list: str) -> Column:
    return F.expr(f"coalesce({_first_usable(pair_list, MESSAGE_KEYS)}, '')")


def other_pairs(pair_list: str) -> Column:
    """Key and value of the pairs that are not level, time or message."""
    reserved = ", ".join(f"'{k}'" for k in RESERVED)
    return F.expr(
        f"transform(filter({pair_list}, p -> {_KEY} NOT IN ({reserved})), p -> struct({_KEY} AS k, {_VALUE} AS v))"
    )


def extras(others: str) -> Column:
    """A map of the ``other_pairs`` column; the last pair of a key wins, empty values are kept as ''."""
    latest = f"array_sort(transform({others}, (p, i) -> struct(p.k AS k, -i AS i, p.v AS v)))"
    first = "filter(a, (p, i) -> i = 0 OR a[i - 1].k <> p.k)"
    return F.expr(
        f"map_from_entries(transform(array({latest}), a -> transform({first}, p -> struct(p.k, p.v)))[0])"
    )


def looks_like(text: str) -> Column:
    """True for text with at least two separate pairs."""
    return F.expr(f"regexp_count({text}, r'{COUNTED_PAIR}') >= 2")
