"""User patterns: literal or regular expression, any-of semantics, ignoring case."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Fixed value: a pattern with none of these characters is a literal.
REGEX_CHARACTERS = ".^$*+?{}[]|()\\"

# i ignore case, U Unicode classes, d only \n ends a line.
FLAGS = "(?iUd)"

_MANY = 16


def is_literal(pattern: str) -> bool:
    return not any(c in REGEX_CHARACTERS for c in pattern)


def to_java(pattern: str) -> str:
    """Rewrite the few spellings that Java's regex dialect lacks.

    ``(?P<name>``, ``(?P=name)`` and ``\\Z`` get their Java spelling (group names
    lose characters Java does not allow), and ``[`` or ``&&`` inside a character
    class, which Java would read as a nested class, are escaped. A brace that opens no
    repeat count is a character, ``{,n}`` counts from 0, and of the inline flags ``a`` turns Unicode
    classes off, ``u`` and ``L`` go. Conditional groups are refused.
    """
    names: dict[str, str] = {}

    def java_name(name: str) -> str:
        return names.setdefault(name, "g%d%s" % (len(names), re.sub(r"[^A-Za-z0-9]", "", name)))

    spellings = re.compile(
        r"(?P<escape>\\.)|\(\?P<(?P<define>\w+)>|\(\?P=(?P<use>\w+)\)|(?P<cls>\[\^?\]?(?:\\.|[^\]\\])*\])"
        r"|\{(?P<low>\d*)(?P<comma>,?)(?P<high>\d*)\}|(?P<brace>\{)|\(\?(?P<flags>[aiLmsux]+)(?P<after>[):])",
        re.DOTALL,
    )

    def spell(m: re.Match) -> str:
        if m["escape"]:
            return r"\z" if m["escape"] == r"\Z" else m["escape"]
        if m["define"]:
            return f"(?<{java_name(m['define'])}>"
        if m["use"]:
            return rf"\k<{java_name(m['use'])}>"
        if m["brace"]:
            return r"\{"
        if m["low"] is not None:
            if not m["low"] and not m["comma"]:
                return r"\{\}" if not m["high"] else "\\" + m[0]
            return f"{{{m['low'] or 0}{m['comma']}{m['high']}}}"
        if m["flags"]:
            on = "".join(f for f in m["flags"] if f not in "auL") + ("-U" if "a" in m["flags"] else "")
            return f"(?{on}{m['after']}" if on or m["after"] == ":" else ""
        body = re.sub(r"(\\.)|\[|&&", lambda b: b[1] or "".join("\\" + c for c in b[0]), m["cls"][1:-1], flags=re.DOTALL)
        return "[" + re.sub(r"^(\^?)\]", r"\1\\]", body) + "]"

    return spellings.sub(spell, pattern)


def check(pattern: str) -> str:
    """The Java form of ``pattern``; ``ValueError`` when it is not a valid expression."""
    try:
        re.compile(pattern)
    except re.error as error:
        raise ValueError(f"invalid pattern {pattern!r}: {error}") from None
    java = FLAGS + to_java(pattern)
    spark = SparkSession.getActiveSession()
    jvm = getattr(spark, "_jvm", None)
    if jvm is not None:
        try:
            jvm.java.util.regex.Pattern.compile(java)
        except Exception as error:  # the Java side names the position
            raise ValueError(f"invalid pattern {pattern!r}: {str(error).splitlines()[0]}") from None
    return java


def literal(text: Column, needle: str) -> Column:
    return F.contains(F.lower(text), F.lower(F.lit(needle)))


def any_literal(text: Column, needles: Sequence[str]) -> Column:
    if len(needles) <= _MANY:
        test = F.lit(False)
        for needle in needles:
            test = test | literal(text, needle)
        return test
    # Long lists: lower the line once and test the needles against that value.
    words = F.array(*[F.lower(F.lit(n)) for n in needles])
    return F.exists(F.array(F.lower(text)), lambda low: F.exists(words, lambda w: F.contains(low, w)))


def any_regex(text: Column, expressions: Sequence[str]) -> Column:
    test = F.lit(False)
    for expression in expressions:
        test = test | F.rlike(text, F.lit(check(expression)))
    return test


def any_pattern(text: Column, patterns: str | Sequence[str] | None, regex_mode: bool = False) -> Column:
    """True where ``text`` contains at least one pattern; no pattern matches everything.

    A list of literals is searched literally; as soon as one entry is an
    expression, or with ``regex_mode``, every entry is read as an expression.
    """
    chosen = [patterns] if isinstance(patterns, str) else list(patterns or [])
    if not chosen:
        return F.lit(True)
    if not regex_mode and all(is_literal(p) for p in chosen):
        return any_literal(text, chosen)
    return any_regex(text, chosen)


def alternation(patterns: Sequence[str]) -> str | None:
    """One Java expression matching any pattern, or None when one of them is invalid."""
    try:
        for p in patterns:
            check(p)
    except ValueError:
        return None
    return FLAGS + "|".join(f"(?:{to_java(p)})" for p in patterns)
