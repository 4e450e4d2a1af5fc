"""Column functions over text: patterns as Python means them, fingerprints, token counts."""

from __future__ import annotations

import logging
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

log = logging.getLogger(__name__)
#: Python's white space: Unicode's and U+001C to U+001F.
BLANK = r"[\s\x1c-\x1f]"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once: body sees a variable, however often and however deep it names it.

    A plain expression named inside a lambda is evaluated anew for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def java_pattern(pattern: str | None, ignore_case: bool = False) -> str | None:
    """A Python pattern for Java: only \\n ends a line, classes are Unicode. None, with a warning, if it is invalid."""
    if not pattern:
        return None
    try:
        re.compile(pattern)
    except re.error as e:
        log.warning("invalid pattern %r: %s", pattern, e)
        return None
    p = re.sub(r"\(\?P<", "(?<", pattern).replace(r"\Z", r"\z")
    p = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", p)
    return ("(?idU)" if ignore_case else "(?dU)") + p


def java_replacement(replacement: str) -> str:
    """A Python replacement for Java: \\1 and \\g<name> become groups, $ is literal."""
    r = replacement.replace("$", r"\$")
    r = re.sub(r"\\g<(\d+)>", r"${\1}", r)
    r = re.sub(r"\\g<(\w+)>", r"${\1}", r)
    r = re.sub(r"\\(\d)", r"$\1", r)
    return re.sub(r"\$\{(\d+)\}", r"$\1", r)


def stripped(c: Column) -> Column:
    """c without white space at its ends; most texts have none there, which their first and last character tell."""
    ends = F.concat(F.substring(c, 1, 1), F.substring(c, -1, 1))
    return F.when(ends.rlike(f"(?dU){BLANK}"), F.regexp_replace(c, f"(?dU)^{BLANK}+|{BLANK}+$", "")).otherwise(c)


def is_blank(c: Column) -> Column:
    return c.rlike(f"(?dU)^{BLANK}*$")


def fingerprint(c: Column) -> Column:
    """sha256:{code points}:{hex}; empty text leaves the length out."""
    return F.when(F.length(c) == 0, F.concat(F.lit("sha256:"), F.sha2(c, 256))).otherwise(F.concat(F.lit("sha256:"), F.length(c).cast("string"), F.lit(":"), F.sha2(c, 256)))


def token_count(c: Column) -> Column:
    """A quarter of the code points, rounded down."""
    return F.floor(F.length(c) / 4).cast("long")
