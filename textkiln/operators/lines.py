"""Line programs: declared stages compiled to one expression over an array of lines.

Nothing here shuffles; a document is a row and its lines an array. Every stage binds its lines to a variable and names
them only through it, so a program's plan grows by a constant a stage and its time by a constant a line.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from textkiln.functions.text import bound, is_blank, java_pattern, java_replacement

# The escape sequences that are removed, the notice of a cut text, and the fallback.
ANSI = r"\x1B(?:[@-Z\\-_]|\[[0-?]*[ -/]*[@-~])"
CUT_NOTICE = "... [Truncated. Full output saved to {}]"
EMPTY_OUTPUT = "[Empty Output]"


@dataclass(frozen=True)
class Stage:
    """One step of a program; unknown names and invalid patterns do nothing."""

    name: str
    enabled: bool = True
    pattern: str | None = None
    replacement: str = ""
    max_lines: int = 50
    head_ratio: float = 0.5
    priority_lines: str | None = None
    fallback: str = EMPTY_OUTPUT

    def __post_init__(self) -> None:
        if self.max_lines < 1 or not 0 <= self.head_ratio <= 1:
            raise ValueError("max_lines must be 1 at least and head_ratio between 0 and 1")

    @classmethod
    def of(cls, d: dict) -> Stage:
        return cls(**{k: v for k, v in d.items() if k in cls.__dataclass_fields__})


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def strip_ansi(lines: Column) -> Column:
    return F.transform(lines, lambda x: F.regexp_replace(x, ANSI, ""))


def regex_replace(lines: Column, pattern: str | None, replacement: str = "") -> Column:
    p = java_pattern(pattern)
    return lines if p is None else F.transform(lines, lambda x: F.regexp_replace(x, F.lit(p), F.lit(java_replacement(replacement))))


def regex_drop(lines: Column, pattern: str | None) -> Column:
    p = java_pattern(pattern)
    return lines if p is None else F.filter(lines, lambda x: ~x.rlike(p))


def regex_keep(lines: Column, pattern: str | None) -> Column:
    p = java_pattern(pattern)
    return lines if p is None else F.filter(lines, lambda x: x.rlike(p))


def line_dedup(lines: Column) -> Column:
    """Distinct lines, each where it stands first."""
    return F.array_distinct(lines)


def head_tail(lines: Column, max_lines: int = 50, head_ratio: float = 0.5) -> Column:
    head = int(max_lines * head_ratio)

    def cut(x: Column) -> Column:
        n = F.size(x)
        ends = F.concat(F.slice(x, 1, head), F.slice(x, n - (max_lines - head) + 1, max_lines - head))
        return F.when(n <= max_lines, x).otherwise(ends)

    return bound(lines, cut)


def smart_truncate(lines: Column, max_lines: int = 50, head_ratio: float = 0.5, priority_lines: str | None = None) -> Column:
    """Priority lines and, in what they leave, the first and last others; of too many priority lines the first and last.

    One pass marks the lines, a second keeps the marked ones and those before and after the bounds of the cut: the
    positions of the first other line that goes and of the first one of the tail.
    """
    p = java_pattern(priority_lines)
    if p is None:
        return head_tail(lines, max_lines, head_ratio)

    def chosen(s: Column) -> Column:  # marked: the lines and whether they have priority; others: positions of the rest
        room = F.lit(max_lines) - (F.size(s["marked"]) - F.size(s["others"]))
        head = (room * F.lit(float(head_ratio))).cast("int")
        edges = F.struct(F.get(s["others"], head).alias("low"), F.get(s["others"], F.size(s["others"]) - (room - head)).alias("high"))
        few = bound(edges, lambda e: F.filter(s["marked"], lambda x, i: x["p"] | (i < e["low"]) | F.coalesce(i >= e["high"], F.lit(False))))
        first = F.filter(s["marked"], lambda x: x["p"])
        return F.when(room < 0, head_tail(first["x"], max_lines, head_ratio)).otherwise(few["x"])

    def cut(x: Column) -> Column:
        marked = F.transform(x, lambda y: F.struct(y.alias("x"), y.rlike(p).alias("p")))
        others = lambda m: F.filter(F.transform(m, lambda y, i: F.when(~y["p"], i)), lambda i: i.isNotNull())
        return F.when(F.size(x) <= max_lines, x).otherwise(bound(bound(marked, lambda m: F.struct(m.alias("marked"), others(m).alias("others"))), chosen))

    return bound(lines, cut)


def on_empty(lines: Column, fallback: str = EMPTY_OUTPUT) -> Column:
    empty = lambda x: (F.size(x) == 0) | ((F.size(x) == 1) & is_blank(F.get(x, F.lit(0))))
    return bound(lines, lambda x: F.when(empty(x), F.array(F.lit(fallback))).otherwise(x))


def tee_ref(raw: Column) -> Column:
    return F.concat(F.lit("tee:"), F.sha2(raw, 256))


def _truncated(s: Stage, notice: Column) -> Callable[[Column], Column]:
    def cut(x: Column) -> Column:
        return smart_truncate(x, s.max_lines, s.head_ratio, s.priority_lines) if s.name == "smart_truncate" else head_tail(x, s.max_lines, s.head_ratio)

    return lambda x: F.when(F.size(x) > s.max_lines, F.concat(cut(x), notice)).otherwise(x)


def run(text: Column, stages: Iterable[Stage | dict]) -> Column:
    """The text after the stages; null stays null and empty text empty."""
    before, after = CUT_NOTICE.split("{}")
    lines = lines_of(text)
    for s in (x if isinstance(x, Stage) else Stage.of(x) for x in stages):
        if s.enabled is False:
            continue
        if s.name in ("smart_truncate", "head_tail"):
            notice = F.array(F.concat(F.lit(before), tee_ref(text), F.lit(after)))
            lines = bound(lines, _truncated(s, notice))
        else:
            step = {
                "strip_ansi": lambda x: strip_ansi(x),
                "regex_replace": lambda x, s=s: regex_replace(x, s.pattern, s.replacement),
                "regex_drop": lambda x, s=s: regex_drop(x, s.pattern),
                "regex_keep": lambda x, s=s: regex_keep(x, s.pattern),
                "line_dedup": lambda x: line_dedup(x),
                "on_empty": lambda x, s=s: on_empty(x, s.fallback),
            }.get(s.name)
            lines = step(lines) if step else lines
    return F.when(text == "", "").otherwise(F.array_join(lines, "\n"))


def is_cut(output: Column, text: Column) -> Column:
    before, after = CUT_NOTICE.split("{}")
    return F.contains(output, F.concat(F.lit(before), tee_ref(text), F.lit(after)))
