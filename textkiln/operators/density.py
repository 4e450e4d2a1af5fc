"""Scores of lines by what they tell, and selection of the best ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textkiln.functions.text import BLANK, bound, stripped
from textkiln.operators.lines import lines_of

# What a line must hold to stay, what marks noise, and the weights.
KEEP = [r"error\[", r"ERROR", r"FAILED", r"panic", r"exception", r"def\s+\w+", r"class\s+\w+", r"import\s+", r"from\s+", r"^\s*[-*]\s"]
DROP = [r"Compiling\s+\w+", r"Finished\s+dev", r"Running\s+\d+\s+test", r"^\s*Downloading", r"^\s*Blocking", r"^\s*Unblocking", r"\d+%\s*\|", r"[#▓░]+", r"^\s*=\s*=\s*=\s*"]
MUST, NOISE, BASE, PER_CHARS, MOST_FOR_LENGTH, FOR_INDENT = 0.9, 0.05, 0.3, 100.0, 0.7, 0.1
LEAST_LINES, LEAST_KEPT, RATIO = 10, 5, 0.5


def _any(patterns: list[str], flags: str) -> str:
    return f"({flags})(?:{'|'.join(patterns)})".replace(r"\s", BLANK)


_KEEP, _DROP = _any(KEEP, "?idU"), _any(DROP, "?dU")
# What a line must contain, in lower case or as it is, to match at all; a search for plain words is far cheaper than the
# patterns. The last row are the characters beyond ASCII that equal a letter of the words when case is ignored.
_KEEP_HINTS = ("error", "failed", "panic", "exception", "def", "class", "import", "from")
_KEEP_ANY_CASE = ("-", "*", "\u017f", "\u212a", "\u0130", "\u0131")
_DROP_HINTS = ("Compiling", "Finished", "Running", "Downloading", "locking", "%", "#", "\u2593", "\u2591", "=")


def _contains(c: Column, words: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, (F.contains(c, F.lit(w)) for w in words))


def _kept_by_pattern(line: Column) -> Column:
    return (_contains(F.lower(line), _KEEP_HINTS) | _contains(line, _KEEP_ANY_CASE)) & line.rlike(_KEEP)


def _noise(line: Column) -> Column:
    return _contains(line, _DROP_HINTS) & line.rlike(_DROP)


def score(line: Column) -> Column:
    s = stripped(line)
    length = F.least(F.length(s) / F.lit(PER_CHARS), F.lit(MOST_FOR_LENGTH))
    indent = F.when(line.rlike(f"(?dU)^{BLANK}"), F.lit(FOR_INDENT)).otherwise(F.lit(0.0))
    return F.when(s == "", F.lit(0.0)).when(_kept_by_pattern(line), F.lit(1.0)).when(_noise(line), F.lit(NOISE)).otherwise(F.lit(BASE) + length + indent)


def _kept_count(n: Column, ratio: float) -> Column:
    return F.greatest(F.lit(LEAST_KEPT), (n * F.lit(float(ratio))).cast("int"))


def _kept(lines: Column, ratio: float) -> Column:
    """0-based numbers of the lines that stay, ascending; lines must be a bound variable."""
    scored = F.transform(lines, lambda x, i: F.struct((-score(x)).alias("less"), i.alias("i")))
    best = bound(_kept_count(F.size(lines), ratio), lambda n: F.filter(F.sort_array(scored), lambda s, k: (k < n) | (s["less"] <= -MUST)))
    return F.when(F.size(lines) <= LEAST_LINES, F.transform(lines, lambda _, i: i)).otherwise(F.sort_array(best["i"]))


def kept_indices(text: Column, ratio: float = RATIO) -> Column:
    """0-based numbers of the lines that stay, ascending; ties go to the earlier line."""
    return bound(lines_of(text), lambda x: _kept(x, ratio))


def drop_indices(text: Column, ratio: float = RATIO) -> Column:
    return bound(lines_of(text), lambda x: F.array_except(F.transform(x, lambda _, i: i), _kept(x, ratio)))


def collapse(text: Column, ratio: float = RATIO) -> Column:
    """Kept lines, with `... [k lines dropped] ...` for every run of others."""
    notice = lambda k: F.when(k > 0, F.array(F.concat(F.lit("... ["), k.cast("string"), F.lit(" lines dropped] ...")))).otherwise(F.array().cast("array<string>"))

    def joined(lines: Column, kept: Column) -> Column:
        body = F.transform(kept, lambda i, j: F.concat(notice(i - F.when(j == 0, F.lit(-1)).otherwise(F.get(kept, j - 1)) - 1), F.array(F.get(lines, i))))
        last = notice(F.size(lines) - 1 - F.get(kept, F.size(kept) - 1))
        return F.array_join(F.concat(F.flatten(body), last), "\n")

    return bound(lines_of(text), lambda x: bound(_kept(x, ratio), lambda k: joined(x, k)))


def scored_lines(docs: DataFrame, key: str, text: str = "text", ratio: float = RATIO) -> DataFrame:
    """The exploded form: key, line_no, line, score, kept. One shuffle by key; it spills, for very long documents."""
    rows = docs.filter(F.col(text).isNotNull()).select(key, F.posexplode(lines_of(F.col(text))).alias("line_no", "line"))
    rows = rows.withColumn("score", score(F.col("line")))
    by = Window.partitionBy(key)
    rank = F.row_number().over(by.orderBy(F.desc("score"), "line_no"))
    n = F.count(F.lit(1)).over(by)
    kept = (n <= LEAST_LINES) | (rank <= _kept_count(n, ratio)) | (F.col("score") >= MUST)
    return rows.withColumn("kept", kept)
