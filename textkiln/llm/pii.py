"""Personal data in text, found with expressions only.

Patterns propose spans, checksums confirm them (Luhn for card numbers, mod 97 for account numbers), words nearby
adjust the score. Offsets count code points; ends are exclusive. Positions come from splitting a text at a pattern:
the pieces and the matches alternate, so running sums of their lengths are the offsets. The sums are kept by runs of
RUN matches, so that what a text costs stays near its length even where it holds a hundred thousand matches.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of an account number by country, blanks not counted (ISO 13616 registry).
IBAN_CHARS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}
IBAN_LISTED = "|".join(" ".join(IBAN_CHARS.values()).split())


def _iban_pattern() -> str:
    """Matches an account number's first four characters; group 1 is all of it, so the next one may start within.

    Countries of the registry: as many characters as theirs have. Other codes: the longest run of 15 to 34 that ends
    where no letter or digit follows.
    """
    sized = [rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_CHARS.items()]
    other = rf"(?!{IBAN_LISTED})[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{11,30}}"
    return rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?=((?:{'|'.join([*sized, other])})(?![A-Za-z0-9])))[A-Z]{{2}}[0-9]{{2}}"


#: Kinds in the order of the output. The patterns match what the plain forms match from left to right, but start
#: only where a run of characters starts (or the last match ended) and never give back what a run has taken, so
#: long runs cost linear time and no stack. Account numbers look ahead by at most 30 characters and as many blanks,
#: so they do too. Card numbers: only runs of 13 to 19 digits.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": _iban_pattern(),
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "secret": r"(?<![A-Za-z0-9+/_-])(?:-----BEGIN (?:[A-Z]++\x20){0,3}PRIVATE KEY-----|[A-Za-z0-9+/_-]{20,}+={0,2})",
}
#: Secrets that show by how they begin; others need a digit, a letter, at most MOST_SECRET characters and a word nearby.
KNOWN_SECRET = r"^(?:-----BEGIN |(?:AKIA|ASIA)[0-9A-Z]{16}$|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10}|sk-[A-Za-z0-9_-]{20}|AIza[0-9A-Za-z_-]{35}$)"
MOST_SECRET = 512
#: A text without this can't match; it is found much faster.
HINTS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
BASE = ("email", "ip", "card", "phone")
#: What a confirmed match scores, what one of these words nearby adds, and the least score that is reported. Nearby is
#: within CONTEXT_CHARS on either side, and not beyond the next match of the kind.
SCORES = {"email": 0.9, "ip": 0.7, "card": 0.9, "phone": 0.7, "iban": 0.8, "ssn": 0.3, "secret": 0.3}
KNOWN_SCORE = 0.9
CONTEXT = {
    "email": ["mail", "contact"],
    "ip": ["ip", "host", "server", "address"],
    "card": ["card", "visa", "credit", "payment"],
    "phone": ["phone", "tel", "call", "mobile"],
    "iban": ["iban", "account", "bank", "konto"],
    "ssn": ["ssn", "social security"],
    "secret": ["token", "secret", "password", "passwd", "pwd", "key", "apikey", "auth", "bearer", "credential"],
}
CONTEXT_ADDS, CONTEXT_CHARS, LEAST = 0.3, 40, 0.5
#: Matches whose offsets are summed up together.
RUN = 256


def _luhn(match: Column) -> Column:
    d = F.split(F.regexp_replace(match, "[^0-9]", ""), "")
    value = lambda x, i: F.when(((F.size(d) - 1 - i) % 2) == 1, F.when(x * 2 > 9, x * 2 - 9).otherwise(x * 2)).otherwise(x)
    digits = F.transform(d, lambda c: c.cast("int"))
    return F.aggregate(F.transform(digits, value), F.lit(0), lambda a, x: a + x) % 10 == 0


def _mod97(match: Column) -> Column:
    s = F.regexp_replace(match, " ", "")
    chars = F.split(F.concat(F.substring(s, 5, 100), F.substring(s, 1, 4)), "")
    step = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.try_to_number(c, F.lit("9")).cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(chars, F.lit(0), lambda a, c: step(a, c).cast("int")) == 1


def _confirmed(kind: str, m: Column) -> Column:
    n = F.length(F.regexp_replace(m, "[^0-9]", ""))
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda x: x.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"))
    if kind == "card":
        return _luhn(m)
    if kind == "phone":
        return n.between(9, 15)
    if kind == "secret":
        return m.rlike(KNOWN_SECRET) | (m.rlike("[0-9]") & m.rlike("[A-Za-z]") & (F.length(m) <= MOST_SECRET))
    return F.lit(True)


def _iban(m: Column) -> Column:
    """The account number that m starts with, or null; of codes without a length the longest that ends at a blank."""
    words = F.split(m, " ")
    prefixes = F.transform(F.sequence(F.size(words), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(words, 1, n), " "))
    found = F.filter(prefixes, lambda x: (F.length(F.regexp_replace(x, " ", "")) >= 15) & _mod97(x))
    return F.when(m.rlike(f"^(?:{IBAN_LISTED})"), F.when(_mod97(m), m)).otherwise(F.get(found, 0))


def _near(kind: str) -> str:
    """A whole word of the kind's context, in lower case; it may be in the plural."""
    return rf"(?<![a-z])(?:{'|'.join(CONTEXT[kind])})s?(?![a-z])"


def spans_of(text: Column, kind: str) -> Column:
    """array<struct<kind, start, end, text, score>> of one kind, by start."""
    p, none = PATTERNS[kind], "array<struct<kind:string,start:int,end:int,text:string,score:double>>"
    found = "array<struct<start:int,end:int,text:string,near:string>>"
    matches = F.regexp_extract_all(text, F.lit(p), F.lit(1 if kind == "iban" else 0))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        m = _iban(x["m"]) if kind == "iban" else x["m"]
        end = start + F.length(m)
        out = F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), m.alias("text"), x["near"].alias("near"))))
        if kind != "iban":
            return F.struct(end.alias("at"), end.alias("last"), out.alias("out"))
        fits = m.isNotNull() & (start >= acc["last"])  # the first of those that overlap
        return F.struct((start + 4).alias("at"), F.when(fits, end).otherwise(acc["last"]).alias("last"), F.when(fits, out).otherwise(acc["out"]).alias("out"))

    def run(acc: Column, some: Column) -> Column:
        state = F.struct(acc["at"].alias("at"), acc["last"].alias("last"), F.array().cast(found).alias("out"))
        summed = F.array(F.aggregate(some, state, step))
        return F.transform(summed, lambda r: F.struct(r["at"].alias("at"), r["last"].alias("last"), F.concat(acc["out"], F.array(r["out"])).alias("out")))[0]

    def runs(pairs: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(pairs) - 1, F.lit(0)), F.lit(RUN)), lambda i: F.slice(pairs, i + 1, RUN))

    def pairs(pieces: Column) -> Column:  # each match, what lies between it and the last one, and what is near
        parts = F.zip_with(pieces, matches, lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("m"), F.substring(g, -CONTEXT_CHARS, CONTEXT_CHARS).alias("near")))
        after = F.slice(pieces, 2, F.size(pieces))
        # What follows an account number's first four characters begins with the rest of it.
        width = CONTEXT_CHARS + (2 * max(IBAN_CHARS) if kind == "iban" else 0)
        near = lambda x, g: F.concat(x["near"], F.lit(" "), F.substring(g, 1, width))
        joined = F.zip_with(parts, after, lambda x, g: F.struct(x["gap"].alias("gap"), x["m"].alias("m"), near(x, g).alias("near")))
        return F.filter(joined, lambda x: x["m"].isNotNull())

    dealt = F.transform(F.array(F.transform(F.array(F.split(text, p, -1)), pairs)[0]), runs)[0]
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("last"), F.array().cast(f"array<{found}>").alias("out"))
    confirmed = F.filter(F.flatten(F.aggregate(dealt, start, run)["out"]), lambda s: _confirmed(kind, s["text"]))

    def scored(s: Column) -> Column:
        own = F.when(s["text"].rlike(KNOWN_SECRET), F.lit(KNOWN_SCORE)).otherwise(F.lit(SCORES[kind])) if kind == "secret" else F.lit(SCORES[kind])
        score = F.least(F.lit(1.0), own + F.when(F.lower(s["near"]).rlike(_near(kind)), F.lit(CONTEXT_ADDS)).otherwise(F.lit(0.0)))
        return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), score.alias("score"))

    kept = F.filter(F.transform(confirmed, scored), lambda s: s["score"] >= LEAST)
    may = text.contains(HINTS[kind]) if kind in HINTS else F.lit(True)
    return F.when(may & text.rlike(p), kept.cast(none)).otherwise(F.array().cast(none))


def detect(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `pii`: array<struct<kind, start, end, text, score>> by kind as in PATTERNS, then start.

    Null text counts as empty; an empty table stays empty; repeated rows each get their own spans. A column of docs
    named pii is replaced.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn("pii", F.concat(*(spans_of(t, k) for k in PATTERNS)))


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
