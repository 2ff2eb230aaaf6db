"""Personal data in whole texts, with DataFrame expressions only.

Regular expressions propose spans of each kind; checksum and range validators confirm them (Luhn for cards, mod-97 for
bank account numbers, parts of at most 255 for addresses, digit counts for phones); words near a span move its score.
Positions come from splitting the text by the same pattern that extracts the matches: a match starts where the pieces
and matches before it end. All positions are code points, ends exclusive.

The Java patterns below match what the plain ones in the comments match, but cannot recurse or backtrack over long
runs: a repetition that is followed by nothing it could give back is possessive, and a match may only start where the
run starts or the match before it has ended.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban")
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # [A-Z]{2}[0-9]{2}(\x20?[A-Z0-9]{4}){2,7}(\x20?[A-Z0-9]{1,3})? : country, check digits, groups of four
    "iban": r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+",
}
#: What a text must hold for a pattern to match at all; tested before the pattern runs.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
#: Words that speak for a kind when they stand within WINDOW code points before or after a span.
CONTEXT = {
    "email": "mail|contact|write|reach",
    "ip": "ip|address|server|host|login",
    "card": "card|visa|credit|debit|payment|pay",
    "phone": "phone|call|tel|mobile|fax|contact",
    "iban": "iban|bank|account|transfer|konto",
}
WINDOW = 40
#: Score of a span by its kind's evidence: pattern alone, or pattern and checksum; a context word adds CONTEXT_GAIN.
PATTERN_SCORE = {"email": 0.7, "ip": 0.5, "card": 0.8, "phone": 0.5, "iban": 0.9}
CONTEXT_GAIN = 0.1

_DIGITS_DOUBLED = "0246813579"  # digit sum of twice the digit


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes: every second digit from the right is doubled, the sum ends in 0."""
    r = F.reverse(digits)
    at = F.sequence(F.lit(1), F.length(digits))
    value = lambda i: F.when(i % 2 == 1, r.substr(i, F.lit(1))).otherwise(F.translate(r.substr(i, F.lit(1)), "0123456789", _DIGITS_DOUBLED)).cast("int")
    return F.aggregate(at, F.lit(0), lambda s, i: s + value(i)) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number (spaces removed) passes: first four moved to the end, letters as 10..35, remainder 1."""
    moved = F.concat(F.substring(iban, 5, 40), F.substring(iban, 1, 4))
    def step(rest: Column, i: Column) -> Column:
        n = F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), moved.substr(i, F.lit(1))) - 1
        return F.when(n < 10, (rest * 10 + n) % 97).otherwise((rest * 100 + n) % 97)
    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), step) == 1


def valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        small = lambda p: F.when(F.length(F.regexp_replace(p, "^0+", "")) <= 3, F.substring(p, -3, 3).cast("int") <= 255).otherwise(False)
        return F.forall(F.split(match, r"\."), small)
    if kind == "card":
        return F.when(n.between(16, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return n.between(8, 15)
    if kind == "iban":
        plain = F.regexp_replace(match, " ", "")
        return F.when(F.length(plain).between(15, 34), mod97(plain)).otherwise(False)
    return F.lit(True)


_SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"
#: Matches taken in one piece, and code points in a block of text. No step costs more than a piece or block for each match.
PIECE, BLOCK = 256, 256


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def _walk(items: Column, total: Callable[[Column], Column], join: Callable[[Column, Column], Column], step: Callable[[Column, Column], Column], none: Column) -> Column:
    """What aggregate(items, struct(0 as at, none as out), step).out has, in pieces: an array that grows by one element a
    step is copied as often. total: of a piece, what its steps do to `at`; join: of `at` and a total."""

    def solve(parts: Column) -> Column:
        bases = F.aggregate(F.transform(parts, total), F.array(F.lit(0)), lambda a, t: F.concat(a, F.array(join(F.element_at(a, -1), t))))
        of = lambda part, at: F.aggregate(part, F.struct(at.alias("at"), none.alias("out")), step)["out"]
        return _let(bases, lambda at: F.flatten(F.transform(parts, lambda part, k: of(part, at[k]))))

    pieces = lambda x: F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(x) - 1, F.lit(0)) / PIECE).cast("int")), lambda k: F.slice(x, k * PIECE + 1, PIECE))
    return _let(items, lambda x: _let(pieces(x), solve))


def _blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def _between(blocks: Column, start: Column, end: Column) -> Column:
    """The code points from start up to end of a text in blocks."""
    a, b = F.floor(start / BLOCK).cast("int"), F.floor(end / BLOCK).cast("int")
    block = lambda k: F.coalesce(F.get(blocks, k), F.lit(""))
    far = F.concat(F.substr(block(a), start % BLOCK + 1), F.array_join(F.slice(blocks, a + 2, F.greatest(b - a - 1, F.lit(0))), ""), F.substr(block(b), F.lit(1), end % BLOCK))
    return F.when(a == b, F.substr(block(a), start % BLOCK + 1, end - start)).otherwise(far)


def _score(kind: str, blocks: Column, start: Column, end: Column) -> Column:
    before = _between(blocks, F.greatest(start - WINDOW, F.lit(0)), start)
    near = F.lower(F.concat(before, F.lit(" "), _between(blocks, end, end + WINDOW)))
    return F.lit(PATTERN_SCORE[kind]) + F.when(near.rlike(rf"(?:^|[^a-z0-9])(?:{CONTEXT[kind]})"), CONTEXT_GAIN).otherwise(0.0)


def spans_of(kind: str, text: Column) -> Column:
    """array<struct<kind, start, end, score>> of a kind's confirmed spans in order; empty for a null text."""
    p = PATTERNS[kind]
    matches = F.regexp_extract_all(text, F.lit(p), F.lit(0))
    gaps = F.transform(F.split(text, p, -1), lambda x: F.length(x))
    none = F.array().cast(_SPANS)
    size = lambda x: x["gap"] + F.coalesce(F.length(x["match"]), F.lit(0))

    def step(a: Column, x: Column) -> Column:
        end = a["at"] + size(x)
        found = F.array(F.struct((a["at"] + x["gap"]).alias("start"), end.alias("end")))
        good = x["match"].isNotNull() & valid(kind, x["match"])
        return F.struct(end.alias("at"), F.when(good, F.concat(a["out"], found)).otherwise(a["out"]).alias("out"))

    # A text has one piece more than matches; the last one meets a null match.
    places = _walk(F.arrays_zip(gaps.alias("gap"), matches.alias("match")), lambda part: F.aggregate(part, F.lit(0), lambda t, x: t + size(x)), lambda a, t: a + t, step, F.array().cast("array<struct<start:int,end:int>>"))
    span = lambda blocks: lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), _score(kind, blocks, s["start"], s["end"]).alias("score"))
    scored = _let(places, lambda x: F.when(F.size(x) > 0, _let(_blocks(text), lambda blocks: F.transform(x, span(blocks)))))
    needed = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else text.rlike("[0-9]")
    return F.coalesce(F.when(needed, scored), none)


def with_spans(docs: DataFrame, text_col: str = "text", out_col: str = "pii_spans") -> DataFrame:
    """docs with the confirmed spans of all kinds, by kind as in KINDS and then by start.

    Kinds are searched separately, so spans of different kinds may overlap. A null or empty text has none. A column of
    the input that is named like out_col is replaced; repeated rows and all other columns stay.
    """
    kinds = [fresh(docs, f"{out_col}__{k}") for k in KINDS]
    found = docs.withColumns({c: spans_of(k, F.col(text_col).cast("string")) for c, k in zip(kinds, KINDS)})
    return found.withColumn(out_col, F.concat(*[F.col(c) for c in kinds])).drop(*kinds)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_iban, base_sha256, spans, scores of every row.

    A null or empty text has no spans; null and repeated ids stay, one row each; other columns are ignored; an empty
    table gives no rows. spans: kind:start:end of all spans, comma-joined; base_sha256: the digest of the base kinds' part; scores: the
    spans' scores in the same order, comma-joined.
    """
    found = with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).drop("text")
    base = F.filter("pii_spans", lambda s: s["kind"].isin(*BASE_KINDS))
    of = lambda k: F.filter("pii_spans", lambda s: s["kind"] == k)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii_spans")).alias("spans"), F.array_join(F.transform("pii_spans", lambda s: F.round(s["score"], 3).cast("string")), ",").alias("scores"))


def redact(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Pipeline stage: every span with a score of `least` or more becomes [KIND]; n_chars, if there, follows the text.

    Overlapping spans are replaced together, by the kind of the first. Rows, their number and all other columns stay;
    a null text stays null.
    """
    column = fresh(docs, "pii_spans")
    found = with_spans(docs, out_col=column)
    spans = F.array_sort(F.filter(column, lambda s: s["score"] >= least), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    text = F.col("text")

    def step(a: Column, s: Column) -> Column:
        # What stands between the spans so far and this one, unless they overlap.
        new = F.array(F.struct(a["at"].alias("start"), s["start"].alias("end"), s["kind"].alias("kind")))
        return F.when(s["start"] < a["at"], F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out"))).otherwise(F.struct(s["end"].alias("at"), F.concat(a["out"], new).alias("out")))

    last = lambda part: F.coalesce(F.array_max(F.transform(part, lambda s: s["end"])), F.lit(0))
    gaps = lambda x: _walk(x, last, F.greatest, step, F.array().cast("array<struct<start:int,end:int,kind:string>>"))
    replaced = lambda blocks, x: F.concat(F.array_join(F.transform(gaps(x), lambda g: F.concat(_between(blocks, g["start"], g["end"]), F.lit("["), F.upper(g["kind"]), F.lit("]"))), ""), _between(blocks, last(x), F.length(text)))
    done = _let(spans, lambda x: F.when(F.size(x) > 0, _let(_blocks(text), lambda blocks: replaced(blocks, x))).otherwise(text))
    out = found.withColumn("text", F.when(F.size(column) > 0, done).otherwise(text)).drop(column)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
