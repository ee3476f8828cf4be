"""Text expressions: cleaning, tokens and shingles, names, number formats. All stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the data format.
TOKEN_PATTERN = r"[a-z0-9$.%-]+"
NAMED_OPS = ("divide", "subtract", "add", "multiply")
STOP_MARKERS = ("\n### ", "\n\nANSWER", "\nOkay,")


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def clean_text(c: Column) -> Column:
    """Escape residue (a literal backslash-n or -t, single or doubled) and runs of white space become one space; ends are stripped."""
    plain = F.regexp_replace(c, r"\\{1,2}[nt]", " ")
    return strip(F.regexp_replace(plain, r"(?U)[\s\x1c-\x1f]+", " "))


def tokens(c: Column) -> Column:
    """Lower-case tokens of letters a-z, digits and ``$ . % -``; null gives an empty array."""
    return F.coalesce(F.regexp_extract_all(F.lower(c), F.lit(f"({TOKEN_PATTERN})"), F.lit(1)), F.array().cast("array<string>"))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row, however often the body uses it, also within its own lambdas."""
    return F.transform(F.array(value), body)[0]


def _runs(words: Column, n: int, make, kind: str) -> Column:
    def of(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: make(F.slice(w, i, n)))
        return F.array_distinct(F.when(F.size(w) >= n, runs).otherwise(F.array().cast(f"array<{kind}>")))

    return let(words, of)


def shingles(words: Column, n: int) -> Column:
    """Distinct runs of ``n`` tokens joined by a space; none where there are fewer tokens."""
    return _runs(words, n, lambda run: F.array_join(run, " "), "string")


def shingle_hashes(words: Column, n: int) -> Column:
    """As ``shingles``, each as a 64-bit hash: an eighth of the bytes to shuffle."""
    return _runs(words, n, F.xxhash64, "bigint")


def leading_op(program: Column) -> Column:
    """Group of the operator a program begins with: one of the named ones, ``table_or_tail``, ``tail``, or ``none``."""
    op = F.regexp_extract(strip(program), r"^([a-zA-Z_]+)\(", 1)
    return F.when(F.coalesce(op, F.lit("")) == "", "none").when(op.isin(*NAMED_OPS), op).when(op.startswith("table_"), "table_or_tail").otherwise("tail")


def model_file_name(model: Column) -> Column:
    """A model slug as a file name."""
    return F.replace(F.replace(model, F.lit("/"), F.lit("--")), F.lit("."), F.lit("-"))


def estimated_tokens(c: Column, per_token: float = 3.6) -> Column:
    """Characters by ``per_token``, rounded half to even, at least 1."""
    return F.greatest(F.lit(1), F.bround(F.length(c) / F.lit(per_token), 0).cast("long"))


def cut_at_stops(c: Column, stops: tuple[str, ...] = STOP_MARKERS) -> Column:
    """The text before the first of the stop markers."""
    at = [F.when(F.instr(c, s) > 0, F.instr(c, s)) for s in stops]
    first = F.least(*at) if len(at) > 1 else at[0]
    return F.when(first.isNull(), c).otherwise(F.substring(c, F.lit(1), first - 1))


def head(c: Column, n: int) -> Column:
    """The first ``n`` characters, with an ellipsis where the text goes on."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def significant(c: Column, digits: int = 5) -> Column:
    """General number format: ``digits`` significant digits (ties to even), no trailing zeros, an exponent below 1e-4 and from 10**digits on."""

    def of(x: Column) -> Column:
        size = F.floor(F.log10(F.abs(x)))
        # Java rounds ties up; rounding half to even beforehand leaves no tie. The scale of a rounding has to be a literal.
        even = F.lit(None).cast("double")
        for e in range(-6, 12):
            even = F.when(size == e, F.bround(x, digits - 1 - e)).otherwise(even)
        raw = F.format_string(f"%.{digits}g", F.coalesce(even, x))
        raw = F.regexp_replace(raw, r"(\.\d*?)0+(?=e|$)", "$1")
        return F.when(x == 0, F.lit("0")).otherwise(F.regexp_replace(raw, r"\.(?=e|$)", ""))

    return let(c, of)


def contains_any(c: Column, parts: tuple[str, ...]) -> Column:
    """True if one of ``parts`` occurs in the text; null counts as empty."""
    return reduce(lambda a, b: a | b, [F.coalesce(c.contains(p), F.lit(False)) for p in parts])
