"""Answer extraction, number parsing and scoring with exact decimals, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.text import let, strip

#: Fixed values of the scoring contract: statuses, the form of an answer line, tolerances.
OK, NO_LINE, NON_NUMERIC = "ok", "no_answer_line", "non_numeric_answer"
PLAIN_NUMBER = r"^-?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"
ANSWER_LINE = r"(?imdU)^\s*answer\b\s*[:\-–]?\s*(.*?)\s*$"
REL_TOL, REL_FROM, ABS_TOL = "0.001", "1000", "0.01"
#: Digits of exact values. Anything larger or finer is compared as a double.
DECIMAL = "decimal(26,12)"
_NULL_NUMBER = f"struct<exact:decimal(29,14),approx:double,is_percent:boolean>"


def parse_number(raw: Column) -> Column:
    """A struct ``exact decimal, approx double, is_percent`` for a clean number, else null.

    Currency signs, thousands separators, percent signs, parentheses for negatives and Unicode minus signs are read, in that
    fixed order; whatever is left must be a plain decimal with an optional exponent.
    """
    s = strip(F.translate(raw, "−–—", "---"))
    s = strip(F.regexp_replace(s, "^`+|`+$", ""))
    s = strip(F.regexp_replace(s, "^[\"']+|[\"']+$", ""))
    s = strip(F.regexp_replace(s, r"\\{1,2}[nt]", " "))

    def unwrap(t: Column) -> Column:
        negative = t.startswith("(") & t.endswith(")") & (F.length(t) > 1)
        inner = F.when(negative, strip(F.substring(t, F.lit(2), F.length(t) - 2))).otherwise(t)
        return F.struct(inner.alias("t"), negative.alias("negative"))

    def unpercent(b: Column) -> Column:
        t = b["t"]
        sign, word = t.endswith("%"), F.lower(t).endswith("percent")
        cut = F.when(sign, strip(F.substring(t, F.lit(1), F.length(t) - 1))).when(word, strip(F.substring(t, F.lit(1), F.length(t) - 7))).otherwise(t)
        return F.struct(F.replace(F.regexp_replace(cut, r"(?U)^[$€£]\s*", ""), F.lit(","), F.lit("")).alias("t"), b["negative"].alias("negative"), (sign | word).alias("percent"))

    def value(r: Column) -> Column:
        # A value with more than 12 places would be rounded by the cast: it has no exact form here.
        places = F.length(F.regexp_extract(r["t"], r"\.(\d*)", 1))
        exact = F.when((places <= 12) & ~F.lower(r["t"]).contains("e-1"), r["t"].try_cast(DECIMAL))
        approx = r["t"].try_cast("double")
        exact, approx = F.when(r["negative"], -exact).otherwise(exact), F.when(r["negative"], -approx).otherwise(approx)
        exact = F.when(r["percent"], (exact * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(29,14)")).otherwise(exact.cast("decimal(29,14)"))
        number = F.struct(exact.alias("exact"), F.when(r["percent"], approx / 100).otherwise(approx).alias("approx"), r["percent"].alias("is_percent"))
        return F.when(r["t"].rlike(PLAIN_NUMBER), number).otherwise(F.lit(None).cast(_NULL_NUMBER))

    return let(let(let(s, unwrap), unpercent), value)


def extract_answer(output: Column) -> Column:
    """A struct ``status, raw, number, n_answer_lines`` for the last answer line of an output that has something on it."""
    none = F.array().cast("array<string>")
    found = F.when(strip(F.coalesce(output, F.lit(""))) == "", none).otherwise(F.regexp_extract_all(output, F.lit(ANSWER_LINE), F.lit(1)))

    def last(lines: Column) -> Column:
        return F.struct(F.size(lines).alias("n"), F.try_element_at(F.filter(F.transform(lines, strip), lambda x: x != ""), F.lit(-1)).alias("raw"))

    def number(g: Column) -> Column:
        return F.struct(g["n"].alias("n"), g["raw"].alias("raw"), parse_number(g["raw"]).alias("number"))

    def finish(g: Column) -> Column:
        status = F.when(g["n"] == 0, NO_LINE).when(g["number"].isNull(), NON_NUMERIC).otherwise(OK)
        return F.struct(status.alias("status"), g["raw"].alias("raw"), g["number"].alias("number"), g["n"].alias("n_answer_lines"))

    return let(let(let(F.coalesce(found, none), last), number), finish)


def within_tolerance(value: Column, gold: Column) -> Column:
    """True if two numbers (structs of ``parse_number``) differ by at most 0.001 of a gold from 1000 on, or 0.01 below; exact where both are."""
    d, g = F.abs(value["exact"] - gold["exact"]), F.abs(gold["exact"])
    exact = F.when(g >= F.lit(REL_FROM).cast("decimal(4,0)"), d * F.lit("1000").cast("decimal(4,0)") <= g).otherwise(d <= F.lit(ABS_TOL).cast("decimal(3,2)"))
    da, ga = F.abs(value["approx"] - gold["approx"]), F.abs(gold["approx"])
    approx = F.when(ga >= float(REL_FROM), da <= ga * float(REL_TOL)).otherwise(da <= float(ABS_TOL))
    return F.coalesce(exact, approx)


def score(output: Column, gold: Column) -> Column:
    """A struct ``correct, status, raw, value, gold_value, diff, n_answer_lines``; never raises, null and junk are incorrect."""
    both = F.struct(extract_answer(output).alias("e"), parse_number(gold).alias("g"))

    def judge(b: Column) -> Column:
        e, g = b["e"], b["g"]
        ok = (e["status"] == OK) & g.isNotNull()
        return F.struct(
            F.coalesce(ok & within_tolerance(e["number"], g), F.lit(False)).alias("correct"),
            e["status"].alias("status"),
            e["raw"].alias("raw"),
            e["number"]["approx"].alias("value"),
            g["approx"].alias("gold_value"),
            F.when(ok, F.coalesce(F.abs(e["number"]["exact"] - g["exact"]).cast("double"), F.abs(e["number"]["approx"] - g["approx"]))).alias("diff"),
            e["n_answer_lines"].alias("n_answer_lines"),
        )

    return let(both, judge)


def select_gold(exe: Column, answer: Column) -> Column:
    """A struct ``gold, gold_source, drop_reason``: the executed answer if it parses, else the written one, else why the row is dropped."""
    e, a = parse_number(exe).isNotNull(), parse_number(answer).isNotNull()
    empty = (F.coalesce(exe, F.lit("")) == "") & (F.coalesce(answer, F.lit("")) == "")
    return F.struct(
        F.when(e, exe).when(a, answer).alias("gold"),
        F.when(e, "exe_ans").when(a, "answer_fallback").alias("gold_source"),
        F.when(e | a, F.lit(None).cast("string")).when(empty, "empty_gold").otherwise("non_numeric_gold").alias("drop_reason"),
    )
