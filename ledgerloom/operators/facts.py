"""Questions derived from time-stamped company facts: selection, deduplication, change and portion candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ledgerloom.operators.sampling import seeded

#: Fixed values of the taxonomy: the concepts asked about and how they are called, and the bounds of a usable fact.
CONCEPTS = {
    "Revenues": "total revenues",
    "RevenueFromContractWithCustomerExcludingAssessedTax": "revenue",
    "NetIncomeLoss": "net income",
    "OperatingIncomeLoss": "operating income",
    "Assets": "total assets",
    "CashAndCashEquivalentsAtCarryingValue": "cash and cash equivalents",
}
CUTOFF, FORMS, FRAME = "2026-01-01", ("10-Q", "10-K"), "CY202"


def entries(docs: DataFrame, concepts: dict[str, str] = CONCEPTS, unit: str = "USD") -> DataFrame:
    """One row per reported entry of the wanted concepts: ``cik``, ``title``, ``concept``, ``label``, ``pos`` and the entry's fields.

    Absent levels of the nested maps give no rows.
    """
    gaap = F.col("facts")["us-gaap"]
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("concept"), F.lit(label).alias("label")) for c, label in concepts.items()]))
    rows = docs.select(F.col("cik_str").alias("cik"), "title", gaap.alias("gaap"), each.alias("c"))
    rows = rows.select("cik", "title", "c.*", F.try_element_at("gaap", F.col("c.concept"))["units"].alias("units"))
    return rows.select("cik", "title", "concept", "label", F.posexplode(F.try_element_at("units", F.lit(unit))).alias("pos", "e")).select("cik", "title", "concept", "label", "pos", "e.*")


def usable(cutoff: str = CUTOFF, forms: tuple[str, ...] = FORMS, frame: str = FRAME, require_start: bool = True) -> Column:
    """A recent fact of a regular report over a known period; absent fields fail."""
    ok = F.col("frame").startswith(frame) & F.col("form").isin(*forms) & (F.col("filed") >= cutoff)
    return F.coalesce(ok & (F.coalesce(F.col("start"), F.lit("")) != "") if require_start else ok, F.lit(False))


def last_of(rows: DataFrame, *keys: str) -> DataFrame:
    """Of entries with the same keys the last reported, at the place of the first (column ``first_pos``)."""
    other = [c for c in rows.columns if c not in keys]
    merged = rows.groupBy(*keys).agg(F.max_by(F.struct(*other), "pos").alias("_r"), F.min("pos").alias("first_pos"))
    return merged.select(*keys, "_r.*", "first_pos")


def number_text(val: Column) -> Column:
    """A figure as written in programs: whole numbers without a point."""
    return F.when(val == F.floor(val), F.format_string("%.0f", val)).otherwise(val.cast("string"))


def changes(facts: DataFrame) -> DataFrame:
    """Period-over-period changes of each company and concept: ``cik``, ``title``, ``concept``, question, program, gold (5 places).

    Facts with the same end and value count once; neighbours by end are compared if neither is zero and the relative change
    lies strictly between 0.0005 and 10.
    """
    once = last_of(facts.where(usable()), "cik", "concept", "end", "val")
    by = W.partitionBy("cik", "concept").orderBy("end", "first_pos")
    pairs = once.withColumn("a", F.lag("val").over(by)).withColumn("a_end", F.lag("end").over(by))
    gold = F.try_divide(F.col("val") - F.col("a"), F.abs("a"))
    pairs = pairs.withColumn("g", gold).where((F.col("a") != 0) & (F.col("val") != 0) & (F.abs("g") > 0.0005) & (F.abs("g") < 10))
    a, b, base = number_text(F.col("a")), number_text(F.col("val")), number_text(F.abs("a"))
    question = F.concat(F.lit("by what percentage did "), F.col("label"), F.lit(" change between the period to "), F.col("a_end"), F.lit(" and the period to "), F.col("end"), F.lit("?"))
    program = F.concat(F.lit("subtract("), b, F.lit(", "), a, F.lit("), divide(#0, "), base, F.lit(")"))
    lines = F.array(*[F.concat_ws(" | ", "label", e, v) for e, v in (("a_end", a), ("end", b))])
    return pairs.select("cik", "title", "concept", question.alias("question"), program.alias("program"), F.bround("g", 5).alias("gold"), F.col("g").alias("ratio"), "filed", lines.alias("lines"), "end", "a_end")


def portions(facts: DataFrame, part: str = "CashAndCashEquivalentsAtCarryingValue", whole: str = "Assets") -> DataFrame:
    """Share of one concept in another at the same period end, strictly between 0.001 and 0.95; columns as ``changes``."""
    ok = facts.where(usable())
    c = last_of(ok.where(F.col("concept") == part), "cik", "end").select("cik", "end", "title", "filed", F.col("val").alias("c"), F.col("label").alias("c_label"))
    a = last_of(ok.where(F.col("concept") == whole), "cik", "end").select("cik", "end", F.col("val").alias("a"), F.col("label").alias("a_label"))
    both = c.join(a, ["cik", "end"]).withColumn("g", F.try_divide("c", "a")).where((F.col("g") > 0.001) & (F.col("g") < 0.95))
    question = F.concat(F.lit("which share of "), F.col("a_label"), F.lit(" was "), F.col("c_label"), F.lit(" at "), F.col("end"), F.lit("?"))
    program = F.concat(F.lit("divide("), number_text(F.col("c")), F.lit(", "), number_text(F.col("a")), F.lit(")"))
    lines = F.array(F.concat_ws(" | ", "c_label", "end", number_text(F.col("c"))), F.concat_ws(" | ", "a_label", "end", number_text(F.col("a"))))
    return both.select("cik", "title", F.lit("portion").alias("concept"), question.alias("question"), program.alias("program"), F.bround("g", 5).alias("gold"), F.col("g").alias("ratio"), "filed", lines.alias("lines"), "end", F.lit(None).cast("string").alias("a_end"))


def context_text(title: Column, lines: Column) -> Column:
    """The context of a derived question: a heading and a line per figure."""
    return F.concat(F.lit("figures from the tagged report of "), title, F.lit("\nline | period end | usd\n"), F.array_join(lines, "\n"))


def build_eval(docs: DataFrame, n_companies: int = 60, n_rows: int = 180, seed: int = 7) -> DataFrame:
    """The time-split evaluation table: candidates of ``n_companies`` companies in seeded order, at most ``n_rows``, with positional ids."""
    chosen = docs.select("cik_str").distinct().orderBy(seeded("cik_str", seed), "cik_str").limit(n_companies)
    facts = entries(docs.join(F.broadcast(chosen), "cik_str", "left_semi"))
    cands = changes(facts).unionByName(portions(facts)).withColumn("_k", F.concat_ws("|", F.col("cik").cast("string"), "question"))
    top = cands.orderBy(seeded("_k", seed), "_k").limit(n_rows)
    place = F.row_number().over(W.orderBy(seeded("_k", seed), "_k")) - 1  # at most n_rows rows reach this window
    return top.select(
        F.concat(F.lit("facts-"), place.cast("string")).alias("id"),
        F.lit("time_split").alias("split"),
        "question",
        context_text(F.col("title"), F.col("lines")).alias("context"),
        F.col("gold").cast("string").alias("gold"),
        F.lit("xbrl_computed").alias("gold_source"),
        "program",
        F.col("title").alias("company"),
        "filed",
    )
