"""Reports: one-row JSON documents, markdown tables, and sections kept between markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that a table meant for reading may have.
MOST_ROWS = 10_000


def as_json(df: DataFrame, *columns: str) -> DataFrame:
    """One JSON text per row, nulls kept."""
    cols = columns or tuple(df.columns)
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("json"))


def write_json(df: DataFrame, path: str) -> None:
    """A report of few rows (``MOST_ROWS`` at most, else an error) as one file of JSON lines in the folder ``path``, nulls kept."""
    if df.limit(MOST_ROWS + 1).count() > MOST_ROWS:
        raise ValueError("too many rows for a report")
    as_json(df).coalesce(1).write.mode("overwrite").text(path)


def markdown_line(*cells: Column) -> Column:
    """A row of a markdown table."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(c.cast("string"), F.lit("")) for c in cells]), F.lit(" |"))


def markdown_table(df: DataFrame, *order: str) -> str:
    """A small result as a markdown table; more than ``MOST_ROWS`` rows is an error, not a cut."""
    rows = df.orderBy(*order).limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError("too many rows for a table")
    head = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(head + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows])


def gate_report(comparison: DataFrame, model: str, base: str, gate_set: str) -> str:
    """The comparison of two models as text: a table, the decision on the gate set, and a warning for ids only one of them answered; more than ``MOST_ROWS`` sets are an error, not a cut."""
    rows = comparison.orderBy("eval_set").limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError("too many evaluation sets for a report")
    lines = [f"## {model} against {base}", "", "| set | n | accuracy | interval | base | interval | points | b/c | p |", "|---|---|---|---|---|---|---|---|---|"]
    for r in rows:
        lines.append(f"| {r.eval_set} | {r.n} | {r.acc_a:.4f} | {r.lo_a:.4f} to {r.hi_a:.4f} | {r.acc_b:.4f} | {r.lo_b:.4f} to {r.hi_b:.4f} | {r.delta_points:+.2f} | {r.b}/{r.c} | {r.p:.4g} |")
    lines.append("")
    for r in rows:
        if r.eval_set == gate_set:
            apart = r.lo_a > r.hi_b or r.lo_b > r.hi_a
            lines += [f"- gain {r.delta_points:+.2f} points", f"- intervals {'are apart' if apart else 'overlap'}", f"- gate: {r.gate}", f"- later gate: {r.phase1}"]
        if r.only_a or r.only_b:
            lines.append(f"- warning: {r.eval_set} has {r.only_a} ids of {model} only and {r.only_b} of {base} only")
    return "\n".join(lines)


def upsert_section(text: str, name: str, body: str) -> str:
    """Put ``body`` between the markers of section ``name``, at the end if they are absent; doing it twice changes nothing."""
    begin, end = f"<!-- begin {name} -->", f"<!-- end {name} -->"
    section = f"{begin}\n{body}\n{end}"
    if begin in text and end in text:
        before, rest = text.split(begin, 1)
        return before + section + rest.split(end, 1)[1]
    return (text.rstrip("\n") + "\n\n" if text.strip() else "") + section + "\n"
