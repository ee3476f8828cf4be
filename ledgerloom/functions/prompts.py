"""Prompts: three named templates, worked examples, and the message records made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What every prompt asks for at its end.
CONTRACT = (
    "How to answer:\n- Work in short steps and quote the figures you use.\n"
    "- Then give one line that begins with Program: and lists calls such as subtract(a, b), divide(#0, b); #0 is the first result.\n"
    "- Close with one line that begins with ANSWER: and holds the number alone."
)
LEADS = {
    "zero_shot": "Use the report below to answer the question.",
    "cot": "Use the report below to answer the question. Read the table with care and reason before you settle on a figure.",
    "few_shot": "Below are solved cases. Treat the last one, which is open, in the same way.",
}
ARMS = tuple(LEADS)
_TAIL = {"zero_shot": "### Response", "cot": "### Response\nFirst, the figures that matter:", "few_shot": "### Response"}


def render_prompt(arm: str, question: Column, context: Column, exemplars: str = "") -> Column:
    """The prompt of ``arm`` for a question on a context. Parts are put together, never searched, so braces in a text are inert."""
    if arm not in LEADS:
        raise KeyError(arm)
    shown = [F.lit(exemplars)] if arm == "few_shot" else []
    return F.concat_ws("\n\n", F.lit(LEADS[arm]), *shown, F.concat(F.lit("### Context\n"), context), F.concat(F.lit("### Question\n"), question), F.lit(CONTRACT), F.lit(_TAIL[arm]))


def load_exemplars(spark: SparkSession, path: str, most: int = 100) -> list[dict]:
    """The worked examples, ordered by id; more than ``most`` is an error, since they become part of every prompt."""
    rows = spark.read.parquet(path).select("id", "context", "question", "solution").orderBy("id").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} exemplars")
    return [r.asDict() for r in rows]


#: The layout of a worked example is a fixed format of the prompts.
def exemplar_block(exemplars: list[dict]) -> str:
    """Worked examples as one text, separated by a rule."""
    return "\n\n---\n\n".join(f"### Context\n{e['context']}\n\n### Question\n{e['question']}\n\n### Response\n{e['solution']}" for e in exemplars)


def exemplar_skeletons(examples: DataFrame, ids: tuple[str, ...]) -> DataFrame:
    """The chosen examples with a blank solution, to be filled in by hand; an id that is absent is an error."""
    chosen = examples.where(F.col("id").isin(*ids)).select("id", "context", "question", F.lit("").alias("solution"))
    have = {r["id"] for r in chosen.select("id").collect()}
    if missing := sorted(set(ids) - have):
        raise ValueError(f"not among the examples: {missing}")
    return chosen


def messages(user: Column, assistant: Column) -> Column:
    """The two messages of a training record."""
    one = [F.struct(F.lit(role).alias("role"), text.alias("content")) for role, text in (("user", user), ("assistant", assistant))]
    return F.array(*one)


def message_text(msgs: Column, k: int) -> Column:
    """Content of message ``k``; null where there is none."""
    return F.get(msgs, F.lit(k))["content"]
