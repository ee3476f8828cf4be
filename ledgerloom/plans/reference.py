"""Queries of the evaluation pipeline over the test tables, each with the SQL it is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import answers, program, prompts, text
from ledgerloom.operators import checks, decontam, facts, report, runlog, sampling, stats, training
from ledgerloom.operators.delivery import normal_key
from ledgerloom.session import scratch, table
from ledgerloom.sources import jsonl, raw
from ledgerloom.streaming import runlog as stream

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def wrap(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return wrap


def _examples(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "examples")


def _log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "run_log")


def _train(spark: SparkSession, d: str) -> DataFrame:
    return _examples(spark, d).where("split = 'train'")


# ---- text -------------------------------------------------------------------------------------------------------

_SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


@query(f"""SELECT id, md5(regexp_replace(regexp_replace(regexp_replace(question, '\\\\{{1,2}}[nt]', ' ', 'g'), '{_SPACE}+', ' ', 'g'), '^ | $', '', 'g')) AS h
FROM examples""")
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    """Questions without escape residue and odd spacing (as md5)."""
    return _examples(spark, d).select("id", F.md5(text.clean_text(F.col("question"))).alias("h"))


@query("""SELECT id, len(t) AS n_tokens, len(list_distinct(list_transform(CASE WHEN len(t) >= 8 THEN range(1, len(t) - 6) ELSE [] END, lambda i: array_to_string(t[i:i+7], ' ')))) AS n_shingles
FROM (SELECT id, regexp_extract_all(lower(context), '[a-z0-9$.%-]+') AS t FROM examples)""")
def shingle_counts(spark: SparkSession, d: str) -> DataFrame:
    """Tokens and distinct 8-token shingles of every context."""
    t = text.tokens(F.col("context"))
    return _examples(spark, d).select("id", F.size(t).alias("n_tokens"), F.size(text.shingles(t, 8)).alias("n_shingles"))


@query("""SELECT id, CASE WHEN op = '' THEN 'none' WHEN op IN ('divide', 'subtract', 'add', 'multiply') THEN op WHEN starts_with(op, 'table_') THEN 'table_or_tail' ELSE 'tail' END AS op_group
FROM (SELECT id, coalesce(regexp_extract(trim(program), '^([a-zA-Z_]+)\\(', 1), '') AS op FROM examples)""")
def op_groups(spark: SparkSession, d: str) -> DataFrame:
    """Leading operator of every program."""
    return _examples(spark, d).select("id", text.leading_op(F.col("program")).alias("op_group"))


@query("SELECT row_id, replace(replace(model, '/', '--'), '.', '-') AS file_name FROM run_log")
def model_file_names(spark: SparkSession, d: str) -> DataFrame:
    """Model slugs as file names."""
    return _log(spark, d).select("row_id", text.model_file_name(F.col("model")).alias("file_name"))


@query("""SELECT row_id, length(CASE WHEN k = 0 THEN output ELSE left(output, k - 1) END) AS n_chars FROM (
SELECT row_id, output, coalesce(least(nullif(instr(output, chr(10) || '### '), 0), nullif(instr(output, chr(10) || chr(10) || 'ANSWER'), 0), nullif(instr(output, chr(10) || 'Okay,'), 0)), 0) AS k FROM run_log)""")
def stop_cut(spark: SparkSession, d: str) -> DataFrame:
    """Length of every output up to the first stop marker."""
    return _log(spark, d).select("row_id", F.length(text.cut_at_stops(F.col("output"))).alias("n_chars"))


# ---- answers ----------------------------------------------------------------------------------------------------


@query("SELECT row_id, status, n_answer_lines, round(CAST(extracted AS DOUBLE), 9) + 0.0 AS value FROM run_log")
def answer_extract(spark: SparkSession, d: str) -> DataFrame:
    """The answer read from every output; held against what the log's own scorer noted."""
    e = answers.extract_answer(F.col("output"))
    return _log(spark, d).select("row_id", e.alias("e")).select("row_id", F.col("e.status").alias("status"), F.col("e.n_answer_lines").alias("n_answer_lines"), (F.round("e.number.approx", 9) + 0.0).alias("value"))


@query("SELECT row_id, correct FROM run_log")
def score_flags(spark: SparkSession, d: str) -> DataFrame:
    """Whether every output is right; held against what the log's own scorer noted."""
    return _log(spark, d).select("row_id", answers.score(F.col("output"), F.col("gold"))["correct"].alias("correct"))


@query("""SELECT c_custkey, round(c_acctbal, 2) AS value, c_custkey % 3 = 2 AS is_percent FROM customer""")
def answer_parse(spark: SparkSession, d: str) -> DataFrame:
    """Balances written as currency, in parentheses, or as percentages, and read back."""
    c, k = F.round("c_acctbal", 2), F.col("c_custkey") % 3
    money = F.format_number(F.abs(c), 2)
    signed = F.when(c < 0, F.concat(F.lit("($"), money, F.lit(")"))).otherwise(F.concat(F.lit("$ "), money))
    written = F.when(k == 2, F.concat(F.format_string("%.4f", c * 100), F.lit(" percent"))).when(k == 1, F.replace(F.format_string("%.2f", c), F.lit("-"), F.lit("−"))).otherwise(signed)
    n = answers.parse_number(written)
    return table(spark, d, "customer").select("c_custkey", F.round(n["approx"], 2).alias("value"), n["is_percent"].alias("is_percent"))


_ARM = "lower(regexp_replace(arm, '^\\s+|\\s+$', '', 'g'))"


@query(f"""SELECT {_ARM} AS arm, status, count(*) AS n FROM run_log GROUP BY 1, status""")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    """Statuses per arm, from the outputs themselves."""
    s = answers.extract_answer(F.col("output"))["status"].alias("status")
    return _log(spark, d).select(normal_key("arm").alias("arm"), s).groupBy("arm", "status").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT arm, array_to_string(list_sort(list(status || '=' || n)), ',') AS counts FROM (SELECT {_ARM} AS arm, status, count(*) AS n FROM run_log GROUP BY 1, status) GROUP BY arm""")
def status_maps(spark: SparkSession, d: str) -> DataFrame:
    """The same as a map per arm, written out."""
    m = stats.status_map(runlog.normalized(_log(spark, d)), ("arm",))
    pairs = F.transform(F.map_entries("status_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return m.select("arm", F.array_join(F.sort_array(pairs), ",").alias("counts"))


_FAULTY = """faulty AS (SELECT id, split, question, context, CASE WHEN starts_with(md5(id), '0') THEN 'not meaningful' ELSE gold END AS gold,
CASE WHEN starts_with(md5(id), '1') THEN 'table_max(sales, none)' WHEN starts_with(md5(id), '2') THEN 'add(987654321, 1)' ELSE program END AS program FROM examples)"""


def _faulty(spark: SparkSession, d: str) -> DataFrame:
    """All examples, some with faults planted by rule: golds without a figure, table operations, figures that no context shows."""
    h = F.md5("id")
    program_ = F.when(h.startswith("1"), "table_max(sales, none)").when(h.startswith("2"), "add(987654321, 1)").otherwise(F.col("program"))
    return _examples(spark, d).withColumns({"gold": F.when(h.startswith("0"), "not meaningful").otherwise(F.col("gold")), "program": program_})


_BAD_GOLD = "bad AS (SELECT id, split, gold, 'non_numeric_answer' AS status FROM faulty WHERE gold IS NULL OR NOT regexp_matches(gold, '[0-9]'))"


@query(f"WITH {_FAULTY}, {_BAD_GOLD} SELECT * FROM bad")
def gold_smoke(spark: SparkSession, d: str) -> DataFrame:
    """Golds that do not score themselves as correct, with faults planted."""
    return checks.gold_self_score(_faulty(spark, d))


@query(f"WITH {_FAULTY}, {_BAD_GOLD} SELECT split || ':' || status AS key, count(*) AS n FROM bad GROUP BY ALL")
def gold_failures(spark: SparkSession, d: str) -> DataFrame:
    """How many golds fail, by split and status."""
    return checks.failure_histogram(checks.gold_self_score(_faulty(spark, d)))


@query(f"WITH {_FAULTY}, {_BAD_GOLD} SELECT * FROM bad ORDER BY split, id LIMIT 15")
def gold_failures_head(spark: SparkSession, d: str) -> DataFrame:
    """The first fifteen failures. (A head operator.)"""
    return checks.first_failures(checks.gold_self_score(_faulty(spark, d)))


@query("""SELECT split, count(*) AS n_raw, CAST(count_if(regexp_matches(gold, '[0-9]')) AS BIGINT) AS n_kept, CAST(count_if(gold_source = 'answer_fallback') AS BIGINT) AS n_fallback FROM examples GROUP BY split""")
def gold_selection(spark: SparkSession, d: str) -> DataFrame:
    """Golds chosen with fallback: the executed answer is there unless the table says the fallback was used."""
    exe = F.when(F.col("gold_source") != "answer_fallback", F.col("gold"))
    rows = _examples(spark, d).select("split", answers.select_gold(exe, F.col("gold")).alias("g"))
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n_raw"), F.count("g.gold").alias("n_kept"), F.count_if(F.col("g.gold_source") == "answer_fallback").alias("n_fallback"))


# ---- programs and training records --------------------------------------------------------------------------------

_RUN = """calls AS (SELECT id, split, question, context, program, gold, regexp_extract_all(coalesce(program, ''), '(\\w+)\\(([^)]*)\\)', 1) AS ops,
regexp_extract_all(coalesce(program, ''), '(\\w+)\\(([^)]*)\\)', 2) AS args FROM examples),
one AS (SELECT *, CASE WHEN starts_with(trim(split_part(args[1], ',', 2)), 'const_') THEN CAST(replace(trim(split_part(args[1], ',', 2)), 'const_', '') AS DOUBLE) ELSE try_cast(trim(split_part(args[1], ',', 2)) AS DOUBLE) END AS y1,
try_cast(trim(split_part(args[1], ',', 1)) AS DOUBLE) AS x1 FROM calls),
first AS (SELECT *, CASE ops[1] WHEN 'add' THEN x1 + y1 WHEN 'subtract' THEN x1 - y1 WHEN 'multiply' THEN x1 * y1 WHEN 'divide' THEN x1 / nullif(y1, 0) END AS v1 FROM one),
two AS (SELECT *, CASE WHEN trim(split_part(args[2], ',', 1)) = '#0' THEN v1 ELSE try_cast(trim(split_part(args[2], ',', 1)) AS DOUBLE) END AS x2,
CASE WHEN starts_with(trim(split_part(args[2], ',', 2)), 'const_') THEN CAST(replace(trim(split_part(args[2], ',', 2)), 'const_', '') AS DOUBLE) ELSE try_cast(trim(split_part(args[2], ',', 2)) AS DOUBLE) END AS y2 FROM first),
run AS (SELECT *, CASE len(ops) WHEN 1 THEN v1 WHEN 2 THEN CASE ops[2] WHEN 'add' THEN x2 + y2 WHEN 'subtract' THEN x2 - y2 WHEN 'multiply' THEN x2 * y2 WHEN 'divide' THEN x2 / nullif(y2, 0) END END AS value,
CASE WHEN regexp_full_match(trim(gold), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN CAST(trim(gold) AS DOUBLE) END AS g FROM two),
outcome AS (SELECT *, CASE WHEN regexp_matches(coalesce(program, ''), 'table_(average|max|min|sum)') THEN 'table_op' WHEN value IS NULL OR g IS NULL THEN 'parse_error'
WHEN abs(value - g) > CASE WHEN abs(g) >= 1000 THEN abs(g) * 0.001 ELSE 0.01 END THEN 'mismatch' ELSE 'kept' END AS disposition FROM run)"""


@query(f"WITH {_RUN} SELECT id, round(value, 6) AS value, value IS NULL AS failed FROM run")
def program_exec(spark: SparkSession, d: str) -> DataFrame:
    """Every program executed."""
    r = program.execute(F.col("program"))
    return _examples(spark, d).select("id", r.alias("r")).select("id", F.round("r.value", 6).alias("value"), F.col("r.error").isNotNull().alias("failed"))


@query(f"WITH {_RUN} SELECT id, disposition FROM outcome WHERE split = 'train'")
def program_dispositions(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of every training example."""
    return training.dispositions(_train(spark, d)).select("id", "disposition")


@query(f"WITH {_RUN} SELECT disposition, count(*) AS n_rows, round(count(*) / sum(count(*)) OVER (), 4) AS share FROM outcome WHERE split = 'train' GROUP BY disposition")
def disposition_report(spark: SparkSession, d: str) -> DataFrame:
    """Training examples per disposition."""
    return training.disposition_report(training.dispositions(_train(spark, d)))


@query("""SELECT op, count(*) AS n_calls FROM (SELECT unnest(regexp_extract_all(coalesce(program, ''), '(\\w+)\\([^)]*\\)', 1)) AS op FROM examples WHERE split = 'train') GROUP BY op""")
def op_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Calls per operator in the training split."""
    return training.op_histogram(_train(spark, d))


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _prompt_sql(arm: str, shown: str = "") -> str:
    parts = [_sql_text(prompts.LEADS[arm]), *([shown] if shown else []), "'### Context\n' || context", "'### Question\n' || question", _sql_text(prompts.CONTRACT), _sql_text(prompts._TAIL[arm])]
    return " || '\n\n' || ".join(parts)


_FIVE = "CASE WHEN {v} = 0 THEN '0' ELSE regexp_replace(regexp_replace(printf('%.5g', {v}), '(\\.[0-9]*?)0+(e|$)', '\\1\\2'), '\\.(e|$)', '\\1') END"
_STEP = "'Step {k}: ' || CASE ops[{k}] WHEN 'add' THEN 'take ' || {a} || ' plus ' || {b} WHEN 'subtract' THEN 'take ' || {a} || ' less ' || {b} WHEN 'multiply' THEN 'take ' || {a} || ' times ' || {b} WHEN 'divide' THEN 'take ' || {a} || ' over ' || {b} END || '; that is ' || {v} || ' (#{i}).'"


def _arg_sql(k: int, j: int) -> str:
    t = f"trim(split_part(args[{k}], ',', {j}))"
    return f"CASE WHEN {t} = '#0' THEN 'the result of step 1' ELSE {t} END"


_STEPS_SQL = " || ".join(
    [
        _STEP.format(k=1, i=0, a=_arg_sql(1, 1), b=_arg_sql(1, 2), v=_FIVE.format(v="v1")),
        "CASE WHEN len(ops) = 2 THEN ' ' || " + _STEP.format(k=2, i=1, a=_arg_sql(2, 1), b=_arg_sql(2, 2), v=_FIVE.format(v="value")) + " ELSE '' END",
    ]
)


@query(f"""WITH {_RUN} SELECT id, md5({_prompt_sql('cot')}) AS prompt, md5({_STEPS_SQL} || '\nProgram: ' || program || '\nANSWER: ' || gold) AS reply
FROM outcome WHERE split = 'train' AND disposition = 'kept'""")
def sft_messages(spark: SparkSession, d: str) -> DataFrame:
    """Training records: prompt and reply of every kept example (as md5)."""
    rows = training.records(training.dispositions(_train(spark, d)))
    return rows.select("id", F.md5(prompts.message_text(F.col("messages"), 0)).alias("prompt"), F.md5(prompts.message_text(F.col("messages"), 1)).alias("reply"))


_LEN = "CAST(greatest(1, round_even(length(array_to_string(list_transform(messages, lambda m: m.content), chr(10))) / 3.6, 0)) AS BIGINT)"


@query(f"SELECT count(*) AS n_records, CAST(count_if(n <= 400) AS BIGINT) AS n_kept, CAST(count_if(n > 400) AS BIGINT) AS n_dropped, max(n) AS longest FROM (SELECT {_LEN} AS n FROM train_records)")
def length_report(spark: SparkSession, d: str) -> DataFrame:
    """Training records within 400 estimated tokens, and beyond."""
    return training.length_report(table(spark, d, "train_records"), 400)


@query(f"SELECT id, count(*) AS n FROM (SELECT id, {_LEN} AS n FROM train_records) WHERE n <= 400 GROUP BY id")
def length_filter(spark: SparkSession, d: str) -> DataFrame:
    """Ids of the records within the limit; longer ones are dropped whole."""
    return training.within_length(table(spark, d, "train_records"), 400).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH v AS (SELECT length(context) AS n, row_number() OVER (ORDER BY length(context)) - 1 AS k, count(*) OVER () AS total FROM examples)
SELECT share, max(n) AS value FROM v, (SELECT unnest([0.5, 0.9, 0.95, 0.99]) AS share) WHERE k = least(CAST(floor(total * share) AS BIGINT), total - 1) GROUP BY share""")
def length_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Lengths of contexts at fixed shares of the sorted list, without interpolation."""
    return training.index_percentiles(_examples(spark, d), F.length("context"))


# ---- decontamination ----------------------------------------------------------------------------------------------

_GRAMS = "CASE WHEN len({t}) >= 8 THEN list_distinct(list_transform(range(1, len({t}) - 6), lambda i: array_to_string({t}[i:i+7], ' '))) ELSE [] END"
_TOK = "regexp_extract_all(lower({c}), '[a-z0-9$.%-]+')"
_SCORES = f"""texts AS (SELECT id, split, 'q' AS field, {_TOK.format(c="question")} AS t FROM examples UNION ALL SELECT id, split, 'c', {_TOK.format(c="context")} FROM examples),
grams AS (SELECT id, split, field, unnest({_GRAMS.format(t="t")}) AS gram FROM texts),
corpus AS (SELECT DISTINCT gram FROM grams WHERE split IN ('dev', 'test')),
met AS (SELECT id, field, count(c.gram) / count(*) AS share FROM grams g LEFT JOIN corpus c ON g.gram = c.gram WHERE split = 'train' GROUP BY id, field),
scores AS (SELECT e.id, coalesce(q.share, 0) AS question_overlap, coalesce(c.share, 0) AS context_overlap FROM examples e
LEFT JOIN met q ON q.id = e.id AND q.field = 'q' LEFT JOIN met c ON c.id = e.id AND c.field = 'c' WHERE split = 'train')"""


def _scores(spark: SparkSession, d: str) -> DataFrame:
    e = _examples(spark, d)
    return decontam.decontaminate(e.where("split = 'train'"), e.where("split in ('dev', 'test')"))


@query(f"WITH {_SCORES} SELECT id, round(question_overlap, 6) AS question_overlap, round(context_overlap, 6) AS context_overlap FROM scores")
def decontam_scores(spark: SparkSession, d: str) -> DataFrame:
    """Shingle containment of every training question and context in the evaluation texts."""
    return _scores(spark, d).select("id", *[F.round(c, 6).alias(c) for c in ("question_overlap", "context_overlap")])


@query(f"WITH {_SCORES} SELECT id FROM scores WHERE question_overlap < 0.5")
def decontam_kept(spark: SparkSession, d: str) -> DataFrame:
    """Training rows that stay."""
    return decontam.kept(_train(spark, d), _scores(spark, d)).select("id")


_Q = ", ".join(f"round(quantile_cont({c}_overlap, {q}), 4) AS {c}_p{int(q * 100)}" for c in ("question", "context") for q in (0.5, 0.9, 0.95, 0.99))


@query(f"WITH {_SCORES} SELECT count(*) AS n_rows, CAST(count_if(question_overlap >= 0.5) AS BIGINT) AS n_dropped, CAST(count_if(question_overlap < 0.5) AS BIGINT) AS n_kept, {_Q} FROM scores")
def decontam_report(spark: SparkSession, d: str) -> DataFrame:
    """Counts and quantiles of the overlaps."""
    return decontam.report(_scores(spark, d))


@query(f"WITH {_SCORES} SELECT id, round(question_overlap, 6) AS question_overlap, round(context_overlap, 6) AS context_overlap FROM scores ORDER BY scores.question_overlap DESC, id LIMIT 5")
def decontam_worst(spark: SparkSession, d: str) -> DataFrame:
    """The five most contaminated training rows."""
    return decontam.worst(_scores(spark, d)).select("id", *[F.round(c, 6).alias(c) for c in ("question_overlap", "context_overlap")])


@query(f"""WITH d AS (SELECT doc_id AS id, {_TOK.format(c="text")} AS t FROM documents), b AS (SELECT item_id AS id, {_TOK.format(c="text")} AS t FROM benchmark),
dg AS (SELECT id, unnest({_GRAMS.format(t="t")}) AS gram FROM d), corpus AS (SELECT DISTINCT unnest({_GRAMS.format(t="t")}) AS gram FROM b),
met AS (SELECT id, count(c.gram) / count(*) AS share FROM dg LEFT JOIN corpus c ON dg.gram = c.gram GROUP BY id)
SELECT d.id AS doc_id, round(coalesce(share, 0), 6) AS text_overlap FROM d LEFT JOIN met ON met.id = d.id""")
def document_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Containment of every document in the held-out passages."""
    got = decontam.containment(table(spark, d, "documents"), "doc_id", ("text",), decontam.corpus(table(spark, d, "benchmark"), ("text",)))
    return got.select("doc_id", F.round("text_overlap", 6).alias("text_overlap"))


# ---- sampling -----------------------------------------------------------------------------------------------------

_BINS = """e AS (SELECT id, CASE WHEN op = '' THEN 'none' WHEN op IN ('divide', 'subtract', 'add', 'multiply') THEN op WHEN starts_with(op, 'table_') THEN 'table_or_tail' ELSE 'tail' END AS op_group, n
FROM (SELECT id, length(context) AS n, coalesce(regexp_extract(trim(program), '^([a-zA-Z_]+)\\(', 1), '') AS op FROM examples WHERE split <> 'train')),
q AS (SELECT quantile_cont(n, 0.25) AS q1, quantile_cont(n, 0.5) AS q2, quantile_cont(n, 0.75) AS q3 FROM e),
b AS (SELECT id, op_group, n, CASE WHEN n <= q1 THEN 0 WHEN n <= q2 THEN 1 WHEN n <= q3 THEN 2 ELSE 3 END AS bin FROM e, q)"""


def _binned(spark: SparkSession, d: str) -> DataFrame:
    rows = _examples(spark, d).where("split <> 'train'").select("id", text.leading_op(F.col("program")).alias("op_group"), F.length("context").alias("n"))
    return sampling.quartile(rows, F.col("n"), "bin")


@query(f"WITH {_BINS} SELECT bin, count(*) AS n_rows, min(n) AS least, max(n) AS most FROM b GROUP BY bin")
def quartile_bins(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation rows by quartile of context length."""
    return _binned(spark, d).groupBy("bin").agg(F.count(F.lit(1)).alias("n_rows"), F.min("n").alias("least"), F.max("n").alias("most"))


_SAMPLE = f"""{_BINS}, r AS (SELECT *, md5('42|' || id) AS h, row_number() OVER (PARTITION BY op_group, bin ORDER BY md5('42|' || id), id) AS rn, count(*) OVER (PARTITION BY op_group, bin) AS ns, count(*) OVER () AS total FROM b),
c AS (SELECT * FROM r WHERE rn <= greatest(1, round_even(ns * (90.0 / total), 0))),
cut AS (SELECT id FROM c ORDER BY h, id LIMIT 90),
more AS (SELECT id FROM r WHERE id NOT IN (SELECT id FROM c) ORDER BY md5('43|' || id), id LIMIT (SELECT greatest(0, 90 - count(*)) FROM c)),
s AS (SELECT id FROM cut UNION ALL SELECT id FROM more)"""


@query(f"WITH {_SAMPLE} SELECT b.id, op_group, bin FROM b WHERE id IN (SELECT id FROM s)")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    """90 evaluation rows, in proportion by operator and length. (A sampling operator.)"""
    return sampling.stratified(_binned(spark, d), ("op_group", "bin"), "id", 90).select("id", "op_group", "bin")


@query(f"""WITH {_SAMPLE}, p AS (SELECT op_group, count(*) / sum(count(*)) OVER () AS share FROM b GROUP BY op_group), t AS (SELECT op_group, count(*) / sum(count(*)) OVER () AS share FROM b WHERE id IN (SELECT id FROM s) GROUP BY op_group)
SELECT p.op_group, round(p.share, 6) AS population_share, round(coalesce(t.share, 0), 6) AS sample_share FROM p LEFT JOIN t ON t.op_group = p.op_group""")
def composition(spark: SparkSession, d: str) -> DataFrame:
    """Operators in the sample beside those in the population."""
    rows = _binned(spark, d)
    return sampling.composition(rows, sampling.stratified(rows, ("op_group", "bin"), "id", 90), "op_group")


@query(f"WITH {_SAMPLE} SELECT CAST(floor((SELECT quantile_cont(n, 0.5) FROM b)) AS BIGINT) AS population_chars, CAST(floor((SELECT quantile_cont(n, 0.5) FROM b WHERE id IN (SELECT id FROM s))) AS BIGINT) AS sample_chars")
def sample_medians(spark: SparkSession, d: str) -> DataFrame:
    """Median context length of the population and of the sample."""
    rows = _binned(spark, d)
    return sampling.medians(rows, sampling.stratified(rows, ("op_group", "bin"), "id", 90), F.col("n"), "chars")


@query("""SELECT id, CASE WHEN row_number() OVER (ORDER BY md5('42|' || id), id) <= round_even(count(*) OVER () * 0.05, 0) THEN 'val' ELSE 'train' END AS part FROM examples WHERE split = 'train'""")
def train_val_split(spark: SparkSession, d: str) -> DataFrame:
    """Five percent of the training rows for validation, exactly."""
    return sampling.seeded_split(_train(spark, d).select("id"), "id", 0.05).select("id", "part")


@query("SELECT id FROM examples WHERE split = 'dev' ORDER BY id LIMIT 20")
def head_examples(spark: SparkSession, d: str) -> DataFrame:
    """The first twenty development examples. (A head operator.)"""
    return sampling.head_of(_examples(spark, d).where("split = 'dev'").select("id"), 20, "id")


# ---- facts --------------------------------------------------------------------------------------------------------

_CONCEPTS = ", ".join(f"('{c}', '{label}')" for c, label in facts.CONCEPTS.items())
_FACTS = f"""c(concept, label) AS (VALUES {_CONCEPTS}),
raw AS (SELECT cik_str AS cik, title, concept, label, facts['us-gaap'][concept].units['USD'] AS es FROM company_facts, c),
entries AS (SELECT cik, title, concept, label, generate_subscripts(es, 1) - 1 AS pos, unnest(es, recursive := true) FROM raw WHERE es IS NOT NULL),
ok AS (SELECT * FROM entries WHERE starts_with(frame, 'CY202') AND start <> '' AND form IN ('10-Q', '10-K') AND filed >= '2026-01-01'),
once AS (SELECT cik, title, concept, label, "end", val, arg_max(filed, pos) AS filed, min(pos) AS first_pos FROM ok GROUP BY ALL),
lagged AS (SELECT *, lag(val) OVER w AS a, lag("end") OVER w AS a_end FROM once WINDOW w AS (PARTITION BY cik, concept ORDER BY "end", first_pos)),
changed AS (SELECT *, (val - a) / abs(a) AS g FROM lagged WHERE a <> 0 AND val <> 0 AND abs((val - a) / abs(a)) > 0.0005 AND abs((val - a) / abs(a)) < 10),
latest AS (SELECT cik, concept, "end", arg_max(val, pos) AS val, arg_max(filed, pos) AS filed FROM ok GROUP BY ALL),
shares AS (SELECT c.cik, c."end", c.val / nullif(a.val, 0) AS g, c.filed FROM latest c JOIN latest a ON a.cik = c.cik AND a."end" = c."end"
WHERE c.concept = 'CashAndCashEquivalentsAtCarryingValue' AND a.concept = 'Assets')"""


@query(f"WITH {_FACTS} SELECT cik, concept, count(*) AS n_entries, count(DISTINCT \"end\") AS n_ends, min(filed) AS first_filed, max(filed) AS last_filed FROM ok GROUP BY cik, concept")
def usable_facts(spark: SparkSession, d: str) -> DataFrame:
    """Usable facts per company and concept."""
    rows = facts.entries(table(spark, d, "company_facts")).where(facts.usable())
    return rows.groupBy("cik", "concept").agg(F.count(F.lit(1)).alias("n_entries"), F.countDistinct("end").alias("n_ends"), F.min("filed").alias("first_filed"), F.max("filed").alias("last_filed"))


@query(f"WITH {_FACTS} SELECT cik, concept, \"end\", val, filed FROM latest")
def fact_last_write(spark: SparkSession, d: str) -> DataFrame:
    """Of refiled facts the last, per company, concept and period."""
    rows = facts.entries(table(spark, d, "company_facts")).where(facts.usable())
    return facts.last_of(rows, "cik", "concept", "end").select("cik", "concept", "end", "val", "filed")


@query(f"WITH {_FACTS} SELECT cik, concept, a_end, \"end\", round(g, 6) AS change, filed FROM changed")
def period_change(spark: SparkSession, d: str) -> DataFrame:
    """Change of every concept from one period to the next."""
    got = facts.changes(facts.entries(table(spark, d, "company_facts")))
    return got.select("cik", "concept", "a_end", "end", F.round("ratio", 6).alias("change"), "filed")


@query(f"WITH {_FACTS} SELECT cik, \"end\", round(g, 6) AS portion, filed FROM shares WHERE g > 0.001 AND g < 0.95")
def portion_join(spark: SparkSession, d: str) -> DataFrame:
    """Cash as a share of assets at the same period end."""
    got = facts.portions(facts.entries(table(spark, d, "company_facts")))
    return got.select("cik", "end", F.round("ratio", 6).alias("portion"), "filed")


_NUM = "printf('%.0f', {x})"
_LINE = "{label} || ' | ' || {end} || ' | ' || " + _NUM
_ENDS = [_LINE.format(label="label", end="a_end", x="a"), _LINE.format(label="label", end='"end"', x="val")]
_PARTS = [_LINE.format(label=f"'{facts.CONCEPTS[c]}'", end='c."end"', x=f"{k}.val") for k, c in (("c", "CashAndCashEquivalentsAtCarryingValue"), ("a", "Assets"))]


@query(f"""WITH {_FACTS}, chosen AS (SELECT cik_str FROM company_facts ORDER BY md5('7|' || cik_str), cik_str LIMIT 60),
cands AS (SELECT cik, title, 'by what percentage did ' || label || ' change between the period to ' || a_end || ' and the period to ' || "end" || '?' AS question,
'subtract(' || {_NUM.format(x="val")} || ', ' || {_NUM.format(x="a")} || '), divide(#0, ' || {_NUM.format(x="abs(a)")} || ')' AS program, round(g, 5) AS gold, filed, {_ENDS[0]} || chr(10) || {_ENDS[1]} AS lines FROM changed
UNION ALL SELECT c.cik, f.title, 'which share of {facts.CONCEPTS["Assets"]} was {facts.CONCEPTS["CashAndCashEquivalentsAtCarryingValue"]} at ' || c."end" || '?', 'divide(' || {_NUM.format(x="c.val")} || ', ' || {_NUM.format(x="a.val")} || ')',
round(c.val / nullif(a.val, 0), 5), c.filed, {_PARTS[0]} || chr(10) || {_PARTS[1]} FROM latest c JOIN latest a ON a.cik = c.cik AND a."end" = c."end" JOIN company_facts f ON f.cik_str = c.cik
WHERE c.concept = 'CashAndCashEquivalentsAtCarryingValue' AND a.concept = 'Assets' AND c.val / nullif(a.val, 0) > 0.001 AND c.val / nullif(a.val, 0) < 0.95),
top AS (SELECT *, row_number() OVER (ORDER BY md5('7|' || cik || '|' || question), cik || '|' || question) AS rn FROM cands WHERE cik IN (SELECT cik_str FROM chosen))
SELECT 'facts-' || (rn - 1) AS id, 'time_split' AS split, question, 'figures from the tagged report of ' || title || chr(10) || 'line | period end | usd' || chr(10) || lines AS context, gold, 'xbrl_computed' AS gold_source, program, title AS company, filed FROM top WHERE rn <= 180""")
def fact_eval_set(spark: SparkSession, d: str) -> DataFrame:
    """The time-split evaluation table, whose programs give their golds. (A sampling operator: 180 rows of 60 companies.)"""
    return facts.build_eval(table(spark, d, "company_facts")).withColumn("gold", F.col("gold").cast("double"))


# ---- prompts and exemplars ----------------------------------------------------------------------------------------

_SHOWN = "(SELECT string_agg('### Context\n' || context || '\n\n### Question\n' || question || '\n\n### Response\n' || solution, '\n\n---\n\n' ORDER BY id) FROM exemplars)"


@query(f"SELECT id, md5({_prompt_sql('zero_shot')}) AS zero_shot, md5({_prompt_sql('cot')}) AS cot, md5({_prompt_sql('few_shot', _SHOWN)}) AS few_shot FROM examples")
def prompt_texts(spark: SparkSession, d: str) -> DataFrame:
    """The prompt of every example for each arm (as md5)."""
    shown = prompts.exemplar_block(prompts.load_exemplars(spark, f"{d}/exemplars.parquet"))
    return _examples(spark, d).select("id", *[F.md5(prompts.render_prompt(a, F.col("question"), F.col("context"), shown)).alias(a) for a in prompts.ARMS])


@query("SELECT e.id, e.split, e.question = x.question AS same_question FROM exemplars x JOIN examples e ON e.id = x.id")
def exemplar_origin(spark: SparkSession, d: str) -> DataFrame:
    """Exemplars found again among the examples."""
    x = table(spark, d, "exemplars").select("id", F.col("question").alias("q"))
    return _examples(spark, d).join(x, "id").select("id", "split", (F.col("question") == F.col("q")).alias("same_question"))


@query("""SELECT id, md5(coalesce(messages[1].content, '')) AS first, md5(coalesce(messages[2].content, '')) AS second, len(messages) AS n FROM train_records""")
def message_parts(spark: SparkSession, d: str) -> DataFrame:
    """First and second message of every training record."""
    m = F.col("messages")
    return table(spark, d, "train_records").select("id", F.md5(F.coalesce(prompts.message_text(m, 0), F.lit(""))).alias("first"), F.md5(F.coalesce(prompts.message_text(m, 1), F.lit(""))).alias("second"), F.size(m).alias("n"))


# ---- run log and statistics -----------------------------------------------------------------------------------------

_PLAIN = "lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'))"
_NORMAL = f"""log AS (SELECT * REPLACE ({_PLAIN.format(c="id")} AS id, {_PLAIN.format(c="arm")} AS arm, {_PLAIN.format(c="eval_set")} AS eval_set,
replace(replace({_PLAIN.format(c="model")}, '/', '--'), '.', '-') AS model) FROM run_log)"""
_FIRST = f"{_NORMAL}, first AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY model, arm, eval_set, id ORDER BY row_id) = 1)"


def _keyed(spark: SparkSession, d: str) -> DataFrame:
    """The run log with its keys in normal form."""
    return runlog.normalized(_log(spark, d))


@query(f"WITH {_FIRST} SELECT row_id FROM first")
def runlog_first_writes(spark: SparkSession, d: str) -> DataFrame:
    """The first row of each id within model, arm and evaluation set."""
    return runlog.first_writes(_keyed(spark, d)).select("row_id")


@query(f"WITH {_NORMAL} SELECT id FROM examples WHERE id NOT IN (SELECT id FROM log WHERE id IS NOT NULL)")
def resume_todo(spark: SparkSession, d: str) -> DataFrame:
    """Examples without an answer yet."""
    return runlog.todo(_examples(spark, d), _keyed(spark, d)).select("id")


@query(f"""WITH {_NORMAL} SELECT row_id, count(*) OVER w AS n_so_far, round(sum(CAST(correct AS INT)) OVER w / count(*) OVER w, 6) AS acc_so_far, round(sum(coalesce(cost_usd, 0)) OVER w, 6) AS cost_so_far
FROM log WINDOW w AS (PARTITION BY model, arm, eval_set ORDER BY row_id)""")
def running_totals(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy and cost as a run goes on."""
    got = runlog.running(_keyed(spark, d), "row_id", ("model", "arm", "eval_set"))
    return got.select("row_id", "n_so_far", F.round("acc_so_far", 6).alias("acc_so_far"), F.round("cost_so_far", 6).alias("cost_so_far"))


@query(f"""WITH p AS (SELECT split, CAST(greatest(1, round_even(length({_prompt_sql('cot')}) / 3.6, 0)) AS BIGINT) AS t FROM examples)
SELECT split, count(*) AS n_rows, CAST(sum(t) AS BIGINT) AS tokens_in, round(sum(t) / 1e6 + count(*) * 700 / 1e6 * 5, 6) AS worst_cost FROM p GROUP BY ROLLUP (split)""")
def cost_estimate(spark: SparkSession, d: str) -> DataFrame:
    """What answering every example would cost at most, per split and in total."""
    rows = _examples(spark, d).select("split", prompts.render_prompt("cot", F.col("question"), F.col("context")).alias("prompt"))
    return runlog.cost_estimate(rows, "prompt", "split")


@query("SELECT row_id, round(n_prompt_tokens / 1e6 + completion_tokens / 1e6 * 5, 9) AS usd FROM run_log WHERE completion_tokens IS NOT NULL")
def call_cost(spark: SparkSession, d: str) -> DataFrame:
    """Cost of every call from its token counts."""
    rows = _log(spark, d).where("completion_tokens is not null")
    return rows.select("row_id", F.round(runlog.token_cost(F.col("n_prompt_tokens"), F.col("completion_tokens")), 9).alias("usd"))


@query(f"WITH {_NORMAL} SELECT model, eval_set, count(DISTINCT id) AS n_done, round(sum(coalesce(cost_usd, 0)), 6) AS cost_usd, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM log GROUP BY model, eval_set")
def run_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Progress per model and evaluation set."""
    return runlog.manifest(_keyed(spark, d)).select("model", "eval_set", "n_done", "cost_usd", F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"))


_LG = "lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1)"
_CELLS = f"""{_FIRST}, cell AS (SELECT model, arm, eval_set, count(*) AS n, CAST(count_if(correct) AS BIGINT) AS k, CAST(count_if(status = 'ok') AS BIGINT) AS n_ok, CAST(count_if(status = 'no_answer_line') AS BIGINT) AS n_none, CAST(count_if(status = 'non_numeric_answer') AS BIGINT) AS n_bad
FROM first GROUP BY ALL),
mass AS (SELECT model, arm, eval_set, n, k, i, sum(CASE WHEN k = 0 THEN CAST(i = 0 AS DOUBLE) WHEN k = n THEN CAST(i = n AS DOUBLE) ELSE exp({_LG.format(n='n', k='i')} + i * ln(k / n) + (n - i) * ln(1 - k / n)) END) OVER (PARTITION BY model, arm, eval_set ORDER BY i) AS cdf
FROM (SELECT *, unnest(range(0, n + 1)) AS i FROM cell)),
ci AS (SELECT model, arm, eval_set, min(CASE WHEN cdf >= 0.025 THEN i END) AS lo, min(CASE WHEN cdf >= 0.975 THEN i END) AS hi FROM mass GROUP BY ALL)"""


def _first_log(spark: SparkSession, d: str) -> DataFrame:
    return runlog.first_writes(_keyed(spark, d).select("row_id", "id", "model", "arm", "eval_set", "correct", "status"))


@query(f"WITH {_CELLS} SELECT c.model, c.arm, c.eval_set, n, round(k / n, 4) AS acc, round(lo / n, 4) AS ci_lo, round(hi / n, 4) AS ci_hi, n_ok, n_none AS n_no_answer_line, n_bad AS n_non_numeric_answer FROM cell c JOIN ci ON ci.model = c.model AND ci.arm = c.arm AND ci.eval_set = c.eval_set")
def cell_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy, interval and statuses of every cell."""
    return stats.cells(_first_log(spark, d))


_P = f"CASE WHEN b = c THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(b, c) + 1), lambda i: exp({_LG.format(n='(b + c)', k='i')} - (b + c) * ln(2))))) END"


@query(f"""WITH {_FIRST}, pairs AS (SELECT x.model, x.eval_set, x.arm AS arm_a, y.arm AS arm_b, CAST(count_if(x.correct AND NOT y.correct) AS BIGINT) AS b, CAST(count_if(NOT x.correct AND y.correct) AS BIGINT) AS c, count(*) AS n_shared
FROM first x JOIN first y ON y.model = x.model AND y.eval_set = x.eval_set AND y.id = x.id AND x.arm < y.arm GROUP BY ALL)
SELECT model, eval_set, arm_a, arm_b, b, c, n_shared, b + c AS discordant, round({_P} + 1e-12, 9) AS p FROM pairs""")
def mcnemar_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Exact McNemar test of every two arms."""
    got = stats.arm_pairs(_first_log(spark, d))
    return got.select("model", "eval_set", "arm_a", "arm_b", "b", "c", "n_shared", "discordant", F.round(F.col("p") + F.lit(1e-12), 9).alias("p"))


@query(f"""WITH {_FIRST}, f AS (SELECT eval_set, id, max(CASE WHEN model = 'pelican--atlas-large' THEN CAST(correct AS INT) END) AS a, max(CASE WHEN model = 'quillmark--ledger-8b' THEN CAST(correct AS INT) END) AS b FROM first
WHERE arm = 'cot' AND model IN ('pelican--atlas-large', 'quillmark--ledger-8b') GROUP BY eval_set, id),
g AS (SELECT eval_set, CAST(count_if(a IS NOT NULL AND b IS NOT NULL) AS BIGINT) AS n, CAST(count_if(a = 1 AND b IS NOT NULL) AS BIGINT) AS ka, CAST(count_if(b = 1 AND a IS NOT NULL) AS BIGINT) AS kb, CAST(count_if(a = 1 AND b = 0) AS BIGINT) AS b, CAST(count_if(a = 0 AND b = 1) AS BIGINT) AS c,
CAST(count_if(a IS NOT NULL AND b IS NULL) AS BIGINT) AS only_a, CAST(count_if(a IS NULL AND b IS NOT NULL) AS BIGINT) AS only_b FROM f GROUP BY eval_set)
SELECT eval_set, n, only_a, only_b, b, c, round({_P} + 1e-12, 9) AS p, round(ka / n, 4) AS acc_a, round(kb / n, 4) AS acc_b, round((ka - kb) / n * 100, 4) AS delta_points FROM g WHERE n > 0""")
def model_comparison(spark: SparkSession, d: str) -> DataFrame:
    """One model against another on the ids both answered."""
    got = stats.compare_models(_first_log(spark, d), "pelican--atlas-large", "quillmark--ledger-8b", "cot")
    return got.select("eval_set", "n", "only_a", "only_b", "b", "c", F.round(F.col("p") + F.lit(1e-12), 9).alias("p"), "acc_a", "acc_b", "delta_points")


@query(f"""WITH {_FIRST}, f AS (SELECT eval_set, id, max(CASE WHEN model = 'pelican--atlas-large' THEN CAST(correct AS INT) END) AS a, max(CASE WHEN model = 'quillmark--ledger-8b' THEN CAST(correct AS INT) END) AS b FROM first WHERE arm = 'cot' GROUP BY eval_set, id),
g AS (SELECT eval_set, count(*) AS n, sum(a) AS ka, sum(b) AS kb FROM f WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY eval_set),
h AS (SELECT eval_set, 'a' AS side, n, ka AS k FROM g UNION ALL SELECT eval_set, 'b', n, kb FROM g),
m AS (SELECT eval_set, side, n, i, sum(CASE WHEN k = 0 THEN CAST(i = 0 AS DOUBLE) WHEN k = n THEN CAST(i = n AS DOUBLE) ELSE exp({_LG.format(n='n', k='i')} + i * ln(k / n) + (n - i) * ln(1 - k / n)) END) OVER (PARTITION BY eval_set, side ORDER BY i) AS cdf FROM (SELECT *, unnest(range(0, CAST(n AS BIGINT) + 1)) AS i FROM h)),
c AS (SELECT eval_set, side, round(min(CASE WHEN cdf >= 0.025 THEN i END) / any_value(n), 4) AS lo, round(min(CASE WHEN cdf >= 0.975 THEN i END) / any_value(n), 4) AS hi FROM m GROUP BY ALL),
r AS (SELECT g.eval_set, round((ka - kb) / n * 100, 4) AS delta_points, x.lo AS lo_a, x.hi AS hi_a, y.lo AS lo_b, y.hi AS hi_b, x.lo > y.hi OR y.lo > x.hi AS apart FROM g JOIN c x ON x.eval_set = g.eval_set AND x.side = 'a' JOIN c y ON y.eval_set = g.eval_set AND y.side = 'b')
SELECT eval_set, delta_points, lo_a, hi_a, lo_b, hi_b, CASE WHEN delta_points >= 8 AND apart THEN 'PASS' ELSE 'FAIL' END AS gate,
CASE WHEN delta_points >= 3.5 AND apart THEN 'pass' WHEN delta_points >= 3.5 THEN 'unclassified' WHEN delta_points >= 1 THEN 'partial' ELSE 'fail' END AS phase1 FROM r""")
def gate_decision(spark: SparkSession, d: str) -> DataFrame:
    """The two gates for every evaluation set, with the intervals they rest on."""
    got = stats.compare_models(_first_log(spark, d), "pelican--atlas-large", "quillmark--ledger-8b", "cot")
    return got.select("eval_set", "delta_points", "lo_a", "hi_a", "lo_b", "hi_b", "gate", "phase1")


@query()
def bootstrap_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Percentile bootstrap intervals by resampling, beside the exact ones of ``cell_accuracy``."""
    return stats.bootstrap(_first_log(spark, d), ("model", "arm", "eval_set"))


@query(f"""SELECT '| ' || arm || ' | ' || n || ' | ' || printf('%.4f', acc) || ' |' AS line FROM (SELECT {_ARM} AS arm, count(*) AS n, avg(CAST(correct AS INT)) AS acc FROM run_log GROUP BY 1)""")
def accuracy_table(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy per arm as lines of a markdown table."""
    got = _keyed(spark, d).groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("correct").cast("int")).alias("acc"))
    return got.select(report.markdown_line(F.col("arm"), F.col("n"), F.format_string("%.4f", "acc")).alias("line"))


# ---- checks ---------------------------------------------------------------------------------------------------------


@query("SELECT id, program FROM examples WHERE regexp_matches(program, 'const_[0-9]')")
def constant_programs(spark: SparkSession, d: str) -> DataFrame:
    """Programs that use a constant, by regular expression."""
    return checks.programs_like(_examples(spark, d), r"const_[0-9]")


@query(f"WITH {_FAULTY} SELECT id FROM faulty WHERE regexp_matches(coalesce(program, ''), 'table_(average|max|min|sum)')")
def table_op_programs(spark: SparkSession, d: str) -> DataFrame:
    """Programs that name a table operation, with faults planted."""
    return _faulty(spark, d).where(program.uses_table_op(F.col("program"))).select("id")


@query(f"""WITH {_FAULTY}, hits AS (SELECT op, id, row_number() OVER (PARTITION BY op ORDER BY id) AS rn FROM faulty, (SELECT unnest(['table_average', 'table_max', 'table_min', 'table_sum']) AS op) WHERE contains(program, op))
SELECT o.op, count(h.id) AS n_rows, coalesce(string_agg(h.id, ',' ORDER BY h.id) FILTER (WHERE rn <= 3), '') AS first_ids FROM (SELECT unnest(['table_average', 'table_max', 'table_min', 'table_sum']) AS op) o LEFT JOIN hits h ON h.op = o.op GROUP BY o.op""")
def table_op_report(spark: SparkSession, d: str) -> DataFrame:
    """Per table operation the rows that name it and the first three. (The ids are a head.)"""
    return checks.table_op_report(_faulty(spark, d))


@query(f"""WITH {_FAULTY}, {_RUN.replace("FROM examples", "FROM faulty")} SELECT id, round(value, 6) AS value, gold FROM run
WHERE coalesce(program, '') <> '' AND (starts_with(md5(id), '0') OR starts_with(md5(id), '1') OR starts_with(md5(id), '2'))""")
def program_gold_check(spark: SparkSession, d: str) -> DataFrame:
    """Programs whose result is not their gold, with faults planted; the other programs give theirs."""
    return checks.program_gold(_faulty(spark, d)).withColumn("value", F.round("value", 6))


@query(f"""WITH {_FAULTY}, a AS (SELECT id, regexp_replace(context, '([0-9]),([0-9])', '\\1\\2', 'g') AS ctx, trim(unnest(string_split(array_to_string(regexp_extract_all(coalesce(program, ''), '\\w+\\(([^)]*)\\)', 1), ','), ','))) AS figure FROM faulty)
SELECT DISTINCT id, figure FROM a WHERE figure <> '' AND NOT starts_with(figure, '#') AND NOT starts_with(figure, 'const_') AND NOT contains(ctx, ltrim(replace(figure, ',', ''), '-'))""")
def figure_provenance(spark: SparkSession, d: str) -> DataFrame:
    """Figures of programs that their context does not show, with faults planted."""
    return checks.figures_in_context(_faulty(spark, d))


@query("SELECT gold_source, count(*) AS n FROM examples GROUP BY gold_source")
def source_counts(spark: SparkSession, d: str) -> DataFrame:
    """Examples per source of the gold."""
    return _examples(spark, d).groupBy("gold_source").agg(F.count(F.lit(1)).alias("n"))


# ---- sources, sinks, streams --------------------------------------------------------------------------------------------


@query("SELECT id, count(*) AS n_records, CAST(sum(len(messages)) AS BIGINT) AS n_messages FROM train_records GROUP BY id")
def jsonl_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Training records written as JSON lines to the shared folder and read back."""
    path = scratch(spark, "round-trip")
    jsonl.write_records(table(spark, d, "train_records"), path)
    rows = jsonl.read_log(spark, path, jsonl.MESSAGES, strict=True)
    return rows.groupBy("id").agg(F.count(F.lit(1)).alias("n_records"), F.sum(F.size("messages")).alias("n_messages"))


@query(f"""WITH {_NORMAL}, kept AS (SELECT row_id FROM log QUALIFY row_number() OVER (PARTITION BY id, model, arm, eval_set ORDER BY ts ASC NULLS LAST, row_id) = 1)
SELECT arm, status, count(*) AS n FROM run_log WHERE row_id IN (SELECT row_id FROM kept) GROUP BY arm, status""")
def stream_score(spark: SparkSession, d: str) -> DataFrame:
    """The run log scored as a stream, each answer appended once."""
    base = scratch(spark, "stream")
    schema = _log(spark, d).schema
    stream.score_stream(spark, f"{d}/run_log.parquet*", schema, f"{base}/scored", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/scored").groupBy("arm", "status").agg(F.count(F.lit(1)).alias("n"))


_CLEANED = f"regexp_replace(regexp_replace(regexp_replace(@, '\\\\{{1,2}}[nt]', ' ', 'g'), '{_SPACE}+', ' ', 'g'), '^ | $', '', 'g')"


def _raw_lines(spark: SparkSession, d: str, examples: DataFrame | None = None) -> DataFrame:
    """All examples (or those given) written as raw records, one JSON object a line, and scanned back."""
    examples = _examples(spark, d) if examples is None else examples
    path = scratch(spark, "raw")
    text_of = lambda c: F.col(c).cast("string")
    exe = F.when(F.col("gold_source") != "answer_fallback", text_of("gold"))
    qa = F.struct(text_of("question").alias("question"), text_of("program").alias("program"), exe.alias("exe_ans"), text_of("gold").alias("answer"))
    rows = examples.select(F.array("context").alias("pre_text"), F.array(F.lit(" ")).alias("post_text"), F.array(F.array("company", "filed")).alias("table"), qa.alias("qa"))
    jsonl.write_records(rows, path)
    return raw.read_raw_lines(spark, path)


@query(f"""SELECT md5({_CLEANED.replace("@", "question")}) AS q, count(*) AS n, CAST(sum(length(program)) AS BIGINT) AS program_chars FROM examples GROUP BY 1""")
def raw_scan(spark: SparkSession, d: str) -> DataFrame:
    """Raw records to examples: cleaned questions and programs, by question."""
    rows = raw.build_examples(_raw_lines(spark, d), "train")
    return rows.groupBy(F.md5("question").alias("q")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("program")).alias("program_chars"))


@query("SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS least, count(*) - 1 AS most, count(*) AS n_places FROM examples")
def raw_places(spark: SparkSession, d: str) -> DataFrame:
    """The places of raw records: every number from 0 on, once."""
    rows = _raw_lines(spark, d)
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.min("pos").cast("long").alias("least"), F.max("pos").cast("long").alias("most"), F.countDistinct("pos").alias("n_places"))


@query(f"""SELECT md5({_CLEANED.replace("@", "context")} || CASE WHEN trim(coalesce(company, 'None') || coalesce(filed, 'None')) = '' THEN '' ELSE chr(10) || {_CLEANED.replace("@", "coalesce(company, 'None')")} || ' | ' || {_CLEANED.replace("@", "coalesce(filed, 'None')")} END) AS c, count(*) AS n FROM examples GROUP BY 1""")
def raw_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Contexts put together from text and table; the blank text after them adds nothing."""
    rows = raw.build_examples(_raw_lines(spark, d), "train")
    return rows.groupBy(F.md5("context").alias("c")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 'train' AS split, count(*) AS n_raw, CAST(count_if(regexp_matches(gold, '[0-9]')) AS BIGINT) AS n_kept, CAST(count_if(gold_source = 'answer_fallback') AS BIGINT) AS gold_answer_fallback FROM examples""")
def raw_report(spark: SparkSession, d: str) -> DataFrame:
    """The report of a raw scan: rows kept, and golds that came from the second field."""
    return raw.split_report(raw.build_examples(_raw_lines(spark, d), "train")).select("split", "n_raw", "n_kept", "gold_answer_fallback")


@query("SELECT CAST(row_number() OVER (ORDER BY CAST(cik_str AS VARCHAR)) - 1 AS INT) AS pos, cik_str AS cik, 'T' || cik_str AS ticker, title, 'CIK' || lpad(CAST(cik_str AS VARCHAR), 10, '0') || '.json' AS file FROM company_facts")
def ticker_universe(spark: SparkSession, d: str) -> DataFrame:
    """The companies written as a ticker file (one object, keys that say nothing) and read by its values."""
    path = scratch(spark, "tickers")
    entry = F.struct("cik_str", F.concat(F.lit("T"), F.col("cik_str").cast("string")).alias("ticker"), "title")
    docs = table(spark, d, "company_facts").select(F.struct(F.col("cik_str").cast("string").alias("key"), entry.alias("value")).alias("e"))
    docs.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list("e"))), {"ignoreNullFields": "false"}).alias("json")).write.text(path)
    return jsonl.universe(spark, path)


@query("SELECT cik_str AS cik, title, coalesce(cardinality(map_keys(facts['us-gaap'])), 0) AS n_concepts FROM company_facts WHERE facts IS NOT NULL")
def facts_files(spark: SparkSession, d: str) -> DataFrame:
    """Company-facts documents written as files and read back."""
    path = scratch(spark, "facts")
    docs = table(spark, d, "company_facts").where("facts is not null").select(F.col("cik_str").alias("cik"), F.col("title").alias("entityName"), "facts")
    jsonl.write_records(docs, path)
    rows = jsonl.facts_dir(spark, path, lines=True)
    return rows.select(F.col("cik_str").alias("cik"), "title", F.coalesce(F.size(F.map_keys(F.col("facts")["us-gaap"])), F.lit(0)).alias("n_concepts"))


@query("SELECT DISTINCT id FROM run_log WHERE id IS NOT NULL")
def logged_ids(spark: SparkSession, d: str) -> DataFrame:
    """The run log written as JSON lines, and the ids that it has answers for."""
    path = scratch(spark, "log")
    jsonl.write_records(_log(spark, d).select("id", "model", "output"), path)
    return jsonl.done_ids(spark, path)


@query(f"WITH {_FACTS} SELECT cik, concept, \"end\", 'by what percentage did ' || label || ' change between the period to ' || a_end || ' and the period to ' || \"end\" || '?' AS question, round(g, 5) AS gold FROM changed")
def fact_questions(spark: SparkSession, d: str) -> DataFrame:
    """The question and gold of every change of a concept."""
    got = facts.changes(facts.entries(table(spark, d, "company_facts")))
    return got.select("cik", "concept", "end", "question", "gold")


@query(f"WITH {_FACTS} SELECT cik, concept, \"end\", 'subtract(' || printf('%.0f', val) || ', ' || printf('%.0f', a) || '), divide(#0, ' || printf('%.0f', abs(a)) || ')' AS program FROM changed")
def fact_programs(spark: SparkSession, d: str) -> DataFrame:
    """The program of every change of a concept."""
    got = facts.changes(facts.entries(table(spark, d, "company_facts")))
    return got.select("cik", "concept", "end", "program")


@query("SELECT split, gold_source, count(*) AS n FROM examples GROUP BY split, gold_source")
def report_file(spark: SparkSession, d: str) -> DataFrame:
    """A report written as a file of JSON lines, and read back."""
    path = scratch(spark, "report")
    report.write_json(_examples(spark, d).groupBy("split", "gold_source").agg(F.count(F.lit(1)).alias("n")), path)
    return spark.read.schema("split string, gold_source string, n long").json(path)


@query(f"WITH {_FAULTY} SELECT CASE WHEN starts_with(md5(id), '0') THEN 'non_numeric_gold' ELSE 'none' END AS reason, count(*) AS n FROM faulty GROUP BY 1")
def raw_drops(spark: SparkSession, d: str) -> DataFrame:
    """Why raw records are left out, with faults planted."""
    rows = raw.build_examples(_raw_lines(spark, d, _faulty(spark, d)), "train")
    return rows.groupBy(F.coalesce("drop_reason", F.lit("none")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT id, md5(CASE WHEN length(context) > 200 THEN left(context, 200) || '...' ELSE context END) AS head FROM examples")
def context_heads(spark: SparkSession, d: str) -> DataFrame:
    """Contexts as a listing shows them. (A head of each text is the feature.)"""
    return _examples(spark, d).select("id", F.md5(text.head(F.col("context"), 200)).alias("head"))


@query("SELECT e.id, md5(e.context) AS context, md5(e.question) AS question, '' AS solution FROM exemplars x JOIN examples e ON e.id = x.id")
def exemplar_skeletons(spark: SparkSession, d: str) -> DataFrame:
    """The chosen examples with a blank solution, written as JSON lines to be filled in by hand, and read back."""
    path = scratch(spark, "skeletons")
    ids = tuple(x["id"] for x in prompts.load_exemplars(spark, f"{d}/exemplars.parquet"))
    jsonl.write_records(prompts.exemplar_skeletons(_examples(spark, d), ids), path)
    rows = jsonl.read_log(spark, path, "id string, context string, question string, solution string", strict=True)
    return rows.select("id", F.md5("context").alias("context"), F.md5("question").alias("question"), "solution")
