"""Texts that stop before their end: a structural check of the last lines, and baselines per source for the unsure ones."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.skew import lookup_join
from ledgerloom.session import durable

#: Words that introduce the answer line, by language (fixed values of the output format and its translations).
ANSWER_KEYS = ("answer", "antwort", "respuesta", "réponse", "reponse", "resposta", "risposta", "antwoord", "odpowiedź", "ответ", "答案", "回答", "答え")
PROGRAM_KEYS = ("program", "programm", "programme", "programa", "programma", "программа", "程序")
_LEAD = r"[\s>*_`#\"'“”«»\-•]*"
_KEY = re.compile(rf"^{_LEAD}(?:(?P<answer>{'|'.join(ANSWER_KEYS)})|(?P<program>{'|'.join(PROGRAM_KEYS)}))(?!\w)[*_`\s]*(?P<sep>[:：\-–])?[*_\s]*(?P<value>.*)$", re.I)
_HEADER = re.compile(r"^\s*#{1,6}(?:\s+\S+){0,3}\s*:?\s*$|^\s*[`~]{3,}\w*\s*$|^\s*(?:</?\w+\s*/?>\s*)+$|^\s*[-=_*]{3,}\s*$")
_INVISIBLE = "​‌‍⁠﻿­"
_WORD = re.compile(r"[^\W_]", re.U)
_ELLIPSIS = re.compile(r"(?:\[\s*(?:…|\.\.\.)\s*\]|\(\s*(?:…|\.\.\.)\s*\)|…|\.\.\.)\s*(?:\(?\s*(?:more|continued|truncated|mehr|más|suite)\s*\)?)?[\s\"'”’)»]*$", re.I)
_BROKEN = re.compile(r"�+\s*$|\\(?:u[0-9a-fA-F]{0,3}|x[0-9a-fA-F]?)?$|&(?:#\d*|[a-zA-Z]{1,8})$|<[a-zA-Z/][^<>]*$|%[0-9A-Fa-f]?$(?<=[a-zA-Z/]%)")
_END = re.compile(r"[.!?。！？｡।؟:;][\s\"'”’»)\]*_`]*$")
_STOP = re.compile(r"[.!?。！？｡।؟][\s\"'”’»)\]*_`]*$")
_WORDLESS_VALUE = re.compile(r"^(?:n/?a|none|null|unknown|not\b.*|keine?\b.*|no\b.*)\W*$", re.I)
_OPEN, _CLOSE = "([{“«", ")]}”»"
_STRUCT = re.compile(r"[()\[\]{}“”«»`]|(?<![\w'])\"|\"(?!\w)")
_CALL = re.compile(r"^[a-z_]+\(\s*[^(),\s]+\s*,\s*[^(),\s]+\s*\)$", re.I)

EMPTY, COMPLETE, CUT, UNSURE = "empty", "complete", "cut", "unsure"


def open_marks(text: str) -> list[str]:
    """What a stack automaton leaves open in ``text``: brackets, paired quotes, code spans; closing marks without an opening one are ignored."""
    stack: list[str] = []
    for m in _STRUCT.finditer(text):
        c = m.group()
        if c in _OPEN:
            stack.append(c)
        elif c in _CLOSE:
            want = _OPEN[_CLOSE.index(c)]
            if want in stack:
                del stack[len(stack) - 1 - stack[::-1].index(want) :]
        elif stack and stack[-1] == c:
            stack.pop()
        elif c in stack:
            del stack[len(stack) - 1 - stack[::-1].index(c) :]
        else:
            stack.append(c)
    return stack


_SPANS = re.compile(
    r"^[ \t]*(?P<fence>```+|~~~+)|(?P<tag></?(?:b|i|u|em|strong|code|pre|table|ul|ol|div|span|details|summary|think|answer)\b[^<>\n]*>)|(?P<bold>(?<![\w*])\*\*(?=[^\s*])|(?<=[^\s*])\*\*(?![\w*]))"
    r"|[()\[\]{}“”«»„]|(?P<quote>(?<![\w'\"])\"(?=\S))|(?<=\S)\"(?![\w\"])",
    re.I | re.M,
)
_INTERVAL = re.compile(r"[(\[]\s*[-+−]?[\d.∞]+\s*[,;]\s*[-+−]?[\d.∞]+\s*[)\]]")
_MARKS = re.compile(r"[(\[{“«„\"<]|\*\*|```|~~~")
_CLOSES = {")": "(", "]": "[", "}": "{", "”": "“", "»": "«"}
#: What a sign of the automaton stands for.
_MEANS = {"(": "bracket", "[": "bracket", "{": "bracket", "“": "quote", "«": "quote", '"': "quote", "```": "fence", "~~~": "fence", "**": "bold"}
CONSTRUCTS = ("bracket", "quote", "fence", "bold", "tag")


def spans(text: str) -> tuple[list[str], set[str]]:
    """What the stack automaton leaves open over a whole text, and the constructs that it saw closed: brackets, quotes, code fences, tags, bold.

    Closing marks without an opening one are ignored; a fence that ends the text opens nothing.
    """
    stack: list[str] = []
    closed: set[str] = set()

    def close(c: str) -> bool:
        if c not in stack:
            return False
        del stack[len(stack) - 1 - stack[::-1].index(c) :]
        closed.add(_MEANS.get(c, "tag"))
        return True

    for m in _SPANS.finditer(_INTERVAL.sub(" ", text)):
        c = m.group()
        if m["tag"]:
            name = f"<{re.match(r'</?(\w+)', c)[1].lower()}>"
            if c.startswith("</"):
                close(name)
            elif not c.endswith("/>"):
                stack.append(name)
        elif m["fence"] or m["bold"] or c == '"':
            c = m["fence"][:3] if m["fence"] else c
            if not close(c) and (c != '"' or m["quote"]):  # a mark after a word closes, but opens nothing
                stack.append(c)
        elif c == "„":
            stack.append("“")
        elif c == "“":  # opens a quote, or closes one that the low mark opened
            if not close(c):
                stack.append(c)
        elif c in _CLOSES:
            close(_CLOSES[c])
        else:
            stack.append(c)
    if stack and stack[-1] in ("```", "~~~") and _HEADER.match(text.splitlines()[-1]):
        stack.pop()
    return stack, closed


def open_spans(text: str) -> list[str]:
    """What the stack automaton leaves open over a whole text."""
    return spans(text)[0]


def _value_state(value: str, program: bool) -> str:
    """State of what follows a key on its line."""
    v = value.strip().strip("*_").strip()
    if not v:
        return UNSURE
    if program:
        calls = v.rstrip(". ")
        if _WORDLESS_VALUE.match(calls):
            return COMPLETE
        if open_marks(calls) or not calls.endswith(")"):
            return CUT
        last = re.split(r"(?<=\))\s*[,;]?\s*", calls)
        return COMPLETE if all(_CALL.match(c) for c in last if c) else CUT
    if open_marks(v):
        return CUT
    if any(c.isdigit() for c in v):
        return CUT if v[-1] in ",(+=/" else COMPLETE
    if not _WORD.search(v):
        return CUT
    return COMPLETE if _WORDLESS_VALUE.match(v) or _STOP.search(v) else UNSURE


def is_blank(text: str | None) -> bool:
    """True for null, and for texts of white space, invisible signs, punctuation, markup, headers or bare keys alone."""
    if text is None:
        return True
    for line in text.splitlines():
        line = line.strip().strip(_INVISIBLE).strip()
        if not line or _HEADER.match(line) or not _WORD.search(re.sub(r"</?\w+\s*/?>|&\w+;", "", line)):
            continue
        m = _KEY.match(line)
        if not m or _WORD.search(m["value"]):
            return False
    return True


def state(text: str | None) -> str:
    """The first of ``examine``."""
    return examine(text)[0]


def examine(text: str | None) -> tuple[str, str | None, list[str]]:
    """State of a text; for the baseline the context it stands in, and the constructs that it shows closed before a proper last sentence.

    ``empty``, ``complete``, ``cut``, or ``unsure`` where only the habits of the source, or the question, can tell.

    ``cut``: a broken multi-byte sign or escape, an ellipsis, open brackets, quotes or markup on the last line, a key cut
    within itself or left without a value after other text, a program whose last call is not closed.
    ``unsure``: the last line is prose without a terminator, or a last sentence ends within brackets, quotes, a fence, a tag or
    bold opened anywhere before (a complete answer line ends a text whatever is open); such a text stands in the context of what
    it leaves open. Only complete and unsure texts have a context.
    """
    found, left, closed = _examine(text)
    if left:
        return found, f"open-{_MEANS.get(left[-1], 'tag')}", []
    return found, context_of(text) if found in (COMPLETE, UNSURE) else None, sorted(f"open-{c}" for c in closed)


_NOTHING: tuple[list[str], set[str]] = ([], set())


def _examine(text: str | None) -> tuple[str, list[str], set[str]]:
    if is_blank(text):
        return EMPTY, *_NOTHING
    whole = text.rstrip().rstrip(_INVISIBLE).rstrip()
    if _BROKEN.search(whole) or _ELLIPSIS.search(whole):
        return CUT, *_NOTHING
    lines = [x for x in whole.splitlines() if x.strip(_INVISIBLE + " \t")]
    while len(lines) > 1 and _HEADER.match(lines[-1]):
        lines.pop()
    last = lines[-1].strip()
    before = any(not is_blank(x) for x in lines[:-1])
    key = _KEY.match(last)
    if key and (key["sep"] or not key["value"] or key["answer"] and len(key["value"].split()) < 3):
        got = _value_state(key["value"], bool(key["program"]))
        if got == UNSURE and not _WORD.search(key["value"]):
            got = CUT if before else EMPTY
        return got, *_NOTHING
    bare = last.strip("*_ ").lower()
    if before and any(len(bare) < len(k) and k.startswith(bare) for k in ANSWER_KEYS + PROGRAM_KEYS) and bare:
        return CUT, *_NOTHING
    if _STOP.search(last):
        left, closed = spans(whole) if _MARKS.search(whole) else _NOTHING
        return (UNSURE, left, set()) if left else (COMPLETE, left, closed)
    if open_marks(last):
        return CUT, *_NOTHING
    if any(c.isdigit() for c in last) and not re.search(r"[^\W\d_]{2,}", last):
        return COMPLETE, *_NOTHING
    return UNSURE, *_NOTHING


_ITEM = re.compile(r"^[-*•]\s|^(?:step\s*)?\d+\s*[.:)]", re.I)
#: Terminal contexts: what kind of line a text ends on, and whether its last word is a word, a figure or a sign; or what was left open
#: before a proper last sentence.
CONTEXTS = tuple(f"{line}-{word}" for line in ("key", "item", "prose") for word in ("word", "figure", "sign"))
OPEN_CONTEXTS = tuple(f"open-{c}" for c in CONSTRUCTS)


def context_of(text: str | None) -> str | None:
    """The terminal context of a text; None for null and blank ones."""
    lines = [x for x in (text or "").splitlines() if x.strip()]
    while len(lines) > 1 and _HEADER.match(lines[-1]):
        lines.pop()
    if not lines:
        return None
    last = lines[-1].strip()
    word = last.split()[-1]
    shape = "figure" if any(c.isdigit() for c in word) else "word" if _WORD.search(word) else "sign"
    return f"{'key' if _KEY.match(last) else 'item' if _ITEM.match(last) else 'prose'}-{shape}"


#: Words that do not end a sentence in any of the languages (so no verb particles and no words that are a noun elsewhere).
_LEADING = frozenset(
    "the a of and or but nor to at by from for with into than as is are was were be been has have its their our your whose which because if while whereas per we they i "
    "der den dem des ein eine einen einem einer und oder von für weil dass zwischen im beim vom zum zur "
    "le les la du de un une et que dans pour sur au aux ce cette ces dont entre notre leur ses el los las del y en una con para se al su sus "
    "o os as da dos das e em na um uma com ao il gli di della dei che dal nel alla nella è het een voor w z że och att ett ve bir ile".split()
)
_GOING_ON = re.compile(r"[,;:、，；：+=/<&@#$€£¥(\[{“«–—-]$")
_LABELS = frozenset("option class part item note table plan series group case column row line type tier grade exhibit schedule appendix".split())
_FRAGMENT = re.compile(r"^[bcdfghjklmnpqrstvwxz]{1,3}$")
_LATIN_END = "ɏ"


def stops_midway(text: str) -> bool:
    """True where a text without a terminator cannot be whole: it ends on a word that opens something, on a sign that goes on, or within a word.

    Within a word is told of at most three consonants, no label (``option b``) and no unit after a figure (``5 bn``). Beyond
    the Latin script there is no list of words; there a text that ends an earlier sentence properly is held to that at its end.
    """
    lines = [x for x in text.splitlines() if x.strip()]
    while len(lines) > 1 and _HEADER.match(lines[-1]):
        lines.pop()
    last = lines[-1].strip().strip("*_`").rstrip()
    words = last.split()
    if not words or _GOING_ON.search(last):
        return True
    word, prior = words[-1].strip("\"'”’»)]("), words[-2].lower() if len(words) > 1 else ""
    if word.lower() in _LEADING and not (len(word) == 1 and prior in _LABELS):
        return True
    if _FRAGMENT.match(word):
        return prior not in _LABELS and not any(c.isdigit() for c in prior)
    letters = [c for c in word if c.isalpha()]
    return bool(letters) and letters[-1] > _LATIN_END and any(c in text[:-1] for c in ("。", "！", "｡", "।", "؟", ". ", ".\n"))


#: How far the share of properly ended texts of a source must lie below that of the others to be a habit: so many deviations, and
#: at least so much; the share of unterminated texts that stop midway from which it is no habit but cuts, if the others do not cut
#: midway more than twice as often; and the fewest unterminated texts in which a habit can be seen.
DEVIATIONS, LEAST_GAP, MOST_MIDWAY, LEAST_SEEN = 3.0, 0.3, 0.1, 20


def habits(df: DataFrame, source: tuple[str, ...]) -> DataFrame:
    """The sources and contexts (``_tag``) in which a missing end is a habit. Counts are combined before the shuffle.

    The share of properly ended texts of a source in a context is held against the pooled share of the sources that end theirs at
    least as often as all texts together, in terms of the spread of the shares of those. Texts that stop midway are cuts
    whatever the source does, so they do not count towards the share; where many of the unterminated texts of a source stop midway,
    it cuts its texts and the others are no habit either. Equal shares give equal decisions at every number of rows.
    """
    tag = F.to_json(F.struct(*[F.col(c) for c in source]))
    own = F.struct(F.col("context").alias("context"), F.col("terminated").alias("ended"), F.col("midway").alias("midway"))
    closed = F.transform("closed", lambda c: F.struct(c.alias("context"), F.lit(True).alias("ended"), F.lit(False).alias("midway")))
    each = df.where(F.col("state").isin(COMPLETE, UNSURE) & F.col("context").isNotNull()).select(tag.alias("tag"), F.explode(F.concat(F.array(own), closed)).alias("x"))
    counts = each.select("tag", "x.*").groupBy("tag", "context").agg(F.count_if("ended").alias("ended"), F.count_if(~F.col("ended") & ~F.col("midway")).alias("bare"), F.count_if("midway").alias("midway"))
    counts = durable(counts.withColumn("n", F.col("ended") + F.col("bare")).withColumn("share", F.try_divide("ended", "n")), "ends-counts")
    # One row per context, so never more than the contexts there are.
    overall = F.broadcast(counts.groupBy("context").agg(F.try_divide(F.sum("ended"), F.sum("n")).alias("overall")))
    upper = counts.join(overall, "context").where(F.col("share") >= F.col("overall") - 1e-9)
    pooled = F.try_divide(F.sum("ended"), F.sum("n"))
    going_on = F.try_divide(F.sum("midway"), F.sum(F.col("midway") + F.col("bare")))
    spread = F.sqrt(F.greatest(F.try_divide(F.sum(F.col("n") * F.col("share") * F.col("share")), F.sum("n")) - pooled * pooled, F.lit(0.0)))
    usual = F.broadcast(upper.groupBy("context").agg(pooled.alias("usual"), spread.alias("spread"), going_on.alias("usual_midway")))
    per_source = counts.where(~F.startswith("context", F.lit("open-"))).groupBy("tag").agg(going_on.alias("source_midway"))
    low = F.col("share") < F.col("usual") - F.greatest(F.lit(DEVIATIONS) * F.col("spread"), F.lit(LEAST_GAP))
    cuts = F.greatest(F.coalesce(F.try_divide(F.col("midway"), F.col("midway") + F.col("bare")), F.lit(0.0)), F.coalesce("source_midway", F.lit(0.0))) >= F.greatest(F.lit(MOST_MIDWAY), F.coalesce(F.col("usual_midway") / 2, F.lit(0.0)))
    seen = F.col("midway") + F.col("bare") >= LEAST_SEEN
    return counts.join(usual, "context").join(per_source, "tag", "left").where(low & ~cuts & seen).select(F.concat_ws("|", "tag", "context").alias("_tag"), F.lit(True).alias("habit"))


def with_baseline(df: DataFrame, source: tuple[str, ...]) -> DataFrame:
    """Adds ``habit``: whether texts of the same source leave out the end in the same context by habit (``habits``).

    Only ``unsure`` rows meet the habits, joined so that a source with most of the rows is no hot key. Sources compare null-safe.
    Other rows get null.
    """
    tag = F.concat_ws("|", F.to_json(F.struct(*[F.col(c) for c in source])), "context")
    unsure = lookup_join(df.where(F.col("state") == UNSURE).withColumn("_tag", tag), habits(df, source), "_tag").drop("_tag")
    return df.where(F.col("state") != UNSURE).withColumn("habit", F.lit(None).cast("boolean")).unionByName(unsure)


def is_cut() -> Column:
    """True for a cut text, and for an unsure one that stops midway or whose source does not leave out its ends by habit."""
    return (F.col("state") == CUT) | ((F.col("state") == UNSURE) & (F.col("midway") | ~F.coalesce(F.col("habit"), F.lit(False))))
