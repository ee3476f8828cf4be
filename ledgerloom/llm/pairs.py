"""Broken prompt-response pairs: empty, truncated, refusing, question-copying and wrong-language outputs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm import languages, terminal
from ledgerloom.operators.delivery import normal_key
from ledgerloom.operators.skew import lookup_join
from ledgerloom.session import durable, spread

#: Ways to decline, by language. A text is a refusal only if it also gives no figure as the answer.
REFUSALS = {
    "en": r"\b(?:can(?:no|')?t|can not|could(?:n't| not)|unable to|not able to|won'?t|will not|am not allowed to|not in a position to) (?:\w+ ){0,2}?(?:answer|help|provid\w*|giv\w*|determine|calculate|compute|respond|assist|comply|shar\w*|offer|tell|say|work|be (?:giving|answering|providing|sharing)|fulfil\w*|do|suppl\w*|disclos\w*|stat\w*|commit|engage)\b"
    r"|\b(?:no|without any|lack(?:s|ing)?(?: any| the)?) (?:means|way|basis|possibility|grounds) (?:to|of|for|on)\b|\bunanswerable\b|\b(?:outside|out of|beyond) (?:my|our|the) (?:scope|remit|abilit\w+|role|power\w*|reach)\b|\bnot (?:comfortable|willing|prepared|able|permitted|allowed|authori[sz]ed)\b|\b(?:i|we) (?:must |will |shall |would |have to )?(?:withhold|abstain|refrain|pass on)\b|\b(?:is|are|remains?) (?:impossible|unavailable to me)\b"
    r"|\b(?:must|have to|need to|has to|like to|prefer to) (?:\w+ )?(?:decline|refuse|pass on|abstain)|\bi (?:decline|refuse)\b|\brather not\b|\bno answer (?:can|could|is)\b|\bnot possible (?:for me )?to (?:\w+ )?(?:answer|provide|give|say|determine)"
    r"|\b(?:don't|do not|doesn't|does not|didn't|did not) (?:have|give|contain|include|provide|offer) (?:\w+ ){0,2}?(?:access|enough|sufficient|information|the (?:figures|data|information))\b|\b(?:insufficient|not enough) (?:information|data)\b|\bbeyond what i\b|\bagainst my\b|\bi'm afraid\b|\bcannot be (?:answered|determined|calculated)\b",
    "de": r"\bnicht (?:beantworten|helfen|berechnen|angeben|sagen|weiterhelfen|möglich)\b|\bkeine (?:auskunft|zahl|zahlen|antwort|angabe|angaben|aussage)\b|\bkann ich (?:\w+ ){0,4}(?:nicht|keine)\b|\blehne\b|\bmöchte (?:\w+ ){0,3}(?:nicht|keine)\b|\btut mir leid\b",
    "fr": r"\bne (?:peux|puis|pouvons|peut|veux|souhaite) (?:pas|être)\b|\bimpossible de\b|\bpréfère ne pas\b|\bpas en mesure\b|\bdésolée?\b|\bne dispose pas\b",
    "es": r"\bno (?:puedo|podemos|se puede|quiero|dispongo|tengo acceso|estoy en condiciones)\b|\bno (?:me )?es posible\b|\bprefiero no\b|\blo siento\b|\bno hay (?:suficiente|información)\b",
    "pt": r"\bnão (?:posso|podemos|consigo|quero|tenho acesso|disponho)\b|\bnão (?:me )?é possível\b|\bprefiro não\b|\b(?:desculpe|lamento|sinto muito)\b",
    "it": r"\bnon (?:posso|possiamo|riesco|voglio|dispongo|sono in grado|ho accesso)\b|\bnon (?:mi )?è possibile\b|\bpreferisco non\b|\bmi dispiace\b",
    "nl": r"\bkan (?:ik )?(?:\w+ ){0,3}niet\b|\bhelaas\b|\bliever niet\b",
    "pl": r"\bnie mogę\b|\bnie jest możliwe\b|\bwolę nie\b|\bprzepraszam\b",
    "ru": r"не могу|невозможно|не имею возможности|не в состоянии|предпочитаю не|извините|к сожалению|не буду",
    "zh": r"无法|不能(?:回答|提供|给出)|抱歉|对不起|不便|拒绝",
    "ja": r"できません|できかねます|お答え|申し訳|お断り",
    "sv": r"\bkan (?:jag )?(?:\w+ )?inte (?:\w+ )?(?:svara|ge|lämna|beräkna|räkna|hjälpa|ange|uppge|besvara)|\binte möjligt\b|\bgår inte att\b|\btyvärr\b|\bbeklagar\b|\bavstår\b|\bhelst inte\b",
    "da": r"\bkan (?:jeg )?(?:\w+ )?ikke (?:\w+ )?(?:svare|give|beregne|oplyse|hjælpe|besvare)|\bikke muligt\b|\bdesværre\b|\bbeklager\b|\bafstår\b|\bhelst ikke\b",
    "no": r"\bkan (?:jeg )?(?:\w+ )?ikke (?:\w+ )?(?:svare|gi|beregne|oppgi|hjelpe|besvare)|\bikke mulig\b|\bdessverre\b|\bavstår\b",
    "fi": r"\ben (?:\w+ )?(?:voi|pysty|osaa|halua|kykene)\b|\bei (?:ole mahdollista|voida)\b|\bvalitettavasti\b|\bpahoittelen\b|\bkieltäydyn\b|\bmahdotonta\b",
    "cs": r"\bnemohu\b|\bnemůžu\b|\bnelze\b|\bnejsem schop\w+|\bbohužel\b|\bomlouvám\b|\bodmítám\b|\bnení možné\b",
    "hu": r"\bnem (?:tud(?:ok|om|unk)|lehet|lehetséges|áll módomban|kívánok)\b|\bsajnos\b|\bsajnálom\b|\belnézést\b",
    "ro": r"\bnu (?:\w+ )?(?:pot|putem|poate|este posibil|dispun|doresc|sunt în măsură)\b|\bîmi pare rău\b|\bdin păcate\b|\brefuz\b",
    "tr": r"(?:emem|amam|emeyiz|amayız|emiyorum|amıyorum|emiyoruz|amıyoruz)\b|\bmümkün değil\b|\büzgünüm\b|\bmaalesef\b|\breddediyorum\b",
    "id": r"\btidak (?:\w+ )?(?:dapat|bisa|mampu|mungkin)\b|\bmaaf\b|\bmenolak\b",
    "vi": r"không thể|xin lỗi|từ chối|rất tiếc",
    "ko": r"수 없(?:습니다|어요|음|다)|죄송|불가능|거절",
    "ar": r"لا (?:أستطيع|يمكنني|يمكن|نستطيع|يمكننا)|عذر|آسف|غير قادر|أرفض|أعتذر",
    "el": r"δεν (?:μπορώ|μπορούμε|είναι δυνατόν|είμαι σε θέση)|λυπάμαι|συγγνώμη|αδυνατώ|αρνούμαι",
    "he": r"(?:לא|אינני|איני) (?:יכול|ניתן|אפשר)|מצטער|סליחה|מסרב",
    "hi": r"नहीं (?:दे|बता|कर) सक|असमर्थ|क्षमा करें|माफ़|संभव नहीं",
    "th": r"ไม่สามารถ|ขออภัย|ขอโทษ|ปฏิเสธ",
}
_ANY_REFUSAL = re.compile("|".join(REFUSALS.values()), re.I)
_NEAR = {"sv": ("sv", "da", "no"), "da": ("sv", "da", "no"), "no": ("sv", "da", "no"), "es": ("es", "pt"), "pt": ("es", "pt")}
_REFUSAL = {lang: re.compile("|".join(REFUSALS[x] for x in dict.fromkeys(("en", *_NEAR.get(lang, (lang,))))), re.I) for lang in REFUSALS}
_YEAR = re.compile(r"\b(?:19|20)\d\d(?:[-/.]\d{1,2}[-/.]\d{1,2})?\b|\b\d{1,2}[-/.]\d{1,2}[-/.](?:19|20)\d\d\b|^\s*(?:step\s*)?\d{1,2}[:.)]", re.I | re.M)
_NAMED = re.compile(r"\b(?:10-?[KQ]|8-?K|20-?F|S-1|Q[1-4]|[1-4]Q|FY\s?\d+|(?:note|item|page|table|exhibit|section|step|line|part)s?\s+\d+\w?)\b", re.I)
#: Years, dates and step numbers, as in ``_YEAR``; one word is left in their place.
_PERIODS = _YEAR
_SENTENCES = re.compile(r"(?<=[.!?;])\s+|[。！？；\n]+")
_RESULT = re.compile(r"(?:[=≈]|\b(?:is|was|are|were|be|equals?|gives|leaves|makes?|yields|totals?|comes to|amounts to|leads to|ist|war|beträgt|ergibt|sind|est|était|donne|es|fue|son|resulta|é|foi|è|era)\b)\s*(?:about |around |roughly |approximately )?[-−(]?\s*[$€£]?\s*\d", re.I)
_DATED = re.compile(r"\d[\d.,]*%?\)?(?: \w+)? (?:in|for|at|of|im|en|em|nel)\s+then\b", re.I)
_SHOWN = re.compile(r"\b(?:shows?|shown|lists?|listed|mentions?|mentioned|reports?|reported|states?|stated|contains?|covers?|includes?|given|refers?|only|nur|solo|seulement|apenas)\b", re.I)
_CALLED = re.compile(r"\b[a-z_]+\([^()\n]*\d", re.I)
_LABEL = re.compile(r"^[\s>*_`#\"'“”«»\-•]*(?:question|the question (?:was|is|reads)|frage|pregunta|pergunta|domanda|вопрос|问题|prompt|query|q|response|task|user)\s*(?:[:：\-–]\s*|$)", re.I | re.M)
_KEYS = re.compile(rf"^[\s>*_`#\"'“”«»\-•]*(?:{'|'.join(terminal.ANSWER_KEYS + terminal.PROGRAM_KEYS)})\s*(?:[:：\-–*_]\s*|$)", re.I | re.M)
_WORDS = re.compile(r"[^\W_]+(?:[-./,]\d+)*", re.U)
_ESCAPES = re.compile(r"\\+[nrt]")
#: Distance by compression up to which an output is a copy of its question. Questions of other records keep 0.53 and more from each
#: other (1 in 100 below 0.59), answers 0.73 and more from their own question, copies with one word changed at most 0.44.
COPY_DISTANCE = 0.5
DEFECTS = ("empty", "truncated", "refusal", "copies_question", "wrong_language")


def gives_figure(text: str) -> bool:
    """True where an answer line has a short value with a digit, or a program is called on figures."""
    if _CALLED.search(text):
        return True
    for line in text.splitlines():
        m = terminal._KEY.match(line.strip())
        if m and m["answer"] and any(c.isdigit() for c in m["value"]) and len(m["value"].split()) <= 4:
            return True
    return False


def _concludes(piece: str, after: bool) -> bool:
    """True if a sentence gives a figure as a result: after the words that decline any figure but one that a source shows; before them only what something is, for no period."""
    if _RESULT.search(piece) and (after or not _DATED.search(piece)):
        return True
    return after and any(c.isdigit() for c in piece) and not _SHOWN.search(piece)


def is_refusal(text: str | None, lang: str | None = None) -> bool:
    """Declines by the dictionary (of English and of the language of the text, or of all languages where that is not known) and gives no figure as the answer: on an answer line, in a program, or in a sentence that concludes.

    Figures that are only mentioned (years, dates, steps, names of reports and notes, what the excerpt shows) do not matter.
    """
    if not text or gives_figure(text):
        return False
    text = text.replace("’", "'")
    said = list(_REFUSAL.get(lang, _ANY_REFUSAL).finditer(text))
    if not said:
        return False
    if not any(c.isdigit() for c in _YEAR.sub(" ", text)):
        return True
    head, tail = (_PERIODS.sub(" then ", _NAMED.sub(" ", x)) for x in (text[: said[-1].start()], text[said[-1].end() :]))
    # What stands before the words in their own sentence is what they decline.
    before = _SENTENCES.split(head)[:-1]
    return not (any(_concludes(x, False) for x in before) or any(_concludes(x, True) for x in _SENTENCES.split(tail)))


def bare_words(text: str) -> list[str]:
    """Words of ``text`` without labels, bare keys, quotes, case, spacing and punctuation."""
    return _WORDS.findall(_KEYS.sub(" ", _LABEL.sub(" ", _ESCAPES.sub(" ", text))).lower())


_ZSTD = zstandard.ZstdCompressionParameters(compression_level=19, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)


def compressed(data: bytes, given: bytes | None = None) -> int:
    """The size of ``data`` compressed by zstandard, with ``given`` as the dictionary."""
    content = None if given is None else zstandard.ZstdCompressionDict(given, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    packer = zstandard.ZstdCompressor(compression_params=_ZSTD) if content is None else zstandard.ZstdCompressor(compression_params=_ZSTD, dict_data=content)
    return len(packer.compress(data))


def copy_distance(a: str, b: str) -> float:
    """How much of two texts is left when each is compressed with the other as dictionary, by its size compressed alone: the greater share.

    About 0.2 for equal texts of a sentence; both ways, since a text that holds more than a copy has words that the other lacks.
    """
    x, y = a.encode(), b.encode()
    if not x or not y:
        return 1.0
    return max(compressed(y, x) / compressed(y), compressed(x, y) / compressed(x))


def copies_question(question: str | None, output: str | None) -> bool:
    """The output is the question itself: compressed with the question as dictionary next to nothing of it is left, nor of the question with it.

    Labels, bare keys, quotes, case, spacing and punctuation are left out before; one word more or less is allowed. Equal words are
    a copy at any length; of a question of fewer than about six words, in which one word is much, only those are.
    """
    if not question or not output:
        return False
    q, o = bare_words(question), bare_words(output)
    return bool(q and o) and abs(len(q) - len(o)) <= 1 and (q == o or copy_distance(" ".join(q), " ".join(o)) <= COPY_DISTANCE)


#: What outputs are grouped by to learn how often they end properly.
SOURCE = ("model", "provider_used")


def signals(log: DataFrame, source: tuple[str, ...] = SOURCE, ends_only: bool = False) -> DataFrame:
    """Per row what can be told from the output alone, and the text only where a question must decide.

    ``short`` is the output where no figure is given as the answer; with ``ends_only`` only those among them whose end is
    in doubt, and neither refusal nor language is looked at. Sources are columns ``s0``, ``s1``... with ``model`` in normal form.
    """
    named = [(normal_key(c) if c == "model" else F.col(c).cast("string")).alias(f"s{i}") for i, c in enumerate(source)]
    carried = ["row_id", "qid", *[f"s{i}" for i in range(len(source))], "status", "extracted"]
    src = log.select("row_id", normal_key("id").alias("qid"), *named, "status", "extracted", F.col("output").alias("__text"))
    schema = ", ".join(f"{c} {src.schema[c].dataType.simpleString()}" for c in carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(len(carried)).to_pylist()
            state, context, closed = zip(*map(terminal.examine, texts)) if texts else ((), (), ())
            asked = (terminal.CUT, terminal.UNSURE) if ends_only else (terminal.CUT, terminal.UNSURE, terminal.COMPLETE)
            gives = [s != terminal.EMPTY and gives_figure(t) for s, t in zip(state, texts)]
            cols = {
                "state": pa.array(state, pa.string()),
                "terminated": pa.array([s == terminal.COMPLETE for s in state]),
                "midway": pa.array([s == terminal.UNSURE and not (c or "").startswith("open-") and terminal.stops_midway(t) for s, t, c in zip(state, texts, context)]),
                "context": pa.array(context, pa.string()),
                "closed": pa.array(closed, pa.list_(pa.string())),
                "short": pa.array([t if s in asked and not g else None for s, t, g in zip(state, texts, gives)], pa.string()),
            }
            if not ends_only:
                spoken = [None if s == terminal.EMPTY else languages.language(_KEYS.sub(" ", t)) for s, t in zip(state, texts)]
                cols["refusal"] = pa.array([s != terminal.EMPTY and not g and is_refusal(t, lang) for s, t, lang, g in zip(state, texts, spoken, gives)])
                cols["spoken"] = pa.array(spoken, pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(carried)], *cols.values()], [*carried, *cols])

    return spread(src).mapInArrow(run, f"{schema}, state string, terminated boolean, midway boolean, context string, closed array<string>, short string" + ("" if ends_only else ", refusal boolean, spoken string"))


def questions(examples: DataFrame) -> DataFrame:
    """One question per example id in normal form; of repeated ids the least question."""
    return examples.select(normal_key("id").alias("qid"), "question").groupBy("qid").agg(F.min("question").alias("question"))


@F.pandas_udf(T.StringType())
def _language_of(texts: pd.Series) -> pd.Series:
    return texts.map(languages.language)


@F.pandas_udf(T.BooleanType())
def _copies(questions: pd.Series, outputs: pd.Series) -> pd.Series:
    return pd.Series([copies_question(q, o) for q, o in zip(questions, outputs)], dtype=bool)


def is_copy() -> Column:
    """True where the carried output is the question itself."""
    return F.when(F.col("short").isNotNull() & F.col("question").isNotNull(), _copies("question", "short")).otherwise(F.lit(False))


def judged(log: DataFrame, examples: DataFrame, source: tuple[str, ...] = SOURCE) -> DataFrame:
    """One row per output: ``row_id``, ``status``, ``extracted`` and a flag for each of ``DEFECTS``.

    Whatever needs no question is told in one pass over the outputs and written to the shared folder; outputs that give a
    figure are not carried further. The question is joined by id in normal form, hot ids apart (``lookup_join``).
    Null outputs are ``empty``; an unknown id, a null question or a language that cannot be told flags neither copy nor
    language; an empty log gives no rows. Only the named columns are read, so further columns cannot clash.
    """
    seen = durable(signals(log, source), "signals")
    asked = questions(examples).withColumn("asked", _language_of("question"))
    rows = lookup_join(terminal.with_baseline(seen, tuple(f"s{i}" for i in range(len(source)))), asked, "qid")
    rows = rows.withColumn("copies_question", is_copy())
    own = ~F.col("copies_question")
    return rows.select(
        "row_id",
        "status",
        "extracted",
        (F.col("state") == terminal.EMPTY).alias("empty"),
        (terminal.is_cut() & own).alias("truncated"),
        (F.col("refusal") & own).alias("refusal"),
        "copies_question",
        (F.coalesce(F.col("spoken") != F.col("asked"), F.lit(False)) & own).alias("wrong_language"),
    )


def defects(log: DataFrame, examples: DataFrame, source: tuple[str, ...] = SOURCE) -> DataFrame:
    """One row per output and defect: ``row_id``, ``defect``, ``status``, ``extracted``."""
    found = F.filter(F.array(*[F.when(F.col(d), F.lit(d)) for d in DEFECTS]), lambda d: d.isNotNull())
    return judged(log, examples, source).select("row_id", F.explode(found).alias("defect"), "status", "extracted")
