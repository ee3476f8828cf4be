import pytest

from ledgerloom.llm import languages, pairs, terminal, truncation

LOG = "row_id long, id string, model string, provider_used string, status string, extracted string, output string, spoken string, short string, state string, question string"
Q = "what was the percentage change in net income from 2019 to 2020?"
GOOD = "First I look up the line for net income. The change is 5; relative to 10 this is 0.5.\nProgram: subtract(15, 10), divide(#0, 10)\nANSWER: 0.5"

STATES = [
    (GOOD, "complete"),
    (GOOD + "\n### ", "complete"),
    ("It was 5, and that is 0.5.", "complete"),
    ('The note calls it "Umsatz".', "complete"),
    ("Program: add(1, 2).", "complete"),
    ("I cannot say.\nProgram: none\nANSWER: not available", "complete"),
    ("The result is 5. That is all (see the table above).", "complete"),
    ("ANSWER: N/A", "complete"),
    ("42", "complete"),
    ("用 312 除以 673 得到 46.4。", "complete"),
    ("It was 5.\nANSWER", "cut"),
    ("It was 5.\nANSW", "cut"),
    ("It was 5.\nANSWER:", "cut"),
    ("It was 5.\nANSWER: -", "cut"),
    ("It was 5.\nANSWER: (1,2", "cut"),
    ("It was 5.\nANSWER: `", "cut"),
    ("It was 5.\nProgram: subtract(15, 1", "cut"),
    ("It was 5.\nProgram: subtract(15, 10),", "cut"),
    ("It was 5.\nProgram: subtr", "cut"),
    ("It was 5.\nProgram:", "cut"),
    ("The change is 12,07�", "cut"),
    ("The change is twelve and [...]", "cut"),
    ("The change is twel…", "cut"),
    ("The change is twel… (more)", "cut"),
    ('It is called "Umsatz', "cut"),
    ("See <b", "cut"),
    ("ends in \\u12", "cut"),
    ("ends in a &am", "cut"),
    ("The change is twel", "unsure"),
    ("", "empty"),
    (None, "empty"),
    (" ​﻿\xa0\n", "empty"),
    ("...", "empty"),
    ("<br>", "empty"),
    ("```\n```", "empty"),
    ("### Response\nProgram: \nANSWER: ", "empty"),
    ("**ANSWER:**", "empty"),
    ('""', "empty"),
]


@pytest.mark.parametrize("text,want", STATES)
def test_states(text, want):
    assert terminal.state(text) == want


def test_long_text_is_read_whole():
    assert terminal.state("It is so. " * 200_000 + "And th") == "unsure"
    assert terminal.state("(" * 50_000 + "a.") == "unsure" and terminal.state("(" * 50_000 + "a") == "cut"


def test_stack():
    assert terminal.open_marks('a (b [c] "d') == ["(", '"']
    assert terminal.open_marks("it's 5) fine `x` “y”") == []


REFUSED = ["I'm sorry, but I can’t help with that request.", "No answer can be given for 2019.", "I must decline to work this out, and guessing would be irresponsible.\nANSWER: N/A", "Dazu kann ich leider keine Auskunft geben, weil die Angaben fehlen.", "Je préfère ne pas faire ce calcul, veuillez consulter un spécialiste.", "No me es posible dar una cifra sin el informe completo.\nProgram: none\nANSWER: not available", "Não posso responder a esta pergunta.", "Non posso rispondere a questa domanda.", "Я не могу ответить на этот вопрос.", "抱歉,我无法回答这个问题。", "The excerpt does not give enough information to answer."]
NOT_REFUSED = [GOOD, "We are unable to use the note, but the table is sufficient. It was 15 and 10.\nANSWER: 5", "The filing declined to give segment detail, so we cannot split the figure further; the total is enough. It is 7.", "Sorry for the long working. The sum is 12.", "Weitere Anpassungen sind nicht nötig.", "", None, "ANSWER: N/A"]


@pytest.mark.parametrize("text", REFUSED)
def test_refusals(text):
    assert pairs.is_refusal(text)


@pytest.mark.parametrize("text", NOT_REFUSED)
def test_no_refusals(text):
    assert not pairs.is_refusal(text)


def test_contexts():
    got = [terminal.context_of(t) for t in (GOOD, "It is so.", "- It is 5.", "Step 2: then", "a\n### ", "It is )", None, " ")]
    assert got == ["key-figure", "prose-word", "item-figure", "item-word", "prose-word", "prose-sign", None, None]
    assert all(c in terminal.CONTEXTS for c in got if c)
    assert terminal.examine("It is (5.\nSo it is.") == ("unsure", "open-bracket", []) and terminal.examine("It is (5) of **all** now.") == ("complete", "prose-word", ["open-bold", "open-bracket"])


def test_spans_left_open_are_weighed_by_the_habits_of_the_source(spark):
    """One source closes its fences now and then only: those are its habit; of the others an open fence is a cut."""
    fenced, left = "```\nx = 5\n```\nIt is so.", "```\nx = 5\nIt is so."
    items = [("e1", "loose", "p", left)] * 50 + [("e1", "loose", "p", fenced)] * 5 + [("e1", "strict", "p", fenced)] * 50 + [("e1", "strict", "p", left)] + [("e1", "loose", "p", "The lines (net income\nare so.")]
    ex = spark.createDataFrame([("e1", Q)], "id string, question string")
    assert sorted(r.row_id for r in truncation.truncated(make(spark, items), ex).collect()) == [105, 106]


def test_languages():
    assert languages.language(GOOD) == "en" and languages.language("Die Zeile mit cost of sales enthält alles, was wir für die Rechnung brauchen.") == "de"
    assert languages.language("La línea que necesitamos es la de net income.") == "es" and languages.language("La ligne qui nous intéresse est celle de net income.") == "fr"
    assert languages.language("Первое число 5, второе число 7.") == "ru" and languages.language("两者相差 5。") == "zh"
    assert languages.language(None) is languages.language("") is languages.language("12 / 7") is None
    assert languages.language('It is as in the German note "Rückstellungen und Umsatzerlöse" of the year.') == "en"


def test_copies():
    for o in (Q, Q.upper(), f"Question: {Q}", f'"{Q}"', Q + "\nANSWER:", Q.replace("percentage ", ""), f"### Question\n{Q}\n\n### Response\n", Q.replace(" ", "  ")):
        assert pairs.copies_question(Q, o), o
    for o in (GOOD, "what was the ratio of net income to sales in 2019?", "It was " + Q, "", None, Q + " " + Q):
        assert not pairs.copies_question(Q, o), o
    assert pairs.copy_distance(Q, Q) < 0.3 and pairs.copy_distance(Q, "zebra crossing by night, quite unlike it") > 0.9
    assert pairs.copies_question("why?", "Why") and not pairs.copies_question("why?", "how")


def test_other_questions_are_no_copies():
    """Questions that differ in more than one phrase stay apart; one phrase of a template can pass for the one word that may differ."""
    asked = [(kind, line, y, f"what was the {kind} in {line} from {y} to {y + 1}?") for kind in ("percentage change", "average", "total") for line in ("net income", "cost of sales", "accounts receivable") for y in (2009, 2016)]
    for *a, x in asked:
        assert all(sum(u != v for u, v in zip(a, b)) <= 1 for *b, y in asked if pairs.copies_question(x, y))
    assert not pairs.copies_question(asked[0][-1], "how many thousands did goodwill add or lose between 2011 and 2012?")


#: Written without a look at the data: refusals and plain sentences in the languages of the dictionaries.
HELD_OUT_REFUSALS = [
    "I have no means to supply that figure.", "We are not comfortable giving a number here.", "That lies outside my remit, so I will refrain.", "Computing this is impossible with what we have.", "I won't be answering this one.",
    "Das kann ich so leider nicht sagen.", "Je ne peux pas répondre sans le rapport.", "No dispongo de los datos que se piden.", "Não consigo calcular isso com o que foi dado.", "Non sono in grado di fornire questa cifra.",
    "Dat kan ik helaas niet beantwoorden.", "Nie mogę podać tej liczby.", "Jag kan tyvärr inte svara på det.", "Det kan jeg desværre ikke svare på.", "Jeg kan dessverre ikke oppgi tallet.", "En voi vastata tähän kysymykseen.",
    "Na tuto otázku nemohu odpovědět.", "Nu pot răspunde la această întrebare.", "Erre a kérdésre sajnos nem tudok válaszolni.", "Bu soruya cevap veremiyorum.", "Maaf, saya tidak dapat menjawab pertanyaan ini.", "Xin lỗi, tôi không thể trả lời câu hỏi này.",
    "Я не в состоянии назвать это число.", "很抱歉，我不能提供这个数字。", "申し訳ありませんが、お答えできません。", "죄송하지만 이 질문에는 답변할 수 없습니다.", "لا أستطيع الإجابة عن هذا السؤال.", "Δεν μπορώ να απαντήσω σε αυτή την ερώτηση.",
]
HELD_OUT_LANGUAGES = {
    "en": "We take the first of the two amounts and compare it with the second one.", "de": "Wir nehmen den ersten der beiden Beträge und vergleichen ihn mit dem zweiten.", "fr": "Nous prenons le premier des deux montants et le comparons au second.",
    "es": "Tomamos el primero de los dos importes y lo comparamos con el segundo.", "pt": "Pegamos o primeiro dos dois valores e o comparamos com o segundo, que não é maior.", "it": "Prendiamo il primo dei due importi e lo confrontiamo con il secondo.",
    "nl": "We nemen het eerste van de twee bedragen en vergelijken dat met het tweede.", "pl": "Bierzemy pierwszą z tych dwóch kwot i porównujemy ją z drugą, która nie jest większa.", "sv": "Vi tar det första av de två beloppen och jämför det med det andra som är större än detta.",
    "fi": "Otamme ensimmäisen luvun ja vertaamme sitä toiseen, joka on suurempi kuin tämä.", "cs": "Vezmeme první z těchto částek a porovnáme ji s druhou, která je větší než tato, protože to není jinak.", "ro": "Luăm prima dintre cele două sume și o comparăm cu a doua, care este mai mare.",
    "hu": "Az első összeget vesszük és azt hasonlítjuk a másodikhoz, hogy lássuk, melyik az, ami nagyobb.", "tr": "Bu iki tutar arasında ilki ile ikincisi için bir oran bulunur ve bu daha çok bilinir.", "id": "Kami mengambil yang pertama dari dua jumlah itu dan ini tidak lebih besar dari yang lain.",
    "vi": "Chúng tôi lấy số đầu trong hai số và so với số kia, được như đã nói.", "ru": "Берём первую из двух сумм и сравниваем её со второй.", "ja": "二つの金額のうち最初のものを二番目と比べます。", "ko": "두 금액 가운데 첫 번째를 두 번째와 비교합니다.", "el": "Παίρνουμε το πρώτο από τα δύο ποσά και το συγκρίνουμε με το δεύτερο.",
}


def test_held_out_refusals_and_languages():
    missed = [t for t in HELD_OUT_REFUSALS if not pairs.is_refusal(t, languages.language(t))]
    assert len(missed) <= 0.1 * len(HELD_OUT_REFUSALS), missed
    wrong = {k: languages.language(t) for k, t in HELD_OUT_LANGUAGES.items() if languages.language(t) != k}
    assert len(wrong) <= 0.1 * len(HELD_OUT_LANGUAGES), wrong
    assert not [t for t in HELD_OUT_LANGUAGES.values() if pairs.is_refusal(t)]


def make(spark, items):
    return spark.createDataFrame([(i, a, m, p, "ok", None, o, "x", "y", "z", "w") for i, (a, m, p, o) in enumerate(items)], LOG)


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.row_id, set()).add(r.defect)
    return out


def test_operator(spark):
    items = [("e1", "m", "p", o) for o in (GOOD, None, Q, "I have to pass on this one.", "Die Zeile mit net income enthält alles, was wir brauchen, und das ist 0.5.\nANTWORT: 0.5", "The change is twel")]
    items += [(" E1 ", "m", None, Q), ("none", "m", "p", Q), (None, "m", "p", "It ends (here"), ("e1", None, None, GOOD)] + [("e1", "m", "p", GOOD)] * 40
    log = make(spark, items)
    ex = spark.createDataFrame([("e1", Q, "x"), ("e2", None, "x"), (None, "lost", "x")], "id string, question string, spoken string")
    got = found(pairs.defects(log, ex))
    assert got == {1: {"empty"}, 2: {"copies_question"}, 3: {"refusal"}, 4: {"wrong_language"}, 5: {"truncated"}, 6: {"copies_question"}, 8: {"truncated"}}
    assert sorted(r.row_id for r in truncation.truncated(log, ex).collect()) == [5, 8]
    rates = {(r.model, r.provider_used): (r.n_rows, r.n_cut) for r in truncation.cut_rates(log, ex).collect()}
    assert rates == {("m", "p"): (48, 2), ("m", None): (1, 0), (None, None): (1, 0)}
    empty = log.limit(0)
    assert pairs.defects(empty, ex).count() == truncation.truncated(empty, ex).count() == truncation.cut_rates(empty, ex).count() == 0
    assert found(pairs.defects(log.where("row_id < 2"), ex.limit(0))) == {1: {"empty"}}


def test_source_that_never_ends_its_texts(spark):
    items = [("e1", "bare", "p", f"the value of line {k} it seems to be so")  for k in range(60)] + [("e1", "full", "p", "It was 5, and this is the direction seen in the text.")] * 60 + [("e1", "full", "p", "The change is twel")]
    ex = spark.createDataFrame([("e1", Q)], "id string, question string")
    assert [r.row_id for r in truncation.truncated(make(spark, items), ex).collect()] == [120]


MIDWAY = ["It is shown in the", "The table gives, however,", "We take th", "The rise is 5 and", "Das liegt an der", "Сумма равна 5. Это зна"]
NOT_MIDWAY = ["The change is twel", "It was option b", "It rose by 5 bn", "it seems to be so", "We take it", "Сумма равна пяти", "See (the table)"]


def test_midway():
    assert [terminal.stops_midway(t) for t in MIDWAY + NOT_MIDWAY] == [True] * len(MIDWAY) + [False] * len(NOT_MIDWAY)


def test_source_that_cuts_nearly_all_its_texts_is_no_habit(spark):
    ends = ["The sum of the", "The sum of both val", "The sum is seen in the tab", "The sum of both", "We take th"]
    items = [("e1", "cutter", "p", "It was 5, and this is the direction seen in the text.")] * 10 + [("e1", "cutter", "p", ends[k % 5]) for k in range(90)]
    ex = spark.createDataFrame([("e1", Q)], "id string, question string")
    log = make(spark, items)
    assert [(r.n_rows, r.n_cut) for r in truncation.cut_rates(log, ex).collect()] == [(100, 90)]
    assert sorted(r.row_id for r in truncation.truncated(log, ex).collect()) == list(range(10, 100))


def test_habit_does_not_depend_on_the_number_of_rows(spark):
    def bare(n):
        return [("e1", f"bare{n}", "p", "The value of the line it seems to be so" if k % 5 else "The value is up.") for k in range(n)]

    items = bare(30) + bare(600) + [("e1", "full", "p", "It was 5, and this is the direction seen in the text.")] * 600 + [("e1", "bare600", "p", "The value of the")]
    ex = spark.createDataFrame([("e1", Q)], "id string, question string")
    assert [r.row_id for r in truncation.truncated(make(spark, items), ex).collect()] == [1230]


MENTIONED = ["I cannot determine this; the note only shows $5,829 for 2016.", "I cannot answer from the 10-K alone.", "I can't help with the figures of Q3, sorry.", "The note lists 5,829 and 612. I cannot determine the change.", "It was 5,829 in 2016. I'm unable to calculate the change.", "The line is 5,829, but I must decline to work this out.\nANSWER: N/A"]
ANSWERED = ["We cannot give more detail than that. Dividing 12 by 4 leaves 3.", "The change is 12. I cannot say more.", "I cannot say more than this: the total is 12.", "We do not have the data for 2016, so 5,829 less 612 makes 5,217.", "I cannot determine it exactly.\nANSWER: 5"]


def test_figures_mentioned_do_not_make_an_answer():
    assert [pairs.is_refusal(t) for t in MENTIONED + ANSWERED] == [True] * len(MENTIONED) + [False] * len(ANSWERED)


SPANS = ['He said "the sum\nis 5.', "Man nennt es „Umsatz.\nIt is so.", "The lines are (net income\nand sales.", "```\nnet income = 5\nIt is so.", "<table>\nIt is 5.", "**The sum is 5.\nIt is so."]
CLOSED = ["The lines are (net income\nand sales).", "```\nx = 5\n```\nIt is so.", "<b>It</b> is 5.<br/>\nIt is so.", "It is in [0, 5).\n1) **The sum** is 5.", "It is so.\n```", "```\nIt is so.\n```", 'The 5" pipe is "new\nand old". It is so.', "Man nennt es „Umsatz“. It is so.", "(see\nThe sum is 5.\nANSWER: 5"]


def test_spans_opened_on_earlier_lines():
    assert [terminal.state(t) for t in SPANS + CLOSED] == ["unsure"] * len(SPANS) + ["complete"] * len(CLOSED)
