import numpy as np

from ledgerloom.llm import prose, quality

PROSE = "At year end the ratio of net revenue to total assets stood at 28.8%, against 34.2% in 2004. In addition, we closed 21 sites at the coast during the full year, and management repeated further savings. "
GERMAN = "Die Rückstellungen wurden um $115.4 million erhöht, weil mehrere Verfahren noch nicht abgeschlossen sind. Im Segment mit den größten Werken sank die Auslastung auf 21.7%, während die Kosten weiter stiegen. "
TABLE = "line | 2021 | 2020\ncash | 96.3% | (72140)\nwarranty reserves | 67663 | 78.1%\ntotal assets | 51.5% | -\n" * 3
LIST = "Contents\nSchedule of marketing expense ............ 197\nNet income by segment ......... 12\n- the pension plan\n- commodity collars\n2. gross profit per share\n" * 3
JUNK = "zsfrhgl qwxxzlfxwz cj qegbtdds hfsv xxhwwcsdlbt wcrddq vwqebexzg kjrqcxqwvlbxrr htlqwsqzt vtlfl tbebkaddlwvqz bjdharthqdcltr rx vdjlg ahgqsrbzhl\n" * 3
KINDS = [
    (PROSE * 2, None), (GERMAN * 2, None), (PROSE.replace(" ", "\n", 30), None), (" ".join(" ".join(w) + "    " for w in PROSE.split()), "junk"), (PROSE.upper() * 2, None),
    (TABLE, "table"), (TABLE.replace(" | ", "\t"), "table"), (TABLE.replace(" | ", ","), "table"), (TABLE.replace(" | ", "   "), "table"),
    (LIST, "list"), (JUNK, "junk"), ("18 cf 6c ab 67 81 8f 4d 92 fc f1 55\n" * 9, "junk"), ('<div class="c26" id="x778"><span style="w:93px"></span></div>' * 8, "junk"),
    ("expense restructuring service home marine towers revenue backlog loan cash home fuel assets tax " * 5, "junk"), ("R+Km0FhFcBq2Itluq1ovYa9sSlpSx+M6WKbtuBmPOW3zVko/DF+3HgIlKHV7MT1JgQAiAzcEBdEl\n" * 6, "junk"), ("!; }~^|=[<%\\*._{-$_++[;+%}]^@.@<$]..:^+\\<#+& " * 8, "junk"),
    (PROSE + TABLE * 3, "table"), (PROSE * 4 + TABLE, None),
]


SCHEMA = "doc_id long, text string, lang_found string, kind string"
BASE = [(i, f"{PROSE if i % 3 else GERMAN}" * (1 + i % 4), "x", "k") for i in range(150)]


def test_blocks_cover_whole_texts():
    texts = ["", "?", "x" * 3000, PROSE * 40, TABLE + PROSE, "a b\n" * 500, " \n\t"]
    got = prose.blocks(texts)
    chars = np.bincount(got.text, got.chars, minlength=len(texts))
    assert [int(c) for c in chars] == [0, 1, 3000, len(PROSE) * 40, sum(c != "\n" for c in TABLE + PROSE), 1500, 0]
    assert got.chars.max() == 3000 and (got.chars[got.text == 3] < 2 * prose.BLOCK_CHARS).all()
    alone = [prose.blocks([t]) for t in texts]
    assert np.allclose(got.stats, np.concatenate([x.stats for x in alone])) and got.lang == [x.lang[0] for x in alone]


def test_long_texts_are_read_whole_in_slices(spark, monkeypatch):
    text = (PROSE + "\n") * 50 + TABLE * 60
    whole, sliced = prose.blocks([text]), prose.blocks_of_long(text, 2000)
    assert sliced.chars.sum() == whole.chars.sum() and (sliced.plain[:, :-1] == whole.plain[:, :-1]).all()
    assert prose.blocks_of_long(PROSE * 50, 2000).lang == ["en"]
    assert prose.blocks_of_long("x" * 5000, 2000).chars.sum() == 5000
    monkeypatch.setattr(prose, "CHUNK_CHARS", 5000)
    df = spark.createDataFrame(BASE + [(900, text, "x", "k"), (901, TABLE * 60, "x", "k")], SCHEMA)
    got = {r.doc_id: r.n_chars for r in quality.text_blocks(df).where("doc_id >= 900").selectExpr("doc_id", "length(sizes) n_chars").collect()}
    assert set(got) == {900, 901} and [(r.doc_id, r.kind) for r in quality.not_prose(df).where("doc_id = 901").collect()] == [(901, "table")]


def test_statistics_against_plain_counts():
    s = dict(zip(prose.STATS, prose.blocks(["The net income of 2016 was $5, and it rose. See x3."]).stats[0]))
    assert np.isclose(s["symbol_ratio"], 4 / 40) and np.isclose(s["digit_ratio"], 6 / 40) and np.isclose(s["stop_rate"], 2 / 12) and s["ended_lines"] == 1
    assert np.isclose(s["figure_tokens"], 2 / 12) and np.isclose(s["mixed_tokens"], 1 / 12) and np.isclose(s["common_words"], 5 / 10)


def test_distance_is_mahalanobis():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, len(quality.STATS)))
    cov = np.cov(x.T, bias=True)
    models = quality._models({"en": (500.0, x.mean(0), cov)})
    z, parts = quality._parts(models, "en", x[:5])
    assert np.allclose(parts.sum(1), [v @ np.linalg.inv(cov + np.diag(quality.FLOOR**2)) @ v for v in z])


def test_fit_is_robust(spark):
    """A third of all text is junk: the model stays that of the prose alone."""
    junk = [(5000 + i, JUNK * 2, "x", "k") for i in range(90)]
    clean, mixed = (quality.fit(quality.text_blocks(spark.createDataFrame(rows, SCHEMA)))["en"] for rows in (BASE, BASE + junk))
    assert np.allclose(clean[0], mixed[0], atol=0.2)
    found = {r.doc_id for r in quality.not_prose(spark.createDataFrame(BASE + junk, SCHEMA)).collect()}
    assert found == {5000 + i for i in range(90)}


def test_prose_of_other_languages(spark):
    texts = [
        "Компания сообщила, что выручка выросла на 12,4 процента по сравнению с прошлым годом. Руководство ожидает, что рост продолжится и в следующем квартале, несмотря на слабый спрос. " * 3,
        "公司在报告期内实现营业收入一百二十亿元，同比增长百分之十二。管理层预计下半年需求仍将保持稳定，但原材料价格上涨可能影响毛利率。" * 4,
        "Yhtiön liikevaihto kasvoi viime vuonna selvästi, koska kysyntä oli vahvaa kaikilla markkinoilla. Johto odottaa kasvun jatkuvan myös ensi vuonna, vaikka kustannukset ovat nousseet. " * 3,
        "Het bedrijf meldde dat de omzet in het afgelopen jaar met 12,4% is gestegen. De directie verwacht dat de groei ook in het volgende kwartaal zal aanhouden, ondanks de zwakke vraag. " * 3,
    ]
    df = spark.createDataFrame(BASE + [(900 + i, t, "x", "k") for i, t in enumerate(texts)], SCHEMA)
    assert quality.not_prose(df).count() == 0


def test_operator(spark):
    rows = BASE + [(1000 + i, t, "x", "k") for i, (t, _) in enumerate(KINDS)] + [(2000, None, "x", "k"), (2001, "", "x", "k"), (None, TABLE, "x", "k"), (1005, TABLE, "x", "k")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = [(r.doc_id, r.kind) for r in quality.not_prose(df).collect()]
    want = [(1000 + i, k) for i, (_, k) in enumerate(KINDS) if k] + [(None, "table"), (1005, "table")]
    assert sorted(got, key=str) == sorted(want, key=str)
    r = quality.prose_distance(df).where("doc_id = 1005").first()
    assert abs(sum(r[f"part_{s}"] for s in quality.STATS) - r.distance) < 1e-6 * r.distance and r.distance > quality.LIMIT
    r = quality.prose_distance(df).where("doc_id = 1").first()
    assert r.n_words == 2 * sum(any(c.isalpha() for c in w) for w in PROSE.split()) and r.outside == 0 and r.kind is None and r.ended_lines == 1
    assert quality.prose_distance(df).count() == 150 + len(KINDS) + 2
    assert quality.not_prose(df.limit(0)).count() == 0


def test_noise_between_function_words_is_junk(spark):
    noise = ["of the @@@@@@@@ to the ######## in a %%%%%%%% " * 9, "of xqz-ttr-zzv-kkj-bbd-qqw vvk-zzt-ppq the xxr-ttz-qqk-bbz zzt-wwk-kkd-ddq-xxc " * 9, "the #### @@@@ $$$$ of ^^^^ ++++ the ==== ~~~~ " * 9]
    df = spark.createDataFrame(BASE + [(900 + i, t, "x", "k") for i, t in enumerate(noise)], SCHEMA)
    assert sorted((r.doc_id, r.kind) for r in quality.not_prose(df).collect()) == [(900, "junk"), (901, "junk"), (902, "junk")]
