"""Languages that are rare, or of which there are only long texts."""

from lumirel.llm import language_id


def documents(lang, n, words=40):
    """Texts of a made-up language: its words have letters of its own."""
    letters = [chr(0x4E00 + 40 * lang + i) for i in range(40)]
    return [" ".join(letters[(3 * i + j) % 40] + letters[(i + 7 * j) % 40] for j in range(words)) for i in range(n)]


def test_a_language_of_long_texts_is_learned(spark):
    rows = [(f"l{k}", t) for k in range(3) for t in documents(k, 6)] + [("long", t) for t in documents(9, 3, 9000)]
    df = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    assert min(len(t) for lang, t in rows if lang == "long") > language_id.TRAIN_CHARS
    crf = language_id.train(df)
    assert crf.languages == ["l0", "l1", "l2", "long"]
    assert language_id.Tagger(crf).predict(documents(9, 1, 60))[0] == ["long"]


def test_languages_beyond_the_commonest_are_learned(spark, monkeypatch):
    monkeypatch.setattr(language_id, "LANGUAGES", 2)
    monkeypatch.setattr(language_id, "TRAIN_DOCS", 4)
    # 5 languages with budgets for 2: each has one document, the rare one too.
    rows = [(f"l{k}", t) for k in range(5) for t in documents(k, 9 - 2 * k, 400)]
    df = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    crf = language_id.train(df)
    assert crf.languages == [f"l{k}" for k in range(5)]
    assert language_id.Tagger(crf).predict(documents(4, 1, 60))[0] == ["l4"]


def test_rows_with_one_id_take_no_language_from_training(spark):
    rows = [("l0", t) for t in documents(0, 3)] * 9 + [("l1", t) for t in documents(1, 2)]
    df = spark.createDataFrame([(1, t, lang) for lang, t in rows], "doc_id long, text string, lang string")
    assert language_id.train(df).languages == ["l0", "l1"]
