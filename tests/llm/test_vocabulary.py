"""The word list of the language model leaves no language out."""

from palisade.llm import language


def test_rare_languages_keep_words_and_grams(spark):
    big = " ".join(f"{w} " * 5 for w in ("the", "and", "house", "garden"))
    rows = [(i, big, "en") for i in range(40)] + [(100 + i, "kuningas kirjoittaa", "fi") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs, max_words=1)
    assert model.languages == ["en", "fi"] and len(model.shares[0].names) == 2
    assert {"<kir", "<kun"} <= set(model.shares[4].names.to_pylist())
    assert language.Scorer(model).predict("kirjoittaa")[0] == "fi"
