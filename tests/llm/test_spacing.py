"""Words disguised by spaces and doubled letters."""

import pytest

from gridspark.llm import toxicity


@pytest.fixture(scope="module")
def reader(spark):
    docs = spark.createDataFrame([("you are a stupid clown and it is on me to go up",), ("the clown was not a fat man",), ("little kettle of an idiot",)] * 40, "text string")
    return toxicity.Reader(toxicity.language_model(docs))


def forms(reader, text):
    return {w for token in toxicity.Reader.tokens(text) for w in reader.of(token)}


@pytest.mark.parametrize(
    ("text", "words"),
    [
        ("you are a s t u p i d man", {"stupid"}),
        ("s t u p i d c l o w n", {"stupid", "clown"}),
        ("the f a t man", {"fat"}),
        ("so st up id", {"stupid"}),
        ("s t u p 1 d !", {"stupid"}),
        ("an iddiot", {"idiot", "iddiot"}),
        ("a little kettle", {"little", "kettle"}),
    ],
)
def test_restored(reader, text, words):
    assert words <= forms(reader, text)


def test_ordinary_short_words_stay(reader):
    assert forms(reader, "it is on me") == {"it", "is", "on", "me"}
    assert forms(reader, "s " * 30000) is not None
