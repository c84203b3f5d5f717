import pytest
from pyspark.sql import functions as F

from snipquarry.functions import english


@pytest.mark.parametrize(
    ("word", "wanted"),
    [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"),
     ("relational", "relat"), ("conditional", "condit"), ("generalizations", "gener"), ("hopefulness", "hope"), ("electrical", "electr"), ("adoption", "adopt"), ("probate", "probat"), ("rate", "rate"), ("controll", "control"), ("roll", "roll"), ("x1", "x1"), ("été", "été")],
)
def test_stem(word, wanted):
    assert english.stem(word) == wanted


def test_match(spark):
    d = spark.createDataFrame([(1, "Running caches", "x"), (2, None, "cached runs"), (3, "nothing", None), (4, None, None)], "id int, a string, b string")
    hit = lambda q: [r.id for r in d.where(english.matches([F.col("a"), F.col("b")], q)).orderBy("id").collect()]
    assert hit("the caching run") == [1, 2] and hit("the of") == [] and hit("") == []


def test_stems_begin_like_their_words():
    """What the substring test before the analyser relies on."""
    ends = ["", "s", "es", "ies", "ed", "eed", "ing", "y", "ational", "tional", "enci", "anci", "izer", "abli", "alli", "entli", "eli", "ousli", "ization", "ation", "ator", "alism", "iveness", "fulness", "ousness", "aliti", "iviti", "biliti", "ability", "ibility", "icate", "ative", "alize", "ical", "ful", "ness", "ement", "ion", "ll", "ying", "bling", "izing", "ating"]
    for root in ("sens", "respons", "hop", "hopp", "fil", "rel", "act", "gener", "con", "d", "ag", "plast", "tr", "yell", "ox", "vi"):
        for end in ends:
            word = root + end
            s = english.stem(word)
            assert word.startswith(s[: max(1, len(s) - 2)]), (word, s)
