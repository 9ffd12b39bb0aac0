"""Text and id expressions on hand-made rows."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import ids, text
from palimpsest.functions.stem import analyze, french_stem, stem_table, stop_words


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", expr(F.col("v")).alias("x")).orderBy("i").collect()]


def test_normal_forms(spark):
    values = ["été", "été", "", None, "œuvre"]
    assert column(spark, values, text.nfc) == [None if v is None else unicodedata.normalize("NFC", v) for v in values]
    assert column(spark, values, text.nfd) == [None if v is None else unicodedata.normalize("NFD", v) for v in values]


def test_white_space(spark):
    assert column(spark, [" a  b\r\n\tc ", " ", None], text.squeeze) == ["a b c", "", None]
    assert column(spark, [" \t", "", None, "x"], text.is_blank) == [True, True, True, False]


def test_words_and_terms(spark):
    assert column(spark, ["L'Été 2023, x_y", None, "..."], text.words) == [["l", "été", "2023", "x", "y"], [], []]
    assert column(spark, ["L'Été 2023a, x_y", None], text.letter_terms) == [["l", "été", "a", "x", "y"], []]
    assert column(spark, ["x_y 10", None], text.word_tokens) == [["x_y", "10"], []]


def test_cleaners(spark):
    assert column(spark, ["a*b/c:d?(e)+f'", None], text.clean_query) == ["abcdef", None]
    assert column(spark, ["œuvre Été ß", None], text.fold_accents) == ["oeuvre Ete ss", None]
    assert column(spark, ["l'eau, 12", None], lambda c: text.drop_punctuation(c, digits=True)) == ["leau ", None]
    assert column(spark, ["l'eau d'ici"], text.split_elisions) == ["l eau d ici"]


def test_tags(spark):
    assert column(spark, ["0.7", "1.5", "-1", "ERROR", None], text.safe_unit) == [0.7, 0.0, 0.0, 0.0, 0.0]


def test_id_dialects(spark):
    values = ["doc12", "12", "doc-12", "cod12", " DOC12", "doc", None]
    assert column(spark, values, ids.bare_docid) == [12, 12, 12, 12, 12, None, None]
    assert column(spark, values[:4], ids.strip_prefix) == ["12", "12", "-12", "cod12"]
    assert column(spark, values[:4], ids.strip_chars) == ["12", "12", "-12", "12"]


def test_hosts(spark):
    urls = ["https://www.A-b.example:80/x?y", "m.a.example", "HTTP://WWW.X.EXAMPLE?p=1", None, "", "https://"]
    assert column(spark, urls, ids.host) == ["a-b.example", "a.example", "x.example", None, None, None]
    assert column(spark, [" Forum-Entraide ", None], ids.source_name) == ["forum_entraide", None]


@pytest.mark.parametrize(
    ("word", "stem"),
    [
        pair.split(":")
        for pair in (
            "continu:continu continua:continu continuellement:continuel continuité:continu continuons:continuon contorsions:contors contournait:contourn "
            "contractions:contract contradictoirement:contradictoir contraindre:contraindr contraria:contrari mains:main maintenaient:mainten maintenue:maintenu "
            "mairie:mair mais:mais maïs:maï maîtresses:maîtress majesté:majest majestueusement:majestu majeure:majeur majorités:major malades:malad maladive:malad "
            "nationaux:national chevaux:cheval quelle:quel"
        ).split()
    ],
)
def test_stemmer(word, stem):
    assert french_stem(word) == stem


def test_analyzers(spark):
    d = spark.createDataFrame([(1, "L'été, les œuvres, même continuellement 10 à"), (2, None), (3, "")], "id int, t string")
    bow = [(r.id, r.stem) for r in analyze(d, ["id"], "t", "bow").orderBy("id", "pos").collect()]
    assert bow == [(1, french_stem("lete")), (1, french_stem("oeuvres")), (1, french_stem("continuellement"))]
    topic = [r.stem for r in analyze(d, ["id"], "t", "topic").orderBy("id", "pos").collect()]
    assert french_stem("continuellement") in topic and "10" not in topic
    assert {"meme", "même"} <= set(stop_words())
    assert stem_table(spark.createDataFrame([("mains",), ("mains",), (None,)], "term string")).collect()[0].stem == "main"
