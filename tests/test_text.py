import pytest
from pyspark.sql import functions as F

from vectorloom.functions import text as tx
from vectorloom.functions.porter import porter_stem


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "t string").select(fn(F.col("t"))).first()[0]


@pytest.mark.parametrize("fn, given, want", [
    (tx.strip_numeric, "salut les amis du 59", "salut les amis du "),
    (tx.strip_short, "salut les amis du 59", "salut les amis"),
    (tx.strip_tags, "<i>Hello</i> <b>World</b>!", "Hello World!"),
    (tx.strip_multiple_whitespaces, "salut  les\r\nloulous!", "salut les loulous!"),
    (tx.strip_non_alphanum, "toto nf-kappa titi", "toto nf kappa titi"),
    (tx.split_alphanum, "toto diet1 titi", "toto diet 1 titi"),
    (tx.split_alphanum, "toto 1diet titi", "toto 1 diet titi"),
    (tx.remove_stopwords, "the world is square", "world square"),
    (tx.strip_punctuation, "a,b!!c", "a b c"),
    (tx.deaccent, "Šéf chomutovských komunistů dostal poštou bílý prášek", "Sef chomutovskych komunistu dostal postou bily prasek"),
    (tx.decode_html_entities, "&amp;&#65;&#x42;&eacute;&nosuch;", "&ABé&nosuch;"),
    (tx.strip_wiki_markup, "a {{cite {{x}} y}} [[link|text]] '''b''' <ref>n</ref> [http://u.org site]", "a  text '''b'''  site"),
    (tx.decode_html_entities, "&#x; &#1114112; &lt&gt; &&amp; &#55296;", "&#x; &#1114112; &lt> && &#55296;"),
    (tx.strip_wiki_markup, "[[File:a.png|thumb|a [[b|c]] d]] [[Category:x]] x<br/>y {{open [1] <!-- no -->", "a c d  xy {{open [1] "),
    (tx.strip_wiki_markup, "{| class=w\n|+ top\n|-\n! a !! b\n|-\n| style=x | 1 || [[q]]\n|}end", "\ntop\na\nb\n1\nq\nend"),
])
def test_scalar(spark, fn, given, want):
    assert one(spark, given, fn) == want


def test_stem_golden(spark):
    given = ("While it is quite useful to be able to search a large collection of documents almost instantly for a joint "
             "occurrence of a collection of exact words, for many searching purposes, a little fuzziness would help. ")
    want = ("while it is quit us to be abl to search a larg collect of document almost instantli for a joint occurr of a "
            "collect of exact words, for mani search purposes, a littl fuzzi would help.")
    assert one(spark, given, tx.stem) == want


@pytest.mark.parametrize("word, want", [("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"),
                                        ("sky", "sky"), ("happy", "happi"), ("controlling", "control"), ("is", "is")])
def test_porter(word, want):
    assert porter_stem(word) == want


def test_tokens(spark):
    assert one(spark, "Don't 12 a_b _x ab1cd", lambda c: tx.tokenize(c)) == ["Don", "t", "a_b", "_x", "ab", "cd"]
    assert one(spark, "Don't a_b _xyz " + "q" * 16, lambda c: tx.simple_preprocess(c)) == ["don", "a_b"]


def test_sentences(spark):
    got = one(spark, "Mr. Smith came. He left!\nNo stop here\nU.S. troops won? Yes.", tx.split_sentences)
    assert got == ["Mr. Smith came.", "He left!", "No stop here", "U.S. troops won?", "Yes."]


def test_standardize_words(spark):
    e = spark.createDataFrame([("The", 0, 1), ("the", 1, 2), ("a-b", 2, 3), ("--", 3, 4)], "word string, idx int, x int")
    got = {r["word"]: r["x"] for r in tx.standardize_words(e, lower=True, clean=True).collect()}
    assert got == {"the": 2, "ab": 3}


def test_wiki_article_filter(spark):
    rows = spark.createDataFrame([("Talk:x", "word " * 60), ("ok", "word " * 60), ("short", "word")], "title string, text string")
    assert [r["title"] for r in tx.clean_wiki_articles(rows).collect()] == ["ok"]


def test_short_ways_of_tokens_equal_the_long_ones(spark):
    pieces = ["plain", "U.S.A.", "caf\u00e9,", "x1y2", "--", "a_the_longword", "The", "_", "\u0130stanbul", "it's", "ab", "12", "e.g.word", "\u212aelvin", "word.", "\u00bdcup"]
    rows = spark.createDataFrame([(p,) for p in pieces], "c string")
    c = F.col("c")
    first = F.get(tx.tokenize(tx.collapse_acronyms(c), lower=True, deacc=True), F.lit(0))
    token = tx.tokenize(c, lower=True, deacc=True)
    stop = ["the", "plain"]
    long = tx.default_filters(stop, stemming=False)
    got = rows.select(tx.first_token(c).alias("a"), first.alias("b"), F.transform(token, lambda w: tx.clean_token(w, stop)).alias("d"),
                      F.transform(token, lambda w: F.array_join(tx.preprocess_string(w, long), "")).alias("e"),
                      tx.preprocess_string(c, tx.content_filters(stop)).alias("f"), tx.preprocess_string(c, long).alias("g"))
    assert all(r["a"] == r["b"] and r["d"] == r["e"] and r["f"] == r["g"] for r in got.collect())
    assert "longword" in str([r["d"] for r in got.collect()])
