"""Text functions. Every function maps Columns to Columns and stays inside the JVM unless it says otherwise."""

from __future__ import annotations

import functools
import re
import string
import sys
import unicodedata
from collections.abc import Callable, Iterable
from html.entities import name2codepoint

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectorloom.functions.porter import porter_stem

# Token pattern (letters, letter-numbers, other numerals, underscore), all ASCII punctuation.
TOKEN_CLASS = r"[\p{L}\p{Nl}\p{No}_]+"
PUNCTUATION_CLASS = r"[!-/:-@\[-`{-~]+"
IGNORED_NAMESPACES = ["Wikipedia", "Category", "File", "Portal", "Template", "MediaWiki", "User", "Help", "Book",
                      "Draft", "WikiProject", "Special", "Talk"]
ARTICLE_MIN_WORDS = 50

assert set(string.punctuation) == {chr(c) for c in range(33, 127) if not chr(c).isalnum()}


# ---------------------------------------------------------------- cleaning
def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, r"<[^>]+>", "")


def strip_punctuation(c: Column) -> Column:
    return F.regexp_replace(c, PUNCTUATION_CLASS, " ")


def strip_numeric(c: Column) -> Column:
    return F.regexp_replace(c, r"[0-9]+", "")


def strip_non_alphanum(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\p{L}\p{N}_]", " ")


def strip_multiple_whitespaces(c: Column) -> Column:
    return F.regexp_replace(c, r"[\s\x1c-\x1f\x{85}\p{Z}]+", " ")


def split_alphanum(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"([a-z]+)([0-9]+)", "$1 $2"), r"([0-9]+)([a-z]+)", "$1 $2")


def words(c: Column) -> Column:
    """Whitespace split without empty pieces."""
    return F.filter(F.split(c, r"[\s\x1c-\x1f\x{85}\p{Z}]+"), lambda w: w != "")


def strip_short(c: Column, minsize: int = 3) -> Column:
    return F.array_join(F.filter(words(c), lambda w: F.length(w) >= minsize), " ")


def default_stopwords() -> list[str]:
    """Spark ML's English list; pass your own list to any function that takes `stopwords`."""
    from pyspark.ml.feature import StopWordsRemover

    return sorted(StopWordsRemover.loadDefaultStopWords("english"))


def remove_stopwords(c: Column, stopwords: Iterable[str] | None = None) -> Column:
    stop = list(default_stopwords() if stopwords is None else stopwords)
    return F.array_join(F.filter(words(c), lambda w: ~w.isin(stop)), " ")


@functools.lru_cache(maxsize=1)
def _accent_table() -> tuple[str, str]:
    """Every character whose unaccented form is one other character, derived from the Unicode tables."""
    source, target = [], []
    for code in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= code <= 0xDFFF:
            continue
        ch = chr(code)
        decomposed = unicodedata.normalize("NFD", ch)
        if decomposed == ch:
            continue
        plain = unicodedata.normalize("NFC", "".join(x for x in decomposed if unicodedata.category(x) != "Mn"))
        if len(plain) == 1 and plain != ch:
            source.append(ch)
            target.append(plain)
    return "".join(source), "".join(target)


def deaccent(c: Column) -> Column:
    """Remove diacritics: precomposed letters by table, loose combining marks by class."""
    source, target = _accent_table()
    return F.regexp_replace(F.translate(c, source, target), r"\p{Mn}+", "")


def tokenize(c: Column, lower: bool = False, deacc: bool = False) -> Column:
    """Maximal runs of word characters that are not digits."""
    c = F.lower(c) if lower else c
    c = deaccent(c) if deacc else c
    return F.regexp_extract_all(c, F.lit(TOKEN_CLASS), F.lit(0))


def simple_preprocess(c: Column, deacc: bool = False, min_len: int = 2, max_len: int = 15) -> Column:
    return F.filter(
        tokenize(c, lower=True, deacc=deacc),
        lambda t: F.length(t).between(min_len, max_len) & ~t.startswith("_"))


# ---------------------------------------------------------------- stemming (Arrow, cached per worker)
_cached_stem = functools.lru_cache(maxsize=1 << 18)(porter_stem)


def _stem_words(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else " ".join(_cached_stem(w) for w in t.split()))


def stem(c: Column) -> Column:
    """Lower-case and Porter-stem each whitespace token (Arrow batches; narrow, so no token is shuffled)."""
    return F.pandas_udf(_stem_words, "string")(c)


def stem_vocabulary(vocab: DataFrame, token: str = "token") -> DataFrame:
    """Add `stem` to a table of distinct tokens: Python runs once per type, not once per occurrence."""
    return vocab.withColumn("stem", stem(F.col(token)))


def content_filters(stopwords: Iterable[str] | None = None, minsize: int = 3) -> list[Callable[[Column], Column]]:
    """The words that `default_filters` without stemming leaves, from one split instead of four."""
    stop = list(default_stopwords() if stopwords is None else stopwords)
    keep = lambda c: F.array_join(F.filter(words(c), lambda w: (F.length(w) >= minsize) & ~w.isin(stop)), " ")
    return [F.lower, strip_tags, strip_punctuation, strip_numeric, keep]


def default_filters(stopwords: Iterable[str] | None = None, stemming: bool = True) -> list[Callable[[Column], Column]]:
    steps = [F.lower, strip_tags, strip_punctuation, strip_multiple_whitespaces, strip_numeric,
             lambda c: remove_stopwords(c, stopwords), strip_short]
    return [*steps, stem] if stemming else steps


def preprocess_string(c: Column, filters: list[Callable[[Column], Column]] | None = None) -> Column:
    """Apply the filters in order and split; the list is replaceable."""
    for step in default_filters() if filters is None else filters:
        c = step(c)
    return words(c)


# ---------------------------------------------------------------- entities and wiki markup
def _character(reference: str) -> str | None:
    """The character of a reference between ampersand and semicolon: a name, a decimal or a hexadecimal number."""
    if not reference.startswith("#"):
        return chr(name2codepoint[reference]) if reference in name2codepoint else None
    base, digits = (16, reference[2:]) if reference[1:2] in ("x", "X") else (10, reference[1:])
    if not (digits.isascii() and digits.isalnum()):
        return None
    try:
        code = int(digits, base)
    except ValueError:
        return None
    return chr(code) if code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF else None


def _decode_references(text: str) -> str:
    head, *parts = text.split("&")
    out = [head]
    for part in parts:
        reference, end, rest = part.partition(";")
        decoded = _character(reference) if end else None
        out.append("&" + part if decoded is None else decoded + rest)
    return "".join(out)


def decode_html_entities(c: Column) -> Column:
    """Decode numeric and named character references; unknown ones stay. Arrow, whole text."""
    def decode(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _decode_references(t) if t is not None and "&" in t else t)

    return F.pandas_udf(decode, "string")(c)


#: The brackets of wiki source that can nest, and elements whose content is no prose.
_BRACKET = re.compile(r"\{\{|\}\}|\{\||\|\}|\[\[|\]\]|\[(?=\w+://)|\]")
_CLOSING = {"{{": "}}", "{|": "|}", "[[": "]]", "[": "]"}
_SILENT = re.compile(r"(?is)<!--.*?-->|<(ref|nowiki|math)\b(?:[^>]*/>|.*?</\1\s*>)")
_TAG = re.compile(r"<[^<>]*>")


def _said(opening: str, inner: str) -> str:
    """What a reader sees of a closed bracket with the (already reduced) content `inner`."""
    if opening == "{{":
        return ""
    if opening == "[":
        return inner.partition(" ")[2]
    if opening == "[[":
        target, *labels = inner.split("|")
        space = target.partition(":")[0].strip().lower()
        if space == "category":
            return ""
        if space in ("file", "image"):
            return labels[-1] if labels else ""
        return labels[-1] if labels else target
    # a table: cell contents, without row marks, captions' marks and cell attributes
    cells = [cell.rpartition("|")[2].strip(" !+") for line in inner.split("\n")[1:] if not line.startswith("|-")
             for cell in re.split(r"\|\||!!", line.removeprefix("|").removeprefix("!"))]
    return "\n" + "\n".join(cells)


def _plain_wiki(text: str) -> str:
    """One pass with a stack of open brackets; a bracket that never closes is text."""
    text = _TAG.sub("", _SILENT.sub("", text))
    stack: list[tuple[str, list[str]]] = [("", [])]
    at = 0
    for mark in _BRACKET.finditer(text):
        stack[-1][1].append(text[at:mark.start()])
        at, sign = mark.end(), mark.group()
        if sign in _CLOSING:
            stack.append((sign, []))
        elif sign == _CLOSING.get(stack[-1][0]):
            opening, parts = stack.pop()
            stack[-1][1].append(_said(opening, "".join(parts)))
        else:
            stack[-1][1].append(sign)
    stack[-1][1].append(text[at:])
    while len(stack) > 1:
        opening, parts = stack.pop()
        stack[-1][1].append(opening + "".join(parts))
    return "".join(stack[0][1])


def strip_wiki_markup(c: Column) -> Column:
    """Wiki source to plain text: brackets nest, which no regular expression follows, hence one Arrow pass over each text."""
    def strip(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None else _plain_wiki(t))

    return F.pandas_udf(strip, "string")(c)


def clean_wiki_articles(pages: DataFrame, title: str = "title", text: str = "text",
                        min_words: int = ARTICLE_MIN_WORDS, lemmatise: bool = False) -> DataFrame:
    """Articles with at least `min_words` tokens whose title is in no ignored namespace; adds `tokens`."""
    allowed = ~F.col(title).rlike("^(" + "|".join(IGNORED_NAMESPACES) + "):")
    tokens = simple_preprocess(F.col(text))
    return (pages.filter(allowed)
            .withColumn("tokens", tokens)
            .filter(F.size("tokens") >= min_words))


# ---------------------------------------------------------------- sentences
# Abbreviation protection and sentence patterns.
AB_SENIOR = r"([A-Z][a-z]{1,2}\.)\s([\p{L}\p{N}_])"
AB_ACRONYM = r"(\.[a-zA-Z]\.)\s([\p{L}\p{N}_])"
AB_ACRONYM_LETTERS = r"([a-zA-Z])\.([a-zA-Z])\."
UNDO_SENIOR = r"([A-Z][a-z]{1,2}\.)@([\p{L}\p{N}_])"
UNDO_ACRONYM = r"(\.[a-zA-Z]\.)@([\p{L}\p{N}_])"
SENTENCE = r"(?d)(\S[^\n]+?[.!?])(?=\s+|$)|(\S[^\n]+?)(?=[\n]|$)"


def split_sentences(c: Column) -> Column:
    """Sentences in order; known abbreviations do not end one."""
    c = F.regexp_replace(F.regexp_replace(c, AB_SENIOR, "$1@$2"), AB_ACRONYM, "$1@$2")
    found = F.regexp_extract_all(c, F.lit(SENTENCE), F.lit(0))
    return F.transform(found, lambda s: F.regexp_replace(F.regexp_replace(s, UNDO_SENIOR, "$1 $2"), UNDO_ACRONYM, "$1 $2"))


def collapse_acronyms(c: Column) -> Column:
    return F.regexp_replace(c, AB_ACRONYM_LETTERS, "$1$2")


def packed_sentences(docs: DataFrame, doc_id: str, text: str = "text",
                     filters: list[Callable[[Column], Column]] | None = None) -> DataFrame:
    """(doc_id, pos, sentence, tokens) as arrays: the sentences of a document in its row; those left empty are dropped."""
    rows = F.transform(split_sentences(F.col(text)), lambda s, i: F.struct(
        i.alias("pos"), s.alias("sentence"), preprocess_string(s, filters).alias("tokens")))
    return (docs.select(doc_id, F.filter(rows, lambda s: F.size(s["tokens"]) > 0).alias("_s"))
            .select(doc_id, "_s.pos", "_s.sentence", "_s.tokens"))


def clean_by_sentence(docs: DataFrame, doc_id: str, text: str = "text",
                      filters: list[Callable[[Column], Column]] | None = None) -> DataFrame:
    """One row per sentence with its text, processed tokens and position; sentences left empty are dropped."""
    packed = packed_sentences(docs, doc_id, text, filters)
    return packed.select(doc_id, F.explode(F.arrays_zip("pos", "sentence", "tokens")).alias("_s")).select(
        doc_id, "_s.pos", "_s.sentence", "_s.tokens")


def first_token(c: Column) -> Column:
    """First token of a piece of text without blanks, null if there is none; pieces of ASCII pass by the accents."""
    full = F.get(tokenize(collapse_acronyms(c), lower=True, deacc=True), F.lit(0))
    plain = F.nullif(F.regexp_extract(F.lower(F.when(c.contains("."), collapse_acronyms(c)).otherwise(c)), "[a-z_]+", 0), F.lit(""))
    return (F.when(c.rlike("^[A-Za-z_]+$"), F.lower(c))
            .when(F.length(c) == F.octet_length(c), plain).otherwise(full))


def clean_token(c: Column, stopwords: Iterable[str] | None = None, minsize: int = 3) -> Column:
    """`content_filters` of one token of `tokenize`, joined; only tokens with an underscore hold several words."""
    stop = list(default_stopwords() if stopwords is None else stopwords)
    low = F.lower(c)
    several = F.array_join(preprocess_string(c, content_filters(stop, minsize)), "")
    return F.when(c.contains("_"), several).when((F.length(low) >= minsize) & ~low.isin(stop), low).otherwise("")


def clean_by_word(docs: DataFrame, doc_id: str, text: str = "text",
                  filters: list[Callable[[Column], Column]] | None = None) -> DataFrame:
    """One row per word occurrence with its surface form, processed form and position."""
    occurrences = docs.select(
        doc_id, F.posexplode(tokenize(collapse_acronyms(F.col(text)), lower=True, deacc=True)).alias("pos", "word"))
    return (occurrences.withColumn("token", F.array_join(preprocess_string(F.col("word"), filters), ""))
            .filter(F.col("token") != ""))


# ---------------------------------------------------------------- word forms
def standardize_words(embedding: DataFrame, lower: bool = False, clean: bool = False,
                      word: str = "word", idx: str = "idx") -> DataFrame:
    """Normalise the words of a table; empty results go, collisions keep an unchanged word, else the first."""
    new = F.col(word)
    new = F.regexp_replace(new, r"[^\p{L}\p{N}_]|_", "") if clean else new
    new = F.lower(new) if lower else new
    best = F.min_by(F.struct(*[F.col(c) for c in embedding.columns if c != word]),
                    F.struct((F.col("_new") != F.col(word)).cast("int"), F.col(idx)))
    kept = embedding.withColumn("_new", new).filter(F.col("_new") != "").groupBy("_new").agg(best.alias("_best"))
    return kept.select(F.col("_new").alias(word), "_best.*")


def tagged_lemma_filter(tokens: DataFrame, tag: str = "tag",
                        keep: Iterable[str] = ("NN", "VB", "JJ", "RB")) -> DataFrame:
    """Content words of an already tagged token table."""
    return tokens.filter(F.substring(F.upper(F.col(tag)), 1, 2).isin(list(keep)))
