"""Readers: text formats to (doc_id, tokens), (doc_id, term_id, weight) or (word, vector) tables.

Documents in line formats are numbered by line. `numbered_lines` does that in two levels: row offsets inside each
file block and running starts over blocks, so no task reads more than its own splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vectorloom.functions.text import tokenize
from vectorloom.runtime import cut

MAX_SENTENCE_LENGTH = 10_000
SPACE = r"\s+"


def _pieces(c, pattern: str = SPACE):
    return F.filter(F.split(c, pattern), lambda w: w != "")


def _positioned(spark: SparkSession, path: str, line_sep: str | None = None) -> DataFrame:
    reader = spark.read if line_sep is None else spark.read.option("lineSep", line_sep)
    return reader.text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"))


def numbered_lines(spark: SparkSession, path: str, line_sep: str | None = None, per_file: bool = False) -> DataFrame:
    """(line, value[, file]): lines numbered from 0 over the files in name order, or within each file."""
    rows = cut(_positioned(spark, path, line_sep))
    blocks = rows.groupBy("_file", "_block").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    over = (W.partitionBy("_file") if per_file else W).orderBy("_block") if per_file else W.orderBy("_file", "_block")
    starts = blocks.withColumn(
        "_start", F.coalesce(F.sum("_n").over(over.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # one row per block
    out = rows.join(starts, ["_file", "_block"]).withColumn("line", F.col("_start") + F.col("_at") - F.col("_first"))
    return out.select("line", "value", F.col("_file").alias("file")) if per_file else out.select("line", "value")


# ---------------------------------------------------------------- plain text
def read_lines_sentences(spark: SparkSession, path: str, max_sentence_length: int = MAX_SENTENCE_LENGTH,
                         limit: int | None = None) -> DataFrame:
    """(line, piece, tokens): one line is one sentence, long ones are cut into pieces."""
    lines = numbered_lines(spark, path)
    if limit is not None:
        lines = lines.filter(F.col("line") < limit)
    tokens = lines.select("line", _pieces(F.col("value")).alias("_t")).filter(F.size("_t") > 0)
    starts = F.sequence(F.lit(0), F.size("_t") - 1, F.lit(max_sentence_length))
    parts = F.transform(starts, lambda s: F.slice("_t", s + 1, F.lit(max_sentence_length)))
    return tokens.select("line", F.posexplode(parts).alias("piece", "tokens"))


# What makes a token markup, and what is stripped from the others.
TEXT8_MARKUP = ["<", ">", '="', "://", "&lt;", "&gt;", "&amp;", "=", "|"]
TEXT8_STRIPPED = r"""&quot;|[}{\]\[,)(\\.']"""


def read_text8(spark: SparkSession, path: str, max_sentence_length: int = MAX_SENTENCE_LENGTH) -> DataFrame:
    """(sentence, tokens): a corpus without line breaks, read blank by blank and cut every N tokens."""
    from vectorloom.runtime import dense_ids

    words = numbered_lines(spark, path, " ").select(
        "line", F.posexplode(_pieces(F.col("value"))).alias("_k", "value"))
    for mark in TEXT8_MARKUP:
        words = words.filter(~F.contains("value", F.lit(mark)))
    clean = words.select("line", "_k", F.regexp_replace(F.lower("value"), TEXT8_STRIPPED, "").alias("token"))
    placed = dense_ids(clean, [F.col("line"), F.col("_k")], "_pos")
    return (placed.groupBy(F.floor(F.col("_pos") / max_sentence_length).alias("sentence"))
            .agg(F.sort_array(F.collect_list(F.struct("_pos", "token"))).alias("_s"))  # N tokens per group
            .select("sentence", F.col("_s.token").alias("tokens")))


def read_tagged_tokens(spark: SparkSession, path: str, include_tags: bool = True) -> DataFrame:
    """(line, tokens) from word/TAG lines: alphabetic tags only, cut to two letters."""
    pairs = F.filter(F.transform(_pieces(F.col("value")), lambda t: F.split(t, "/")), lambda p: F.size(p) == 2)
    if include_tags:
        kept = F.filter(pairs, lambda p: F.substring(F.get(p, F.lit(1)), 1, 2).rlike(r"^\p{L}+$"))
        words = F.transform(kept, lambda p: F.concat(F.lower(F.get(p, F.lit(0))), F.lit("/"), F.substring(F.get(p, F.lit(1)), 1, 2)))
    else:
        words = F.transform(pairs, lambda p: F.lower(F.get(p, F.lit(0))))
    return numbered_lines(spark, path).select("line", words.alias("tokens")).filter(F.size("tokens") > 0)


def read_tagged_lines(spark: SparkSession, path: str) -> DataFrame:
    """(tags, words): a document per line, tagged with its line number."""
    return numbered_lines(spark, path).select(F.array("line").alias("tags"), _pieces(F.col("value")).alias("words"))


def read_text_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, tokens): lower-cased tokens per line; doc_id is the line number."""
    return numbered_lines(spark, path).select(F.col("line").alias("doc_id"), tokenize(F.col("value"), lower=True).alias("tokens"))


def read_csv_corpus(spark: SparkSession, path: str, labels: bool = False, header: bool = False, sep: str = ",") -> DataFrame:
    """(doc_id, term_id, weight): numeric columns are features by position; a label column comes first."""
    lines = numbered_lines(spark, path)
    if header:
        lines = lines.filter(F.col("line") > 0).withColumn("line", F.col("line") - 1)
    cells = F.split("value", f"\\Q{sep}\\E")
    cells = F.slice(cells, 2, F.size(cells)) if labels else cells
    return lines.select(F.col("line").alias("doc_id"), F.posexplode(cells).alias("term_id", "_v")).select(
        "doc_id", F.col("term_id").cast("long").alias("term_id"), F.trim("_v").cast("double").alias("weight"))


# ---------------------------------------------------------------- bag-of-words formats
def read_matrix_market(spark: SparkSession, path: str, with_empty: bool = False) -> DataFrame:
    """0-based triples of a coordinate file; with_empty adds (doc, null, null) for documents without entries.

    The header's entry count is not relied upon.
    """
    lines = numbered_lines(spark, path).filter(~F.col("value").startswith("%") & (F.trim("value") != ""))
    head = lines.agg(F.min_by("value", "line").alias("h"), F.min("line").alias("_l")).first()
    if head["h"] is None:
        raise ValueError(f"{path} holds no size line")
    p = _pieces(F.col("value"))
    rows = lines.filter(F.col("line") > head["_l"]).select(
        (F.get(p, F.lit(0)).cast("long") - 1).alias("doc_id"), (F.get(p, F.lit(1)).cast("long") - 1).alias("term_id"),
        F.get(p, F.lit(2)).cast("double").alias("weight"))
    if not with_empty:
        return rows
    return spark.range(int(head["h"].split()[0])).withColumnRenamed("id", "doc_id").join(rows, "doc_id", "left")


def _doc_numbers(lines: DataFrame) -> DataFrame:
    """Re-number kept lines without gaps (used where blank or comment lines are skipped)."""
    from vectorloom.runtime import dense_ids

    return dense_ids(lines, [F.col("line")], "doc_id").drop("line")


def read_svmlight(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, target, term_id, weight): 1-based features become 0-based; qid and comments are skipped."""
    body = F.trim(F.regexp_replace("value", "#.*$", ""))
    lines = _doc_numbers(numbered_lines(spark, path).select("line", body.alias("value")).filter("value <> ''"))
    p = _pieces(F.col("value"))
    entries = F.filter(F.slice(p, 2, F.size(p)), lambda e: ~e.startswith("qid:"))
    split = lines.select("doc_id", F.get(p, F.lit(0)).alias("target"), entries.alias("_es"))  # once per line, not per entry
    return split.select("doc_id", "target", F.explode("_es").alias("_e")).select(
        "doc_id", "target", (F.substring_index("_e", ":", 1).cast("long") - 1).alias("term_id"),
        F.substring_index("_e", ":", -1).cast("double").alias("weight"))


def read_blei(spark: SparkSession, path: str, vocab_path: str | None = None) -> DataFrame:
    """(doc_id, term_id, weight[, token]) from `N id:value ...`; a wrong N fails the job."""
    p = _pieces(F.col("value"))
    lines = numbered_lines(spark, path).filter(F.trim("value") != "").select(
        F.col("line").alias("doc_id"), F.get(p, F.lit(0)).cast("int").alias("_n"), F.slice(p, 2, F.size(p)).alias("_e"))
    checked = lines.filter(F.assert_true(
        F.col("_n") == F.size("_e"), F.concat(F.lit("bad entry count in line "), F.col("doc_id").cast("string"))).isNull())
    rows = checked.select("doc_id", F.explode("_e").alias("_e")).select(
        "doc_id", F.substring_index("_e", ":", 1).cast("long").alias("term_id"),
        F.substring_index("_e", ":", -1).cast("double").alias("weight"))
    return rows if vocab_path is None else rows.join(read_vocab_lines(spark, vocab_path), "term_id", "left")


def read_vocab_lines(spark: SparkSession, path: str) -> DataFrame:
    """(term_id, token): one token per line, numbered by line."""
    return numbered_lines(spark, path).select(F.col("line").alias("term_id"), F.trim("value").alias("token"))


def read_uci(spark: SparkSession, path: str, vocab_path: str | None = None) -> DataFrame:
    """Three header lines, then 1-based triples."""
    p = _pieces(F.col("value"))
    rows = numbered_lines(spark, path).filter((F.col("line") >= 3) & (F.trim("value") != "")).select(
        (F.get(p, F.lit(0)).cast("long") - 1).alias("doc_id"), (F.get(p, F.lit(1)).cast("long") - 1).alias("term_id"),
        F.get(p, F.lit(2)).cast("double").alias("weight"))
    return rows if vocab_path is None else rows.join(read_vocab_lines(spark, vocab_path), "term_id", "left")


def _counted_words(lines: DataFrame) -> DataFrame:
    """(doc_id, term_id, token, weight) with ids by token order, from (doc_id, tokens)."""
    from vectorloom.operators.vocab import token_runs
    from vectorloom.runtime import dense_ids

    runs = token_runs(lines)
    ids = dense_ids(runs.select("token").distinct(), [F.col("token")], "term_id")
    return runs.join(ids, "token").select("doc_id", "term_id", "token", F.col("tf").cast("double").alias("weight"))


def read_low(spark: SparkSession, path: str) -> DataFrame:
    """A line with the number of documents, then one document's words per line."""
    lines = numbered_lines(spark, path).filter("line > 0").select(
        (F.col("line") - 1).alias("doc_id"), _pieces(F.trim("value")).alias("tokens"))
    return _counted_words(lines)


def read_mallet(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(bag of words, metadata) from `docid lang w1 w2 ...`."""
    p = F.split(F.trim("value"), SPACE, 3)
    lines = cut(numbered_lines(spark, path).select(
        F.col("line").alias("doc_id"), F.get(p, F.lit(0)).alias("name"), F.get(p, F.lit(1)).alias("lang"),
        _pieces(F.coalesce(F.get(p, F.lit(2)), F.lit(""))).alias("tokens")))
    return _counted_words(lines), lines.select("doc_id", "name", "lang")


# ---------------------------------------------------------------- wiki dumps
def read_wiki_xml(spark: SparkSession, path: str, namespaces: tuple[str, ...] | None = ("0",)) -> DataFrame:
    """(page_id, title, text) of a MediaWiki dump; pages of other namespaces keep an empty text."""
    schema = "title string, ns string, id string, revision struct<text: string>"
    pages = spark.read.format("xml").option("rowTag", "page").schema(schema).load(path)
    text = F.coalesce("revision.text", F.lit(""))
    if namespaces is not None:
        text = F.when(F.col("ns").isin(list(namespaces)), text).otherwise("")
    return pages.select(F.col("id").alias("page_id"), "title", text.alias("text"))


# ---------------------------------------------------------------- embeddings
def _vectors(lines: DataFrame, dim: int) -> DataFrame:
    """(word, idx, vector) from `word f1 ... fd` lines; the word may hold blanks, bad lines go, first duplicate stays."""
    p = F.split(F.regexp_replace("value", r"\s+$", ""), " ")
    parts = lines.select("line", p.alias("_p")).filter(F.size("_p") > dim)
    at = F.greatest(F.size("_p") - dim, F.lit(0))
    numbers = F.slice("_p", at + 1, F.lit(dim)).alias("_x")
    word = F.array_join(F.slice("_p", F.lit(1), at), " ").alias("word")
    rows = parts.select("line", word, numbers)
    rows = rows.withColumn("vector", F.transform("_x", lambda x: x.try_cast("float"))).filter(
        ~F.exists("vector", lambda x: x.isNull()) & (F.col("word") != ""))
    return rows.groupBy("word").agg(F.min("line").alias("idx"), F.min_by("vector", "line").alias("vector"))


def read_word2vec_text(spark: SparkSession, path: str) -> DataFrame:
    """Header `V d`, then one word per line."""
    lines = numbered_lines(spark, path)
    head = lines.filter("line = 0").first()
    dim = int(head["value"].split()[1])
    return _vectors(lines.filter("line > 0").withColumn("line", F.col("line") - 1), dim)


def read_glove_text(spark: SparkSession, path: str) -> DataFrame:
    """No header; the dimension is that of the first line."""
    lines = numbered_lines(spark, path)
    dim = len(lines.filter("line = 0").first()["value"].split(" ")) - 1
    return _vectors(lines, dim)


def load_embedding(spark: SparkSession, path: str, kind: str = "word2vec", normalize: bool = True, lower: bool = False,
                   clean: bool = False) -> DataFrame:
    """Read, scale rows to length one and standardise words."""
    from vectorloom.functions import vectors as vx
    from vectorloom.functions.text import standardize_words

    e = {"word2vec": read_word2vec_text, "glove": read_glove_text}[kind](spark, path)
    e = e.withColumn("vector", vx.as_double(F.col("vector")))
    e = e.withColumn("vector", vx.unit(F.col("vector"))) if normalize else e
    return standardize_words(e, lower, clean) if lower or clean else e


# ---------------------------------------------------------------- evaluation sets
def read_analogy_questions(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, category, family, a, b, c, answer): `: section` lines apply to the lines after them in their file."""
    lines = numbered_lines(spark, path, per_file=True)
    sections = lines.filter(F.col("value").startswith(":")).select(
        "file", F.col("line").alias("_from"), F.trim(F.substring("value", 2, 1 << 20)).alias("category"))
    spans = sections.withColumn("_to", F.lead("_from").over(W.partitionBy("file").orderBy("_from")))  # one row per section
    p = _pieces(F.col("value"))
    asked = lines.filter(~F.col("value").startswith(":")).select("file", "line", p.alias("_p")).filter(F.size("_p") == 4)
    inside = (F.col("line") > F.col("_from")) & (F.col("_to").isNull() | (F.col("line") < F.col("_to")))
    family = F.when(F.col("category").startswith("gram"), "syntactic").otherwise("semantic")
    return asked.join(F.broadcast(spans), "file").filter(inside).select(
        F.col("line").alias("query_id"), "category", family.alias("family"),
        *[F.get("_p", F.lit(i)).alias(n) for i, n in enumerate(("a", "b", "c", "answer"))])


def read_outlier_groups(spark: SparkSession, path: str) -> DataFrame:
    """(group_id, pos, word, is_outlier): one file per group, a blank line before the outliers."""
    files = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("_file"), F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(\.[^./]*)?$", 1).alias("group_id"),
        "value")
    lines = files.select("_file", "group_id", F.posexplode(F.transform(F.split("value", "\n"), lambda x: F.trim(x))).alias("pos", "word"))
    blank = F.min(F.when(F.col("word") == "", F.col("pos"))).over(W.partitionBy("_file"))
    return lines.withColumn("_blank", blank).withColumn(
        "is_outlier", F.coalesce(F.col("pos") > F.col("_blank"), F.lit(False))).filter("word <> ''").drop("_blank", "_file")


def read_labelled_words(spark: SparkSession, path: str) -> DataFrame:
    """(word, label): the first line of every word, if it names a single label."""
    lines = numbered_lines(spark, path).withColumn("value", F.trim("value")).select(
        "line", F.regexp_extract("value", r"^(\S+)\s+(.+)$", 1).alias("word"), F.regexp_extract("value", r"^(\S+)\s+(.+)$", 2).alias("label"))
    first = lines.filter("word <> ''").groupBy("word").agg(F.min_by("label", "line").alias("label"))
    return first.filter(~F.contains("label", F.lit(" ")))


# Fixed value: marks removed from labelled documents.
DOCUMENT_MARKS = r"""<br />|[,."'!?()]"""


def read_labelled_dirs(spark: SparkSession, path: str, depth: int = 1) -> DataFrame:
    """(name, label, text): the folder `depth` levels above a file is the class, a file is a document."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    where = F.col("_metadata.file_path")
    lines = F.transform(F.split(F.regexp_replace("value", r"\n$", ""), "\n"), lambda x: F.lower(F.trim(x)))
    text = F.replace(F.regexp_replace(F.array_join(lines, " "), DOCUMENT_MARKS, ""), F.lit("/"), F.lit(" "))
    return files.select(F.regexp_extract(where, r"([^/]+)$", 1).alias("name"),
                        F.regexp_extract(where, rf"([^/]+)(?:/[^/]+){{{depth}}}$", 1).alias("label"), text.alias("text"))
