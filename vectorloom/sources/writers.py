"""Writers: the formats of `readers`, one part file per task, header in the first part.

Rows are ordered by a range partitioning on the document, so a folder read in name order is one sorted file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.runtime import cut

EPS = 1e-12


def _save(lines: DataFrame, path: str, order: list[str], mode: str = "errorifexists") -> None:
    """`lines(order..., line)` as text, globally ordered, without a single-task sort."""
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.mode(mode).text(path)


def _with_header(rows: DataFrame, header: DataFrame) -> DataFrame:
    return header.select(*rows.columns).unionByName(rows)


def _number(c):
    """Shortest text of a value: whole numbers without a fraction."""
    return F.when(c == F.floor(c), c.cast("long").cast("string")).otherwise(c.cast("string"))


def _size(rows: DataFrame, num_docs: int | None, num_terms: int | None):
    top = rows.agg(F.max("doc_id"), F.max("term_id"), F.count("*")).first()
    return (num_docs if num_docs is not None else (top[0] if top[0] is not None else -1) + 1,
            num_terms if num_terms is not None else (top[1] if top[1] is not None else -1) + 1, top[2])


def _header_rows(spark: SparkSession, texts: list[str]) -> DataFrame:
    return spark.createDataFrame([(-1, i - len(texts), t) for i, t in enumerate(texts)], "doc_id long, term_id long, line string")


def _triples(rows: DataFrame, value) -> DataFrame:
    return rows.select("doc_id", "term_id", F.concat_ws(
        " ", (F.col("doc_id") + 1).cast("string"), (F.col("term_id") + 1).cast("string"), value).alias("line"))


def write_matrix_market(rows: DataFrame, path: str, num_docs: int | None = None, num_terms: int | None = None) -> None:
    """1-based sorted triples under a size line; entries of (almost) no weight are left out."""
    rows = cut(rows.select(F.col("doc_id").cast("long"), F.col("term_id").cast("long"), F.col("weight").cast("double"))
               .filter(F.abs("weight") > EPS))
    docs, terms, nnz = _size(rows, num_docs, num_terms)
    head = _header_rows(rows.sparkSession, ["%%MatrixMarket matrix coordinate real general", f"{docs} {terms} {nnz}"])
    _save(_with_header(_triples(rows, F.col("weight").cast("string")), head), path, ["doc_id", "term_id"])


def write_uci(rows: DataFrame, path: str, num_docs: int | None = None, num_terms: int | None = None) -> None:
    rows = cut(rows.select(F.col("doc_id").cast("long"), F.col("term_id").cast("long"), F.col("weight").cast("long")))
    head = _header_rows(rows.sparkSession, [str(x) for x in _size(rows, num_docs, num_terms)])
    _save(_with_header(_triples(rows, F.col("weight").cast("string")), head), path, ["doc_id", "term_id"])


def _entries(rows: DataFrame, docs: DataFrame | None, entry) -> DataFrame:
    """(doc_id, n, text): each document's entries joined by blanks; `docs` adds documents without entries."""
    packed = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("term_id", entry.alias("e")))).alias("_p")).select(
        "doc_id", F.size("_p").alias("n"), F.array_join(F.col("_p.e"), " ").alias("text"))
    if docs is None:
        return packed
    return docs.select("doc_id").join(packed, "doc_id", "left").fillna({"n": 0, "text": ""})


def write_svmlight(rows: DataFrame, path: str, targets: DataFrame | None = None) -> None:
    """`target id:value ...`, 1-based; `targets(doc_id, target)` defaults to 0."""
    text = _entries(rows, targets, F.concat_ws(":", (F.col("term_id") + 1).cast("string"), F.col("weight").cast("string")))
    text = text.withColumn("target", F.lit("0")) if targets is None else text.join(targets, "doc_id")
    _save(text.select("doc_id", F.rtrim(F.concat_ws(" ", F.col("target").cast("string"), "text")).alias("line")), path, ["doc_id"])


def write_blei(rows: DataFrame, path: str, docs: DataFrame | None = None, vocab: DataFrame | None = None) -> None:
    """`N id:value ...`; weights within 1e-7 of a whole number are written whole. `vocab` goes to path.vocab."""
    w = F.col("weight").cast("double")
    text = _entries(rows.filter(F.abs(w) > 1e-7), docs, F.concat_ws(":", F.col("term_id").cast("string"), _number(w)))
    _save(text.select("doc_id", F.rtrim(F.concat_ws(" ", F.col("n").cast("string"), "text")).alias("line")), path, ["doc_id"])
    if vocab is not None:
        _save(vocab.select("term_id", F.col("token").alias("line")), path + ".vocab", ["term_id"])


def _repeated(rows: DataFrame, vocab: DataFrame, docs: DataFrame | None) -> DataFrame:
    named = rows.join(vocab.select("term_id", "token"), "term_id")
    return _entries(named, docs, F.array_join(F.array_repeat("token", F.col("weight").cast("int")), " "))


def truncated_weights(rows: DataFrame) -> DataFrame:
    """Rows whose weight a word-repeating format cannot hold."""
    return rows.filter(F.col("weight") != F.floor("weight"))


def write_low(rows: DataFrame, path: str, vocab: DataFrame, docs: DataFrame | None = None) -> None:
    """Number of documents, then each document's words, repeated int(weight) times."""
    text = cut(_repeated(rows, vocab, docs).select(F.col("doc_id").cast("long"), F.col("text").alias("line")))
    head = rows.sparkSession.createDataFrame([(-1, str(text.count()))], "doc_id long, line string")
    _save(_with_header(text, head), path, ["doc_id"])


def write_mallet(rows: DataFrame, path: str, vocab: DataFrame, meta: DataFrame | None = None) -> None:
    """`docid lang words`; `meta(doc_id, name, lang)` defaults to the document number and `__unknown__`."""
    text = _repeated(rows, vocab, meta)
    text = text.select("*", F.col("doc_id").cast("string").alias("name"), F.lit("__unknown__").alias("lang")) if meta is None \
        else text.join(meta, "doc_id")
    _save(text.select("doc_id", F.rtrim(F.concat_ws(" ", "name", "lang", "text")).alias("line")), path, ["doc_id"])


def write_vw(rows: DataFrame, path: str, docs: DataFrame | None = None) -> None:
    """`| id:count ...` per document."""
    text = _entries(rows, docs, F.concat_ws(":", F.col("term_id").cast("string"), _number(F.col("weight").cast("double"))))
    _save(text.select("doc_id", F.rtrim(F.concat_ws(" ", F.lit("|"), "text")).alias("line")), path, ["doc_id"])


# ---------------------------------------------------------------- vocabularies and vectors
def write_word2vec_text(embedding: DataFrame, path: str, counts: DataFrame | None = None, decimals: int = 6,
                        header: bool = True, vocab_path: str | None = None) -> None:
    """`V d`, then `word f1 ... fd` by descending count; `header=False` gives the GloVe layout."""
    e = embedding if counts is None else embedding.join(counts.select("word", "count"), "word")
    e = e if "count" in e.columns else e.withColumn("count", F.lit(0))
    numbers = F.array_join(F.transform(F.col("vector").cast("array<double>"), lambda x: F.format_string(f"%.{decimals}f", x)), " ")
    rows = cut(e.select((-F.col("count")).cast("long").alias("o"), "word", F.concat_ws(" ", "word", numbers).alias("line")))
    if header:
        n, dim = rows.count(), embedding.select(F.size("vector")).first()
        head = rows.sparkSession.createDataFrame([(-(1 << 62), "", f"{n} {0 if dim is None else dim[0]}")], rows.schema)
        _save(_with_header(rows, head), path, ["o", "word"])
    else:
        _save(rows, path, ["o", "word"])
    if vocab_path is not None:
        _save(e.select((-F.col("count")).alias("o"), "word", F.concat_ws(" ", "word", F.col("count").cast("string")).alias("line")),
              vocab_path, ["o", "word"])


def glove_to_word2vec(spark: SparkSession, source: str, target: str) -> None:
    """Put the `V d` line in front of header-less vectors."""
    from vectorloom.sources.readers import numbered_lines

    lines = cut(numbered_lines(spark, source).select(F.col("line").alias("o"), F.col("value").alias("line")))
    dim = len(lines.filter("o = 0").first()["line"].split(" ")) - 1
    head = spark.createDataFrame([(-1, f"{lines.count()} {dim}")], "o long, line string")
    _save(_with_header(lines, head), target, ["o"])


def write_vocab_text(vocab: DataFrame, path: str, by_df: bool = False) -> None:
    """`id<TAB>word<TAB>df`, ordered by word or by falling df."""
    keys = [(-F.col("df")).alias("o"), "token"] if by_df else [F.lit(0).alias("o"), "token"]
    _save(vocab.select(*keys, F.concat_ws("\t", F.col("term_id").cast("string"), "token", F.col("df").cast("string")).alias("line")),
          path, ["o", "token"])


def read_vocab_text(spark: SparkSession, path: str) -> DataFrame:
    """(term_id, token, df); a word listed twice is an error."""
    p = F.split("value", "\t")
    rows = spark.read.text(path).select(
        F.get(p, F.lit(0)).cast("long").alias("term_id"), F.get(p, F.lit(1)).alias("token"), F.get(p, F.lit(2)).cast("long").alias("df"))
    checked = rows.groupBy("token").agg(F.count("*").alias("_n"), F.min("term_id").alias("term_id"), F.min("df").alias("df"))
    return checked.filter(F.assert_true(F.col("_n") == 1, F.concat(F.lit("word listed twice: "), F.col("token"))).isNull()).select(
        "term_id", "token", "df")


# ---------------------------------------------------------------- tensors and runs
def write_coo_tensor(tensor: DataFrame, path: str) -> None:
    """Coordinate tensor as parquet under order=<number of modes>."""
    modes = [m for m in "ijkl" if m in tensor.columns]
    tensor.select(*modes, "value").write.mode("errorifexists").parquet(f"{path}/order={len(modes)}")


def save_run(path: str, method: str, num_docs: int, min_count: int, dim: int, embedding: DataFrame,
             extras: dict[str, DataFrame] | None = None, elapsed: float = 0.0) -> str:
    """runs/<method>/<docs>_<min_count>_<dim>/ with vectors, metadata and further tables; returns the folder."""
    run = f"{path}/runs/{method}/{num_docs}_{min_count}_{dim}"
    embedding.write.mode("errorifexists").parquet(f"{run}/vectors")
    meta = embedding.agg(F.count("*").alias("vocab_size")).select(
        F.lit(method).alias("method"), F.lit(num_docs).alias("num_docs"), F.lit(min_count).alias("min_count"),
        F.lit(dim).alias("dim"), "vocab_size", F.lit(float(elapsed)).alias("elapsed"))
    meta.write.mode("errorifexists").json(f"{run}/metadata")
    for name, extra in (extras or {}).items():
        extra.write.mode("errorifexists").parquet(f"{run}/{name}")
    return run
