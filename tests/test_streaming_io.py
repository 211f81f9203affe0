import pytest
from pyspark.sql import functions as F

from vectorloom.operators import vocab as v
from vectorloom.sources import readers as rd
from vectorloom.sources import writers as wr
from vectorloom.streaming import incremental as inc


@pytest.fixture
def stream_dir(tmp_path, toy):
    toy.repartition(3).write.parquet(str(tmp_path / "in"))
    return tmp_path


def test_stream_vocab_equals_batch_and_resumes(spark, toy, stream_dir):
    stream, state = str(stream_dir / "in"), str(stream_dir / "state")
    inc.stream_vocab(inc.file_stream(spark, stream), state)
    want = sorted(map(tuple, v.token_counts(toy).collect()))
    assert sorted(map(tuple, inc.read_vocab(spark, state).select("token", "df", "cf").collect())) == want
    toy.coalesce(1).write.mode("append").parquet(stream)
    inc.stream_vocab(inc.file_stream(spark, stream), state)
    assert inc.read_vocab(spark, state).agg(F.sum("cf")).first()[0] == 2 * sum(t[2] for t in want)


def test_merged_batches_count_once(spark, toy, tmp_path, monkeypatch):
    """Five batches, merged after every second one, and a replay of a batch that is merged already."""
    monkeypatch.setattr(inc, "MERGE_EVERY", 2)
    path, state = str(tmp_path / "in"), str(tmp_path / "state")
    for _ in range(5):
        toy.coalesce(1).write.mode("append").parquet(path)
    inc.stream_phrases(inc.file_stream(spark, path), state)
    assert spark.read.parquet(f"{state}/merged").select("upto").distinct().count() == 2
    want = {r["key"]: 5 * r["count"] for r in inc.phrases.phrase_counts(toy).collect()}
    assert {r["key"]: r["count"] for r in inc.read_phrases(spark, state).collect()} == want
    inc.phrases.phrase_counts(toy).write.mode("overwrite").parquet(f"{state}/counts/batch=1")
    inc._summed(spark, state, ["key"], ["count"], 1).write.mode("overwrite").parquet(f"{state}/merged/upto=1")
    assert {r["key"]: r["count"] for r in inc.read_phrases(spark, state).collect()} == want


def test_late_rows_are_dropped(spark, tmp_path):
    path, state = str(tmp_path / "in"), str(tmp_path / "state")
    times = [["2024-01-01 10:00:00", "2024-01-01 11:00:00"], ["2024-01-09 10:00:00"], ["2024-01-01 12:00:00", "2024-01-09 11:00:00"]]
    for part in times:
        spark.createDataFrame([(t, "x") for t in part], "t string, token string").select(
            F.to_timestamp("t").alias("ts"), "token").coalesce(1).write.mode("append").parquet(path)
        inc.stream_topic_slices(inc.file_stream(spark, path), state)
    got = {r["slice"].strftime("%d"): r["n"] for r in inc.read_topic_slices(spark, state).collect()}
    assert got == {"01": 2, "09": 2}


def test_matrix_market_keeps_empty_documents(spark, tmp_path):
    path = str(tmp_path / "mm")
    rows = spark.createDataFrame([(0, 1, 2.5), (2, 0, 1.0), (2, 3, 1e-13)], "doc_id long, term_id long, weight double")
    wr.write_matrix_market(rows, path, num_docs=4)
    back = rd.read_matrix_market(spark, path, with_empty=True).collect()
    assert sorted((r["doc_id"], r["term_id"], r["weight"]) for r in back if r["term_id"] is not None) == [(0, 1, 2.5), (2, 0, 1.0)]
    assert {r["doc_id"] for r in back} == {0, 1, 2, 3}


def test_text_formats(spark, tmp_path):
    def file(name, text):
        p = tmp_path / name
        p.write_text(text)
        return str(p)

    svm = rd.read_svmlight(spark, file("svm", "# top\n0 qid:1 1:1.0 3:2.0 # note\n\n1 2:4.5\n")).collect()
    assert sorted((r["doc_id"], r["target"], r["term_id"], r["weight"]) for r in svm) == [(0, "0", 0, 1.0), (0, "0", 2, 2.0), (1, "1", 1, 4.5)]
    with pytest.raises(Exception, match="bad entry count"):
        rd.read_blei(spark, file("blei", "3 0:1 1:1\n")).collect()
    vec = rd.read_word2vec_text(spark, file("w2v", "3 2\nnew york 1 2\na 3 4\na 5 6\nbad 1\n")).orderBy("word").collect()
    assert [(r["word"], r["vector"]) for r in vec] == [("a", [3.0, 4.0]), ("new york", [1.0, 2.0])]
    q = rd.read_analogy_questions(spark, file("q", ": capitals\nA B C D\nbad line\n: gram1\nw x y z\n")).collect()
    assert sorted((r["category"], r["family"], r["answer"]) for r in q) == [("capitals", "semantic", "D"), ("gram1", "syntactic", "z")]
    o = rd.read_outlier_groups(spark, file("Q1.txt", "a1\nb1\n\nx1\n")).collect()
    assert sorted((r["group_id"], r["word"], r["is_outlier"]) for r in o) == [("Q1", "a1", False), ("Q1", "b1", False), ("Q1", "x1", True)]
    lab = rd.read_labelled_words(spark, file("pos", "run VB NN\nred JJ\nred NN\n")).collect()
    assert [(r["word"], r["label"]) for r in lab] == [("red", "JJ")]
    t8 = rd.read_text8(spark, file("t8", "One, two <b> (three) a=b four"), 2).orderBy("sentence").collect()
    assert [r["tokens"] for r in t8] == [["one", "two"], ["three", "four"]]
    br = rd.read_tagged_tokens(spark, file("brown", "The/AT dog/NN ./. x/y/z\n./.\n")).collect()
    assert [r["tokens"] for r in br] == [["the/AT", "dog/NN"]]
    csv = rd.read_csv_corpus(spark, file("c.csv", "l;x;y\na;1;2.5\n"), labels=True, header=True, sep=";").collect()
    assert [(r["doc_id"], r["term_id"], r["weight"]) for r in csv] == [(0, 0, 1.0), (0, 1, 2.5)]


def test_line_numbers_cross_files(spark, tmp_path):
    p = str(tmp_path / "lines")
    spark.range(1000).repartitionByRange(5, "id").sortWithinPartitions("id").select(F.col("id").cast("string").alias("v")).write.text(p)
    assert all(r["line"] == int(r["value"]) for r in rd.numbered_lines(spark, p).collect())


def test_duplicate_vocab_word_is_an_error(spark, tmp_path):
    (tmp_path / "v.txt").write_text("0\ta\t1\n1\ta\t2\n")
    with pytest.raises(Exception, match="word listed twice"):
        wr.read_vocab_text(spark, str(tmp_path / "v.txt")).collect()
