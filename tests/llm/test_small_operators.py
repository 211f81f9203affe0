"""Language id, toxicity, mixing, quality rules, URL cascade, separator scan and nearest neighbours."""

import random
import uuid

import duckdb
import numpy as np
import pandas as pd
import pytest
from conftest import edge_rows
from pyspark.sql import functions as F

from vectorloom.llm import cross_polytope, language_id, mixing, quality, queries, separator_scan, tokens, toxicity, url_filter

SF = "/root/testdata/sf0.01"


# ---- language id
def test_bundle_is_the_sum_of_bound_letters():
    dims, text = 64, "Ab c!!d"
    letters = {c: language_id.letter_vector(0 if c == " " else ord(c), dims).astype(int) for c in " abcd"}
    want = sum(np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c] for a, b, c in zip(" ab c d ", "ab c d ", "b c d "))
    got = language_id._bundles([text.encode(), b"", b"12"], np.arange(3), 3, dims)
    assert (got[0] == want).all() and not got[1:].any()


def test_language_edges(edges, nothing):
    rows = language_id.language_id(edges).collect()
    assert len(rows) == len(edge_rows())
    told = {r.doc_id: r for r in rows}
    assert all(told[i].lang_pred == "und" and told[i].score == 0 for i in (100, 101, 102, 103))
    assert all(told[i].lang_pred == ("de", "en")[i % 2] for i in range(24) if i % 4 and i != 3) and all(0 <= r.score <= 1 for r in rows)
    assert language_id.language_id(nothing).count() == 0
    assert {r.lang_pred for r in language_id.language_id(edges.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = language_id.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97


# ---- toxicity
def test_toxicity_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    hits = sum(r.predicted and r.toxic for r in rows)
    assert hits > 0.8 * sum(r.toxic for r in rows) and hits > 0.85 * sum(r.predicted for r in rows)
    assert all(r.predicted == (r.score >= 0.5) for r in rows)


def test_toxicity_edges(spark, edges, nothing):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(24)] + [(100, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity(edges, labels).collect()
    assert len(rows) == len(edge_rows()) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (100, 101, 102)}) == 1
    assert toxicity.toxicity(nothing, labels).count() == 0
    assert {r.predicted for r in toxicity.toxicity(edges, labels.limit(0)).collect()} == {0}


def test_label_model_finds_the_good_voters():
    rng = np.random.default_rng(1)
    toxic = rng.random(3000) < 0.1
    good = [(toxic & (rng.random(3000) < 0.5)) for _ in range(5)]
    noise = [rng.random(3000) < 0.2 for _ in range(2)]
    votes = np.stack(good + noise, 1).astype(np.float32)
    fired = np.array([1.0] * 5 + [0, 0])
    posterior = toxicity.label_model(votes, fired, fired, 5)
    assert np.mean((posterior > 0.5) == toxic) > 0.97
    weights, bias = toxicity.train_classifier(votes, posterior)
    assert weights[:5].min() > 2 and np.abs(weights[5:]).max() < 1 and bias < -2


# ---- mixing
def fill(sizes, weights, share, most):
    """Targets by resharing what full sources cannot take, one round after the other."""
    total, target, open_ = share * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        level = (total - sum(target[i] for i in range(len(sizes)) if i not in open_)) / sum(weights[i] for i in open_)
        full = {i for i in open_ if weights[i] * level >= most * sizes[i]}
        for i in open_:
            target[i] = most * sizes[i] if i in full else weights[i] * level
        if not full:
            break
        open_ -= full
    return target


def test_mix(edges, nothing):
    rows = mixing.pareto_mix(edges).collect()
    want = {}
    for r in edge_rows():
        want[r[3]] = want.get(r[3], 0) + len((r[1] or "").encode().split())
    names = sorted((k for k in want if k is not None)) + [None]
    targets = dict(zip(names, fill([want[k] for k in names], [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5, 2)))
    sources = {}
    for r in edge_rows():
        sources.setdefault(r[0], set()).add(r[3])
    assert sorted(set(round(r.target, 6) for r in rows)) == sorted(set(round(t, 6) for t in targets.values()))
    assert all(0 <= r.taken <= 2 * r.size for r in rows) and len(rows) == len(edge_rows())
    for name, target in targets.items():
        mine = [r for r in rows if round(r.target, 6) == round(target, 6)]
        assert abs(sum(r.taken for r in mine) - target) <= max((r.size for r in mine), default=0)
    again = mixing.pareto_mix(edges.repartition(2)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert mixing.pareto_mix(nothing).count() == 0


# ---- quality rules
def test_quality_rules_equal_sql(edges, nothing, monkeypatch):
    got = quality.quality_filter(edges).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    documents = pd.DataFrame(edge_rows(), columns=["doc_id", "text", "lang", "source", "n_chars"])  # noqa: F841
    want = duckdb.sql(queries.QUALITY_SQL).fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert quality.quality_filter(nothing).count() == 0


def test_repeated_words(written):
    cases = {"": 0, "a b c d e f g h": 0, "a b c d e f g h a b c d e f g h": 16, "a " * 9: 9, "a " * 8: 0,
             "1 2 3 4 5 6 7 8 x 1 2 3 4 5 6 7 8 y 2 3 4 5 6 7 8 y": 8 + 1 + 9 + 8 - 1}
    texts = list(cases)
    rows = quality.signals(written([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")).collect()
    for r in rows:
        words = texts[r.doc_id].split()
        windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
        covered = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(8)}
        assert r.n_repeat_words == len(covered), texts[r.doc_id]


# ---- URL cascade
def test_urls(spark):
    urls = [None, "", "http://", "x.net/a", "http://Net/", "https://a.NET", "http://a.net/x?y://z.org/fr/", "ftp://example.net/en/1", "http://example.net/e",
            "http://b.example.net/en/", "http://bexample.net/en/", "http://example.com/de/x#y", "http://example.com/d", "http://w.org/fr/", "http://org/fr",
            "http://.net/", "http://a.net./", "://net/", "http://a.net/x", "http://a.net/x", "HTTP://EXAMPLE.COM/DE/", "http://x.net#/", "mailto:a@b.net/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    frame = pd.DataFrame(list(enumerate(urls)), columns=["page_id", "url"])  # noqa: F841
    want = duckdb.sql(queries.URL_SQL.replace("FROM pages", "FROM frame")).fetchall()
    want = [(a, h or "", p or "", r, v) for a, h, p, r, v in want]
    assert sorted(map(tuple, url_filter.judge_urls(pages, queries.URL_RULES).collect()), key=str) == sorted(want, key=str)
    assert url_filter.judge_urls(pages.limit(0), queries.URL_RULES).count() == 0


def test_cascade_is_exact_on_its_universe(spark):
    keys = [f"host{i}.org/{i % 7}" for i in range(20_000)]
    listed = keys[::23] + ["not in the universe/"]
    levels = url_filter.build_cascade(spark.createDataFrame([(k,) for k in keys], "key string"), listed)
    assert len(levels) > 1
    assert (url_filter.in_cascade(levels, url_filter.hashed_keys(keys)) == np.isin(keys, listed)).all()
    assert sum(x.size for x in levels) < 30 * len(listed)


# ---- separator scan
@pytest.mark.parametrize("block", [1, 7, 1000])
def test_token_counts_round_trip(spark, edges, block):
    path = f"{spark.sparkContext.getCheckpointDir()}/tokens-{uuid.uuid4().hex}"
    separator_scan.write_token_files(edges, path, file_docs=9)
    rows = separator_scan.token_counts(spark, path, block_tokens=block).collect()
    words = tokens.WordTokenizer()
    assert sorted(r.n_tokens for r in rows) == sorted(len(words.encode([r[1] or ""])[0]) // 4 for r in edge_rows())
    assert all(r.ended for r in rows)


def test_a_file_is_read_in_ranges(spark, tmp_path, monkeypatch):
    """A file over the bytes that Spark reads as one value; its blocks are rows of several tasks."""
    ids = np.random.default_rng(6).choice([0, 1, 2, 300], 5000, p=[0.01, 0.33, 0.33, 0.33]).astype("<u2")
    (tmp_path / "a token file.bin").write_bytes(ids.tobytes())
    (tmp_path / "empty.bin").write_bytes(b"")
    ends = np.flatnonzero(ids == 0)
    want = [*np.diff(np.concatenate(([-1], ends))) - 1, len(ids) - ends[-1] - 1]
    monkeypatch.setattr(separator_scan, "TASK_BYTES", 1000, raising=False)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 4000)
    try:
        rows = separator_scan.token_counts(spark, str(tmp_path), block_tokens=100).orderBy("doc").collect()
        blocks = separator_scan.scan_blocks(spark, str(tmp_path), block_tokens=100).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert [r.n_tokens for r in rows if r.n_tokens or r.ended] == [n for n in want[:-1]] + [n for n in want[-1:] if n]
    assert [r.ended for r in rows][:len(ends)] == [True] * len(ends) and sorted(b.block for b in blocks) == list(range(50))
    assert len({b.task for b in blocks}) > 3
    (tmp_path / "odd.bin").write_bytes(b"abc")
    with pytest.raises(Exception, match="not a whole number of tokens"):
        separator_scan.token_counts(spark, str(tmp_path)).collect()


def test_files_that_only_spark_reads(spark, tmp_path, monkeypatch):
    (tmp_path / "a.bin").write_bytes(np.array([5, 0, 0, 6, 7, 0, 8], "<u2").tobytes())
    monkeypatch.setattr(separator_scan, "_seekable", lambda path: False, raising=False)
    rows = separator_scan.token_counts(spark, str(tmp_path), block_tokens=2).orderBy("doc").collect()
    assert [(r.n_tokens, r.ended) for r in rows] == [(1, True), (0, True), (2, True), (1, False)]


def test_stitching(spark):
    rng = random.Random(4)
    blocks, want = [], {}
    for file in "abc":
        ids = [rng.choice([0, 1, 1, 1, 2]) for _ in range(rng.randint(1, 60))]
        counts, n = [], 0
        for x in ids:
            counts, n = (counts + [n], 0) if x == 0 else (counts, n + 1)
        want[file] = counts + [n] * (n > 0)
        for b in range(0, len(ids), 5):
            part = ids[b:b + 5]
            at = [i for i, x in enumerate(part) if x == 0]
            blocks.append((file, b // 5, len(at), len(part), at[0] if at else len(part), len(part) - at[-1] - 1 if at else len(part),
                           [j - i - 1 for i, j in zip(at, at[1:])]))
    frame = spark.createDataFrame(blocks, "file string, block long, n_separators long, n_tokens long, head long, tail long, inner array<long>")
    got = {}
    for r in separator_scan.stitch(frame).orderBy("file", "doc").collect():
        got.setdefault(r.file, []).append(r.n_tokens)
    assert got == {k: v for k, v in want.items() if v}


# ---- nearest neighbours
def near(rows, ids, k):
    v = {i: np.array(x, float) for i, x in zip(ids, rows)}
    return {q: sorted(((-float(v[q] @ v[i]), i) for i in v if i != q))[:k] for q in v if q % 20 == 0}


def test_neighbours_recall(spark):
    frame = spark.read.parquet(f"{SF}/embeddings.parquet")
    local = frame.orderBy("vec_id").toPandas()
    want = near(local["embedding"], local["vec_id"], 20)
    got = {}
    for r in cross_polytope.nearest(frame, F.col("id") % 20 == 0).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
        assert abs(r.score - float(np.array(local["embedding"][r.vec_id], float) @ np.array(local["embedding"][r.query_id], float))) < 1e-12
    assert set(got) == set(want) and all(sorted(x) == list(range(1, 21)) for x in got.values())
    assert np.mean([len({i for _, i in want[q]} & {i for i, _ in got[q].values()}) / 20 for q in want]) > 0.9


def test_neighbours_edges(spark, monkeypatch):
    rng = np.random.default_rng(0)
    good = [(i, (rng.normal(size=6) * rng.uniform(0.1, 9)).tolist(), 0) for i in range(120)]
    good += [(i, good[0][1], 0) for i in range(120, 200)] + [(200, good[5][1], 1)]
    bad = [(300, None, 0), (320, [0.0] * 6, 0), (340, [1.0, None, 1.0, 1.0, 1.0, 1.0], 0), (360, [float("nan")] * 6, 0), (380, [float("inf")] * 6, 0),
           (400, [1.0, 2.0], 0), (420, [], 0), (440, [1.0] * 9, 0), (None, [1.0] * 6, 0)]
    frame = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>, rank int")
    want = near([x for _, x, _ in good], [i for i, _, _ in good], 20)
    for cell in (cross_polytope.CELL_BYTES, 6 * 8 * 10):  # the second one splits crowded buckets
        monkeypatch.setattr(cross_polytope, "CELL_BYTES", cell)
        monkeypatch.setattr(cross_polytope, "PROBE_BYTES", cell)  # queries in small runs, too
        got = {}
        for r in cross_polytope.nearest(frame, F.col("id") % 20 == 0, probe_rate=99).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
        assert {q: [i for _, i in sorted(x)] for q, x in got.items()} == {q: [i for _, i in x] for q, x in want.items()}
    few = cross_polytope.nearest(spark.createDataFrame(good[:3], frame.schema), F.col("id") == 0).collect()
    assert len(few) <= 2
    assert cross_polytope.nearest(frame.limit(0), F.col("id") % 20 == 0).count() == 0


@pytest.mark.parametrize("norms", ["one outlier", "lognormal"])
def test_neighbours_of_uneven_norms(spark, norms):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x *= np.exp(rng.normal(size=3000) / 2)[:, None] if norms == "lognormal" else np.where(np.arange(3000) == 7, 100, 1)[:, None]
    frame = spark.createDataFrame(pd.DataFrame({"vec_id": range(3000), "embedding": x.tolist()}))
    got = {}
    for r in cross_polytope.nearest(frame, F.col("id") % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = near(x.tolist(), range(3000), 20)
    assert set(got) == set(want) and all(len(i) == 20 for i in got.values())
    assert np.mean([len({i for _, i in want[q]} & got[q]) / 20 for q in want]) > 0.9
