"""Evaluation queries; word lists and questions are derived from the embeddings table by position."""

from pyspark.sql import functions as F

from vectorloom.functions import vectors as vx
from vectorloom.operators import evaluate as ev
from vectorloom.operators import weight as w
from vectorloom.plans.registry import documents, query, r6, table
from vectorloom.plans.search_queries import DOT, EMB, embedding, word_of, word_vectors
from vectorloom.plans.weight_queries import TFIDF_SQL, corpus_tfidf

RANKED = ("rk AS (SELECT *, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rs, "
          "rank() OVER (ORDER BY h) + (count(*) OVER (PARTITION BY h) - 1) / 2.0 AS rh FROM sc)")
MEAN = "mv AS (SELECT list(m ORDER BY i) AS m FROM (SELECT i, avg(x) AS m FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS i FROM emb) GROUP BY i))"


def word_pairs(spark, d):
    """Every word with the word seven places on (unknown past the end); score = label distance."""
    e = table(spark, d, "embeddings").select("vec_id", "label")
    return e.select(word_of(F.col("vec_id")).alias("w1"), word_of(F.col("vec_id") + 7).alias("w2"),
                    (F.col("label") + F.col("vec_id") % 5).alias("score"))


_SIM = (f"WITH {EMB}, {MEAN}, sc AS (SELECT round({DOT.format('x.v', 'coalesce(y.v, m)')}, 6) AS s, CAST(x.label + x.idx % 5 AS DOUBLE) AS h "
        "FROM emb x {} emb y ON y.idx = x.idx + 7, mv), ")


@query("eval_similarity", _SIM.format("LEFT JOIN") + f"{RANKED} SELECT round(corr(rs, rh), 6) AS correlation FROM rk")
def _(spark, d):
    return ev.eval_similarity(word_pairs(spark, d), embedding(spark, d)).select(r6(F.col("correlation"), "correlation"))


@query("eval_similarity_drop", _SIM.format("JOIN") + f"{RANKED} SELECT round(corr(rs, rh), 6) AS correlation FROM rk")
def _(spark, d):
    return ev.eval_similarity(word_pairs(spark, d), embedding(spark, d), missing="drop").select(
        r6(F.col("correlation"), "correlation"))


# questions: consecutive words; the last ones name unknown words
Q = ("q AS (SELECT idx AS query_id, word AS a, 'w' || lpad(CAST(idx + 1 AS VARCHAR), 8, '0') AS b, 'w' || lpad(CAST(idx + 2 AS VARCHAR), 8, '0') AS c, "
     "'w' || lpad(CAST(CASE WHEN idx % 3 = 0 THEN idx + 2 ELSE idx + 3 END AS VARCHAR), 8, '0') AS answer, 'label' || CAST(label AS VARCHAR) AS category FROM emb)")


def questions(spark, d):
    e = table(spark, d, "embeddings")
    i = F.col("vec_id")
    return e.select(i.alias("query_id"), word_of(i).alias("a"), word_of(i + 1).alias("b"), word_of(i + 2).alias("c"),
                    word_of(F.when(i % 3 == 0, i + 2).otherwise(i + 3)).alias("answer"),
                    F.concat(F.lit("label"), F.col("label").cast("string")).alias("category"))


def _predict_sql(vec, method="add", exclude=True, missing="mean"):
    join = "LEFT JOIN" if missing == "mean" else "JOIN"
    fill = (lambda x: f"coalesce({x}.{vec}, m)") if missing == "mean" else (lambda x: f"{x}.{vec}")
    mean = "mv" if vec == "v" else "mv"
    dots = {r: DOT.format(f"w.{vec}", r) for r in ("qa", "qb", "qc")}
    if method == "add":
        score = f"{dots['qb']} - {dots['qa']} + {dots['qc']}"
    else:
        score = " + ".join(f"{sign}ln((1 + {dots[r]}) / 2 + 1e-5)" for r, sign in (("qb", ""), ("qa", "-"), ("qc", "")))
    where = "WHERE w.word NOT IN (z.a, z.b, z.c)" if exclude else ""
    return (f"z AS (SELECT q.*, {fill('x')} AS qa, {fill('y')} AS qb, {fill('t')} AS qc FROM q {join} un x ON x.word = q.a {join} un y ON y.word = q.b "
            f"{join} un t ON t.word = q.c{', ' + mean if missing == 'mean' else ''}), "
            f"pr AS (SELECT query_id, predicted FROM (SELECT z.query_id, w.word AS predicted, round({score}, 6) AS sc FROM z, un w {where}) "
            "QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sc DESC, predicted) = 1)")


def _acc_sql(total="all", source="q"):
    return (f"jd AS (SELECT {source}.*, coalesce(predicted = answer, false) AS ok FROM {source} LEFT JOIN pr USING (query_id)) "
            f"SELECT coalesce(category, '{total}') AS category, avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END) AS accuracy, "
            "count(*) FILTER (ok) AS correct, count(*) AS count FROM jd GROUP BY ROLLUP (category)")


for _m in ("add", "mul"):
    @query(f"predict_analogies_{_m}", f"WITH {EMB}, {MEAN}, {Q}, {_predict_sql('v', _m)} SELECT query_id, predicted FROM pr")
    def _(spark, d, m=_m):
        return ev.predict_analogies(questions(spark, d), embedding(spark, d), m)

    @query(f"eval_analogy_{_m}", f"WITH {EMB}, {MEAN}, {Q}, {_predict_sql('v', _m)}, {_acc_sql()}")
    def _(spark, d, m=_m):
        return ev.eval_analogy(questions(spark, d), embedding(spark, d), m)


@query("accuracy_sections",
       f"WITH {EMB}, {Q.replace('q AS', 'q0 AS', 1)}, q AS (SELECT * FROM q0 WHERE a IN (SELECT word FROM emb) AND b IN (SELECT word FROM emb) "
       f"AND c IN (SELECT word FROM emb) AND answer IN (SELECT word FROM emb)), {_predict_sql('u', missing='drop')}, {_acc_sql('total')}")
def _(spark, d):
    return ev.accuracy(questions(spark, d), embedding(spark, d), case_insensitive=True)


@query("deterministic_analogies",
       f"WITH {EMB}, {Q}, {_predict_sql('u', exclude=False, missing='drop')}, {_acc_sql()}")
def _(spark, d):
    return ev.deterministic_analogies(questions(spark, d), embedding(spark, d))


@query("eval_wordrep",
       f"WITH {EMB}, p AS (SELECT 'label' || CAST(label AS VARCHAR) AS category, row_number() OVER (PARTITION BY label ORDER BY idx) - 1 AS pos, "
       "word AS l, 'w' || lpad(CAST(idx + 1 AS VARCHAR), 8, '0') AS r FROM emb), k AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY category ORDER BY pos) <= 1000), "
       "q AS (SELECT x.category || '|' || x.pos || '|' || y.pos AS query_id, x.l AS a, x.r AS b, y.l AS c, y.r AS answer, x.category "
       f"FROM k x JOIN k y ON x.category = y.category AND x.pos <> y.pos), {MEAN}, {_predict_sql('v')}, {_acc_sql()}")
def _(spark, d):
    from pyspark.sql import Window as W

    e = embedding(spark, d)
    pos = F.row_number().over(W.partitionBy("label").orderBy("idx")) - 1
    pairs = e.select(F.concat(F.lit("label"), F.col("label").cast("string")).alias("category"), pos.alias("pos"),
                     F.col("word").alias("left"), word_of(F.col("idx") + 1).alias("right"))
    return ev.eval_wordrep(pairs, e)


@query("eval_semeval_relations",
       f"WITH {EMB}, {MEAN}, pr AS (SELECT x.label AS category, list_transform(list_zip(x.v, coalesce(y.v, m)), lambda z: z[1] - z[2]) AS dv "
       "FROM emb x LEFT JOIN emb y ON y.idx = x.idx + 1, mv WHERE x.idx % 4 = 0), "
       "pm AS (SELECT category, list(mm ORDER BY i) AS p FROM (SELECT category, i, avg(z) AS mm FROM (SELECT category, unnest(dv) AS z, "
       "generate_subscripts(dv, 1) AS i FROM pr) GROUP BY ALL) GROUP BY category), "
       "qs AS (SELECT x.label AS category, 'f' || CAST(x.label % 3 AS VARCHAR) AS family, list_transform(list_zip(x.v, coalesce(y.v, m)), "
       "lambda z: z[1] - z[2]) AS dv, CAST(x.idx * 7 % 13 AS DOUBLE) AS h FROM emb x LEFT JOIN emb y ON y.idx = x.idx + 3, mv), "
       f"sc AS (SELECT category, family, round({DOT.format('p', 'dv')}, 6) AS s, h FROM qs JOIN pm USING (category)), "
       "rk AS (SELECT *, rank() OVER (PARTITION BY category ORDER BY s) + (count(*) OVER (PARTITION BY category, s) - 1) / 2.0 AS rs, "
       "rank() OVER (PARTITION BY category ORDER BY h) + (count(*) OVER (PARTITION BY category, h) - 1) / 2.0 AS rh FROM sc), "
       "co AS (SELECT category, family, corr(rs, rh) AS c FROM rk GROUP BY ALL) "
       "SELECT coalesce(family, 'all') AS family, round(avg(c), 6) AS correlation FROM co GROUP BY ROLLUP (family)")
def _(spark, d):
    e = table(spark, d, "embeddings")
    i = F.col("vec_id")
    prototypes = e.filter(i % 4 == 0).select(F.col("label").alias("category"), word_of(i).alias("left"), word_of(i + 1).alias("right"))
    asked = e.select(F.col("label").alias("category"), F.concat(F.lit("f"), (F.col("label") % 3).cast("string")).alias("family"),
                     word_of(i).alias("left"), word_of(i + 3).alias("right"), (i * 7 % 13).alias("score"))
    return ev.eval_semeval_relations(prototypes, asked, embedding(spark, d)).select("family", r6(F.col("correlation"), "correlation"))


@query("purity",
       "WITH n AS (SELECT quality AS c, source AS t, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL), "
       "b AS (SELECT t, max(n) AS m, sum(n) AS s FROM n GROUP BY t) SELECT round(sum(m) / sum(s), 6) AS purity FROM b")
def _(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return ev.purity(rows, "quality", "source").select(r6(F.col("purity"), "purity"))


@query("eval_categorization")
def _(spark, d):
    return ev.eval_categorization(embedding(spark, d), seeds=2)


# groups of eight words and one outlier, in table order
_GR = "g AS (SELECT CAST(floor(idx / 9) AS BIGINT) AS group_id, idx % 9 AS pos, word, idx % 9 = 8 AS o, u, v FROM un)"
_CASES2 = (f"{_GR}, cl AS (SELECT * FROM g WHERE NOT o), ot AS (SELECT * FROM g WHERE o), sz AS (SELECT group_id, count(*) AS m FROM cl GROUP BY 1), "
           f"pp AS (SELECT x.group_id, x.pos AS i, y.pos AS j, {DOT.format('x.u', 'y.u')} AS s FROM cl x JOIN cl y ON x.group_id = y.group_id AND x.pos < y.pos), "
           f"ow AS (SELECT group_id, round(sum(s), 6) AS own FROM pp GROUP BY 1), so AS (SELECT ot.group_id, ot.word AS outlier, cl.pos, {DOT.format('cl.u', 'ot.u')} AS s FROM cl JOIN ot USING (group_id)), "
           "ci AS (SELECT a.group_id, a.outlier, a.pos, round((SELECT sum(s) FROM so b WHERE b.group_id = a.group_id AND b.outlier = a.outlier AND b.pos <> a.pos) + "
           "(SELECT sum(s) FROM pp WHERE pp.group_id = a.group_id AND i <> a.pos AND j <> a.pos), 6) AS c FROM so a), "
           "op AS (SELECT ci.group_id, outlier, count(*) FILTER (c < own) AS op, any_value(m) AS size FROM ci JOIN ow USING (group_id) JOIN sz USING (group_id) GROUP BY 1, 2)")


def groups(spark, d):
    e = table(spark, d, "embeddings")
    i = F.col("vec_id")
    return e.select(F.floor(i / 9).cast("long").alias("group_id"), (i % 9).alias("pos"), word_of(i).alias("word"), (i % 9 == 8).alias("is_outlier"))


@query("outlier_positions", f"WITH {EMB}, {_CASES2} SELECT group_id, outlier, op, size FROM op")
def _(spark, d):
    return ev.outlier_positions(groups(spark, d), embedding(spark, d), 2)


@query("eval_outliers",
       f"WITH {EMB}, {_CASES2}, pg AS (SELECT group_id, count(*) FILTER (NOT o) AS nc, count(*) FILTER (o) AS no FROM g GROUP BY 1) "
       "SELECT round(avg(op * 1.0 / size) * 100, 6) AS opp, round(avg(CASE WHEN op = size THEN 1.0 ELSE 0.0 END) * 100, 6) AS accuracy, count(*) AS cases, "
       "0.0::DOUBLE AS filtered_cluster_items, 0.0::DOUBLE AS filtered_outliers, "
       "(SELECT round(avg(CASE WHEN nc < 2 OR no < 1 THEN 1.0 ELSE 0.0 END) * 100, 6) FROM pg) AS filtered_groups FROM op")
def _(spark, d):
    out = ev.eval_outliers(groups(spark, d), embedding(spark, d), 2)
    return out.select(*[F.col(c) if c == "cases" else r6(F.col(c), c) for c in out.columns])


@query("outlier_positions_triples")
def _(spark, d):
    return ev.outlier_positions(groups(spark, d), embedding(spark, d), 3)


@query("eval_word_classification")
def _(spark, d):
    return ev.eval_word_classification(embedding(spark, d), "word", shares=(0.5, 1.0))


@query("eval_sentiment")
def _(spark, d):
    vectors = w.docs_to_vectors(documents(spark, d), word_vectors(spark, d), 64, how="sum")
    return ev.eval_sentiment(vectors, table(spark, d, "labels").select("doc_id", "quality"))


@query("learned_analogy")
def _(spark, d):
    q = questions(spark, d)
    train, test = w.hashed_split(q, ["query_id"], 0.85)
    return ev.learned_analogy(train, test, embedding(spark, d), steps=50)


def _half(e):
    return e.withColumn("vector", F.slice("vector", 1, 32))


@query("compare_embeddings",
       f"WITH {EMB}, m AS (SELECT 'label' || CAST(x.label AS VARCHAR) AS metric, {DOT.format('x.v', 'y.v')} AS f, "
       f"{DOT.format('x.v[1:32]', 'y.v[1:32]')} AS h FROM emb x JOIN emb y ON y.idx = x.idx + 1) "
       "SELECT metric, round(avg(f), 6) AS full_mean, round(stddev_pop(f), 6) AS full_std, round(avg(h), 6) AS half_mean, "
       "round(stddev_pop(h), 6) AS half_std FROM m GROUP BY metric")
def _(spark, d):
    e = embedding(spark, d)
    parts = []
    for name, table_ in (("full", e), ("half", _half(e))):
        nxt = table_.select((F.col("idx") - 1).alias("idx"), F.col("vector").alias("_n"))
        parts.append(table_.join(nxt, "idx").select(
            F.concat(F.lit("label"), F.col("label").cast("string")).alias("metric"), F.lit(name).alias("method"),
            (F.col("idx") % 3).alias("seed"), vx.dot(F.col("vector"), F.col("_n")).alias("value")))
    out = ev.compare_embeddings(parts[0].unionByName(parts[1]), ["full", "half"])
    return out.select("metric", *[r6(F.col(c), c) for c in out.columns if c != "metric"])


@query("eval_all")
def _(spark, d):
    e = embedding(spark, d)
    return ev.eval_all(e, word_pairs(spark, d), questions(spark, d), e)


@query("search_hyperparams")
def _(spark, d):
    return ev.search_hyperparams(embedding(spark, d), "word", "label", trials=2, restarts=1, shares=(1.0,))


@query("human_similarity_correlation",
       f"WITH {TFIDF_SQL}, p AS (SELECT x.doc_id AS a, sum(x.w * y.w) AS s FROM tfidf x JOIN tfidf y ON y.doc_id = x.doc_id + 1 AND x.token = y.token GROUP BY 1), "
       "h AS (SELECT x.doc_id AS a, CASE WHEN x.lang = y.lang THEN 1.0 ELSE 0.0 END AS h FROM documents x JOIN documents y ON y.doc_id = x.doc_id + 1) "
       "SELECT round(corr(coalesce(s, 0), h), 6) AS correlation FROM h LEFT JOIN p USING (a)")
def _(spark, d):
    from vectorloom.operators.distance import cossim
    from vectorloom.plans.search_queries import neighbours

    pairs = neighbours(spark, d)
    langs = table(spark, d, "documents").select("doc_id", "lang")
    human = (pairs.join(langs.select(F.col("doc_id").alias("a"), F.col("lang").alias("la")), "a")
             .join(langs.select(F.col("doc_id").alias("b"), F.col("lang").alias("lb")), "b")
             .select("a", "b", (F.col("la") == F.col("lb")).cast("double").alias("human")))
    model = cossim(pairs, corpus_tfidf(spark, d), key="token")
    return ev.human_similarity_correlation(model, human).select(r6(F.col("correlation"), "correlation"))


