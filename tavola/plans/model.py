"""The guard's text model, its metrics, and the n-gram weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from tavola.operators import guardmodel as gm, metrics, textweights
from tavola.plans.guard import LOG, SCAN
from tavola.plans.registry import query

_GRAMS = """list_concat(list_concat(
    list_transform(range(1, len(x) - 1), lambda i: x[i] || x[i + 1] || x[i + 2]),
    list_transform(range(1, len(x) - 2), lambda i: x[i] || x[i + 1] || x[i + 2] || x[i + 3])),
    list_transform(range(1, len(x) - 3), lambda i: x[i] || x[i + 1] || x[i + 2] || x[i + 3] || x[i + 4]))"""


def _vocabulary(source: str, key: str, text: str) -> str:
    return rf"""
        docs AS (SELECT {key} AS id, string_split(regexp_replace(lower({text}), '\s\s+', ' ', 'g'), '') AS x FROM {source}),
        grams AS MATERIALIZED (SELECT id, unnest({_GRAMS}) AS gram FROM docs),
        tf AS MATERIALIZED (SELECT id, gram, count(*) AS tf FROM grams GROUP BY 1, 2),
        vocab AS (SELECT gram, count(*) AS df, ln((1.0 + (SELECT count(*) FROM docs)) / (1 + count(*))) + 1 AS idf
                  FROM tf GROUP BY 1 HAVING count(*) >= 2 AND count(*) <= 0.95 * (SELECT count(*) FROM docs))"""


@query(
    "o92_vocabulary",
    f"WITH {_vocabulary('documents', 'doc_id', 'text')} SELECT gram, df, round(idf, 6) AS idf FROM vocab",
)
def _(c):
    vocab = textweights.vocabulary(c.raw("documents").select("text"), "text")
    return vocab.withColumn("idf", F.round("idf", 6))


@query(
    "o92_weights",
    f"""WITH {_vocabulary('d_sql_log', 'log_id', 'sql')},
        w AS (SELECT id, tf.gram, tf * idf AS v FROM tf JOIN vocab USING (gram)),
        l AS (SELECT id, sqrt(sum(v * v)) AS len FROM w GROUP BY 1)
        SELECT w.id AS log_id, count(*) AS terms, round(sum(v / len), 6) AS total, round(max(v / len), 6) AS largest
        FROM w JOIN l USING (id) GROUP BY 1""",
)
def _(c):
    rows = textweights.weights(c.sql_log.select("log_id", "sql"), "log_id", "sql")
    return rows.groupBy("log_id").agg(
        F.count(F.lit(1)).alias("terms"),
        F.round(F.sum("weight"), 6).alias("total"),
        F.round(F.max("weight"), 6).alias("largest"),
    )


def _log(c):
    return c.sql_log.select("log_id", "sql", "label")


RANKED = """SELECT log_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(log_id || '#42')) AS rank,
                   count(*) OVER (PARTITION BY label) AS size FROM d_sql_log"""


@query(
    "o94_stratified_split",
    f"SELECT log_id, CAST(label AS BIGINT) AS label, rank <= floor(size * 0.2::DOUBLE + 0.5) AS is_test FROM ({RANKED})",
)
def _(c):
    return gm.stratified_split(_log(c), "log_id").select("log_id", "label", "is_test")


@query(
    "o98_folds",
    f"SELECT log_id, CAST(label AS BIGINT) AS label, rank % 5 AS fold FROM ({RANKED})",
)
def _(c):
    return gm.stratified_folds(_log(c), "log_id").select("log_id", "label", "fold")


@query("o93_holdout_metrics")
def _(c):
    return gm.holdout_metrics(_log(c), "log_id")


@query("o95_model_scan")
def _(c):
    split = gm.stratified_split(_log(c), "log_id")
    model = gm.fit(split.where("NOT is_test"))
    return model.scan(split.where("is_test").select("log_id", "sql"))


@query("o98_cross_validation")
def _(c):
    return gm.cross_validate(_log(c), "log_id")


@query("o100_top_features")
def _(c):
    log = _log(c)
    return gm.top_features(log, gm.fit(log))


VERDICTS = f"WITH {LOG} SELECT log_id, CASE WHEN layer = 'ml' THEN NULL ELSE allowed END AS allowed, CASE WHEN layer = 'ml' THEN NULL ELSE layer END AS layer FROM ({SCAN})"


@query("o95_rules_kept_by_model", VERDICTS)
def _(c):
    """What rules decide stays as it is in the whole cascade; the model decides all the rest."""
    log = _log(c)
    found = gm.fit(log).scan(log.select("log_id", "sql"))
    ruled = ~(F.col("layer").isNull() | (F.col("layer") == "ml"))
    return found.select("log_id", F.when(ruled, F.col("allowed")).alias("allowed"), F.when(ruled, F.col("layer")).alias("layer"))


@query(
    "o95_score_range",
    "SELECT count(*) AS statements, true AS in_range, CAST(20 AS BIGINT) AS features FROM d_sql_log",
)
def _(c):
    log = _log(c)
    model = gm.fit(log)
    scored = model.score(log).agg(
        F.count("*").alias("statements"), F.bool_and(F.col("score").between(0, 1)).alias("in_range")
    )
    return scored.join(gm.top_features(log, model).agg(F.count("*").alias("features")))


@query("o93_holdout_range", "SELECT count(*) > 0 AS in_range FROM d_sql_log")
def _(c):
    found = gm.holdout_metrics(_log(c), "log_id")
    names = ("precision", "recall", "f1", "roc_auc")
    return found.select(F.forall(F.array(*names), lambda x: x.between(0.9, 1.0)).alias("in_range"))


@query("o93_toxic_documents")
def _(c):
    """The classifier on real texts: labelled documents, held-out metrics."""
    labels = c.raw("labels").where(F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").alias("label"))
    docs = c.raw("documents").select("doc_id", F.col("text").alias("sql")).join(labels, "doc_id")
    return gm.holdout_metrics(docs, "doc_id")


# Metrics on a fixed score ------------------------------------------------------------------

SCORED = """s AS (SELECT doc_id, CAST(quality AS INT) AS label, (doc_id * 37 % 1000) / 1000.0::DOUBLE AS score FROM labels)"""


def _scored(c):
    return c.raw("labels").select(
        F.col("quality").alias("label"), (F.col("doc_id") * 37 % 1000 / 1000.0).alias("score")
    )


@query(
    "o96_metrics",
    f"""WITH {SCORED},
        k AS (SELECT CAST(count(*) FILTER (WHERE label = 1 AND score >= 0.5) AS DOUBLE) AS tp,
                     CAST(count(*) FILTER (WHERE label = 0 AND score >= 0.5) AS DOUBLE) AS fp,
                     CAST(count(*) FILTER (WHERE label = 1 AND score < 0.5) AS DOUBLE) AS fn,
                     CAST(count(*) FILTER (WHERE label = 0 AND score < 0.5) AS DOUBLE) AS tn FROM s),
        d AS (SELECT score, sum(label) AS pos, count(*) - sum(label) AS neg FROM s GROUP BY 1),
        r AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS ctp, sum(neg) OVER (ORDER BY score DESC) AS cfp FROM d),
        a AS (SELECT sum(neg * (2.0 * ctp - pos) / 2) / sum(pos) / sum(neg) AS roc_auc,
                     sum(CAST(pos AS DOUBLE) * ctp / (ctp + cfp)) / sum(pos) AS pr_auc FROM r)
        SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn,
               round((tp + tn) / (tp + fp + fn + tn), 9) AS accuracy,
               round((tp / (tp + fn) + tn / (tn + fp)) / 2, 9) AS balanced_accuracy,
               round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall,
               round(2 * tp / (2 * tp + fp + fn), 9) AS f1,
               round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 9) AS mcc,
               round(CAST(roc_auc AS DOUBLE), 9) AS roc_auc, round(pr_auc, 9) AS pr_auc FROM k, a""",
)
def _(c):
    out = metrics.evaluate(gm.predicted(_scored(c)))
    return out.select(*[F.round(n, 9).alias(n) if t == "double" else n for n, t in out.dtypes])


@query(
    "o96_class_report",
    f"""WITH {SCORED}, p AS (SELECT label, CAST(score >= 0.5 AS INT) AS said FROM s)
        SELECT CAST(k AS BIGINT) AS label,
               round(count(*) FILTER (WHERE label = k AND said = k) / CAST(count(*) FILTER (WHERE said = k) AS DOUBLE), 9) AS precision,
               round(count(*) FILTER (WHERE label = k AND said = k) / CAST(count(*) FILTER (WHERE label = k) AS DOUBLE), 9) AS recall,
               round(2.0::DOUBLE * count(*) FILTER (WHERE label = k AND said = k)
                     / (count(*) FILTER (WHERE said = k) + count(*) FILTER (WHERE label = k)), 9) AS f1,
               count(*) FILTER (WHERE label = k) AS support
        FROM p, (SELECT unnest([0, 1]) AS k) GROUP BY k""",
)
def _(c):
    out = metrics.class_report(metrics.confusion(gm.predicted(_scored(c))))
    return out.select(*[F.round(n, 9).alias(n) if t == "double" else n for n, t in out.dtypes])


@query(
    "o97_curves",
    f"""WITH {SCORED},
        d AS (SELECT score, sum(label) AS pos, count(*) - sum(label) AS neg FROM s GROUP BY 1),
        r AS (SELECT score, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n
              FROM d WINDOW w AS (ORDER BY score DESC))
        SELECT score AS threshold, round(fp / n::DOUBLE, 9) AS fpr, round(tp / p::DOUBLE, 9) AS tpr,
               round(tp / (tp + fp)::DOUBLE, 9) AS precision, round(tp / p::DOUBLE, 9) AS recall FROM r""",
)
def _(c):
    out = metrics.curve_points(metrics.score_counts(_scored(c)))
    return out.select("threshold", *[F.round(n, 9).alias(n) for n in ("fpr", "tpr", "precision", "recall")])


SWEEP = f"""{SCORED}, t AS (SELECT i + 1 AS i, t.v AS threshold FROM (SELECT unnest(range(50)) AS i,
             unnest([{', '.join(repr(v) for v in metrics.sweep_thresholds())}]::DOUBLE[]) AS v) t),
    m AS (SELECT t.i, t.threshold, count(*) FILTER (WHERE label = 1 AND score >= threshold) AS tp,
                 count(*) FILTER (WHERE label = 0 AND score >= threshold) AS fp,
                 count(*) FILTER (WHERE label = 1 AND score < threshold) AS fn FROM s, t GROUP BY 1, 2),
    f AS (SELECT *, CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END AS f1 FROM m)"""


@query(
    "o99_threshold_sweep",
    f"WITH {SWEEP} SELECT i, round(threshold, 9) AS threshold, tp, fp, fn, round(f1, 9) AS f1 FROM f",
)
def _(c):
    out = metrics.threshold_sweep(_scored(c))
    return out.withColumns({n: F.round(n, 9) for n in ("threshold", "f1")})


@query(
    "o99_best_threshold",
    f"WITH {SWEEP} SELECT round(threshold, 9) AS threshold, round(f1, 9) AS f1 FROM f ORDER BY f.f1 DESC, i LIMIT 1",
)
def _(c):
    out = metrics.best_threshold(metrics.threshold_sweep(_scored(c)))
    return out.withColumns({n: F.round(n, 9) for n in ("threshold", "f1")})
