"""Feature scaling, folds, weights, classifiers and scores."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from shelfvec.operators import labels as L
from shelfvec.operators import metrics as M
from shelfvec.operators.axes import reduce_wide
from shelfvec.operators.classify import Settings, logistic_regression, regression_coefficients
from shelfvec.operators.features import COMBINED, IMAGE, TEXT, reduce_dimensions, standardize, vector_columns
from shelfvec.operators.folds import class_weights, stratified_folds, with_class_weights
from shelfvec.plans.evaluation import Evaluation, evaluate, evaluation, fit_jobs, folded_labels, run_suite, stored_rows
from shelfvec.operators.price_ranges import price_classes
from suite import query, table
from suite.catalog import SHUFFLE_KEY_SQL
from suite.views import LEMMA_ROWS, clothes, vectors


@query(
    "m1_standardize",
    """WITH v AS (SELECT vec_id AS row_id, i AS place, embedding[i + 1]::DOUBLE AS x
                  FROM embeddings, unnest(range(64)) r(i)),
       s AS (SELECT place, avg(x) AS mean, stddev_pop(x) AS dev FROM v GROUP BY place)
       SELECT row_id, place, round((x - mean) / dev, 6) + 0.0 AS value FROM v JOIN s USING (place)""",
)
def m1(spark, sf):
    scaled = standardize(vector_columns(vectors(spark, sf)), COMBINED, "scaled")
    values = scaled.select(
        "row_id", F.posexplode(vector_to_array("scaled")).alias("place", "value")
    )
    return values.select(
        "row_id", F.col("place").cast("long").alias("place"), (F.round("value", 6) + 0.0).alias("value")
    )


@query("m2_principal_components")
def m2(spark, sf):
    reduced = reduce_dimensions(vector_columns(vectors(spark, sf)))
    axes = vector_to_array("PCA")
    return reduced.select("row_id", *[F.round(axes[i], 6).alias(f"c{i}") for i in range(10)])


@query(
    "m2_full_rotation",
    """WITH v AS (SELECT vec_id AS row_id, i AS place, embedding[i + 1]::DOUBLE AS x
                  FROM embeddings, unnest(range(64)) r(i)),
       s AS (SELECT place, avg(x) AS mean, stddev_pop(x) AS dev FROM v GROUP BY place)
       SELECT row_id, round(sum(((x - mean) / dev) ** 2), 5) AS length2
       FROM v JOIN s USING (place) GROUP BY row_id""",
)
def m2_full(spark, sf):
    """All components together keep the length of every standardised vector."""
    reduced = reduce_dimensions(vector_columns(vectors(spark, sf)), components=64)
    square = F.aggregate(vector_to_array("PCA"), F.lit(0.0), lambda a, x: a + x * x)
    return reduced.select("row_id", F.round(square, 5).alias("length2"))


def axes_sql(components, steps=26):
    """CTEs ``axis1`` and on: each leading axis as the matrix v v', by squaring what is left.

    Squared over and over at trace one, a covariance matrix becomes the
    projection on its first axis; that axis is then taken out.
    """
    parts = ["""
        v AS (SELECT vec_id AS row_id, i AS place, embedding[i + 1]::DOUBLE AS x FROM embeddings, unnest(range(64)) r(i)),
        s AS (SELECT place, avg(x) AS mean, stddev_pop(x) AS dev FROM v GROUP BY place),
        z AS MATERIALIZED (SELECT row_id, place, (x - mean) / dev AS x FROM v JOIN s USING (place)),
        cov1 AS MATERIALIZED (SELECT a.place AS i, b.place AS j, avg(a.x * b.x) AS c FROM z a JOIN z b USING (row_id) GROUP BY ALL)"""]
    for k in range(1, components + 1):
        parts.append(f"""
        power{k} AS (
          SELECT 0 AS step, i, j, c / (SELECT sum(c) FROM cov{k} WHERE i = j) AS p FROM cov{k}
          UNION ALL
          SELECT step + 1, i, j, q / sum(CASE WHEN i = j THEN q END) OVER ()
          FROM (SELECT a.step, a.i, b.j, sum(a.p * b.p) AS q FROM power{k} a JOIN power{k} b ON a.j = b.i
                WHERE a.step < {steps} GROUP BY ALL)),
        axis{k} AS MATERIALIZED (SELECT i, j, p FROM power{k} WHERE step = {steps}),
        cov{k + 1} AS MATERIALIZED (
          SELECT i, j, c - p * (SELECT sum(x.c * y.p) FROM cov{k} x JOIN axis{k} y ON x.i = y.i AND x.j = y.j) AS c
          FROM cov{k} JOIN axis{k} USING (i, j))""")
    return ",".join(parts)


def squares_sql(components):
    return " UNION ALL ".join(
        f"""SELECT a.row_id, {k - 1} AS place, round(sum(a.x * p * b.x), 4) + 0.0 AS square
            FROM z a JOIN axis{k} ON a.place = i JOIN z b ON b.row_id = a.row_id AND b.place = j GROUP BY a.row_id"""
        for k in range(1, components + 1)
    )


def _squares(reduced, components, column="PCA"):
    values = vector_to_array(column)
    pairs = [F.struct(F.lit(i).alias("place"), (F.round(values[i] * values[i], 4) + 0.0).alias("square")) for i in range(components)]
    return reduced.select("row_id", F.explode(F.array(*pairs)).alias("x")).select("row_id", "x.place", "x.square")


@query("m2_axes", f"WITH RECURSIVE {axes_sql(10)} {squares_sql(10)}")
def m2_axes(spark, sf):
    """The ten components, squared as signs are free; the twin squares covariance matrices."""
    return _squares(reduce_dimensions(vector_columns(vectors(spark, sf))), 10)


@query("m2_wide_axes", f"WITH RECURSIVE {axes_sql(3)} {squares_sql(3)}")
def m2_wide(spark, sf):
    """Three components by rounds of products, without a matrix of width by width."""
    return _squares(reduce_wide(vector_columns(vectors(spark, sf)), COMBINED, "PCA", 3, turn=1e-11), 3)


KEY_SQL = SHUFFLE_KEY_SQL.format(key="vec_id")
FOLDS_SQL = f"""
folds AS (SELECT vec_id AS row_id, label AS target,
                 ((row_number() OVER (ORDER BY label, {KEY_SQL}, vec_id) - 1) % 5)::INT AS fold
          FROM embeddings)
"""


def _folds(spark, sf):
    return stratified_folds(vectors(spark, sf).select("row_id", "target"))


@query("m3_stratified_folds", f"WITH {FOLDS_SQL} SELECT row_id, target, fold FROM folds")
def m3(spark, sf):
    return _folds(spark, sf)


@query(
    "m4_class_weights",
    f"""WITH {FOLDS_SQL},
        c AS (SELECT f.fold AS fold, t.target, count(*) AS n
              FROM (SELECT DISTINCT fold FROM folds) f JOIN folds t ON t.fold <> f.fold
              GROUP BY ALL)
        SELECT fold, target,
               round(sum(n) OVER (PARTITION BY fold)
                     / (count(*) OVER (PARTITION BY fold) * n)::DOUBLE, 6) AS weight,
               (sum(n) OVER (PARTITION BY fold))::BIGINT AS n_train
        FROM c""",
)
def m4(spark, sf):
    weights = class_weights(_folds(spark, sf))
    return weights.withColumn("weight", F.round("weight", 6))


def _rounded(df):
    return df.withColumns({name: F.round(name, 6) for name in M.METRICS})


def _binary(spark, sf):
    """Labels: the first class against the rest."""
    return vectors(spark, sf).select("row_id", (F.col("target") == 0).cast("int").alias("target"))


def _even(spark, sf):
    """Labels: classes of even number against the others."""
    return vectors(spark, sf).select("row_id", (F.col("target") % 2 == 0).cast("int").alias("target"))


def _classes(spark, sf):
    return vectors(spark, sf).select("row_id", "target")


def _store(spark, sf, *models):
    """The given vectors under one or more model names, each a rotation of the halves."""
    base = vectors(spark, sf)
    parts = []
    for shift, model in enumerate(models):
        sides = ("text", "img") if shift % 2 == 0 else ("img", "text")
        parts.append(
            base.select(
                F.lit(model).alias("model"),
                "row_id",
                F.col(sides[0]).alias("text"),
                F.col(sides[1]).alias("img"),
            )
        )
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


# Newton steps on the balanced objective with one feature, penalty b * b / 2.
NEWTON_SQL = """
RECURSIVE d AS MATERIALIZED (
  SELECT embedding[1]::DOUBLE AS x, (label = 0)::INT AS y,
         count(*) OVER () / (2.0::DOUBLE * count(*) OVER (PARTITION BY label = 0)) AS w
  FROM embeddings),
steps AS (
  SELECT 0 AS step, 0.0::DOUBLE AS b, 0.0::DOUBLE AS a
  UNION ALL
  SELECT step + 1, b - (haa * gb - hab * ga) / (hbb * haa - hab * hab),
         a - (hbb * ga - hab * gb) / (hbb * haa - hab * hab)
  FROM (SELECT step, b, a, sum(w * (p - y) * x) + b AS gb, sum(w * (p - y)) AS ga,
               sum(w * p * (1 - p) * x * x) + 1 AS hbb, sum(w * p * (1 - p) * x) AS hab,
               sum(w * p * (1 - p)) AS haa
        FROM (SELECT step, b, a, x, y, w, 1 / (1 + exp(-(b * x + a))) AS p FROM steps, d)
        GROUP BY step, b, a)
  WHERE step < 25)
"""


@query(
    "m5_coefficients",
    f"""WITH {NEWTON_SQL}
        SELECT 'first' AS feature, round(b, 3) AS coefficient, round(a, 3) AS intercept
        FROM steps WHERE step = 25""",
)
def m5_coefficients(spark, sf):
    """Balanced regression on one component, the same optimum as Newton's method."""
    rows = _binary(spark, sf).join(vectors(spark, sf).drop("target"), "row_id")
    one = rows.select("row_id", "target", array_to_vector(F.slice("text", 1, 1)).alias("first"))
    split = one.withColumn("fold", F.lit(1))
    # Fold 0 is empty, so its weights are those of the whole table.
    weighted = with_class_weights(split, 2).withColumn("weight", F.col("weights")[0])
    model = logistic_regression(weighted.count(), Settings(tol=1e-10), "first").fit(weighted)
    found = [("first", float(model.coefficients[0]), float(model.intercept))]
    fitted = spark.createDataFrame(found, "feature string, coefficient double, intercept double")
    return fitted.withColumns({c: F.round(c, 3) for c in ("coefficient", "intercept")})


@query("m5_m10_binary_logreg")
def m5(spark, sf):
    """The flagship: cross-validated scores of every feature set."""
    tasks = {"first_class": _binary(spark, sf)}
    return _rounded(evaluate(_store(spark, sf, "base"), ["base"], tasks, evaluation()))


@query("m6_multiclass_logreg")
def m6(spark, sf):
    config = evaluation(multiclass=True)
    return _rounded(evaluate(_store(spark, sf, "base"), ["base"], {"label": _classes(spark, sf)}, config))


@query("m7_multiclass_mlp")
def m7(spark, sf):
    config = evaluation("mlp", multiclass=True)
    tasks = {"label": _classes(spark, sf)}
    store = _store(spark, sf, "base")
    return _rounded(evaluate(store, ["base"], tasks, config, one_score=False))


@query(
    "m6_price_classes",
    """WITH r AS (SELECT o_totalprice::DOUBLE AS x, row_number() OVER (ORDER BY o_totalprice) AS place,
                         count(*) OVER () AS n FROM orders),
            bounds AS (SELECT k, x FROM r, range(1, 7) c(k) WHERE place = greatest(ceil(k * n / 7.0 - 1e-9), 1))
       SELECT o_orderkey AS row_id, (SELECT count(*) FROM bounds b WHERE o_totalprice::DOUBLE > b.x)::INT AS target
       FROM orders""",
)
def m6_price_classes(spark, sf):
    """Seven price ranges of equal size as classes."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), "o_totalprice")
    return price_classes(orders, "o_totalprice", 7, exact_rows=500).select("row_id", "target")


@query("m7_relu_adam")
def m7_adam(spark, sf):
    """The network of rectified units, trained by Adam in mini-batches, per fold."""
    config = evaluation("adam", multiclass=True)
    tasks = {"label": _classes(spark, sf)}
    return _rounded(evaluate(_store(spark, sf, "base"), ["base"], tasks, config, one_score=False))


def _stationary_sql(classes, widths):
    sets = ", ".join(f"('{name}', {width})" for name, width in widths.items())
    return f"""
        WITH {FOLDS_SQL}, sets(data_type, width) AS (VALUES {sets})
        SELECT data_type, f.fold AS fold, k::INT AS output, i::INT AS place, 0.0::DOUBLE AS gradient,
               (SELECT count(*) FROM folds t WHERE t.fold <> f.fold)::DOUBLE AS weight
        FROM sets, (SELECT DISTINCT fold FROM folds) f, range({classes}) o(k), range(width + 1) p(i)"""


def _stationary(spark, sf, config, labels):
    """The objective's gradient at the fitted coefficients of every set and fold, summed by expressions.

    The objective is strictly convex but for a common shift of the intercepts,
    so a gradient of zero names the one optimum. ``weight`` is the sum of the
    balanced weights, that is the number of training rows.
    """
    stored = stored_rows(folded_labels(labels, config), _store(spark, sf, "base"), config)
    (job,) = fit_jobs(stored, config)
    fitted = regression_coefficients(job)
    widths = {TEXT: 32, IMAGE: 32, COMBINED: 64}
    columns = {name: F.concat(*[vector_to_array(c) for c in job.spans.get(name, (name,))]) for name in widths}
    folds = F.explode(F.sequence(F.lit(0), F.lit(config.folds - 1))).alias("held")
    sides = [job.table.select(F.lit(name).alias("set"), "target", "fold", "weights", F.concat(x, F.array(F.lit(1.0))).alias("x"), folds) for name, x in columns.items()]
    rows = sides[0].unionByName(sides[1]).unionByName(sides[2]).where("fold <> held")
    # A row of coefficients per set and fold.
    met = rows.join(F.broadcast(fitted.withColumnsRenamed({"data_type": "set", "fold": "held"})), ["set", "held"])
    dot = lambda c: F.aggregate(F.zip_with(c, "x", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    scores = F.transform("coefficients", dot)
    if config.settings.multiclass:
        top = F.array_max("scores")
        total = F.aggregate("scores", F.lit(0.0), lambda s, z: s + F.exp(z - top))
        error = F.transform("scores", lambda z, k: F.exp(z - top) / total - F.when(k == F.col("target"), 1.0).otherwise(0.0))
    else:
        error = F.transform("scores", lambda z: 1 / (1 + F.exp(-z)) - F.col("target"))
    met = met.withColumn("scores", scores).withColumn("weight", F.get("weights", F.col("held")))
    each = met.select("set", "held", "weight", "coefficients", "x", F.posexplode(error).alias("output", "error"))
    each = each.select("set", "held", "weight", "output", "error", F.get("coefficients", F.col("output")).alias("own"), F.posexplode("x").alias("place", "x"))
    sums = each.groupBy("set", "held", "output", "place").agg(
        F.sum(F.col("weight") * F.col("error") * F.col("x")).alias("slope"),
        F.sum("weight").alias("weight"),
        F.first(F.get("own", F.col("place"))).alias("own"),
        F.first(F.size("own")).alias("size"),
    )
    penalty = F.when(F.col("place") < F.col("size") - 1, F.col("own")).otherwise(0.0)
    return sums.select(
        F.col("set").alias("data_type"), F.col("held").alias("fold"), "output", "place",
        (F.round((F.col("slope") + penalty) / F.col("weight"), 4) + 0.0).alias("gradient"), F.round("weight", 6).alias("weight"),
    )


SETS = {"Text": 32, "Image": 32, "Combined": 64}


@query("m5_optimum", _stationary_sql(1, SETS).replace("label AS target", "(label = 0)::INT AS target").replace("ORDER BY label,", "ORDER BY label = 0,"))
def m5_optimum(spark, sf):
    """Binary regressions of three feature sets and five folds stand at their optimum."""
    config = Evaluation(Settings(tol=1e-13), feature_sets=(TEXT, IMAGE, COMBINED))
    return _stationary(spark, sf, config, _binary(spark, sf))


@query("m6_optimum", _stationary_sql(10, SETS))
def m6_optimum(spark, sf):
    """The same for ten classes at once."""
    config = Evaluation(Settings(multiclass=True, tol=1e-13), "weighted", feature_sets=(TEXT, IMAGE, COMBINED))
    return _stationary(spark, sf, config, _classes(spark, sf))


@query("m12_grid")
def m12(spark, sf):
    store = _store(spark, sf, "base", "swapped")
    tasks = {"first_class": _binary(spark, sf), "even_class": _even(spark, sf)}
    return _rounded(evaluate(store, ["base", "swapped"], tasks, evaluation()))


@query("m13_task_suite")
def m13(spark, sf):
    """Documents as products: their labels, folds, fits and scores, three flags and two classes."""
    docs = table(spark, sf, "documents")
    catalog = docs.select(
        F.col("doc_id").alias("row_id"),
        F.col("source").alias("category"),
        F.concat("source", F.lit("/"), "lang").alias("sub_category"),
        (F.col("n_chars") > 3000).alias("isadult"),
    )
    worn = clothes(spark, sf)
    dictionary = spark.createDataFrame(LEMMA_ROWS, "lang string, form string, lemma string")
    flags = {
        "IsAdult": L.is_adult(catalog),
        "MaleFemale": L.male_female(worn, dictionary),
        "IsChild": L.adult_child(worn, dictionary),
    }
    names = {
        "Category": catalog.select("row_id", F.col("category").alias("target")),
        "SubCategory": L.roll_up_rare(catalog).select("row_id", F.col("sub_category").alias("target")),
    }
    classes = {task: L.encode_classes(df).select("row_id", "target") for task, df in names.items()}
    given = _store(spark, sf, "base").withColumnRenamed("row_id", "vec_id")
    place = F.col("row_id") % F.lit(given.count())
    store = catalog.select("row_id", place.alias("vec_id")).join(given, "vec_id").drop("vec_id")
    results = run_suite(store, ["base"], flags, classes)
    parts = [df.withColumn("evaluator", F.lit(name)) for name, df in results.items()]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return _rounded(whole)


# Quality as the truth and toxicity as its prediction.
FLAGS_SQL = f"""
flags AS (SELECT doc_id, quality AS target, toxic AS prediction,
                 ((row_number() OVER (ORDER BY quality, {SHUFFLE_KEY_SQL.format(key="doc_id")},
                                      doc_id) - 1) % 5)::INT AS fold
          FROM labels),
sums AS (SELECT fold, sum(target * prediction)::DOUBLE AS hit, sum(prediction)::DOUBLE AS predicted,
                sum(target)::DOUBLE AS actual
         FROM flags GROUP BY fold),
scores AS (SELECT fold,
                  CASE WHEN predicted + actual > 0 THEN 2 * hit / (predicted + actual) ELSE 0 END AS f1,
                  CASE WHEN predicted > 0 THEN hit / predicted ELSE 0 END AS precision,
                  CASE WHEN actual > 0 THEN hit / actual ELSE 0 END AS recall
           FROM sums)
"""


def _flag_counts(spark, sf):
    rows = table(spark, sf, "labels").select(
        "doc_id", F.col("quality").alias("target"), F.col("toxic").alias("prediction")
    )
    return M.confusion(stratified_folds(rows, key="doc_id"), ["fold"])


@query(
    "m8_binary_scores",
    f"""WITH {FLAGS_SQL}
        SELECT fold, round(f1, 6) AS f1, round(precision, 6) AS precision, round(recall, 6) AS recall
        FROM scores""",
)
def m8(spark, sf):
    return _rounded(M.binary_scores(_flag_counts(spark, sf), ["fold"]))


@query(
    "m10_mean_over_folds",
    f"""WITH {FLAGS_SQL}
        SELECT 'quality' AS task, round(avg(f1), 6) AS f1, round(avg(precision), 6) AS precision,
               round(avg(recall), 6) AS recall
        FROM scores""",
)
def m10(spark, sf):
    scores = M.binary_scores(_flag_counts(spark, sf), ["fold"])
    return _rounded(M.mean_over_folds(scores.withColumn("task", F.lit("quality")), ["task"]))


# Largest component as the prediction: most classes never occur as truth.
GUESS_SQL = """
guess AS (SELECT label AS target, list_position(embedding, list_max(embedding)) - 1 AS prediction
          FROM embeddings),
classes AS (SELECT target AS label FROM guess UNION SELECT prediction FROM guess),
stats AS (SELECT label,
                 (SELECT count(*) FROM guess WHERE target = label AND prediction = label)::DOUBLE AS hit,
                 (SELECT count(*) FROM guess WHERE prediction = label)::DOUBLE AS predicted,
                 (SELECT count(*) FROM guess WHERE target = label)::DOUBLE AS actual
          FROM classes),
scored AS (SELECT *, 2 * hit / (predicted + actual) AS f1,
                  CASE WHEN predicted > 0 THEN hit / predicted ELSE 0 END AS precision,
                  CASE WHEN actual > 0 THEN hit / actual ELSE 0 END AS recall
           FROM stats)
"""


@query(
    "m9_averaged_scores",
    f"""WITH {GUESS_SQL}
        SELECT 'weighted' AS average, round(sum(f1 * actual) / sum(actual), 6) AS f1,
               round(sum(precision * actual) / sum(actual), 6) AS precision,
               round(sum(recall * actual) / sum(actual), 6) AS recall FROM scored
        UNION ALL
        SELECT 'macro', round(avg(f1), 6), round(avg(precision), 6), round(avg(recall), 6) FROM scored
        UNION ALL
        SELECT 'micro', round(sum(hit) / sum(actual), 6), round(sum(hit) / sum(predicted), 6),
               round(sum(hit) / sum(actual), 6) FROM scored""",
)
def m9(spark, sf):
    head = F.col("embedding")
    guess = table(spark, sf, "embeddings").select(
        F.col("label").alias("target"),
        (F.array_position(head, F.array_max(head)) - 1).cast("int").alias("prediction"),
    )
    counts = M.confusion(guess.withColumn("task", F.lit("label")), ["task"])
    parts = [
        M.averaged_scores(counts, ["task"], average)
        .drop("task")
        .withColumn("average", F.lit(average))
        for average in M.AVERAGES
    ]
    return _rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query(
    "m11_feature_sets",
    """SELECT vec_id AS row_id, 32 AS text_width, 32 AS image_width, 64 AS combined_width,
              10 AS pca_width, embedding[33]::DOUBLE AS combined_33
       FROM embeddings""",
)
def m11(spark, sf):
    table_ = reduce_dimensions(vector_columns(vectors(spark, sf)))
    sets = {"text": "Text", "image": "Image", "combined": "Combined", "pca": "PCA"}
    return table_.select(
        "row_id",
        *[F.size(vector_to_array(c)).alias(f"{name}_width") for name, c in sets.items()],
        vector_to_array("Combined")[32].alias("combined_33"),
    )


PART_TYPES = ("STANDARD", "MEDIUM", "PROMO", "LARGE", "SMALL", "ECONOMY")
WIDE_SQL = ", ".join(
    f"max({metric}) FILTER (task = '{kind}') AS {kind.lower()}_{metric}"
    for kind in PART_TYPES
    for metric in M.METRICS
)


@query(
    "m14_wide_results",
    f"""WITH r AS (SELECT p_brand AS model, p_type AS task, round(avg(p_size), 6) AS f1,
                          round(avg(p_retailprice), 6) AS precision, count(*)::DOUBLE AS recall
                   FROM part GROUP BY ALL)
        SELECT model, 'size' AS task, {WIDE_SQL} FROM r GROUP BY model""",
)
def m14(spark, sf):
    results = (
        table(spark, sf, "part")
        .groupBy(F.col("p_brand").alias("model"), F.col("p_type").alias("data_type"))
        .agg(
            F.round(F.avg("p_size"), 6).alias("f1"),
            F.round(F.avg("p_retailprice"), 6).alias("precision"),
            F.count(F.lit(1)).cast("double").alias("recall"),
        )
        .withColumn("task", F.lit("size"))
    )
    wide = M.wide_results(results, list(PART_TYPES))
    return wide.select(
        "model",
        "task",
        *[F.col(f"{kind}.{m}").alias(f"{kind.lower()}_{m}") for kind in PART_TYPES for m in M.METRICS],
    )
