"""Result and timing tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfvec.operators import report as R
from shelfvec.plans.reporting import baseline_tables, leaderboard
from suite import query, table
from suite.views import vectors

# Line items read as a result table: return flag, line status, three measures.
RESULTS_SQL = """
results AS (SELECT l_returnflag AS model, l_linestatus AS data_type, l_linestatus AS task,
                   l_discount AS f1, l_tax AS precision, l_quantity / 50 AS recall,
                   l_orderkey, l_linenumber, l_partkey, l_extendedprice
            FROM lineitem),
means AS (SELECT model, data_type, avg(f1) AS f1, avg(precision) AS precision,
                 avg(recall) AS recall
          FROM results GROUP BY ALL),
relative AS (SELECT m.model, m.data_type, (m.f1 - b.f1) / b.f1 * 100 AS f1,
                    (m.precision - b.precision) / b.precision * 100 AS precision,
                    (m.recall - b.recall) / b.recall * 100 AS recall
             FROM means m JOIN means b ON b.model = 'N' AND b.data_type = m.data_type)
"""


def _results(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("model"),
        F.col("l_linestatus").alias("data_type"),
        F.col("l_linestatus").alias("task"),
        F.col("l_discount").alias("f1"),
        F.col("l_tax").alias("precision"),
        (F.col("l_quantity") / 50).alias("recall"),
    )


def _six(df):
    return df.withColumns({name: F.round(name, 6) + 0.0 for name in R.METRICS})


SIX_SQL = """round(f1, 6) + 0.0 AS f1, round(precision, 6) + 0.0 AS precision,
             round(recall, 6) + 0.0 AS recall"""


@query("r1_mean_by_model", f"WITH {RESULTS_SQL} SELECT model, data_type, {SIX_SQL} FROM means")
def r1(spark, sf):
    return _six(R.mean_by_model(_results(spark, sf)))


@query(
    "r2_relative_to_baseline",
    f"WITH {RESULTS_SQL} SELECT model, data_type, {SIX_SQL} FROM relative",
)
def r2(spark, sf):
    return _six(R.relative_to_baseline(R.mean_by_model(_results(spark, sf)), "N"))


@query(
    "r3_baseline_tables",
    f"""WITH {RESULTS_SQL}
        SELECT 'f1' AS metric, model, round_even(max(f1) FILTER (data_type = 'F') * 1000, 0) / 1000 + 0.0 AS F_,
               round_even(max(f1) FILTER (data_type = 'O') * 1000, 0) / 1000 + 0.0 AS O_ FROM relative GROUP BY model
        UNION ALL
        SELECT 'precision', model, round_even(max(precision) FILTER (data_type = 'F') * 1000, 0) / 1000 + 0.0,
               round_even(max(precision) FILTER (data_type = 'O') * 1000, 0) / 1000 + 0.0 FROM relative GROUP BY model
        UNION ALL
        SELECT 'recall', model, round_even(max(recall) FILTER (data_type = 'F') * 1000, 0) / 1000 + 0.0,
               round_even(max(recall) FILTER (data_type = 'O') * 1000, 0) / 1000 + 0.0 FROM relative GROUP BY model""",
)
def r3(spark, sf):
    tables = baseline_tables(_results(spark, sf), "N", ["F", "O"])
    parts = [
        tables[name].select(
            F.lit(name).alias("metric"),
            "model",
            (F.col("F") + 0.0).alias("F_"),
            (F.col("O") + 0.0).alias("O_"),
        )
        for name in ("f1", "precision", "recall")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "r4_rounded",
    "SELECT event_id, round_even(value / 8 * 1000, 0) / 1000 AS f1 FROM events",
)
def r4(spark, sf):
    rows = table(spark, sf, "events").select("event_id", (F.col("value") / 8).alias("f1"))
    return R.rounded(rows, ["f1"])


def _ranked(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("model"),
        F.col("o_orderpriority").alias("task"),
        (F.col("o_custkey") % F.lit(50)).alias("f1"),
        "o_orderkey",
    )


# Many ties: the first order wins.
BEST_SQL = """
best AS (SELECT o_orderstatus AS model, o_orderpriority AS task, o_custkey % 50 AS f1, o_orderkey
         FROM orders
         QUALIFY row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority
                                    ORDER BY o_custkey % 50 DESC, o_orderkey) = 1)
"""


@query("r5_best_rows", f"WITH {BEST_SQL} SELECT * FROM best")
def r5(spark, sf):
    return R.best_rows(_ranked(spark, sf), "o_orderkey")


@query(
    "r6_leaderboard",
    f"WITH {BEST_SQL} SELECT * FROM best WHERE model IN ('F', 'O') ORDER BY f1 DESC",
)
def r6(spark, sf):
    return leaderboard(_ranked(spark, sf), "o_orderkey", ["F", "O"])


def _timings(spark, sf):
    return table(spark, sf, "events").select(
        F.col("event_type").alias("engine"),
        F.when(F.length("props") > 8, "batch").otherwise("sample").alias("stage"),
        F.col("value").alias("seconds"),
    )


TIMINGS_SQL = """
timings AS (SELECT event_type AS engine,
                   CASE WHEN length(props) > 8 THEN 'batch' ELSE 'sample' END AS stage,
                   value AS seconds
            FROM events)
"""


@query(
    "r7_compare_timings",
    f"""WITH {TIMINGS_SQL},
        t AS (SELECT engine, stage, avg(seconds) AS mean, stddev_samp(seconds) AS deviation
              FROM timings GROUP BY ALL)
        SELECT t.engine, t.stage, round(t.mean, 6) AS mean, round(t.deviation, 6) AS deviation,
               round((t.mean - b.mean) / b.mean * 100, 6) + 0.0 AS difference
        FROM t JOIN t b ON b.engine = 'view' AND b.stage = t.stage""",
)
def r7(spark, sf):
    compared = R.compare_timings(_timings(spark, sf), "view")
    return compared.withColumns(
        {c: F.round(c, 6) + 0.0 for c in ("mean", "deviation", "difference")}
    )


@query(
    "r8_quartiles",
    f"""WITH {TIMINGS_SQL}
        SELECT engine, stage, count(*) AS n, min(seconds) AS minimum,
               round(quantile_cont(seconds, 0.25), 6) AS q25,
               round(quantile_cont(seconds, 0.5), 6) AS q50,
               round(quantile_cont(seconds, 0.75), 6) AS q75, max(seconds) AS maximum
        FROM timings GROUP BY ALL""",
)
def r8(spark, sf):
    summary = R.quartiles(_timings(spark, sf))
    return summary.withColumns({c: F.round(c, 6) for c in ("q25", "q50", "q75")})


def _projected(spark, sf, column):
    rows = vectors(spark, sf).select("row_id", column.alias("text"))
    # A catalog with a row for every vector, without names where there is no document.
    named = table(spark, sf, "documents").select(
        F.col("doc_id").alias("row_id"), F.col("source").alias("category"), F.col("text").alias("title")
    )
    catalog = rows.select("row_id").join(named, "row_id", "left")
    return R.project_vectors(rows, catalog)


@query(
    "r9_three_of_three",
    """WITH v AS (SELECT vec_id AS row_id, i AS place, embedding[i + 1]::DOUBLE AS x
                  FROM embeddings, unnest(range(3)) r(i)),
       s AS (SELECT place, avg(x) AS mean, stddev_pop(x) AS dev FROM v GROUP BY place),
       l AS (SELECT row_id, sum(((x - mean) / dev) ** 2) AS length2
             FROM v JOIN s USING (place) GROUP BY row_id)
       SELECT row_id, source AS category, text AS title, round(length2, 5) AS length2
       FROM l LEFT JOIN documents ON doc_id = row_id""",
)
def r9_three(spark, sf):
    """Three components of a three-wide vector keep its standardised length."""
    points = _projected(spark, sf, F.slice("text", 1, 3))
    length = F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2
    return points.select("row_id", "category", "title", F.round(length, 5).alias("length2"))


@query("r9_projection")
def r9(spark, sf):
    points = _projected(spark, sf, F.col("text"))
    return points.withColumns({axis: F.round(axis, 6) for axis in "xyz"})
