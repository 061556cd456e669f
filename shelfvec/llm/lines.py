"""Removal of lines that stand on many sites.

A line counts as boilerplate when it occurs on at least ``min_sites`` distinct
sites. The spread of each line is read from a HyperLogLog sketch of its sites;
sketches are built in the map tasks and merged by the aggregation, so a line on
a third of all pages sends one small sketch per task. Estimates well above or
below the threshold decide at once. Those within the sketch's error of it are
counted exactly.

Lines with fewer rows than ``min_sites`` cannot reach it; they are left out of
the sketches after a plain count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfvec.sources.scratch import materialize

KEY = ["line_a", "line_b"]
ROW = ["_doc", "_digest"]
BLANK = " \t\r"


def _lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _line_rows(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """A row per non-blank line: where it stands, its 128-bit digest, its site and length."""
    line = F.trim(F.col("_line"), F.lit(BLANK))
    return (
        docs.select(
            F.col(id_col).alias("_doc"),
            F.xxhash64(text_col).alias("_digest"),
            F.col(site_col).cast("string").alias("_site"),
            F.posexplode(_lines_of(F.col(text_col))).alias("_at", "_line"),
        )
        .select(
            *ROW,
            "_site",
            "_at",
            F.length("_line").alias("_chars"),
            F.xxhash64(line).alias("line_a"),
            F.xxhash64(line, F.lit(1)).alias("line_b"),
            (line == "").alias("_blank"),
        )
        .where(~F.col("_blank"))
        .drop("_blank")
    )


def spread_lines(hits: DataFrame, min_sites: int, lg_k: int, sigmas: float) -> DataFrame:
    """Digests of the lines on at least ``min_sites`` sites, exactly."""
    band = sigmas * 1.04 / 2 ** (lg_k / 2)
    sketches = hits.groupBy(*KEY).agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("_site", F.lit(lg_k))).alias("sites")
    )
    sketches = materialize(sketches, "line-spread")
    sure = sketches.where(F.col("sites") > min_sites * (1 + band)).select(*KEY)
    near = sketches.where(F.col("sites").between(min_sites * (1 - band) - 1, min_sites * (1 + band)))
    counted = (
        hits.join(near.select(*KEY), KEY, "left_semi")
        .groupBy(*KEY)
        .agg(F.countDistinct("_site").alias("sites"))
        .where(F.col("sites") >= min_sites)
        .select(*KEY)
    )
    return sure.unionByName(counted)


def drop_spread_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
    min_sites: int = 10,
    max_share: float | None = 0.5,
    lg_k: int = 10,
    sigmas: float = 4.0,
    counts: bool = False,
) -> DataFrame:
    """Documents without the lines that stand on ``min_sites`` sites or more.

    Lines are compared without blanks at their ends; blank lines stay. A
    document with more than ``max_share`` of its characters in such lines is
    not a page with boilerplate but a copy of a page found on many sites: it
    keeps its text and is left to the removal of near copies. So no text
    disappears from all documents that hold it but for boilerplate lines. With
    None for ``max_share`` only documents without a line of their own are such
    copies, and all others lose these lines, however many.

    A null site counts as no site, a null text has no lines and stays null.
    Repeated rows and rows with equal ids are treated row by row. Other columns
    pass through. With ``counts`` the columns ``n_lines`` and
    ``n_removed_lines`` are added. An empty table gives an empty table.
    """
    lines = _line_rows(docs, id_col, text_col, site_col)
    often = lines.groupBy(*KEY).agg(F.count("*").alias("n")).where(F.col("n") >= min_sites)
    # Stored, so that the join below has a plain exchange on both sides: small
    # tables are broadcast by their size, and the rows of a hot line are split.
    often = materialize(often.select(*KEY), "often")
    hits = materialize(lines.join(often, KEY, "left_semi"), "line-hits")
    spread = materialize(spread_lines(hits, min_sites, lg_k, sigmas), "lines-spread")
    cut = (
        hits.join(spread, KEY, "left_semi")
        .groupBy(*ROW)
        .agg(F.collect_set(F.struct("_at", "_chars")).alias("_cut"))
    )
    chars = F.aggregate("_cut", F.lit(0).cast("long"), lambda total, x: total + x["_chars"])
    cut = cut.select(
        F.col("_doc").alias("_cut_doc"),
        F.col("_digest").alias("_cut_digest"),
        F.transform("_cut", lambda x: x["_at"]).alias("_cut"),
        chars.alias("_cut_chars"),
    )
    cut = materialize(cut, "cuts")
    # The row rides in a struct, so that no column of it can clash with those added here.
    keyed = docs.select(
        F.struct(*docs.columns).alias("_in"),
        F.col(id_col).alias("_doc"),
        F.xxhash64(text_col).alias("_digest"),
        F.col(text_col).alias("_text"),
    )
    same = keyed["_doc"].eqNullSafe(cut["_cut_doc"]) & (keyed["_digest"] == cut["_cut_digest"])
    # Cuts grow with the documents: the same plan, a merge, at any size.
    joined = keyed.join(cut.hint("merge"), same, "left")
    text = F.col("_text")
    kept = F.filter(_lines_of(text), lambda _, i: ~F.array_contains("_cut", i))
    if max_share is None:
        few = F.exists(kept, lambda line: F.trim(line, F.lit(BLANK)) != "")
    else:
        few = F.col("_cut_chars") <= max_share * F.length(text)
    removes = F.col("_cut").isNotNull() & few
    extra = {}
    if counts:
        extra = {
            "n_lines": F.size(_lines_of(text)).cast("long"),
            "n_removed_lines": F.when(removes, F.size("_cut")).otherwise(0).cast("long"),
        }
    left = F.when(removes, F.array_join(kept, "\n")).otherwise(text)
    columns = [
        (left if c == text_col else F.col("_in")[c]).alias(c) for c in docs.columns if c not in extra
    ]
    return joined.select(*columns, *(c.alias(n) for n, c in extra.items()))


def line_digests(docs: DataFrame) -> DataFrame:
    """Per document its lines, those removed, and the length and digest of what stays."""
    kept = drop_spread_lines(docs.select("doc_id", "text", "source"), counts=True)
    text = F.coalesce("text", F.lit(""))
    return kept.select(
        "doc_id",
        "n_lines",
        "n_removed_lines",
        F.length(text).cast("long").alias("n_chars_kept"),
        F.sha2(text, 256).alias("kept_sha256"),
    )


SQL = """
WITH lines AS (
    SELECT row, i, lines[i] AS line, trim(lines[i], ' ' || chr(9) || chr(13)) AS bare, source
    FROM (
        SELECT row, source, lines, unnest(generate_series(1, len(lines))) AS i
        FROM (SELECT row_number() OVER () AS row, source,
                     string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)
    )
),
spread AS (
    SELECT bare FROM lines WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT source) >= 10
),
marked AS (
    SELECT l.row, l.i, l.line, s.bare IS NOT NULL AS cut
    FROM lines l LEFT JOIN spread s ON l.bare = s.bare
),
per_doc AS (
    SELECT row, count(*) AS n_lines, count(*) FILTER (WHERE cut) AS n_cut,
           coalesce(sum(length(line)) FILTER (WHERE cut), 0) AS cut_chars,
           coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT cut), '') AS kept
    FROM marked GROUP BY row
),
docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
done AS (
    SELECT doc_id, n_lines,
           CASE WHEN cut_chars <= 0.5 * length(text) THEN n_cut ELSE 0 END AS n_removed_lines,
           CASE WHEN n_cut > 0 AND cut_chars <= 0.5 * length(text) THEN kept ELSE text END AS kept
    FROM docs JOIN per_doc USING (row)
)
SELECT doc_id, n_lines, n_removed_lines, length(kept) AS n_chars_kept, sha256(kept) AS kept_sha256
FROM done
"""
