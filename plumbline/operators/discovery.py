"""False-discovery control for families of tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.numeric import join_groups
from plumbline.functions.ordered import ordered_chunks, running_total, suffix_min
from plumbline.session import cut_lineage


def bh_fdr(tests: DataFrame, family: list[str], p: str = "p") -> DataFrame:
    """Adds Benjamini-Hochberg ``q`` and ``family_size``.

    Equal p-values share a q, so the work is done on distinct p-values per
    family and a family may be of any size: the running rank and the minimum
    over larger p-values both run in chunks.  The tests are written out first:
    q-values are joined back on p, which must not be computed twice.  A missing
    p counts as 1.
    """
    tests = cut_lineage(tests.withColumn(p, F.coalesce(p, F.lit(1.0))))
    counts = tests.groupBy(*family, F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("cnt"))
    chunks = ordered_chunks(counts, family, ["_p"])
    ranked = running_total(chunks, family, ["_p"], "cnt", "_before")
    sizes = counts.groupBy(*family).agg(F.sum("cnt").alias("family_size"))
    scaled = join_groups(ranked, sizes, family).withColumn(
        "_q", F.col("_p") * F.col("family_size") / (F.col("_before") + F.col("cnt"))
    )
    qs = suffix_min(scaled, family, ["_p"], "_q", "_m").select(
        *family, F.col("_p").alias(p), F.least("_m", F.lit(1.0)).alias("q"), "family_size"
    )
    return join_groups(tests, qs, [*family, p])


# Result keys that may hold the p-value of a test, in order.
P_KEYS = ("p", "p_value", "pearson_p", "spearman_p", "adf_p_value")


def result_p(result: str = "result") -> Column:
    """The p-value of an evidence result; 1 when the test has none."""
    return F.coalesce(*[F.col(result)[k] for k in P_KEYS], F.lit(1.0))


def fdr_family(evidence: DataFrame, family: list[str]) -> DataFrame:
    """q-values for the stat_test evidence of every family."""
    tests = evidence.where("kind = 'stat_test'").withColumn("p", result_p())
    return bh_fdr(tests, family)
