"""Privacy: ratings by rule, their summary, the gate, and the score of an auditor on cases with known ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions.text import share

EMAIL, PHONE, SECRET = r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+[.][A-Za-z]+", r"[+]?[0-9][0-9 ().-]{7,}[0-9]", r"(?i)(api[_ -]?key|password|secret)"
MISSING = "Missing privacy audit result."


def rule_rating(content: Column) -> Column:
    """1 with an address or a phone number, 2 with a secret's name, 3 with many digits, 5 otherwise; null content is 5."""
    text = F.coalesce(content, F.lit(""))
    return F.when(text.rlike(EMAIL) | text.rlike(PHONE), 1).when(text.rlike(SECRET), 2).when(text.rlike("[0-9]{6}"), 3).otherwise(5)


def summary(audits: DataFrame, threshold: int = 3) -> DataFrame:
    """By stage: total, passed, failed, pass_rate, and the ratings' histogram as ``rating:n`` in numeric order."""
    counts = audits.groupBy("stage", "rating").agg(F.count("*").alias("n"))
    entry = F.struct("rating", F.concat(F.col("rating").cast("string"), F.lit(":"), F.col("n").cast("string")).alias("t"))
    out = counts.groupBy("stage").agg(F.sum("n").alias("total"), F.coalesce(F.sum(F.when(F.col("rating") >= threshold, F.col("n"))), F.lit(0)).alias("passed"), F.array_sort(F.collect_list(entry)).alias("h"))
    return out.select("stage", "total", "passed", (F.col("total") - F.col("passed")).alias("failed"), F.round(share(F.col("passed"), F.col("total")), 6).alias("pass_rate"), F.array_join(F.transform("h", lambda x: x["t"]), ",").alias("histogram"))


def gate(clusters: DataFrame, audits: DataFrame, threshold: int = 3) -> DataFrame:
    """Clusters with rating, privacy_kept and final_kept; a cluster without an audit counts as rated 1."""
    out = clusters.join(audits.select("cluster_id", "rating"), "cluster_id", "left")
    note = F.when(F.col("rating").isNull(), F.lit(MISSING)).otherwise(F.lit(""))
    out = out.select(*[c for c in clusters.columns], F.coalesce("rating", F.lit(1)).alias("rating"), note.alias("note"))
    kept = F.col("rating") >= threshold
    return out.withColumn("privacy_kept", kept).withColumn("final_kept", kept & F.col("kept_by_threshold"))


def auditor_score(cases: DataFrame) -> DataFrame:
    """One row over cases (rating, low, high): the share in range, and the mean distance to the middle, halves to even."""
    middle = F.bround((F.col("low") + F.col("high")) / 2, 0)
    return cases.agg(
        F.count("*").alias("cases"),
        F.round(share(F.count_if(F.col("rating").between(F.col("low"), F.col("high"))), F.count("*")), 6).alias("in_range_rate"),
        F.round(F.coalesce(F.avg(F.abs(F.col("rating") - middle)), F.lit(0.0)), 6).alias("mean_error"),
    )


#: Cases that an auditor is scored on, with the least and the largest rating expected.
CASES = (
    ("pv-001", "Jane Doe at Acme Corp requested salary details for employee 412.", 1, 2),
    ("pv-002", "A single startup in Austin asked for legal tax advice in a private context.", 2, 3),
    ("pv-003", "Users asked for guidance on debugging Python web APIs.", 4, 5),
    ("pv-004", "Many conversations involve drafting marketing copy for product launches.", 4, 5),
    ("pv-005", "An employee at Northbridge Biotech asked for merger-sensitive negotiation tactics.", 1, 2),
    ("pv-006", "Conversations discuss general language translation tasks across teams.", 4, 5),
)


def cases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CASES), "case_id string, content string, low int, high int")


def fallback_counts(audits: DataFrame) -> DataFrame:
    """(stage, audits, fallbacks): in how many audits (stage, fallback_used) of a stage the fallback spoke."""
    return audits.groupBy("stage").agg(F.count("*").alias("audits"), F.count_if("fallback_used").alias("fallbacks"))
