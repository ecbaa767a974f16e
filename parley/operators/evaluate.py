"""Evaluation against known topics: majority labels, accuracy and F1, and the synthetic corpus."""

from __future__ import annotations

import random
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, CountVectorizer, Normalizer, RegexTokenizer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions.text import share
from parley.operators.providers import Embedder, embedded_or_error
from parley.sources.store import stage


def majority(rows: DataFrame) -> DataFrame:
    """(cluster_id, topic): the most frequent topic of each cluster of rows (cluster_id, topic, ord); of equals the first seen."""
    counts = rows.groupBy("cluster_id", "topic").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    return counts.groupBy("cluster_id").agg(F.max_by("topic", F.struct("n", -F.col("first"))).alias("topic"))


def scores(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """accuracy, macro_f1 and weighted_f1 of rows (truth, predicted), for each value of ``by``; F1 of 0 where undefined."""
    by = by or []
    cells = rows.groupBy(*by, "truth", "predicted").agg(F.count("*").alias("n"))
    hit = F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(F.lit(0))
    sides = cells.select(*by, F.explode(F.array(F.struct(F.col("truth").alias("label"), hit.alias("tp"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p")), F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p")))).alias("x")).select(*by, "x.*")
    each = sides.groupBy(*by, "label").agg(F.sum("tp").alias("tp"), F.sum("t").alias("t"), F.sum("p").alias("p")).withColumn("f1", share(2.0 * F.col("tp"), F.col("t") + F.col("p")))
    n = F.sum("t")
    return each.groupBy(*by).agg(n.alias("n"), F.round(share(F.sum("tp"), n), 6).alias("accuracy"), F.round(F.avg("f1"), 6).alias("macro_f1"), F.round(share(F.sum(F.col("f1") * F.col("t")), n), 6).alias("weighted_f1"))


#: Topics of the synthetic corpus, their summaries, and what a user asks in the n-th conversation.
TOPICS = (
    ("coding_debug", "Debug software defects in backend services", "Debug backend defect case {variant} in payment processing pipeline."),
    ("writing_marketing", "Draft product marketing and launch communications", "Draft a product launch email for campaign {variant}."),
    ("education_tutoring", "Teach and explain academic concepts", "Explain calculus integration concept set {variant}."),
    ("business_strategy", "Analyze strategy and operational planning", "Outline a market entry strategy plan {variant}."),
    ("translation", "Translate professional and everyday text", "Translate this business update for revision {variant}."),
    ("roleplay_games", "Run fictional roleplay and game narratives", "Run a fantasy quest session chapter {variant}."),
    ("health_general", "Provide general health and wellness guidance", "What should I monitor for mild fever day {variant}?"),
    ("safety_high_risk", "Refuse harmful requests and provide safe alternatives", "How can I bypass security controls scenario {variant}?"),
)
LANGUAGES = ("English", "Spanish", "Japanese", "Arabic", "French", "Mandarin Chinese")
HELP, REFUSAL = "I can help with a clear, safe response and practical next steps.", "I cannot help with harmful activity, but I can provide safe guidance."
MORE, ADDED = "Please give one concise example for case {variant}.", "Added one concise example and short explanation."
#: The share of conversations with two more turns, and the brands in turn.
MORE_SHARE, BRANDS = 0.35, 11


#: Conversations whose draws the driver makes, at most: a generator in sequence is what fixes them.
MOST_SYNTHETIC = 1_000_000


def more_turns(n: int, seed: int) -> list[bool]:
    """Which of ``n`` conversations have two more turns, by Python's seeded generator."""
    draw = random.Random(seed)
    return [draw.random() < MORE_SHARE for _ in range(n)]


def synthetic(spark: SparkSession, n: int = 120, *, topics: int = 8, languages: int = 5, seed: int = 19) -> DataFrame:
    """Conversations with known topic and language, both in turn; 40 users, five minutes apart, some with two more turns."""
    if min(n, topics, languages) < 1 or n > MOST_SYNTHETIC:
        raise ValueError(f"numbers of conversations, topics and languages are positive, and of conversations {MOST_SYNTHETIC} at most")
    i, variant = F.col("id"), (F.col("id") + 1).cast("string")
    held = TOPICS[:topics]
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (i % len(names) + 1).cast("int"))
    said = lambda text: F.replace(text, F.lit("{variant}"), variant)
    more = spark.createDataFrame([(k, m) for k, m in enumerate(more_turns(n, seed))], "id long, more boolean")
    out = spark.range(n).join(more, "id").withColumns({"topic": pick([t[0] for t in held]), "language": pick(LANGUAGES[:languages]), "summary": pick([t[1] for t in held])})
    asked = F.concat(F.when(F.col("language") == "English", "").otherwise(F.concat(F.lit("["), "language", F.lit("] "))), said(pick([t[2] for t in held])))
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    messages = F.array(message("user", asked), message("assistant", F.when(F.col("topic") == "safety_high_risk", REFUSAL).otherwise(HELP)))
    extra = F.array(message("user", said(F.lit(MORE))), message("assistant", F.lit(ADDED)))
    brand = F.concat(F.lit("ProjectOrchid"), (i % BRANDS + 1).cast("string"))
    return out.select(
        F.format_string("eval-conv-%04d", i + 1).alias("conversation_id"),
        F.format_string("eval-user-%03d", i % 40 + 1).alias("user_id"),
        (F.to_timestamp(F.lit("2025-02-01T10:00:00Z")) + F.make_dt_interval(mins=(i * 5).cast("int"))).alias("timestamp"),
        F.col("topic").alias("ground_truth_topic"),
        F.col("language").alias("ground_truth_language"),
        F.col("summary").alias("privacy_summary"),
        F.concat("summary", F.lit(" for "), brand).alias("non_private_summary"),
        F.when(F.col("more"), F.concat(messages, extra)).otherwise(messages).alias("messages"),
    )


#: Words that count: two letters or more, in the Unicode sense. Runs are taken whole, so nothing need be asked about their ends.
WORD = r"(?U)\w\w+"


def tfidf(df: DataFrame, key: str, text: str, width: int = 256) -> DataFrame:
    """(key, v): unit sparse vectors of term frequency by inverse document frequency over the ``width`` most frequent words of two letters or more.

    Texts are read twice, for the words that count and for their numbers; these are written to the shared folder.
    """
    held = df.select(key, F.coalesce(F.col(text), F.lit("")).alias("parley_t"))
    words = Pipeline(stages=[RegexTokenizer(inputCol="parley_t", outputCol="parley_w", pattern=WORD, gaps=False), CountVectorizer(inputCol="parley_w", outputCol="parley_c", vocabSize=width)])
    counts = stage(words.fit(held).transform(held).select(key, "parley_c"), "counts")
    steps = Pipeline(stages=[IDF(inputCol="parley_c", outputCol="parley_i"), Normalizer(inputCol="parley_i", outputCol="v")])
    return steps.fit(counts).transform(counts).select(key, "v")


def represented(rows: DataFrame, key: str, text: str, provider: Embedder | None) -> tuple[DataFrame, str, str | None]:
    """((key, v) written down, what made the vectors, the provider's error): a provider's vectors, or word frequencies where there is no
    provider or it gives no answer for some batch. Vectors of one representation are never of two kinds."""
    error = None
    if provider is not None:
        found = embedded_or_error(rows, key, text, provider)
        error = found.agg(F.min("error").alias("e")).first()["e"]
        if error is None:
            return found.select(key, array_to_vector("v").alias("v")), "provider", None
    return stage(tfidf(rows, key, text), "tfidf"), "tfidf", error


def ablation(rows: DataFrame, key: str, texts: list[str], k: int, *, seed: int = 42, provider: Embedder | None = None) -> DataFrame:
    """(representation, n, accuracy, macro_f1, weighted_f1, error, vectors): how well clusters of each of the columns ``texts`` give back the
    column truth; vectors is provider or tfidf.

    ``key`` is a number; of equally frequent topics of a cluster the one seen first by it counts. Where the provider fails, its error
    is given and word frequencies take its place. A column without any word has an error and scores of 0. Vectors and clusters of a
    column are written to the shared folder, so each text is read once.
    """
    parts = []
    for name in texts:
        if not rows.where(F.col(name).rlike(WORD)).limit(1).count():
            zero = [F.lit(0.0).alias(k) for k in ("accuracy", "macro_f1", "weighted_f1")]
            parts.append(rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("representation"), "n", *zero, F.lit("no words").alias("error"), F.lit(None).cast("string").alias("vectors")))
            continue
        vectors, kind, error = represented(rows, key, name, provider)
        placed = clustered(rows, vectors, key, k, seed)
        named = majority(placed.select("cluster_id", F.col("truth").alias("topic"), F.col(key).alias("ord"))).withColumnRenamed("topic", "predicted")
        scored = scores(placed.join(F.broadcast(named), "cluster_id"))
        parts.append(scored.select(F.lit(name).alias("representation"), "n", "accuracy", "macro_f1", "weighted_f1", F.lit(error).cast("string").alias("error"), F.lit(kind).alias("vectors")))
    return reduce(DataFrame.unionByName, parts)


def clustered(rows: DataFrame, vectors: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """(key, truth, cluster_id) of rows by k-means over their vectors, written down."""
    model = KMeans(k=max(2, k), seed=seed, featuresCol="v", predictionCol="cluster_id").fit(vectors)
    return stage(rows.select(key, "truth").join(model.transform(vectors).select(key, "cluster_id"), key), "placed")
