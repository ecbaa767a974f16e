"""A training corpus from documents: classify, filter by rules, drop near duplicates, mix sources, pack.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but the last return the columns of
documents. ``run`` writes each stage's rows to the shared folder and reads them again.

For all stages: null, empty and very long texts, rows that repeat an id or agree in all columns, and ids that are null have the
result that each stage names; columns beside those of documents are kept as they are, whatever their names; an empty table gives
an empty table of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parley.llm.common import stage
from parley.llm.mixing import mix
from parley.llm.near_dup import one_of_each
from parley.llm.packing import pack
from parley.llm.quality_gam import quality_scores
from parley.llm.quality_rules import quality_rules
from parley.llm.queries import SEED, table, WANTED

#: The share of tokens that the mix draws from what is left, and its rounds at most.
BUDGET, ROUNDS = 0.8, 24


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.5 or more; it is fitted on labelled documents of the input.

    Null and empty texts are scored by features that are all 0. Rows that agree in their text are scored alike, so they stay or go
    together. Without labels the score is 0.5 and all rows stay.
    """
    return quality_scores(docs, table(spark, sf_dir, "labels"), keep=tuple(docs.columns))


def filter_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Null, empty and short texts (below 10 words) go; equal texts of one language are judged alike."""
    return quality_rules(docs, keep=tuple(docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near duplicates. Null, empty and wordless texts and rows with a null id stay;
    of rows that repeat an id and a text one stays."""
    return one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by calibrated probabilities, once each. Null sources and languages are values of their own; null and empty
    texts weigh one token; rows that repeat an id within a source, language and topic are drawn together."""
    return mix(docs, WANTED, budget=BUDGET, seed=SEED, rounds=ROUNDS, keep=tuple(docs.columns))


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies. Texts without words are pieces of 0 tokens; null sources conflict with nothing; every
    row is packed, repeated ones too."""
    return pack(docs)


STAGES = [
    ("quality_classifier", classify),
    ("quality_rules", filter_rules),
    ("near_duplicates", drop_near_duplicates),
    ("source_mix", mix_sources),
    ("best_fit_packing", pack_bins),
]
#: Boosting, near-duplicate classes and packing are not expressible in SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
