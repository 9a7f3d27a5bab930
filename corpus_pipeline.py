"""The corpus pipeline: from raw documents to token files, stage by stage.

Each stage calls one operator over all rows that the stage before it kept, and its
result is written to the shared folder and read again. Nulls and empty tables are what
the operators say: a null text is an empty one and is kept until mixing takes its words,
of which it has none; repeated rows stay rows of their own up to the near-duplicate stage;
an empty table passes through all stages.
"""

from pyspark.sql import DataFrame, SparkSession

from stewardspark.llm import decontamination, mixing, near_dup, token_files, tokens, toxicity
from stewardspark.llm.common import stored, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest id."""
    return near_dup.without_near_duplicates(docs, shingle=3, distance=3)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, or as much of them, as the mix takes."""
    return mixing.mixed_documents(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All texts as token files; returned is their index, read back from them."""
    return token_files.token_files(docs, tokens.default_tokenizer())


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_files", token_stage),
]

#: SQL can express neither the classifier nor the tokenizer nor the components.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
