"""A corpus pipeline: toxicity, near-duplicates, secrets, mixture, tokens.

``STAGES`` are functions (spark, docs, sf_dir) -> DataFrame; each reads what the
one before it wrote. All but the last return the columns of ``documents``.

Cases, for all stages: null texts, ids, languages and sources, empty texts, very
long texts (worked on whole), repeated rows and further columns of any name
(dropped) are allowed; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import bpe, jaccard, mixing, secrets, toxicity
from sightline.session import saved, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.5 or more go; rows without text or id are scored like any other, repeated rows alike."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.scores(docs, model, keep=COLUMNS).where("score < 0.5").select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard 0.8 or more) the document of smallest id stays.

    SimHash finds links, which are checked and completed (see ``jaccard``). Null
    and empty texts are copies of each other. Rows without id all stay; different
    texts of one id are told apart, equal ones are one.
    """
    return jaccard.once(docs.select(*COLUMNS))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind; every document stays, a null text stays null."""
    r = secrets.scan(docs, keep=("doc_id", "lang", "source", "n_chars"), redacted=True)
    n = F.when(F.col("spans") == "", F.col("n_chars")).otherwise(F.length("redacted").cast("long"))
    return r.select("doc_id", F.col("redacted").alias("text"), "lang", "source", n.alias("n_chars"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources take them: 0, 1 or 2 times.

    Null and empty texts have size 0 and are taken like their neighbours in size;
    a null source is a source of its own; equal rows are documents of their own.
    """
    return mixing.mix(docs.select(*COLUMNS))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of the mix: their number, and digests of the ids and of their decoding; a null text is read as an empty one."""
    return bpe.digests(docs, *bpe.default_ranks(), keep=("doc_id", "lang", "source", "n_chars"))


STAGES = [("toxicity", toxicity_stage), ("simhash", near_dedup_stage), ("secrets", secrets_stage), ("mixing", mixing_stage), ("bpe", tokens_stage)]
#: Models and fingerprints are not expressible in SQL; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
