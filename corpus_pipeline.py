"""Documents to token ids: five stages, each reading what the one before has written.

Each stage takes (spark, docs, sf_dir) and works on all of docs. All but the last
return the columns of ``documents``. Decisions name rows by KEY, id and text, so that
rows whose ids are null or repeat are decided each; rows equal in both share a decision.
Null and letterless texts go in the first stage; texts are read whole, however long, and
those of fewer than five words are one shingle. An empty table stays empty in each stage,
and other columns than those of ``documents`` are dropped by the first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import bpe, decontaminate, jaccard, langid, scratch, secrets
from factloom.llm.components import near
from factloom.llm.queries import PATTERN, VOCABULARY

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


#: Documents that Python gets at once; the stages' results run later, so the session keeps it.
BATCH_ROWS = 500


def _small_batches(spark: SparkSession) -> None:
    """Lowers the session's batch size if it is larger, so that batches of long texts stay small."""
    if int(spark.conf.get(scratch.BATCH)) > BATCH_ROWS:
        spark.conf.set(scratch.BATCH, str(BATCH_ROWS))


KEY = "_key"


def _keyed(docs: DataFrame) -> DataFrame:
    """Adds what tells rows apart; keys with an id come before those without."""
    return docs.withColumn(KEY, F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", F.xxhash64("text").alias("hash")))


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Keyed docs but those with the given keys; texts aren't moved while the keys are few."""
    return docs.join(near(scratch.keep(keys.select(KEY).distinct(), "dropped")), KEY, "left_anti")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose language is rejected; those without a letter or text among them."""
    _small_batches(spark)
    model = langid.train(*langid.sample(docs))
    return langid.identify(docs, model, out="_language").where(~F.col("_language.rejected")).select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of similar ones, once if it repeats, and all that link with none."""
    docs = _keyed(docs)
    groups = scratch.keep(jaccard.jaccard_components(docs, KEY), "groups")
    left = _without(docs, groups.where(F.col(KEY) != F.col("component_id")))
    again = scratch.keep(groups.where(F.col("n_shingles") > 0).groupBy(KEY).count().where("count > 1").select(KEY), "again")
    if again.isEmpty():
        return left.select(*COLUMNS)
    once = left.join(near(again), KEY, "left_semi").dropDuplicates([KEY])
    return _without(left, again).select(*COLUMNS).union(once.select(*COLUMNS))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents of which passages of the benchmark cover a twentieth or more."""
    docs = _keyed(docs)
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), KEY)
    return _without(docs, found.where("contaminated")).select(*COLUMNS)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the texts; all documents stay."""
    _small_batches(spark)
    return secrets.mask_secrets(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text and how many they are."""
    _small_batches(spark)
    coded = bpe.encode_documents(docs, VOCABULARY, PATTERN)
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language", language),
    ("one_of_each", one_of_each),
    ("decontaminated", decontaminated),
    ("without_secrets", without_secrets),
    ("tokens", tokens),
]
#: SQL can't say the trained, hashed and token-level stages; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = scratch.keep(docs, f"stage-{name}")
    return docs
