"""A corpus pipeline: documents that a quality classifier keeps, one of each group of near copies, without secrets, mixed
to target weights and packed into training sequences. Each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltwarden.llm import common, jaccard, mixing, packing, quality, queries, secrets

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: SQL can express neither the trained classifier nor the trained forest; tests hold the stages against plain versions.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. It learns from all labelled rows up to its bound.

    A null text scores as an empty one; rows that repeat an id or a text are judged each by itself and alike, null ids stay
    null ids, and an empty table has an empty result. Without labels of both classes all are judged alike.
    """
    model = quality.fit(docs.select("doc_id", "text"), common.table(spark, sf_dir, "labels"))
    return quality.score(docs, model).where("predicted = 1").select(*COLUMNS)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that with the smallest id, nulls last.

    Groups are of texts, so rows that repeat a text are one, whatever their ids, and a row that is like no other stays,
    also with a null id or with one that other texts have. Texts without words are like no other; of these, rows that
    repeat an id are one.
    """
    row, one = common.fresh(docs, "row", "one")
    rows = common.written(docs.select(*COLUMNS).withColumn(row, F.monotonically_increasing_id()), "rows")
    groups = jaccard.components(rows, doc_id=row).select(F.col("doc_id").alias(row), "n_shingles", "component_id")
    named = groups.join(rows.select(row, "doc_id"), row)
    wordless, own = F.col("n_shingles") == 0, F.col("doc_id").isNotNull()
    named = named.withColumn("kind", F.when(~wordless, 0).when(own, 1).otherwise(2))
    named = named.withColumn("group", F.when(wordless & own, F.col("doc_id")).otherwise(F.col("component_id")))
    first = named.groupBy("kind", "group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", row)).alias(one))
    return rows.join(first.select(F.col(one)[row].alias(row)), row, "left_semi").select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret's text replaced and n_chars counted anew.

    Null and empty texts stay as they are, repeated rows stay and are changed alike, and an empty table has an empty result.
    """
    return secrets.redact(docs, secrets.fit(spark, docs=docs)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; repeats are repeated rows.

    A null source is a source of its own, null texts have no words and go with others of their source, rows that repeat an
    id are taken together, and an empty table has an empty result.
    """
    return mixing.repeated(mixing.mix(docs)).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of at most 2048 tokens.

    Null texts are empty documents of one token, rows that repeat an id are pieces of their own, and an empty table gives
    no piece.
    """
    return packing.pack_documents(docs, queries.vocabulary("byte_bpe_50k.json"), end_id=0, capacity=2048)


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", jaccard_join),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", mixing_sources),
    ("best-fit packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's are written to the shared folder and read again. What a stage wrote for itself,
    and the rows of the stage before, go when its own rows are stored."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with common.scope(spark):
            path = docs.inputFiles()[:1] if name != STAGES[0][0] else []
            docs = common.written(stage(spark, docs, sf_dir), name.replace(" ", "-"), keep=True)
        for file in path:
            common.delete(spark, file.rsplit("/", 1)[0])
    return STAGES[-1][1](spark, docs, sf_dir)
