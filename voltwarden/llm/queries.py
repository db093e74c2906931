"""The subpackage's queries: each applies its operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, jaccard, minhash, mixing, topk, trie
from .common import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents packed into sequences of 2048 tokens; null texts are empty, repeated rows are pieces of their own, an empty table gives none."""
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=0, capacity=2048)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places, hashes and scores of the secrets of all documents, by a forest that learns from findings labelled in their own contexts; null and empty texts have none."""
    from .secrets import findings, fit

    docs = table(spark, sf_dir, "documents")
    return findings(docs, fit(spark, docs=docs))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of the shingle set and component of every document; texts without words are linked with nothing."""
    from .jaccard import components

    return components(table(spark, sf_dir, "documents"), size=5, percent=80)


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best by integer inner product for each fiftieth vector, ties to smaller ids; unsound vectors take no part."""
    from .topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents by ascending id, and from the files each document's place, length and checksum; null texts are their end id alone."""
    from .tokenfile import read_files, token_files

    return read_files(token_files(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1, bits=16, unit="byte"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An MPEG audio stream of each text, stored as a table and read back into features; null and empty texts have a padded payload of 64 zeros."""
    from .media import features, media_column

    return features(common.written(media_column(table(spark, sf_dir, "documents")), "media"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by the model of the labelled ones outside the held-out fold; null texts score as empty ones."""
    from .quality import fit, score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by the model of those outside the held-out fold; texts without a letter are und."""
    from .langid import fit, predict

    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix of sources by weights 1, 2, 3 takes; null texts have size 0."""
    from .mixing import mix

    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), weights=[1, 2, 3], cap=3)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, hash and list of the spans of personal data of every document; null and empty texts have none."""
    from .pii import digest

    return digest(table(spark, sf_dir, "documents"))


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all conversations, each begun with turns of its group's first; rows without a conv_id take no part, an empty table has no node."""
    nodes = trie.trie(*trie.regrown(*trie.turns(table(spark, sf_dir, "conversations")), heads=4, group=20))
    return nodes.drop("rank", "subtree_end")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16 whitened components of every sound vector; a deviation too large for a long is null."""
    from .whitening import whiten

    rows = whiten(table(spark, sf_dir, "embeddings"), k=16)
    return rows.withColumn("deviation", F.col("deviation").try_cast("long"))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of the shingle set, component and whether it is kept, for every document; texts without words are linked with nothing."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_secrets": op2_secrets,
    "op3_jaccard": op3_jaccard,
    "op4_topk": op4_topk,
    "op5_token_files": op5_token_files,
    "op6_media": op6_media,
    "op7_quality": op7_quality,
    "op8_language": op8_language,
    "op9_mixing": op9_mixing,
    "op10_pii": op10_pii,
    "op11_trie": op11_trie,
    "op12_whitening": op12_whitening,
    "op13_minhash": op13_minhash,
}

ORACLE_SQL: dict[str, str] = {
    "op3_jaccard": jaccard.SQL,
    "op4_topk": topk.SQL,
    "op9_mixing": mixing.SQL,
    "op11_trie": trie.SQL,
    "op13_minhash": minhash.SQL,
}
