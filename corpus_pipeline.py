"""A corpus pipeline of the operators in lodestar.llm: from documents to packed token sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.llm import exact_dedup, langid, minhash, packing, suffix_dedup
from lodestar.llm.common import written

#: Least share of a document that its main language must have.
SHARE = 0.4


def language(spark, docs, sf_dir):
    """Documents without a letter, or without a main language, go. The model is learned from the labelled ones.

    Null and empty texts have no letter and go; rows of null language are learned nothing from;
    repeated rows share one decision; columns of any names are kept; an empty table stays empty.
    """
    model = langid.train(docs.select("doc_id", "text", "lang"))
    found = langid.identify(docs, model)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= SHARE)).select(*docs.columns)


def exact(spark, docs, sf_dir):
    """One document of each group of equal texts stays, that of the largest id.

    Null counts as an empty text; rows that repeat both id and text stay or go together; a null id
    goes if its group has another; columns of any names are kept; an empty table stays empty.
    """
    return exact_dedup.survivors(docs)


def near(spark, docs, sf_dir):
    """One document of each group of near duplicates stays, that of the smallest id.

    Null, empty and blank texts have no words and stay, as do rows of null id; rows of equal id stay
    or go together; columns of any names are kept; an empty table stays empty.
    """
    return minhash.survivors(docs)


def passages(spark, docs, sf_dir):
    """Passages of 50 bytes and more that a document of smaller id has too are cut out; no document goes.

    Null texts stay null, short ones whole; rows of null id lose nothing, and rows of equal id
    nothing to each other; columns of any names are kept, n_chars is counted anew; an empty table
    stays empty.
    """
    cut = suffix_dedup.without_passages(docs)
    return cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def packed(spark, docs, sf_dir):
    """Sequences of 1024 tokens at most.

    A null or empty text is the end token alone; repeated rows are packed each on its own, whatever
    their ids; other columns are not read; an empty table gives no sequence.
    """
    return packing.pack(docs)


STAGES = [("language ID", language), ("exact dedup", exact), ("MinHash near-dedup", near), ("suffix-array dedup", passages), ("best-fit packing", packed)]
#: SQL cannot express language ID, the sketches or the packing; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The packed pieces of all documents that stay, after every stage was written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
