"""A corpus for training: five stages from documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and works on every row that its predecessor kept; all but the last return the columns of documents.
Null texts hold nothing to judge a language by and go in the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import langid, line_dedup, packing, quality, simhash
from factloom.llm.common import documents, free, labels, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model, fitted on the labelled ones, can tell; null and empty texts and those without a letter go.

    Very long texts are judged whole, repeated rows and ties alike; other columns pass through, whatever their names; no rows, no rows.
    """
    model = langid.train(docs)
    (told,) = free(docs, "told")
    return langid.identified(docs, model, told).where(~F.col(f"{told}.rejected")).select(*[F.col(f"`{c}`") for c in docs.columns])


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that trusted text does not find surprising for their language.

    A null lang has the threshold of all, a null or empty text nothing against it; very long texts are judged whole, repeated rows and ties alike; other
    columns pass through, whatever their names; without labels all rows stay; no rows, no rows.
    """
    return quality.keep_good(docs, labels(spark, sf_dir))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that many sites repeat, but for the copy in the smallest doc_id.

    Null texts stay null, null sites count for none; very long texts are split like others, rows of one doc_id treated alike; other columns pass through,
    n_chars is that of the new text; no rows, no rows.
    """
    return line_dedup.without_boilerplate(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: texts whose five-word shingles have a Jaccard similarity of 0.8 or more, linked in turn.

    Null and empty texts are one group; very long texts are compared whole; of ties and repeated rows one stays; other columns pass through; no rows, no rows.
    """
    return simhash.keep_one(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids in sequences with their lexical neighbours.

    A null or empty text is its end alone; very long texts run over many sequences; repeated rows are packed as often; other columns are not read; no rows, no rows.
    """
    return packing.pack(docs, ids=True)


STAGES = [("language", language), ("quality", good), ("lines", lines), ("near_duplicates", distinct), ("packing", packed)]

#: SQL has no trained model, no SimHash and no tokenizer; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
