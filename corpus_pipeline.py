"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents. Its decisions take effect: rejected documents go, repeated line chunks are cut out of
texts, of near-duplicates one document stays, secrets are masked. The last stage gives the pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linkweave.llm import line_dedup, packing, quality, secret_scan, simhash
from linkweave.llm.common import table, written
from linkweave.llm.encoding import vocabulary_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule or are outliers go. A null text fails; a null language or source is
    a group of its own; repeated rows get equal verdicts; an empty table stays empty."""
    return quality.filtered(docs)


def line_chunks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines are cut out of texts. A null text stays null, a null id sorts first, rows
    equal in id and text lose the same; an empty table stays empty."""
    return line_dedup.deduplicated(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more the one with the
    smallest id stays, null ids last. Texts without words, null ones too, are one group; so are repeated
    rows; an empty table stays empty."""
    return simhash.deduplicated(docs, shingle=5, similarity=(4, 5))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are masked. A null text stays null; repeated rows are masked alike; an empty table
    stays empty."""
    return secret_scan.redacted(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences. A null text is its end id alone, a null source a source of its own,
    repeated rows are packed each; an empty table gives no pieces."""
    return packing.pack(docs, vocabulary_path("byte_bpe_50k.json"), end_id=1)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_chunks", line_chunks),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("packed", packed),
]

#: Tokens and XXH64 fingerprints are beyond SQL: tests/llm hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
