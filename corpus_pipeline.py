"""A training corpus from documents: five stages, each a table that the next one reads.

toxicity: documents that the ordinal regression grades as toxic go.
near_duplicates: one document of each component of similar texts stays
(word 5-shingles, Jaccard similarity 0.8 or more).
personal_data: spans of personal data are masked in the text.
mixing: documents repeat, or go, so that sources come near their target weights.
packing: documents become pieces of sequences of at most 2048 tokens.

Defined results, stage by stage, for the cases that the operators name:

- nulls: a null text has no toxic words, no shingles and no personal data, so it passes
  the first three stages as it is; its size is 0, so its copies are drawn alone; it
  is packed as one end token. A null id, language or count is kept; a null source is the last source.
- empty and very long texts: as nulls, but the text stays empty; whole texts are read at every stage.
- ties and repeated rows: repeated rows are graded alike; of rows that are equal or
  similar the smallest id stays, and of equal ids with equal texts one row; copies
  that mixing makes are equal rows and are packed apart.
- empty tables: every stage returns an empty table with its columns; without labels of both kinds no document goes.
- extra columns: all but the last stage keep them, whatever their names; none is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnwick.llm import jaccard, mixing, packing, pii, toxicity
from tarnwick.session import drop_stored, stored

#: No SQL expresses the fitted models and the random rounding; tests compare with brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not toxic, learned from the labels of documents still here; all, if nothing can be learned."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, toxicity.fit(toxicity.labelled(docs, labels)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of similar texts; all that have no words."""
    return jaccard.one_of_each(docs, k=5, percent=80)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked; null and empty texts as they are."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it: 0, 1 or more equal rows; all columns kept."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document with its place in a sequence; a null text is one end token."""
    return packing.pack(docs, packing.tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over documents."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:  # the table that this stage has read
            drop_stored(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
