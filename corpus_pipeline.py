"""A corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a frame, which is written and read again as the next one's docs. All but the
last return the columns of documents. No stage samples, caps or cuts texts. Stages whose Python workers need memory beside the
executors' JVMs first have these give back what earlier stages made them take.

1. quality classifier: documents that it rejects go.
2. SimHash near-dedup: one document of each group of near copies (five-word shingles, similarity 0.8 or more) stays.
3. secret scans: what is secret in a text is replaced, n_chars follows.
4. mixing sources to target weights: documents as often as the mix takes them, whole.
5. SentencePiece encoding: number and digest of the ids of each text of the mix, and the digest of what they decode to.

Edge cases by stage. All: an empty table stays empty, further columns are kept (but by the last), very long texts are taken whole.
1. Null text is scored as the empty text; repeated rows and rows without an id stay or go each by its text.
2. Near copies are looked for by SimHash and, as that misses pairs, by prefix filtering too. Null text is the empty text; texts
   without words are copies of each other; of repeated rows one stays; ties go to the smallest doc_id, null last.
3. Null text stays null; n_chars changes only with the text.
4. Null source is a source of its own; rows with null, equal or repeated ids are taken by number; null text has size 0.
5. Null text is the empty text; every row of the mix gives a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidegraph.llm import mixing, neardup, pieces, quality, secrets
from tidegraph.llm.common import give_back_heap, settle, table


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.reject_documents(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    give_back_heap(spark)
    return neardup.drop_near_copies(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    give_back_heap(spark)
    return secrets.redact_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    give_back_heap(spark)
    return pieces.digest_texts(docs)


STAGES = [
    ("quality", reject_low_quality),
    ("near_dedup", drop_near_copies),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: SQL can express neither the learned classifier nor the groups; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settle(docs, name)
    return docs
