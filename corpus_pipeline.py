"""The corpus pipeline: stages over the documents table, each reading what the last kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import common, langid, packing, secrets, simhash, toxicity

VOCABULARY = "word_bpe_49k.json"
REJECT_TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is at least ``REJECT_TOXIC`` go. Null and empty texts
    and rows with null ids are scored like any other; repeated rows go or stay together;
    an empty table stays empty."""
    docs = common.bounded(docs)
    scorer = toxicity.train(docs, common.table(spark, sf_dir, "labels"))
    into = common.free_name(docs.columns, "toxicity")
    return toxicity.scored(docs, scorer, into=into).where(F.col(into) < REJECT_TOXIC).select(*docs.columns)


def drop_no_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no language, that is null texts and texts without a letter, go. The
    others keep their columns, with ``lang`` as identified, or as it was if there was no
    language to learn. Repeated rows and rows with null ids are judged like any other; an
    empty table stays empty."""
    docs = common.bounded(docs)
    model = langid.train(docs.select("doc_id", "text", "lang"))
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    lang, share = (common.free_name(docs.columns, n) for n in ("found_lang", "found_share"))
    found = langid.identify(docs, model, (lang, share))
    kept = found.where(F.col(lang) != langid.UNDETERMINED).withColumn("lang", F.col(lang))
    return kept.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies stays: five-word
    shingles, Jaccard similarity of 0.8 or more. Null texts are empty, and empty texts
    are copies of each other; rows with null ids stay; of repeated rows one stays; an empty
    table stays empty."""
    return simhash.one_per_group(common.bounded(docs))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, repeated ones too; found secrets are replaced and n_chars
    follows the text. Null texts stay null; an empty table stays empty."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 ids, repeated ones too. Null
    texts have their end id only; ties in length go by place; an empty table gives no rows."""
    return packing.pack(common.bounded(docs), common.tokenizer_path(VOCABULARY))


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_no_language),
    ("near_duplicates", drop_near_copies),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: Trained stages and the library's tokenization have no SQL form; tests compare each
#: stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each one's rows written in between."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
