"""The corpus pipeline: quality rules, language, near duplicates, mixing, packing.

Each stage takes all that the one before kept, written as Parquet and read
again, and returns the columns of documents (the last one packed pieces).

* quality_rules drops failing lines and documents that lose too much;
* language_id drops documents of no recognised language (all stay if none could be learnt);
* near_dedup keeps one document of each group of near duplicates (five-word
  shingles, Jaccard 0.8);
* mix_sources draws words of the sources by weight: a row for each document
  and pass over its source, with the words drawn; one document may so come
  twice, and goes if no word of it is drawn;
* pack packs token ids into sequences of 2048.

Null texts go in the first stage. Repeated rows become one in near_dedup. Empty
tables give empty results. Further columns of documents are carried along up to packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemill.llm.common import staged
from tidemill.llm.language import keep_known
from tidemill.llm.mixing import mixed_documents
from tidemill.llm.near_dups import without_duplicates
from tidemill.llm.packing import pack_documents
from tidemill.llm.quality_rules import keep_clean

TOKENIZER, END_ID = "word_bpe_49k.json", 1


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_clean(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_known(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path(TOKENIZER), END_ID)


STAGES = [("quality_rules", quality_rules), ("language_id", language_id), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("pack", pack)]

#: SQL can express neither the language model nor packing. tests/llm holds quality against SQL, near duplicates against all pairs and packing against
#: the ids; language and mixing against their own functions, which have brute-force tests of their own, and run() against the stages one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
