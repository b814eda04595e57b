"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; all but the last return the
columns of `documents`. Texts change in one stage only (`repeats`), which sets n_chars anew.

Defined cases: a row is a row, whatever its doc_id: null and repeated ids are kept apart, and of rows with one text one stays;
between rows that tie the smallest doc_id stays, null last, then the first row. Null and letterless texts go in the first
stage. Null labels teach nothing; without any label no document is toxic. Very long texts are read in windows or portions.
An empty table gives an empty result. Further columns are dropped, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quartzlake.llm import language, packing, shingles, suffixes, toxicity
from quartzlake.llm.shared import cut, passing, release, table

#: A document whose best language has a lower mean probability is in none of the known languages.
MIN_LANGUAGE_SCORE = 0.4
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; those without a letter or with a low score go."""
    found = language.predict(docs, language.fit(docs))
    return found.where((F.col("lang_pred") != language.UNDETERMINED) & (F.col("lang_score") >= MIN_LANGUAGE_SCORE)).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below one half."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where("toxic_score < 0.5").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of texts that are linked by a shingle similarity of 0.8 or more."""
    return shingles.one_of_each(docs).select(*COLUMNS)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 200 bytes that stand before too: the first occurrence of each stays, by doc_id. A
    character that was cut in two goes, and so does a document of which nothing is left."""
    done = suffixes.remove_repeats(docs, carry=("lang", "source", "n_chars"), characters=True, keep_first=True)
    kept = done.where("n_removed = 0 OR octet_length(kept) > 0").withColumn("text", F.col("kept").cast("string"))
    length = F.when(F.col("n_removed") == 0, F.col("carry.n_chars")).otherwise(F.char_length("text").cast("long"))
    return kept.select("doc_id", "text", "carry.lang", "carry.source", length.alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


STAGES = [("language", identify_language), ("toxicity", drop_toxic), ("near duplicates", drop_near_duplicates), ("repeats", drop_repeats), ("packing", pack)]

#: The classifiers and the tokenizer have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next; what a stage has written besides goes with its input."""
    docs, held = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with passing() as made:
            docs = cut(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
            made.pop()
        release(*held)
        held = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
