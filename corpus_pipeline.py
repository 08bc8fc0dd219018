"""A corpus pipeline over `documents`: every stage works on all that the stage before kept.

`STAGES` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return
the columns of documents. `run` writes each stage's result under the shared folder and reads it again as the next input.

Stages: documents whose language is rejected go; of each group of near copies the one with the smallest doc_id stays;
documents that hold benchmark passages go; sources are mixed to their target weights; the mix is cut into shards.

Every stage takes NULLs in any column, empty and very long texts, repeated rows, empty tables and extra columns of any
name; what it does with them is said at the stage. Only the last stage adds columns.
"""

from pyspark.sql import DataFrame, SparkSession

from tarnwatch.llm import decontaminate, language_models, mixing, reshard, set_join
from tarnwatch.llm.common import load, materialise, prepare

#: No SQL: the language models, the near-copy groups and spaced seeds are no SQL expressions; stages are tested by brute force.
ORACLE_SQL = None


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language models accept.

    NULL texts and texts without a letter have no language and go. Repeated rows share their fate, and a text of any
    length is read whole. Without a training text (an empty table, no lang at all) there is no model and all go.
    """
    return language_models.accepted(docs, language_models.train(docs))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id.

    NULL and empty texts are near to nothing and stay. A NULL doc_id comes after all ids, ties go by a hash of the text,
    and of rows equal in doc_id and text one stays. An empty table stays empty.
    """
    return set_join.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages.

    NULL and empty texts hold none and stay; repeated rows and rows with a NULL doc_id are judged by their text. Without
    documents or without benchmark items nothing goes.
    """
    return decontaminate.drop_leaks(docs, load(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents in the number of copies that brings sources to their target weights.

    A NULL source is a source of its own. Documents without a word have size 0: they are in the mix as often as their
    source is repeated as a whole. Repeated rows are documents of their own; an empty table gives an empty mix.
    """
    return mixing.materialise_mix(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in 16 shards of near equal bytes, from 12 shards by text with the fewest bytes moved, read from the shards' files.

    NULL texts weigh one byte. Columns named like one of the shard's own come back as `<name>_given`. Repeated rows take
    slots of their own; an empty table gives no rows.
    """
    return reshard.reshard_files(docs, reshard.hashed_layout())


STAGES = [
    ("language ID", known_language),
    ("n-gram Jaccard join", one_of_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources to target weights", mixed),
    ("sharding", sharded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
