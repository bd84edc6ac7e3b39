"""The corpus pipeline: documents through five stages, each written as Parquet and read again by the next.

Every stage works on all rows that the one before kept. Documents that the quality classifier rejects go; lines that
are later copies of repeated runs go, and with them texts that consist of nothing else; of near copies the document with
the smallest doc_id stays; the mix repeats or leaves out documents by source; the last stage places what is left in
training sequences.

A null or empty text gets the score of the network's bias in the first stage; if it stays, line dedup leaves it, it is
linked with nothing, its size in the mix is 0, and packed it is one piece that holds the end id. Repeated rows are scored
each, are one document to line and near dedup, of which one stays, and are mixed and packed by what is left. A null
source is a source of its own. Columns besides those of documents are carried to the last stage, whatever their names.
An empty table gives an empty result at every stage.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from verdance.llm import bytenet, lines, minhash, mixing, packing
from verdance.llm.common import cut, drop_tables, recorded, ship, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Bytes of an Arrow batch: texts differ so much in length that a number of rows bounds nothing.
BATCH = "8m"


#: Tables that a stage wrote for itself, by stage.
_written: dict[str, list[str]] = {}


def stage(run: Stage) -> Stage:
    """A stage that first gives back the disk of those before it.

    A stage begins when its predecessor's result is written, so the tables behind that one have served. Those of the
    stage itself stay until a later one begins, and those of the last stage until its result is read.
    """

    @wraps(run)
    def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        order = [f.__name__ for _, f in STAGES]
        for name in order[: order.index(run.__name__)]:
            drop_tables(spark, _written.pop(name, []))
        with recorded() as paths:
            out = run(spark, docs, sf_dir)
        _written.setdefault(run.__name__, []).extend(paths)
        return out

    return begun


def workers(spark: SparkSession) -> None:
    """Python workers that know the package and take small batches."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that the classifier, trained on their own labels, predicts to be good."""
    workers(spark)
    net = bytenet.trained(docs, table(spark, sf_dir, "labels"))
    return bytenet.accepted(docs, net)


@stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: texts without the later copies of repeated runs of lines."""
    return lines.without_copies(docs)


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: one document of each group of near copies, five words and a similarity of 0.8."""
    workers(spark)
    return minhash.first_of_each(docs, minhash.Near(words=5, percent=80))


@stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents as often as the mix of their sources takes them."""
    return mixing.mixed(docs)


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: the documents' pieces with their places in sequences of 4096 tokens."""
    workers(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix", mix),
    ("pack", pack),
]

#: The stages fit models, iterate and tokenize, which SQL can't express; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents that the stages keep, as the last stage places them."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
