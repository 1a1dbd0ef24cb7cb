"""A pipeline from raw documents to token records, made of the operators of ``ledgerline.llm``.

Each stage takes all its predecessor kept, as a table reread from the shared
folder, so a lost executor costs at most the tasks of one stage. Documents that the
quality classifier rejects go; of each group of near copies one stays; contaminated
documents go; the mixture is sampled to tempered shares; the rest becomes token records.

Texts go to Python workers in batches of at most ``ARROW_ROWS`` rows, so that neither side of the
pipe holds many texts. Each stage sets the session so, if it has larger batches, and leaves it so:
a stage's result is computed after the stage returns.

Defined cases: a null or empty text is scored like any other; if it is kept it is near no
other document, is not contaminated, has no tokens to weigh and becomes a record of the end
id alone. Rows with one ``doc_id`` are rows of their own, and of a group of near copies, rows of one id and
text included, a single row stays. A null ``doc_id`` is an id like others. Texts of any length are
used whole. No documents give no rows. Columns beyond those of documents pass through all stages but
the last, whatever their names.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerline.llm.common import table  # noqa: E402
from ledgerline.llm.decontaminate import decontaminate  # noqa: E402
from ledgerline.llm.mixing import mix  # noqa: E402
from ledgerline.llm.ngram_join import keep_one_per_group  # noqa: E402
from ledgerline.llm.quality import keep_quality  # noqa: E402
from ledgerline.llm.token_records import digest, token_records, vocabulary_file  # noqa: E402
from ledgerline.session import store  # noqa: E402

ARROW_ROWS = 1000
_ARROW_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _bound_batches(spark: SparkSession) -> None:
    rows = int(spark.conf.get(_ARROW_SETTING))
    if rows <= 0 or rows > ARROW_ROWS:
        spark.conf.set(_ARROW_SETTING, str(ARROW_ROWS))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _bound_batches(spark)
    return keep_quality(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _bound_batches(spark)
    return keep_one_per_group(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _bound_batches(spark)
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _bound_batches(spark)
    return mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _bound_batches(spark)
    records, _, _ = token_records(docs, vocabulary_file())
    return digest(records)


STAGES = [("quality", quality), ("near_copies", near_copies), ("benchmark", benchmark), ("mixture", mixture), ("tokens", tokens)]

# Training a classifier and merging tokens are beyond SQL; the tests hold run() against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
