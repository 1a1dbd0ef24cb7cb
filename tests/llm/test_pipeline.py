"""Stages of the pipeline, each on what the one before kept, against plain Python where its result is not learned."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerline.llm import quality
from ledgerline.session import store

from test_ngram_join import brute_set  # noqa: E402
from test_text_operators import brute_contamination

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    tables = [spark.read.parquet(f"{DATA}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(store(stage(spark, tables[-1], DATA), f"test-{name}"))
    return [[r.asDict() for r in t.collect()] for t in tables], [t.columns for t in tables]


def test_columns_stay(stages):
    _, columns = stages
    assert all(c == columns[0] for c in columns[:-1])
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "benchmark", "mixture", "tokens"]


def test_stages_decide_as_their_operators(spark, stages):
    raw, good, single, clean, mixed, tokens = stages[0]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    kept = {d["doc_id"] for d in good}
    labelled = [d["doc_id"] for d in raw if d["doc_id"] in labels]
    assert np.mean([(i in kept) == (labels[i] == 1) for i in labelled]) > 0.9

    sets = {d["doc_id"]: brute_set(d["text"]) for d in good}
    ids, group = sorted(sets), {i: i for i in sets}
    for a in ids:
        for b in ids:
            if b < a and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {i: new if g == old else g for i, g in group.items()}
    assert sorted(d["doc_id"] for d in single) == sorted(i for i in ids if group[i] == i)

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    found = {d["doc_id"]: brute_contamination(d["text"], items) for d in single}
    assert sorted(d["doc_id"] for d in clean) == sorted(i for i, (n, hit, _) in found.items() if not (hit and 20 * hit >= n))

    assert {d["doc_id"] for d in mixed} <= {d["doc_id"] for d in clean} and len(mixed) > 0.4 * len(clean)
    assert sorted(t["doc_id"] for t in tokens) == sorted(d["doc_id"] for d in mixed)


def test_tokens_follow_each_other(stages):
    rows = sorted(stages[0][-1], key=lambda t: t["doc_id"])
    starts = np.concatenate(([0], np.cumsum([t["n_tokens"] for t in rows])))
    assert [t["start"] for t in rows] == starts[:-1].tolist()
    from ledgerline.llm.token_records import vocabulary_file
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary_file())
    texts = {d["doc_id"]: d["text"] for d in stages[0][0]}
    for t in rows[:40]:
        ids = np.array([*tokenizer.encode(texts[t["doc_id"]] or "", add_special_tokens=False).ids, 2], "<u4")
        assert t["ids_crc32"] == zlib.crc32(ids.tobytes())


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {f"op{n}_" for n in range(1, 14)} == {m for m in (name.split("_")[0] + "_" for name in names) if m.startswith("op")} and "pipeline" in names
    assert set(entry.oracle_sql()) <= names


def test_fold_is_the_remainder_of_crc32(spark):
    df = spark.createDataFrame([(7,), (None,)], "doc_id long").select(quality.fold(F.col("doc_id")).alias("f"), "doc_id")
    assert {r["doc_id"]: r["f"] for r in df.collect()} == {7: zlib.crc32(b"7") % 5, None: 0}


def test_stages_bound_batches_and_leave_smaller_ones(spark):
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    documents = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    try:
        for given, then in (("10000", "1000"), ("0", "1000"), ("50", "50")):
            spark.conf.set(setting, given)
            assert corpus_pipeline.benchmark(spark, documents, DATA).count() == 0
            assert spark.conf.get(setting) == then
    finally:
        spark.conf.set(setting, before)
