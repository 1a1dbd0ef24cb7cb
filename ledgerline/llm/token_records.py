"""Token-ID / binary output: length-delimited records with a separate offset index.

A file is a sequence of frames, one per document, in ascending ``doc_id`` order
over all files: byte length of the ids (8 bytes), masked checksum of that length
(4), the ids as little-endian unsigned integers of two bytes (four if the vocabulary
has 65,536 ids or more; lengths in the index tell which), masked checksum of the
ids (4). The checksum is CRC-32, rotated and shifted by a constant so that a checksum
of data which holds checksums stays useful. The index has a row per document (file, byte offset, length, number of tokens), so that a training job
can read records in any order; its order in a file needs no scan.

One range exchange orders the documents; each task then encodes its share and
writes one file, a batch at a time. A file is written under another name and
renamed when it is whole; a task that runs again writes the same bytes under the
same name. The places before each file come from one row per file.

Defined cases: a null text is empty (its record holds the end id alone); null
``doc_id`` comes first; rows with one ``doc_id`` are ordered by text hash and
length, each gets its own record, and many of them spread over several files; no
rows give no file and an empty result; texts of any length are encoded whole, into
one record; other columns are ignored.

The folder has to be one that pyarrow can open from every executor (a shared
mount, or a store that its file systems know).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import open_folder, ship_package, table
from ledgerline.llm.words import WordEncoder
from ledgerline.session import run_folder

MASK = 0xA282EAD8  # fixed value, added to the rotated checksum
HEAD, FOOT = struct.Struct("<QI"), struct.Struct("<I")
INDEX_SCHEMA = "file string, doc_id long, offset long, n_bytes long, n_tokens long, start_in_file long"


def masked(data: bytes) -> int:
    checksum = zlib.crc32(data)
    return ((checksum >> 15 | checksum << 17) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return length + FOOT.pack(masked(length)) + payload + FOOT.pack(masked(payload))


def unframe(data: bytes) -> bytes:
    """The ids of one frame; raises if a checksum does not hold."""
    length, check = HEAD.unpack_from(data)
    payload = data[HEAD.size : HEAD.size + length]
    if check != masked(data[:8]) or len(payload) != length or FOOT.unpack_from(data, HEAD.size + length)[0] != masked(payload):
        raise ValueError("damaged token record")
    return payload


def write_records(docs: DataFrame, folder: str, vocabulary: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the records below ``folder``/data and returns their index, itself stored.

    ``vocabulary`` is the content of a tokenizer file (a few MB whatever the data).
    """
    spark = docs.sparkSession
    ship_package(spark)
    files, root = open_folder(f"{folder}/data")
    files.create_dir(root, recursive=True)
    shared = spark.sparkContext.broadcast(vocabulary)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        files, root = open_folder(f"{folder}/data")
        name = f"part-{context.partitionId():06d}.tokens"
        # Another attempt of this task may be writing too.
        attempt = f"{root}/_{name}-{context.taskAttemptId()}"
        encoder, out, offset, start = WordEncoder.of(shared.value), None, 0, 0
        width = encoder.dtype.itemsize
        end = end_id.to_bytes(width, "little") if end_id is not None else b""
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                out = files.open_output_stream(attempt, buffer_size=1 << 20)
            rows = []
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), encoder.encode(batch["text"].to_pylist())):
                payload = ids + end
                data = frame(payload)
                out.write(data)
                rows.append((name, doc_id, offset, len(data), len(payload) // width, start))
                offset, start = offset + len(data), start + len(payload) // width
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, kind) for column, kind in zip(zip(*rows), [pa.string()] + [pa.int64()] * 5)],
                names=["file", "doc_id", "offset", "n_bytes", "n_tokens", "start_in_file"],
            )
        if out is not None:
            out.close()
            files.move(attempt, f"{root}/{name}")

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    ordered = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
        .withColumns({"h": F.xxhash64("text"), "n": F.length("text")})
        .repartitionByRange("doc_id", "h", "n")
        .sortWithinPartitions("doc_id", "h", "n")
        .select("doc_id", "text")
    )
    index = f"{folder}/index"
    ordered.mapInArrow(write, INDEX_SCHEMA).write.parquet(index)
    return spark.read.schema(INDEX_SCHEMA).parquet(index)


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (four bytes each) of every record, read from the files by their index.

    ``start`` counts the ids of all records before. Both checksums are tested.
    """

    ship_package(index.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = open_folder(f"{folder}/data")
        name, source = None, None
        for batch in batches:
            rows = batch.to_pylist()
            done, ids, size = 0, [], 0
            for k, row in enumerate(rows):
                if row["file"] != name:
                    if source is not None:
                        source.close()
                    name, source = row["file"], files.open_input_file(f"{root}/{row['file']}")
                source.seek(row["offset"])
                payload = unframe(source.read(row["n_bytes"]))
                if len(payload) == 2 * row["n_tokens"]:
                    payload = np.frombuffer(payload, "<u2").astype("<u4").tobytes()
                ids.append(payload)
                size += len(ids[-1])
                if size > 4 << 20 or k == len(rows) - 1:
                    part = batch.slice(done, len(ids))
                    yield pa.RecordBatch.from_arrays([part["doc_id"], part["start"], part["n_tokens"], pa.array(ids, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])
                    done, ids, size = k + 1, [], 0
        if source is not None:
            source.close()

    # One row per file: far fewer than documents.
    before = index.groupBy("file").agg(F.sum("n_tokens").alias("total"))
    before = before.select("file", (F.sum("total").over(Window.orderBy("file")) - F.col("total")).alias("before"))
    located = index.join(before, "file").withColumn("start", F.col("before") + F.col("start_in_file"))
    dealt = located.repartition("file").sortWithinPartitions("file", "offset")
    return dealt.select("file", "offset", "n_bytes", "doc_id", "start", "n_tokens").mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids binary"
    )


def token_records(docs: DataFrame, vocabulary_path: str, end_id: int | None = 2, folder: str | None = None) -> tuple[DataFrame, DataFrame, str]:
    """Writes and returns (records read back, index, folder)."""
    folder = folder or run_folder(docs.sparkSession, "token-records")
    with open(vocabulary_path, encoding="utf-8") as file:
        vocabulary = file.read()
    index = write_records(docs, folder, vocabulary, end_id)
    return read_records(index, folder), index, folder


def digest(records: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of records read back."""
    return records.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def vocabulary_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, _, _ = token_records(table(spark, sf_dir, "documents"), vocabulary_file())
    return digest(records)
