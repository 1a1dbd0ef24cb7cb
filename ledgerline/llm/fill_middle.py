"""Fill-in-middle transformation by secondary-sort assembly.

A text is cut into units (runs of ASCII letters, or one other character). Two
hashed places split it into prefix, middle and suffix, and the output puts the
middle last, each part behind its marker: ``<P>``prefix``<S>``suffix``<M>``middle
(psm), ``<S>``suffix``<P>``prefix``<M>``middle (spm), or the text as it is (plain).

A map step emits pieces of at most ``CHUNK_UNITS`` units, keyed by document and
output position. One exchange by document, sorted by (document, position) inside
each partition, lets a task stream the pieces past a running digest of the output.
The task cuts the output stream at its markers, knowing only the form, and gives
every stretch its place in the text. For restoration the same partitions are
sorted again by that place (an external sort of Spark, no second exchange), and
the stretches stream past a second digest. Nothing holds more than a batch of
pieces, and a lost executor costs its partitions of one exchange.

Documents are keyed by id and a 128-bit hash of the text, so neither order nor
partition of the input matters. Rows equal in both are counted in the map step and
go through as one document: rows repeated many times cost one row per batch.

Defined cases: a null text is empty; a null ``doc_id`` is hashed as ``1:`` followed
by nothing; an empty text and one that holds a marker are plain; rows with one id
and different texts are documents of their own; each repeated row has its row in
the result; no rows give no rows; other columns are ignored. There are no ties.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import ship_package, table

CHUNK_UNITS = 16_384
PLAIN_FROM, SPM_BELOW = 90, 20  # per cent of the third and the fourth hash
MARKERS = {"prefix": "<P>", "suffix": "<S>", "middle": "<M>"}
ORDERS = {"psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle"), "plain": ()}
PLACES = {"prefix": 0, "middle": 1, "suffix": 2}
LAST = 3  # place of the row that closes a document
ROWS = 2_000  # rows of a batch that leaves a task, and BYTES of its texts, at most
BYTES = 4 << 20

PIECES = "doc_id long, key binary, position int, n long, form string, copies long, piece string"
STRETCHES = (
    "doc_id long, key binary, place int, turn int, stretch string, n long, form string, copies long, "
    "prefix_chars long, middle_chars long, output_sha256 string"
)
DIGESTS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string, copies long"


def unit_starts(text: str) -> np.ndarray:
    """Places (code points) where units start."""
    code = np.frombuffer(text.encode("utf-32-le"), "<u4")
    letter = ((code | 32) - 97 < 26) & (code < 128)  # unsigned: what is below 97 wraps around
    start = ~letter
    start[1:] |= ~letter[:-1]
    start[:1] = True
    return np.flatnonzero(start)


def draws(doc_id: int | None) -> tuple[int, int, int, int]:
    """The four hashed numbers of a document."""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12))


def cut(doc_id: int | None, text: str, chunk_units: int = CHUNK_UNITS) -> tuple[int, str, list[str]]:
    """Number of units, form, and the pieces of the output in order."""
    starts = unit_starts(text)
    n = len(starts)
    h1, h2, h3, h4 = draws(doc_id)
    form = "spm" if h4 % 100 < SPM_BELOW else "psm"
    if not text or h3 % 100 >= PLAIN_FROM or any(marker in text for marker in MARKERS.values()):
        form = "plain"

    def chunks(low: int, high: int) -> list[str]:
        edges = [*(int(starts[u]) for u in range(low, high, chunk_units)), int(starts[high]) if high < n else len(text)]
        return [text[a:b] for a, b in zip(edges, edges[1:])] or [""]

    if form == "plain":
        return n, form, chunks(0, n)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    units = {"prefix": (0, low), "middle": (low, high), "suffix": (high, n)}
    pieces = []
    for part in ORDERS[form]:
        first, *rest = chunks(*units[part])
        pieces += [MARKERS[part] + first, *rest]
    return n, form, pieces


class Cutter:
    """Cuts a streamed output of a known form into stretches of its parts, wherever its pieces end."""

    def __init__(self, form: str) -> None:
        self.order = iter(ORDERS[form])
        self.part, self.next = ("prefix", None) if form == "plain" else (None, next(self.order))
        self.tail = ""
        self.chars = dict.fromkeys(PLACES, 0)
        self.turns = dict.fromkeys(PLACES, 0)

    def _stretch(self, text: str) -> Iterator[tuple[int, int, str]]:
        if text:
            if self.part is None:
                raise ValueError("an output does not start with its marker")
            self.turns[self.part] += 1
            self.chars[self.part] += len(text)
            yield PLACES[self.part], self.turns[self.part], text

    def feed(self, piece: str) -> Iterator[tuple[int, int, str]]:
        """(place, turn, text) of the stretches that are certain."""
        text = self.tail + piece
        while self.next is not None and (at := text.find(MARKERS[self.next])) >= 0:
            yield from self._stretch(text[:at])
            text = text[at + len(MARKERS[self.next]) :]
            self.part, self.next = self.next, next(self.order, None)
        keep = min(2, len(text)) if self.next is not None else 0  # a marker may go on in the next piece
        text, self.tail = text[: len(text) - keep], text[len(text) - keep :]
        yield from self._stretch(text)

    def close(self) -> Iterator[tuple[int, int, str]]:
        if self.next is not None:
            raise ValueError("an output lacks a marker")
        yield from self._stretch(self.tail)


def _batches(rows: Iterator[tuple], schema: pa.Schema, text_at: int | None) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded size."""
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*held), schema.types)], schema=schema)

    for row in rows:
        held.append(row)
        size += len(row[text_at] or "") if text_at is not None else 0
        if len(held) >= ROWS or size >= BYTES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split() for field in ddl.split(", "))])


def _tuples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


def output_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_units: int = CHUNK_UNITS) -> DataFrame:
    """The outputs as pieces: all of a document in one partition, in order of ``position``."""
    ship_package(docs.sparkSession)
    schema = _arrow(PIECES)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                copies: dict[tuple, int] = {}
                found = []
                for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                    key = hashlib.blake2b((text or "").encode(), digest_size=16).digest()
                    copies[doc_id, key] = copies.get((doc_id, key), 0) + 1
                    if copies[doc_id, key] == 1:
                        found.append((doc_id, key, text or ""))
                for doc_id, key, text in found:
                    n, form, pieces = cut(doc_id, text, chunk_units)
                    for position, piece in enumerate(pieces):
                        yield doc_id, key, position, n, form, copies[doc_id, key], piece

        return _batches(rows(), schema, 6)

    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    dealt = named.mapInArrow(emit, PIECES).repartition("doc_id", "key")
    return dealt.sortWithinPartitions("doc_id", "key", "position")


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int, Iterator[str]]]:
    """First row, copies (a list that is right once the pieces are read), and pieces of each document of sorted batches."""
    rows = _tuples(batches)
    row = next(rows, None)
    while row is not None:
        first, copies = row, [0]

        def pieces() -> Iterator[str]:
            nonlocal row
            done = -1
            while row is not None and row[:2] == first[:2]:
                if row[2] == 0:
                    copies[0] += row[5]
                if row[2] > done:  # the same piece of an equal row says nothing new
                    done = row[2]
                    yield row[6]
                row = next(rows, None)

        yield first, copies, pieces()


def restored_stretches(pieces: DataFrame) -> DataFrame:
    """Stretches of the texts in order of (place, turn), found in the streamed outputs; the last row of a document sums it up."""
    schema = _arrow(STRETCHES)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for (doc_id, key, _, n, form, _, _), copies, parts in _documents(batches):
                digest, cutter = hashlib.sha256(), Cutter(form)
                for piece in parts:
                    digest.update(piece.encode())
                    for place, turn, text in cutter.feed(piece):
                        yield doc_id, key, place, turn, text, None, None, None, None, None, None
                for place, turn, text in cutter.close():
                    yield doc_id, key, place, turn, text, None, None, None, None, None, None
                chars = (None, None) if form == "plain" else (cutter.chars["prefix"], cutter.chars["middle"])
                yield doc_id, key, LAST, 0, None, n, form, copies[0], *chars, digest.hexdigest()

        return _batches(rows(), schema, 4)

    return pieces.mapInArrow(stream, STRETCHES).sortWithinPartitions("doc_id", "key", "place", "turn")


def digests(stretches: DataFrame) -> DataFrame:
    """One row per document, with the hash of its restored text and the number of its ``copies``."""
    schema = _arrow(DIGESTS)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            digest = hashlib.sha256()
            for doc_id, _, place, _, text, n, form, copies, prefix, middle, output in _tuples(batches):
                if place != LAST:
                    digest.update(text.encode())
                    continue
                yield doc_id, n, form, prefix, middle, output, digest.hexdigest(), copies
                digest = hashlib.sha256()

        return _batches(rows(), schema, None)

    return stretches.mapInArrow(stream, DIGESTS)


def repeated(rows: DataFrame) -> DataFrame:
    """Each row as often as its ``copies`` says, a batch at a time."""
    kept = [c for c in rows.columns if c != "copies"]

    def repeat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            times = batch["copies"].to_numpy()
            batch = batch.select(kept)
            while len(times):
                at = int(np.searchsorted(np.cumsum(times), ROWS))
                yield batch.take(np.repeat(np.arange(at), times[:at]))
                batch, times = batch.slice(at), times[at:].copy()
                if len(times):  # this row does not fit any more; a large count goes in several batches
                    part = min(int(times[0]), ROWS)
                    yield batch.take(np.zeros(part, np.int64))
                    times[0] -= part

    return rows.mapInArrow(repeat, rows.select(*kept).schema)


def outputs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, form, output: the assembled training texts, one row per row of ``docs``."""
    schema = pa.schema([("doc_id", pa.int64()), ("form", pa.string()), ("output", pa.string()), ("copies", pa.int64())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for first, copies, parts in _documents(batches):
                text = "".join(parts)
                yield first[0], first[4], text, copies[0]

        return _batches(rows(), schema, 2)

    pieces = output_pieces(docs, id_col, text_col)
    return repeated(pieces.mapInArrow(join, "doc_id long, form string, output string, copies long"))


def fill_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_units: int = CHUNK_UNITS) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of every row."""
    return repeated(digests(restored_stretches(output_pieces(docs, id_col, text_col, chunk_units))))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle(table(spark, sf_dir, "documents"))
