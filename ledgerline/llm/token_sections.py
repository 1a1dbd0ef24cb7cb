"""Token counts by section: tokens of whole documents attributed through their offsets.

Each text is encoded once, as a whole. Byte lengths of its tokens, added up, give
every token's span; the sections of a text (parts of it, such as lines, or fields
that were put together) are spans as well. A token inside one section counts
there. A token that crosses a boundary is allocated by a stated rule:

* ``majority`` (default): the section that has most of its bytes, the earlier on a tie,
* ``first`` / ``last``: the section of its first / last byte.

Sections must not overlap; bytes in no section belong to none, and a token all of
whose bytes are in no section is counted nowhere. The interval join is a search in
the sorted section ends, in the task that has the text: no shuffle, memory in
proportion to one text.

Defined cases: null and empty texts have no sections by line and so no rows; given
sections beyond the text are cut to it, empty ones count 0; repeated documents get
their rows each, and so do several documents with a null ``doc_id``, which stays null;
texts of any length are encoded whole; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import ship_package, table

RULES = ("majority", "first", "last")
RESULT = "doc_id long, section int, name string, start int, end int, n_tokens long, n_crossing long"
_LOADED: dict[str, tuple] = {}


def load_ranks(ranks: bytes, pattern: str) -> tuple:
    """The encoding of a rank file's content, and the byte length of each id; kept by each Python worker."""
    import tiktoken

    key = hashlib.sha256(ranks + pattern.encode()).hexdigest()
    if key not in _LOADED:
        pairs = (line.split() for line in ranks.splitlines() if line)
        mergeable = {base64.b64decode(token): int(rank) for token, rank in pairs}
        lengths = np.zeros(max(mergeable.values()) + 1, np.int64)
        for token, rank in mergeable.items():
            lengths[rank] = len(token)
        _LOADED[key] = tiktoken.Encoding("sections", pat_str=pattern, mergeable_ranks=mergeable, special_tokens={}), lengths
    return _LOADED[key]


def line_ends(raw: bytes) -> np.ndarray:
    """Ends of lines in bytes, each with its line break."""
    breaks = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
    return breaks if len(breaks) and breaks[-1] == len(raw) or not raw else np.append(breaks, len(raw))


def attribute(token_ends: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str = "majority") -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and those among them that reach beyond it. All places in bytes; sections in order."""
    n = len(starts)
    token_starts = np.concatenate(([0], token_ends[:-1])).astype(np.int64)
    # Sections are disjoint and in order: the first that ends after a token starts, the last that starts before it ends.
    first = np.searchsorted(ends, token_starts, side="right")
    last = np.searchsorted(starts, token_ends, side="left") - 1
    # Empty sections hold nothing.
    touching = (first <= last) & (first < n) & (token_ends > token_starts)
    owner = np.where(rule == "last", last, first)
    inside = touching & (first == last)
    inside &= (token_starts >= starts[np.minimum(first, n - 1)]) & (token_ends <= ends[np.maximum(last, 0)]) if n else inside
    if rule == "majority":
        for t in np.flatnonzero(touching & (first < last)):
            parts = range(first[t], last[t] + 1)
            owner[t] = max(parts, key=lambda s: (min(ends[s], token_ends[t]) - max(starts[s], token_starts[t]), -s))
    else:
        # The section of the first (last) byte; a byte outside all belongs to none.
        edge = token_starts if rule == "first" else token_ends - 1
        at = np.minimum(owner, n - 1) if n else owner
        if n:
            touching &= (starts[at] <= edge) & (edge < ends[at])
    counts = np.bincount(owner[touching], minlength=n)
    crossing = np.bincount(owner[touching & ~inside], minlength=n)
    return counts, crossing


def section_counts(docs: DataFrame, ranks: bytes, pattern: str, rule: str = "majority", sections_col: str | None = None) -> DataFrame:
    """A row for each document and section: its place (code points) and tokens.

    Sections are lines, or those of an array column of (name, start, end) in code
    points. ``ranks`` is the content of a rank file (about a MB whatever the data).
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(ranks)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, lengths = load_ranks(shared.value, pattern)
        for batch in batches:
            ids, out = batch["doc_id"], [[] for _ in range(7)]
            for k in range(batch.num_rows):
                text = batch["text"][k].as_py() or ""
                raw = text.encode("utf-8", "replace")
                # The byte where each character starts, and the end.
                places = None if len(raw) == len(text) else np.append(np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80), len(raw))
                if sections_col is None:
                    ends = line_ends(raw)
                    starts, names = np.concatenate(([0], ends[:-1])).astype(np.int64)[: len(ends)], [None] * len(ends)
                else:
                    given = sorted(batch["sections"][k].as_py() or [], key=lambda s: (s["start"], s["end"]))
                    names = [s["name"] for s in given]
                    starts, ends = (np.clip(np.array([s[c] for s in given], np.int64), 0, len(text)) for c in ("start", "end"))
                    starts, ends = (starts, ends) if places is None else (places[starts], places[ends])
                if not len(ends):
                    continue
                tokens = np.cumsum(lengths[encoding.encode_ordinary(text)]) if text else np.empty(0, np.int64)
                counts, crossing = attribute(tokens, starts, ends, rule)
                if places is not None:
                    starts, ends = np.searchsorted(places, starts), np.searchsorted(places, ends)
                doc_id, n = ids[k].as_py(), len(ends)
                for column, values in zip(out, ([doc_id] * n, range(n), names, starts.tolist(), ends.tolist(), counts.tolist(), crossing.tolist())):
                    column.extend(values)
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, kind) for column, kind in zip(out, kinds)], names=["doc_id", "section", "name", "start", "end", "n_tokens", "n_crossing"]
            )

    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    if sections_col is not None:
        columns.append(F.col(sections_col).cast("array<struct<name:string,start:int,end:int>>").alias("sections"))
    return docs.select(*columns).mapInArrow(count, RESULT)


def joined_fields(docs: DataFrame, fields: list[str], separator: str = "\n") -> DataFrame:
    """doc_id, the fields put together as ``text``, and their places as ``sections``; null fields are empty."""
    parts = F.array(*[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields])
    ends = F.transform(F.sequence(F.lit(1), F.lit(len(fields))), lambda k: F.length(F.array_join(F.slice(parts, 1, k), separator)))
    sections = F.transform(
        F.arrays_zip(F.array(*map(F.lit, fields)).alias("name"), parts.alias("part"), ends.alias("end")),
        lambda x: F.struct(x["name"].alias("name"), (x["end"] - F.length(x["part"])).cast("int").alias("start"), x["end"].cast("int").alias("end")),
    )
    return docs.select("doc_id", F.array_join(parts, separator).alias("text"), sections.alias("sections"))


def rank_file(name: str = "byte_bpe_50k.tiktoken") -> tuple[bytes, str]:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as file:
        return file.read(), public_tokenizers.PATTERN


def op9_token_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document."""
    ranks, pattern = rank_file()
    return section_counts(table(spark, sf_dir, "documents"), ranks, pattern).drop("name")
