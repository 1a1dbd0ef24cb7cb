"""N-gram Jaccard join as a blocked sparse product of the document by n-gram incidence.

Rows of the incidence matrix are classes of documents with one shingle set (exact
copies are one row), columns are shingles. Two classes link when
100 * overlap >= 80 * union. A link leaves at most ``size // 5`` shingles of a set
without partner, and that bound decides at every step what need not be multiplied:

1. Per document, in place: set size and hash of the set. From each set only the
   shingles of least hash go on (a quarter of all shingles, by a threshold on the
   hash, and never fewer than the bound plus one).
2. Columns: per shingle the number of documents and whether several classes have
   it. A class with more lonely shingles than its bound links with nothing and drops out.
3. The rest is ordered by (lonely first, rarer first, hash). Of two linked sets the
   first bound + 1 shingles in one order must have one in common (prefix filter),
   so only those columns remain. Very common shingles come last and drop out
   unless a document hardly has others.
4. Classes that share remaining columns, directly or in a chain, form a group. A
   group of more than ``BLOCK`` classes is looked at again by all shingles of its
   sets, which parts what met in common passages. Groups are cut into blocks of
   classes of like size; a block is multiplied with itself and with those of its
   group whose sizes the bound allows. A task makes overlap counts for column block
   after column block, drops pairs that the columns still to come cannot lift over
   the bound, and returns a spanning forest of the links it found, never the pairs.
5. Components of these forests; the least ``doc_id`` of each is its name.

The order uses the hash and document counts of hashed shingles (64 bits): any
function of the shingle gives right results, so collisions there cost time only.
Overlaps are counted on 64-bit hashes as well.

Memory: a task holds two blocks of texts' sets; everything else is rows. Group
size never meets one task: copies are one class, a common shingle is aggregated
before its shuffle, a large group is many blocks. Work in one group of n mutually
near but different texts is n * n / 2 counts, spread over tasks.

Defined cases: null, empty and blank texts have no shingles, size 0, and are
components of their own; fewer words than ``words_per_shingle`` make one shingle of all; repeated
documents get a row each, equal ``doc_id``s too (their component is that of the
least reachable ``doc_id``); a null ``doc_id`` takes part, its rows' component is
null only if no other ``doc_id`` is reachable; equal sets (ties) are linked; texts of any
length are cut into shingles whole; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import ship_package, table
from ledgerline.llm.components import connected_components
from ledgerline.session import store

WORDS_PER_SHINGLE = 5
PERCENT = 80
SAMPLED = 1 << 62  # shingles with a hash below, as unsigned: a quarter of all
BLOCK = 512  # classes in a block, about
COLUMN_BLOCK = 4096  # shingles multiplied at once
FILTER_BITS = 1 << 24  # of the set of candidates' ids that every task gets, 2 MB whatever the data
MAX_CACHED_WORDS = 200_000  # hashes of words a task keeps
SLICE = 1000  # documents whose shingles a task holds at once

_MIX = np.uint64(0x9E3779B97F4A7C15)  # fixed value, an odd multiplier
_WORDS: dict[bytes, int] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, size: int = WORDS_PER_SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return np.empty(0, np.uint64)
    try:
        values = np.array([_WORDS[word] for word in words], np.uint64)
    except KeyError:
        if len(_WORDS) > MAX_CACHED_WORDS:
            _WORDS.clear()
        for word in words:
            if word not in _WORDS:
                _WORDS[word] = xxhash.xxh3_64_intdigest(word)
        values = np.array([_WORDS[word] for word in words], np.uint64)
    n = len(values)
    width = min(size, n)
    total = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        total = (total + values[k : n - width + 1 + k]) * _MIX
        total ^= total >> np.uint64(29)
    return np.unique(_mixed(total))


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def allowed_misses(size, percent: int = PERCENT):
    """Shingles of a set of this size that a linked set can lack."""
    return size - -(-size * percent // 100)


def _first_shingles(shingles: np.ndarray, percent: int) -> np.ndarray:
    """The sampled shingles of a set, or the bound plus one if those are fewer."""
    return shingles[: max(int(np.searchsorted(shingles, np.uint64(SAMPLED))), allowed_misses(len(shingles), percent) + 1)]


def _set_key(shingles: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(shingles.tobytes()) if len(shingles) else 0


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in small parts; what was kept for a task goes with it."""
    try:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                yield batch.slice(start, SLICE)
    finally:
        _WORDS.clear()


def _describe(width: int):
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            sets = [shingle_set(text.as_py(), width) for text in batch["text"]]
            keys = _signed(np.array([_set_key(x) for x in sets], np.uint64))
            sizes = np.array([len(x) for x in sets], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["hash"], pa.array(sizes), pa.array(keys)], names=["doc_id", "hash", "n_shingles", "key"]
            )

    return describe


def _columns(percent: int, width: int):
    """(gram, key, n) of the first shingles, with the copies and common shingles of a batch put together."""

    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            sets = [x for x in (shingle_set(text.as_py(), width) for text in batch["text"]) if len(x)]
            if not sets:
                continue
            firsts = [_signed(_first_shingles(x, percent)) for x in sets]
            keys = np.repeat(_signed(np.array([_set_key(x) for x in sets], np.uint64)), [len(x) for x in firsts])
            grams = np.concatenate(firsts)
            order = np.lexsort((keys, grams))
            grams, keys = grams[order], keys[order]
            starts = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
            ends = np.concatenate((starts[1:], [len(grams)]))
            first, last = keys[starts], keys[ends - 1]
            more = first != last
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate((grams[starts], grams[starts][more]))),
                    pa.array(np.concatenate((first, last[more]))),
                    pa.array(np.concatenate((ends - starts, np.zeros(more.sum(), np.int64))).astype(np.int32)),
                ],
                names=["gram", "key", "n"],
            )

    return columns


def _pick(bits: bytes, percent: int, width: int):
    """Rows whose id may be a candidate's, with the key of their set."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(bits.value, np.uint64)
        for batch in _slices(batches):
            slot = batch["slot"].to_numpy()
            hit = (known[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1)
            batch = batch.filter(pa.array(hit.astype(bool)))
            keys = [_set_key(shingle_set(text.as_py(), width)) for text in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["at"], pa.array(_signed(np.array(keys, np.uint64))), batch["text"]], names=["at", "key", "text"])

    return pick


def _candidate_grams(percent: int, width: int, whole: bool):
    """(gram, key, spare) of the first shingles of each set, or of all."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            sets = [shingle_set(text.as_py(), width) for text in batch["text"]]
            firsts = [_signed(x if whole else _first_shingles(x, percent)) for x in sets]
            counts = [len(x) for x in firsts]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(firsts) if firsts else np.empty(0, np.int64)),
                    pa.array(np.repeat(batch["key"].to_numpy(), counts)),
                    pa.array(np.repeat(batch["spare"].to_numpy(), counts)),
                ],
                names=["gram", "key", "spare"],
            )

    return grams


def links_of_blocks(rows: list[np.ndarray], others: list[np.ndarray], percent: int = PERCENT, column_block: int = COLUMN_BLOCK) -> np.ndarray:
    """Boolean matrix of the links of some sets with others: the product of their incidence matrices."""
    n, m = len(rows), len(others)
    a, b = (np.array([len(x) for x in sets], np.int64) for sets in (rows, others))
    # 100 * o >= p * (a + b - o)
    needed = -(-percent * (a[:, None] + b[None, :]) // (100 + percent))
    possible = needed <= np.minimum(a[:, None], b[None, :])
    _, columns = np.unique(np.concatenate(rows + others), return_inverse=True)
    at, split = np.repeat(np.arange(n + m), np.concatenate((a, b))), int(a.sum())
    # Columns that both sides have, numbered anew.
    both = np.zeros(columns.max() + 1, bool)
    both[columns[:split]] = True
    there = np.zeros_like(both)
    there[columns[split:]] = True
    both &= there
    number = np.cumsum(both) - 1
    kept = both[columns]
    at, columns = at[kept], number[columns[kept]]
    order = np.argsort(columns, kind="stable")
    at, columns, width = at[order], columns[order], int(both.sum())
    left = np.bincount(at, minlength=n + m).astype(np.int64)  # shared columns still to come
    overlap = np.zeros((n, m), np.float32)
    for start in range(0, width, column_block):
        alive, met = np.flatnonzero(possible.any(axis=1)), np.flatnonzero(possible.any(axis=0))
        if not len(alive):
            break
        first, end = np.searchsorted(columns, [start, start + column_block])
        part = np.zeros((n + m, min(column_block, width - start)), np.float32)
        part[at[first:end], columns[first:end] - start] = 1
        overlap[np.ix_(alive, met)] += part[alive] @ part[n + met].T
        left -= np.bincount(at[first:end], minlength=n + m)
        possible &= overlap + np.minimum(left[:n, None], left[None, n:]) >= needed
    return possible & (overlap >= needed)


def forest_of(links: np.ndarray) -> np.ndarray:
    """For each row, then each column, the least of all (rows first) that it reaches."""
    n, m = links.shape
    root = np.arange(n + m)
    while True:
        new = root.copy()
        if n and m:
            new[:n] = np.minimum(root[:n], np.where(links, root[None, n:], n + m).min(axis=1))
            new[n:] = np.minimum(root[n:], np.where(links, root[:n, None], n + m).min(axis=0))
        new = np.minimum(new, new[new])
        if (new == root).all():
            return root
        root = new


def _multiply(percent: int, width: int):
    """Streams groups of rows with one (group, i, j) and yields (a, b) of their spanning forests."""

    def forest(i: int, j: int, members: dict[tuple[int, int], str]) -> tuple[np.ndarray, np.ndarray]:
        sides: tuple[list, list] = ([], [])
        for (part, key), text in sorted(members.items()):
            sides[part == j and i != j].append((key, shingle_set(text, width)))
        rows, others = sides[0], sides[1] if i != j else sides[0]
        if not rows or not others:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        root = forest_of(links_of_blocks([x for _, x in rows], [x for _, x in others], percent))
        keys = np.array([key for key, _ in rows + others], np.int64)
        at = np.flatnonzero(keys[root] != keys)
        return keys[at], keys[root[at]]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, members = None, {}
        for batch in _slices(batches):
            found = []
            for group, i, j, part, key, text in zip(*(batch[c].to_pylist() for c in ("group", "i", "j", "part", "key", "text"))):
                if (group, i, j) != current:
                    if len(members) > 1:
                        found.append(forest(*current[1:], members))
                    current, members = (group, i, j), {}
                members[part, key] = text
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], names=["a", "b"])
        if len(members) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in forest(*current[1:], members)], names=["a", "b"])

    return multiply


def no_id():
    """Stands for a null id in joins."""
    return F.lit(-(1 << 63) + 1)


def _id_filter(ids: DataFrame) -> tuple[bytes, Column]:
    """A bit set of hashes of the column ``at``: FILTER_BITS in all, so a few MB at most."""
    slot = F.pmod(F.xxhash64("at"), F.lit(FILTER_BITS))
    words = ids.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits"))
    out = np.zeros(FILTER_BITS // 64, np.int64)
    for word, bits in words.collect():
        out[word] = bits
    return out.tobytes(), slot


def candidates(docs: DataFrame, described: DataFrame, percent: int = PERCENT, width: int = WORDS_PER_SHINGLE) -> DataFrame:
    """(key, n_shingles, spare, text) of each class that can link with another; steps 2 and 3, first half.

    ``spare`` is how many shared shingles a partner may lack, plus one. Also (gram, n) of shared columns.
    """
    filled = described.filter("n_shingles > 0")
    columns = (
        docs.select("text").mapInArrow(_columns(percent, width), "gram long, key long, n int")
        .groupBy("gram").agg(F.min("key").alias("first"), F.max("key").alias("last"), F.sum("n").alias("n"))
    )
    # One job for both, with all columns in both (n is never 0), so that their exchange is made once and read twice.
    # A condition on the shingle would be moved below the aggregation and part the two, hence the sum.
    lonely = columns.filter((F.col("first") == F.col("last")) & (F.col("n") > 0))
    sampled = F.when(F.col("gram").between(0, SAMPLED - 1), 1).otherwise(0)
    lonely = lonely.groupBy(F.col("first").alias("id")).agg(F.sum(sampled).alias("n"))
    shared = columns.filter("first <> last").select(F.col("gram").alias("id"), "n")
    both = store(
        lonely.withColumn("kind", F.lit("lonely")).unionByName(shared.withColumn("kind", F.lit("shared"))), "ngram-columns", "kind"
    )
    lonely = both.filter("kind = 'lonely'").select(F.col("id").alias("key"), F.col("n").alias("lonely"))
    shared = both.filter("kind = 'shared'").select(F.col("id").alias("gram"), "n")

    misses = F.expr(f"n_shingles - (n_shingles * {percent} + 99) div 100")
    classes = filled.groupBy("key", "n_shingles").agg(F.min(F.coalesce("doc_id", no_id())).alias("at"))
    spare = (misses - F.coalesce("lonely", F.lit(0)) + 1).cast("long")
    classes = store(classes.join(lonely, "key", "left").select("key", "n_shingles", "at", spare.alias("spare")).filter("spare > 0"), "ngram-classes")
    bits, slot = _id_filter(classes)
    shared_bits = docs.sparkSession.sparkContext.broadcast(bits)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), no_id()).alias("at"), "text").withColumn("slot", slot)
    picked = rows.mapInArrow(_pick(shared_bits, percent, width), "at long, key long, text string")
    return store(picked.join(classes, ["at", "key"]), "ngram-candidates"), shared


def candidate_groups(
    texts: DataFrame, shared: DataFrame, percent: int = PERCENT, width: int = WORDS_PER_SHINGLE, whole: bool = False
) -> DataFrame:
    """(id, component): classes that share a column of their prefixes, directly or in a chain.

    ``whole`` takes prefixes of whole sets, else of their first shingles.
    """
    grams = texts.select("key", "spare", "text").mapInArrow(_candidate_grams(percent, width, whole), "gram long, key long, spare long")
    met = grams.join(shared, "gram").dropDuplicates(["key", "gram"])
    # A set's shingles at most meet in one window.
    place = F.row_number().over(Window.partitionBy("key").orderBy("n", "gram"))
    kept = store(met.withColumn("place", place).filter("place <= spare").select("gram", "key"), "ngram-prefixes")
    # Stored, so that a column of very many classes can be split in the join.
    least = store(kept.groupBy("gram").agg(F.min("key").alias("least")), "ngram-least")
    edges = kept.join(least, "gram").filter("key <> least").select(F.col("key").alias("a"), F.col("least").alias("b"))
    return connected_components(edges, "ngram-groups")


def refined(
    texts: DataFrame, groups: DataFrame, block: int = BLOCK, percent: int = PERCENT, width: int = WORDS_PER_SHINGLE
) -> DataFrame:
    """Candidates with their groups; groups of more than a block are looked at again, by all shingles of their sets.

    Partners of a class are in its group, so a shingle that no other class of a
    large group has is lonely. Counting them all (not the sampled ones alone) drops
    classes, lowers ``spare``, and parts groups that met in common passages.
    """
    # Stored, so that a component of very many classes can be split in the join.
    sizes = store(groups.groupBy("component").agg(F.count("*").alias("n")).withColumn("large", F.col("n") > block), "ngram-sizes")
    placed = store(groups.join(sizes, "component").select(F.col("id").alias("key"), "component", "large"), "ngram-placed")
    # A class can be there twice, if its row is.
    known = texts.dropDuplicates(["key"]).join(placed, "key")
    known = store(known.select("key", "n_shingles", "spare", "text", "component", "large"), "ngram-members")
    small = known.filter("not large")
    large = known.filter("large")
    grams = large.select("key", "spare", "text").mapInArrow(_candidate_grams(percent, width, True), "gram long, key long, spare long")
    columns = grams.groupBy("gram").agg(F.min("key").alias("first"), F.max("key").alias("last"), F.count("*").alias("n"))
    lonely = columns.filter((F.col("first") == F.col("last")) & (F.col("n") > 0)).groupBy(F.col("first").alias("id")).agg(F.count("*").alias("n"))
    shared = columns.filter("first <> last").select(F.col("gram").alias("id"), "n")
    both = store(lonely.withColumn("kind", F.lit("lonely")).unionByName(shared.withColumn("kind", F.lit("shared"))), "ngram-inner-columns", "kind")
    lonely = both.filter("kind = 'lonely'").select(F.col("id").alias("key"), F.col("n").alias("lonely"))
    shared = both.filter("kind = 'shared'").select(F.col("id").alias("gram"), "n")
    spare = (F.expr(f"n_shingles - (n_shingles * {percent} + 99) div 100") - F.coalesce("lonely", F.lit(0)) + 1).cast("long")
    left = large.drop("spare", "component", "large").join(lonely, "key", "left")
    left = store(left.select("key", "n_shingles", spare.alias("spare"), "text").filter("spare > 0"), "ngram-large")
    again = candidate_groups(left, shared, percent, width, True).select(F.col("id").alias("key"), "component")
    columns_ = ["key", "n_shingles", "spare", "text", F.col("component").alias("group")]
    return small.select(*columns_).unionByName(left.join(again, "key").select(*columns_))


def blocks(members: DataFrame, block: int = BLOCK, percent: int = PERCENT) -> DataFrame:
    """(group, i, j, part, key, text): the rows of each pair of blocks to multiply.

    A block holds classes of like size and like greatest size of a partner: of x,
    overlaps reach ``most`` = size less lonely shingles, hence partners
    ``most`` * (100 + percent) / percent - size.
    """
    most = f"((n_shingles * {percent} + 99) div 100 + spare - 1)"
    reach = F.expr(f"{most} * {100 + percent} div {percent} - n_shingles")

    def step(size) -> Column:
        # Linked sizes differ by a factor of 100 / percent at most, so by one of these steps.
        return F.floor(F.log(F.greatest(size, F.lit(1)).cast("double")) / F.log(F.lit(100 / percent * 1.0001))).cast("int")

    sized = members.select("group", "key", step(F.col("n_shingles")).alias("own"), step(reach).alias("reach"))
    kind = ["group", "own", "reach"]
    counts = sized.groupBy(*kind).agg(F.count("*").alias("n"))
    totals = counts.groupBy("group").agg(F.sum("n").alias("total"))
    parts = F.when(F.col("total") <= block, 0).otherwise(F.ceil(F.col("n") / block)).cast("int")
    plan = store(counts.join(totals, "group").filter("total > 1").select(*kind, parts.alias("parts")), "ngram-plan")
    placed = sized.join(plan, kind)
    whole = F.col("parts") == 0
    part = F.when(whole, -1).otherwise(F.pmod(F.xxhash64("key"), F.greatest("parts", F.lit(1))).cast("int"))
    # own, reach and part in one number.
    place = F.when(whole, F.lit(-1).cast("long")).otherwise((F.col("own").cast("long") * 4096 + F.col("reach")) * (1 << 32) + part)
    placed = store(placed.select("group", "key", place.alias("part")), "ngram-blocks")
    each = store(placed.select("group", "part").distinct(), "ngram-block-names")
    own, reach_of = (lambda c: F.shiftright(c, 44)), (lambda c: F.shiftright(c, 32).bitwiseAND(4095))
    meets = (F.abs(own("i") - own("j")) <= 1) & (own("i") <= reach_of("j")) & (own("j") <= reach_of("i")) | (F.col("i") < 0)
    pairs = each.withColumnRenamed("part", "i").join(each.withColumnRenamed("part", "j"), "group").filter((F.col("i") <= F.col("j")) & meets)
    pairs = store(pairs, "ngram-block-pairs")
    left = placed.join(pairs.withColumn("part", F.col("i")), ["group", "part"])
    right = placed.join(pairs.filter("i < j").withColumn("part", F.col("j")), ["group", "part"])
    tasks = left.unionByName(right).select("group", "i", "j", "part", "key")
    dealt = tasks.join(members.select("key", "text"), "key").repartition("group", "i", "j").sortWithinPartitions("group", "i", "j")
    return dealt.select("group", "i", "j", "part", "key", "text")


def class_components(docs: DataFrame, described: DataFrame, percent: int = PERCENT, width: int = WORDS_PER_SHINGLE, block: int = BLOCK) -> DataFrame:
    """(id, component) of the classes that link with another."""
    texts, shared = candidates(docs, described, percent, width)
    groups = candidate_groups(texts, shared, percent, width)
    dealt = blocks(refined(texts, groups, block, percent, width), block, percent)
    return connected_components(dealt.mapInArrow(_multiply(percent, width), "a long, b long"), "ngram-components")


def describe(docs: DataFrame, width: int = WORDS_PER_SHINGLE) -> DataFrame:
    """doc_id, hash of the text, n_shingles and key of the shingle set for each row, stored."""
    ship_package(docs.sparkSession)
    rows = docs.select("doc_id", F.xxhash64("text").alias("hash"), "text")
    return store(rows.mapInArrow(_describe(width), "doc_id long, hash long, n_shingles long, key long"), "ngram-sets")


def jaccard_components(docs: DataFrame, percent: int = PERCENT, width: int = WORDS_PER_SHINGLE, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    described = describe(docs, width)
    linked = class_components(docs, described, percent, width, block)
    # By class first, so that many copies are few rows; nulls are not least.
    least = described.filter("n_shingles > 0").groupBy("key").agg(F.min("doc_id").alias("least"))
    named = least.join(linked, least["key"] == linked["id"], "left").select("key", "least", F.coalesce("component", "key").alias("component"))
    named = store(named, "ngram-named")
    names = store(named.groupBy("component").agg(F.min("least").alias("component_id")), "ngram-names")
    by_class = store(named.join(names, "component").select("key", "component_id"), "ngram-classes")
    joined = described.join(by_class, "key", "left")
    return joined.select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one_per_group(docs: DataFrame, percent: int = PERCENT, width: int = WORDS_PER_SHINGLE, block: int = BLOCK) -> DataFrame:
    """``docs`` with one row of each component, of the least (``doc_id``, text hash), nulls last.

    Rows without shingles all stay, repeated ones too.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    described = describe(texts, width)
    linked = class_components(texts, described, percent, width, block)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "hash")).alias("first")
    by_class = described.filter("n_shingles > 0").groupBy("key").agg(first)
    group = F.coalesce("component", "key").alias("component")
    by_group = by_class.join(linked, by_class["key"] == linked["id"], "left").groupBy(group).agg(F.min("first").alias("first"))
    empty = described.filter("n_shingles = 0").select("doc_id", "hash", F.lit(True).alias("all")).distinct()
    kept = by_group.select("first.doc_id", "first.hash", F.lit(False).alias("all")).unionByName(empty)
    kept = kept.select(F.coalesce("doc_id", no_id()).alias("__id"), F.col("hash").alias("__hash"), F.col("all").alias("__all"))
    keyed = docs.withColumns({"__id": F.coalesce(F.col("doc_id").cast("long"), no_id()), "__hash": F.xxhash64("text")})
    joined = keyed.join(kept, ["__id", "__hash"])
    turn = F.row_number().over(Window.partitionBy("__id", "__hash").orderBy("__id"))
    return joined.withColumn("__turn", turn).filter("__all or __turn = 1").select(*[joined[c] for c in docs.columns])


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH RECURSIVE doc AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x20\x09-\x0D]+') AS w
    FROM documents
), shingle AS (
    SELECT DISTINCT doc_id, array_to_string(w[s:s + k - 1], ' ') AS g
    FROM (SELECT doc_id, w, least(5, len(w)) AS k, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS s FROM doc WHERE len(w) > 0)
), size AS (
    SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
), overlap AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM shingle x JOIN shingle y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL
), link AS (
    SELECT a, b FROM overlap JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)
), reach(id, other) AS (
    SELECT doc_id, doc_id FROM size UNION SELECT id, b FROM reach JOIN link ON a = other
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(least_id, doc_id) AS component_id
FROM documents LEFT JOIN size USING (doc_id) LEFT JOIN (SELECT id AS doc_id, min(other) AS least_id FROM reach GROUP BY id) USING (doc_id)
"""
