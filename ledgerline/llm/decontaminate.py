"""Benchmark decontamination with a generalised suffix automaton over test items.

Words are runs of digits, letters a-z (A-Z lowered) and characters beyond ASCII.
A window is ``window`` consecutive words of an item; an item with fewer words is
one window as a whole. The automaton accepts every word sequence that occurs in
some item. A task streams the words of each text through it and keeps the length
of the longest match that ends at each word; where it reaches a window's length
the words of that window are hit, and the state names the items.

Most stretches of a text never come near a window. As every occurrence of a
window covers one whole block of ``(shortest + 1) // 2`` words at a multiple of
that number, only stretches around blocks which the automaton accepts are
streamed; that loses nothing.

Texts stay where they are: no shuffle. Items are dealt by hash to automata of about
``WORDS_PER_AUTOMATON`` words. A longer item is cut into pieces that overlap by a window
less one word, so that every window lies in one of them. With a single automaton, the usual case,
its items are broadcast and its pass gives the result. Otherwise there is one
pass over the texts for each: its items are broadcast, what it hits is stored in
the shared folder, and the broadcast is given up before the next one begins, so
the driver and every worker hold one automaton's items at a time. The hit
stretches are merged by text hash.

Defined cases: null and wordless texts have no words and no hits; wordless items
have no window; a null ``item_id`` is written as the empty string; repeated
items count once by ``item_id``, also where their rows are in different automata, and
all items of a window count alike; repeated documents get a row each; without
items nothing is hit; a long text costs memory in proportion to itself; other
columns pass through untouched where rows are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from fractions import Fraction
from itertools import chain

import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import ascii_lower, ship_package, table
from ledgerline.session import store

WINDOW = 13
WORDS_PER_AUTOMATON = 100_000  # some 60 MB in a Python worker
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_WORD_BYTES = re.compile(rb"[0-9a-z\x80-\xff]+")
# A-Z lowered, anything that is part of no word made a space.
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_BUILT: dict[object, ItemAutomaton] = {}

RESULT = (
    "n_words long, n_hit long, items array<string>, first_word array<int>, last_word array<int>, "
    "first_byte array<int>, end_byte array<int>"
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_NORMAL).split()


class ItemAutomaton:
    """Suffix automaton of several word sequences."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        items = [(name, words) for name, words in items if words]
        for _, words in items:
            state = 0
            for word in words:
                state = self._extend(state, word)
        # Items by state, for states that hold sequences of a window's length or more.
        self.items: list[set[str]] = [set() for _ in self.link]
        # (length, item) of items shorter than a window, by state.
        self.short: dict[int, set[tuple[int, str]]] = {}
        for name, words in items:
            state = 0
            for word in words:
                state = self.next[state][word]
                at = state
                while at > 0 and self.length[at] >= window and name not in self.items[at]:
                    self.items[at].add(name)
                    at = self.link[at]
            if len(words) < window:
                self.short.setdefault(state, set()).add((len(words), name))
        # The nearest state with a short item at or above each state.
        self.short_above = [-1] * len(self.link)
        for state in sorted(range(len(self.link)), key=self.length.__getitem__):
            self.short_above[state] = state if state in self.short else self.short_above[self.link[state]] if state else -1
        lengths = [min(window, len(words)) for _, words in items]
        self.longest = max(lengths, default=0)
        self.block = (min(lengths, default=1) + 1) // 2

    def _extend(self, last: int, word: bytes) -> int:
        nxt, link, length = self.next, self.link, self.length
        if word in nxt[last]:
            there = nxt[last][word]
            return there if length[there] == length[last] + 1 else self._split(last, word, there)
        new = self._add(length[last] + 1, {}, 0)
        at = last
        while at >= 0 and word not in nxt[at]:
            nxt[at][word] = new
            at = link[at]
        if at >= 0:
            there = nxt[at][word]
            link[new] = there if length[there] == length[at] + 1 else self._split(at, word, there)
        return new

    def _add(self, length: int, follow: dict[bytes, int], link: int) -> int:
        self.next.append(follow)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, at: int, word: bytes, there: int) -> int:
        """A state for the shorter sequences of ``there``, those that end after ``at``."""
        copy = self._add(self.length[at] + 1, dict(self.next[there]), self.link[there])
        self.link[there] = copy
        while at >= 0 and self.next[at].get(word) == there:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def _stretches(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """Stretches of words outside which no window occurs."""
        block, reach, nxt = self.block, self.longest - self.block, self.next
        start = end = -1
        root = nxt[0]
        for k in range(0, len(words) - block + 1, block):
            state = root.get(words[k])
            if state is None:
                continue
            for word in words[k + 1 : k + block]:
                state = nxt[state].get(word)
                if state is None:
                    break
            if state is not None:
                if end < 0 or k - reach > end:
                    if end >= 0:
                        yield start, end
                    start = max(0, k - reach)
                end = min(len(words), k + block + reach)
        if end >= 0:
            yield start, end

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged stretches (first, last word) inside windows, and the items whose windows occur."""
        if self.longest == 0:
            return [], set()
        nxt, link, length, window = self.next, self.link, self.length, self.window
        spans: list[tuple[int, int]] = []
        found: set[str] = set()

        def mark(first: int, last: int) -> None:
            while spans and spans[-1][0] >= first:
                spans.pop()
            if spans and first <= spans[-1][1] + 1:
                first = spans.pop()[0]
            spans.append((first, last))

        for start, end in self._stretches(words):
            state = matched = 0
            for k in range(start, end):
                word = words[k]
                while state and word not in nxt[state]:
                    state = link[state]
                    matched = length[state]
                state = nxt[state].get(word, 0)
                if not state:
                    matched = 0
                    continue
                matched += 1
                reach = 0
                if matched >= window:
                    at = state
                    while length[link[at]] >= window:
                        at = link[at]
                    found |= self.items[at]
                    reach = window
                at = self.short_above[state]
                while at > 0:
                    for size, name in self.short[at]:
                        if size <= matched:
                            found.add(name)
                            reach = max(reach, size)
                    at = self.short_above[link[at]]
                if reach:
                    mark(k - reach + 1, k)
        return spans, found


def _automaton(key: object, items: list[tuple[str, str]], window: int) -> ItemAutomaton:
    """The automaton of one broadcast, built once by each Python worker."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = ItemAutomaton([(name, words_of(text)) for name, text in items], window)
    return _BUILT[key]


def _scan(spark: SparkSession, items: list[tuple[str, str]], window: int) -> tuple[Column, Broadcast]:
    """A function of a text column giving ``RESULT`` against some items, and the broadcast it uses."""
    shared = spark.sparkContext.broadcast(items)
    key = (spark.sparkContext.applicationId, shared._jbroadcast.id(), window)

    @F.pandas_udf(RESULT)
    def scan(texts: pd.Series) -> pd.DataFrame:
        automaton, rows = _automaton(key, shared.value, window), []
        for text in texts:
            words = words_of(text)
            spans, items = automaton.hits(words)
            first, last = [s for s, _ in spans], [e for _, e in spans]
            first_byte: list[int] = []
            end_byte: list[int] = []
            if spans:
                places = [m.span() for m in _WORD_BYTES.finditer((text or "").encode("utf-8", "replace").translate(_NORMAL))]
                first_byte, end_byte = [places[s][0] for s in first], [places[e][1] for e in last]
            n_hit = sum(e - s + 1 for s, e in spans)
            rows.append((len(words), n_hit, sorted(items), first, last, first_byte, end_byte))
        return pd.DataFrame(rows, columns=["n_words", "n_hit", "items", "first_word", "last_word", "first_byte", "end_byte"])

    return scan, shared


def _pieces(text: Column, window: int, most: int) -> Column:
    """Parts of at most ``most`` words of an item's text, which share no fewer words than windows need."""
    lowered, step = ascii_lower(text), most - window + 1
    words = F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))
    starts = F.sequence(F.lit(0), F.greatest(F.ceil((F.size(words) - (window - 1)) / F.lit(step)) - 1, F.lit(0)).cast("int"))
    cut = F.transform(starts, lambda k: F.array_join(F.slice(words, k * step + 1, F.lit(most)), " "))
    return F.when(F.regexp_count(lowered, F.lit(WORD)) > most, cut).otherwise(F.array(text))


def item_shards(benchmark: DataFrame, words_per_automaton: int = WORDS_PER_AUTOMATON, window: int = WINDOW) -> Iterator[list[tuple[str, str]]]:
    """Items, long ones in pieces, in shares of about so many words, each small enough for one automaton and collected when asked for."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    most = max(words_per_automaton // 10, 2 * window)
    items = items.select("item", F.explode(_pieces(F.col("text"), window, most)).alias("text"))
    total = items.agg(F.sum(F.regexp_count(ascii_lower(F.col("text")), F.lit(WORD)))).first()[0] or 0
    n_shards = max(1, -(-total // words_per_automaton))
    if n_shards > 1:
        # Read once more for each share, but cut once; by share, so that a pass reads its own.
        shard = F.pmod(F.xxhash64("item", "text"), F.lit(n_shards)).cast("int")
        items = store(items.withColumn("shard", shard).repartition("shard"), "benchmark-items", "shard")
    for k in range(n_shards):
        share = items.filter(F.col("shard") == k).drop("shard") if n_shards > 1 else items
        yield sorted(tuple(row) for row in share.distinct().collect())


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, words_per_automaton: int = WORDS_PER_AUTOMATON, name: str = "contamination") -> DataFrame:
    """``docs`` with a struct column ``name`` of type ``RESULT`` about its column ``text``.

    With more items than one automaton takes, the passes run when this is called.
    """
    spark = docs.sparkSession
    ship_package(spark)
    shards = item_shards(benchmark, words_per_automaton, window)
    items, following = next(shards), next(shards, None)
    if following is None:
        return docs.withColumn(name, _scan(spark, items, window)[0](F.col("text")))
    # Several automata: a pass each; what they hit is merged by text.
    key = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    hits = None
    for items in chain([items, following], shards):
        scan, shared = _scan(spark, items, window)
        part = store(docs.select(key.alias("key"), scan(F.col("text")).alias("r")).filter(F.col("r.n_hit") > 0), "contamination-hits")
        shared.destroy()
        hits = part if hits is None else hits.unionByName(part)
    # At most one distinct row for each automaton.
    merged = hits.groupBy("key").agg(F.collect_set("r").alias("parts")).mapInArrow(_merged, f"key string, {RESULT}")
    merged = store(merged.select(F.col("key").alias("__key"), F.struct(*[c for c in merged.columns if c != "key"]).alias("__hits")), "contamination-merged")
    joined = docs.withColumn("__key", key).join(merged, "__key", "left")
    n_words = F.regexp_count(ascii_lower(F.coalesce(F.col("text"), F.lit(""))), F.lit(WORD)).cast("long")
    nothing = F.struct(n_words.alias("n_words"), F.lit(0).cast("long").alias("n_hit"), *[F.array().cast(t).alias(c) for c, t in _LISTS.items()])
    return joined.select(*[joined[c] for c in docs.columns], F.coalesce(F.col("__hits"), nothing).alias(name))


_LISTS = {"items": "array<string>", **dict.fromkeys(["first_word", "last_word", "first_byte", "end_byte"], "array<int>")}


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One result from the results of several automata; spans that overlap or touch become one."""
    ints = pa.list_(pa.int32())
    kinds = {"key": pa.string(), "n_words": pa.int64(), "n_hit": pa.int64(), "items": pa.list_(pa.string()), **dict.fromkeys(list(_LISTS)[1:], ints)}
    for batch in batches:
        rows = []
        for key, parts in zip(batch["key"].to_pylist(), batch["parts"].to_pylist()):
            spans: list[list[int]] = []
            for span in sorted(s for r in parts for s in zip(r["first_word"], r["last_word"], r["first_byte"], r["end_byte"])):
                if spans and span[0] <= spans[-1][1] + 1:
                    spans[-1][1], spans[-1][3] = max(spans[-1][1], span[1]), max(spans[-1][3], span[3])
                else:
                    spans.append(list(span))
            lists = dict(zip(list(_LISTS)[1:], map(list, zip(*spans))))
            n_hit = sum(last - first + 1 for first, last, _, _ in spans)
            items = sorted({item for r in parts for item in r["items"]})
            rows.append({"key": key, "n_words": parts[0]["n_words"], "n_hit": n_hit, "items": items, **lists})
        yield pa.RecordBatch.from_pylist(rows, pa.schema(list(kinds.items())))


def is_contaminated(result: Column, min_share: float | Fraction = 0.05) -> Column:
    """Hit words make at least ``min_share`` of all (one in twenty by default).

    The limit is the fraction as written (0.3 is 3 / 10), compared without rounding.
    """
    limit = Fraction(str(min_share))
    times = lambda name, n: result[name].cast("decimal(20,0)") * F.lit(str(n)).cast("decimal(38,0)")
    return (result["n_hit"] > 0) & (times("n_hit", limit.denominator) >= times("n_words", limit.numerator))


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_share: float = 0.05) -> DataFrame:
    """``docs`` without contaminated rows; the rest, spans below the limit included, as they are."""
    scanned = contamination(docs, benchmark, name="__contamination")
    return scanned.filter(~is_contaminated(F.col("__contamination"), min_share)).select(*[scanned[c] for c in docs.columns])


def without_spans(docs: DataFrame, benchmark: DataFrame, min_words: int = WINDOW, min_share: float = 1.0) -> DataFrame:
    """``docs`` with every hit span cut out of its text if the span has ``min_words`` or all hits reach ``min_share``."""
    scanned = contamination(docs, benchmark, name="__contamination")
    share = Fraction(str(min_share))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, results: pd.DataFrame) -> pd.Series:
        out = []
        for text, row in zip(texts, results.itertuples(index=False)):
            if not row.n_hit:
                out.append(text)
                continue
            raw, at, kept = text.encode("utf-8", "replace"), 0, []
            whole = int(row.n_hit) * share.denominator >= share.numerator * int(row.n_words)
            for first, last, start, end in zip(row.first_word, row.last_word, row.first_byte, row.end_byte):
                if whole or last - first + 1 >= min_words:
                    kept.append(raw[at:start])
                    at = end
            out.append(b"".join([*kept, raw[at:]]).decode())
        return pd.Series(out)

    cleaned = cut(F.col("text"), F.col("__contamination"))
    return scanned.select(*[cleaned.alias(c) if c == "text" else scanned[c] for c in docs.columns])


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "contamination")
    result = F.col("contamination")
    return found.select(
        "doc_id", result["n_words"].alias("n_words"), result["n_hit"].alias("n_hit"), F.size(result["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(result["items"], ","), 256).alias("items_sha256"), is_contaminated(result).alias("contaminated"),
    )


OP8_SQL = r"""
WITH item AS (
    SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item, w, least(13, len(w)) AS k
    FROM (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark)
    WHERE len(w) > 0
), item_window AS (
    SELECT DISTINCT item, k, array_to_string(w[s:s + k - 1], ' ') AS g
    FROM (SELECT item, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM item)
), doc AS (
    SELECT row_number() OVER () AS r, doc_id,
           coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
    FROM documents
), doc_window AS (
    SELECT r, k, s, array_to_string(w[s:s + k - 1], ' ') AS g
    FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM doc, (SELECT DISTINCT k FROM item_window))
), found AS (
    SELECT r, k, s, item FROM doc_window JOIN item_window USING (k, g)
), hit AS (
    SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + k)) AS p FROM (SELECT DISTINCT r, k, s FROM found)) GROUP BY r
), named AS (
    SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM found) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""
