"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted into cells (source, language, topic). Token weights of the
cells start at their token counts and are raked: for one dimension after the
other, each value's weights are multiplied so that they sum up to the value's
target; a weight never exceeds the cell's tokens, so weight / tokens is a
probability. Turns end when none moves a probability by more than ``tolerance``,
after ``rounds`` at the latest; ``distances`` tells how far each value then is from
its target. A document is kept with its cell's probability, decided by a hash of its
id: the same documents every time.

Targets are shares per value. Those not given are tempered: proportional to
(tokens of the value) ** ``alpha``, which lifts small sources. The raked total is
``keep`` of all tokens.

All of it is DataFrame code. Topics and tokens are found in one pass over the texts
and stored; the cells come from one aggregation with a partial step (a source with a third of all rows costs one row
per task), each turn is three small aggregations and joins over the cells, written
to the shared folder. Spark broadcasts cells by its own threshold or joins them
with skew splitting.

Defined cases: a null source, language or topic counts as the empty string; null
and empty texts have no tokens, their cell's tokens alone count, and a cell
without tokens keeps its rows (there is nothing to weigh); a null ``doc_id`` is
hashed like an empty text; rows of one id are kept or left out alike if they are
in one cell; no rows give no rows; a value without a target has target 0 and a
target without rows is spread over the other values; equal hashes are kept or left
out alike (there are no other ties); texts of any length are read whole; other
columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import table
from ledgerline.session import store

DIMENSIONS = ("source", "lang", "topic")
ALPHA, KEEP, ROUNDS, TOLERANCE, SEED = 0.7, 0.8, 10, 1e-12, "mix-1"

# A topic's sign, looked for in this order.
TOPIC_SIGNS = [("legal", "(?i)licensed under|all rights reserved|copyright"), ("code", r"[{};]\s*\n|def \w+\(|</\w+>"), ("contact", r"@[A-Za-z0-9-]+\.|\+[0-9][0-9 ().-]{6,}[0-9]"), ("data", "[0-9]{4,}")]


def topic_of(text: Column) -> Column:
    """A coarse topic by signs in the whole text, ``prose`` if there is none."""
    topic = F.lit("prose")
    for name, sign in reversed(TOPIC_SIGNS):
        topic = F.when(text.rlike(sign), name).otherwise(topic)
    return topic


def token_count(text: Column) -> Column:
    """White-space separated words, the unit that is weighed."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \t\n\r]+")), F.lit(0)).cast("long")


def hash_share(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) fixed by an id."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def described() -> list[Column]:
    """The dimensions (not null) and n_tokens of a document."""
    return [
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("source", "lang")],
        topic_of(F.coalesce("text", F.lit(""))).alias("topic"), token_count(F.col("text")).alias("n_tokens"),
    ]


def _with_targets(cells: DataFrame, targets: dict[str, dict[str, float]], alpha: float, keep: float) -> DataFrame:
    """Cells with a column ``target_<dimension>``: the tokens that the cell's value is to have."""
    for dimension in DIMENSIONS:
        values = cells.groupBy(F.col(dimension).alias("value")).agg(F.sum("n_tokens").cast("double").alias("n"))
        if dimension in targets:
            given = cells.sparkSession.createDataFrame([(str(k), float(v)) for k, v in targets[dimension].items()], "value string, share double")
            values = values.join(given, "value", "left").select("value", "n", F.coalesce("share", F.lit(0.0)).alias("share"))
        else:
            values = values.withColumn("share", F.pow("n", F.lit(alpha)))
        sums = values.agg(F.sum("share").alias("shares"), F.sum("n").alias("total"))
        first = sums.first()
        target = F.col("share") * F.lit(keep * (first["total"] or 0.0) / (first["shares"] or 1.0))
        cells = cells.join(values.select(F.col("value").alias(dimension), target.alias(f"target_{dimension}")), dimension)
    return cells


def rake(
    cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, alpha: float = ALPHA, keep: float = KEEP, rounds: int = ROUNDS, tolerance: float = TOLERANCE
) -> DataFrame:
    """The dimensions, n_tokens, weight, probability and target_<dimension> of each cell."""
    current = _with_targets(cells, targets or {}, alpha, keep)
    current = store(current.withColumn("weight", F.col("n_tokens").cast("double")), "mixing-cells")
    probability = F.when(F.col("n_tokens") > 0, F.col("weight") / F.col("n_tokens")).otherwise(1.0)
    for _ in range(rounds):
        current = current.withColumn("before", probability)
        for dimension in DIMENSIONS:
            sums = current.groupBy(dimension).agg(F.sum("weight").alias("weight_sum"))
            scaled = F.col("weight") * F.col(f"target_{dimension}") / F.col("weight_sum")
            weight = F.when(F.col("weight_sum") > 0, F.least(scaled, F.col("n_tokens").cast("double"))).otherwise(0.0)
            current = current.join(sums, dimension).withColumn("weight", weight).drop("weight_sum")
        current = store(current, "mixing-cells")
        if (current.agg(F.max(F.abs(probability - F.col("before")))).first()[0] or 0.0) <= tolerance:
            break
    return current.select(*DIMENSIONS, "n_tokens", "weight", probability.alias("probability"), *[f"target_{c}" for c in DIMENSIONS])


def distances(raked: DataFrame) -> DataFrame:
    """dimension, value, its target and weight in tokens, and their distance as a share of the target (null without one)."""
    kinds = F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).alias("value"), F.col(f"target_{c}").alias("target"), "weight") for c in DIMENSIONS]))
    summed = raked.select(kinds.alias("kind")).groupBy("kind.dimension", "kind.value").agg(F.max("kind.target").alias("target"), F.sum("kind.weight").alias("weight"))
    share = F.when(F.col("target") > 0, F.abs(F.col("weight") - F.col("target")) / F.col("target"))
    return summed.withColumn("distance", share)


def cells_of(rows: DataFrame) -> DataFrame:
    return store(rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("n_tokens")), "mixing-counts")


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, alpha: float = ALPHA, keep: float = KEEP, rounds: int = ROUNDS, seed: str = SEED) -> DataFrame:
    """The sampled rows of ``docs`` as they are."""
    rows = store(docs.select(*described(), hash_share(F.col("doc_id"), seed).alias("share"), F.struct(*docs.columns).alias("document")), "mixing-documents")
    cells = rake(cells_of(rows), targets, alpha, keep, rounds).select(*DIMENSIONS, "probability")
    return rows.join(cells, list(DIMENSIONS)).filter("share < probability").select("document.*")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample with each document's cell, tokens and probability."""
    rows = store(table(spark, sf_dir, "documents").select("doc_id", *described()), "mixing-documents")
    sampled = rows.join(rake(cells_of(rows)).select(*DIMENSIONS, "probability"), list(DIMENSIONS))
    sampled = sampled.filter(hash_share(F.col("doc_id"), SEED) < F.col("probability"))
    return sampled.select("doc_id", *DIMENSIONS, "n_tokens", F.round("probability", 6).alias("probability"))


def _sql() -> str:
    topic = " ".join(f"WHEN regexp_matches(text, '{sign}') THEN '{name}'" for name, sign in TOPIC_SIGNS)
    ctes = [f"""
doc AS MATERIALIZED (
    SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, CASE {topic} ELSE 'prose' END AS topic,
           coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')), 0) AS n_tokens
    FROM documents
), counted AS MATERIALIZED (
    SELECT source, lang, topic, CAST(sum(n_tokens) AS BIGINT) AS n_tokens FROM doc GROUP BY ALL
)"""]
    for c in DIMENSIONS:
        ctes.append(f"""
target_{c} AS MATERIALIZED (
    SELECT {c}, power(n, {ALPHA}) * {KEEP} * sum(n) OVER () / sum(power(n, {ALPHA})) OVER () AS target_{c}
    FROM (SELECT {c}, CAST(sum(n_tokens) AS DOUBLE) AS n FROM counted GROUP BY {c})
)""")
    ctes.append("""
w0 AS MATERIALIZED (
    SELECT *, CAST(n_tokens AS DOUBLE) AS weight FROM counted JOIN target_source USING (source) JOIN target_lang USING (lang) JOIN target_topic USING (topic)
)""")
    for k in range(ROUNDS * len(DIMENSIONS)):
        c = DIMENSIONS[k % len(DIMENSIONS)]
        ctes.append(f"""
w{k + 1} AS MATERIALIZED (
    SELECT * EXCLUDE (s, weight), CASE WHEN s > 0 THEN least(weight * target_{c} / s, CAST(n_tokens AS DOUBLE)) ELSE 0 END AS weight
    FROM (SELECT *, sum(weight) OVER (PARTITION BY {c}) AS s FROM w{k})
)""")
    return "WITH" + ",".join(ctes) + f"""
SELECT doc_id, source, lang, topic, doc.n_tokens, round(p, 6) AS probability
FROM doc JOIN (SELECT source, lang, topic, CASE WHEN n_tokens > 0 THEN weight / n_tokens ELSE 1 END AS p FROM w{ROUNDS * len(DIMENSIONS)}) USING (source, lang, topic)
WHERE CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) / 4294967296.0 < p
"""


OP3_SQL = _sql()
