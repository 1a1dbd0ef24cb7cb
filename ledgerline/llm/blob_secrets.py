r"""Secret scans with an incremental ledger of blobs, in DataFrame code only.

Every version of every path is content-addressed: its blob is the SHA-256 of its
text. The ledger is a table of (blob, rule version, findings) in a folder. A scan
looks up which (blob, rule version) pairs the ledger lacks, reads the text of one
row for each such blob, appends what it finds, and joins the findings of all
blobs back to all paths. Scanning again, or a history with few new versions,
reads only what is new; a new rule version is scanned without dropping the old.

Copies of a text are one blob. Which blobs are unseen is found without texts. A row
for each is then picked with a group limit in each task before the shuffle, so a text
that a third of all rows hold costs a row per task; joining back, the blob's many paths stand on the side that
adaptive execution can split.

A run appends its findings as one new folder of the ledger, named by a run; a run
that fails leaves no marker of success and is not read. Ledger rows are distinct
by (blob, rule version), so two runs that scan one blob do no harm.

Defined cases: null and empty texts are the blob of the empty text, with no
findings; repeated rows are rows of one blob and each gets its result; a null
path stays null; without rows nothing is scanned or returned; ties between
copies go to any of them, as their texts are equal; long texts are searched
whole; other columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import is_broadcast, table
from ledgerline.llm.spans import joined, matches
from ledgerline.session import run_folder, store

RULES_VERSION = "1"
KINDS = ["assign", "access", "hex", "private_key", "jwt"]  # in the order of results at one place
BASE_KINDS = KINDS[:3]

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_HEAD = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "(?<![0-9a-f])[0-9a-f]{32,}"  # a run is matched as a whole, so shorter ones need no look
PRIVATE_KEY = "-----BEGIN (?:[A-Z]{1,12} ){0,3}PRIVATE KEY-----"
JWT = r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"
SPAN = "array<struct<start:int,order:int,end:int,kind:string>>"
LEDGER = f"blob string, rules string, spans {SPAN}"


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def findings(text: Column) -> Column:
    """All spans of a text by start, then kind as listed."""
    likely_word = text.rlike("(?i)passw|secret|token|api_?key")
    found = {
        "assign": F.filter(matches(text, ASSIGN, likely_word), lambda m: F.length(F.regexp_replace(m["match"], ASSIGN_HEAD, "")) >= 8),
        "access": F.filter(matches(text, ACCESS, text.contains("AKIA")), lambda m: F.length(m["match"]) >= 16),
        "hex": matches(text, HEX),
        "private_key": matches(text, PRIVATE_KEY, text.contains("PRIVATE KEY")),
        "jwt": matches(text, JWT, text.contains("eyJ")),
    }

    def named(kind: str):
        return lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("order"), m["end"].alias("end"), F.lit(kind).alias("kind"))

    return F.array_sort(F.concat(*[F.transform(found[kind], named(kind)) for kind in KINDS]))


def read_ledger(spark: SparkSession, folder: str, rules: str | None = None) -> DataFrame:
    """Distinct rows of the ledger, of one rule version if named; empty if nothing was written."""
    try:
        ledger = spark.read.schema(LEDGER).parquet(f"{folder}/run=*")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)
    return ledger if rules is None else ledger.filter(F.col("rules") == rules)


def one_row_per_blob(versions: DataFrame, wanted: DataFrame) -> DataFrame:
    """A row (blob, text) for each of the ``wanted`` blobs; a task passes on one, whatever the number of its copies."""
    first = F.row_number().over(Window.partitionBy("blob").orderBy("n"))
    picked = versions.withColumn("n", F.length("text")).withColumn("first", first).filter("first = 1")
    return picked.join(wanted, "blob", "left_semi").select("blob", "text")


def scan_blobs(versions: DataFrame, folder: str, rules: str = RULES_VERSION, scan=findings) -> DataFrame:
    """Scans blobs of ``versions`` (blob, text) that the ledger lacks for ``rules``, appends them, and returns what was appended."""
    spark = versions.sparkSession
    known = read_ledger(spark, folder, rules).select("blob").distinct()
    unseen = store(versions.select("blob").distinct().join(known, "blob", "left_anti"), "unseen-blobs")
    # Few unseen blobs are broadcast, and all other texts stay where they are.
    one = one_row_per_blob(versions.join(unseen, "blob", "left_semi") if is_broadcast(unseen) else versions, unseen)
    target = f"{folder}/run={uuid.uuid4().hex}"
    one.select("blob", F.lit(rules).alias("rules"), scan(F.coalesce("text", F.lit(""))).alias("spans")).write.parquet(target)
    return spark.read.schema(LEDGER).parquet(target)


def scan_history(history: DataFrame, folder: str, rules: str = RULES_VERSION, scan=findings) -> DataFrame:
    """Columns of ``history`` but its ``text``, with blob and spans, for every version of every path."""
    addressed = history.withColumn("__blob", blob_of(F.col("text")))
    scan_blobs(addressed.select(F.col("__blob").alias("blob"), "text"), folder, rules, scan)
    ledger = read_ledger(history.sparkSession, folder, rules).dropDuplicates(["blob"]).select(F.col("blob").alias("__blob"), F.col("spans").alias("__spans"))
    # Stored, so that the many paths of one blob can be split in the join.
    ledger = store(ledger, "secret-findings")
    paths = store(addressed.drop("text"), "secret-paths")
    joined_ = paths.join(ledger, "__blob")
    return joined_.select(*[c for c in history.columns if c != "text"], F.col("__blob").alias("blob"), F.col("__spans").alias("spans"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan_history(history, run_folder(spark, "secret-ledger"))
    base = F.filter("spans", lambda s: s["kind"].isin(BASE_KINDS))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, BASE_KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
