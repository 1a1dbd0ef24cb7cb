r"""Personal data by weak supervision, in DataFrame code only.

Labelers vote on candidate spans: a strict regular expression with its check, a
gazetteer (top-level domains, calling codes, card issuers, reserved networks), the
words before the span, and its shape. Each says yes (1), no (-1) or nothing (0).
Expectation-maximisation over the counts of vote patterns estimates how often each
labeler is right; its posteriors are soft labels, on which a naive Bayes classifier
of spans is trained (kind, length, share of digits, sign before, context). Strict
spans always stay; the classifier decides about the others: mail addresses in
words, national phone numbers, and identity numbers (``ssn``).

Texts are read once and stay in their rows. What leaves a task is a table of vote
patterns (at most 3 ** 4) and one of feature values (some 40), summed in each task
first; EM is one expression over the first. Nothing is joined or shuffled by
document, and a text's spans stay in its row.

The patterns match as the plain ones given for each kind do, but are written so
that long runs cost no recursion and no square: possessive loops, and looking back
where a match can only start at the start of a run.

Defined cases: null and empty texts have no spans; repeated documents get a row
each; a null ``doc_id`` stays null; without any span the model says yes to nothing;
ties in probability (0.5) count as yes; spans that overlap a strict one are dropped;
long texts are searched whole; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import table
from ledgerline.llm.spans import digits, joined, matches
from ledgerline.session import store

KINDS = ["email", "ip", "card", "phone", "ssn"]  # in the order of results
ROUNDS = 25

_LOCAL = "[A-Za-z0-9._%+-]"
# A match may start where the one before ended, in the middle of a run.
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
SPELLED_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:[\[(]dot[\])]|\.)\x20?[A-Za-z0-9-]{1,63})++"
PLAIN_PHONE = r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"

# Gazetteers and words of context.
DOMAINS = ["com", "org", "net", "edu", "gov", "io", "info", "biz", "de", "fr", "es", "uk", "it", "nl", "eu", "ch", "at", "us", "ca", "au", "jp", "cn", "in", "br", "mx"]
CALLING_CODES = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
CARD_ISSUERS = "3[47]|4|5[1-5]|2[2-7]|6"
RESERVED_NETWORKS = r"0\.|255\.|22[4-9]\.|23[0-9]\.|24[0-9]\.|25[0-4]\."
SAYS_YES = {
    "email": "mail|contact|write to|reach", "ip": r"\bip\b|address|host|server|login from", "card": "card|visa|amex|payment|paid",
    "phone": "phone|tel|call|mobile|fax|whatsapp|contact", "ssn": "ssn|social security|tax id",
}
SAYS_NO = {
    "email": "example of|such as", "ip": r"version|release|\bv$|section", "card": "isbn|serial|order|tracking", "phone": "isbn|serial|order|sku|part no",
    "ssn": "serial|order|part no|sku",
}
LABELERS = ["strict", "gazetteer", "context", "shape"]
SPAN = "array<struct<kind:string,start:int,end:int,base:boolean,votes:array<int>,features:array<string>>>"


def _yes_no(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _gazetteer(kind: str, match: Column) -> Column:
    plain = digits(match)
    if kind == "email":
        known = F.lower(F.regexp_extract(match, r"([A-Za-z0-9-]+)$", 1)).isin(DOMAINS)
        return _yes_no(known, ~known)
    if kind == "ip":
        return _yes_no(F.lit(False), match.rlike(f"^(?:{RESERVED_NETWORKS})"))
    if kind == "card":
        known = plain.rlike(f"^(?:{CARD_ISSUERS})")
        return _yes_no(known, ~known)
    if kind == "phone":
        return F.when(match.startswith("+"), _yes_no(plain.rlike(f"^(?:{CALLING_CODES})"), plain.rlike("^0"))).otherwise(
            _yes_no(plain.rlike("^[2-9][0-9]{2}[2-9]"), plain.rlike("^[01]|^[0-9]{3}[01]"))
        )
    return _yes_no(F.lit(False), plain.rlike("^(?:000|666|9)|^[0-9]{3}00|0000$"))


def _shape(kind: str, match: Column) -> Column:
    plain = digits(match)
    if kind == "email":
        return _yes_no(F.length(match).between(6, 80), (F.length(match) > 128) | match.contains(".."))
    same = plain.rlike(r"^([0-9])\1*$")
    return _yes_no(~same & (F.length(plain) <= 19), same)


def _spans(text: Column, kind: str, pattern: str, base: bool, likely: Column, valid=None) -> Column:
    """Candidates of one kind with their votes and features."""
    found = matches(text, pattern, likely)
    if valid is not None:
        found = F.filter(found, lambda m: valid(m["match"]))

    def candidate(m: Column) -> Column:
        before = F.lower(m["before"])
        context = _yes_no(before.rlike(SAYS_YES[kind]), before.rlike(SAYS_NO[kind]))
        n_digits = F.length(digits(m["match"]))
        last = F.right(m["before"], F.lit(1))
        features = F.array(
            F.lit(f"kind {kind}"),
            F.concat(F.lit("length "), F.least(F.lit(8), F.floor(F.length(m["match"]) / 4)).cast("string")),
            F.concat(F.lit("digits "), F.floor(n_digits * 4 / F.length(m["match"])).cast("string")),
            F.concat(F.lit("after "), F.when(last == "", "start").when(last.rlike(r"\s"), "space").when(last.rlike(r"\w"), "word").otherwise("sign")),
            F.concat(F.lit("context "), context.cast("string")),
        )
        votes = F.array(F.lit(1 if base else 0), _gazetteer(kind, m["match"]), context, _shape(kind, m["match"]))
        return F.struct(
            F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), F.lit(base).alias("base"),
            votes.alias("votes"), features.alias("features"),
        )

    return F.transform(found, candidate)


def _is_ip(match: Column) -> Column:
    def part_is_byte(part: Column) -> Column:
        plain = F.regexp_replace(part, "^0+", "")
        return (F.length(plain) <= 3) & (F.coalesce(plain.try_cast("int"), F.lit(0)) <= 255)

    return F.forall(F.split(match, r"\."), part_is_byte)


def _luhn(plain: Column) -> Column:
    return F.coalesce(F.call_function("luhn_check", plain), F.lit(False))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, base (strict spans in order) and more (other candidates apart from those), stored."""
    text = F.col("text")
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n_digits = lambda m: F.length(digits(m))
    rows = rows.select(
        "doc_id",
        _spans(text, "email", EMAIL, True, text.contains("@")).alias("email"),
        _spans(text, "ip", IP, True, text.contains("."), _is_ip).alias("ip"),
        _spans(text, "card", CARD, True, text.rlike("[0-9]"), lambda m: _luhn(digits(m))).alias("card"),
        _spans(text, "phone", PHONE, True, text.contains("+"), lambda m: n_digits(m).between(8, 15)).alias("phone"),
        F.concat(
            _spans(text, "email", SPELLED_EMAIL, False, text.rlike(r"[\[(]at[\])]")),
            _spans(text, "phone", PLAIN_PHONE, False, text.rlike("[0-9]{4}")),
            _spans(text, "ssn", SSN, False, text.rlike("[0-9]{4}")),
        ).alias("other"),
    )
    base = F.concat("email", "ip", "card", "phone").alias("base")
    rows = rows.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:4]], base, "other")
    apart = F.filter("other", lambda o: ~F.exists("base", lambda b: (b["start"] < o["end"]) & (o["start"] < b["end"])))
    return store(rows.select("doc_id", *[f"n_{k}" for k in KINDS[:4]], "base", F.when(F.size("other") > 0, apart).otherwise(F.col("other")).alias("more")), "pii-candidates")


def _logit(p: Column) -> Column:
    return F.ln(p / (1 - p))


def _posterior(votes: Column, prior: Column, rights: Column) -> Column:
    """Probability that a span is personal data, given labelers' votes and how often each is right."""
    score = F.aggregate(F.arrays_zip(votes.alias("vote"), rights.alias("right")), _logit(prior), lambda s, x: s + x["vote"] * _logit(x["right"]))
    return 1 / (1 + F.exp(-score))


def reliabilities(found: DataFrame, rounds: int = ROUNDS) -> tuple[float, list[float]]:
    """Share of spans that are personal data, and how often each labeler is right when it votes."""
    spans = found.select(F.explode(F.concat("base", "more")).alias("span"))
    patterns = spans.groupBy(F.col("span.votes").alias("votes")).agg(F.count("*").cast("double").alias("n"))
    # At most 81 rows.
    one = patterns.agg(F.array_sort(F.collect_list(F.struct("votes", "n"))).alias("patterns"))

    def bounded(x: Column, low: float, high: float) -> Column:
        return F.least(F.lit(high), F.greatest(F.lit(low), x))

    def step(model: Column, _: Column) -> Column:
        soft = F.transform("patterns", lambda x: F.struct(x["votes"].alias("votes"), x["n"].alias("n"), _posterior(x["votes"], model["prior"], model["rights"]).alias("p")))

        def right(j: int) -> Column:
            agree = F.aggregate(soft, F.lit(2.0), lambda s, x: s + x["n"] * F.when(x["votes"][j] == 1, x["p"]).when(x["votes"][j] == -1, 1 - x["p"]).otherwise(0.0))
            votes = F.aggregate(soft, F.lit(3.0), lambda s, x: s + x["n"] * F.abs(x["votes"][j]))
            return bounded(agree / votes, 0.55, 0.99)

        yes = F.aggregate(soft, F.lit(1.0), lambda s, x: s + x["n"] * x["p"])
        total = F.aggregate(soft, F.lit(2.0), lambda s, x: s + x["n"])
        return F.struct(bounded(yes / total, 0.05, 0.95).alias("prior"), F.array(*[right(j) for j in range(len(LABELERS))]).alias("rights"))

    start = F.struct(F.lit(0.5).alias("prior"), F.array(F.lit(0.9), F.lit(0.7), F.lit(0.7), F.lit(0.6)).alias("rights"))
    row = one.select(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step).alias("model")).first()
    return row["model"]["prior"], list(row["model"]["rights"])


def span_classifier(found: DataFrame, prior: float, rights: list[float]) -> tuple[float, dict[str, float]]:
    """Naive Bayes weights: intercept, and the log odds of each feature value."""
    spans = found.select(F.explode(F.concat("base", "more")).alias("span"))
    soft = spans.select("span.features", _posterior(F.col("span.votes"), F.lit(prior), F.array(*map(F.lit, rights))).alias("p"))
    sums = soft.select(F.explode(F.array_append("features", F.lit("all"))).alias("feature"), "p").groupBy("feature").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no"))
    # Some 40 feature values, whatever the data.
    rows = {row["feature"]: (row["yes"] + 1, row["no"] + 1) for row in sums.collect()}
    yes, no = rows.pop("all", (1.0, 1.0))
    weights = {feature: math.log(a / yes) - math.log(b / no) for feature, (a, b) in rows.items()}
    return math.log(yes / no), weights


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_<kind> of strict spans, base (strict spans) and spans (all, with a probability), by kind then start."""
    found = candidates(docs)
    prior, rights = reliabilities(found)
    intercept, weights = span_classifier(found, prior, rights)
    table_ = F.create_map(*[F.lit(x) for pair in sorted(weights.items()) for x in pair]) if weights else F.create_map().cast("map<string,double>")

    def scored(s: Column) -> Column:
        score = F.aggregate(s["features"], F.lit(float(intercept)), lambda t, f: t + F.coalesce(table_[f], F.lit(0.0)))
        order = F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
        return F.struct(
            order.alias("order"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["base"].alias("base"), (1 / (1 + F.exp(-score))).alias("probability")
        )

    spans = F.filter(F.transform(F.concat("base", "more"), scored), lambda s: s["base"] | (s["probability"] >= 0.5))
    return found.select("doc_id", *[f"n_{k}" for k in KINDS[:4]], "base", F.array_sort(spans).alias("spans"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *[f"n_{k}" for k in KINDS[:4]], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )
