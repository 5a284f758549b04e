"""The reviewer's side: chunks, rule-based personal data, verdicts, misses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redsieve.config import DEFAULT, MISS_TYPES
from redsieve.functions.text import chunks, last_object_with, stripped

#: Rules of this package's own detector. They find identifiers by form and don't stand for a language service.
PII_RULES = (
    ("Email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    ("IPAddress", r"\b(?:\d{1,3}\.){3}\d{1,3}\b"),
    ("CreditCardNumber", r"\b\d{13,19}\b"),
    ("PhoneNumber", r"\+\d{1,3} \(\d{3}\) \d{3}-\d{4}"),
    ("USSocialSecurityNumber", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("IBAN", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}\b"),
    ("CurrencyAmount", r"[$€£] ?\d[\d,.]*(?: ?(?:million|billion|m|bn|k))?"),
)

FEEDBACK_UNPARSED = "Reviewer response could not be parsed; please re-scan carefully."
FEEDBACK_FORCED = "Approved, but the least number of passes isn't reached: scan once more under the custom rules, borderline names, addresses and identifiers above all."


def text_chunks(texts: DataFrame, size: int = DEFAULT.pii_chunk_chars) -> DataFrame:
    """doc_id, start, chunk: requests to a detector."""
    return texts.select("doc_id", F.explode(chunks(F.col("text"), size)).alias("c")).select("doc_id", "c.start", "c.chunk")


def rule_entities(pieces: DataFrame) -> DataFrame:
    """doc_id, start, category, text: what the rules find in each chunk (doc_id, start, chunk); what a chunk's end cuts is not found."""
    return pieces.select("doc_id", "start", F.explode(chunk_entities(F.col("chunk"))).alias("e")).select("doc_id", "start", "e.category", "e.text")


def chunk_entities(chunk: Column) -> Column:
    """category and text of what the rules find in a chunk."""
    return F.concat(*[_found(chunk, category, rule) for category, rule in PII_RULES])


def _found(chunk: Column, category: str, rule: str) -> Column:
    return F.transform(F.regexp_extract_all(chunk, F.lit(f"({rule})")), lambda t: F.struct(F.lit(category).alias("category"), t.alias("text")))


VERDICT = "verdict string, summary string, missed array<struct<page:int,type:string,text:string,bbox:array<double>,reason:string>>, required_actions string, feedback string"


def parsed_verdicts(answers: DataFrame) -> DataFrame:
    """doc_id, verdict, missed (JSON list), feedback of a reviewer's answers (doc_id, answer): the last JSON object with a verdict,
    else REVISE."""
    o = last_object_with(F.col("answer"), ("verdict",))
    v = F.try_parse_json(o)
    text = lambda k: F.try_variant_get(v, f"$.{k}", "string")
    missed = F.coalesce(F.to_json(F.try_variant_get(v, "$.missed", "variant")), F.lit("[]"))
    return answers.select("doc_id", F.when(o.isNull(), F.lit("REVISE")).otherwise(text("verdict")).alias("verdict"), missed.alias("missed"), F.when(o.isNull(), F.lit(FEEDBACK_UNPARSED)).otherwise(F.coalesce(text("feedback"), F.lit(""))).alias("feedback"))


def missed_entries(verdicts: DataFrame) -> DataFrame:
    """doc_id, pos, type, page, bbox, label, entry: the entries of ``missed``; what isn't a list has none. An entry that is no
    object has no type."""
    v = F.try_variant_get(F.try_parse_json("missed"), "$", "array<variant>")
    rows = verdicts.select("doc_id", F.posexplode(F.coalesce(v, F.array().cast("array<variant>"))).alias("pos", "e"))
    get = lambda path, kind: F.try_variant_get("e", path, kind)
    return rows.select("doc_id", "pos", get("$.type", "string").alias("type"), get("$.page", "int").alias("page"), get("$.bbox", "array<double>").alias("bbox"), get("$.text", "string").alias("label"))


def miss_type(kind: Column) -> Column:
    """One of the buckets, regardless of case and white space around it; else Other."""
    k = F.lower(stripped(F.coalesce(kind, F.lit(""))))
    out = F.lit("Other")
    for name in MISS_TYPES[:-1]:
        out = F.when(k == name.lower(), F.lit(name)).otherwise(out)
    return out


def miss_buckets(misses: DataFrame, key: str, kind: str = "type") -> DataFrame:
    """``key`` and a count for each bucket, all of them always there."""
    return misses.groupBy(key).agg(*[F.count_if(miss_type(F.col(kind)) == t).alias(t.lower()) for t in MISS_TYPES])


def logo_boxes(misses: DataFrame) -> DataFrame:
    """Misses that are logos with a page and a box of four."""
    return misses.where((F.lower("type") == "logo") & (F.size("bbox") == 4) & F.col("page").isNotNull())


def logo_block(misses: DataFrame) -> DataFrame:
    """doc_id, block: logo boxes as a payload for the box tool."""
    item = F.struct("pos", F.struct("page", "bbox", F.lit("logo").alias("reason")).alias("b"))
    return logo_boxes(misses).groupBy("doc_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["b"])).alias("block"))


def feedback_json(missed: Column, text: Column, forced: Column) -> Column:
    """What the redactor gets: the misses, a JSON list, and the reviewer's words; after an approval that came too early, a standing
    request."""
    given = F.to_json(F.struct(missed.alias("missed"), text.alias("feedback")))
    fixed = F.to_json(F.struct(F.lit("[]").alias("missed"), F.lit(FEEDBACK_FORCED).alias("feedback")))
    return F.when(forced, fixed).otherwise(given)


def feedback(verdicts: DataFrame, forced: Column) -> DataFrame:
    """doc_id, feedback_json of verdicts as parsed_verdicts() returns them."""
    return verdicts.select("doc_id", feedback_json(F.col("missed"), F.col("feedback"), forced).alias("feedback_json"))
