"""URL filters: longest rule first, else host word segmentation and multinomial naive Bayes.

Host names are split into words by the most probable segmentation under a unigram model (Viterbi); the model's words are those of
the pages' titles. Host words and path tokens are the features of a naive Bayes model that learns from the URLs a rule decides.
Both models are counts over all pages, kept whole as written tables: a label looks up the words that occur in it, and tokens are
joined with their log odds; either table is broadcast only where its rows are counted to be few.

Defined results: a null URL, or one without ``://``, has an empty host and path, and no rule; it is judged by the prior. Without
any URL that a rule decides, the method allows. Rows are judged one by one, so repeated rows and frequent hosts do no harm. An
empty table gives an empty one."""

from __future__ import annotations

import math
import re
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redsieve.llm.common import bounded, saved

#: Verdict, host, path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))

#: Substrings in a batch.
BATCH = 20_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = "://([^/?#]*)([^?#]*)"
    part = lambda k: F.coalesce(F.regexp_extract(url, pattern, k), F.lit(""))
    return F.translate(part(1), string.ascii_uppercase, string.ascii_lowercase), part(2)


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls if none does."""
    rule = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def unigrams(pages: DataFrame) -> DataFrame:
    """word, n: the words of all titles."""
    title = F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), "(?is)<title[^>]*>(.*?)</title", 1))
    words = pages.select(F.explode(F.regexp_extract_all(title, F.lit(r"(\p{L}+)"))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


def segmenter(counts: dict[str, int], total: int | None = None):
    """segment(name): the words of the most probable split; letters that no word covers stay together. counts: at least those
    of the words that occur in the names. total: of all words' counts, where counts are a part of them."""
    total = (sum(counts.values()) if total is None else total) + 1
    cost = {w: -math.log(n / total) for w, n in counts.items() if len(w) > 1}
    lengths = sorted({1, *map(len, cost)}, reverse=True)

    def segment(name: str) -> tuple[str, ...]:
        n = len(name)
        best, back = [0.0] + [math.inf] * n, [0] * (n + 1)
        for j in range(1, n + 1):
            for k in lengths:
                i = j - k
                if i < 0:
                    continue
                c = cost.get(name[i:j])
                if c is None and k == 1:
                    c = math.log(total) + 4.0  # a letter that is no word's
                if c is not None and best[i] + c < best[j]:
                    best[j], back[j] = best[i] + c, i
        cuts = []
        while n:
            cuts.append(name[back[n] : n])
            n = back[n]
        out: list[str] = []
        free = False
        for w in reversed(cuts):
            if w in cost:
                out.append(w)
            elif free:
                run.append(w)
            else:
                run = [w]
                out.append(run)
            free = w not in cost
        return tuple(w if isinstance(w, str) else "".join(w) for w in out)

    return segment


def parts(host: str, path: str) -> list[str]:
    """The last label, runs of letters in the others (l:, to be split into words) and path tokens; runs of digits count by their length."""
    labels = host.split(".")
    out = [f"t:{labels[-1]}"]
    out += [f"h:#{len(x)}" if x.isdigit() else f"l:{x}" for x in re.findall(r"[^\W\d_]+|\d+", ".".join(labels[:-1]))]
    out += [f"p:#{len(x)}" if x.isdigit() else f"p:{x.lower()}" for x in re.findall(r"[^\W\d_]+|\d+", path)]
    return out


def _rows(pages: DataFrame, rules: tuple) -> DataFrame:
    """A row per page, with a key of its own and its parts."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parts(h, p) for h, p in zip(batch["host"].to_pylist(), batch["path"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.string()))], [*batch.schema.names, "parts"])

    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "verdict": verdict, "row": F.monotonically_increasing_id()})
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(split, f"{schema}, parts array<string>")


def label_words(labels: DataFrame, counts: DataFrame) -> DataFrame:
    """label, words: the split of each of the distinct ``labels`` under ``counts`` (word, n), a written table. Only the substrings
    that are as long as some word are looked up."""
    lengths = sorted(r[0] for r in counts.select(F.length("word")).distinct().collect() if r[0] > 1)
    total = counts.agg(F.sum("n")).first()[0] or 0

    def substrings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, word = [], []
        made = lambda: pa.RecordBatch.from_arrays([pa.array(of, pa.string()), pa.array(word, pa.string())], ["label", "word"])
        for batch in batches:
            for name in batch["label"].to_pylist():
                for k in lengths:
                    for w in {name[i : i + k] for i in range(len(name) - k + 1)}:
                        of.append(name)
                        word.append(w)
                        if len(of) >= BATCH or len(of) * len(name) >= BATCH * 256:
                            yield made()
                            of, word = [], []
        yield made()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch["label"].to_pylist()
            found = [segmenter({w["word"]: w["n"] for w in ws or ()}, total)(name) for name, ws in zip(names, batch["found"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["label"], pa.array(found, pa.list_(pa.string()))], ["label", "words"])

    held = labels.mapInArrow(substrings, "label string, word string")
    known = saved(counts.join(held.select("word").distinct(), "word", "left_semi"), "host-words")
    found = held.join(bounded(known), "word").groupBy("label").agg(F.collect_list(F.struct("word", "n")).alias("found"))
    return labels.join(found, "label", "left").select("label", "found").mapInArrow(split, "label string, words array<string>")


def _tokens(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """row, verdict, at, token: the tokens of each row, ``at`` in their order."""
    each = rows.select("row", "verdict", F.posexplode("parts").alias("place", "part"))
    label = F.when(F.col("part").startswith("l:"), F.substring("part", 3, 2**31 - 1))
    each = each.withColumn("label", label)
    labels = saved(each.select("label").where("label is not null").distinct(), "labels")
    words = saved(label_words(labels, counts), "label-words")
    plain = each.where("label is null").select("row", "verdict", F.struct("place", F.lit(0).alias("k")).alias("at"), F.col("part").alias("token"))
    split = each.where("label is not null").join(bounded(words), "label").select("row", "verdict", "place", F.posexplode("words").alias("k", "word"))
    return plain.unionByName(split.select("row", "verdict", F.struct("place", "k").alias("at"), F.concat(F.lit("h:"), "word").alias("token")))


def log_odds(seen: DataFrame, tokens: DataFrame) -> tuple[float, DataFrame]:
    """Prior log odds of allow, and token, odds: a row per token that occurs under a verdict. seen: verdict, a row per URL;
    tokens: verdict, token."""
    n = {r["verdict"]: r["n"] for r in seen.groupBy("verdict").agg(F.count("*").alias("n")).collect()}
    each = tokens.groupBy("token").agg(*[F.count(F.when(F.col("verdict") == v, 1)).alias(v) for v in ("allow", "block")])
    each = saved(each, "token-counts")
    totals = each.agg(F.sum("allow"), F.sum("block"), F.count("*")).first()
    size = totals[2] or 1
    odds = [F.log((F.col(v) + 1) / F.lit(float((totals[k] or 0) + size))) for k, v in enumerate(("allow", "block"))]
    prior = math.log((n.get("allow", 0) + 1) / (n.get("block", 0) + 1)) if n else 0.0
    return prior, each.select("token", (odds[0] - odds[1]).alias("odds"))


def naive_bayes(rows: DataFrame) -> tuple[float, dict[str, float]]:
    """``log_odds`` of small tables, collected. rows: verdict and tokens."""
    prior, odds = log_odds(rows, rows.select("verdict", F.explode("tokens").alias("token")))
    return prior, {r["token"]: r["odds"] for r in odds.collect()}


def url_verdicts(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score (the method's log odds of allow): a row per page."""
    rows = saved(_rows(pages, rules), "urls")
    tokens = saved(_tokens(rows, saved(unigrams(pages), "title-words")), "url-tokens")
    prior, odds = log_odds(rows.where("verdict is not null"), tokens.where("verdict is not null"))
    terms = tokens.join(bounded(odds), "token").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", "odds"))).alias("terms"))
    total = F.lit(prior) + F.coalesce(F.aggregate("terms", F.lit(0.0), lambda s, t: s + t["odds"]), F.lit(0.0))
    scored = rows.join(terms, "row", "left").withColumn("score", total)
    verdict = F.coalesce("verdict", F.when(F.col("score") >= 0, "allow").otherwise("block"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
