"""URL filters: rules by host and path, then naive Bayes over segmented names.

Rules name a domain and a path beginning; the longest that fits decides. Urls without a rule are judged by their words:
names run together in the host are split by unigram Viterbi, with word frequencies counted over the pages' own texts,
and multinomial naive Bayes scores the words of host and path.

It learns from the rules' verdicts: a url with a rule counts as that rule says. What the rules themselves name, the labels
of their domains and the words of their paths, is no feature, so that the model tells what goes with blocked urls and not
the rule again. Urls without a rule count as allowed, but for those whose words hold one of a few given seeds, a second
and weaker source of labels for what no rule names.

Names are segmented once per distinct host, each with just the frequencies of its own substrings: a join of distinct
substrings with word counts. Class counts are sums per word; words of hot hosts are summed before any shuffle.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Rules in order of their contract: (verdict, domain, path beginning).
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: Seeds: words that mark a url without a rule as blocked in training.
SEEDS = ("adult", "ads", "bets", "casino", "pills", "porn", "poker", "spam", "viagra", "xxx")
LONGEST, SMOOTH, LEAST_COUNT = 20, 1.0, 2


def parts(url: str) -> tuple[Column, Column]:
    """Host and path of a url column: empty without a :// (or for null)."""
    u = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substr(u, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, else null. A rule's name is its domain and path."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [F.when(((host == d) | host.endswith(f".{d}")) & path.startswith(p), F.struct(F.lit(d + p).alias("rule"), F.lit(v).alias("verdict"))) for v, d, p in ordered]
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def named_by(rules=RULES) -> list[str]:
    """The words that rules name: labels of their domains and words of their paths."""
    return sorted({w for _, domain, path in rules for w in re.findall(r"[^\W_]+", f"{domain} {path}".lower())})


def split_name(name: str, counts: dict[str, int], total: int, longest: int = LONGEST) -> list[str]:
    """The likeliest words that make up a name, by unigram Viterbi; an unknown run is as unlikely as it is long."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(name) + 1):
        options = []
        for start in range(max(0, end - longest), end):
            word = name[start:end]
            n = counts.get(word, 0)
            value = math.log(n / total) if n else -math.log(total + 10) - 2.5 * (end - start)
            options.append((best[start][0] + value, start))
        best.append(max(options, key=lambda o: (o[0], -o[1])))
    out, end = [], len(name)
    while end:
        start = best[end][1]
        out.append(name[start:end])
        end = start
    return out[::-1]


def word_counts(pages: DataFrame, body: str = "html") -> DataFrame:
    """(word, n): ASCII letter runs of the pages' texts without markup, lower-cased, of at most LONGEST letters. An unclosed
    script or style takes the rest of its page; no page takes more time than its length."""
    plain = F.lower(F.regexp_replace(F.coalesce(F.col(body), F.lit("")), r"(?s)<(script|style)\b.*?(?:</\1[^<>]*>|\z)|<[^<>]*>|&[a-zA-Z0-9#]+;", " "))
    words = pages.select(F.explode(F.split(plain, r"[^a-z]+")).alias("word"))
    return words.filter(F.length("word").between(2, LONGEST)).groupBy("word").agg(F.count("*").alias("n"))


def segmented(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """(host, words) for distinct hosts: labels and dashes divide first, then Viterbi. `counts` is read twice."""
    names = F.array_distinct(F.filter(F.split("host", r"[^a-z]+"), lambda x: F.length(x) > 1))

    def pieces(x: Column) -> Column:
        starts = F.sequence(F.lit(1), F.length(x) - 1)
        return F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.least(F.lit(LONGEST), F.length(x) - i + 1))), lambda n: F.substring(x, i, n))))

    subs = hosts.select("host", F.explode(F.array_distinct(F.flatten(F.transform(names, pieces)))).alias("word"))
    total = counts.filter(F.col("n") >= LEAST_COUNT).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    known = subs.join(counts.filter(F.col("n") >= LEAST_COUNT), "word").groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("known"))  # a host's own substrings: bounded by its length
    rows = hosts.join(known, "host", "left").select("host", F.map_entries("known").alias("known"))
    size = int(total.first().total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = []
            for host, known in zip(batch.column("host").to_pylist(), batch.column("known").to_pylist()):
                table = {e["key"]: e["value"] for e in known or ()}
                words.append([w for name in re.findall(r"[a-z]+|[0-9]+|[^\x00-\x7f]+", host) for w in (split_name(name, table, max(size, 1)) if name.isascii() and name.isalpha() else [name])])
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(words, pa.list_(pa.string()))], ["host", "words"])

    return rows.mapInArrow(run, "host string, words array<string>")


def path_words(path: Column) -> Column:
    """The words of a path, lower-cased; a number stands as its length."""
    words = F.filter(F.split(F.lower(path), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    return F.transform(words, lambda x: F.when(x.rlike("^[0-9]+$"), F.concat(F.lit("#"), F.length(x).cast("string"))).otherwise(x))


def judged(pages: DataFrame, id: str = "page_id", url: str = "url", body: str = "html", rules=RULES, seeds=SEEDS) -> DataFrame:
    """(id, host, path, rule, verdict, words, log_odds) per page; log_odds are those of block against allow.

    Null urls and urls without :// have an empty host and path and no words: their odds are the prior. Even odds allow, as
    does training in which one class is missing. Repeated rows count each in training. An empty table gives an empty
    result.
    """
    host, path = parts(url)
    rows = pages.select(F.col(id).alias("id"), host.alias("host"), path.alias("path"))
    fit = rule_of(F.col("host"), F.col("path"), rules)
    hosts = staged(segmented(rows.select("host").distinct(), staged(word_counts(pages, body), "counts")), "hosts")
    # Urls alike in host, path words and rule verdict are counted together: one row per kind, with its number of pages.
    shape = path_words(F.col("path"))
    kinds = rows.groupBy("host", shape.alias("shape"), fit["verdict"].alias("given")).agg(F.count("*").alias("n")).join(hosts, "host")
    named = F.array(*map(F.lit, named_by(rules))).cast("array<string>")
    words = F.filter(F.concat("words", "shape"), lambda w: ~F.array_contains(named, w))
    kinds = kinds.select("host", "shape", "n", "given", words.alias("words"))
    bad = F.when(F.col("given").isNotNull(), F.col("given") == "block").otherwise(F.arrays_overlap("words", F.array(*map(F.lit, seeds)).cast("array<string>")) & (F.size("words") > 0))
    kinds = staged(kinds.withColumn("bad", bad), "kinds")
    each = F.when(F.col("bad"), F.col("n")).otherwise(0), F.when(F.col("bad"), 0).otherwise(F.col("n"))
    sums = staged(kinds.select("n", "bad", F.explode("words").alias("word")).groupBy("word").agg(F.sum(each[0]).alias("b"), F.sum(each[1]).alias("a")), "words")
    t = sums.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("a"), F.coalesce(F.sum("b"), F.lit(0)).alias("b"), F.count("*").alias("v")).first()
    pages_of = kinds.agg(F.coalesce(F.sum(each[1]), F.lit(0)).alias("a"), F.coalesce(F.sum(each[0]), F.lit(0)).alias("b")).first()
    both = bool(pages_of.a and pages_of.b)
    prior = math.log(pages_of.b / pages_of.a) if both else 0.0
    weight = F.lit(0.0) if not both else F.log((F.col("b") + SMOOTH) / (t.b + SMOOTH * max(t.v, 1))) - F.log((F.col("a") + SMOOTH) / (t.a + SMOOTH * max(t.v, 1)))
    alike = kinds.groupBy("host", "shape").agg(F.first("words").alias("words"))  # the words follow from host and shape
    odds = alike.select("host", "shape", F.posexplode("words").alias("at", "word")).join(sums.select("word", weight.alias("w")), "word")
    odds = odds.groupBy("host", "shape").agg(F.sum(F.col("w").cast("decimal(30,12)")).cast("double").alias("log_odds"))  # decimal: the sum's order doesn't matter
    known = staged(alike.join(odds, ["host", "shape"], "left").select("host", "shape", "words", (F.coalesce("log_odds", F.lit(0.0)) + prior).alias("log_odds")), "odds")
    out = rows.withColumn("shape", shape).join(known, ["host", "shape"]).withColumn("fit", fit)
    verdict = F.coalesce("fit.verdict", F.when(F.col("log_odds") > 0, F.lit("block")).otherwise(F.lit("allow")))
    return out.select(F.col("id").alias(id), "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "words", "log_odds")
