"""Quotes in texts: where they stand, with tolerance for case and white space; passages around words."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import automaton
from ..session import staged

#: Words of a quote that are looked for where the whole isn't found.
HEAD_WORDS = 8


def flat(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def pattern(quote: Column) -> Column:
    """A regular expression of a quote's words, white space of any kind between them, in either case."""
    words = F.filter(F.split(F.trim(quote), r"\s+"), lambda w: w != "")
    return F.concat(F.lit("(?iu)"), F.array_join(F.transform(words, lambda w: F.regexp_replace(w, r"([\\.+*?()\[\]{}|^$-])", r"\\$1")), r"\s+"))


def located(docs: DataFrame, quotes: DataFrame) -> DataFrame:
    """(quote_id, doc_id, start, end, form) of quotes in texts, as offsets in the text itself. `docs`: doc_id, text;
    `quotes`: quote_id, quote, a stated set.

    A quote is looked for exactly, then with any case and white space, then, if it has more than HEAD_WORDS words, by its
    first HEAD_WORDS; form says which was found first. Texts are met by the rarest inner word of each form, so no text
    meets all quotes; forms of one or two words, which have no inner word, are found by an automaton over all of them. What
    may be met is known by ids first; texts are fetched for those ids alone, once.
    """
    words = F.split(flat("quote"), " ")
    whole = quotes.select("quote_id", F.lit(0).alias("form"), F.trim("quote").alias("quote")).filter("quote <> ''")
    raw_words = F.split(F.trim("quote"), r"\s+")
    head = quotes.filter(F.size(words) > HEAD_WORDS).select("quote_id", F.lit(1).alias("form"), F.array_join(F.slice(raw_words, 1, HEAD_WORDS), " ").alias("quote"))
    forms = staged(whole.union(head).withColumn("flat", flat("quote")), "forms")
    inner = F.slice(F.split("flat", " "), 2, F.greatest(F.size(F.split("flat", " ")) - 2, F.lit(0)))
    terms = forms.select("quote_id", "form", F.explode(F.array_distinct(inner)).alias("term"))
    bodies = docs.select("doc_id", flat("text").alias("body"))
    postings = bodies.select("doc_id", F.explode(F.array_distinct(F.split("body", " "))).alias("term")).join(terms.select("term").distinct(), "term", "left_semi")
    postings = staged(postings, "postings")
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    rare = terms.join(df, "term", "left").groupBy("quote_id", "form").agg(F.min_by("term", F.struct(F.coalesce("df", F.lit(0)), "term")).alias("term"))
    met = rare.join(postings, "term").select("quote_id", "form", "doc_id")
    short = forms.filter(F.size(F.split("flat", " ")) <= 2).select("quote_id", "form", "flat")
    if not short.isEmpty():
        near = automaton.found(bodies, "doc_id", "body", short.select("flat").distinct().withColumn("phrase", F.col("flat")), "flat", "phrase")
        met = met.union(near.join(short, "flat").select("quote_id", "form", "doc_id"))
    met = staged(met.join(forms, ["quote_id", "form"]), "met")
    texts = docs.join(met.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "text", flat("text").alias("body"))
    met = met.join(texts, "doc_id").filter(F.col("body").contains(F.col("flat")))
    exact = F.expr("locate(quote, text)") - 1
    tolerant = F.regexp_instr("text", pattern(F.col("quote"))) - 1
    n = F.when((F.col("form") == 0) & (exact >= 0), F.length("quote")).otherwise(F.length(F.regexp_substr("text", pattern(F.col("quote")))))
    start = F.when((F.col("form") == 0) & (exact >= 0), exact).otherwise(tolerant)
    name = F.when(F.col("form") == 1, "head").when(exact >= 0, "exact").otherwise("tolerant")
    rows = met.select("quote_id", "doc_id", "form", start.cast("long").alias("start"), n.cast("long").alias("n"), name.alias("name")).filter("start >= 0")
    best = rows.groupBy("quote_id", "doc_id").agg(F.min(F.struct("form", "start", "n", "name")).alias("b"))
    return best.select("quote_id", "doc_id", F.col("b.start").alias("start"), (F.col("b.start") + F.col("b.n")).alias("end"), F.col("b.name").alias("form"))


def passages(text: Column | str, needles: Column | str, window: int = 900, most: int = 3) -> Column:
    """Up to `most` windows of a text around its mentions of the needles, in their order, none within another; the text's
    beginning where nothing is mentioned."""

    def cut(t: str, words: list[str]) -> list[str]:
        low, found = t.lower(), []
        for word in words:
            at = low.find(word) if word else -1
            while at >= 0 and len(found) < most:
                piece = t[max(0, at - window // 2) : at + window // 2].strip()
                if piece and not any(piece in f or f in piece for f in found):
                    found.append(piece)
                at = low.find(word, at + len(word))
        return found or [t[:window]]

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series, lists: pd.Series) -> pd.Series:
        return pd.Series([cut(t or "", [(w or "").lower().strip() for w in ([] if ws is None else ws)]) for t, ws in zip(texts, lists)])

    return run(text, needles)
