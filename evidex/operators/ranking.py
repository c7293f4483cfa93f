"""Query analysis and ranking: intents, entities, type names, taxonomy paths, 19 signals, and the staged retrieval.

Questions are a stated set, small beside the items; what they need from the items (subjects, pools) is found by equi-joins
on words, and signals are plain columns over the pool's rows. A score is the sum of its recorded signals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import staged
from . import retrieval as R

#: Intents by priority, with the patterns that give them away.
CUES = {
    "listing": [r"^which\b", r"^what [a-z -]+ (are|is) (only )?(available|supported|included|allowed)", r"\blist (of|the|all)\b"],
    "limitation": [r"\b(risks?|limitations?|restrictions?|caveats?|drawbacks?|pitfalls?|cannot|can't|not (supported|allowed))\b", r"\b(must not|mustn't|should not|shouldn't|avoid)\b"],
    "comparison": [r"\b(difference|differ|versus|vs\.?|compared? (to|with)|instead of|rather than)\b"],
    "example": [r"\bexamples?\b", r"\bsample\b", r"\bshow me\b"],
    "syntax": [r"\bsyntax\b", r"\bsignature\b", r"\bparameters?\b", r"\barguments?\b"],
    "version": [r"\bversion\b", r"\bsince\b", r"\bavailable in\b", r"\bonly (available|in)\b", r"\bdeprecated\b"],
    "error": [r"\berror\b", r"\bexception\b", r"\bmessage\b"],
    "troubleshooting": [r"\btroubleshoot", r"\bnot working\b", r"\bfails?\b", r"\b(isn't|doesn't|won't|can't|does not|is not) (work|refresh|load|connect|start|appear)"],
    "procedure": [r"^how (do|to|can|should)\b", r"\bsteps?\b", r"\bset ?up\b", r"\bcreate\b", r"\bconfigure\b"],
    "configuration": [r"\b(setting|configuration|option|enable|disable)s?\b"],
    "architecture": [r"\b(architecture|design|schema|topology|components?)\b"],
    "definition": [r"^what (is|are|does|do)\b", r"\bdefin(e|ition)\b", r"\bmean(s|ing)?\b"],
    "conceptual": [r"^why\b", r"^how (does|do|is|are)\b", r"^when (is|are|should|do|does)\b", r"\bexplain\b", r"\bconcept\b", r"\brecommended\b"],
}
#: The types, roles and polarities of items that an intent prefers.
PREFERRED = {
    "listing": {"types": ["fact", "limitation"]},
    "definition": {"roles": ["foundation"], "types": ["definition"]},
    "conceptual": {"roles": ["foundation"], "types": ["definition", "fact", "best_practice"]},
    "procedure": {"roles": ["dependent"], "types": ["procedure", "best_practice"]},
    "configuration": {"roles": ["dependent"], "types": ["procedure"]},
    "limitation": {"polarity": ["negative"]},
    "troubleshooting": {"polarity": ["negative"], "types": ["procedure"]},
    "error": {"polarity": ["negative"]},
    "example": {"roles": ["example"]},
    "syntax": {"roles": ["foundation"], "types": ["definition", "example"]},
    "version": {"types": ["fact", "limitation"]},
    "comparison": {"roles": ["foundation"], "types": ["definition", "fact", "best_practice"]},
    "architecture": {"roles": ["foundation"], "types": ["definition", "best_practice"]},
}
#: What a signal adds to a score.
WEIGHTS = {
    "fusion": 0.6, "entity_subject": 0.020, "entity_mention": 0.005, "concept_coverage": 0.020, "intent_affinity": 0.006, "type_match": 0.006, "member": 0.006,
    "topic_affinity": 0.008, "authority": 0.005, "verification": 0.002, "official": 0.001, "version_match": 0.004, "version_mismatch": -0.006, "candidate": -0.008,
    "stale": -0.006, "conflicted": -0.004, "needs_review": -0.004, "needs_revalidation": -0.002, "validator_failed": -0.004,
}
#: Words that an entity of several words neither begins nor ends with.
FUNCTION_WORDS = "a an the of in on for to by with and or is are was were be do does did what which how why when where".split()
#: Intents that ask about the subject itself.
ABOUT = ["definition", "conceptual", "syntax", "comparison", "architecture"]
#: Lexical weights of an item's fields.
FIELDS = {"subject": 1.0, "statement": 0.4, "explanation": 0.2, "topic": 0.1}
#: Patterns of identifiers, as tokens and as whole subjects.
UPPER, CAMEL = r"^[A-Z][A-Z0-9_.]{2,}$", r"^[A-Z][a-z]+(?:[A-Z][A-Za-z0-9]+)+$"
MEMBER = r"^(?:[A-Z][A-Z0-9_.]{2,}|[A-Z][a-z]+(?:[A-Z][A-Za-z0-9]+)+)(?: \(.*\))?$"
VERSION = r"(?i)\b(?:v(?:ersion)?\s*)?(\d{4}|\d+\.\d+(?:\.\d+)?)\b"
WORD = "([a-z0-9][a-z0-9+#.-]*)"


def plain(query: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(query), r"\s+", " "))


def intent(query: Column | str, declared: dict[str, list[str]] | None = None) -> Column:
    """The first intent by priority of which a cue occurs; a domain's declared cues are tried before the core's."""
    q = plain(query)
    found = []
    for cues in (declared or {}, CUES):
        for name in CUES:
            hit = F.lit(False)
            for cue in cues.get(name, []):
                hit = hit | q.rlike(cue)
            if cues.get(name):
                found.append(F.when(hit, name))
    return F.coalesce(*found)


def version(query: Column | str) -> Column:
    """A year or dotted number, where the question speaks of a version."""
    found = F.regexp_extract(query, VERSION, 1)
    return F.when(plain(query).contains("version") & (found != ""), found)


def stemmed(text: Column) -> Column:
    """Distinct lower-cased words, crudely stemmed: the first of ing, ies, es, s, ed goes from words of over five letters."""
    w = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(1))
    return F.array_distinct(F.transform(w, _stem))


def _stem(w: Column) -> Column:
    n, out = F.length(w), w
    for suffix in reversed(("ing", "ies", "es", "s", "ed")):
        cut = F.substring(w, F.lit(1), n - len(suffix))
        out = F.when((n > 5) & w.endswith(suffix), F.concat(cut, F.lit("y")) if suffix == "ies" else cut).otherwise(out)
    return out


def grams(questions: DataFrame, most: int = 4) -> DataFrame:
    """(query, low, written): n-grams of one to `most` tokens and at least two characters, as first written."""
    t = F.col("tokens")

    def of(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.struct((i * 10 + n).alias("at"), F.array_join(F.slice(t, i, n), " ").alias("g")))

    rows = questions.select("query", X.tokens("text").alias("tokens"))
    parts = [F.when(F.size(t) >= n, of(n)) for n in range(1, most + 1)]
    exploded = rows.select("query", F.explode(F.flatten(F.array_compact(F.array(*parts)))).alias("x")).filter(F.length("x.g") >= 2)
    return exploded.groupBy("query", F.lower("x.g").alias("low")).agg(F.min_by("x.g", "x.at").alias("written"))


def entities(questions: DataFrame, items: DataFrame, most: int = 4) -> DataFrame:
    """(query, low, text, canonical, kind, n_items, weight, common). `questions`: query, text; `items`: live ones' subject.

    An n-gram is an entity if it is a subject, or if it has several words, six characters and no function word at its ends
    and begins subjects. What lies within another entity goes, but for identifiers, which are always entities.
    """
    subjects = items.groupBy(F.lower("subject").alias("low")).agg(F.min("subject").alias("canonical"), F.count("*").alias("n"))
    g = grams(questions, most)
    exact = g.join(subjects, "low").select("query", "low", "written", "canonical", F.lit("subject").alias("kind"), F.col("n").alias("n_items"))
    ends = (~F.substring_index("low", " ", 1).isin(FUNCTION_WORDS)) & (~F.substring_index("low", " ", -1).isin(FUNCTION_WORDS))
    several = g.filter(F.col("low").contains(" ") & (F.length("low") >= 6) & ends).join(exact.select("query", "low"), ["query", "low"], "left_anti")
    words = F.split("low", " ")
    begun = subjects.select("n", F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.least(F.size(words) - 1, F.lit(most)))), lambda k: F.when(k < F.size(words), F.array_join(F.slice(words, 1, k), " ")))).alias("low")).filter("low IS NOT NULL").groupBy("low").agg(F.sum("n").alias("n"))
    prefix = several.join(begun, "low").select("query", "low", "written", F.col("written").alias("canonical"), F.lit("prefix").alias("kind"), F.col("n").alias("n_items"))
    tokens = questions.select("query", F.explode(F.array_distinct(X.tokens("text"))).alias("written")).filter(F.col("written").rlike(UPPER) | F.col("written").rlike(CAMEL))
    named = tokens.groupBy("query", F.lower("written").alias("low")).agg(F.min("written").alias("_id"))
    found = exact.union(prefix).join(named, ["query", "low"], "full_outer")
    rows = found.select("query", "low", F.coalesce("written", "_id").alias("text"), F.coalesce("canonical", "_id").alias("canonical"), F.when(F.col("_id").isNotNull(), "identifier").otherwise(F.col("kind")).alias("kind"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.col("canonical").isNotNull().alias("_found"))
    others = F.collect_list(F.when(F.col("_found"), F.col("low"))).over(Window.partitionBy("query"))  # a question's own entities, a bounded list
    rows = rows.withColumn("_all", others).filter((F.col("kind") == "identifier") | ~F.exists("_all", lambda o: (o != F.col("low")) & o.contains(F.col("low"))))
    share = 1 / (1 + F.log2(F.greatest(F.col("n_items"), F.lit(1)).cast("double")))
    weight = F.when(F.col("kind") == "identifier", F.greatest(share, F.lit(0.8))).when(F.col("text").rlike("[ -]"), share).otherwise(share * 0.5)
    return rows.select("query", "low", "text", "canonical", "kind", "n_items", weight.alias("weight"), (weight < 0.2).alias("common"))


def entity_channel(found: DataFrame, items: DataFrame, most: int = 30) -> DataFrame:
    """(query, id, entity, entity_rank): at most `most` items per entity whose subject it is, by confidence and id."""
    rows = found.select("query", F.lower("canonical").alias("entity")).distinct().join(items.select("id", "confidence", F.lower("subject").alias("entity")), "entity")
    w = Window.partitionBy("query", "entity").orderBy(F.desc("confidence"), "id")
    return rows.withColumn("entity_rank", F.row_number().over(w)).filter(F.col("entity_rank") <= most).select("query", "id", "entity", "entity_rank")


def type_terms(types: DataFrame) -> DataFrame:
    """(knowledge_type, terms): the words of three letters or more in a type's name, label and prefix."""
    words = F.array_distinct(F.filter(X.words(F.regexp_replace(F.concat_ws(" ", "knowledge_type", "label", "prefix"), "_", " ")), lambda w: F.length(w) >= 3))
    return types.select("knowledge_type", words.alias("terms"))


def matching_paths(terms: DataFrame, paths: DataFrame, rare: float = 4.0) -> DataFrame:
    """(query, path): taxonomy paths of which every word of the last part begins, or is begun by, a term of the question,
    and that have two such words or only rare ones. `terms`: query, term, idf; `paths`: path, a declared list."""
    leaf = F.filter(stemmed(F.element_at(F.split("path", "/"), -1)), lambda t: F.length(t) > 2)
    words = paths.select(F.lower("path").alias("path"), leaf.alias("leaf")).filter(F.size("leaf") > 0).select("path", F.size("leaf").alias("n"), F.explode("leaf").alias("word"))
    # Terms that begin alike share their first three letters, so those are the key.
    left = terms.withColumn("key", F.substring("term", 1, 3)).filter(F.length("term") >= 3)
    pairs = words.withColumn("key", F.substring("word", 1, 3)).join(left, "key").filter(F.col("word").startswith(F.col("term")) | F.col("term").startswith(F.col("word")))
    best = pairs.groupBy("query", "path", "n", "word").agg(F.max("idf").alias("idf"))
    full = best.groupBy("query", "path", "n").agg(F.count("*").alias("hit"), F.min("idf").alias("least"))
    return full.filter((F.col("hit") == F.col("n")) & ((F.col("n") >= 2) | (F.col("least") >= rare))).select("query", "path")


def affine(found: Column, knowledge_type: Column, role: Column, polarity: Column, declared: dict[str, list[str]] | None = None) -> Column:
    """Whether an item is of a type, polarity or role that the intent prefers; a domain may declare an intent's types."""
    out = F.lit(False)
    for name in {**PREFERRED, **(declared or {})}:
        want = {"types": declared[name]} if declared and name in declared else PREFERRED[name]
        hit = F.lit(False)
        for key, column in (("types", knowledge_type), ("roles", role), ("polarity", polarity)):
            if want.get(key):
                hit = hit | F.coalesce(column.isin(want[key]), F.lit(False))
        out = out | ((found == name) & hit)
    return F.coalesce(out, F.lit(False))


def weighted_postings(items: DataFrame, fields: dict[str, float] = FIELDS) -> DataFrame:
    """(id, term, weight): an item's words with the greatest weight of the fields they stand in."""

    def of(field: str, weight: float) -> Column:
        return F.transform(F.array_distinct(X.words(F.coalesce(field, F.lit("")))), lambda w: F.struct(w.alias("term"), F.lit(weight).alias("weight")))

    each = F.flatten(F.array(*(of(f, k) for f, k in fields.items())))
    return items.select("id", F.explode(each).alias("x")).groupBy("id", "x.term").agg(F.max("x.weight").alias("weight"))


def fielded_channel(terms: DataFrame, posts: DataFrame, k: int) -> DataFrame:
    """(query, id, score, lex_rank): any term matches; the idf-weighted share of the question, each term by its field's
    weight. `terms`: query, term, idf; `posts`: id, term, weight."""
    total = terms.groupBy("query").agg(F.sum("idf").alias("_all"))
    hits = terms.join(posts, "term").groupBy("query", "id").agg(F.sum(F.col("idf") * F.col("weight")).alias("_sum"))
    scored = hits.join(total, "query").select("query", "id", F.round(F.col("_sum") / F.col("_all"), 6).alias("score"))
    return R.top(scored, "query", [F.desc("score"), F.col("id")], k, "lex_rank")


def signals(rows: DataFrame, declared: dict[str, list[str]] | None = None) -> DataFrame:
    """`rows` with a struct of the 19 signals and the score, their sum.

    A row is a question and a candidate. Of the question: intent, version, entities (array of low, kind, weight, common),
    terms (array of term, idf), paths; of the item: subject, statement, topic, knowledge_type, role, polarity, authority,
    level, official, product_version, status, needs_review, needs_revalidation, validator_failed, words (its terms),
    type_terms; of the pool: vec_rank, lex_rank, rare_rank. A signal that doesn't apply is 0.
    """
    w = WEIGHTS
    c = F.col
    about = c("intent").isNull() | c("intent").isin(ABOUT)
    subject_factor = F.when(c("intent") == "listing", 0.2).when(about, 1.0).otherwise(0.5)
    mention_factor = F.when(c("intent") == "listing", 1.2).when(about, 0.4).otherwise(0.8)
    subject = F.lower(F.trim(F.coalesce("subject", F.lit(""))))
    own = F.filter("entities", lambda e: e["low"] == subject)
    opened = F.filter("entities", lambda e: (e["kind"] == "prefix") & subject.startswith(F.concat(e["low"], F.lit(" "))))
    said = F.lower(F.concat_ws(" ", "subject", "statement"))
    named = F.filter("entities", lambda e: ~e["common"] & said.contains(e["low"]))
    best = F.get(F.sort_array(F.transform(named, lambda e: F.struct(e["weight"].alias("weight"), e["low"].alias("low"))), False), 0)
    scale = F.when(best["low"].rlike("[ -]"), F.greatest(best["weight"], F.lit(0.6))).otherwise(best["weight"])
    is_own, is_opened = F.size(own) > 0, F.size(opened) > 0
    mentioned = ~is_own & ~is_opened & (F.size(named) > 0)
    zero = F.lit(0.0)
    terms = F.filter("terms", lambda t: F.length(t["term"]) > 1)
    covered = F.filter(terms, lambda t: F.array_contains("words", t["term"]))

    def idf(a: Column) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda s, t: s + t["idf"])

    best_lexical = F.least("lex_rank", "rare_rank")
    versioned = c("version").isNotNull() & (F.coalesce("product_version", F.lit("")) != "")
    agrees = F.lower("product_version").contains(F.lower("version"))
    topic = F.lower(F.coalesce("topic", F.lit("")))
    made = {
        "fusion": F.coalesce(w["fusion"] / (15 + c("vec_rank")), w["fusion"] * 0.25 / (15 + best_lexical), zero),
        "entity_subject": F.when(is_own, w["entity_subject"] * F.get(own, 0)["weight"] * subject_factor).when(is_opened, w["entity_subject"] * F.get(opened, 0)["weight"] * 0.8 * subject_factor),
        "entity_mention": F.when(mentioned, w["entity_mention"] * scale * mention_factor * 2),
        "member": F.when(mentioned & (c("intent") == "listing") & F.trim("subject").rlike(MEMBER), w["member"]),
        "topic_affinity": F.when(F.exists("paths", lambda p: topic.startswith(p)), w["topic_affinity"]),
        "concept_coverage": F.when(F.size(covered) > 0, w["concept_coverage"] * idf(covered) / idf(terms)),
        "intent_affinity": F.when(affine(c("intent"), c("knowledge_type"), c("role"), c("polarity"), declared), w["intent_affinity"]),
        "type_match": F.when(F.arrays_overlap(F.transform("terms", lambda t: t["term"]), c("type_terms")), w["type_match"]),
        "authority": w["authority"] * c("authority") / 100,
        "verification": w["verification"] * F.least("level", F.lit(4)) / 4,
        "official": F.when(c("official"), w["official"]),
        "version_match": F.when(versioned & agrees, w["version_match"]),
        "version_mismatch": F.when(versioned & ~agrees, w["version_mismatch"]),
        "candidate": F.when(c("status") == "CANDIDATE", w["candidate"]),
        "stale": F.when(c("status") == "STALE", w["stale"]),
        "conflicted": F.when(c("status") == "CONFLICTED", w["conflicted"]),
        "needs_review": F.when(c("needs_review"), w["needs_review"]),
        "needs_revalidation": F.when(c("needs_revalidation"), w["needs_revalidation"]),
        "validator_failed": F.when(c("validator_failed"), w["validator_failed"]),
    }
    struct = F.struct(*(F.round(F.coalesce(made[k], zero), 6).alias(k) for k in WEIGHTS))
    total = zero
    for k in WEIGHTS:
        total = total + F.col(f"signals.{k}")
    return rows.withColumn("signals", struct).withColumn("score", F.round(total, 6))


def ranked(scored: DataFrame, k: int) -> DataFrame:
    """The first k per question by score and id."""
    return R.top(scored, "query", [F.desc("score"), F.col("id")], k, "rank")


def expansion(chosen: DataFrame, found: DataFrame, questions: DataFrame, items: DataFrame, most: int = 3, per_entity: int = 20) -> DataFrame:
    """(query, id, why): at most `most` items beside the chosen ones, for a question's two longest entities: the best
    foundation where none is chosen, a negative item for questions about limits and faults, an example where one is asked
    for. `chosen`: query, id; `found`: entities; `questions`: query, intent; `items`: id, subject, confidence, role, polarity."""
    first = Window.partitionBy("query").orderBy(F.desc(F.length("text")), "text")
    two = found.withColumn("nth", F.row_number().over(first)).filter("nth <= 2").select("query", "nth", F.lower("canonical").alias("entity"))
    of = items.select("id", F.lower("subject").alias("entity"), "confidence", "role", "polarity")
    w = Window.partitionBy("query", "nth").orderBy(F.desc("confidence"), "id")
    pool = two.join(of, "entity").withColumn("at", F.row_number().over(w)).filter(F.col("at") <= per_entity).join(questions.select("query", "intent"), "query")
    pool = pool.join(chosen.select("query", "id", F.lit(True).alias("taken")), ["query", "id"], "left")
    has = F.max(F.coalesce(F.col("taken"), F.lit(False)) & (F.col("role") == "foundation")).over(Window.partitionBy("query", "nth"))
    wants = {
        "foundation": (F.col("role") == "foundation") & ~F.coalesce(F.col("has"), F.lit(False)),
        "negative": (F.col("polarity") == "negative") & F.col("intent").isin("limitation", "troubleshooting", "error"),
        "example": (F.col("role") == "example") & (F.col("intent") == "example"),
    }
    free = pool.withColumn("has", has).filter("taken IS NULL")
    parts = None
    for order, (why, fits) in enumerate(wants.items()):
        one = free.filter(F.coalesce(fits, F.lit(False))).groupBy("query", "nth").agg(F.min_by("id", "at").alias("id")).withColumn("why", F.lit(why)).withColumn("order", F.lit(order))
        parts = one if parts is None else parts.union(one)
    once = parts.withColumn("n", F.row_number().over(Window.partitionBy("query", "id").orderBy("nth", "order"))).filter("n = 1")
    return once.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy("nth", "order"))).filter(F.col("n") <= most).select("query", "id", "why")


def retrieve(pool: DataFrame, questions: DataFrame, items: DataFrame, found: DataFrame, k: int, stage: str = "full", declared: dict[str, list[str]] | None = None) -> DataFrame:
    """(query, id, place, why) of one of the stages rrf, rank, diverse or full, each on what the one before it gives.

    rrf fuses the pool's ranks alone; rank orders by all signals; diverse holds back near copies and crowded subjects; full
    adds the expansion after the chosen. `pool`: query, id, vec_rank, lex_rank, rare_rank; `questions` and `items` with
    what `signals` wants of them, items with a confidence; `found`: entities.
    """
    chosen = F.lit("chosen").alias("why")
    if stage == "rrf":
        fused = pool.select("query", "id", F.round(R.rrf(F.col("vec_rank"), F.col("lex_rank"), F.col("rare_rank")), 9).alias("score"))
        return ranked(fused, k).select("query", "id", F.col("rank").cast("int").alias("place"), chosen)
    scored = signals(pool.join(questions, "query").join(items, "id"), declared)
    if stage == "rank":
        return ranked(scored, k).select("query", "id", F.col("rank").cast("int").alias("place"), chosen)
    lists = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id")))
    subject = F.array_join(F.array_sort(stemmed(F.col("subject"))), " ")
    words = F.transform(stemmed(F.col("statement")), lambda w: F.xxhash64(w))
    best = staged(R.diversified(lists.select("query", "id", "rank", subject.alias("subject"), words.alias("words")), k=k), "chosen")
    if stage == "diverse":
        return best.select("query", "id", "place", chosen)
    more = expansion(best, found, questions, items)
    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.col("why") != "foundation", "why", "id"))
    return best.select("query", "id", "place", chosen).union(more.select("query", "id", (k + nth).cast("int").alias("place"), "why"))
