"""Personal data: fixed forms, and identifiers that bootstrapped contexts find."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plume.llm.common import KEYS, SPACES, by_keys, discard, stored, with_keys
from plume.llm.spans import beside, count_of, let, listing, masked, matches, valid

KINDS = ("email", "ip", "card", "phone", "context")
# possessive, and only from where a run of their characters or the last match ends, so that time grows with the text
# and nothing is recursive
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
# a whole run of digits and single separators that holds 14 to 19 digits
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = r"^0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"
#: An instance: a number in parentheses with what is before and after, or three groups of digits or more, or a string with a digit or @.
MENTION = (
    r"(?<![^\x20\x09-\x0D])(?:(?:\+?[0-9]{1,3}[\x20.-]?)?\([0-9]++\)[\x20.-]?[0-9][0-9.-]*+[^\x20\x09-\x0D]*+"
    r"|\+?[0-9]{1,4}(?:\x20[0-9]{2,4}+(?![^\x20\x09-\x0D])){2,}+|[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+)"
)
#: Words of a context on each side.
CONTEXT_WORDS = 3
#: Marks around an identifier that aren't part of it.
EDGE = r"[\"'`*#$%&!?,;:.|<>()\[\]{}]"
ROUNDS = 3
#: A pattern discovers if it has this score, and counts with this many different instances.
LEAST_SCORE = 0.8
LEAST_INSTANCES = 5
#: Seeds among them at least.
LEAST_SEEDS = 4
#: A context after finds strings of shapes of which contexts before find this share.
SHAPE_SHARE = 0.5


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the digits of ``number`` pass Luhn's test."""
    back = F.regexp_extract_all(F.reverse(number), F.lit("[0-9]"), F.lit(0))
    worth = F.transform(back, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(worth, F.lit(0), lambda a, x: a + x) % 10 == 0


def base_spans(text: Column) -> Column:
    """email, ip, card and phone spans."""
    email = matches(text, EMAIL, 0, text.contains("@"))
    ip = valid(matches(text, IP, 1, text.rlike("[0-9]\\.[0-9]")), lambda m: F.forall(F.split(m, "\\."), lambda p: p.rlike(BYTE)))
    card = valid(matches(text, CARD, 2, text.rlike("[0-9][\\x20-]?[0-9]")), lambda m: luhn(digits(m)))
    phone = valid(matches(text, PHONE, 3, text.contains("+")), lambda m: F.length(digits(m)).between(10, 15))
    return F.concat(email, ip, card, phone)


def mentions(text: Column, base: Column) -> Column:
    """Instances: start, end, match, near (the base span beside) and the words before and after, which may be instances, too."""

    def around(gaps: Column) -> Column:
        spans = F.transform(matches(text, MENTION, 4), lambda s: s)
        words = lambda part: F.filter(F.split(part, SPACES), lambda w: w != "")

        def one(all_: Column) -> Column:
            def context(s: Column, i: Column) -> Column:
                left = F.concat_ws(" ", F.coalesce(F.get(all_, i - 1)["match"], F.lit("")), F.get(gaps, i))
                right = F.concat_ws(" ", F.get(gaps, i + 1), F.coalesce(F.get(all_, i + 1)["match"], F.lit("")))
                before = let(words(left), lambda w: F.slice(w, F.greatest(F.size(w) - CONTEXT_WORDS + 1, F.lit(1)), F.lit(CONTEXT_WORDS)))
                return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match"), s["near"].alias("near"), before.alias("before"), F.slice(words(right), 1, CONTEXT_WORDS).alias("after"))

            return F.transform(all_, context)

        return let(beside(spans, base), one)

    none = F.array().cast("array<struct<start:int,end:int,match:string,near:struct<start:int,kind:int,end:int,match:string>,before:array<string>,after:array<string>>>")
    return F.when(text.rlike("[0-9@]"), let(F.split(text, MENTION, -1), around)).otherwise(none)


def graph(found: DataFrame) -> DataFrame:
    """The pattern-instance edges: keys, pattern, instance, start, end, seed.

    A pattern is one to three lower-case words before (<) or after (>) an
    instance, or the word on each side; digits in them are one 9. A mention
    in a base span stands for the whole span, a seed, and only has
    the context beyond it. Marks at the edges of other instances are cut off.
    """
    edges = found.filter(F.size("mentions") > 0).select(*KEYS, F.explode("mentions").alias("m"))
    seed = F.coalesce(F.col("m.near.end") > F.col("m.start"), F.lit(False))
    edges = edges.withColumn("seed", seed)
    before = F.when(~F.col("seed") | (F.col("m.start") <= F.col("m.near.start")), F.col("m.before")).otherwise(F.array().cast("array<string>"))
    after = F.when(~F.col("seed") | (F.col("m.end") >= F.col("m.near.end")), F.col("m.after")).otherwise(F.array().cast("array<string>"))
    plain = lambda words: F.transform(words, lambda w: F.regexp_replace(F.lower(w), "[0-9]+", "9"))
    lead, tail = F.length(F.regexp_extract("m.match", f"^{EDGE}*", 0)), F.length(F.regexp_extract("m.match", f"(?<!{EDGE}){EDGE}*+$", 0))
    lead, tail = F.when(F.col("m.match").rlike(r"^\(?\+?[0-9]"), 0).otherwise(lead), tail
    core = F.substring(F.col("m.match"), lead + 1, F.greatest(F.length("m.match") - lead - tail, F.lit(0)))
    edges = edges.select(
        *KEYS, "seed", F.when(F.col("seed"), F.col("m.near.match")).otherwise(core).alias("instance"),
        (F.col("m.start") + lead).alias("start"), (F.col("m.end") - tail).alias("end"), plain(before).alias("b"), plain(after).alias("a"),
    )
    b, a = F.col("b"), F.col("a")
    patterns = []
    for k in range(1, CONTEXT_WORDS + 1):
        patterns.append(F.when(F.size(b) >= k, F.concat(F.lit("< "), F.array_join(F.slice(b, F.size(b) - k + 1, F.lit(k)), " "))))
    for k in range(1, CONTEXT_WORDS + 1):
        patterns.append(F.when(F.size(a) >= k, F.concat(F.lit("> "), F.array_join(F.slice(a, 1, k), " "))))
    patterns.append(F.when((F.size(a) > 0) & (F.size(b) > 0), F.concat_ws(" ", F.lit("<>"), F.get(b, F.size(b) - 1), F.get(a, F.lit(0)))))
    edges = edges.withColumn("pattern", F.explode(F.array(*patterns))).filter("pattern is not null and instance <> ''")
    return edges.select(*KEYS, "pattern", "instance", "start", "end", "seed")


def identifies(instance: Column) -> Column:
    """Whether a string has the form of an identifier: 5 digits or more, or letters and digits, or @ and a name."""
    n, letters = F.length(digits(instance)), instance.rlike(r"\p{L}")
    handle = instance.rlike(r"^[^\p{L}0-9@]*@[\p{L}0-9_.-]*\p{L}") | instance.rlike(r"[\p{L}0-9]@[\p{L}0-9]")
    return F.when(letters, handle | ((n >= 2) & (F.length(F.regexp_replace(instance, r"[^\p{L}0-9]", "")) >= 5))).otherwise(n >= 5)


def shape_of(instance: Column) -> Column:
    """Digits as 9, letters as a, runs cut to one, and the marks between them."""
    return F.regexp_replace(F.regexp_replace(instance, r"\p{L}+", "a"), "[0-9]+", "9")


#: Parts that rows of a frequent pattern or instance are dealt to.
SALTS = 16


def salted(rows: DataFrame, facts: DataFrame, key: str, by: str) -> DataFrame:
    """``rows`` joined with ``facts``, which has one row per ``key``; rows of one key are dealt to parts by ``by``."""
    rows = rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    facts = facts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(facts, [key, "salt"]).drop("salt")


def score_patterns(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """pattern, score, instances: the patterns of the pattern-instance graph.

    Seeds have confidence 1. In each round a pattern's score is the sum of
    the confidence of its different instances over their number and one
    (few instances say little), and an instance that is no seed gets the
    score of its best pattern of ``LEAST_INSTANCES`` or more. Edges are summed per (pattern,
    instance) first, and seeds per pattern once and for all, so that a
    frequent instance is few rows.
    """
    pairs = edges.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"))
    pairs = stored(pairs, "pairs")
    fixed = pairs.groupBy("pattern").agg(F.count("*").alias("instances"), F.sum(F.col("seed").cast("int")).alias("seeds"))
    fixed = stored(fixed.filter(F.col("instances") >= LEAST_INSTANCES), "seeds")
    open_ = stored(salted(pairs.filter(~F.col("seed")).select("pattern", "instance"), fixed.filter("seeds > 0").select("pattern"), "pattern", "instance"), "open")
    discard(pairs)
    scores = fixed.select("pattern", "instances", "seeds", (F.col("seeds") / (F.col("instances") + 1)).alias("score"))
    for _ in range(rounds):
        scored = salted(open_, scores.select("pattern", "score"), "pattern", "instance")
        belief = scored.groupBy("instance").agg(F.max("score").alias("belief"))
        gained = salted(open_, belief, "instance", "pattern").groupBy("pattern").agg(F.sum("belief").alias("gain"))
        old = scores
        scores = fixed.join(gained, "pattern", "left")
        scores = stored(scores.select("pattern", "instances", "seeds", ((F.col("seeds") + F.coalesce("gain", F.lit(0.0))) / (F.col("instances") + 1)).alias("score")), "scores")
        if hasattr(old, "stored_path"):
            discard(old)
    discard(fixed, open_)
    return scores


def find_personal(docs: DataFrame) -> DataFrame:
    """Personal data in every row of ``docs`` (doc_id, text).

    Returns doc_id, the row's keys, base and spans: base has the fixed forms; spans
    also what contexts find: strings of an identifier's form that no base
    span overlaps, in a context of one to three words before, or of a word
    on each side, that in the whole corpus stands nearly always at personal
    data, whatever the string's shape; or before words that nearly always
    follow it, if the shape is one that such strings mostly have. Forms have
    no greatest length; e-mails, numbers of cards and others that the fixed
    forms refuse can be found by their contexts, too.

    A null text counts as empty. Rows are told apart by doc_id and text, so
    equal rows get equal spans; an empty table gives an empty
    result. Only built-in functions are used.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    df = with_keys(docs.select("doc_id", "text")).select("doc_id", *KEYS, text.alias("text"), base_spans(text).alias("base"))
    found = stored(df.select("doc_id", *KEYS, "base", mentions(F.col("text"), F.col("base")).alias("mentions")), "personal")
    edges = stored(graph(found), "mentions")
    scores = score_patterns(edges)
    good = scores.filter((F.col("score") >= LEAST_SCORE) & (F.col("seeds") >= LEAST_SEEDS)).select("pattern")
    fresh = salted(edges.filter(~F.col("seed") & identifies(F.col("instance"))), good, "pattern", "instance").withColumn("shape", shape_of(F.col("instance")))
    fresh = stored(fresh, "fresh")
    shapes = fresh.groupBy("shape").agg(F.avg(F.col("pattern").startswith("<").cast("double")).alias("share")).filter(F.col("share") >= SHAPE_SHARE)
    fresh = fresh.filter(F.col("pattern").startswith("<")).unionByName(fresh.join(shapes.select("shape"), "shape", "left_semi"))
    span = F.struct(F.col("start").cast("int").alias("start"), F.lit(4).alias("kind"), F.col("end").cast("int").alias("end"), F.col("instance").alias("match"))
    fresh = stored(fresh.groupBy(*KEYS).agg(F.collect_set(span).alias("more")), "contexts")
    same = (F.col("id_key") == F.col("of_id")) & (F.col("text_key") == F.col("of_text"))
    out = found.drop("mentions").join(fresh.withColumnsRenamed({"id_key": "of_id", "text_key": "of_text"}), same, "left")
    return out.select("doc_id", *KEYS, "base", F.when(F.col("more").isNull(), F.col("base")).otherwise(F.concat("base", "more")).alias("spans"))


def personal(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans of :func:`find_personal`."""
    found = find_personal(docs)
    return found.select(
        "doc_id",
        *[count_of(F.col("base"), k).alias(f"n_{KINDS[k]}") for k in range(4)],
        F.sha2(listing(F.col("base"), KINDS), 256).alias("base_sha256"),
        listing(F.col("spans"), KINDS).alias("spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of its texts replaced by its kind; all columns stay.

    Overlapping spans are replaced by the kind of the first. Only texts with
    spans are joined with them; the others pass unchanged, null texts too.
    """
    found = find_personal(docs).filter(F.size("spans") > 0).select(*KEYS, "spans")
    found = stored(found.dropDuplicates(KEYS), "found")
    whole = with_keys(docs.select("doc_id", "text", F.struct(*docs.columns).alias("row")))
    rest = by_keys(whole, found.select(*KEYS), "left_anti").select("row.*")
    clean = masked(F.col("text"), F.col("spans"), KINDS)
    out = by_keys(whole, found.select(*KEYS), "left_semi").join(found, KEYS)
    return rest.union(out.select(*[clean.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns]))
