"""Secrets: fixed forms, and strings that a battery of randomness tests finds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plume.llm.common import stored
from plume.llm.spans import apart, count_of, let, listing, matches, valid

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
# an access key or hex run is a maximal run, so its least length can be part of the pattern
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
#: Runs of one character class.
CLASS_RUNS = r"[0-9]+|[A-Z]+|[a-z]+|[^0-9A-Za-z]+"
#: Encodings by the characters that they use, the first that fits counts: name, pattern, letters of the alphabet,
#: and how many of them are digits, capitals, small letters and others.
ENCODINGS = (
    ("small hex", "^[0-9a-f]+$", (10, 0, 6, 0)),
    ("capital hex", "^[0-9A-F]+$", (10, 6, 0, 0)),
    ("small base32", "^[a-z2-7]+$", (6, 0, 26, 0)),
    ("base32", "^[A-Z2-7]+$", (6, 26, 0, 0)),
    ("small alphanumeric", "^[a-z0-9]+$", (10, 0, 26, 0)),
    ("capital alphanumeric", "^[A-Z0-9]+$", (10, 26, 0, 0)),
    ("alphanumeric", "^[A-Za-z0-9]+$", (10, 26, 26, 0)),
    ("base64", "", (10, 26, 26, 2)),
)
#: Of the strings that the battery rejects, the expected share that is random all the same.
LOST_SHARE = 0.01
#: Expected share of natural strings among those found.
FALSE_SHARE = 0.001
#: Least evidence against a natural string, as minus the log10 of its p value, whatever the corpus.
LEAST_EVIDENCE = 3.0
#: Bounds of the share of class changes in natural strings: a corpus with few strings says nothing better.
NATURAL_RATE = (0.005, 0.2)
LENGTH_CLASSES = (20, 28, 40, 64)


def base_spans(text: Column) -> Column:
    """assign, access and hex spans."""
    assign = valid(matches(text, ASSIGN, 0), lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 8)
    return F.concat(assign, matches(text, ACCESS, 1, text.contains("AKIA")), matches(text, HEX, 2))


def upper_tail(z: Column) -> Column:
    """1 - Phi(z) for z >= 0 (Abramowitz and Stegun 26.2.17)."""
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-z * z / 2) * 0.3989422804014327 * poly


def two_sided(z: Column) -> Column:
    return 2 * upper_tail(F.least(F.abs(z), F.lit(30.0)))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def battery(token: Column) -> Column:
    """The p value of three tests of randomness together: three times the least, 1 at most.

    Uniformity: chi-squared of the letters of the inferred encoding's
    alphabet, as a normal deviate by Wilson and Hilferty, both tails (a string that
    names each letter once isn't random, either). Runs: the number of runs of one character
    class against its mean and deviation. Serial correlation: of
    neighbouring character codes.
    """

    def facts(t: Column) -> Column:
        code = F.lit(len(ENCODINGS))
        for k in range(len(ENCODINGS) - 2, -1, -1):
            code = F.when(t.rlike(ENCODINGS[k][1]), k + 1).otherwise(code)
        classes = F.element_at(F.array(*[F.array(*[F.lit(float(x)) for x in own]) for _, _, own in ENCODINGS]), code)
        letters = F.regexp_extract_all(t, F.lit("."), F.lit(0))
        counts = F.transform(F.array_distinct(letters), lambda c: (F.length(t) - F.length(F.replace(t, c, F.lit("")))).cast("double"))
        codes = F.transform(letters, lambda c: F.ascii(c).cast("double"))
        runs = F.regexp_count(t, F.lit(CLASS_RUNS)).cast("double")
        return F.struct(F.length(t).cast("double").alias("n"), classes.alias("classes"), total(classes).alias("size"), counts.alias("counts"), codes.alias("codes"), runs.alias("runs"))

    def tests(f: Column) -> Column:
        n, df = f["n"], f["size"] - 1
        chi = total(F.transform(f["counts"], lambda c: c * c)) * f["size"] / n - n
        deviate = (F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        uniform = let(deviate, two_sided)
        change = 1 - total(F.transform(f["classes"], lambda c: (c / f["size"]) * (c / f["size"])))
        runs = let(change, lambda q: two_sided((f["runs"] - 1 - (n - 1) * q) / F.sqrt((n - 1) * q * (1 - q))))
        centred = let(total(f["codes"]) / n, lambda mean: F.transform(f["codes"], lambda c: c - mean))
        product = lambda d: F.zip_with(d, F.slice(d, F.lit(2), F.size(d)), lambda x, y: x * F.coalesce(y, F.lit(0.0)))
        serial = let(centred, lambda d: let(total(F.transform(d, lambda c: c * c)), lambda v: F.when(v > 0, two_sided(total(product(d)) / v * F.sqrt(n))).otherwise(0.0)))
        return F.least(F.lit(1.0), 3 * F.least(uniform, runs, serial))

    return let(F.regexp_replace(token, "=+$", ""), lambda t: let(facts(t), tests))


def natural_log_p(token: Column, rate: Column) -> Column:
    """Minus the log10 of Chernoff's bound for so many class changes in natural strings.

    ``rate`` is the share of neighbours of different classes in the middle
    one of the corpus's natural strings.
    """
    n = F.greatest(F.length(token) - 1, F.lit(1)).cast("double")
    x = F.least((F.regexp_count(token, F.lit(CLASS_RUNS)) - 1) / n, F.lit(0.999))
    kl = x * F.log(F.greatest(x, F.lit(1e-9)) / rate) + (1 - x) * F.log((1 - x) / (1 - rate))
    return F.when(x > rate, n * kl / F.log(F.lit(10.0))).otherwise(0.0)


def length_class(token: Column) -> Column:
    n = F.length(token)
    return sum((F.when(n >= k, 1).otherwise(0) for k in LENGTH_CLASSES), F.lit(0))


def discovery_limits(candidates: DataFrame, evidence: str, share: float) -> dict[int, float]:
    """For each length class the least evidence at which the expected false share is ``share`` (Benjamini and Hochberg).

    ``evidence`` names a column of minus the log10 of p values. It is
    counted in tenths up to 60, so a few thousand rows reach the driver
    whatever the corpus. A class without discoveries has no limit.
    """
    counted = candidates.groupBy("size", F.least(F.floor(F.col(evidence) * 10), F.lit(600)).alias("tenth")).count()
    rows: dict[int, list] = {}
    for size, tenth, n in counted.collect():
        rows.setdefault(size, []).append((tenth, n))
    limits = {}
    for size, found in rows.items():
        total_, above = sum(n for _, n in found), 0
        for tenth, n in sorted(found, reverse=True):
            above += n
            if 10 ** (-tenth / 10) * total_ <= share * above:
                limits[size] = tenth / 10
    return limits


def beyond(evidence: Column, size: Column, limits: dict[int, float]) -> Column:
    """Whether evidence reaches the limit of its length class."""
    bar = F.lit(float("inf"))
    for k, limit in limits.items():
        bar = F.when(size == k, F.lit(limit)).otherwise(bar)
    return F.floor(evidence * 10) / 10 >= bar


def find_secrets(docs: DataFrame) -> DataFrame:
    """Secrets in every row of ``docs`` (doc_id, text).

    Columns: doc_id, base (spans of fixed forms), spans (with
    those that the tests add). Candidates are strings of 20 or more encoding
    characters that no base span overlaps. Each gets two p values: that of
    the battery if it were random, and that of its changes of character
    class if it were natural, as the strings of the corpus are. Benjamini
    and Hochberg's procedure runs on both within classes of length: a
    candidate is added if it is among those discovered not to be natural
    (false share ``FALSE_SHARE``, and evidence of ``LEAST_EVIDENCE`` at least)
    and not among those discovered not to be random (``LOST_SHARE``).

    The texts are scanned once; spans are written to the shared folder. A
    null text counts as empty. Equal rows get equal spans; an empty table
    gives an empty result. Only built-in functions are used.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    scanned = docs.select("doc_id", text.alias("text"))
    scanned = scanned.select("doc_id", base_spans(F.col("text")).alias("base"), matches(F.col("text"), CANDIDATE, 3).alias("found"))
    tested = lambda c: F.struct(*[c[x].alias(x) for x in ("start", "kind", "end", "match")], (-F.log10(F.greatest(battery(c["match"]), F.lit(1e-60)))).alias("not_random"))
    found = F.when(F.size("found") > 0, F.transform(apart(F.col("found"), F.col("base"), 3), tested))
    scanned = stored(scanned.select("doc_id", "base", F.coalesce(found, F.array().cast("array<struct<start:int,kind:int,end:int,match:string,not_random:double>>")).alias("found")), "secrets")
    candidates = scanned.select(F.explode("found").alias("c")).select(F.col("c.match").alias("token"), "c.not_random").withColumn("size", length_class(F.col("token")))
    random = discovery_limits(candidates, "not_random", LOST_SHARE)
    # natural strings are those that the battery rejects, each counted once
    natural = candidates.filter(beyond(F.col("not_random"), F.col("size"), random)).select("token").distinct()
    changes = (F.regexp_count("token", F.lit(CLASS_RUNS)) - 1) / (F.length("token") - 1)
    middle = natural.agg(F.percentile_approx(changes, 0.5, 1000)).first()[0] or 0.0
    rate = F.lit(float(min(NATURAL_RATE[1], max(NATURAL_RATE[0], middle))))
    judged = candidates.select("size", natural_log_p(F.col("token"), rate).alias("not_natural"))
    natural = discovery_limits(judged, "not_natural", FALSE_SHARE)

    def secret(c: Column) -> Column:
        size, evidence = length_class(c["match"]), natural_log_p(c["match"], rate)
        return (evidence >= LEAST_EVIDENCE) & beyond(evidence, size, natural) & ~beyond(c["not_random"], size, random)

    added = F.transform(F.filter("found", secret), lambda c: F.struct(*[c[x].alias(x) for x in ("start", "kind", "end", "match")]))
    return scanned.select("doc_id", "base", F.concat("base", added).alias("spans"))


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of :func:`find_secrets`."""
    found = find_secrets(docs)
    return found.select(
        "doc_id",
        *[count_of(F.col("base"), k).alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(listing(F.col("base"), KINDS), 256).alias("base_sha256"),
        listing(F.col("spans"), KINDS).alias("spans"),
    )
