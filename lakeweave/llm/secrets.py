"""Secret scan with character Markov models, in DataFrame expressions only.

Fixed patterns give the base spans. The method then takes every run of 20 or more
key-like characters (shorter bare keys are missed, see README) and compares two first-order character models, one of random
strings and one of ordinary identifiers, by log-likelihood ratio. Both models come
from labelled samples; they are two arrays of 95 x 95 transition scores, so the
scoring expression stays inside the JVM without any join.

Defined results: null text counts as empty; a text without spans has n_* = 0,
an empty spans string and the digest of the empty string; rows are independent,
so repeated rows repeat their result; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import places, table

KINDS = ("assign", "access", "hex", "markov")
VALUE = "A-Za-z0-9+/_.=-"
#: kind -> (pattern, group whose length counts, least length)
BASE = {
    "assign": (rf"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([{VALUE}]+)""", 1, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
#: Maximal runs that are too short are never matches of these kinds, and none starts inside them:
#: asking for the least length in the pattern finds the same spans without listing the short runs.
FAST = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
#: Cheap conditions that every match meets, tried before the pattern itself.
GATE = {"assign": r"""[DdTtNnYy]["']?\x20*[:=]"""}
#: The look-behind only spares attempts inside a run; a match is a whole run either way.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
FIRST, SIDE = 32, 95


@dataclass(frozen=True)
class MarkovModel:
    """Log-likelihood ratio (random against identifier) of each character pair, row-major over codes 32-126."""

    ratio: tuple[float, ...]


def labelled_samples(docs: DataFrame, per_class: int = 4000, sample_docs: int = 256) -> DataFrame:
    """(token, random): random strings of common key alphabets, and identifiers made of words.

    Random strings are digests of a counter. Identifiers join neighbouring ASCII words of the
    documents with the `sample_docs` smallest hashes of doc_id (a documented bound; the pair tables have
    9025 cells), as snake_case, kebab-case, camelCase and paths, each once.
    """
    spark = docs.sparkSession
    digest = F.sha2(F.col("id").cast("string"), 256)
    dense = F.regexp_replace(F.base64(F.unhex(digest)), "=", "")
    random = spark.range(per_class).select(
        F.when(F.col("id") % 4 == 0, F.substring(digest, 1, 32))
        .when(F.col("id") % 4 == 1, F.substring(dense, 1, 40))
        .when(F.col("id") % 4 == 2, F.upper(F.substring(F.regexp_replace(dense, "[+/]", "Z"), 1, 24)))
        .otherwise(F.translate(dense, "+/", "-_"))
        .alias("token"),
        F.lit(True).alias("random"),
    )
    # The smallest hashes first, then their texts: no task gathers texts from all others.
    smallest = docs.select(F.xxhash64("doc_id").alias("h")).distinct().orderBy("h").limit(sample_docs)
    picked = docs.where(F.col("text").isNotNull()).join(F.broadcast(smallest), F.xxhash64("doc_id") == F.col("h")).select("text")
    words = picked.select(F.filter(F.split("text", r"[^A-Za-z]+"), lambda w: F.length(w) > 1).alias("w"))
    triple = F.expr("transform(sequence(1, greatest(size(w) - 2, 1), 3), i -> slice(w, i, 3))")
    parts = words.where(F.size("w") >= 3).select(F.explode(triple).alias("p")).where(F.size("p") == 3).distinct()
    style = F.abs(F.xxhash64("p")) % 4
    plain = parts.select(
        F.when(style == 0, F.lower(F.concat_ws("_", "p")))
        .when(style == 1, F.lower(F.concat_ws("-", "p")))
        .when(style == 2, F.concat_ws("", F.transform("p", lambda x: F.initcap(x))))
        .otherwise(F.concat_ws("/", "p"))
        .alias("token"),
        F.lit(False).alias("random"),
    )
    # Common identifiers, so that a table without words still gives a model.
    stock = spark.range(1).select(F.explode(F.array(*map(F.lit, STOCK))).alias("token"), F.lit(False).alias("random"))
    return random.unionByName(plain).unionByName(stock)


#: Ordinary identifiers of program text.
STOCK = """
get_user_account_by_identifier applicationConfigurationManager maximum_number_of_connections_per_host content-security-policy
DEFAULT_CONNECTION_TIMEOUT createReadableStreamFromResponse request_handler_registration numberOfRetriesRemaining
transaction-isolation-level src/main/resources/application InternationalizationService usr/local/share/documentation
validate_certificate_chain MAX_BUFFER_SIZE_IN_BYTES parseQueryParameters should_return_empty_list_when_missing
org/example/project/internal background-color-transition updateCustomerShippingAddress is_feature_flag_enabled
AbstractDatabaseConnectionFactory write_temporary_file_to_disk image-processing-pipeline-worker resolveDependencyVersions
compute_weighted_average_score HTTP_STATUS_NOT_FOUND home/developer/workspace/service serializeObjectToString
previous_month_revenue_total enable-experimental-feature ThreadPoolExecutorService check_file_permissions_before_open
convertTimestampToLocalDate lib/python/site-packages/module number_of_active_sessions generateRandomIdentifier
remote-procedure-call-handler UNIT_TEST_COVERAGE_REPORT calculateMonthlyPayment test_case_with_invalid_argument
getElementsByClassName horizontal_scroll_position virtual-machine-configuration initialize_logging_framework
""".split()


def train_markov(samples: DataFrame, backoff: float = 20.0) -> MarkovModel:
    """Transition scores from (token, random); at most 2 x 9025 counts reach the driver.

    A row of a table leans on its class's character frequencies with the weight of `backoff` pairs.
    """
    pairs = samples.where(F.length("token") >= 2).select(
        "random", F.explode(F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda i: F.substring(F.col("token"), i, 2))).alias("pair")
    )
    codes = pairs.select("random", F.ascii("pair").alias("a"), F.ascii(F.substring("pair", 2, 1)).alias("b"))
    known = codes.where(F.col("a").between(FIRST, FIRST + SIDE - 1) & F.col("b").between(FIRST, FIRST + SIDE - 1))
    counts = {True: {}, False: {}}
    for r in known.groupBy("random", "a", "b").count().collect():
        counts[r["random"]][(r["a"] - FIRST, r["b"] - FIRST)] = r["count"]
    tables = {}
    for label, own in counts.items():
        total, second = [0] * SIDE, [0.5] * SIDE
        for (a, b), n in own.items():
            total[a] += n
            second[b] += n
        base = [x / sum(second) for x in second]
        tables[label] = [math.log((own.get((a, b), 0) + backoff * base[b]) / (total[a] + backoff)) for a in range(SIDE) for b in range(SIDE)]
    return MarkovModel(tuple(x - y for x, y in zip(tables[True], tables[False], strict=True)))


def log_ratio(token: Column, model: MarkovModel) -> Column:
    """Sum of pair ratios of a token of printable ASCII, as a double."""
    # One folded constant: thousands of single literals would cost seconds of planning.
    table = F.split(F.lit(",".join(f"{x:.6g}" for x in model.ratio)), ",").cast("array<double>")

    # Every character once: a substring by its number would be sought from the start each time.
    codes = F.transform(F.filter(F.split(token, ""), lambda c: F.length(c) > 0), lambda c: F.ascii(c) - FIRST)

    def step(acc, c):
        inside = c.between(0, SIDE - 1) & acc["last"].between(0, SIDE - 1)
        return F.struct((acc["sum"] + F.when(inside, F.get(table, acc["last"] * SIDE + c)).otherwise(0.0)).alias("sum"), c.alias("last"))

    return F.aggregate(codes, F.struct(F.lit(0.0).alias("sum"), F.lit(-1).alias("last")), step, lambda acc: acc["sum"])


def _spans(text: Column, kind: str, pattern: str, keep) -> Column:
    """'kind:start:end' strings, each after a comma, of the matches for which keep(match) holds; places in code points."""
    show = lambda start, end: F.concat(F.lit(f"{kind}:"), start.cast("string"), F.lit(":"), end.cast("string"))
    gate = text.rlike(GATE[kind]) & text.rlike(pattern) if kind in GATE else text.rlike(pattern)
    return F.when(gate, places(text, F.lit(pattern), F.length, keep, show)).otherwise(F.lit(""))


def _parse(listed: Column) -> Column:
    """Spans as structs (start, kind number, end), sorted by start, then kind."""
    parts = F.filter(F.split(listed, ","), lambda s: F.length(s) > 0)
    names = F.array(*map(F.lit, KINDS))

    def one(s):
        f = F.split(s, ":")
        return F.struct(F.get(f, F.lit(1)).cast("int").alias("start"), F.array_position(names, F.get(f, F.lit(0))).cast("int").alias("kind"), F.get(f, F.lit(2)).cast("int").alias("end"))

    return F.array_sort(F.transform(parts, one))


def _join(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, model: MarkovModel, least_ratio: float = 12.0, least_per_char: float = 0.4) -> DataFrame:
    """Per row: doc_id, base (array of spans), added (spans of the method outside base spans)."""
    text = F.col("text")
    d = docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    pattern, group, least = BASE["assign"]
    lists = [_spans(text, "assign", pattern, lambda h: F.length(F.regexp_extract(h, pattern, group)) >= least)]
    lists += [_spans(text, kind, FAST[kind], lambda h: F.lit(True)) for kind in ("access", "hex")]

    def strange(h):
        return log_ratio(h, model) >= F.greatest(F.lit(least_ratio), least_per_char * F.length(h))

    found = d.select("doc_id", _parse(F.concat(*lists)).alias("base"), _parse(_spans(text, "markov", CANDIDATE, strange)).alias("random"))
    return found.select(
        "doc_id", "base",
        F.filter("random", lambda r: ~F.exists("base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"]))).alias("added"),
    )


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_secrets(docs, train_markov(labelled_samples(docs)))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind) + 1)).cast("long").alias(f"n_{kind}")
    every = F.array_sort(F.concat("base", "added"))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_join(F.col("base")), 256).alias("base_sha256"), _join(every).alias("spans"), F.size("added").cast("long").alias("n_markov"))
