"""Quality rules whose cutoffs bound the good documents they cost: exact binomial tests on labelled holdouts.

Every rule has a fixed grid of cutoffs. Labelled rows fall into two halves by id. The first half puts the cutoffs into
one order: those that reject the fewest good rows first, more bad ones before fewer, and only cutoffs that add a larger
share of the bad rows than of the good ones. Rejecting by the first t cutoffs together is hypothesis t of a stratum. The
other half tests them: with n good holdouts of a stratum, k of them rejected, "at most ``alpha`` of the good rows are
lost" is accepted where P(Binomial(n, alpha) <= k) is at most ``delta`` / strata, the same as an upper
Clopper-Pearson bound of at most ``alpha``. Inside a stratum the hypotheses are tested in their order up to the first
that fails (a fixed sequence needs no correction); over the strata ``delta`` is shared out (Bonferroni). So with
probability 1 - delta no stratum loses more than ``alpha`` of its good rows that pass the base rules. A stratum
with too few labelled rows for a proof gets no cutoffs.

All work is DataFrame functions; words, lines and windows are arrays inside a row. Windows that differ by hash differ;
only a text with equal hashes is compared by its words, so counts are exact.

Defined cases: a null or empty text has zeros and fails the base rules; equal rows are kept or dropped alike and count
once as labelled rows; several labels of an id count as their smallest; null ids, ids and labels without a partner are not
labelled; a null stratum is a stratum; without labels the base rules decide; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..runtime import cut, small

SPACES = r"\x20\x09-\x0D"
WORD, SYMBOL = f"[^{SPACES}]+", "[#*$%&|<>]"

# Cutoffs by rule from loose to strict, in thousandths. A rule rejects above its cutoff, short_words below.
CUTOFFS = {
    "symbols": [500, 400, 300, 200, 150, 100, 70, 50, 30, 20, 10],
    "dup_lines": [500, 400, 300, 200, 150, 100],
    "repeats": [450, 400, 350, 300, 250, 200, 150, 100],
    "long_words": [12000, 11000, 10000, 9000, 8000, 7500, 7000, 6500],
    "short_words": [3000, 3500, 4000],
}
PARTS = {"symbols": ("n_symbols", "word_chars"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"),
         "long_words": ("word_chars", "n_words"), "short_words": ("word_chars", "n_words")}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
LEAST_WORDS, MOST_REPEATED = 50, 50
ALPHA, DELTA = 0.05, 0.05


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of three which the list holds twice or more."""
    n = F.greatest(F.size(words) - 2, F.lit(0))
    windows = F.arrays_zip(F.slice(words, 1, n), F.slice(words, 2, n), F.slice(words, 3, n))

    def covered(w: Column) -> Column:
        placed = F.sort_array(F.transform(w, lambda x, i: F.struct(x["0"].alias("a"), x["1"].alias("b"), x["2"].alias("c"), i.alias("i"))))
        same = lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])
        reach = lambda x: [x["i"], x["i"] + 1, x["i"] + 2]
        twins = _let(placed, lambda s: F.zip_with(
            F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1),
            lambda x, y: F.when(same(x, y), F.array(*reach(x), *reach(y))).otherwise(F.array().cast("array<int>"))))
        return F.size(F.array_distinct(F.flatten(twins)))

    def count(w: Column) -> Column:
        hashes = F.transform(w, lambda x: F.xxhash64(x))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(w), F.lit(0)).otherwise(covered(w))

    return _let(windows, count)


def text_counts(docs: DataFrame, carry: list[str], text: str = "text") -> DataFrame:
    """The counts that the rules read, and whether the base rules fail, next to the columns of ``carry``."""
    body = F.coalesce(F.col(text), F.lit(""))
    split = docs.select(
        *carry, F.size(F.regexp_extract_all(body, F.lit(f"({SYMBOL})"))).cast("long").alias("n_symbols"),
        F.regexp_extract_all(body, F.lit(f"({WORD})")).alias("_words"),
        F.filter(F.split(body, "\n", -1), lambda x: x.rlike(f"[^{SPACES}]")).alias("_lines"))
    long = lambda c: c.cast("long")
    counted = split.select(
        *carry, long(F.size("_words")).alias("n_words"), long(F.length(F.concat_ws("", "_words"))).alias("word_chars"), "n_symbols",
        long(F.size("_lines")).alias("n_lines"), long(F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        long(repeated_words(F.col("_words"))).alias("n_repeat_words"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def beyond(rule: str, cutoff: int) -> Column:
    part, whole = PARTS[rule]
    value, limit = 1000 * F.col(part), cutoff * F.col(whole)
    return (value < limit) if rule == "short_words" else (value > limit)


def log_gamma(x: Column) -> Column:
    """Stirling's series at x + 8, for x of 1 or more."""
    y = x + 8.0
    series = 1 / (12 * y) - 1 / (360 * F.pow(y, 3)) + 1 / (1260 * F.pow(y, 5)) - 1 / (1680 * F.pow(y, 7))
    rising = x
    for k in range(1, 8):
        rising = rising * (x + float(k))
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - F.log(rising)


def binomial_lower(n: Column, k: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k) for k below n p, 1 from there on (no test accepts it).

    Terms are added from k downwards; below the mean they fall, and 40 standard deviations end the sum.
    """
    n, k = n.cast("double"), k.cast("double")
    top = F.exp(log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    steps = F.sequence(F.lit(0), F.least(k, F.ceil(40 * F.sqrt(n * p)) + 40).cast("int"))

    def add(acc: Column, i: Column) -> Column:
        here, j = acc["term"], k - i
        return F.struct((here * j * (1 - p) / ((n - j + 1) * p)).alias("term"), (acc["sum"] + here).alias("sum"))

    total = F.aggregate(steps, F.struct(top.alias("term"), F.lit(0.0).alias("sum")), add, lambda acc: acc["sum"])
    return F.when(k < n * p, total).otherwise(1.0)


def first_step(path: list[tuple[str, int]]) -> Column:
    """1-based place of the first cutoff of ``path`` that rejects a row; null for none."""
    if not path:
        return F.lit(None).cast("int")
    return F.coalesce(*[F.when(beyond(rule, cutoff), F.lit(k)) for k, (rule, cutoff) in enumerate(path, 1)])


def order_cutoffs(learning: DataFrame) -> list[tuple[str, int]]:
    """Cutoffs in the order of the test, from rows with the counts and ``good``. The grid bounds what is collected."""
    grid = [(rule, c) for rule, cutoffs in CUTOFFS.items() for c in cutoffs]
    names = [f"{kind}_{k}" for kind in ("good", "bad") for k in range(len(grid))]
    sums = [F.count_if(is_kind & beyond(*g)) for is_kind in (F.col("good"), ~F.col("good")) for g in grid]
    seen = learning.agg(*[s.alias(n) for s, n in zip(sums, names)]).first().asDict()
    places = sorted(range(len(grid)), key=lambda k: (seen[f"good_{k}"], -seen[f"bad_{k}"], k))
    order = [grid[k] for k in places]
    added = {r["step"]: r for r in learning.groupBy(first_step(order).alias("step")).agg(
        F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")).collect()}
    n_good, n_bad = (sum(r[kind] for r in added.values()) for kind in ("good", "bad"))
    return [g for k, g in enumerate(order, 1) if k in added and added[k]["bad"] * n_good > added[k]["good"] * n_bad]


def certify(holdouts: DataFrame, stratum: str, path: list[tuple[str, int]], alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Per stratum: n good holdouts, steps (cutoffs of the path that the tests accept), lost (holdouts they reject)."""
    good = holdouts.where("good").select(stratum, first_step(path).alias("step"))
    lost = F.array(*[F.count_if(F.col("step") <= k) for k in range(1, len(path) + 1)]).cast("array<long>")
    hits = cut(good.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"), lost.alias("lost")))
    share = delta / max(hits.count(), 1)
    fails = F.transform("lost", lambda k: binomial_lower(F.col("n"), k, alpha) > share)
    first = F.array_position(fails, F.lit(True)).cast("int")
    steps = F.when(first > 0, first - 1).otherwise(F.lit(len(path)))
    return hits.select(stratum, "n", "lost", steps.alias("steps")).select(
        stratum, "n", "steps", F.when(F.col("steps") > 0, F.get("lost", F.col("steps") - 1)).otherwise(0).alias("lost"))


def learning_half(key: str) -> Column:
    return F.ascii(F.md5(F.col(key).cast("string").cast("binary"))) % 2 == 0


def apply_rules(docs: DataFrame, labels: DataFrame, key: str = "doc_id", stratum: str = "lang", text: str = "text",
                label: str = "quality", alpha: float = ALPHA, delta: float = DELTA) -> tuple[DataFrame, DataFrame, list[tuple[str, int]]]:
    """Rows with key, counts, base_failed, step (first cutoff beyond, null for none) and kept; the certified steps by
    stratum; and the cutoffs in their order."""
    named = docs.select(F.col(key).alias("_key"), F.col(stratum).alias("_stratum"), F.col(text).alias("_text"))
    counted = cut(text_counts(named, ["_key", "_stratum"], "_text"))
    marks = labels.where(F.col(label).isNotNull()).groupBy(F.col(key).alias("_key")).agg((F.min(label) == 1).alias("good"))
    labelled = cut(counted.where("NOT base_failed").join(marks, "_key").distinct())
    path = order_cutoffs(labelled.where(learning_half("_key")))
    if path:
        proofs = cut(certify(labelled.where(~learning_half("_key")), "_stratum", path, alpha, delta))
    else:
        proofs = labelled.where("false").select("_stratum", F.lit(0).cast("long").alias("n"), F.lit(0).alias("steps"), F.lit(0).cast("long").alias("lost"))
    joined = counted.withColumn("step", first_step(path)).alias("d").join(
        small(proofs.select(F.col("_stratum").alias("_of"), "steps")), F.col("_stratum").eqNullSafe(F.col("_of")), "left")
    kept = ~F.col("base_failed") & (F.col("step").isNull() | (F.col("step") > F.coalesce("steps", F.lit(0))))
    rows = joined.select(F.col("_key").alias(key), *COUNTS, "base_failed", "step", kept.alias("kept"))
    return rows, proofs.withColumnRenamed("_stratum", stratum), path
