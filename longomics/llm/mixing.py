"""Mixing sources to target weights by Pareto order sampling.

A document's expected copies are ``target * weight / sum(weight * size)`` over its source. The whole part is taken for
certain; for the fraction p the document draws U from a hash of its id and is ranked by the odds of U over the odds of
p, small ratios first. Each source takes its ranked documents up to the words that the certain copies leave open, so
the sample has a fixed size in words and misses the target by at most half a document.

Targets: sources in code point order (null last) weigh as ``weights`` repeats and share all words; none gets more
than ``max_copies`` times its own words, the excess is shared again by weight.

Ranks come from a range partition by (source, ratio) and carried block sums, so a source holding a third of all rows
is spread over many tasks. Only the weight total and the capped total of the sources reach the driver.

Defined cases: a null or blank text has size 0 and takes 0; a null source is a source of its own; a null id draws as
the empty id; rows with one id are ranked each for itself, equal rows are interchangeable; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..operators import ordered
from ..runtime import cut

SALTS = 64
WORDS = "[^\\x20\\x09-\\x0D]+"


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long")


def uniform(key: str) -> Column:
    """Number in (0, 1) from the first 52 bits of the md5 of the id as text."""
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), max_copies: int = 3) -> DataFrame:
    """source, source_size, target: all words shared by weight, each source at most ``max_copies`` times its own."""
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size")) \
        .withColumn("_none", F.col("source").isNull())
    ranked = ordered.row_numbers(per_source, [], ["_none", "source"], "_rank")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    table = cut(ranked.select("source", "source_size", weight.cast("long").alias("w")))
    cap, capped, level = F.col("source_size") * max_copies, -1, 0.0
    while True:
        full = cap < F.lit(level) * F.col("w")
        row = table.agg(F.sum(F.when(full, 1).otherwise(0)).alias("n"), F.sum("source_size").alias("total"),
                        F.sum(F.when(full, cap).otherwise(0)).alias("taken"),
                        F.sum(F.when(~full, F.col("w")).otherwise(0)).alias("open")).first()
        if not row["total"] or row["n"] == capped:
            break
        capped, level = row["n"], (row["total"] - row["taken"]) / row["open"]
    return table.select("source", "source_size",
                        F.least(F.lit(level) * F.col("w"), cap.cast("double")).alias("target"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weight: str | None = None,
        weights: Sequence[int] = (1, 2, 3), max_copies: int = 3, carry: Sequence[str] = ()) -> DataFrame:
    """One row per input row: key, size, source_size, target, copies, taken (size times copies).

    ``weight`` names a positive column of unequal inclusion inside a source; ``carry`` columns pass through.
    """
    extra = {f"_x{k}": name for k, name in enumerate(carry)}
    sizes = cut(docs.select(
        F.col(key).alias("_key"), F.col(source).alias("source"), word_count(text).alias("size"),
        uniform(key).alias("_u"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_w"),
        *[F.col(name).alias(out) for out, name in extra.items()]))
    targets = source_targets(sizes, weights, max_copies)
    mass = sizes.groupBy("source").agg(F.sum(F.col("_w") * F.col("size")).alias("_mass"))
    plan = targets.join(mass, targets["source"].eqNullSafe(mass["source"])).drop(mass["source"])
    # A source may hold a third of all rows: rows are dealt by (source, salt) and the short plan is repeated per salt.
    dealt = sizes.withColumn("_salt", F.pmod(F.xxhash64("_key", "_u", "size"), F.lit(SALTS)))
    short = plan.withColumnRenamed("source", "_src").withColumn("_turn", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = dealt.join(short, F.col("source").eqNullSafe(F.col("_src")) & (F.col("_salt") == F.col("_turn"))) \
        .drop("_src", "_salt", "_turn")
    expected = F.when(F.col("_mass") > 0, F.least(F.col("target") * F.col("_w") / F.col("_mass"), F.lit(float(max_copies)))).otherwise(0.0)
    sure = F.floor("_e").cast("long")
    odds = (F.col("_u") / (1 - F.col("_u"))) / (F.col("_p") / (1 - F.col("_p")))
    ratio = F.when(F.col("_p") > 0, odds).otherwise(F.lit(float("inf")))
    rows = (joined.withColumn("_e", expected).withColumn("_sure", sure).withColumn("_p", F.col("_e") - F.col("_sure"))
            .withColumn("_q", ratio).withColumn("_certain", F.col("_sure") * F.col("size")).drop("_e", "_w", "_u", "_mass")
            # The scan joins its carries on the group, where a null would meet nothing.
            .withColumn("_of", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))))
    order = ["_q", "_key", "size"]
    placed = ordered.scan(ordered.block_order(rows, ["_of"], order), ["_of"], order,
                          {"_upto": ("sum", "size"), "_given": ("sum", "_certain")}, totals={"_all": "_given"})
    more = (F.col("_p") > 0) & (2 * F.col("_upto") - F.col("size") <= 2 * (F.col("target") - F.col("_all")))
    copies = F.col("_sure") + more.cast("long")
    return placed.select(F.col("_key").alias(key), "size", "source_size", "target", copies.alias("copies"),
                         (copies * F.col("size")).alias("taken"),
                         *[F.col(out).alias(name) for out, name in extra.items()])
