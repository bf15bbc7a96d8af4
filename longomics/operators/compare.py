"""Comparing result sets: confusion matrices, set overlaps, Jaccard, cross-cohort direction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.tails import binomial_half


def ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(0.0)


def confusion(predicted: DataFrame, truth: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Confusion counts and rates over genes present on both sides.

    ``predicted``: by..., gene_id, is_significant; ``truth``: gene_id, is_de.
    """
    keys = by or []
    j = predicted.join(truth.select("gene_id", "is_de"), "gene_id")
    p, d = F.col("is_significant"), F.col("is_de")
    a = j.groupBy(*keys).agg(
        F.count_if(p & d).alias("tp"), F.count_if(p & ~d).alias("fp"),
        F.count_if(~p & d).alias("fn"), F.count_if(~p & ~d).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    sens, prec = ratio(tp, tp + fn), ratio(tp, tp + fp)
    return a.select(*keys, "tp", "fp", "fn", "tn", sens.alias("sensitivity"), ratio(tn, tn + fp).alias("specificity"),
                    prec.alias("precision"), ratio(fp, fp + tp).alias("fdr"),
                    ratio(2 * prec * sens, prec + sens).alias("f1"), ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"))


def overlap(sets: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """Intersection and union sizes over all result sets, and their overall Jaccard index."""
    keys = by or []
    members = sets.select(*keys, name, "gene_id").distinct()
    total = sets.select(*keys, name).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n_sets"))
    per_gene = members.groupBy(*keys, "gene_id").agg(F.count(F.lit(1)).alias("k"))
    per_gene = per_gene.join(total, keys) if keys else per_gene.crossJoin(F.broadcast(total))
    a = per_gene.groupBy(*keys).agg(
        F.max("n_sets").alias("n_sets"), F.count_if(F.col("k") == F.col("n_sets")).alias("n_common"),
        F.count(F.lit(1)).alias("n_union"))
    return a.withColumn("jaccard", ratio(F.col("n_common"), F.col("n_union")))


def pairwise_overlap(sets: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """Shared genes and Jaccard of every two result sets.

    Genes are reduced to their set-membership pattern first, so pairs are formed once per distinct
    pattern (at most 2^sets of them), never per gene.
    """
    keys = by or []
    pattern = (sets.select(*keys, name, "gene_id").distinct().groupBy(*keys, "gene_id")
               .agg(F.sort_array(F.collect_list(name)).alias("p"))
               .groupBy(*keys, "p").agg(F.count(F.lit(1)).alias("n")))
    sizes = pattern.select(*keys, F.explode("p").alias(name), "n").groupBy(*keys, name).agg(F.sum("n").alias("size"))
    pairs = pattern.select(*keys, "n", F.explode(F.flatten(F.transform(
        "p", lambda a: F.transform(F.filter("p", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("q"))
    shared = pairs.groupBy(*keys, F.col("q.a").alias("set_a"), F.col("q.b").alias("set_b")).agg(F.sum("n").alias("n_shared"))
    left = sizes.select(*keys, F.col(name).alias("set_a"), F.col("size").alias("size_a"))
    right = sizes.select(*keys, F.col(name).alias("set_b"), F.col("size").alias("size_b"))
    both = left.join(right, keys) if keys else left.crossJoin(right)
    out = both.where("set_a < set_b").join(shared, [*keys, "set_a", "set_b"], "left").fillna(0, ["n_shared"])
    union = F.col("size_a") + F.col("size_b") - F.col("n_shared")
    return out.select(*keys, "set_a", "set_b", "size_a", "size_b", "n_shared", ratio(F.col("n_shared"), union).alias("jaccard"))


def cross_cohort(here: DataFrame, there: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Direction agreement of two gene -> direction tables with a two-sided binomial p-value."""
    keys = by or []
    a = here.select(*keys, "gene_id", F.col("direction").alias("da"))
    b = there.select(*keys, "gene_id", F.col("direction").alias("db"))
    j = a.join(b, [*keys, "gene_id"], "full")
    both = F.col("da").isNotNull() & F.col("db").isNotNull()
    c = j.groupBy(*keys).agg(
        F.count_if(both).alias("n_common"), F.count_if(both & (F.col("da") == F.col("db"))).alias("n_agree"),
        F.count_if(both & (F.col("da") != F.col("db"))).alias("n_disagree"),
        F.count_if(F.col("db").isNull()).alias("only_here"), F.count_if(F.col("da").isNull()).alias("only_there"))
    some = F.col("n_common") > 0
    return c.select("*", F.when(some, F.col("n_agree") / F.col("n_common")).alias("agreement_fraction"),
                    F.when(some, binomial_half("n_agree", "n_common")).alias("binomial_p"))
