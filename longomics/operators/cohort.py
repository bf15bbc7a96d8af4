"""Cohort tables: nested case documents, survival, pairs, availability, mutation frequency, catalogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import ordered
from ..functions.text import sample_category
from ..runtime import cut, small


def flat_samples(cases: DataFrame) -> DataFrame:
    """One row per sample of nested case documents; cases without samples give none."""
    diag = F.get("diagnoses", F.lit(0))
    unknown = lambda c: F.coalesce(c, F.lit("unknown"))
    e = cases.select("submitter_id", "demographic", diag.alias("d"), F.explode("samples").alias("s"))
    return e.select(
        F.col("submitter_id").alias("case_id"), F.coalesce("s.submitter_id", F.lit("")).alias("sample_id"),
        unknown(F.col("s.sample_type")).alias("sample_type"), unknown(F.col("demographic.gender")).alias("gender"),
        unknown(F.col("demographic.vital_status")).alias("vital_status"),
        unknown(F.col("d.primary_diagnosis")).alias("primary_diagnosis"), unknown(F.col("d.tumor_stage")).alias("tumor_stage"),
        F.col("d.age_at_diagnosis").alias("age_at_diagnosis_days"), F.col("demographic.days_to_death").alias("days_to_death"))


def survival(cases: DataFrame) -> DataFrame:
    """Overall survival: death days with event 1, else last follow-up with event 0, else nulls."""
    diag = F.get("diagnoses", F.lit(0))
    dead = (F.col("demographic.vital_status") == "Dead") & F.col("demographic.days_to_death").isNotNull()
    follow = diag["days_to_last_follow_up"]
    age = diag["age_at_diagnosis"]
    return cases.select(
        F.col("submitter_id").alias("case_id"), F.coalesce("demographic.vital_status", F.lit("")).alias("vital_status"),
        F.when(dead, F.col("demographic.days_to_death")).otherwise(follow).cast("double").alias("os_time"),
        F.when(dead, 1).when(follow.isNotNull(), 0).alias("os_event"),
        F.coalesce("demographic.gender", F.lit("")).alias("gender"),
        F.when(age != 0, F.round(age / 365.25, 1)).alias("age_at_diagnosis_years"),
        F.coalesce(diag["tumor_stage"], F.lit("")).alias("tumor_stage"))


def type_counts(samples: DataFrame, by: list[str]) -> DataFrame:
    return samples.groupBy(*by, "sample_type").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "category", sample_category(F.col("sample_type")))


def pick_type_column(samples: DataFrame, preferred: list[str], by: str = "dataset_id") -> DataFrame:
    """Per dataset the column that tells sample types apart: the first preferred one with values,
    else the column with 2 to 15 distinct values and the fewest of them."""
    columns = [c for c in samples.columns if c not in (by, "sample_id")]
    long = samples.select(by, F.explode(F.array(*[
        F.struct(F.lit(c).alias("name"), F.lit(preferred.index(c) if c in preferred else 1000 + i).alias("pos"),
                 F.col(c).cast("string").alias("v")) for i, c in enumerate(columns)])).alias("e")).select(by, "e.*")
    d = long.where("v IS NOT NULL AND v <> ''").groupBy(by, "name", "pos").agg(F.count_distinct("v").alias("k"))
    usable = d.where((F.col("pos") < 1000) | F.col("k").between(2, 15))
    order = F.when(F.col("pos") < 1000, F.struct(F.lit(0).alias("a"), F.col("pos").cast("bigint").alias("b"), F.col("pos").alias("c"))) \
        .otherwise(F.struct(F.lit(1).alias("a"), F.col("k").alias("b"), F.col("pos").alias("c")))
    return usable.groupBy(by).agg(F.min_by("name", order).alias("type_column"), F.min_by("k", order).alias("n_types"))


def clinical_summary(cases: DataFrame, by: list[str]) -> DataFrame:
    """Long counts of gender, vital status and stage ('not reported' stages left out)."""
    diag = F.get("diagnoses", F.lit(0))
    stage = diag["tumor_stage"]
    items = F.array(
        F.struct(F.lit("gender").alias("field"), F.coalesce("demographic.gender", F.lit("unknown")).alias("value")),
        F.struct(F.lit("vital_status").alias("field"), F.coalesce("demographic.vital_status", F.lit("unknown")).alias("value")),
        F.struct(F.lit("tumor_stage").alias("field"), F.when(stage != "not reported", stage).alias("value")))
    return (cases.select(*by, F.explode(items).alias("e")).where("e.value IS NOT NULL AND e.value <> ''")
            .groupBy(*by, F.col("e.field").alias("field"), F.col("e.value").alias("value")).agg(F.count(F.lit(1)).alias("n")))


def age_summary(cases: DataFrame, by: list[str]) -> DataFrame:
    age = F.get("diagnoses", F.lit(0))["age_at_diagnosis"]
    a = cases.select(*by, (age / 365.25).alias("age")).where("age IS NOT NULL")
    med = ordered.quantiles(a, by, "age", {"age_median": 0.5}).drop("n_values")
    m = a.groupBy(*by).agg(F.avg("age").alias("age_mean"), F.min("age").alias("age_min"), F.max("age").alias("age_max"))
    j = m.join(med, by) if by else m.crossJoin(F.broadcast(med))
    return j.select(*by, *[F.round(c, 1).alias(c) for c in ("age_mean", "age_median", "age_min", "age_max")])


def compare_projects(cases: DataFrame, files: DataFrame) -> DataFrame:
    """One row per project: cases, tumour and normal samples, data kinds, median age, percent male."""
    c = cases.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("cases"),
        F.round(100.0 * F.count_if(F.col("demographic.gender") == "male")
                / F.greatest(F.count(F.when(F.col("demographic").isNotNull(), 1)), F.lit(1)), 1).alias("pct_male"))
    cat = sample_category(F.coalesce("s.sample_type", F.lit("unknown")))
    s = (cases.select("project_id", F.explode("samples").alias("s")).groupBy("project_id").agg(
        F.count_if(cat == "Tumor").alias("tumor_samples"), F.count_if(cat == "Normal").alias("normal_samples")))
    has = lambda col, v: F.coalesce(F.bool_or(F.col(col) == v), F.lit(False))
    f = files.groupBy("project_id").agg(
        has("experimental_strategy", "RNA-Seq").alias("has_rnaseq"), has("data_category", "DNA Methylation").alias("has_methylation"),
        has("data_category", "Copy Number Variation").alias("has_cnv"),
        has("data_category", "Simple Nucleotide Variation").alias("has_mutations"))
    age = age_summary(cases, ["project_id"]).select("project_id", F.col("age_median").alias("median_age"))
    return (c.join(s, "project_id", "left").join(f, "project_id", "left").join(age, "project_id", "left")
            .fillna(0, ["tumor_samples", "normal_samples"])
            .fillna(False, ["has_rnaseq", "has_methylation", "has_cnv", "has_mutations"]))


def availability(files: DataFrame, samples: DataFrame, strategies: list[str]) -> DataFrame:
    """Case x strategy grid of Yes / '' plus sample, tumour and normal counts.

    ``files``: (case_id, strategy, data_category); the strategy list fixes the pivot's width.
    """
    s = F.when(F.coalesce("strategy", F.lit("")) == "", F.col("data_category")).otherwise(F.col("strategy"))
    grid = (files.select("case_id", s.alias("strategy")).groupBy("case_id").pivot("strategy", strategies)
            .agg(F.first(F.lit("Yes"))).fillna("", strategies))
    cat = sample_category(F.col("sample_type"))
    n = samples.groupBy("case_id", "sample_id").agg(F.min("sample_type").alias("sample_type")).groupBy("case_id").agg(
        F.count(F.lit(1)).alias("n_samples"), F.count_if(cat == "Tumor").alias("tumor_samples"),
        F.count_if(cat == "Normal").alias("normal_samples"))
    return grid.join(n, "case_id", "left").fillna(0, ["n_samples", "tumor_samples", "normal_samples"])


def strategy_list(files: DataFrame) -> list[str]:
    s = F.when(F.coalesce("strategy", F.lit("")) == "", F.col("data_category")).otherwise(F.col("strategy"))
    found = files.select(s.alias("s")).where("s IS NOT NULL AND s <> ''").distinct().orderBy("s").collect()
    return [r["s"] for r in found]


def mutation_frequency(mutations: DataFrame, n: int = 50, by: list[str] | None = None) -> DataFrame:
    """Cases per mutated gene, most frequent first (ties by gene); top n per key."""
    keys = by or []
    per = mutations.select(*keys, "gene", "case_id").distinct().groupBy(*keys, "gene").agg(F.count(F.lit(1)).alias("n_cases"))
    total = mutations.select(*keys, "case_id").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n_total"))
    per = per.join(total, keys) if keys else per.crossJoin(F.broadcast(total))
    per = per.withColumn("frequency", F.col("n_cases") / F.col("n_total"))
    if not keys:
        return per.orderBy(F.desc("n_cases"), "gene").limit(n)
    return ordered.row_numbers(per, keys, ["-n_cases", "gene"], "rank").where(F.col("rank") <= n)


def tumor_normal_pairs(samples: DataFrame) -> DataFrame:
    """Every tumour sample with every normal sample of the same patient, as a join on the patient."""
    cat = sample_category(F.col("sample_type"))
    t = samples.where(cat == "Tumor").select("case_id", F.col("sample_id").alias("tumor_sample"), F.col("sample_type").alias("tumor_type"))
    n = samples.where(cat == "Normal").select("case_id", F.col("sample_id").alias("normal_sample"), F.col("sample_type").alias("normal_type"))
    return t.join(n, "case_id")


def enrich_samples(samples: DataFrame, clinical: DataFrame, key: str = "case_id") -> DataFrame:
    new = [c for c in clinical.columns if c == key or c not in samples.columns]
    return samples.join(clinical.select(*new), key, "left")


def catalog_filter(catalog: DataFrame, repository: str | None = None, organism: str | None = None,
                   data_type: str | None = None) -> DataFrame:
    out = catalog
    if repository:
        out = out.where(F.lower("repository") == repository.lower())
    if organism:
        out = out.where(F.lower("organism").contains(organism.lower()))
    if data_type:
        out = out.where(F.col("data_type") == data_type)
    return out


def catalog_search(datasets: DataFrame, pools: DataFrame, query: str) -> DataFrame:
    """Entries of both kinds whose joined text contains every query term."""
    terms = F.array(*[F.lit(t) for t in query.lower().split()])

    def match(*cols: Column) -> Column:
        text = F.lower(F.concat_ws(" ", *cols))
        return F.forall(terms, lambda t: text.contains(t))

    a = datasets.where(match(*[F.col(c) for c in ("accession", "organism", "description", "platform", "repository", "tags")])) \
        .withColumn("type", F.lit("dataset"))
    b = pools.where(match(*[F.col(c) for c in ("pool_name", "description", "studies", "tags")])).withColumn("type", F.lit("pool"))
    return a.unionByName(b, allowMissingColumns=True)


def pair_mates(files: DataFrame) -> DataFrame:
    """(sample_name, mate, path) -> one row per sample with an R1 file; R2-only samples drop out."""
    r1 = files.where("mate = 'R1'").groupBy("sample_name").agg(F.max("path").alias("fastq_r1"))
    r2 = files.where("mate = 'R2'").groupBy("sample_name").agg(F.max("path").alias("fastq_r2"))
    return r1.join(r2, "sample_name", "left").withColumn("is_paired", F.col("fastq_r2").isNotNull())


def _trailing(name: Column) -> Column:
    return F.regexp_extract(name, r"[._\-]?(\d+)$", 1).try_cast("int")


def _base(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(name, r"[._\-]?\d+$", "")), r"^[_\- ]+|[_\- ]+$", "")


def title_scores(columns: DataFrame, titles: DataFrame, by: str = "dataset_id") -> DataFrame:
    """Similarity of a study's matrix columns and sample titles; only positive scores are kept.

    A positive score needs one base name inside the other text, so candidates come from an equi-join
    on shared word prefixes of length 3 (or the whole shorter base), not from all pairs of a study.
    """
    c = columns.select(by, "column", _base(F.col("column")).alias("cb"), _trailing(F.col("column")).alias("cr"))
    low = F.lower("title")
    rep = F.coalesce(F.regexp_extract("title", r"(?i)rep(?:licate)?[._\-\s]?(\d+)", 1).try_cast("int"),
                     F.regexp_extract("title", r"[._\-](\d+)\s*$", 1).try_cast("int"))
    stripped = F.trim(F.regexp_replace(low, r"[\d,\s\-.+]+|rep\d*|10month", ""))
    t = titles.select(by, "sample_id", low.alias("tl"), _base(F.col("title")).alias("tb"), rep.alias("tr"), stripped.alias("ts"))

    def grams(text: Column) -> Column:
        n = F.greatest(F.length(text) - 2, F.lit(1))
        return F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(text, i, F.lit(3))))

    def keys(base: Column, text: Column, base_tag: str, text_tag: str) -> Column:
        own = F.array(F.concat(F.lit(base_tag), F.substring(base, 1, 3)))
        return F.explode(F.concat(own, F.transform(grams(text), lambda g: F.concat(F.lit(text_tag), g))))

    # Either base occurs in the other text, so its first trigram is a trigram of that text; the tags
    # keep a base's trigram from meeting anything but the other side's text.
    left = c.select("*", keys(F.col("cb"), F.lower("column"), "c", "t").alias("k"))
    right = t.select("*", keys(F.col("tb"), F.col("tl"), "t", "c").alias("k"))
    short_l = c.where(F.length("cb").between(1, 2)).select(*c.columns)
    # Sizes are estimated from the files, before the trigrams: without the hint the driver would broadcast them all.
    pairs = left.join(right.hint("merge"), [by, "k"]).drop("k")
    tiny = short_l.join(t.hint("merge"), by).where(F.col("tl").contains(F.col("cb")))
    tiny_t = c.join(t.where(F.length("tb") < 3).hint("merge"), by)
    pairs = pairs.unionByName(tiny).unionByName(tiny_t).dropDuplicates([by, "column", "sample_id"])
    hit = (F.col("cb") != "") & (F.col("tl").contains(F.col("cb")) | F.lower("column").contains(F.col("tb")))
    near = F.greatest(F.lit(0), 15 - F.abs(F.length("ts") - F.length("cb")))
    reps = F.when(F.col("cr").isNotNull() & F.col("tr").isNotNull(), F.when(F.col("cr") == F.col("tr"), 15).otherwise(-10)).otherwise(0)
    return pairs.where(hit).select(by, "column", "sample_id", (20 + near + reps).alias("score")).where("score > 0")


def greedy_match(scores: DataFrame, by: str = "dataset_id") -> DataFrame:
    """One-to-one assignment taking the best remaining (score, column, sample) first.

    Equivalent to the sequential greedy pass: in every round all pairs that are the best of both
    their column and their sample are fixed at once, then their rows and columns leave. The joins are merges:
    a checkpoint keeps the size estimate of the files, by which every round would be broadcast by the driver.
    """
    rest = cut(scores.select(by, "column", "sample_id", F.struct("score", "column", "sample_id").alias("k")))
    fixed = None
    while True:
        bc = rest.groupBy(by, "column").agg(F.max("k").alias("k"))
        bs = rest.groupBy(by, "sample_id").agg(F.max("k").alias("ks"))
        won = cut(bc.select(by, "column", "k", F.col("k.sample_id").alias("sample_id"))
                  .join(bs.hint("merge"), [by, "sample_id"]).where("k = ks").select(by, "column", "sample_id", F.col("k.score").alias("score")))
        if won.isEmpty():
            break
        fixed = won if fixed is None else fixed.unionByName(won)
        rest = cut(rest.join(won.select(by, "column").hint("merge"), [by, "column"], "left_anti")
                   .join(won.select(by, "sample_id").hint("merge"), [by, "sample_id"], "left_anti"))
    return fixed if fixed is not None else scores.select(by, "column", "sample_id", "score").where("false")


def align_titles(columns: DataFrame, titles: DataFrame, by: str = "dataset_id") -> DataFrame:
    """Column -> sample by the first strategy that covers more than half of a study's columns:
    sample id, title (exact, then case-insensitive), source name, scored title, position.

    ``columns``: (dataset, column, position); ``titles``: (dataset, sample_id, title, source, position).
    """
    n = columns.groupBy(by).agg(F.count(F.lit(1)).alias("n_cols"))
    nt = titles.groupBy(by).agg(F.count(F.lit(1)).alias("n_titles"))
    c = columns.select(by, "column", "position")

    def by_text(field: str) -> DataFrame:
        t = titles.where(F.length(field) > 0).select(by, F.col(field).alias("f"), "sample_id", "position")
        exact = t.groupBy(by, "f").agg(F.max_by("sample_id", "position").alias("s1"))
        lower = t.groupBy(by, F.lower("f").alias("fl")).agg(F.min_by("sample_id", "position").alias("s2"))
        j = (c.join(exact, (c[by] == exact[by]) & (c["column"] == exact["f"]), "left").select(c[by], c["column"], "s1"))
        j = j.join(lower.withColumnRenamed(by, "_b"), (F.col(by) == F.col("_b")) & (F.lower("column") == F.col("fl")), "left")
        return j.select(by, "column", F.coalesce("s1", "s2").alias("sample_id")).where("sample_id IS NOT NULL")

    own = c.join(titles.select(by, F.col("sample_id").alias("column")).distinct(), [by, "column"]).select(by, "column", F.col("column").alias("sample_id"))
    fuzzy = greedy_match(title_scores(columns, titles, by), by).select(by, "column", "sample_id")
    pos = (c.join(titles.select(by, "position", "sample_id"), [by, "position"])
           .join(n.join(nt, by).where("n_cols = n_titles").select(by), by, "left_semi").select(by, "column", "sample_id"))
    stacked = None
    for rank, (name, frame) in enumerate([("sample_id", own), ("title", by_text("title")), ("source", by_text("source")),
                                          ("scored", fuzzy), ("position", pos)]):
        part = frame.select(by, "column", "sample_id", F.lit(rank).alias("rank"), F.lit(name).alias("strategy"))
        stacked = part if stacked is None else stacked.unionByName(part)
    ok = (stacked.groupBy(by, "rank").agg(F.count(F.lit(1)).alias("k")).join(n, by).where("k > n_cols * 0.5")
          .groupBy(by).agg(F.min("rank").alias("rank")))
    return stacked.join(small(ok), [by, "rank"]).select(by, "column", "sample_id", "strategy")
