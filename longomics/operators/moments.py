"""Shared per-gene and per-sample moments of a long count table.

All statistics are over the dense matrix (absent cells are zeros) but are computed from the sparse
rows plus the dataset dimensions, so nothing is densified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..runtime import cut, small, spread

DS, GENE, SAMPLE = "dataset_id", "gene_id", "sample_id"


def sample_totals(counts: DataFrame, value: str = "count") -> DataFrame:
    """Library size and detected genes per sample."""
    return counts.groupBy(DS, SAMPLE).agg(
        F.sum(value).cast("double").alias("library_size"),
        F.count_if(F.col(value) > 0).alias("detected_genes"))


def sample_numbers(samples: DataFrame) -> DataFrame:
    return samples.groupBy(DS).agg(F.count(F.lit(1)).alias("n_samples"))


def dense_variance(n: Column, nonzero: Column, mean_nz: Column, var_pop_nz: Column,
                   ddof: int) -> Column:
    """Variance of values plus ``n - nonzero`` zeros, from the non-zero part's moments."""
    m2 = var_pop_nz * nonzero + mean_nz * mean_nz * nonzero * (n - nonzero) / n
    return m2 / (n - ddof)


def gene_moments(counts: DataFrame, value: str = "count", samples: DataFrame | None = None,
                 extra: tuple[Column, ...] = ()) -> DataFrame:
    """Per gene: n_samples, total, mean, var, var_pop, sd, zeros, max_value over the dense row.

    ``samples`` lists the dataset's samples; by default those occurring in ``counts``.
    """
    listed = counts.select(DS, SAMPLE).distinct() if samples is None else samples.select(DS, SAMPLE)
    n = sample_numbers(listed)
    v, some = F.col(value), F.col(value) != 0
    sparse = counts.groupBy(DS, GENE).agg(
        F.sum(v).cast("double").alias("total"),
        F.count_if(some).alias("nonzero"),
        F.avg(F.when(some, v)).alias("_mean_nz"),
        F.var_pop(F.when(some, v)).alias("_var_nz"),
        F.max(v).cast("double").alias("max_value"),
        *extra)
    return finish_moments(sparse, n)


def finish_moments(sparse: DataFrame, n: DataFrame) -> DataFrame:
    """Dense-row statistics from the non-zero part's moments and the dataset's sample number."""
    full = sparse.join(n, DS)
    nz, size = F.col("nonzero"), F.col("n_samples")
    mean_nz, var_nz = F.coalesce("_mean_nz", F.lit(0.0)), F.coalesce("_var_nz", F.lit(0.0))
    var_pop = dense_variance(size, nz, mean_nz, var_nz, 0)
    keep = [c for c in sparse.columns if not c.startswith("_")]
    return full.select(
        *keep, "n_samples",
        (F.col("total") / size).alias("mean"),
        F.when(size > 1, dense_variance(size, nz, mean_nz, var_nz, 1)).alias("var"),
        var_pop.alias("var_pop"),
        F.when(size > 1, F.sqrt(dense_variance(size, nz, mean_nz, var_nz, 1))).alias("sd"),
        (size - nz).alias("zeros"))


def matrix_summaries(counts: DataFrame, samples: DataFrame | None = None) -> dict[str, DataFrame]:
    """Gene moments, sample totals and the count histogram from a single read of the cells.

    Grouping sets expand each row before the map-side combine, so the input is scanned and shuffled
    once for all three; the result is checkpointed and split by grouping id.
    """
    v, some = F.col("count"), F.col("count") != 0
    base = counts.select(DS, GENE, SAMPLE, "count", F.col("count").cast("double").alias("bin"))
    sets = base.groupingSets(
        [[F.col(DS), F.col(GENE)], [F.col(DS), F.col(SAMPLE)], [F.col(DS), F.col("bin")]],
        F.col(DS), F.col(GENE), F.col(SAMPLE), F.col("bin")).agg(
        F.grouping_id().alias("_set"), F.sum(v).cast("double").alias("total"), F.count_if(some).alias("nonzero"),
        F.count_if(v > 0).alias("detected"), F.avg(F.when(some, v)).alias("_mean_nz"),
        F.var_pop(F.when(some, v)).alias("_var_nz"), F.max(v).cast("double").alias("max_value"))
    sets = cut(sets)
    # grouping_id bits, high to low: dataset, gene, sample, bin; a set bit means "not grouped by".
    libs = sets.where("_set = 5").select(DS, SAMPLE, F.col("total").alias("library_size"), F.col("detected").alias("detected_genes"))
    hist = sets.where("_set = 6 AND bin > 0").select(DS, F.col("bin").alias("count"), F.col("nonzero").alias("n"))
    n = sample_numbers(libs if samples is None else samples.select(DS, SAMPLE))
    genes = finish_moments(sets.where("_set = 3").select(DS, GENE, "total", "nonzero", "_mean_nz", "_var_nz", "max_value"), n)
    return {"genes": genes, "libraries": libs, "histogram": hist}


# Parts of a gene list that meet a sample one by one, so that neither a long list nor many samples gather in a task.
CHUNKS = 64
# A list of at most this many samples (or genes) goes to every gene (or sample); cells a task where neither is short;
# up to so many cells the places and the cells simply fall together.
FEW, TASK_CELLS, PLAIN_CELLS = 128, 500_000, 4_000_000


def fill_genes(cells: DataFrame, samples: DataFrame, genes: DataFrame, sample_keys: list[str],
               list_keys: list[str], value: str) -> DataFrame:
    """One row per sample and listed gene, absent cells as zeros.

    With few samples the known cells gather by gene and are dealt to the listed samples there, with few genes the other
    way round: only known cells are shuffled and a list never holds more than ``FEW`` places. With many of both, the
    listed places and the cells fall together in one aggregate, in parts whose number follows the cells. So they do,
    in as many parts as Spark takes, in a matrix of ``PLAIN_CELLS`` at most.
    """
    slots, listed = cut(samples.select(*sample_keys).distinct()), cut(genes.select(*list_keys, GENE).distinct())
    most, longest = _longest(slots, list_keys), _longest(listed, list_keys)
    n_slots = slots.count()
    size = n_slots * longest
    rest = [k for k in sample_keys if k not in list_keys]
    # A single list needs no list key to spread its rows, and joins by gene or sample find them in place.
    lists = [] if n_slots == most else list_keys
    if size > PLAIN_CELLS and most <= FEW:
        return _deal(cells, slots, listed, rest, [GENE], sample_keys, list_keys, value, size, [*lists, GENE])
    if size > PLAIN_CELLS and longest <= FEW:
        return _deal(cells, listed, slots, [GENE], rest, sample_keys, list_keys, value, size, [*lists, *rest])
    if size > PLAIN_CELLS:
        samples, genes = slots, listed
    chunk = F.pmod(F.xxhash64(GENE), F.lit(CHUNKS)).cast("bigint").alias("_k")
    listed = genes.select(*list_keys, GENE, chunk)
    spread = samples.select(*sample_keys, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(CHUNKS - 1).cast("bigint"))).alias("_k"))
    kind = cells.schema[value].dataType
    places = spread.join(listed, [*list_keys, "_k"]).select(*sample_keys, GENE, F.lit(None).cast(kind).alias(value), F.lit(True).alias("_listed"))
    known = cells.select(*sample_keys, GENE, value, F.lit(False).alias("_listed"))
    both = places.unionByName(known)
    if size > PLAIN_CELLS:
        both = both.repartition(max(1, size // TASK_CELLS), *sample_keys, GENE)
    return (both.groupBy(*sample_keys, GENE)
            .agg(F.coalesce(F.max(value), F.lit(0).cast(kind)).alias(value), F.bool_or("_listed").alias("_listed"))
            .where("_listed").select(*sample_keys, GENE, value))


def _longest(rows: DataFrame, by: list[str]) -> int:
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


def _deal(cells: DataFrame, few: DataFrame, many: DataFrame, inner: list[str], outer: list[str], sample_keys: list[str],
          list_keys: list[str], value: str, size: int, by: list[str]) -> DataFrame:
    """Rows of ``many`` (outer keys) x rows of ``few`` (inner keys, ``FEW`` at most) of each list, with their largest value or zero.

    Dealt by ``by`` into parts whose number follows the ``size`` of the result.
    """
    kind = cells.schema[value].dataType
    placed = few.withColumn("_p", F.row_number().over(Window.partitionBy(*list_keys).orderBy(*inner)))
    wanted = placed.select("_p", *[F.col(k).alias(f"_w_{k}") for k in few.columns])
    own = cells.join(small(wanted), [F.col(k).eqNullSafe(F.col(f"_w_{k}")) for k in few.columns])
    known = own.select(*list_keys, *outer, F.struct("_p", F.col(value).alias("_v")).alias("_e"), F.lit(False).alias("_listed"))
    empty = many.select(*list_keys, *outer, F.lit(None).cast(known.schema["_e"].dataType).alias("_e"), F.lit(True).alias("_listed"))
    rows = spread(known.unionByName(empty), size, *by).groupBy(*list_keys, *outer).agg(F.collect_list("_e").alias("_c"), F.bool_or("_listed").alias("_listed"))
    lists = small(placed.groupBy(*list_keys).agg(F.sort_array(F.collect_list(F.struct("_p", *inner))).alias("_s")))
    rows = rows.where("_listed").join(lists, list_keys) if list_keys else rows.where("_listed").crossJoin(lists)
    # A known cell is its own place and the other places are empty; only a place with several cells is searched for.
    taken, blank = F.col("_c._p"), F.lit(None).cast(kind)
    entry = lambda p, v: F.struct(p.alias("_p"), v.alias("_v"))
    found = lambda p: F.array_max(F.transform(F.filter("_c", lambda e: e["_p"] == p), lambda e: e["_v"]))
    largest = F.transform(F.array_distinct(taken), lambda p: entry(p, found(p)))
    single = F.when(F.size(F.array_distinct(taken)) == F.size("_c"), F.col("_c")).otherwise(largest)
    others = F.transform(F.array_except(F.col("_s._p"), taken), lambda p: entry(p, blank))
    dealt = rows.select(*list_keys, *outer, "_s", F.explode(F.concat(single, others)).alias("_d"))
    at = F.element_at("_s", F.col("_d._p"))
    names = {k: at[k].alias(k) for k in inner} | {value: F.coalesce("_d._v", F.lit(0).cast(kind)).alias(value)}
    return dealt.select(*[names.get(k, F.col(k)) for k in [*sample_keys, GENE, value]])


def zero_blocks(cells: DataFrame, samples: DataFrame, n_genes: DataFrame) -> DataFrame:
    """(dataset, sample, _n): how many listed genes have no cell in a sample. ``cells`` hold non-zero cells of them only."""
    own = cells.groupBy(DS, SAMPLE).agg(F.count(F.lit(1)).alias("_own"))
    return (samples.select(DS, SAMPLE).distinct().join(n_genes.select(DS, "_genes"), DS).join(own, [DS, SAMPLE], "left")
            .select(DS, SAMPLE, (F.col("_genes") - F.coalesce("_own", F.lit(0))).alias("_n")).where("_n > 0"))


def densify(counts: DataFrame, value: str = "count", samples: DataFrame | None = None) -> DataFrame:
    """Explicit zero cells for genes x samples of each dataset."""
    listed = (counts if samples is None else samples).select(DS, SAMPLE).distinct()
    filled = fill_genes(counts, listed, counts.select(DS, GENE).distinct(), [DS, SAMPLE], [DS], value)
    return filled.select(DS, GENE, SAMPLE, value)


def standardise(values: DataFrame, value: str = "value") -> DataFrame:
    """z = (value - mean) / population sd per gene, sd 0 -> 1, on the dense matrix."""
    stats = gene_moments(values, value)
    scaled = stats.select(DS, GENE, "mean",
                          F.when(F.col("var_pop") > 0, F.sqrt("var_pop")).otherwise(1.0).alias("scale"))
    return (densify(values, value).join(scaled, [DS, GENE])
            .select(DS, GENE, SAMPLE, ((F.col(value) - F.col("mean")) / F.col("scale")).alias("z")))
