"""Jaccard join on word shingles by universe partition and pigeonhole, verified exactly.

Two sets of sizes r and s with Jaccard of at least 3/4 differ in at most H = (r + s) // 7 tokens. Sizes fall into bands
of growing width; in a band the universe is hashed into m segments, so at least m - H of the m segment subsets of a
linked pair are equal. A document of band b also meets band b - 1 when a partner may lie there.

Cost-based allocation. Subsets are ordered cheap, all-common, empty, then by hash; "common" shingles come from hashed
document frequencies over all documents. A document normally indexes its first H + 1 subsets: at most H of them can
miss the partner, so two linked documents meet in one. A document with fewer cheap subsets indexes all of them and the
one-deletion neighbourhoods of those with two uncommon tokens (such a subset stands for two units of difference) and
takes common or empty subsets only where the units stay below H + 1.

Nodes of the graph are distinct sets, so copies cost one entry per task and subset. Pairs of a group are ruled out by
profiles first (token numbers in slices of the universe; their difference bounds the difference of the sets from
below). Of the rest each node verifies its nearest partner, then each group its nearest pairs, then all pairs whose
ends still are in different components: a large group of near copies stays linear and no component is lost. In that
last step a member row names the smaller groups of its node, at most its own index entries, and a pair is made in the
smallest group that both share, so once. Entries travel as packed bytes; nothing but counters and component sums
reaches the driver. Sets of candidates are found again by a bitmap of fixed size over row hashes.

Defined cases: null, empty and blank texts have no shingles, size 0 and are their own component; fewer than five words
are one shingle; a null id is returned with a null component unless linked to an id; repeated ids take the component
of any of their rows; equal rows are returned each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..runtime import cut
from .base import chunks, mix, shingle_hashes, text_bytes, unique_per_row, word_hashes
from .graph import components

WIDTH, CHUNK, FLUSH = 5, 2 << 20, 1 << 21
COUNTERS, SLICES = 1 << 16, 64
BITMAP = 1 << 26
RATIO = 2.0
# Lower size limits of the bands; the last covers any set that memory can hold.
LIMITS = np.unique(np.floor(RATIO ** np.arange(0, 40)).astype(np.int64))
SEGMENTS = np.maximum(16, np.ceil(0.45 * (np.append(LIMITS[1:], 2 * LIMITS[-1]) - 1)).astype(np.int64))


def linked(inter: np.ndarray, r: np.ndarray, s: np.ndarray) -> np.ndarray:
    return 100 * inter >= 75 * (r + s - inter)


def sets_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles (ascending per row), their rows, and the row starts."""
    n = len(offsets) - 1
    words, at = word_hashes(raw, offsets)
    values, rows = unique_per_row(*shingle_hashes(words, at, n, WIDTH))
    return values, rows, np.searchsorted(rows, np.arange(n + 1))


def digests(values: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Order-free 63-bit digest per row."""
    with np.errstate(over="ignore"):
        sums = np.concatenate(([np.uint64(0)], np.cumsum(mix(values ^ np.uint64(0xA5A5A5A5)), dtype=np.uint64)))
        total = mix(sums[start[1:]] - sums[start[:-1]] + np.diff(start).astype(np.uint64))
    return (total >> np.uint64(1)).astype(np.int64)


def _counter(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(48)).astype(np.int64)


def profiles(values: np.ndarray, rows: np.ndarray, start: np.ndarray) -> list[bytes]:
    """Per row the numbers of tokens in equal slices of the universe, about four tokens a slice, each up to 255."""
    n = np.diff(start)
    power = np.clip(np.ceil(np.log2(np.maximum(n / 4, 1))), 0, 20).astype(np.int64)
    size = 1 << power
    base = np.cumsum(size) - size
    slot = np.where(power[rows] > 0, values >> (64 - np.maximum(power[rows], 1)).astype(np.uint64), 0).astype(np.int64)
    flat = np.minimum(np.bincount(base[rows] + slot, minlength=int(size.sum())), 255).astype(np.uint8).tobytes()
    return [flat[b:b + k] for b, k in zip(base.tolist(), size.tolist())]


def fold(profile: np.ndarray, size: int) -> np.ndarray:
    return np.minimum(profile.reshape(size, -1).sum(axis=1, dtype=np.int64), 255)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(COUNTERS, dtype=np.int64)
    names = ["key", "rk", "n", "digest", "profile", "slice", "counts"]
    kind = None
    for batch in batches:
        kind = batch.column(0).type
        raw, offsets = text_bytes(batch.column(2))
        sizes, marks, shapes = [], [], []
        for a, b in chunks(offsets, CHUNK):
            values, rows, start = sets_of(raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
            counts += np.bincount(_counter(values), minlength=COUNTERS)
            sizes.append(np.diff(start))
            marks.append(digests(values, start))
            shapes += profiles(values, rows, start)
        n = len(batch)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(np.concatenate(sizes) if n else [], pa.int64()),
             pa.array(np.concatenate(marks) if n else [], pa.int64()), pa.array(shapes, pa.binary()),
             pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
    if kind is not None:
        parts = [p.tobytes() for p in counts.reshape(SLICES, -1)]
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(SLICES, kind), *[pa.nulls(SLICES, pa.int64())] * 3, pa.nulls(SLICES, pa.binary()),
             pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], names=names)


def _sum_counts(table: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(b.as_py(), dtype=np.int64) for b in table["counts"]], axis=0)
    return pa.table({"slice": table["slice"][:1], "counts": pa.array([total.tobytes()], pa.binary())})


def common_slots(described: DataFrame) -> np.ndarray:
    """Slots of the document frequency table that stand out, one flag for each of COUNTERS."""
    rows = described.where(F.col("slice").isNotNull()).select("slice", "counts") \
        .groupBy("slice").applyInArrow(_sum_counts, "slice int, counts binary").collect()
    total = np.zeros((SLICES, COUNTERS // SLICES), dtype=np.int64)
    for r in rows:
        total[r["slice"]] = np.frombuffer(r["counts"], dtype=np.int64)
    mean = total.mean()
    return total.ravel() > mean + max(8 * mean ** 0.5, 32)


def signatures(values: np.ndarray, rows: np.ndarray, start: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signature, row) entries of the sets by both roles of the module text."""
    n = np.diff(start)
    band = np.searchsorted(LIMITS, n, side="right") - 1
    cold = ~common[_counter(values)]
    out_sig, out_row = [], []
    for role in (0, 1):
        anchor = band - role
        top = np.append(LIMITS[1:], 2 * LIMITS[-1])[anchor] - 1
        if role:
            use = (n > 0) & (anchor >= 0) & (3 * n <= 4 * top)
            slack = (n + top) // 7
        else:
            use = n > 0
            slack = (n + 4 * n // 3) // 7
        if not use.any():
            continue
        pick = use[rows]
        v, r, c = values[pick], rows[pick], cold[pick]
        m = SEGMENTS[anchor[r]].astype(np.uint64)
        segment = ((v >> np.uint64(32)) * m) >> np.uint64(32)
        first = np.ones(len(v), dtype=bool)
        first[1:] = (segment[1:] != segment[:-1]) | (r[1:] != r[:-1])
        at = np.flatnonzero(first)
        of = np.cumsum(first) - 1
        salt = mix(segment[at] * np.uint64(1000003) + anchor[r[at]].astype(np.uint64) + np.uint64(1 << 60))
        with np.errstate(over="ignore"):
            sums = np.add.reduceat(v, at)
        sig, owner = mix(sums ^ salt), r[at]
        n_cold = np.add.reduceat(c.astype(np.int64), at)
        cheap = n_cold > 0
        order = np.lexsort((sig, ~cheap, owner))
        begin = np.searchsorted(owner, np.arange(len(n)))
        place = np.empty(len(sig), dtype=np.int64)
        place[order] = np.arange(len(sig)) - begin[owner[order]]
        need = slack + 1
        taken = place < need[owner]
        cheap_n = np.bincount(owner, weights=cheap, minlength=len(n)).astype(np.int64)
        units = np.bincount(owner, weights=np.minimum(n_cold, 2), minlength=len(n)).astype(np.int64)
        poor = use & (cheap_n < need)
        enough = poor & (units >= need)
        taken &= cheap | ~enough[owner]
        out_sig.append(sig[taken])
        out_row.append(owner[taken])
        if poor.any():
            near = poor[r] & (n_cold[of] >= 2)
            with np.errstate(over="ignore"):
                out_sig.append(mix((sums[of[near]] - v[near]) ^ salt[of[near]]))
            out_row.append(r[near])
            # Empty segments last: only where the subsets do not reach the need.
            filled = np.bincount(owner, minlength=len(n))
            for row in np.flatnonzero(poor & ~enough & (filled < need)):
                own = segment[at][owner == row].astype(np.int64)
                empty = np.setdiff1d(np.arange(SEGMENTS[anchor[row]]), own).astype(np.uint64)
                blank = np.sort(mix(mix(empty * np.uint64(1000003) + np.uint64(anchor[row]) + np.uint64(1 << 60))))
                out_sig.append(blank[:need[row] - filled[row]])
                out_row.append(np.full(min(len(blank), need[row] - filled[row]), row))
    if not out_sig:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out_sig), np.concatenate(out_row)


def _entries(common, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = common.value
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush():
            sig, node = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            held.clear()
            bucket = ((sig >> np.uint64(40)).astype(np.int64) * buckets) >> 24
            order = np.lexsort((node, sig, bucket))
            sig, node, bucket = sig[order], node[order], bucket[order]
            keep = np.ones(len(sig), dtype=bool)
            keep[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
            sig, node, bucket = sig[keep], node[keep], bucket[keep]
            low = sig & np.uint64((1 << 40) - 1)
            edge = np.searchsorted(bucket, np.arange(buckets + 1))
            some = np.flatnonzero(np.diff(edge))
            pack = lambda x: pa.array([x[edge[k]:edge[k + 1]].tobytes() for k in some], pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array(some, pa.int32()), pack((low >> np.uint64(8)).astype(np.uint32)), pack((low & np.uint64(255)).astype(np.uint8)), pack(node)],
                names=["bucket", "high", "low", "nodes"])

        for batch in batches:
            raw, offsets = text_bytes(batch.column(0))
            for a, b in chunks(offsets, CHUNK):
                values, rows, start = sets_of(raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                mark = digests(values, start)
                _, single = np.unique(mark, return_index=True)
                if len(single) < len(mark):  # copies inside the chunk add nothing
                    use = np.zeros(len(mark), dtype=bool)
                    use[single] = True
                    values, rows = values[use[rows]], rows[use[rows]]
                    start = np.searchsorted(rows, np.arange(len(mark) + 1))
                sig, row = signatures(values, rows, start, flags)
                held.append((sig, mark[row]))
                size += len(sig)
                if size >= FLUSH:
                    yield flush()
                    size = 0
        if size:
            yield flush()
    return run


def _groups(table: pa.Table) -> pa.Table:
    """Groups of at least two nodes with one signature: gid (of the member list), pivot, node."""
    join = lambda name, kind: np.concatenate([np.frombuffer(x.as_py(), dtype=kind) for x in table[name]])
    sig = (join("high", np.uint32).astype(np.int64) << 8) | join("low", np.uint8)
    node = join("nodes", np.int64)
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    keep = np.ones(len(sig), dtype=bool)
    keep[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
    sig, node = sig[keep], node[keep]
    at = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
    size = np.diff(np.append(at, len(sig)))
    with np.errstate(over="ignore"):
        gid = mix(np.add.reduceat(mix(node.astype(np.uint64)), at)).astype(np.int64)
    _, fresh = np.unique(gid, return_index=True)
    use = np.zeros(len(gid), dtype=bool)
    use[fresh] = True
    use &= size > 1
    member = np.repeat(use, size)
    pivot = np.repeat(node[at], size)
    member &= node != pivot
    return pa.table({"gid": np.repeat(gid, size)[member], "pivot": pivot[member], "node": node[member]})


def _overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = []
        for x, y in zip(batch.column(2), batch.column(3)):
            a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            if len(a) > len(b):
                a, b = b, a
            at = np.searchsorted(b, a)
            at[at == len(b)] = 0
            good.append(bool(linked(int((b[at] == a).sum()), len(a), len(b))))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(good, pa.bool_())], names=["a", "b", "good"])


def _met_before(earlier: pa.ChunkedArray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether the members at ``left`` and ``right`` share a smaller group; ``earlier`` lists those of each member."""
    groups = earlier.combine_chunks()
    owner = np.repeat(np.arange(len(groups)), groups.value_lengths().to_numpy())
    _, slot, count = np.unique(groups.flatten().to_numpy(), return_inverse=True, return_counts=True)
    place = np.cumsum(count > 1) - 1
    owner, slot = owner[count[slot] > 1], place[slot[count[slot] > 1]]
    met = np.zeros(len(left), dtype=bool)
    shared = int(slot.max(initial=-1)) + 1
    width = min(shared, max(64, (32 << 20) // max(len(groups), 1)))
    for k in range(0, shared, max(width, 1)):
        flags = np.zeros((len(groups), width), dtype=bool)
        here = (slot >= k) & (slot < k + width)
        flags[owner[here], slot[here] - k] = True
        bits = np.packbits(flags, axis=1)
        rest = np.flatnonzero(~met)
        step = max(1, (32 << 20) // bits.shape[1])
        for j in range(0, len(rest), step):
            some = rest[j:j + step]
            met[some] = (bits[left[some]] & bits[right[some]]).any(axis=1)
    return met


def _cross(table: pa.Table, nearest: bool) -> pa.Table:
    """Pairs of a group with ends in different components whose sizes and profiles allow a link, with the difference of
    the profiles; ``nearest``: for each node with such pairs only the one with the smallest difference, else those without
    a smaller group in common."""
    node, part, n = (table[c].to_numpy() for c in ("node", "component", "n"))
    shapes = [np.frombuffer(x.as_py(), np.uint8) for x in table["profile"]]
    size = min(map(len, shapes))
    shape = np.stack([fold(x, size) for x in shapes]).astype(np.int16)
    left, right, far, whose = [], [], [], []
    step = max(1, (4 << 20) // (len(node) * size))
    for k in range(0, len(node), step):
        mine = slice(k, k + step)
        gap = np.abs(shape[mine, None] - shape[None]).sum(axis=2, dtype=np.int32)
        both = n[mine, None] + n[None]
        ok = (part[mine, None] != part[None]) & (gap <= both // 7) & (3 * np.maximum(n[mine, None], n[None]) <= 4 * np.minimum(n[mine, None], n[None]))
        if nearest:
            gap = np.where(ok, gap, np.iinfo(np.int32).max)
            best = gap.argmin(axis=1)
            row = np.flatnonzero(ok.any(axis=1))
            col = best[row]
        else:
            row, col = np.nonzero(ok & (node[mine, None] > node[None]))
            new = ~_met_before(table["earlier"], row + k, col)
            row, col = row[new], col[new]
        left.append(node[mine][row])
        right.append(node[col])
        far.append(gap[row, col])
        whose.append(node[mine][row])
    a, b = np.concatenate(left), np.concatenate(right)
    return pa.table({"gid": np.full(len(a), table["gid"][0].as_py()), "node": np.concatenate(whose), "a": np.maximum(a, b),
                     "b": np.minimum(a, b), "gap": np.concatenate(far).astype(np.int64)})


def _nearest(table: pa.Table) -> pa.Table:
    return _cross(table, True)


def _all_pairs(table: pa.Table) -> pa.Table:
    return _cross(table, False)


def _bitmap(rows: DataFrame) -> np.ndarray:
    """BITMAP bits with the slot of every ``rk`` set; a fixed size, so it may be broadcast."""
    slot = F.pmod(F.col("rk"), F.lit(BITMAP))
    parts = rows.select(slot.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("k")) \
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).collect()
    out = np.zeros(BITMAP // 8, dtype=np.uint8)
    for r in parts:
        # Bucket k holds the values (k - 1) * 32768 + 1 .. k * 32768 at bits counted from 0.
        body = np.frombuffer(r["bits"], dtype=np.uint8)
        out_at = (r["k"] - 1) * 4096 if r["k"] else 0
        out[out_at:out_at + len(body)] |= body[:len(out) - out_at]
    return out


def _find_sets(bitmap):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        for batch in batches:
            slot = np.mod(batch.column(0).to_numpy(), BITMAP)
            # bucket number and position as Spark's bitmap functions count them
            bucket = np.where(slot > 0, 1 + (slot - 1) // 32768, 0)
            position = np.where(slot > 0, (slot - 1) % 32768, 0)
            index = np.maximum(bucket - 1, 0) * 32768 + position
            hit = (bits[index >> 3] >> (index & 7)) & 1
            some = batch.filter(pa.array(hit.astype(bool)))
            if not len(some):
                continue
            raw, offsets = text_bytes(some.column(1))
            nodes, bodies = [], []
            for a, b in chunks(offsets, CHUNK):
                values, _, start = sets_of(raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                nodes.append(digests(values, start))
                bodies += [values[start[k]:start[k + 1]].tobytes() for k in range(b - a)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes)), pa.array(bodies, pa.binary())], names=["node", "body"])
    return run


def join(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, n_shingles, component_id (smallest key reachable by links)."""
    spark = docs.sparkSession
    context = spark.sparkContext
    buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(key, text).alias("rk"), F.col(text).alias("t"))
    described = cut(rows.mapInArrow(_describe, f"key {kind}, rk long, n long, digest long, profile binary, slice int, counts binary"))
    common = context.broadcast(common_slots(described))
    described = described.where(F.col("slice").isNull())
    facts = described.select("key", "rk", "n", "digest")
    nodes = described.where("n > 0").groupBy("digest").agg(F.min("key").alias("key"), F.min("rk").alias("rk"), F.max("n").alias("n"), F.min("profile").alias("profile"))

    entries = rows.select("t").mapInArrow(_entries(common, buckets), "bucket int, high binary, low binary, nodes binary")
    groups = cut(entries.groupBy("bucket").applyInArrow(_groups, "gid long, pivot long, node long")
                 .groupBy("gid", "node").agg(F.min("pivot").alias("pivot")))
    met = groups.select("node").union(groups.select("pivot")).distinct()
    known = cut(met.join(nodes.withColumnRenamed("digest", "node"), "node").select("node", "rk", "n", "profile"))

    def labelled(found: DataFrame, links: DataFrame, name: str, out: str) -> DataFrame:
        part = links.select(F.col("node").alias(name), F.col("component").alias(out))
        return found.join(part, name, "left").withColumn(out, F.coalesce(out, name))

    def bodies(pairs: DataFrame) -> DataFrame:
        """The sets of the nodes of ``pairs``, built from the texts once more and written."""
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        wanted = cut(ends.join(known.select("node", "rk"), "node"))
        bits = context.broadcast(_bitmap(wanted))
        return cut(rows.select("rk", "t").mapInArrow(_find_sets(bits), "node long, body binary")
                   .join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"]))

    def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        sides = pairs.join(sets.select(F.col("node").alias("a"), F.col("body").alias("x")), "a") \
            .join(sets.select(F.col("node").alias("b"), F.col("body").alias("y")), "b").select("a", "b", "x", "y")
        return cut(sides.mapInArrow(_overlap, "a long, b long, good boolean"))

    # Profiles join the members only on their way to the pairs; no written table holds one more than once.
    members = cut(groups.select("gid", "node").union(groups.select("gid", F.col("pivot").alias("node"))).distinct())
    shapes = known.select("node", "n", "profile")
    pair = "gid long, node long, a long, b long, gap long"

    def parted(rows: DataFrame, links: DataFrame) -> DataFrame:
        """The members of groups that lie in more than one component."""
        parts = labelled(rows.select("gid", "node"), links, "node", "component")
        mixed = parts.groupBy("gid").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("gid")
        return cut(parts.join(mixed, "gid"))

    def nearest_pairs(parts: DataFrame) -> DataFrame:
        """One row per member that may have links in its group; both ends of every such pair are among them."""
        return cut(parts.join(shapes, "node").groupBy("gid").applyInArrow(_nearest, pair))

    def open_pairs(parts: DataFrame) -> DataFrame:
        own = parts.groupBy("node").agg(F.collect_list("gid").alias("gids")).join(shapes, "node")
        named = parts.join(own, "node").withColumn("earlier", F.filter("gids", lambda g: g < F.col("gid"))).drop("gids")
        return named.groupBy("gid").applyInArrow(_all_pairs, pair)

    # First the nearest partner of each node, then the nearest one of each group, then all pairs that are still open.
    # A later step only takes the members for which the step before it saw a possible link.
    seen = nearest_pairs(members.withColumn("component", F.col("node")))
    first = cut(seen.groupBy("node").agg(F.min(F.struct("gap", "a", "b")).alias("p")).select("p.a", "p.b").distinct())
    tried = verify(first, bodies(first))
    for last in (False, True):
        parts = parted(seen, components(tried.where("good")))
        seen = open_pairs(parts) if last else nearest_pairs(parts)
        found = seen.select("a", "b") if last else seen.select("a", "b").distinct()
        more = cut(found.join(tried.select("a", "b"), ["a", "b"], "left_anti"))
        tried = cut(tried.unionByName(verify(more, bodies(more))))
    links = components(tried.where("good"))

    named = labelled(nodes.select("digest", "key").withColumnRenamed("digest", "node"), links, "node", "component")
    least = named.groupBy("component").agg(F.min("key").alias("least"))
    label = named.join(least, "component").select(F.col("node").alias("digest"), "least")
    own = facts.withColumn("digest", F.when(F.col("n") > 0, F.col("digest")).otherwise(-1 - F.abs(F.col("rk") % (1 << 62))))
    return own.join(label, "digest", "left").select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("key")).alias("component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of one document of each group of linked ones (the smallest key), all columns unchanged.

    Rows without words and rows without a key stay. Of the rows of one key one stays; it goes when all its rows lie in
    groups of a smaller key.
    """
    found = join(docs, key, text).where(F.col(key).isNotNull())
    state = cut(found.groupBy(key).agg(F.min(F.col("component_id") != F.col(key)).alias("goes"), F.count(F.lit(1)).alias("rows")))
    left = docs.join(state.where("goes").select(key), key, "left_anti")
    again = "_again"
    while again in {c.lower() for c in docs.columns}:
        again += "_"
    repeated = state.where("rows > 1").select(key, F.lit(True).alias(again))
    if repeated.isEmpty():
        return left.select(docs.columns)
    marked = left.join(repeated, key, "left")
    once = marked.where(F.col(again)).dropDuplicates([key])
    return marked.where(F.col(again).isNull()).unionByName(once).select(docs.columns)
