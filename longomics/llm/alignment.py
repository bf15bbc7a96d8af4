"""Two tokenizers side by side: each distinct text is encoded and aligned once, counts are weighted by its multiplicity.

Rows are shuffled by their full text and counted. Every distinct text is encoded by both vocabularies, the byte ranges
of the tokens are laid over each other, and its distinct linked pairs of ids are written with their uses. Both sides cut
a text at the spaces in it, so a worker encodes and aligns a segment between two such spaces once and adds segments up;
the number of segments it keeps is bounded. A pair's count
is the sum of the multiplicities of the texts that hold it. The ``head`` most frequent pairs (a fixed number, so the
size is bounded) go to the tasks as sorted arrays; only the uses of rarer pairs are joined. The measures of the texts
are then joined to the rows by digest. At most ``HOT`` texts can make up more than one part in ``HOT`` of the rows;
their measures go out as a broadcast, all others meet in a shuffled join, so that copies never gather in one task.

Defined cases: a null or empty text, or one whose joined token bytes differ from a space and the text, has no tokens:
zeros and an empty grouping; equal rows and null keys are counted and returned each; an empty table gives an empty
result; other columns are not read; very long texts are aligned whole, one at a time.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from ..runtime import cut, scratch_path

HEAD, HOT, CHUNK, FLUSH = 1 << 20, 1000, 1 << 19, 1 << 21
_CODERS: dict[str, tuple] = {}
# A space between characters that neither vocabulary joins across: where both sides cut a text in any case.
BORDER = re.compile(r"(?<=\S) (?=[!-~]|[^\W_])")
KEPT, KEPT_CHARS = 1 << 19, 1 << 23
_SEGMENTS: dict[tuple[str, str], Segments] = {}


def byte_values() -> dict[str, int]:
    """Printable stand-ins of byte-level vocabularies: printable Latin-1 stands for itself, the rest follows from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Coder:
    """Ids of texts and the bytes of every id. ``.json`` is byte-level BPE, ``.model`` pieces with byte fallback.

    ``cuts``: no token reaches over a ``BORDER``, so the stretches between them can be encoded one by one.
    """

    def __init__(self, path: str):
        self.pieces = path.endswith(".model")
        if self.pieces:
            self.coder = sentencepiece.SentencePieceProcessor(model_file=path)
            names = [self.coder.id_to_piece(k) for k in range(self.coder.get_piece_size())]
            self.bytes = [bytes([int(p[3:5], 16)]) if self.coder.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(names)]
            self.cuts = not any(re.search("[^▁]▁", p) for p in names)
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            self.coder = Tokenizer.from_file(path)
            self.coder.encode_special_tokens = True
            plan = json.loads(self.coder.to_str())
            split = plan["pre_tokenizer"] or {}
            self.cuts = (split.get("type") == "ByteLevel" and split.get("use_regex", True) and plan["normalizer"] is None
                         and all(t["special"] for t in plan["added_tokens"]))
            values = byte_values()
            vocabulary = self.coder.get_vocab(with_added_tokens=True)
            self.bytes = [b""] * (max(vocabulary.values()) + 1)
            for name, k in vocabulary.items():
                self.bytes[k] = bytes(values[c] for c in name) if all(c in values for c in name) else name.encode()
        self.sizes = np.array([len(b) for b in self.bytes], dtype=np.int64)
        # Decimal ids, left-aligned, with one place more for what follows.
        self.digits = np.zeros((len(self.bytes), len(str(len(self.bytes))) + 1), dtype=np.uint8)
        self.n_digits = np.array([len(str(k)) for k in range(len(self.bytes))], dtype=np.int64)
        for k in range(len(self.bytes)):
            self.digits[k, :self.n_digits[k]] = np.frombuffer(str(k).encode(), np.uint8)

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.pieces:
            return self.coder.encode(texts, num_threads=1)
        return [e.ids for e in self.coder.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


def coder(path: str) -> Coder:
    """The tokenizer, once per worker."""
    if path not in _CODERS:
        _CODERS[path] = Coder(path)
    return _CODERS[path]


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of overlapping ranges of two partitions of one stretch, given their ends, and where both end.

    A piece between two neighbouring ends lies in one range of each side, and two ranges share at most one piece.
    """
    size = int(ends_a[-1]) if len(ends_a) else 0
    mark = np.zeros(size + 1, dtype=np.uint8)
    mark[ends_a] |= 1
    mark[ends_b] |= 2
    kind = mark[np.flatnonzero(mark)]
    of_a, of_b = kind & 1, kind >> 1
    return np.cumsum(of_a) - of_a, np.cumsum(of_b) - of_b, kind == 3


def group_text(a: Coder, b: Coder, ids_a: np.ndarray, ids_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> np.ndarray:
    """Bytes of ``a,a|b;a|b,b;`` for tokens with their group numbers, all groups one after the other."""
    def closing(groups: np.ndarray, last: str) -> np.ndarray:
        out = np.full(len(groups), ord(","), dtype=np.uint8)
        out[np.append(groups[1:] != groups[:-1], True) if len(groups) else []] = ord(last)
        return out

    order = np.argsort(np.concatenate((2 * group_a, 2 * group_b + 1)), kind="stable")
    width = max(a.digits.shape[1], b.digits.shape[1])
    cells = np.zeros((len(order), width), dtype=np.uint8)
    cells[:len(ids_a), :a.digits.shape[1]] = a.digits[ids_a]
    cells[len(ids_a):, :b.digits.shape[1]] = b.digits[ids_b]
    lengths = np.concatenate((a.n_digits[ids_a], b.n_digits[ids_b]))
    cells[np.arange(len(order)), lengths] = np.concatenate((closing(group_a, "|"), closing(group_b, ";")))
    cells = cells[order]
    return cells[cells != 0]


def lay(texts: list[str], a: Coder, b: Coder) -> tuple[np.ndarray, ...]:
    """Of the texts that both sides give back: places, n_a, n_b, n_groups, n_links; then of all these texts one after
    the other: linked id pairs, the groups' text and where the text of each ends."""
    raw = [t.encode() for t in texts]
    all_a, all_b = a.encode(texts), b.encode(texts)
    good = [k for k, t in enumerate(raw) if t and b"".join([a.bytes[i] for i in all_a[k]]) == b" " + t
            and b"".join([b.bytes[i] for i in all_b[k]]) == b" " + t]
    if not good:
        return (*[np.zeros(0, np.int64)] * 5, np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(0, np.int64))
    ids_a = np.concatenate([np.asarray(all_a[k], np.int64) for k in good])
    ids_b = np.concatenate([np.asarray(all_b[k], np.int64) for k in good])
    n_a, n_b = (np.array([len(x[k]) for k in good]) for x in (all_a, all_b))
    at_a, at_b, both = overlaps(np.cumsum(a.sizes[ids_a]), np.cumsum(b.sizes[ids_b]))
    # Every text ends with both sides, so links of a text and groups of a text are stretches of the whole.
    end_link = np.searchsorted(at_a, np.cumsum(n_a), side="left")
    group = np.cumsum(both) - both
    end_group = np.concatenate(([0], np.cumsum(both)))[end_link]
    first_a = np.flatnonzero(np.diff(at_a, prepend=-1))
    first_b = np.flatnonzero(np.diff(at_b, prepend=-1))
    text = group_text(a, b, ids_a, ids_b, group[first_a], group[first_b])
    pairs = (ids_a[at_a].astype(np.uint64) << np.uint64(32)) | ids_b[at_b].astype(np.uint64)
    return (np.array(good), n_a, n_b, np.diff(end_group, prepend=0), np.diff(end_link, prepend=0), pairs, text,
            np.flatnonzero(text == ord(";"))[end_group - 1])


def row(counts: np.ndarray, text: bytes, pairs: np.ndarray) -> tuple:
    """Row of one text: its four counts, digest of the groups, linked id pairs (distinct) and their uses."""
    own = np.sort(pairs)
    begin = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    return (*counts.tolist(), hashlib.sha256(text).hexdigest(), own[begin], np.diff(begin, append=len(own)))


EMPTY = (0, 0, 0, 0, "", np.zeros(0, np.uint64), np.zeros(0, np.int64))


def align_whole(texts: list[str], a: Coder, b: Coder) -> list[tuple]:
    """Rows of texts that are encoded from end to end."""
    out: list[tuple] = [EMPTY] * len(texts)
    good, *counts, pairs, text, end_text = lay(texts, a, b)
    low, start = 0, 0
    for k, i in enumerate(good):
        own = np.array([c[k] for c in counts])
        out[i] = row(own, text[start:end_text[k]].tobytes(), pairs[low:low + own[3]])
        low, start = low + own[3], end_text[k] + 1
    return out


class Segments:
    """The stretches between borders met so far, each encoded and aligned once."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.names: list[bytes] = []
        self.size = 0
        self.n_pairs = 0
        # Counts and place of the first pair (-1: not given back) of every segment; both arrays have room to grow.
        self.counts, self.pairs = np.zeros((1 << 12, 5), np.int64), np.zeros(1 << 12, np.uint64)

    def add(self, new: list[str], a: Coder, b: Coder) -> None:
        good, *counts, pairs, text, end_text = lay(new, a, b)
        have, n = len(self.names), len(new)
        self.number.update(zip(new, range(have, have + n)))
        self.size += sum(map(len, new))
        names, data, start = [b""] * n, text.tobytes(), 0
        for i, end in zip(good.tolist(), end_text.tolist()):
            names[i], start = data[start:end], end + 1
        self.names += names
        while len(self.counts) < have + n:
            self.counts = np.concatenate((self.counts, np.zeros_like(self.counts)))
        while len(self.pairs) < self.n_pairs + len(pairs):
            self.pairs = np.concatenate((self.pairs, np.zeros_like(self.pairs)))
        more = self.counts[have:have + n]
        more[:, 4] = -1
        more[good, :4] = np.column_stack(counts)
        more[good, 4] = self.n_pairs + np.cumsum(counts[3]) - counts[3]
        self.pairs[self.n_pairs:self.n_pairs + len(pairs)] = pairs
        self.n_pairs += len(pairs)


def align(texts: list[str], a: Coder, b: Coder, kept: Segments | None = None) -> list[tuple]:
    """Per text: n_a, n_b, n_groups, n_links, digest of the groups, linked id pairs (distinct) and their uses.

    Both sides cut at every border, so the measures of a text add up from its segments. A text with a segment that a
    side does not give back is encoded from end to end.
    """
    if not (a.cuts and b.cuts):
        return align_whole(texts, a, b)
    kept = Segments() if kept is None else kept
    parts = [BORDER.split(t) for t in texts]
    if new := [s for s in dict.fromkeys(s for p in parts for s in p) if s not in kept.number]:
        kept.add(new, a, b)
    number = kept.number
    at = np.array([number[s] for p in parts for s in p], np.int64)
    ends = np.cumsum([len(p) for p in parts])
    starts = ends - [len(p) for p in parts]
    own = kept.counts[at]
    links = own[:, 3]
    up_to = np.concatenate(([0], np.cumsum(links)))
    pairs = kept.pairs[np.repeat(own[:, 4] - up_to[:-1], links) + np.arange(up_to[-1])]
    good = np.minimum.reduceat(own[:, 4], starts) >= 0 if len(texts) else np.zeros(0, bool)
    sums = np.add.reduceat(own[:, :4], starts) if len(texts) else own[:, :4]
    places, names = at.tolist(), kept.names
    out: list[tuple] = [EMPTY] * len(texts)
    for k in np.flatnonzero(good):
        lo, hi = starts[k], ends[k]
        out[k] = row(sums[k], b";".join([names[i] for i in places[lo:hi]]), pairs[up_to[lo]:up_to[hi]])
    whole = np.flatnonzero(~good).tolist()
    for k, found in zip(whole, align_whole([texts[k] for k in whole], a, b) if whole else []):
        out[k] = found
    return out


def pack(pairs: np.ndarray, uses: np.ndarray) -> bytes:
    """Sorted pairs and their uses: steps of the left ids, right ids, uses, in columns."""
    left, right = pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)
    return np.concatenate((np.diff(left, prepend=np.uint64(0)), right, uses.astype(np.uint64))).astype(np.uint32).tobytes()


def unpack(rows: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs and uses of all rows one after the other, and the number of pairs up to each row's end."""
    parts = [np.frombuffer(r.as_py(), np.uint32).reshape(3, -1) for r in rows]
    ends = np.cumsum([p.shape[1] for p in parts])
    if not len(ends) or not ends[-1]:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), ends
    left = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
    return (left << np.uint64(32)) | np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts]).astype(np.int64), ends


def aligned_texts(docs: DataFrame, path_a: str, path_b: str, text: str = "text") -> DataFrame:
    """One row per distinct text: its digest, multiplicity, measures and packed pairs."""
    distinct = docs.select(F.col(text).alias("t")).where("t <> ''").groupBy("t").agg(F.count(F.lit(1)).alias("n"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = coder(path_a), coder(path_b)
        for batch in batches:
            texts, many = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            lo = 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= CHUNK):
                    size += len(texts[hi])
                    hi += 1
                kept = _SEGMENTS.get((path_a, path_b))
                if kept is None or len(kept.names) > KEPT or kept.size > KEPT_CHARS:
                    kept = _SEGMENTS[path_a, path_b] = Segments()
                rows = align(texts[lo:hi], a, b, kept)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([hashlib.sha256(t.encode()).digest() for t in texts[lo:hi]], pa.binary()), pa.array(many[lo:hi], pa.int64()),
                     *(pa.array([r[c] for r in rows], pa.int64()) for c in range(4)), pa.array([r[4] for r in rows], pa.string()),
                     pa.array([pack(r[5], r[6]) for r in rows], pa.binary())],
                    names=["key", "n", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "packed"])
                lo = hi

    return distinct.mapInArrow(work, "key binary, n long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, packed binary")


def pair_counts(texts: DataFrame) -> DataFrame:
    """Rows that hold a pair: a, b, n, and whether n is the highest of its a."""
    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            pairs, n = (np.concatenate([h[c] for h in held]) for c in (0, 1))
            order = np.argsort(pairs, kind="stable")
            pairs = pairs[order]
            begin = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1])))
            return pairs[begin], np.add.reduceat(n[order], begin)

        def rows(pairs: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array((pairs >> np.uint64(32)).astype(np.int32)),
                                               pa.array((pairs & np.uint64(0xFFFFFFFF)).astype(np.int32)), pa.array(n, pa.int64())], names=["a", "b", "n"])

        for batch in batches:
            pairs, _, ends = unpack(batch.column(1))
            held.append((pairs, np.repeat(batch.column(0).to_numpy(zero_copy_only=False), np.diff(ends, prepend=0))))
            size += len(pairs)
            if size > FLUSH:
                held = [merged()]
                size = len(held[0][0])
                if size > FLUSH // 2:  # too many distinct pairs to hold: the aggregate behind adds them up
                    yield rows(*held[0])
                    held, size = [], 0
        if size:
            yield rows(*merged())

    counts = cut(texts.select("n", "packed").mapInArrow(tally, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")))
    # One row per id of the first vocabulary: a bound on what is broadcast.
    best = F.broadcast(counts.groupBy("a").agg(F.max("n").alias("best")))
    return counts.join(best, "a").select("a", "b", "n", (F.col("n") == F.col("best")).alias("is_best"))


def _head(counts: DataFrame, head: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, DataFrame]:
    """At most ``head`` of the most frequent pairs as sorted arrays, and the others as a table."""
    level = F.floor(F.log2("n") * 16).cast("int")
    levels = {r["level"]: r["count"] for r in counts.groupBy(level.alias("level")).count().collect()}
    least, total = None, 0
    for at in sorted(levels, reverse=True):
        total += levels[at]
        if total > head:
            break
        least = at
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool), counts
    top = counts.where(level >= least).toPandas()
    keys = (top["a"].to_numpy(np.uint64) << np.uint64(32)) | top["b"].to_numpy(np.uint64)
    order = np.argsort(keys)
    return keys[order], top["n"].to_numpy(np.int64)[order], top["is_best"].to_numpy(bool)[order], counts.where(level < least)


def text_measures(texts: DataFrame, counts: DataFrame, head: int = HEAD) -> DataFrame:
    """key, n, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every distinct text."""
    keys, n, best, rest = _head(counts, head)
    shared = texts.sparkSession.sparkContext.broadcast((keys, n, best))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counted, highest = shared.value
        for batch in batches:
            names = batch.column(0)
            pairs, uses, ends = unpack(batch.column(1))
            slot = np.minimum(np.searchsorted(known, pairs), max(len(known) - 1, 0))
            met = known[slot] == pairs if len(known) else np.zeros(len(pairs), bool)
            found = np.where(met, slot, 0)
            best, total = (np.concatenate(([0], np.cumsum(np.where(met, uses * x[found], 0) if len(known) else met.astype(np.int64))))
                           for x in (highest, counted))
            steps = [np.diff(x[ends], prepend=0) for x in (best, total)]
            rows = np.searchsorted(ends, np.flatnonzero(~met), side="right")
            more, nulls = pairs[~met], pa.nulls(len(rows), pa.int64())
            # A row's own sums carry an id that no pair has, and spread by the digest.
            spread = np.array([int.from_bytes(x[:4], "little", signed=True) for x in names.to_pylist()], np.int32)
            both = lambda x, y: pa.concat_arrays([pa.array(x), y if isinstance(y, pa.Array) else pa.array(y)])
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([names, names.take(pa.array(rows))]), both(steps[0], nulls), both(steps[1], nulls),
                 both(np.full(len(names), -1, np.int32), (more >> np.uint64(32)).astype(np.int32)),
                 both(spread, (more & np.uint64(0xFFFFFFFF)).astype(np.int32)), both(np.zeros(len(names), np.int64), uses[~met])],
                names=["key", "n_best", "count_sum", "a", "b", "uses"])

    scored = texts.select("key", "packed").mapInArrow(score, "key binary, n_best long, count_sum long, a int, b int, uses long")
    summed = scored.join(rest, ["a", "b"], "left").groupBy("key").agg(
        F.sum(F.coalesce("n_best", F.lit(0)) + F.when(F.col("is_best"), F.col("uses")).otherwise(0)).alias("n_best"),
        F.sum(F.coalesce("count_sum", F.lit(0)) + F.coalesce(F.col("uses") * F.col("n"), F.lit(0))).alias("count_sum"))
    return texts.drop("packed").join(summed, "key")


MEASURES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text",
                     head: int = HEAD) -> tuple[DataFrame, DataFrame]:
    """Per input row: key, the measures, groups_sha256. And the table of linked pairs (a, b, n, is_best)."""
    spark = docs.sparkSession
    aligned_texts(docs, path_a, path_b, text).write.option("compression", "zstd").parquet(path := scratch_path(spark, "alignment"))
    texts = spark.read.parquet(path)
    counts = pair_counts(texts)
    measures = cut(text_measures(texts, counts, head))
    total = measures.agg(F.sum("n").alias("n")).first()["n"] or 0
    hot = F.col("n") > total / HOT
    text_key = F.when(F.col(text) != "", F.unhex(F.sha2(F.col(text), 256)))
    keyed = cut(docs.select(F.col(key).alias("_id"), text_key.alias("key")))
    columns = ["_id", *MEASURES, "groups_sha256"]
    first = keyed.where("key IS NOT NULL").join(F.broadcast(measures.where(hot)), "key", "left")
    others = first.where("n IS NULL").select("_id", "key").join(measures.where(~hot), "key")
    zero = keyed.where("key IS NULL").select("_id", *[F.lit(0).cast("long").alias(m) for m in MEASURES], F.lit("").alias("groups_sha256"))
    rows = first.where("n IS NOT NULL").select(columns).unionByName(others.select(columns)).unionByName(zero)
    return rows.select(F.col("_id").alias(key), *columns[1:]), counts
