"""Periodic runs of words, found on a grammar: Re-Pair, borders of the rules, derivation positions, maximal intervals.

A run is a stretch of words with smallest period q, at least ``least`` words and two periods long, that no neighbouring
word extends. Every text is compressed by Re-Pair into rules of two symbols. Each rule's border is looked at once, for
the periodic stretches of the rule's own text that cross it (longest extensions to both sides). The derivation tree then
gives every position of the rule. The lowest node that holds a whole run has it across its border, so all runs are met;
parts of a run that end at a node's end lie inside the whole run and go in the merge.

In a run each word lies in some group of ``(least + 1) // 2`` consecutive words that the text holds twice. Words that
lie in no such group are borders that no run can hold, so the grammar is built of the stretches between them, together
for a text. The groups are told by hashes: a collision makes a stretch longer and changes no run.

Defined cases: a null or empty text has no words, no runs and an empty collapsed text; rows are independent, so repeated
rows and null keys give a row each and an empty table none; other columns are not read; a very long text is one row of
work, near n log n.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .base import chunks, mix, text_bytes, word_hashes

LEAST, CHUNK = 12, 1 << 22
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_PLACE = np.random.default_rng(131).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def re_pair(seq: Sequence[int]) -> tuple[list[tuple[int, int]], dict[int, tuple[int, int, int, int]]]:
    """Rules of the most frequent pair until every pair is single. Ids of ``seq`` are below its length.

    Returns the symbols left as (symbol, position) and per new symbol (left, right, length, first position). Pairs of
    one frequency are taken in the order in which they came up, which keeps the derivation shallow.
    """
    n = len(seq)
    sym, after, before = list(seq), list(range(1, n + 1)), list(range(-1, n - 1))
    often = {p for p, c in Counter(zip(seq, seq[1:])).items() if c > 1}
    places: dict[tuple[int, int], list[int]] = {}
    for i, pair in enumerate(zip(seq, seq[1:])):
        if pair in often:
            places.setdefault(pair, []).append(i)
    queue = [(-len(at), k, pair) for k, (pair, at) in enumerate(places.items())]
    heapq.heapify(queue)
    serial, fresh, rules, size = len(queue), n, {}, {}

    def standing(pair: tuple[int, int]) -> list[int]:
        """Positions where the pair still stands, none overlapping the one before."""
        a, b = pair
        out, busy = [], -1
        for i in places[pair]:
            j = after[i]
            if sym[i] == a and j < n and sym[j] == b and i != busy:
                out.append(i)
                busy = j
        return out

    while queue:
        count, _, pair = heapq.heappop(queue)
        at = standing(pair)
        if len(at) < 2:
            del places[pair]
            continue
        if len(at) < -count:
            places[pair] = at if pair[0] != pair[1] else places[pair]
            serial += 1
            heapq.heappush(queue, (-len(at), serial, pair))
            continue
        del places[pair]
        a, b = pair
        rules[fresh] = (a, b, size.get(a, 1) + size.get(b, 1), at[0])
        size[fresh] = rules[fresh][2]
        made: dict[tuple[int, int], list[int]] = {}
        for i in at:
            j = after[i]
            k = after[j]
            sym[i], sym[j], after[i] = fresh, -1, k
            if k < n:
                before[k] = i
                made.setdefault((fresh, sym[k]), []).append(i)
            if (p := before[i]) >= 0:
                made.setdefault((sym[p], fresh), []).append(p)
        for new, where in made.items():
            if len(where) > 1:
                where.sort()
                places[new] = where
                serial += 1
                heapq.heappush(queue, (-len(where), serial, new))
        fresh += 1
    left, i = [], 0
    while i < n:
        left.append((sym[i], i))
        i = after[i]
    return left, rules


def common_starts(seq: list[int]) -> list[int]:
    """Per position the length of the longest common start of the sequence and its rest from there."""
    n = len(seq)
    z = [0] * n
    lo = hi = 0
    for i in range(1, n):
        k = min(hi - i, z[i - lo]) if i < hi else 0
        if i + k >= hi:
            while i + k < n and seq[k] == seq[i + k]:
                k += 1
            lo, hi = i, i + k
        z[i] = k
    if n:
        z[0] = n
    return z


def crossing(text: list[int], middle: int, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, end, smallest period) of the periodic stretches of ``text`` across ``middle``, none extensible in it."""
    left, right = text[:middle], text[middle:]
    right_in_text = common_starts(right + [-1] + text)
    left_in_text = common_starts(left[::-1] + [-1] + text[::-1])
    n, n_left, n_right = len(text), len(left), len(right)
    best: dict[tuple[int, int], int] = {}

    def offer(start: int, end: int, q: int) -> None:
        if end - start >= max(least, 2 * q) and q < best.get((start, end), n):
            best[start, end] = q

    for q in range(1, n // 2 + 1):
        if q <= n_right:  # a whole period to the right of the border
            back = left_in_text[n_left + 1 + n_right - q]
            if back > 0:
                offer(middle - back, middle + q + (right_in_text[q] if q < n_right else 0), q)
        if q <= n_left:  # a whole period to its left
            on = right_in_text[n_right + 1 + n_left - q]
            if on > 0:
                offer(middle - q - (left_in_text[q] if q < n_left else 0), middle + on, q)
    return [(start, end, q) for (start, end), q in best.items()]


def stretch_runs(parts: list[list[int]], least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """Runs (start, end, period) of every part; the parts share one grammar."""
    ids: dict[int, int] = {}
    named = [[ids.setdefault(w, len(ids)) for w in part] for part in parts]
    seq: list[int] = []
    for k, part in enumerate(named):  # a symbol that stands once ends a part
        seq += [*part, len(ids) + k]
    symbols, rules = re_pair(seq)
    fresh = max(rules, default=len(seq) - 1) + 1

    def width(s: int) -> int:
        return rules[s][2] if s in rules else 1

    # The symbols left of a part are joined two by two: the rules that only the start uses.
    roots, row = [], []
    for symbol, place in symbols:
        if len(ids) <= symbol < len(ids) + len(parts):
            while len(row) > 1:
                joined = []
                for k in range(0, len(row) - 1, 2):
                    (a, i), (b, _) = row[k], row[k + 1]
                    rules[fresh] = (a, b, width(a) + width(b), i)
                    joined.append((fresh, i))
                    fresh += 1
                row = joined + (row[-1:] if len(row) % 2 else [])
            roots.append(row[0] if row else None)
            row = []
        else:
            row.append((symbol, place))
    found, holds = {}, set()
    for s, (a, b, size, first) in rules.items():  # rules come after the rules they use
        if size >= least:
            found[s] = crossing(seq[first:first + size], width(a), least)
            if found[s] or a in holds or b in holds:
                holds.add(s)
    out = []
    for root in roots:
        spans: list[tuple[int, int, int]] = []
        stack = [root] if root and root[0] in holds else []
        origin = root[1] if root else 0
        while stack:
            s, place = stack.pop()
            spans += [(q, place - origin + start, place - origin + end) for start, end, q in found[s]]
            a, b = rules[s][:2]
            if b in holds:
                stack.append((b, place + width(a)))
            if a in holds:
                stack.append((a, place))
        spans.sort(key=lambda r: (r[0], r[1], -r[2]))
        whole, period, reach = [], 0, -1
        for q, start, end in spans:
            if q != period:
                period, reach = q, -1
            if end > reach:
                whole.append((start, end, q))
                reach = end
        out.append(sorted(whole, key=lambda r: (r[0], r[2])))
    return out


def repeated_cover(hashes: np.ndarray, rows: np.ndarray, width: int) -> np.ndarray:
    """Words that lie in ``width`` consecutive words which their row holds twice or more."""
    n = len(hashes)
    cover = np.zeros(n, dtype=bool)
    if n <= width:
        return cover
    m = n - width + 1
    with np.errstate(over="ignore"):
        grams = rows[:m].astype(np.uint64) * _PLACE[width]
        for k in range(width):
            grams += hashes[k:k + m] * _PLACE[k]
    grams = mix(grams)
    inside = rows[:m] == rows[width - 1:]
    ordered = np.sort(grams[inside])
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return cover
    slot = np.minimum(np.searchsorted(twice, grams), len(twice) - 1)
    hit = np.flatnonzero(inside & (twice[slot] == grams))
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + width, -1)
    return np.cumsum(edge[:-1]) > 0


def text_runs(words: list[bytes], cover: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a text by start and period; ``cover`` marks words that may lie in one."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], cover.view(np.int8), [0]))))
    spans = [(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2]) if b - a >= least]
    if not spans:
        return []
    ids: dict[bytes, int] = {}
    parts = [[ids.setdefault(w, len(ids)) for w in words[a:b]] for a, b in spans]
    return [(a + start, end - start, q) for (a, _), runs in zip(spans, stretch_runs(parts, least)) for start, end, q in runs]


def keep_first(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words outside every run's part after its first period."""
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, q in runs:
        gone[start + q] += 1
        gone[start + length] -= 1
    return [w for w, g in zip(words, np.cumsum(gone)) if not g]


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST,
         arrange: Callable[[object, int], np.ndarray | None] | None = None) -> DataFrame:
    """One row per input row: key, n_words, runs (start, length, period), collapsed (kept words joined by a space).

    ``arrange(key, n)`` may name the order in which the n words of a text are read (positions, or None for as they are).
    """
    width = (least + 1) // 2

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1).cast(pa.large_string())
            raw, offsets = text_bytes(column)
            for lo, hi in chunks(offsets, CHUNK):
                yield part(batch.column(0).slice(lo, hi - lo), raw[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])

    def part(keys: pa.Array, raw: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        hashes, rows = word_hashes(raw, offsets, lower=False)
        ends = np.searchsorted(rows, np.arange(len(keys)), side="right")
        starts, sizes = np.concatenate(([0], ends[:-1])), np.diff(ends, prepend=0)
        orders: dict[int, np.ndarray] = {}
        if arrange:
            for k, (name, n) in enumerate(zip(keys.to_pylist(), sizes.tolist())):
                if n and (order := arrange(name, n)) is not None:
                    orders[k] = order
                    hashes[starts[k]:ends[k]] = hashes[starts[k]:ends[k]][order]
        cover = repeated_cover(hashes, rows, width)
        data = raw.tobytes()
        found, collapsed = [], []
        for k in range(len(keys)):
            words = data[offsets[k]:offsets[k + 1]].split()
            if k in orders:
                words = [words[i] for i in orders[k].tolist()]
            runs = text_runs(words, cover[starts[k]:ends[k]], least)
            found.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
            collapsed.append(b" ".join(keep_first(words, runs) if runs else words))
        return pa.RecordBatch.from_arrays(
            [keys, pa.array(sizes, pa.int64()), pa.array(found, pa.list_(RUN)), pa.array(collapsed, pa.binary()).cast(pa.string())],
            names=[key, "n_words", "runs", "collapsed"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).mapInArrow(
        work, f"`{key}` {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Number of runs, the longest one (ties: smallest start, then period) and digests of all runs and kept words."""
    by_length = F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("size"), r["start"].alias("start"), r["period"].alias("period"))))
    top = found.select(key, "runs", "collapsed", F.get(by_length, F.lit(0)).alias("_top"))
    length, period = -F.col("_top.size"), F.col("_top.period")
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))))
    return top.select(
        key, F.size("runs").cast("long").alias("n_runs"), F.col("_top.start").alias("start"), length.alias("length"),
        period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
