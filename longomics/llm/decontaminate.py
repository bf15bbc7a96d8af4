"""Benchmark decontamination: a BM25 index of the test items, queried by every passage of every text.

Items are cut into blocks; impacts are divided by the item's score against itself, so 1 is a full hit and one threshold
serves all. Passages are windows of ``2 * longest item`` words, moved by the longest item, so an item lies whole in one
of them. A passage is scored in three steps, all without losing an item above the threshold:

1. essential terms only: the common terms that together cannot lift any item by more than ``SLACK`` are left out;
   block maxima of the rest must reach threshold - SLACK in some block;
2. block maxima over all terms must reach the threshold in a block;
3. the items of such blocks are scored exactly.

Items above the threshold are verified: enough word runs of the question part and of the answer part (the last
sentence, or the last quarter) stand in the passage.

The index is broadcast. Its size is checked: items are indexed in groups of at most ``GROUP_BYTES`` of text, one pass
of the corpus per group, and the passes are united.

Defined cases: null and blank texts and items are neither hits nor hit; repeated documents give repeated rows, repeated
items each a hit of their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .base import MARKS, chunks, text_bytes, word_hashes

GROUP_BYTES, BLOCK, CHUNK = 16 << 20, 16, 4 << 20
K1, B = 1.2, 0.75
THRESHOLD, SLACK = 0.6, 0.25
RUN, QUESTION, ANSWER = 5, 0.6, 0.6
_SPLIT = re.compile(r"(?<=[.!?\n])\s+(?=\S)")


def _words(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    return word_hashes(raw, np.array([0, len(raw)]), border=MARKS)[0]


def _runs(words: np.ndarray) -> set:
    n = min(RUN, len(words))
    return {words[k:k + n].tobytes() for k in range(len(words) - n + 1)} if n else set()


def parts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Words of the question and of the answer."""
    sentences = _SPLIT.split(text.strip())
    if len(sentences) > 1:
        asked, answer = _words(" ".join(sentences[:-1])), _words(sentences[-1])
        if len(asked) and len(answer):
            return asked, answer
    words = _words(text)
    at = max(1, len(words) - max(1, len(words) // 4)) if len(words) > 1 else len(words)
    return words[:at], words[at:]


class Index:
    """Impact lists by block, block maxima by term, and the parts used to verify."""

    def __init__(self, items: list[tuple]):
        self.ids, self.texts = [], []
        words = []
        for item, text in items:
            found = _words(text or "")
            if len(found):
                self.ids.append(item)
                self.texts.append(text)
                words.append(found)
        n = len(words)
        self.longest = max(map(len, words), default=1)
        self.terms = np.unique(np.concatenate(words)) if n else np.zeros(0, np.uint64)
        mean = sum(map(len, words)) / max(n, 1)
        seen = np.zeros(len(self.terms), dtype=np.int64)
        rows = []
        for found in words:
            values, tf = np.unique(found, return_counts=True)
            at = np.searchsorted(self.terms, values)
            seen[at] += 1
            rows.append((at, tf, len(found)))
        idf = np.log1p((n - seen + 0.5) / (seen + 0.5))
        self.post_term, self.post_item, self.post_value = [], [], []
        for k, (at, tf, size) in enumerate(rows):
            impact = idf[at] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean))
            self.post_term.append(at)
            self.post_item.append(np.full(len(at), k))
            self.post_value.append(impact / impact.sum())
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        term, item, value = join(self.post_term, int), join(self.post_item, int), join(self.post_value, float)
        del self.post_term, self.post_item, self.post_value
        order = np.lexsort((item, term))
        self.term, self.item, self.value = term[order], item[order], value[order]
        self.start = np.searchsorted(self.term, np.arange(len(self.terms) + 1))
        # Block maxima: one entry per (term, block).
        block = self.item // BLOCK
        first = np.ones(len(block), dtype=bool)
        first[1:] = (block[1:] != block[:-1]) | (self.term[1:] != self.term[:-1])
        at = np.flatnonzero(first)
        self.max_block = block[at]
        self.max_value = np.maximum.reduceat(self.value, at) if len(at) else np.zeros(0)
        self.max_start = np.searchsorted(self.term[at], np.arange(len(self.terms) + 1))
        self.blocks = -(-n // BLOCK) if n else 0
        # Common terms first until some item could gain more than SLACK from those left out.
        gain, self.essential = np.zeros(n), np.ones(len(self.terms), dtype=bool)
        for t in np.argsort(-seen, kind="stable"):
            span = slice(self.start[t], self.start[t + 1])
            if (gain[self.item[span]] + self.value[span]).max(initial=0) > SLACK:
                break
            gain[self.item[span]] += self.value[span]
            self.essential[t] = False
        self.sides = [tuple(map(_runs, parts(t))) for t in self.texts]
        # Terms by their low bits, to pass over words of no item quickly.
        self.known = np.zeros(1 << 20, dtype=bool)
        self.known[(self.terms & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def bounds(self, passage: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """(n, blocks) sums of block maxima of distinct (passage, term) pairs."""
        width = self.max_start[term + 1] - self.max_start[term]
        where = np.repeat(self.max_start[term] - np.cumsum(width) + width, width) + np.arange(width.sum())
        flat = np.bincount(np.repeat(passage, width) * self.blocks + self.max_block[where], weights=self.max_value[where],
                           minlength=n * self.blocks)
        return flat.reshape(n, self.blocks)

    def hits(self, words: np.ndarray, rows: np.ndarray) -> list[tuple[int, int, float, float, float]]:
        """(row, item, score, question share, answer share) of the verified items; rows ascend."""
        step = max(self.longest, 8)
        mask = np.uint64((1 << 20) - 1)
        maybe = np.flatnonzero(self.known[(words & mask).astype(np.int64)])
        if not len(maybe):
            return []
        at = np.searchsorted(self.terms, words[maybe])
        at[at == len(self.terms)] = 0
        same = self.terms[at] == words[maybe]
        place, term = maybe[same], at[same]
        if not len(place):
            return []
        first = np.searchsorted(rows, rows[place])  # first word of the row
        slot = (place - first) // step
        # Windows of a row: slots s - 1 and s share the words of slot s.
        base = first // step + rows[place] + 1  # distinct and increasing from row to row
        window = base + slot
        rare = self.essential[term]
        n_terms = len(self.terms)
        both = np.unique(np.concatenate([window[rare], window[rare] - 1]) * n_terms + np.tile(term[rare], 2))
        found: list[tuple[int, int, float, float, float]] = []
        if not len(both):
            return found
        names, inverse = np.unique(both // n_terms, return_inverse=True)
        terms_of, alive = both % n_terms, []
        for k in range(0, len(names), 4096):
            part = slice(*np.searchsorted(inverse, [k, k + 4096]))
            bound = self.bounds(inverse[part] - k, terms_of[part], min(4096, len(names) - k))
            alive.append(names[k:k + 4096][(bound >= THRESHOLD - SLACK - 1e-9).any(axis=1)])
        alive = np.concatenate(alive)
        order = np.argsort(window, kind="stable")
        sorted_window = window[order]
        done: set[tuple[int, int]] = set()
        for w in alive:
            mine = order[np.searchsorted(sorted_window, w):np.searchsorted(sorted_window, w + 2)]
            for row in np.unique(rows[place[mine]]):
                own = mine[rows[place[mine]] == row]
                terms = np.unique(term[own])
                bound = self.bounds(np.zeros(len(terms), dtype=np.int64), terms, 1)[0]
                open_block = bound >= THRESHOLD - 1e-9
                if not open_block.any():
                    continue
                width = self.start[terms + 1] - self.start[terms]
                where = np.repeat(self.start[terms] - np.cumsum(width) + width, width) + np.arange(width.sum())
                where = where[open_block[self.item[where] // BLOCK]]
                scores = np.bincount(self.item[where], weights=self.value[where], minlength=len(self.ids))
                near = np.flatnonzero(scores >= THRESHOLD - 1e-9)
                if not len(near):
                    continue
                begin = max(int(first[own[0]]), int(place[own].min()) - 2 * RUN)
                stop = min(int(place[own].max()) + 2 * RUN + 1, int(np.searchsorted(rows, row, side="right")))
                runs_by_size: dict[int, set] = {}
                for item in near:
                    if (int(row), int(item)) in done:
                        continue
                    shares = []
                    for side in self.sides[item]:
                        size = len(next(iter(side))) // 8 if side else 0
                        if size and size not in runs_by_size:
                            runs_by_size[size] = {words[k:k + size].tobytes() for k in range(begin, stop - size + 1)}
                        shares.append(len(side & runs_by_size[size]) / len(side) if side else 1.0)
                    if shares[0] >= QUESTION and shares[1] >= ANSWER:
                        done.add((int(row), int(item)))
                        found.append((int(row), int(item), float(scores[item]), *shares))
        return found


def indexes(benchmark: DataFrame, key: str = "item_id", text: str = "text") -> list[Index]:
    """One index per group of items; groups hold at most about GROUP_BYTES of text."""
    items = benchmark.select(F.col(key).alias("item"), F.col(text).alias("t")).where(F.length("t") > 0)
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    groups = -(-2 * total // GROUP_BYTES) if total > GROUP_BYTES else 1
    out = []
    for g in range(groups):
        chosen = items if groups == 1 else items.where(F.pmod(F.xxhash64("item", "t"), F.lit(groups)) == g)
        out.append(Index([(r["item"], r["t"]) for r in chosen.orderBy("item", "t").collect()]))
    return out


def _scan(column: pa.Array, index: Index) -> Iterator[tuple[int, int, float, float, float]]:
    raw, offsets = text_bytes(column)
    for a, b in chunks(offsets, CHUNK):
        words, rows = word_hashes(raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], border=MARKS)
        if len(words) and index.ids:
            for row, *rest in index.hits(words, rows):
                yield (a + row, *rest)


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
               item_text: str = "text") -> DataFrame:
    """key, item, score, question_share, answer_share: one row per document and item that it holds."""
    kind, item_kind = docs.schema[key].dataType.simpleString(), benchmark.schema[item_key].dataType.simpleString()
    item_type = benchmark.select(item_key).schema

    def scan(index: Index) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in batches:
                found = list(_scan(batch.column(1), own))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([f[0] for f in found], pa.int64())),
                     pa.array([own.ids[f[1]] for f in found], arrow_item),
                     *[pa.array([f[k] for f in found], pa.float64()) for k in (2, 3, 4)]],
                    names=[key, item_key, "score", "question_share", "answer_share"])

        return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, `{item_key}` {item_kind}, score double, question_share double, answer_share double")

    from pyspark.sql.pandas.types import to_arrow_type
    arrow_item = to_arrow_type(item_type[0].dataType)
    return reduce(DataFrame.unionByName, [scan(index) for index in indexes(benchmark, item_key, item_text)])


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows that hold no item, all columns unchanged."""
    place = docs.columns.index(text)
    for index in indexes(benchmark, item_key, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hit = np.zeros(len(batch), dtype=bool)
                for row, *_ in _scan(batch.column(place), shared.value):
                    hit[row] = True
                yield batch.filter(pa.array(~hit))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
