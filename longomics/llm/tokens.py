"""Token counts without ids: pieces counted once per distinct pre-token, joined to per-document frequencies.

A text's pre-tokens are its runs of space marks and the characters up to the next one, cut at new lines. No piece of
the vocabulary reaches over such a border (checked when the model is read), so a text's count is the sum over its
pre-tokens. One pass counts every pre-token of the corpus; each distinct one is encoded once. The most frequent
``head`` of them (a fixed number, so the size is bounded) go to the tasks as a broadcast map; the second pass adds
those up inside the document and sends only the remaining (document, pre-token, count) rows to the join.

Defined cases: a null or empty text has 0 bytes and 0 tokens; equal rows are counted together and returned each; a
null key is a key; an empty table gives an empty result; other columns are not read; very long texts are one row of
frequencies, cut into rows of the join as they come.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F

from ..runtime import cut

MARK, NEWLINE = "▁", "\n"
RUN = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+")
HEAD, LONGEST, FLUSH = 1 << 19, 64, 1 << 19
LIMIT = 4096
_MODELS: dict[str, sentencepiece.SentencePieceProcessor] = {}


def model(path: str) -> sentencepiece.SentencePieceProcessor:
    """The tokenizer, once per worker. Refuses a vocabulary with pieces over the borders used here."""
    if path not in _MODELS:
        read = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [read.id_to_piece(k) for k in range(read.get_piece_size())]
        if any(NEWLINE in p or re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
            raise ValueError("a piece of this vocabulary reaches over a pre-token border")
        _MODELS[path] = read
    return _MODELS[path]


def pre_tokens(text: str) -> Counter:
    """Pre-tokens of a text with counts; a new line is one of its own."""
    if not text:
        return Counter()
    found = Counter(RUN.findall(MARK + text.replace(" ", MARK)))
    if n := text.count(NEWLINE):
        found[NEWLINE] = n
    return found


def _piece_counts(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = model(path)
        mark = len(coder.encode(NEWLINE))
        for batch in batches:
            words = batch.column(0).to_pylist()
            # Behind a new line nothing joins on, and the library adds no space mark of its own there.
            sizes = [len(x) - mark if w != NEWLINE else mark - 1
                     for w, x in zip(words, coder.encode([NEWLINE + w for w in words], num_threads=1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())],
                                             names=["piece", "n", "pieces"])
    return count


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def flush():
        out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())],
                                         names=["piece", "n"])
        held.clear()
        return out

    for batch in batches:
        for value in batch.column(0):
            held.update(pre_tokens(value.as_py()))
            if len(held) >= FLUSH:
                yield flush()
    if held:
        yield flush()


def vocabulary(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Every distinct pre-token of the corpus: piece, n (uses), pieces (its token count)."""
    texts = docs.select(F.col(text).alias("t")).where(F.length("t") > 0)
    uses = texts.mapInArrow(_tally, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    return uses.mapInArrow(_piece_counts(path), "piece string, n long, pieces long")


def _most_frequent(known: DataFrame, head: int) -> dict[str, int]:
    """At most ``head`` of the most used pre-tokens of up to LONGEST characters: a bound on what is broadcast."""
    short = known.where(F.length("piece") <= LONGEST)
    level = F.floor(F.log2("n") * 16).cast("int")
    levels = {r["level"]: r["count"] for r in short.groupBy(level.alias("level")).count().collect()}
    least, total = None, 0
    for at in sorted(levels, reverse=True):
        total += levels[at]
        if total > head:
            break
        least = at
    if least is None:
        return {}
    return dict(short.where(level >= least).select("piece", "pieces").toPandas().itertuples(index=False, name=None))


def count_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", head: int = HEAD,
                 limit: int = LIMIT) -> DataFrame:
    """One row per input row: key, n_bytes, n_tokens, over_limit."""
    known = cut(vocabulary(docs, path, text))
    common = _most_frequent(known, head)
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cheap = shared.value
        for batch in batches:
            keys = batch.column(0)
            sums, own, rest_at, rest_piece, rest_n = [], [], [], [], []
            for k, value in enumerate(batch.column(3)):
                # No pre-token has a space mark behind another character: this key meets nothing and spreads evenly.
                own.append(f"\0{MARK}{k}")
                total = 0
                for piece, n in pre_tokens(value.as_py()).items():
                    each = cheap.get(piece)
                    if each is None:
                        rest_at.append(k)
                        rest_piece.append(piece)
                        rest_n.append(n)
                    else:
                        total += each * n
                sums.append(total)
            n, m = len(sums), len(rest_at)
            rows = pa.array([*range(n), *rest_at], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [keys.take(rows), batch.column(1).take(rows), batch.column(2).take(rows),
                 pa.array([*sums, *[None] * m], pa.int64()), pa.array(own[:n] + rest_piece, pa.string()),
                 pa.array([0] * n + rest_n, pa.int64())], names=["k", "h", "n_bytes", "total", "piece", "n"])

    rows = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("h"),
                       F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.col(text).alias("t"))
    kind = docs.schema[key].dataType.simpleString()
    parts = rows.mapInArrow(run, f"k {kind}, h long, n_bytes long, total long, piece string, n long")
    joined = parts.join(known.select("piece", "pieces"), "piece", "left")
    # Equal rows fall together here and come apart again by their number.
    summed = joined.groupBy("k", "h", "n_bytes").agg(
        F.sum("total").alias("total"), F.sum(F.coalesce(F.col("n") * F.col("pieces"), F.lit(0))).alias("more"),
        F.count("total").alias("copies"))
    tokens = ((F.col("total") + F.col("more")) / F.col("copies")).cast("long")
    return summed.select(F.col("k").alias(key), "n_bytes", tokens.alias("n_tokens"), (tokens > limit).alias("over_limit"),
                         F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy")).drop("_copy")
