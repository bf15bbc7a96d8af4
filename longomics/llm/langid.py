"""Language by compression: the language whose zstandard raw-content dictionary encodes the text smallest.

Each learned language has one dictionary: pieces of a bounded sample of its training texts (``sample_docs`` texts,
``piece`` characters of each, ``dictionary`` bytes together). A text is folded (letters kept, A-Z lowered, other ASCII
to spaces), cut into blocks, and every block is encoded with each dictionary; the summed sizes are compared. Every
byte of every text takes part.

Defined cases: a null text or one without a letter is ``und`` with score 0 and is rejected; ties go to the language
with more training texts, then by name, and count as a margin of 0; with no training text every result is ``und``;
repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

UNKNOWN = "und"
FOLD = bytes(c if c >= 0x80 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
LEVEL, BLOCK = 5, 4096


def fold(text: str) -> bytes:
    """Folded bytes with single spaces."""
    return b" ".join(text.encode("utf-8", "replace").translate(FOLD).split())


def learn(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text", lang: str = "lang",
          sample_docs: int = 400, piece: int = 1000, dictionary: int = 112_640) -> list[tuple[str, bytes]]:
    """(language, dictionary bytes) with the most frequent language first. Counts cover all rows; texts are sampled."""
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")) \
        .where(train & F.col("l").isNotNull() & (F.length("t") > 0))
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return []
    draw = F.pmod(F.xxhash64("k"), F.lit(1_000_003)) / 1_000_003.0
    share = F.lit(0.0)
    for name, n in counts.items():
        share = F.when(F.col("l") == name, F.lit(min(1.0, sample_docs / n))).otherwise(share)
    start = F.pmod(F.xxhash64("k", F.lit(1)), F.greatest(F.lit(1), F.length("t") - piece)).cast("int")
    picked = (rows.withColumn("u", draw).where(F.col("u") < share)
              .select("l", "u", F.substring(F.col("t"), start + 1, F.lit(piece)).alias("t")).collect())
    out = []
    for name in sorted(counts, key=lambda x: (-counts[x], x)):
        body = b" ".join(fold(r["t"]) for r in sorted((r for r in picked if r["l"] == name), key=lambda r: (r["u"], r["t"])))
        out.append((name, body[:dictionary]))
    return out


def encoders(learned: list[tuple[str, bytes]]) -> list[zstandard.ZstdCompressor]:
    out = []
    for _, body in learned:
        shared = zstandard.ZstdCompressionDict(body or b" " * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        shared.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_checksum=False,
                                            write_content_size=False, write_dict_id=False))
    return out


def classify(text: str | None, names: list[str], codecs: list[zstandard.ZstdCompressor]) -> tuple[str, float, float]:
    """(language, score, margin): score is the share of 2**-size in bytes, margin relative to the second size."""
    if not text or not names or not any(c.isalpha() for c in text):
        return UNKNOWN, 0.0, 0.0
    body = fold(text)
    blocks = [body[k:k + BLOCK] for k in range(0, len(body), BLOCK)] or [b""]
    sizes = [sum(len(c.compress(b)) for b in blocks) for c in codecs]
    best = min(range(len(sizes)), key=sizes.__getitem__)
    share = 1.0 / sum(2.0 ** -min(s - sizes[best], 60) for s in sizes)
    second = min((s for k, s in enumerate(sizes) if k != best), default=2 * sizes[best])
    return names[best], share, (second - sizes[best]) / max(second, 1)


def identify(docs: DataFrame, learned: list[tuple[str, bytes]], key: str = "doc_id", text: str = "text",
             min_margin: float = 0.003) -> DataFrame:
    """``key``, ``lang_pred``, ``score``, ``margin`` and ``rejected`` (unknown, or a margin under ``min_margin``)."""
    names = [n for n, _ in learned]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codecs = encoders(learned)
        for batch in batches:
            found = [classify(v.as_py(), names, codecs) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.float64()),
                 pa.array([f[0] == UNKNOWN or f[2] < min_margin for f in found], pa.bool_())],
                names=[key, "lang_pred", "score", "margin", "rejected"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(
        run, f"`{key}` {kind}, lang_pred string, score double, margin double, rejected boolean")


def accept(docs: DataFrame, learned: list[tuple[str, bytes]], text: str = "text", min_margin: float = 0.003) -> DataFrame:
    """The rows whose language is known by a wide enough margin, all columns unchanged."""
    names, place = [n for n, _ in learned], docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codecs = encoders(learned)
        for batch in batches:
            found = [classify(v.as_py(), names, codecs) for v in batch.column(place)]
            yield batch.filter(pa.array([f[0] != UNKNOWN and f[2] >= min_margin for f in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
