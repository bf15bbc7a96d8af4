"""Periodic runs and tokenizer alignment against brute force: nulls, ties, repeats, empty and long texts."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
from longomics.llm import alignment, jaccard, runs
from longomics.llm.catalog import repeated_tail

SCHEMA = "doc_id long, text string, lang string, runs int, key string, n long, t string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts():
    rng = random.Random(8)
    some = ["", " ", "\n\t", "a", "A b\tC", "é ▁▁ ñ z\x0b\x85  x", "<s> </s> ▁ <|endoftext|> <unk>", "x" * 3000, "no " * 11, "no " * 12,
            "a b c d e f g a b c d e f g", "a b c d e f a b c d e f", "😀 tail  \n  lead \r\n don't I'll", "\x00 zero", "İstanbul ǅ ﬁ"]
    for k in range(60):
        words = [rng.choice(["of", "stone", "Light", "under", "é", "1,2", "x"][:rng.randint(1, 7)]) for _ in range(rng.randint(1, 90))]
        some.append(" ".join(words) + ("\n" + " ".join(words[3:]) if k % 3 else ""))
    for size in (7, 30, 200):
        words = [str(k) for k in range(size)]
        some += [" ".join(words * 3), " ".join(words + ["cut"] + words)]
    return some


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", 1, "k", 2, "t") for k, t in enumerate(texts())]
    rows += [(1000, None, None, None, None, None, None), (None, "a b " * 9, None, None, None, None, None), rows[20], rows[20]]
    rows += [(2000 + k, texts()[30], "en", 1, "k", 2, "t") for k in range(40)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain_runs(w, least=12):
    best = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i < len(w) - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                best.setdefault((i, j + q), q)
            i = j
    return sorted(((s, e - s, q) for (s, e), q in best.items()), key=lambda r: (r[0], r[2]))


def plain_digest(doc_id, text):
    w = WORD.findall(text or "")
    n = len(w)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i if i < a else a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    drop = {i for s, size, q in found for i in range(s + q, s + size)}
    top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    head = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return (doc_id, len(found), *head, sha("".join(f"{s},{size},{q}\n" for s, size, q in found)),
            sha(" ".join(x for i, x in enumerate(w) if i not in drop)))


def test_runs_of_small_alphabets():
    rng = random.Random(1)
    for _ in range(1500):
        n, k = rng.randint(0, 70), rng.choice([1, 2, 2, 3, 5, 10])
        w = [rng.randrange(k) for _ in range(n)]
        if rng.random() < .5 and n > 5:
            a, p = rng.randrange(n), rng.randint(1, 12)
            w = [x if i < a else w[(a + (i - a) % p) % n] for i, x in enumerate(w)]
        words = [str(x).encode() for x in w]
        hashes = np.array([x + 77 for x in w], np.uint64)
        want = plain_runs(w)
        assert runs.text_runs(words, runs.repeated_cover(hashes, np.zeros(n, np.int64), 6)) == want
        assert runs.text_runs(words, np.ones(n, bool)) == want  # also without cuts, and so with colliding hashes


def test_grammar_round_trip():
    rng = random.Random(2)
    for n in (2, 3, 9, 50, 400):
        seq = [rng.randrange(min(n, 4)) for _ in range(n)]
        left, rules = runs.re_pair(seq)

        def spell(s):
            return spell(rules[s][0]) + spell(rules[s][1]) if s in rules else [s]

        assert [w for s, _ in left for w in spell(s)] == seq
        for s, (_, _, size, first) in rules.items():
            assert spell(s) == seq[first:first + size]
        pairs = list(zip([s for s, _ in left], [s for s, _ in left[1:]]))
        assert max((c for p, c in Counter(pairs).items() if p[0] != p[1]), default=1) == 1


def test_periodic_runs(docs, empty):
    got = Counter(tuple(r) for r in runs.digest(runs.find(docs, arrange=repeated_tail)).collect())
    assert got == Counter(plain_digest(r.doc_id, r.text) for r in docs.collect())
    assert runs.digest(runs.find(empty)).collect() == []
    kept = {r.doc_id: (r.n_words, r.collapsed) for r in runs.find(docs).collect()}
    assert kept[9] == (12, "no") and kept[8] == (11, " ".join(["no"] * 11)) and kept[1000] == (0, "")


def test_periodic_runs_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = Counter(tuple(r) for r in entry.queries()["op13_periodic_runs"](spark, sf).collect())
    assert got == Counter(plain_digest(r.doc_id, r.text) for r in rows)
    assert sum(r[1] > 0 for r in got) > len(rows) / 12


def plain_alignment(rows):
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    a = Tokenizer.from_file(paths[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=paths[1])
    values, names = alignment.byte_values(), {k: v for v, k in a.get_vocab().items()}
    held, made = Counter(), []
    for doc, text in rows:
        raw = (" " + (text or "")).encode()
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(values[c] for c in names[i]) for i in ids_a]
        pieces = [b.id_to_piece(i) for i in ids_b]
        bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
        if not text or b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            made.append((doc, None))
            continue
        ends = [np.cumsum([len(x) for x in y]).tolist() for y in (bytes_a, bytes_b)]
        starts = [[0, *e[:-1]] for e in ends]
        links = [(ids_a[i], ids_b[j]) for i in range(len(ids_a)) for j in range(len(ids_b))
                 if max(starts[0][i], starts[1][j]) < min(ends[0][i], ends[1][j])]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups, low = [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(x) for x, s, e in zip(ids, st, en) if s >= low and e <= c)
                                   for ids, st, en in zip((ids_a, ids_b), starts, ends)))
            low = c
        held.update(set(links))
        made.append((doc, (len(ids_a), len(ids_b), groups, links)))
    best = defaultdict(int)
    for (i, _), n in held.items():
        best[i] = max(best[i], n)
    for doc, found in made:
        if found is None:
            yield doc, 0, 0, 0, 0, 0, 0, ""
        else:
            n_a, n_b, groups, links = found
            yield (doc, n_a, n_b, len(groups), len(links), sum(held[x] == best[x[0]] for x in links), sum(held[x] for x in links),
                   hashlib.sha256(";".join(groups).encode()).hexdigest())


def test_alignment(docs, empty):
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    want = Counter(plain_alignment([(r.doc_id, r.text) for r in docs.collect()]))
    assert sum(n for r, n in want.items() if r[-1]) > 80 and sum(r[-1] == "" for r in want) > 2
    for head in (0, 20, 1 << 20):  # all pairs by join, some, all by broadcast
        assert Counter(tuple(r) for r in alignment.align_tokenizers(docs, *paths, head=head)[0].collect()) == want
    rows, counts = alignment.align_tokenizers(empty, *paths)
    assert rows.collect() == [] and counts.collect() == []
    none = alignment.align_tokenizers(docs.where("text IS NULL OR text = ''"), *paths)[0]
    assert {tuple(r)[1:] for r in none.collect()} == {(0, 0, 0, 0, 0, 0, "")}


def test_alignment_rare_texts_by_join(docs, monkeypatch):
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    monkeypatch.setattr(alignment, "HOT", 4)
    want = Counter(plain_alignment([(r.doc_id, r.text) for r in docs.collect()]))
    assert Counter(tuple(r) for r in alignment.align_tokenizers(docs, *paths)[0].collect()) == want


def test_alignment_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.substring("text", 1, 1 << 30).alias("text")).collect()
    want = Counter(plain_alignment([(r.doc_id, r.text) for r in rows if len(r.text or "") < 3000]))
    got = Counter(tuple(r) for r in entry.queries()["op12_tokenizer_alignment"](spark, sf).collect())
    small = {r[0] for r in want}
    assert {r[:5] + r[7:] for r in got if r[0] in small} == {r[:5] + r[7:] for r in want}
    assert len(got) == len(rows)


def test_one_of_each_group_with_clashing_columns(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(1, text, "a", True), (2, text + " more", "b", False), (3, "other words stand here alone and quiet", "c", None), (3, "other words stand here alone and quiet", "d", True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _again_ string, _Again boolean")
    got = jaccard.keep_one(docs)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == [1, 3]


def test_a_segment_is_encoded_once_and_adds_up(monkeypatch):
    a, b = (alignment.coder(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    texts = ["The cat, the dog and the cat", "the dog  and", "café don't 12 3", " lead", "trail ", "a\nb c", "x▁y z", "é é ́ x", "the cat"]
    kept = alignment.Segments()
    got, want = alignment.align(texts, a, b, kept), alignment.align_whole(texts, a, b)
    for x, y in zip(got, want):
        assert x[:5] == y[:5] and np.array_equal(x[5], y[5]) and np.array_equal(x[6], y[6])
    monkeypatch.setattr(alignment.Coder, "encode", lambda *_: pytest.fail("a known segment is encoded again"))
    assert alignment.align(["the cat and the dog"], a, b, kept)[0][0] >= 5
