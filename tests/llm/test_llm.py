"""The corpus operators against brute force on small tables with nulls, ties, repeats, empty and long texts."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F, types as T

import __spark_entry__ as entry
import corpus_pipeline
from check import TABLES, table
from longomics.llm import decontaminate, jaccard, langid, mixing, neardup, pii, quality, substrings, tokens, urlfilter
from longomics.llm.base import _BYTE, mix, powers
from longomics.llm.bwt import Merged, shard_transform

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, node string"
WORDS = "the of and river stone light under green moves along quiet water over small house old morning".split()


def some_texts():
    rng = random.Random(4)
    prose = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 120))) for _ in range(30)]
    near = prose[3].split()
    near[5:6] = ["changed"]
    tricky = ["", " ", "\n\n", "a", "A b\tC", "x" * 3000, "é ▁▁ ñ z\x0b", "0" * 2000, "<s> </s> ▁", "tail  \n  lead ",
              "Mail joe@x.org, call +1 (212) 555-0100, ip 10.0.0.7 or 1.2.3.4.5.6.7.8 card 4111 1111 1111 1111 @a.b a@b",
              "IBAN GB82 WEST 1234 5698 7654 32", "1.2.3.999 +123 12345678901234567890123 " + "@" * 500]
    return prose + [prose[3], " ".join(near), prose[0].upper(), prose[7] + " " + prose[8]] + tricky


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en" if k % 3 else "fr", None if k % 7 == 0 else f"s{k % 4}", len(t), k, "n") for k, t in enumerate(some_texts())]
    rows += [(100, None, None, None, None, None, None), (None, "no id here but words of some kind", None, "s1", None, None, None), rows[3], rows[3]]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_tokens(docs, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    coder = sentencepiece.SentencePieceProcessor(model_file=path)
    want = Counter((r.doc_id, len((r.text or "").encode()), len(coder.encode(r.text or ""))) for r in docs.collect())
    for head in (0, 5, 1 << 19):  # all by join, some by join, all by broadcast
        assert Counter(r[:3] for r in rows_of(tokens.count_tokens(docs, path, head=head))) == want
    assert rows_of(tokens.count_tokens(empty, path)) == []


def test_mixing(docs, empty):
    got = rows_of(mixing.mix(docs))
    assert len(got) == docs.count() and sorted(map(str, got)) == sorted(map(str, rows_of(mixing.mix(docs))))
    sizes = Counter()
    for r in docs.collect():
        sizes[r.source] += len(re.findall(r"[^ \t-\r]+", r.text or ""))
    source = {r.doc_id: r.source for r in docs.collect()}
    taken, target = Counter(), {}
    for doc, size, source_size, want, copies, took in got:
        assert took <= 3 * size and took == size * copies and source_size == sizes[source[doc]]
        taken[source[doc]] += took
        target[source[doc]] = want
    assert sum(target.values()) == pytest.approx(sum(sizes.values()))
    longest = max(r[1] for r in got)
    assert all(abs(taken[s] - target[s]) <= longest / 2 + 1 for s in target)
    assert rows_of(mixing.mix(empty)) == []


def test_mixing_unequal_weights(spark):
    rows = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"),
                                    F.when(F.col("id") < 1000, "x").otherwise("y").alias("source"), (1 + F.col("id") % 2).alias("w"))
    got = mixing.mix(rows, weight="w", weights=(1, 3)).groupBy((F.col("doc_id") % 2).alias("heavy"), (F.col("doc_id") < 1000).alias("x")) \
        .agg(F.sum("copies").alias("n")).collect()
    n = {(r.heavy, r.x): r.n for r in got}
    assert n[1, True] / n[0, True] == pytest.approx(2, rel=0.25) and n[1, True] + n[0, True] == pytest.approx(500, abs=2)


def shingles(text):
    words = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words)} if 0 < len(words) < 5 else {tuple(words[k:k + 5]) for k in range(len(words) - 4)}


def brute_components(sets, close):
    label = {k: k for k in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if close(sets[a], sets[b]) and label[a] > label[b]:
                    label[a], changed = label[b], True
    return label


def test_jaccard(spark, docs, empty):
    rng = random.Random(9)
    base = [str(k) for k in range(400)]
    texts = list(some_texts())
    for _ in range(25):  # chains of edits near the threshold, and sets of a few words
        words = base[:rng.choice([6, 12, 60, 400])]
        for _ in range(rng.randint(0, 12)):
            words = words[:]
            words[rng.randrange(len(words))] = rng.choice("pqrs")
        texts.append(" ".join(words))
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    sets = {k: shingles(t) for k, t in enumerate(texts)}
    label = brute_components(sets, lambda x, y: bool(x) and 100 * len(x & y) >= 75 * len(x | y))
    assert sorted(rows_of(jaccard.join(rows))) == [(k, len(sets[k]), label[k]) for k in sorted(sets)]
    got = rows_of(jaccard.join(docs))
    assert len(got) == docs.count() and (100, 0, 100) in got and got.count((3, len(sets[3]), 3)) == 3
    kept = [r.doc_id for r in jaccard.keep_one(docs).collect()]
    assert kept.count(3) == 1 and 30 not in kept and None in kept and 100 in kept
    assert rows_of(jaccard.join(empty)) == []


@pytest.mark.parametrize("size", [7, 40, 300])
def test_signatures_meet_for_every_link(size):
    """The pigeonhole with any mix of common shingles: linked sets share a signature."""
    rng = np.random.default_rng(size)
    for trial in range(60):
        one = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2))
        drop = rng.integers(0, max(1, size // 7) + 1)
        two = np.unique(np.concatenate([one[drop:], rng.integers(0, 1 << 63, drop, dtype=np.uint64)]))
        if not jaccard.linked(len(np.intersect1d(one, two)), len(one), len(two)):
            continue
        common = np.zeros(jaccard.COUNTERS, dtype=bool)
        common[jaccard._counter(one[rng.random(len(one)) < rng.choice([0, 0.5, 0.9, 1])])] = True
        values, rows = np.concatenate([one, two]), np.repeat([0, 1], [len(one), len(two)])
        sig, row = jaccard.signatures(values, rows, np.array([0, len(one), len(values)]), common)
        assert np.intersect1d(sig[row == 0], sig[row == 1]).size, (trial, drop)


def plain_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(digits(m.group())) <= 19 and pii.luhn(digits(m.group()))]
    found += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m.group())) <= 15]
    return sorted(found)


def test_pairs_are_made_in_their_first_group():
    rng = np.random.default_rng(9)
    lists = [sorted(set(rng.integers(-30, 30, rng.integers(0, 9)).tolist())) for _ in range(40)]
    left, right = np.divmod(np.arange(1600), 40)
    met = jaccard._met_before(pa.chunked_array([pa.array(lists, pa.list_(pa.int64()))]), left, right)
    assert met.tolist() == [bool(set(lists[a]) & set(lists[b])) if a != b else met[a * 41] for a, b in zip(left, right)]
    nothing = jaccard._met_before(pa.chunked_array([pa.array([[], []], pa.list_(pa.int64()))]), np.array([0]), np.array([1]))
    assert nothing.tolist() == [False]


def test_pii(docs, empty):
    rng = random.Random(2)
    for text in [*some_texts(), *("".join(rng.choice("ab@.+-1 2(3)4") for _ in range(60)) for _ in range(3000))]:
        assert pii.base_spans(text) == plain_spans(text), text
    got = {r.doc_id: r for r in pii.find_pii(docs).collect()}
    for r in docs.collect():
        assert got[r.doc_id].base_sha256 == hashlib.sha256(pii.listed(plain_spans(r.text or "")).encode()).hexdigest()
    assert sum(r.n_iban for r in got.values()) == 1 and "iban:5:32" in str(got)
    clean = [r.text for r in pii.redact_documents(docs).collect() if r.text and "Mail" in r.text]
    assert clean[0].startswith("Mail <EMAIL>, call <PHONE>, ip <IP> or <IP>.<IP> card <CARD>")
    assert rows_of(pii.find_pii(empty)) == []


@pytest.mark.parametrize("text, want", [
    ("GB82 WEST 1234 5698 7654 32 A transfer", [(0, 27)]), ("DE89370400440532013000 BIC COBADEFF", [(0, 22)]), ("DE89370400440532013000 2024", [(0, 22)]),
    ("to NO93 8601 1117 947 OR DE89370400440532013000 IN 2024", [(3, 21), (25, 47)]), ("AB12 CDEF GHIJ KLM DE89370400440532013000 X", [(19, 41)]),
    ("DE89370400440532013000 GB82 WEST 1234 5698 7654 32 EUR 100", [(0, 22), (23, 50)]), ("DE89370400440532013001 BIC 2024", []), ("DE89370400440532013000x", []), ("xDE89370400440532013000 A", [])])
def test_account_numbers_before_capitals_and_digits(text, want):
    assert pii.added_spans(text) == [(a, 4, b) for a, b in want]
    assert all(text[a:b] not in pii.redact(text, pii.added_spans(text)) for a, b in want)


def test_url_filter_edges(spark):
    day = lambda s: F.to_date(F.lit(s))
    events = spark.createDataFrame([("l", "h:bad.org", "2024-01-10", "add"), ("l", "h:bad.org", "2024-02-01", "remove"), ("l", "h:bad.org", "2024-02-01", "remove"),
                                    ("m", "p:ok.org/x/y", "2024-01-01", "add"), ("m", "p:ok.org/x/y", "2024-01-01", "remove")], "list string, value string, on string, action string") \
        .withColumn("on", F.to_date("on"))
    caps = spark.createDataFrame([(1, "http://A.bad.org:80/q", "2024-01-10"), (2, "http://bad.org", "2024-01-09"), (3, "http://u@bad.org/", "2024-02-01"), (4, "https://ok.org/x/y/z?q", "2024-05-05"),
                                  (5, "https://ok.org/x/yy", "2024-05-05"), (6, None, "2024-01-10"), (7, "not a url", "2024-01-10"), (8, "http://bad.org", None), (1, "http://A.bad.org:80/q", "2024-01-10")],
                                 "page_id int, url string, on string").withColumn("fetched_on", F.to_date("on"))
    got = urlfilter.filter_captures(caps, events).collect()
    assert Counter((r.page_id, r.blocked) for r in got) == Counter([(1, True), (1, True), (2, False), (3, False), (4, True), (5, False), (6, False), (7, False), (8, False)])
    assert not any(r.blocked for r in urlfilter.filter_captures(caps, events.limit(0)).collect())


def test_transforms_merge():
    rng = random.Random(3)
    for _ in range(200):
        strings = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(2, 9))]
        at = rng.randint(1, len(strings) - 1)
        halves = [strings[:at], strings[at:]]
        merged = Merged([shard_transform(np.frombuffer(b"".join(h), np.uint8), np.cumsum([0, *map(len, h)])) for h in halves], list(map(len, halves)))
        of, offset = merged.place(np.array(list(map(len, strings))))
        depth = rng.randint(1, 5)
        order, new = merged.refine(depth)
        every = Counter(s[k:k + depth] for s in strings for k in range(len(s) - depth + 1))
        found = [strings[of[r]][offset[r]:offset[r] + depth] for r in order]
        assert found == sorted(found) and Counter(found) == Counter({k: n for k, n in every.items() if n > 1})
        assert list(new) == [k == 0 or found[k] != found[k - 1] for k in range(len(found))]


def test_substrings(docs, empty):
    rng = random.Random(8)
    passage = "".join(rng.choice("abcd ") for _ in range(260))
    texts = {0: passage, 1: "é" + passage[20:230] + "tail" * 40, 2: passage[:99], 3: "z" * 450, 4: passage[50:150] + passage[30:140], 5: "", 6: passage}
    rows = docs.sparkSession.createDataFrame([*texts.items(), (7, None)], "doc_id long, text string").repartition(3)
    seen, want = set(), {}
    for k, t in texts.items():
        raw = t.encode()
        gone = np.zeros(len(raw) + 1, dtype=bool)
        for i in range(len(raw) - 99):
            if raw[i:i + 100] in seen:
                gone[i:i + 100] = True
            seen.add(raw[i:i + 100])
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        want[k] = (len(raw), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest())
    want[7] = (0, 0, 0, hashlib.sha256(b"").hexdigest())
    assert {r[0]: r[1:5] for r in rows_of(substrings.deduplicate(rows))} == want
    assert len(rows_of(substrings.deduplicate(docs))) == docs.count()
    assert rows_of(substrings.deduplicate(empty)) == []


def test_one_entry_for_each_content():
    """A passage of all texts and a run of one byte: a task sends each content on once and the rest as runs of bytes."""
    rng = random.Random(12)
    passage = "".join(rng.choice("abcd ") for _ in range(400))
    texts = ["".join(rng.choice("efgh ") for _ in range(rng.randint(0, 300))) + passage for _ in range(200)] + ["z" * 5000, passage]
    batch = pa.RecordBatch.from_arrays([pa.array(range(202), pa.int64()), pa.array(range(202), pa.int64()), pa.array(texts)], names=["doc", "tag", "t"])
    sent = [r for out in substrings._entries(16)(iter([batch])) for r in out.to_pylist()]
    every = np.concatenate([np.frombuffer(r["body"], substrings.STRETCH) for r in sent if r["bucket"] >= 0])
    assert len(every) == len({(int(g), int(c)) for g, c in zip(every["gram"], every["content"])})
    runs = np.concatenate([np.frombuffer(r["body"], substrings.RUN) for r in sent if r["bucket"] < 0])
    assert len(runs) <= 2 * len(texts) and {*runs["doc"]} >= {*range(1, 202)}
    settled = substrings._settle(pa.table({"bucket": pa.array([-1], pa.int32()), "body": pa.array([runs.tobytes()], pa.binary())}))
    spans = {(d, a, b) for d, a, b in zip(*(settled[c].to_pylist() for c in ("doc", "at", "stop")))}
    assert (200, 1, 5000) in spans and (201, 0, 400) in spans and settled["gram"].null_count == len(runs)


def test_a_gram_with_many_contents_goes_to_many_buckets(spark):
    """Texts that share 32 bytes and little else; some share 100 bytes to the left of them, to the right or around them."""
    rng = random.Random(14)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    one = lambda s: mix(np.array([(_BYTE[np.frombuffer(s.encode(), np.uint8)] * powers(32)[0]).sum(dtype=np.uint64)]))[0]
    low = min((word(32) for _ in range(3000)), key=one)  # a small hash, so that most windows pick this gram
    left, right = word(80), word(80)
    texts = {k: word(90) + low + word(90) for k in range(1300)}
    for k in range(1300, 1330):
        texts[k] = (word(40) + left if k % 3 else word(100)) + low + (right + word(30) if k % 2 else word(100))
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    seen, want = set(), {}
    for k, t in texts.items():
        b = t.encode()
        gone = np.zeros(len(b) + 1, dtype=bool)
        for i in range(len(b) - 99):
            if b[i:i + 100] in seen:
                gone[i:i + 100] = True
            seen.add(b[i:i + 100])
        want[k] = (len(b), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()))
    assert {r[0]: r[1:4] for r in rows_of(substrings.deduplicate(rows))} == want and sum(w[1] for w in want.values()) > 2000

    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.int64()), pa.array(texts, pa.int64()), pa.array(texts.values())], names=["doc", "tag", "t"])
    sent = [r for out in substrings._entries(1)(iter([batch])) for r in out.to_pylist() if r["bucket"] == 0]
    settled = substrings._settle(pa.table({"bucket": pa.array([0] * len(sent), pa.int32()), "body": pa.array([r["body"] for r in sent], pa.binary())}))
    marks = spark.createDataFrame(settled.to_pandas(integer_object_nulls=True).to_dict("records"), substrings._MARKS).where("gram IS NOT NULL")
    asks = substrings._pieces(marks).groupBy("doc").agg(F.collect_list(F.struct("at", "stop", "gram", "beside", "side")).alias("asks")).toArrow()
    batch = pa.RecordBatch.from_arrays([asks["doc"].combine_chunks(), pa.array([texts[k] for k in asks["doc"].to_pylist()]), asks["asks"].combine_chunks()],
                                       names=["doc", "t", "asks"])
    shards = [r for out in substrings._shards(64)(iter([batch])) for r in out.to_pylist()]
    held = {b: sum(len(r["docs"]) // 8 for r in shards if r["bucket"] == b) for b in {r["bucket"] for r in shards}}
    assert len(held) > 32 and max(held.values()) < sum(held.values()) / 8


def test_leaks(spark, docs, empty):
    rng = random.Random(6)
    items = [" ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n)) + ". The answer is " + str(k) * 6 + " of course." for k, n in enumerate([12, 30, 50, 25, 40])]
    texts = {0: "intro " * 300 + items[1].upper() + " more" * 90, 1: items[2] + " " + items[0], 2: items[3][:60], 3: items[4].split(".")[0], 4: "plain words only"}
    rows = spark.createDataFrame([*texts.items(), (5, None), (6, "")], "doc_id long, text string")
    bench = spark.createDataFrame([*enumerate(items), (9, None), (10, " ")], "item_id int, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(rows, bench).collect()}
    assert got == {(0, 1), (1, 2), (1, 0)}
    assert sorted(r.doc_id for r in decontaminate.drop_leaks(rows, bench).collect()) == [2, 3, 4, 5, 6]
    assert rows_of(decontaminate.find_leaks(empty, bench)) == [] and rows_of(decontaminate.find_leaks(docs, bench.limit(0))) == []


def test_quality(spark, sf, docs, empty):
    found = {r.doc_id: r for r in entry.queries()["op8_quality_scores"](spark, sf).collect()}
    labels = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if found[r.doc_id].held_out]
    assert np.mean([found[r.doc_id].predicted == r.quality for r in labels]) >= 0.9
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = rows_of(quality.classify(docs, none, F.lit(True)))
    assert len(got) == docs.count() and {r[1] for r in got} == {0.5}
    some = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, None), (900, 1)], "doc_id long, quality int")
    assert all(0 <= r[1] <= 1 for r in rows_of(quality.classify(docs, some, F.lit(True)))) and rows_of(quality.classify(empty, some, F.lit(True))) == []


def test_language(spark, sf, docs, empty):
    got = entry.queries()["op9_language_id"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) >= 0.97
    learned = langid.learn(docs, F.lit(True))
    by_id = {r.doc_id: r for r in langid.identify(docs, learned).collect()}
    assert by_id[100].lang_pred == langid.UNKNOWN and by_id[100].rejected and len(learned) == 2
    assert rows_of(langid.identify(empty, langid.learn(empty, F.lit(True)))) == []
    assert {r.lang_pred for r in langid.identify(docs, []).collect()} == {langid.UNKNOWN}


def test_near_vectors(spark):
    rng = np.random.default_rng(1)
    spread = rng.normal(size=(300, 24))
    group = spread[0] + rng.normal(size=(200, 24)) * 0.1
    rows = [(k, [float(v) for v in x], "c") for k, x in enumerate([*spread, *group, spread[5], spread[5] * 3])]
    odd = [(900, None, "c"), (901, [0.0] * 24, "c"), (902, [float("nan")] * 24, "c"), (903, [1.0, None], "c"), (None, rows[5][1], "c"), rows[5], (904, [1e300] * 24, "c"), (905, [1e-300] * 24, "c")]
    df = spark.createDataFrame(rows + odd, T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("node", T.StringType())]))
    ids = [k for k, _, _ in rows] + [904, 905]
    x = np.array([v for _, v, _ in rows] + [[1.0] * 24] * 2)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    close = x @ x.T >= 0.95
    label = brute_components({k: n for n, k in enumerate(ids)}, lambda a, b: close[a, b])
    want = Counter((k, int(close[n].sum()) - 1, label[k], k == label[k]) for n, k in enumerate(ids))
    want.update([(5, int(close[5].sum()) - 1, 5, True), *((k, 0, k, True) for k in (900, 901, 902, 903)), (None, 0, None, False)])
    assert Counter(rows_of(neardup.near_duplicates(df))) == want
    assert rows_of(neardup.near_duplicates(df.limit(0))) == []


def test_missed_rare_links_widen_the_beam():
    """A graph cut in two: a beam never reaches the single partners, which an audit must see beside a large group."""
    rng = np.random.default_rng(5)
    group = np.eye(32)[0] + rng.normal(size=(600, 32)) * 0.01
    vectors = neardup._unit(np.concatenate([group, rng.normal(size=(60, 32))]))
    links = np.full((660, 16), -1, dtype=np.int32)
    links[:600] = (np.arange(600)[:, None] + np.arange(1, 17)) % 600
    graph = neardup.Graph(vectors.astype(np.float32), [(np.arange(660), links)])
    queries = np.concatenate([vectors[:400], vectors[600:]])
    ids, node = np.arange(460) + 1000, np.arange(660)
    true, least = neardup.audit(graph, node, vectors, ids, queries, 0.95)
    assert (true[:400] >= 600).all() and (true[400:] == 1).all() and (least[400:] == neardup.EXACT).all()
    counts = Counter((0, bool(few), int(x)) for few, x in zip(true <= neardup.FEW, least))
    assert neardup.settle_beams(counts, 0.99) == ({-1: neardup.EXACT}, False)
    assert len(neardup.find_links(graph, vectors, queries, 0.95, neardup.EXACT)[0]) == int((queries @ vectors.T >= 0.95).sum())


def test_near_vectors_of_drawn_audits(spark, monkeypatch):
    """Pairs and one large group, with draws smaller than the table."""
    rng = np.random.default_rng(2)
    one = rng.normal(size=(400, 24))
    x = np.concatenate([one, one + rng.normal(size=one.shape) * 0.02, one[0] + rng.normal(size=(200, 24)) * 0.02])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = {k: int(n) - 1 for k, n in enumerate((x @ x.T >= 0.95).sum(axis=1))}
    monkeypatch.setattr(neardup, "AUDIT", 200)
    for recall in (0.9, 1):
        got = {r.vec_id: r.n_links for r in neardup.near_duplicates(df, recall=recall).collect()}
        assert got.keys() == want.keys() and np.mean([got[k] == n for k, n in want.items()]) >= recall


def test_beams_need_proof():
    exact, settle = neardup.EXACT, neardup.settle_beams
    assert settle({(0, True, 16): 460}, 0.99) == ({-1: 16, 0: 16}, False)
    assert settle({(0, True, 16): 100}, 0.99) == ({-1: exact}, True)  # too few to be sure: draw more
    assert settle({(0, False, 16): 4000, (0, True, exact): 8}, 0.99) == ({-1: exact}, False)  # single pairs are not outweighed
    assert settle({(0, True, 16): 3000, (0, True, 32): 100}, 0.99)[0] == {-1: 32, 0: 32}
    beams = settle({**{(k, True, 16): 1000 for k in range(7)}, (7, True, 16): 100, (7, True, 64): 10}, 0.99)[0]
    assert beams[0] == 16 and beams[7] == 64


@pytest.mark.parametrize("name", ["op2_source_mix", "op5_url_filter"])
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = entry.queries()[name](spark, sf)
    got = table(df.columns, rows_of(df))
    rel = con.execute(entry.oracle_sql()[name])
    assert got == table([d[0] for d in rel.description], rel.fetchall())


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == first.columns, name
        assert docs.count() <= before.count()
        if name == "jaccard_join":
            sets = {r.doc_id: shingles(r.text) for r in before.collect()}
            label = brute_components({k: v for k, v in sets.items() if v}, lambda x, y: 100 * len(x & y) >= 75 * len(x | y))
            assert {r.doc_id for r in docs.collect()} == {k for k in sets if label.get(k, k) == k}
    assert all(not pii.base_spans(r.text or "") for r in docs.collect())
    result = entry.queries()["pipeline"](spark, sf)
    assert {r.doc_id for r in result.collect()} == {r.doc_id for r in docs.collect()}
