"""Quality rules against plain Python: counts, exact binomial tests, certified cutoffs, nulls, repeats and empty tables."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from longomics.llm import rules

SCHEMA = "doc_id long, text string, lang string, n_words long, step int, n long, a string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    places = defaultdict(list)
    for i in range(len(w) - 2):
        places[tuple(w[i:i + 3])].append(i)
    covered = {i + k for at in places.values() if len(at) > 1 for i in at for k in range(3)}
    got = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines), len(lines) - len(set(lines)), len(covered))
    return (*got, got[0] < 50 or 100 * got[5] > 50 * got[0])


def prose(rng, n, marks=0):
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 6))) for _ in range(n)]
    for k in range(marks):
        words[k] += "#%&"
    return " ".join(words)


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    texts = ["", " ", None, "a", "a b c a b c", "a a a a", "a b a b a", "é😀 x\x0by\x85z\n\n é😀 x", "x\n\nx\n x\nx \n \nx", "#*$%&|<> ## a|b",
             "ab c d a bc d", "one two " * 40, "one two three " * 3 + prose(rng, 60), "a\rb\fc\td\n" * 3, "x" * 5000]
    rows = [(k, t, None if k % 2 else "en", 9, 9, 9, "a") for k, t in enumerate(texts)]
    at = 100
    for lang, n in (("en", 700), ("fr", 700), ("xx", 40), (None, 500)):
        for k in range(n):  # a fifth is bad and full of marks; some good ones of fr have marks too
            bad = k % 5 == 0
            rows.append((at, prose(rng, rng.randint(55, 70), 40 if bad else 30 if lang == "fr" and k % 9 == 1 else 0), lang, None, None, None, None))
            at += 1
    rows += [(None, prose(rng, 60), "en", 1, 1, 1, "n"), rows[20], rows[20]]
    return spark.createDataFrame(rows, SCHEMA).repartition(4).cache()


@pytest.fixture(scope="module")
def labels(spark, docs):
    rows = [(r.doc_id, int((r.doc_id - 100) % 5 != 0)) for r in docs.where("doc_id >= 800 AND doc_id < 1500").collect()]
    rows += [(r.doc_id, int("#%&" not in r.text)) for r in docs.where("doc_id BETWEEN 100 AND 799 OR doc_id >= 1500").collect()]
    return spark.createDataFrame(rows + [rows[0], (None, 1), (999999, 0), (101, None)], "doc_id long, quality int")


def binomial(n, k, p):
    p = Fraction(p)
    return float(sum(math.comb(n, j) * p ** j * (1 - p) ** (n - j) for j in range(k + 1)))


def plain_verdict(docs, labels, alpha=rules.ALPHA, delta=rules.DELTA):
    counts = [(r.doc_id, r.lang, plain_counts(r.text)) for r in docs]
    label = {}
    for r in labels:
        if r.doc_id is not None and r.quality is not None:
            label[r.doc_id] = min(label.get(r.doc_id, 1), r.quality)
    place = dict(zip(rules.COUNTS, range(6)))
    grid = [(rule, c) for rule, cutoffs in rules.CUTOFFS.items() for c in cutoffs]

    def rejects(g, c):
        part, whole = (c[place[x]] for x in rules.PARTS[g[0]])
        return 1000 * part < g[1] * whole if g[0] == "short_words" else 1000 * part > g[1] * whole

    known = {(d, s, c) for d, s, c in counts if d in label and not c[6]}
    learns = lambda d: ord(hashlib.md5(str(d).encode()).hexdigest()[0]) % 2 == 0
    good = [[c for d, _, c in known if learns(d) and label[d] == q] for q in (0, 1)]
    order = sorted(range(len(grid)), key=lambda k: (sum(rejects(grid[k], c) for c in good[1]), -sum(rejects(grid[k], c) for c in good[0]), k))
    first = lambda path, c: next((k for k, g in enumerate(path, 1) if rejects(g, c)), None)
    gained = [Counter(first([grid[k] for k in order], c) for c in part) for part in good]
    path = [grid[k] for at, k in enumerate(order, 1) if gained[0][at] * len(good[1]) > gained[1][at] * len(good[0])]
    strata = defaultdict(list)
    for d, s, c in known:
        if not learns(d) and label[d] == 1:
            strata[s].append(first(path, c))
    steps = {}
    for s, hits in strata.items():
        steps[s] = 0
        for t in range(1, len(path) + 1):
            k = sum(h is not None and h <= t for h in hits)
            if binomial(len(hits), k, alpha) > delta / len(strata):
                break
            steps[s] = t
    out = []
    for d, s, c in counts:
        at = first(path, c)
        out.append((d, *c, not c[6] and (at is None or at > steps.get(s, 0))))
    return Counter(out), steps, path


def test_counts(docs):
    got = Counter(tuple(r) for r in rules.text_counts(docs.select("doc_id", "text"), ["doc_id"]).collect())
    assert got == Counter((r.doc_id, *plain_counts(r.text)) for r in docs.collect())


def test_binomial_tail(spark):
    cases = [(1, 0), (20, 0), (20, 1), (117, 0), (400, 12), (1000, 30), (1000, 49), (1000, 50), (2000, 80)]
    df = spark.createDataFrame(cases, "n long, k long").select("n", "k", rules.binomial_lower(F.col("n"), F.col("k"), 0.05).alias("p"))
    for r in df.collect():
        assert r.p == (pytest.approx(binomial(r.n, r.k, 0.05), rel=1e-9) if r.k < r.n * 0.05 else 1.0)
    large = spark.createDataFrame([(10 ** 8, 4_990_000)], "n long, k long").select(rules.binomial_lower(F.col("n"), F.col("k"), 0.05)).first()[0]
    z = (4_990_000.5 - 5e6) / math.sqrt(1e8 * 0.05 * 0.95)
    assert large == pytest.approx(0.5 * math.erfc(-z / math.sqrt(2)), rel=1e-2)


def test_verdicts(docs, labels):
    want, steps, path = plain_verdict(docs.collect(), labels.collect())
    rows, proofs, order = rules.apply_rules(docs, labels)
    got = Counter(tuple(r) for r in rows.select("doc_id", *rules.COUNTS, "base_failed", "kept").collect())
    assert order == path and {r.lang: r.steps for r in proofs.collect()} == steps
    assert got == want
    # en and the null stratum get the whole path; fr would lose too many good ones, xx has too few rows for a proof.
    assert steps["en"] == steps[None] == len(path) and 0 < steps["fr"] < len(path) and steps["xx"] == 0
    for r in proofs.where("steps > 0").collect():
        assert binomial(r.n, r.lost, rules.ALPHA) <= rules.DELTA / len(steps)


def test_guarantee_holds_on_fresh_rows(spark):
    """Over many draws, a stratum's true loss above alpha comes through in at most a share delta."""
    rng, alpha, delta = random.Random(3), 0.1, 0.2
    n, risk = 150, 0.12  # the true loss is above alpha
    draws = [sum(rng.random() < risk for _ in range(n)) for _ in range(400)]
    df = spark.createDataFrame([(n, k) for k in draws], "n long, k long")
    broken = df.where(rules.binomial_lower(F.col("n"), F.col("k"), alpha) <= delta).count()
    assert broken / 400 <= delta


def test_without_labels_and_rows(spark, docs, labels):
    rows, proofs, path = rules.apply_rules(docs, labels.where("false"))
    assert path == [] and proofs.collect() == [] and rows.where("kept = base_failed").count() == 0
    rows, _, _ = rules.apply_rules(docs.where("false"), labels)
    assert rows.collect() == []
    only_good, _, path = rules.apply_rules(docs, labels.where("quality = 1"))
    assert path == [] and only_good.where("kept = base_failed").count() == 0


def test_no_python_workers(docs, labels):
    plan = rules.apply_rules(docs, labels)[0]._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
