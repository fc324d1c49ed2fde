"""Centroids, quality rules and runs against brute force, and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexispan.llm import centroids, quality_rules, queries, runs
from lexispan.llm.words import interned

VECTORS = "vec_id bigint, embedding array<float>, label int, cluster string, v int"
DOCS = "doc_id bigint, text string, lang string, kept string, n_words int"


def plain_clusters(rows, k=40, rounds=5, components=64):
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each kept row, by trying all centroids."""
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in e]) for i, e, *_ in rows if e is not None and len(e) == components and all(x is not None and math.isfinite(x) for x in e)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in first[:k]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for turn in range(rounds + 1):
        put = [min((apart(v, c), j) for j, c in enumerate(centres)) for _, v in kept]
        if turn == rounds:
            break
        own = defaultdict(list)
        for (_, v), (_, j) in zip(kept, put):
            own[j].append(v)
        centres = [[sum(x) // len(own[j]) for x in zip(*own[j])] if own[j] else c for j, c in enumerate(centres)]
    inertia = Counter()
    for d, j in put:
        inertia[j] += d
    return [(i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, put)]


def vectors(rng, n):
    heart = rng.normal(size=(12, 64))
    return [(i, (heart[i % 12] + 0.4 * rng.normal(size=64)).astype(np.float32).tolist(), i, "x", 1) for i in range(n)]


def test_clusters_equal_brute_force(spark):
    rows = vectors(np.random.default_rng(3), 300)
    one = [0.0] * 64
    odd = [(900, None, 1, "", 1), (901, [], 1, "", 1), (902, [1.0] * 63, 1, "", 1), (903, [*one[:63], None], 1, "", 1), (904, [*one[:63], float("nan")], 1, "", 1), (905, [*one[:63], float("inf")], 1, "", 1)]
    rows += [*odd, (906, one, 1, "", 1), (907, one, 1, "", 1), rows[5], (5, rows[6][1], 1, "", 1), (None, rows[7][1], 1, "", 1)]
    docs = spark.createDataFrame(rows, VECTORS).repartition(5)
    got = [tuple(r) for r in centroids.told(*centroids.cluster(docs)).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(got, key=key) == sorted(plain_clusters(rows), key=key)


def test_clusters_of_few_large_or_no_vectors(spark):
    rows = [(i, [float(i), -0.001 * i] * 32, 0, "", 0) for i in range(7)]
    assert sorted(map(tuple, centroids.told(*centroids.cluster(spark.createDataFrame(rows, VECTORS))).collect())) == sorted(plain_clusters(rows))
    rows = [(i, [(-1) ** i * 1e5 * i] * 64, 0, "", 0) for i in range(60)]  # past what is added up in 64 bits
    assert sorted(map(tuple, centroids.told(*centroids.cluster(spark.createDataFrame(rows, VECTORS))).collect())) == sorted(plain_clusters(rows))
    huge = [(0, [3e38] * 64, 0, "", 0), (1, [-3e38] * 64, 0, "", 0), (2, [0.0] * 64, 0, "", 0)]
    assert [r.distance for r in centroids.told(*centroids.cluster(spark.createDataFrame(huge, VECTORS))).collect()] == [0, 0, 0]
    out = centroids.told(*centroids.cluster(spark.createDataFrame([], VECTORS)))
    assert out.count() == 0 and out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_sort_means_skips_and_keeps_ties():
    c = np.array([[0, 0], [4, 0], [-4, 0], [4, 0]])
    order, apart = centroids.orders(c)
    v = np.array([[2, 0], [-2, 0], [0, 0], [4, 0], [100, 0]])
    for last in range(4):
        best, away = centroids.nearest(v, np.full(5, last), c, order, apart)
        assert best.tolist() == [0, 0, 0, 1, 1] and away.tolist() == [4, 4, 0, 0, 9216]


def plain_runs(words, least=24, times=3):
    """(start, length, period) by trying each period from each place."""
    n, best = len(words), {}
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j > i and j - i + p >= max(least, times * p):
                best.setdefault((i, j + p), p)  # the smallest period comes first
            i = max(j, i + 1)
    return sorted((s, e - s, p) for (s, e), p in best.items())


def periodic(rng, n):
    """Words with runs in runs, of few kinds so that they touch and overlap."""
    out = []
    while len(out) < n:
        unit = [rng.choice("abc") for _ in range(rng.choice([1, 2, 3, 5, 9, 40]))]
        unit = unit * rng.choice([1, 1, 4]) + [rng.choice("abcde")] * rng.choice([0, 1, 30])
        out += unit * rng.choice([1, 2, 3, 4, 8]) + unit[: rng.randrange(len(unit) + 1)]
    return out[:n]


def test_runs_equal_brute_force():
    rng = random.Random(8)
    for n in (0, 1, 23, 24, 25, 60, *(rng.randrange(24, 500) for _ in range(150))):
        words = periodic(rng, n)
        assert runs.runs(interned(" ".join(words).encode())[1]) == plain_runs(words)
    for words in (["a"] * 400, list("ab") * 150, list("abcdefgh") * 3, [str(i) for i in range(300)], ["x"] * 23 + ["y"] + ["x"] * 24):
        assert runs.runs(interned(" ".join(words).encode())[1]) == plain_runs(words)


def test_agreements():
    s = list("abacabadabacabaabac")
    assert runs.agreements(s)[1:] == [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(1, len(s))]


def plain_digest(doc_id, text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words)
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(found), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], sha("".join(f"{s},{n},{p}\n" for s, n, p in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    joined = lambda words: "".join(w + rng.choice([" ", "  ", "\n", "\t", "\x0b", " \r\n"]) for w in words)
    out = [(i, joined(periodic(rng, rng.randrange(400)) if i % 3 else [f"é{i}{k}" for k in range(rng.randrange(300))]), "en", "x", 1) for i in range(80)]
    out += [(100, None, None, "", 1), (101, "", "", "", 1), (102, " \n\t ", "en", "", 1), (103, "a\xa0a " * 50, "en", "", 1), (None, "a b " * 30, "en", "", 1), (104, " ".join(periodic(rng, 20000)), "fr", "", 1)]
    return [*out, out[4], out[4]]


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, *map(str, r)))


def test_runs_of_rows(spark, texts):
    few = [t for t in texts if t[0] != 104]
    assert any(zlib.crc32(str(t[0]).encode()) % 10 == 0 for t in few)
    docs = spark.createDataFrame(few, DOCS).repartition(4)
    assert order(map(tuple, runs.digest(runs.find(docs, stretch=True)).collect())) == order(plain_digest(i, t) for i, t, *_ in few)
    plain = {r.doc_id: r for r in runs.find(docs).collect()}
    assert plain[103].collapsed == "a\xa0a" and [tuple(r) for r in plain[103].runs] == [(0, 50, 1)]
    long = runs.find(spark.createDataFrame([t for t in texts if t[0] == 104], DOCS)).first()
    assert [tuple(r) for r in long.runs] == runs.runs(interned(texts[-3][1].encode())[1]) and long.n_words == 20000
    assert runs.digest(runs.find(docs.limit(0))).count() == 0


def plain_counts(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    held = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return (len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(held), len(lines), len(re.findall("[A-Z]", text or "")), len(re.findall("[!?]", text or "")))


def test_counts_of_rules(spark, texts):
    more = [(200, "a b c\na b c\n\n \na b c\r\na b c d##|<é>&", "en", "", 1), (201, "x y z x y z x", "en", "", 1), (202, "A! B? " * 40, "en", "", 1)]
    rows = [*texts, *more]
    got = quality_rules.counts(spark.createDataFrame(rows, DOCS).repartition(3), F.col("lang")).select("doc_id", *quality_rules.COUNTS).collect()
    assert order(map(tuple, got)) == order((i, *plain_counts(t)) for i, t, *_ in rows)


def test_tail_is_the_binomial():
    for n, k, p in ((10, 0, 0.1), (50, 7, 0.05), (200, 200, 0.3), (400, 3, 0.02)):
        want = sum(Fraction(math.comb(n, i)) * Fraction(p) ** i * (1 - Fraction(p)) ** (n - i) for i in range(k + 1))
        assert quality_rules.tail(n, k, p) == pytest.approx(float(want), rel=1e-9)


def plain_judge(rows, labels, limit=0.05, error=0.05):
    """kept per (doc_id, text, stratum), with the rules of each stratum from plain loops."""
    known = {}
    for i, q in labels:
        if i is not None and q in (0, 1):
            known[i] = min(q, known.get(i, 1))
    rules, told = quality_rules.RULES, []
    for i, text, stratum, *_ in rows:
        words, chars, symbols, same, repeats, lines, capitals, marks = plain_counts(text)
        base = words < 50 or 100 * repeats > 50 * words
        w, c, n = max(words, 1), max(chars, 1), max(lines, 1)
        signal = {"symbols": 1000 * symbols // w, "repeats": 1000 * repeats // w, "same_lines": 1000 * same // n, "capitals": 1000 * capitals // c, "marks": 1000 * marks // w, "long_words": 1000 * chars // w, "short_words": 1000 * chars // w}
        hit = {r: next((k for k, x in enumerate(cut) if (signal[r] <= x if r == "short_words" else signal[r] >= x)), len(cut)) for r, cut in rules.items()}
        told.append((i, stratum, base, hit))
    cut = {}
    part = lambda i: zlib.crc32(str(i).encode()) % 3
    own = [(s, hit, known[i] == 1, part(i)) for i, s, base, hit in told if i in known and not base and part(i) != 1]
    paths = {}
    for stratum in {s for s, *_ in own}:
        tune = [(hit, good) for s, hit, good, k in own if s == stratum and k == 0]
        cutoff = {}
        for r in rules:
            gain = {}
            for k in range(12):
                lost = sum(good and hit[r] <= k for hit, good in tune)
                if lost * len(rules) <= sum(good for _, good in tune) * limit:
                    gain[k] = sum(not good and hit[r] <= k for hit, good in tune) - lost
            if gain and max(gain.values()) > 0:
                best = [k for k in gain if gain[k] == max(gain.values())]
                cutoff[r] = best[(len(best) + 1) // 2 - 1]
        path = []
        while True:
            left = [(hit, good) for hit, good in tune if not any(hit[r] <= cutoff[r] for r in path)]
            worth = {r: sum((-1 if good else 1) for hit, good in left if hit[r] <= cutoff[r]) for r in cutoff}
            new = min(worth, key=lambda r: (-worth[r], r), default=None)
            if new is None or worth[new] <= 0:
                break
            path.append(new)
        if path:
            paths[stratum] = [(r, cutoff[r]) for r in path]
    for stratum, path in paths.items():
        held = [hit for s, hit, good, k in own if s == stratum and k == 2 and good]
        passed, stop = {}, not held
        for r, most in path:
            for k in range(most + 1):
                trial = passed | {r: k}
                lost = sum(any(hit[x] <= y for x, y in trial.items()) for hit in held)
                stop = stop or quality_rules.tail(len(held), lost, limit) > error / len(paths)
                if not stop:
                    passed = trial
        cut[stratum] = passed
    return [(i, base, not base and not any(hit[r] <= k for r, k in cut.get(s, {}).items())) for i, s, base, hit in told], cut


@pytest.fixture(scope="module")
def labelled():
    """Good and bad texts of two strata, one stratum with too few labels, and one without."""
    rng = random.Random(12)
    rows, labels = [], []
    for i in range(3000):
        stratum = ["en", "en", None, "zz"][i % 4] if i < 2900 else ("few" if i < 2980 else "none")
        words = [rng.choice("abcdefgh") * rng.randrange(1, 9) + rng.choice("abcdefgh") * rng.randrange(3) for _ in range(rng.choice([20, 60, 80]))]
        kind = rng.choice(["good"] * 6 + ["signs", "shout", "lines", "odd"])
        if kind == "signs":
            words = [w + rng.choice(["", "#", "||"]) for w in words]
        elif kind == "shout":
            words = [w.upper() + rng.choice(["!", "!!", ""]) for w in words]
        elif kind == "lines":
            words = [*words, *(["\nsame line"] * rng.randrange(3, 20))]
        elif kind == "odd":
            words = [w + "#" if rng.random() < 0.1 else w for w in words]
        rows.append((i, " ".join(words), stratum, "", 1))
        if stratum != "none":
            labels.append((i, int(kind in ("good", "odd")), 0))
    rows += [(5000, None, "en", "", 1), (5001, "", None, "", 1), (None, rows[3][1], "en", "", 1), rows[8], rows[8]]
    labels += [(None, 1, 0), (7, 0, 0), (9, None, 0), (10, 5, 0)]
    return rows, labels


def test_rules_equal_plain_loops(spark, labelled):
    rows, labels = labelled
    docs, marks = spark.createDataFrame(rows, DOCS).repartition(4), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    want, cut = plain_judge(rows, [(i, q) for i, q, _ in labels])
    assert cut["en"] and cut[None] and cut.get("few", {}) == {} and "none" not in cut
    got = quality_rules.judge(docs, marks, F.col("lang"))
    assert order((r.doc_id, r.base_failed, r.kept) for r in got.collect()) == order(want)
    shuffled = quality_rules.judge(docs, marks, F.col("lang"), broadcast_rows=0)
    assert order((r.doc_id, r.base_failed, r.kept) for r in shuffled.collect()) == order(want)
    # without labels of both classes only the base rules hold
    for some in (marks.limit(0), marks.where("quality = 0")):
        assert all(r.kept == (not r.base_failed) for r in quality_rules.judge(docs, some, F.col("lang")).collect())
    assert quality_rules.judge(docs.limit(0), marks, F.col("lang")).count() == 0


def test_rules_keep_the_limit(spark):
    """Held-out good documents of the given tables: hardly any is rejected, and most bad ones are."""
    d = "/root/testdata/sf0.1"
    got = queries.op12_quality_rules(spark, d).where("NOT base_failed").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("crc32(cast(doc_id AS string)) % 3 = 1")
    n = {(r.quality, r.kept): r["count"] for r in got.groupBy("quality", "kept").count().collect()}
    assert n.get((1, False), 0) <= 0.05 * n[1, True] and n.get((0, True), 0) <= 0.1 * n[0, False]
