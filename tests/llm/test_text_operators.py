"""Operators on texts against brute force, and their edge cases: nulls, empty and long texts, ties, repeated rows, no rows, clashing columns."""

import random
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexispan.llm import common, mixing, packing, quality, simhash, suffix_dedup, token_counts, token_io, toxicity
from lexispan.llm.queries import vocabulary
from lexispan.llm.tokens import BatchEncoder
from tests.llm import brute

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "té", "ru", "zz") for b in ("na", "se", "ß", "to", "q")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ".", ",\n"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    passage, long = prose(rng, 120), prose(rng, 9000)
    texts = [prose(rng, n) for n in (1, 3, 4, 5, 50, 300)]
    texts += [prose(rng, 40) + passage + prose(rng, 30), passage, passage, prose(rng, 5) + passage[:600], long, long[:20000] + "x" + long[20000:], None, "", " \n\t", "a" * 1500, "ab" * 700, None]
    texts += [texts[5], texts[5].replace("ka", "lo", 1), "é" * 700, "The THE the tHe the", "the the the the the"]
    out = [(i, t, "en", ["s1", "s2", None, "s0"][i % 4], None) for i, t in enumerate(texts)]
    return [*out, out[5], (None, "null id text", None, None, 7), (None, "null id text", None, None, 7)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_encoder_is_the_tokenizer():
    odd = ["", None, "a  b  c\n\n x ", "it's  3rd　　 tab\t\tq<|endoftext|> z<|startoftext|>", "\n\n\n", "   a", "café x  y", "İstanbul ΣΑΣ ①② ", prose(random.Random(1), 400)]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        e = BatchEncoder(vocabulary(name), keep=40, together=7)
        for _ in range(2):
            ids, at = e.encode(pa.array(odd))
            for i, t in enumerate(odd):
                assert ids[at[i] : at[i + 1]].tolist() == e.tokenizer.encode(t or "", add_special_tokens=False).ids
        ids, at = e.encode(pa.array([], pa.string()))
        assert len(ids) == 0 and at.tolist() == [0]


def test_encoder_equals_the_plain_call_in_any_company():
    """Texts that begin and end in any character, beside any others, special strings among them."""
    from tokenizers import Tokenizer

    rng = random.Random(31)
    sign = lambda: chr(rng.choice([rng.randrange(1, 128), rng.randrange(65, 91), rng.randrange(128, 0x800), rng.randrange(0x800, 0xD800), rng.randrange(0xE000, 0x110000), 0x301, 0x308, 0xC4]))
    word = lambda: rng.choice(["the", "USA", "été", "Vitamin C", "it'S", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|endof", "text|>", " ", "  ", "\n", sign(), sign() + sign(), "12", "!?", "A\u0301"])
    texts = ["vitamin C", "ähnlich", "the USA", "été", "", "I", "\u0301x", None, "A", "alike", "Z<|endoftext|", ">"]
    texts += [sign() + "".join(word() for _ in range(rng.randrange(6))) + sign() for _ in range(3000)]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        plain = Tokenizer.from_file(vocabulary(name))
        want = [x.ids for x in plain.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
        for size in (1, 7, len(texts)):
            e = BatchEncoder(vocabulary(name))
            for k in range(0, len(texts) if size > 1 else 300, size):
                ids, at = e.encode(pa.array(texts[k : k + size], pa.string()))
                for i, w in enumerate(want[k : k + size]):
                    assert ids[at[i] : at[i + 1]].tolist() == w, texts[k + i]
        plain.encode_special_tokens = True
        ids, at = BatchEncoder(vocabulary(name), ordinary=True).encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [x.ids for x in plain.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]


def test_encoder_shares_the_pieces_of_words():
    """Where marks are at ends of words, white space, capitals and marks after a word make no new piece; accented words are plain ones. All as the library has it."""
    from tokenizers import Tokenizer

    rng = random.Random(8)
    latin = [chr(c) for c in range(0xC0, 0x100)]
    words = ["".join(rng.choice([*"abcxyzABC", *latin]) for _ in range(rng.randint(1, 9))) for _ in range(2000)]
    ends = ["", "", ".", ",", "$$$", "&&&", "***", "###", "%%%", "'s", "\u0301", "\u0308.", "\u00d7", "<|endoftext|>", "\u0130", "-", "\u00a8"]
    texts = [rng.choice(["", " ", "\n", "\t"]).join(w + rng.choice(ends) + rng.choice([" ", "\n", "\u00a0", "\x1c", ""]) for w in words[k : k + 5]) for k in range(0, 2000, 5)]
    texts += ["a\u00e9.", "\u00e9.", "\u00c3.", "\u00c9", "\u00c9\u0301", "\u00c9\u00c9", "\u00c3", "\u00a3.", "\u4e03#", "\u0143\u00df\u00e0\u00ed"]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        plain, e = Tokenizer.from_file(vocabulary(name)), BatchEncoder(vocabulary(name))
        ids, at = e.encode(pa.array(texts))
        for i, t in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == plain.encode(t, add_special_tokens=False).ids, t
    e = BatchEncoder(vocabulary("word_bpe_49k.json"))
    e.encode(pa.array([" \u00e9t\u00e9"]))
    e.tokenizer = None  # the patterns are not needed for small letters
    ids, at = e.encode(pa.array([" \u00e9t\u00e9\n\u00c9T\u00c9\t\u00c9t\u00e9 stra\u00dfe \u00e0\u00ed"]))
    assert ids.tolist() == Tokenizer.from_file(vocabulary("word_bpe_49k.json")).encode("\u00e9t\u00e9 \u00e9t\u00e9 \u00e9t\u00e9 stra\u00dfe \u00e0\u00ed").ids
    assert len(e.known.pieces) == 3


def test_token_files_do_not_depend_on_partitions(spark):
    texts = ["the USA", "été", "vitamin C", "ähnlich", None, "I", "", "Ümit A", "<|endoftext|>"] * 6
    rows = [(i // 2 if i % 9 else None, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = [sorted(map(tuple, token_io.round_trip(d, vocabulary("word_bpe_49k.json")).collect()), key=str) for d in (docs.coalesce(1), docs.repartition(7), docs.orderBy(F.desc("text")))]
    assert found[0] == found[1] == found[2] and len(found[0]) == len(rows)


def test_encoder_knows_every_letter_and_mark():
    """Letters that normalisation takes apart, marks under capitals, stops, and white space of all kinds."""
    signs = [chr(c) for c in (*range(1, 0xD800), *range(0xE000, 0x11000), *range(0x1D400, 0x1D800), *range(0x2F800, 0x2FA20)) if unicodedata.category(chr(c))[0] in "LMZ"]
    texts = ["ab" + "cd ".join(signs[i : i + 20]) + "x. " + "Hq ".join(signs[i : i + 20]) + "." for i in range(0, len(signs), 20)]
    rng = random.Random(6)
    pool = [*signs[:6000], *(" \n\t.,;:!?\"'()abcdeABCDE019\xa0\u3000\u0331\u0301\x01" * 100)]
    texts += ["".join(rng.choice(pool) for _ in range(rng.randint(0, 80))) for _ in range(1500)]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        e = BatchEncoder(vocabulary(name))
        ids, at = e.encode(pa.array(texts))
        for i, x in enumerate(e.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            assert ids[at[i] : at[i + 1]].tolist() == x.ids, texts[i]


def test_token_files_round_trip(spark, docs, rows, empty):
    vocab = vocabulary("word_bpe_49k.json")
    path = common.scratch_path(spark, "test-ids")
    token_io.write(docs.withColumn("part", F.lit(1)), path, vocab, 1, segment_ids=5000)
    got = token_io.read(spark, path, True).orderBy("start").collect()
    e = BatchEncoder(vocab)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at = 0
    for r, (doc, text, *_) in zip(got, order, strict=True):
        ids = np.array(e.tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (doc, at, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes())
        at += len(ids)
    assert token_io.round_trip(empty, vocab).count() == 0


def test_blocks_stand_alone_and_are_checked():
    rng = np.random.default_rng(2)
    ids = np.concatenate((rng.zipf(1.4, 5000) % 60000, np.tile(np.arange(40), 60), rng.integers(0, 1 << 31, 300), [7] * 3000)).astype(np.uint32)
    data = token_io.segment(ids, np.array([1, 2]), np.array([10, len(ids) - 10]))
    assert (token_io.read_segment(data)[0] == ids).all()
    assert (token_io.read_segment(data, [3, 6])[0] == np.concatenate((ids[3 * token_io.BLOCK : 4 * token_io.BLOCK], ids[6 * token_io.BLOCK : 7 * token_io.BLOCK]))).all()
    for at in (20, len(data) // 2):
        bad = bytearray(data)
        bad[at] ^= 0x55
        with pytest.raises((ValueError, zlib.error)):
            token_io.read_segment(bytes(bad))
    again = np.tile(rng.integers(0, 49000, 200), 50).astype(np.uint32)
    assert len(token_io.segment(again, np.array([1]), np.array([len(again)]))) * 8 < 9 * len(again)
    for n in (0, 1, token_io.BLOCK, token_io.BLOCK + 1):
        assert (token_io.read_segment(token_io.segment(ids[:n], np.array([1]), np.array([n])))[0] == ids[:n]).all()


def test_mixing_targets(spark, docs, rows, empty):
    m = mixing.mix(docs.withColumn("size", F.lit("clash")), mixing.word_count()).collect()
    assert len(m) == len(rows)
    size = {}
    for _, text, _, source, _ in rows:
        size[source] = size.get(source, 0) + len((text or "").split())
    weights = dict(zip(sorted(size, key=lambda s: (s is None, s or "")), (1, 2, 3, 1), strict=False))
    left, target, total = set(size), {}, sum(size.values())
    while True:  # fill those that are full, share the rest
        level = (total - sum(3 * size[s] for s in target)) / sum(weights[s] for s in left)
        full = [s for s in left if level * weights[s] > 3 * size[s]]
        if not full:
            break
        for s in full:
            target[s] = 3 * size[s]
            left.remove(s)
    target |= {s: level * weights[s] for s in left}
    for r in m:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source]) and 0 <= r.copies <= 3
        assert r.copies - r.target / r.source_size < 1 and r.target / r.source_size - r.copies < 1
    again = mixing.mix(docs.repartition(7), mixing.word_count()).collect()
    key = lambda r: (str(r.doc_id), str(r.text), r.copies)
    assert sorted(map(key, again)) == sorted(map(key, m))
    assert mixing.emitted(mixing.mix(docs, mixing.word_count())).count() == sum(r.copies for r in m)
    wide = mixing.mix(docs, mixing.word_count(), broadcast_rows=1).collect()  # as with more sources than a task may rank
    assert sorted((*key(r), str(r.source), r.target, r.source_size) for r in wide) == sorted((*key(r), str(r.source), r.target, r.source_size) for r in m)
    assert mixing.mix(empty, mixing.word_count()).count() == 0
    given = spark.createDataFrame([("s1", 1.0), ("s2", 0.0)], "source string, weight double")
    assert {r.source for r in mixing.mix(docs, mixing.word_count(), weights=given).where("copies > 0").collect()} == {"s1"}


def test_mixing_comes_near_its_targets(spark):
    rng = random.Random(9)
    many = spark.createDataFrame([(i, "w " * rng.randint(1, 60), None, f"s{i % 7 if i % 3 else 0}", None) for i in range(6000)], DOCS)
    for r in mixing.mix(many, mixing.word_count()).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.max("target").alias("target")).collect():
        assert abs(r.taken / r.target - 1) < 0.12


@pytest.mark.parametrize("distance", [4, 8])
def test_simhash_table_links(spark, distance):
    rng = np.random.default_rng(distance)
    base = rng.integers(0, 1 << 63, 60, np.uint64)
    flips = [np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (60, k)).astype(np.uint64), axis=1) for k in (1, 3, 6, 8, 9, 20)]
    fp = np.unique(np.concatenate([base, *[base ^ f for f in flips], base[0] ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))]))
    i, j = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= distance)
    want = brute.joined(len(fp), [(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True) if a < b])
    place = {int(v): k for k, v in enumerate(fp)}
    rows = simhash.links(spark.createDataFrame([(int(v),) for v in fp.view(np.int64)], "fp bigint"), distance).collect()
    pairs = [(place[r.a % (1 << 64)], place[r.b % (1 << 64)]) for r in rows]
    assert all((int(fp[a]) ^ int(fp[b])).bit_count() <= distance for a, b in pairs)
    assert brute.joined(len(fp), pairs) == want


@pytest.mark.parametrize("hot", [200_000, 2])
def test_suffix_dedup_is_brute_force(docs, empty, hot):
    got = suffix_dedup.remove(docs.withColumn("removed", F.lit(1)), 400, hot=hot).collect()
    texts = [r.text for r in docs.select("text").collect()]
    import hashlib

    want = sorted(brute.repeats(texts))
    assert sorted((r.n_bytes, r.n_removed, len(r.removed), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got) == want
    assert sum(w[1] for w in want) > 10_000
    assert suffix_dedup.remove(empty, 400).count() == 0
    whole = suffix_dedup.remove(docs, 400, as_text=True).collect()
    assert all(r.kept.encode().decode() == r.kept for r in whole)


def test_suffix_dedup_of_hot_grams(spark):
    """One gram in every text, in long and short passages, split by content and string by string; rows alike in id and text."""
    import hashlib

    rng = random.Random(12)
    gram, page = prose(rng, 12)[:70], prose(rng, 90)
    texts = [prose(rng, rng.randint(0, 40)) + rng.choice([gram, page[:300], page[:420], page[100:505], page]) + prose(rng, rng.randint(0, 60)) for _ in range(160)]
    texts += [texts[3]] * 40
    rows = [(i if i < 160 else 160, t) for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    want = sorted(brute.repeats(texts))
    for hot in (40_000, 60, 1):
        got = suffix_dedup.remove(table, 400, hot=hot).collect()
        assert sorted((r.n_bytes, r.n_removed, len(r.removed), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got) == want
    short = [sorted(map(str, ((r.doc_id, r.removed) for r in suffix_dedup.remove(table, 400, hot=hot, words=30).collect()))) for hot in (40_000, 60, 1)]
    assert short[0] == short[1] == short[2] and short[0] != sorted(map(str, ((r.doc_id, r.removed) for r in suffix_dedup.remove(table, 400).collect())))


def test_suffix_merge_keeps_order_and_prefixes():
    rng = random.Random(3)
    pool = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 40))).encode() for _ in range(400)]
    runs = [sorted({pool[rng.randrange(400)] for _ in range(60)}) for _ in range(7)]
    blobs = [suffix_dedup.front_coded([(s, len(s), 0, 1, 0, 0) for s in run]) for run in runs]
    out = list(suffix_dedup.merged(blobs))
    assert [x[1] for x in out] == sorted(s for run in runs for s in run)
    for x, y in zip(out, out[1:]):  # noqa: B905
        assert y[0] == suffix_dedup.common_prefix(x[1], y[1], 0)
    assert list(suffix_dedup.merged([])) == []


def test_simhash_classes_are_brute_force(docs, rows, empty):
    got = simhash.classes(docs.withColumn("fp", F.lit("clash"))).collect()
    assert len(got) == len(rows)
    fps = [brute.simhash(r[1]) for r in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    own = brute.joined(len(rows), pairs)
    lowest = {}
    for r, c in zip(rows, own, strict=True):
        if r[0] is not None:
            lowest[c] = min(lowest.get(c, r[0]), r[0])
    want = sorted((str(r[0]), f, str(lowest.get(c))) for r, f, c in zip(rows, fps, own, strict=True))
    assert sorted((str(r.doc_id), r.fp % (1 << 64), str(r.component_id)) for r in got) == want
    assert simhash.classes(empty).count() == 0
    kept = simhash.kept(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(own))


def test_simhash_links_join_all_that_is_linked():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, np.uint64)
    fp = np.unique(np.concatenate([base, *[base ^ np.uint64((1 << int(a)) | (1 << int(b)) | (1 << int(c))) for a, b, c in rng.integers(0, 64, (30, 3))]]))
    i, j = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4)
    want = brute.joined(len(fp), [(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True) if a < b])
    place = {int(v): k for k, v in enumerate(fp)}
    for split in (20_000, 60):
        a, b = simhash.group_links(fp, 4, split)
        assert (np.bitwise_count(a ^ b) <= 4).all() and len(a) < len(fp)
        assert brute.joined(len(fp), [(place[int(x)], place[int(y)]) for x, y in zip(a, b, strict=True)]) == want
    assert simhash.layout(1 << 17, 4)[0][2] == 1 and simhash.layout(1 << 40, 4) == [(0, 32, 2), (32, 32, 2)] and len(simhash.layout(1 << 17, 8)) == 5


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1100)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = brute.joined(1101, edges)
    assert got == {n: want[n] for n in got} and {n for e in edges for n in e if e[0] != e[1]} <= set(got)
    assert common.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_token_counts(spark, docs, rows, empty):
    vocab = vocabulary("byte_bpe_50k.json")
    e = BatchEncoder(vocab)
    n = np.array([len(e.tokenizer.encode(r[1] or "", add_special_tokens=False).ids) for r in rows])
    for bucket in (4096, 16):
        h = token_counts.histogram(token_counts.encoded_lengths(docs.withColumn("bucket", F.lit(1)), vocab), bucket)
        for r in h.collect():
            assert (r.n_docs, r.docs_over, r.tokens_over, r.truncated_total) == ((n == r.n_tokens).sum(), (n > r.n_tokens).sum(), n[n > r.n_tokens].sum(), np.minimum(n, r.n_tokens).sum())
        assert token_counts.truncated_total(h, 100).first().tokens == np.minimum(n, 100).sum()
        assert token_counts.quantile(h, 0.5).first().n_tokens == np.sort(n)[-(-len(n) // 2) - 1]
    assert token_counts.histogram(token_counts.encoded_lengths(empty, vocab)).count() == 0


def test_packing(docs, rows, empty):
    vocab = vocabulary("byte_bpe_50k.json")
    got = packing.pack(docs.withColumn("piece", F.lit(1)), vocab, 2, 64, with_ids=True).collect()
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
    for own in seqs.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    e = BatchEncoder(vocab)
    whole = sorted([e.tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [2] for r in rows])
    pieces = {}
    for r in sorted(got, key=lambda r: (r.start, r.ids)):
        pieces.setdefault(r.doc_id, []).append(r)
    assert sum(r.length for r in got) == sum(map(len, whole)) and len(seqs) <= 1.02 * sum(map(len, whole)) / 64 + 1
    for doc, text, *_ in rows:
        if doc is not None and doc != 5:
            ids = e.tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
            own = sorted(pieces[doc], key=lambda r: r.piece)
            assert np.frombuffer(b"".join(bytes(r.ids) for r in own), "<u4").tolist() == ids
            assert all(r.length == 64 for r in own[1:]) and [r.piece for r in own] == list(range(len(own)))
    assert packing.pack(empty, vocab).count() == 0


def test_packing_plan_uses_each_piece_once():
    rng = np.random.default_rng(8)
    for size in (1, 7, 100, 1024):
        counts = np.concatenate(([0], rng.integers(0, 40, size)))
        left = counts.copy()
        patterns = packing.plan(counts, size)
        for lengths, times in patterns:
            assert sum(lengths) <= size and times > 0
            for v in lengths:
                left[v] -= times
        assert not left.any()
        alone = packing.best_fit(counts, size)
        assert sum(t for _, t in alone) == brute.best_fit(counts, size) and sum(t for _, t in patterns) <= brute.best_fit(counts, size)
    left = np.array([0, 2, 0, 1, 0, 0])
    sums = packing.Sums(left)
    assert [sums.fill(left, g, n) for g, n in ((3, 1), (4, 2), (5, 3), (2, 2), (5, 2), (4, 3), (3, 3))] == [(3,), (3, 1), (3, 1, 1), (1, 1), (), (), ()]


def test_packing_uses_pairs_and_triples():
    counts = np.zeros(101, np.int64)
    counts[[80, 20, 60, 25, 15, 71, 9, 8, 12]] = 10  # 80 + 20, 60 + 25 + 15, 71 + 12 + 9 + 8
    patterns = packing.plan(counts, 100)
    full = {n: sum(t for own, t in patterns if len(own) == n and sum(own) == 100) for n in (2, 3, 4)}
    assert min(full.values()) > 0 and sum(t for _, t in patterns) <= brute.best_fit(counts, 100)


def labelled(spark, n=400):
    rng = random.Random(6)
    rows, marks = [], []
    for i in range(n):
        toxic, bad = i % 5 == 0, i % 4 == 1
        words = [w + rng.choice(WORDS) for w in rng.choices(WORDS, k=rng.randint(30, 200))]
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["grobnikov", "vrexulous", "zwackpfui"]))
        text = " ".join(w.upper() + "!!" for w in words) if bad else " ".join(words)
        rows.append((i, text, "en", f"s{i % 6}", None))
        marks.append((i, 0 if bad else 1, int(toxic)))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")


def test_toxicity(spark, docs, empty):
    texts, marks = labelled(spark)
    model = toxicity.train(texts, marks.withColumn("text", F.lit("clash")))
    rows = toxicity.score(texts.withColumn("score", F.lit("clash")), model).collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1}
    right = sum(r.predicted == (r.doc_id % 5 == 0) for r in held)
    assert right / len(held) > 0.95 and all(0 <= r.score <= 1 for r in rows)
    some = toxicity.score(docs, model).collect()
    assert len(some) == docs.count() and len({r.score for r in some if r.text in (None, "")}) == 1
    assert toxicity.score(empty, model).count() == 0
    none = toxicity.train(texts, marks.where("toxic = 0"))
    assert none is None and {r.score for r in toxicity.score(docs, none).collect()} == {0.0}


def test_quality(spark, docs, empty):
    texts, marks = labelled(spark)
    site, path = F.col("source"), F.concat_ws("/", "source", "lang")
    rows = quality.classify(texts.withColumn("host", F.lit("clash")), marks, site, path).collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert sum(r.keep == (r.doc_id % 4 != 1) for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and 0 <= r.host_posterior <= 1 and 0 <= r.path_posterior <= 1 for r in rows)
    assert quality.classify(docs, marks, site, path).count() == docs.count()
    assert quality.classify(empty, marks, site, path).count() == 0
    one = quality.classify(texts, marks.where("quality = 1"), site, path)
    assert one.count() == 400


def test_quality_is_brute_force(spark, docs):
    """Every number of classify, by loops over rows, words and sites; null sites and paths together."""
    import math

    texts, marks = labelled(spark)
    both = texts.unionByName(docs).withColumn("source", F.when(F.col("doc_id") % 7 != 0, F.col("source"))).withColumn("lang", F.when(F.col("doc_id") % 5 != 0, F.col("lang"))).persist()
    path = F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.coalesce("lang", F.lit("")))
    got = quality.classify(both, marks, F.col("source"), path).collect()
    model = quality.fit(both, marks)
    rows = []
    for r in both.collect():
        b = (r.text or "").encode()
        words = b.split()
        w, own = max(1, len(words)), max(1, len(b))
        capitals, digits = sum(65 <= c < 91 for c in b), sum(48 <= c < 58 for c in b)
        letters, signs = capitals + sum(97 <= c < 123 or c > 127 for c in b), sum(33 <= c < 48 or 58 <= c < 65 or 91 <= c < 97 or 123 <= c < 127 for c in b)
        told = [model["odds"][x] for x in b.lower().split() if x in model["odds"]]
        x = [math.log1p(len(words)), own / w, capitals / max(1, letters), digits / own, signs / own, signs / w, math.log1p(len(set(words))) - math.log1p(len(words)), sum(p == q for p, q in zip(words, words[1:], strict=False)) / w, b.count(b"\n") / w, sum(told) / w, len(told) / w]
        z = [min(max((v - m) / s, -8), 8) for v, m, s in zip(x, model["mean"], model["spread"], strict=True)]
        total = sum(a * c for a, c in zip([*z, *(v * v for v in z), 1], model["weights"], strict=True))
        rows.append((r.doc_id, r.source, f"{r.source or ''}/{r.lang or ''}", 1 / (1 + math.exp(-min(max(total, -12), 12)))))
    hosts, paths = {}, {}
    for _, h, q, p in rows:
        for table, key in ((hosts, h), (paths, (h, q))):
            n, good = table.get(key, (0, 0.0))
            table[key] = (n + 1, good + p)
    total, mean = len(rows), sum(r[3] for r in rows) / len(rows)
    share = {h: g / n for h, (n, g) in hosts.items()}
    host_weight = quality.prior_weight(sum(n * (share[h] - mean) ** 2 for h, (n, _) in hosts.items()), len(hosts), mean * (1 - mean), total)
    drawn = sum(n * share[h] * (1 - share[h]) for (h, _), (n, _) in paths.items()) / total
    path_weight = quality.prior_weight(sum(n * (g / n - share[h]) ** 2 for (h, _), (n, g) in paths.items()), len(paths), drawn, total)
    logit = lambda p: math.log(min(max(p, 1e-4), 1 - 1e-4) / (1 - min(max(p, 1e-4), 1 - 1e-4)))
    want = []
    for i, h, q, p in rows:
        up = (max(hosts[h][1] - p, 0) + host_weight * mean) / (hosts[h][0] - 1 + host_weight)
        down = (max(paths[h, q][1] - p, 0) + path_weight * up) / (paths[h, q][0] - 1 + path_weight)
        want.append((i is None, i or 0, str(h), q, up, down, 1 / (1 + math.exp(-(logit(down) + logit(p) - math.log(model["prior"] / (1 - model["prior"])))))))
    found = sorted((r.doc_id is None, r.doc_id or 0, str(r.host), r.path, r.host_posterior, r.path_posterior, r.score) for r in got)
    assert [r[:4] for r in found] == [r[:4] for r in sorted(want)]
    assert np.allclose([r[4:] for r in found], [r[4:] for r in sorted(want)], atol=1e-9)


def test_toxicity_is_brute_force(spark, docs):
    """Scores by a compressor call for each window, and the labels that training may see."""
    import math

    import zstandard

    texts, marks = labelled(spark)
    model = toxicity.train(texts, marks)
    turned = marks.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.train(texts, turned)
    assert model["toxic"] == again["toxic"] and model["ordinary"] == again["ordinary"] and (model["weights"] == again["weights"]).all()
    c = toxicity.Compressors(model["ordinary"], model["toxic"])
    both = texts.limit(60).unionByName(docs)
    for r in toxicity.score(both, model).collect():
        b = (r.text or "").encode()
        starts = [0, *range(toxicity.STEP, max(1, len(b) - toxicity.WINDOW + toxicity.STEP), toxicity.STEP)] if b else []
        gains = [max(0, len(c.plain.compress(b[i : i + toxicity.WINDOW])) - len(c.both.compress(b[i : i + toxicity.WINDOW]))) for i in starts]
        x = [math.log1p(sum(gains)), min(max(gains, default=0), 8), min(sum(g >= 2 for g in gains), 20), math.log1p(len(gains)), 1]
        want = 1 / (1 + math.exp(-min(max(sum(a * w for a, w in zip(x, model["weights"], strict=True)), -30), 30)))
        assert abs(r.score - want) < 1e-9 and r.predicted == (want >= 0.7) and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    assert zstandard.ZstdCompressionDict(model["ordinary"], dict_type=zstandard.DICT_TYPE_RAWCONTENT) is not None


def test_quality_shrinks_sparse_sites(spark):
    rows = [("big", "big/a", 0.9)] * 200 + [("big", "big/b", 0.1)] + [("poor", "poor/a", 0.1)] * 200 + [("tiny", "tiny/a", 0.0)]
    sites, mean, host_weight, path_weight = quality.posteriors(spark.createDataFrame(rows, "host string, path string, p double"))
    assert mean == pytest.approx(sum(r[2] for r in rows) / len(rows)) and 1 <= host_weight <= 1000 and 1 <= path_weight <= 1000
    by = {r.path: r for r in sites.collect()}
    shrunk = lambda r: (r.host_good + host_weight * mean) / (r.host_n + host_weight)
    assert shrunk(by["big/a"]) > 0.8 and shrunk(by["poor/a"]) < 0.2 and 0 < shrunk(by["tiny/a"]) < mean


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as cp

    texts, marks = labelled(spark, 200)
    texts.write.parquet(str(tmp_path / "documents.parquet"))
    marks.write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in cp.STAGES[:-1]:
        n = docs.count()
        docs = common.written(stage(spark, docs, str(tmp_path)), f"test-{name}")
        assert docs.columns == list(cp.OWN)
        if name != "mix_sources":
            assert docs.count() <= n
    assert not docs.where("n_chars <> length(text)").where("n_chars IS NOT NULL").count()
    assert cp.run(spark, str(tmp_path)).count() > 0


def test_pipeline_edges(spark, docs, empty, tmp_path):
    """Nulls, empty and long texts, repeated rows and ids, no rows, other columns of clashing names, and no n_chars or lang."""
    import corpus_pipeline as cp

    marks = spark.createDataFrame([(0, 1, 1), (1, 1, 0), (None, 0, 1)], "doc_id bigint, quality int, toxic int")
    marks.write.parquet(str(tmp_path / "labels.parquet"))
    clash = {c: F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in ("score", "kept", "predicted", "size", "copies", "t", "node", "fp", "_t", "spans", "k1", "piece", "target")}
    now = docs.withColumns(clash).drop("n_chars", "lang")
    for k, (_, stage) in enumerate(cp.STAGES[:-1]):
        now = common.written(stage(spark, now, str(tmp_path)), "test-edges")
        assert now.columns == ["doc_id", "text", "source", *clash]
        rows = now.collect()
        assert rows and all(r[c] == c + ("none" if r.doc_id is None else str(r.doc_id)) for r in rows for c in clash)
        if k == 1:
            assert sum(not (r.text or "").split() for r in rows) == 1 and max(len(r.text or "") for r in rows) > 30_000
    assert cp.pack_sequences(spark, now, str(tmp_path)).where("offset < 0 OR length > 1024").count() == 0
    for _, stage in cp.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_near_copies_are_confirmed_on_shingles(spark, docs, empty):
    rng = random.Random(12)
    texts = []
    for _ in range(25):
        base = [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(rng.randint(60, 250))]
        texts.append(" ".join(base))
        for _ in range(6):  # similarities on both sides of 0.8
            new = list(base)
            for at in rng.sample(range(len(base)), max(1, len(base) // rng.choice([30, 45, 60, 100]))):
                new[at] = "changed" + rng.choice(WORDS)
            texts.append(" ".join(new))
    rows = [(i % 160, t, "en", "s", None) for i, t in enumerate(texts)] + [r[:5] for r in docs.collect()]
    sets = [brute.shingles(r[1]) for r in rows]
    similar = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b) > 0
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if similar(sets[i], sets[j])]
    far = sum((brute.simhash(rows[i][1], 5) ^ brute.simhash(rows[j][1], 5)).bit_count() > 8 for i, j in pairs)
    assert far > 20
    want = {}
    for r, c in zip(rows, brute.joined(len(rows), pairs), strict=True):
        want.setdefault(c, []).append((r[0] is None, r[0] or 0))
    got = simhash.similar_kept(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    own = dict(zip(sets, brute.joined(len(rows), pairs), strict=True))
    assert sorted(own[brute.shingles(r.text)] for r in got) == sorted(want)
    assert all((r.doc_id is None, r.doc_id or 0) == min(want[own[brute.shingles(r.text)]]) for r in got)
    assert simhash.similar_kept(empty).count() == 0


@pytest.mark.parametrize("hot", [200_000, 2])
def test_passages_of_51_words_are_cut(spark, docs, hot):
    rng = random.Random(13)
    plain = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    planted, short, tiny = plain(51), plain(50), " ".join(rng.choice("abcdefg") for _ in range(51))
    assert len(planted.encode()) < 400
    rows = [(k, f"{plain(rng.randint(0, 80))} {p} {plain(rng.randint(1, 80))}", "en", "s", None) for k, p in enumerate([planted, short, tiny, planted + "x"] * 3)]
    rows += [(50, planted, "en", "s", None), (51, "x" + planted, "en", "s", None), (52, tiny, "en", "s", None), (53, f"{plain(60)}\n{plain(3)} {planted}", "en", "s", None)]
    rows += [r[:5] for r in docs.collect()]
    got = suffix_dedup.remove(spark.createDataFrame(rows, DOCS).repartition(3), 400, hot=hot, as_text=True, words=51).collect()
    texts = [r[1] for r in rows]
    want = brute.without_passages(texts)
    assert sorted(r.kept for r in got) == sorted(want)
    assert not any(planted + " " in t or tiny in t for t in want) and sum(short in t for t in want) == 3
    told = suffix_dedup.remove(spark.createDataFrame(rows, DOCS).repartition(3), 400, hot=hot).collect()
    assert sorted((r.n_bytes, r.n_removed, len(r.removed)) for r in told) == sorted(w[:3] for w in brute.repeats(texts))


def test_crowded_buckets_are_split_at_8_bits():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 52, 6000, np.uint64)
    steps = [np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 52, (6000, k)).astype(np.uint64), axis=1) for k in (2, 8, 9)]
    fp = np.unique(np.concatenate([base, *(base ^ f for f in steps)]))  # 12 bits are common, as in a bucket
    assert len(fp) > 20_000
    a, b = simhash.group_links(fp, 8)
    assert (np.bitwise_count(a ^ b) <= 8).all() and len(a) < len(fp)
    place = {int(v): k for k, v in enumerate(fp)}
    number = lambda x, y: [(place[int(p)], place[int(q)]) for p, q in zip(x, y, strict=True)]
    assert brute.joined(len(fp), number(a, b)) == brute.joined(len(fp), number(*simhash.group_links(fp, 8, len(fp))))


def test_grams_of_value_0_are_anchors(monkeypatch):
    data = np.frombuffer(bytes(random.Random(2).randbytes(900)), np.uint8)
    plain = suffix_dedup.gram_hashes
    low = plain(data, suffix_dedup.GRAM)
    low[450] = 7  # the upper half is 0
    monkeypatch.setattr(suffix_dedup, "gram_hashes", lambda *_: low)
    own, h = suffix_dedup.anchors(data, np.array([0, len(data)]), 400)
    assert 450 in own.tolist() and 7 in h.tolist()


def test_simhash_keeps_one_row_of_a_class_whose_id_is_another_ones(spark):
    alone, shared = (prose(random.Random(k), 80) for k in (21, 22))
    rows = [(5, alone), (3, shared), (5, shared)]
    for keep in (simhash.kept, simhash.similar_kept):
        got = keep(spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], DOCS)).collect()
        assert sorted((r.doc_id, r.text) for r in got) == sorted([(5, alone), (3, shared)])


def test_pipeline_stages_are_brute_force(spark, tmp_path):
    import hashlib
    from collections import Counter

    import corpus_pipeline as cp

    texts, marks = labelled(spark, 200)
    rng = random.Random(31)
    rows = [tuple(r) for r in texts.collect()]
    passage = " ".join(rng.choice(WORDS) for _ in range(55))
    rows += [(1000 + k, f"{prose(rng, 40)} {passage} {prose(rng, 30 + k)}", "en", "s1", None) for k in range(4)]
    rows += [(2000 + k, r[1].replace(" ", " once ", 1) if k % 2 else r[1], "en", r[3], None) for k, r in enumerate(rows[:20])]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    marks.write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    plain = [r for r in toxicity.score(docs, toxicity.train(docs, marks)).collect() if r.predicted == 0]
    plain = [(r.doc_id, r.text, r.source) for r in plain]
    seen = []

    def now(k):
        nonlocal docs
        docs = common.written(cp.STAGES[k][1](spark, docs, str(tmp_path)), "test-plain")
        seen.append(docs.count())
        assert Counter((r.doc_id, r.text, r.source) for r in docs.collect()) == Counter(plain)

    now(0)
    plain.sort()
    sets = [brute.shingles(r[1]) for r in plain]
    pairs = [(i, j) for i in range(len(plain)) for j in range(i) if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) > 0]
    plain = [plain[i] for i in sorted(set(brute.joined(len(plain), pairs)))]
    now(1)
    plain = [(i, t, c) for (i, _, c), t in zip(plain, brute.without_passages([r[1] for r in plain]), strict=True)]
    now(2)
    size = Counter()
    for _, t, c in plain:
        size[c] += len(t.split())
    weights = {c: k % 3 + 1 for k, c in enumerate(sorted(size))}
    left, target, total = set(size), {}, sum(size.values())
    while True:
        level = (total - sum(target.values())) / sum(weights[c] for c in left)
        full = [c for c in left if level * weights[c] > 3 * size[c]]
        if not full:
            break
        for c in full:
            target[c] = 3 * size[c]
            left.remove(c)
    target |= {c: level * weights[c] for c in left}
    copies = lambda i, rate: int(rate) + (int(hashlib.md5(f"17:{i}".encode()).hexdigest()[:13], 16) / (1 << 52) < rate - int(rate))
    plain = [r for r in plain for _ in range(copies(r[0], target[r[2]] / size[r[2]]))]
    now(3)
    assert seen[0] < len(rows) and seen[1] < seen[0] and seen[2] == seen[1]
    e = BatchEncoder(vocabulary("byte_bpe_50k.json"))
    lengths = Counter()
    for i, t, _ in plain:
        lengths[i] += len(e.tokenizer.encode(t, add_special_tokens=False).ids) + 1
    got, used = Counter(), {}
    for r in cp.run(spark, str(tmp_path)).collect():
        got[r.doc_id] += r.length
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert got == lengths
    for own in used.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024


def test_links_of_a_crowd_are_joined_once(spark, monkeypatch):
    """Later rounds start from one link a node, not from all links of the rounds before, and no plan makes a large-star step twice."""
    rng = random.Random(17)
    texts = []
    for base in ([rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n)] for n in (400, 90)):
        for _ in range(60):  # one crowd within 8 bits, one that only bands see
            new = list(base)
            for at in rng.sample(range(len(base)), 1):
                new[at] = "changed" + rng.choice(WORDS) + rng.choice(WORDS)
            texts.append(" ".join(new))
    given, found, stars = [], [], []
    plain, confirmed, written = simhash.components, simhash.confirmed, common.written

    def counted(edges, name):
        given.append(edges.count())
        return plain(edges, name)

    def told(*of):
        out = confirmed(*of)
        found.append(out.count())
        return out

    def planned(df, name):
        stars.append(len(re.findall(r"Inner,.* \(low#\d+L? < m#", df._jdf.queryExecution().executedPlan().toString())))
        return written(df, name)

    monkeypatch.setattr(simhash, "components", counted)
    monkeypatch.setattr(simhash, "confirmed", told)
    monkeypatch.setattr(common, "written", planned)
    rows = [(k, t, "en", "s", None) for k, t in enumerate(texts)]
    got = simhash.similar_kept(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    sets = [brute.shingles(t) for t in texts]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert sorted(r.doc_id for r in got) == sorted(set(brute.joined(len(rows), pairs)))
    assert given[0] > 3 * len(rows) and len(given) > 1
    assert all(n < len(rows) + new for n, new in zip(given[1:], [*found[1:], len(rows)], strict=False))
    assert max(stars) == 1
