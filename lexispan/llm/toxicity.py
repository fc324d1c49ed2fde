"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary text and one on what sets
toxic text apart. Each window of a text is compressed twice, with the ordinary
dictionary and with the toxic one before it; the bytes that the toxic one saves
are the window's gain. Gains of a text, calibrated on labelled rows that the
dictionaries have not seen, give its score.

The toxic dictionary is trained on words of toxic texts around byte 5-grams that
no ordinary training text holds and several toxic ones do, else both dictionaries
would fill with the language's common strings and hardly differ.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispan.llm.common import released, ship
from lexispan.llm.tokens import flat, slices

GRAM = 5
WINDOW, STEP = 128, 112
#: Dictionary bytes: ordinary, toxic.
ORDINARY, TOXIC = 2000, 1200


def _grams(b: bytes) -> np.ndarray:
    """Slots, of 2**26, of a text's 5-grams."""
    x = np.frombuffer(b, np.uint8).astype(np.uint64)
    if len(x) < GRAM:
        return np.zeros(0, np.int64)
    h = np.zeros(len(x) - GRAM + 1, np.uint64)
    for i in range(GRAM):
        h = h * np.uint64(0x9E3779B97F4A7C15) + x[i : len(x) - GRAM + 1 + i]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(38)).astype(np.int64)


def telling_words(toxic: list[bytes], ordinary: list[bytes], share: float = 0.01) -> list[list[bytes]]:
    """Per toxic text its words, with the byte before and up to their last telling 5-gram: unseen in ordinary texts, in at least ``share`` of the toxic ones."""
    seen = np.zeros(1 << 26, bool)
    for b in ordinary:
        seen[_grams(b)] = True
    new = [np.flatnonzero(~seen[_grams(b)]) for b in toxic]
    held = Counter()
    for b, at in zip(toxic, new, strict=True):
        held.update({b[i : i + GRAM] for i in at.tolist()})
    need = max(4, int(share * len(toxic)))
    out = []
    for b, at in zip(toxic, new, strict=True):
        telling = np.array([i for i in at.tolist() if held[b[i : i + GRAM]] >= need], np.int64)
        words = []
        for m in re.finditer(rb"[^\x00-\x20]+", b) if len(telling) else ():
            a = max(0, m.start() - 1)
            lo, hi = np.searchsorted(telling, [a, m.end() + 2 - GRAM])  # grams inside the word and the bytes beside it
            if hi > lo:
                words.append(b[a : min(m.end(), int(telling[hi - 1]) + GRAM)])
        out.append(words)
    return out


def trained(samples: list[bytes], size: int, k: int, d: int) -> bytes:
    """The content that zstandard's trainer chooses; the samples' end where they are too few to train on."""
    import zstandard

    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(size + 1000, samples, k=k, d=d).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


class Compressors:
    """Gains of windows under the two dictionaries; ordinary strings are the nearer ones for both, so they cost the same."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.plain, self.both = self._of(ordinary), self._of(toxic + ordinary)

    @staticmethod
    def _of(content: bytes):
        import zstandard as z

        p = z.ZstdCompressionParameters(window_log=18, hash_log=13, chain_log=14, search_log=5, min_match=4, target_length=32, strategy=z.STRATEGY_BTOPT, write_content_size=0, write_checksum=0, write_dict_id=0)
        if len(content) < 8:
            return z.ZstdCompressor(compression_params=p)
        d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=p)
        return z.ZstdCompressor(dict_data=d, compression_params=p)

    def gains(self, windows: list[bytes]) -> np.ndarray:
        sizes = (np.fromiter(map(len, c.multi_compress_to_buffer(windows, threads=0)), np.int64, len(windows)) for c in (self.plain, self.both))
        plain, both = sizes
        return plain - both

    def features(self, texts: list[bytes]) -> np.ndarray:
        """Per text: log of the summed gain, the largest gain, windows that gain 2 or more, and log of the windows' number."""
        windows, first = [], [0]
        for b in texts:
            windows.extend([b[i : i + WINDOW] for i in range(0, max(1, len(b) - WINDOW + STEP), STEP)] if b else [])
            first.append(len(windows))
        first = np.array(first)
        gain = np.maximum(self.gains(windows), 0) if windows else np.zeros(0, np.int64)
        total = np.concatenate(([0], np.cumsum(gain)))
        many = np.concatenate(([0], np.cumsum(gain >= 2)))
        n = np.diff(first)
        top = np.array([gain[a:b].max(initial=0) for a, b in zip(first[:-1], first[1:], strict=True)])
        return np.stack((np.log1p(total[first[1:]] - total[first[:-1]]), np.minimum(top, 8), np.minimum(many[first[1:]] - many[first[:-1]], 20), np.log1p(n)), axis=1).astype(float)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights, the constant last, by Newton's method."""
    x = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(texts: list[bytes], toxic: list[int]) -> dict | None:
    """Dictionaries from two thirds of the texts, weights from the others; None if a class is missing."""
    y = np.array(toxic)
    part = np.zeros(len(y), int)
    for v in (0, 1):
        own = np.flatnonzero(y == v)
        part[own] = np.arange(len(own)) % 3
    bad = list(dict.fromkeys(t for t, v, p in zip(texts, y, part, strict=True) if v == 1 and p < 2))
    good = [t for t, v, p in zip(texts, y, part, strict=True) if v == 0 and p < 2]
    rest = np.flatnonzero(part == 2)
    if not bad or not good or len(set(y[rest])) < 2:
        return None
    words = telling_words(bad, good)
    samples = [b[i : i + 1024] for b in good for i in range(0, len(b), 1024)]
    model = {"ordinary": trained(samples, ORDINARY, 64, 8), "toxic": trained([b"".join(w) for w in words], TOXIC, 16, 6)}
    x = Compressors(model["ordinary"], model["toxic"]).features([texts[i] for i in rest])
    model["weights"] = logistic(x, y[rest])
    return model


def train(docs: DataFrame, labels: DataFrame, each: int = 3000) -> dict | None:
    """A model from at most ``each`` toxic and 2 * ``each`` ordinary labelled texts, those of the smallest hashed ids, which the driver holds."""
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64(F.lit(3), "doc_id")
    chosen = known.where("toxic = 1").orderBy(order).limit(each).unionByName(known.where("toxic = 0").orderBy(order).limit(2 * each))
    # one text for each id, so that what the driver gets is bounded by the ids
    rows = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (r.doc_id, r.text))
    return fit([r.text.encode() for r in rows], [r.toxic for r in rows])


def score(docs: DataFrame, model: dict | None, threshold: float = 0.7) -> DataFrame:
    """Documents with held_out, score and predicted; other columns stay.

    The text alone decides. Null and empty texts have no window and no gain; without
    a model, that is with labels of one class or none, every score is 0. Columns of
    the input whose names clash with those added are replaced.
    """
    ship(docs.sparkSession)
    base = docs.drop("held_out", "score", "predicted")
    names = base.columns

    def scored(batches):
        c = Compressors(model["ordinary"], model["toxic"]) if model else None
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                data, at = flat(part.column("text"))
                body = data.tobytes()
                if model:
                    x = c.features([body[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])
                    p = 1 / (1 + np.exp(-np.clip(x @ model["weights"][:-1] + model["weights"][-1], -30, 30)))
                else:
                    p = np.zeros(len(part))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p, pa.float64())], [*names, "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return base.mapInArrow(released(scored), f"{schema}, score double").withColumn("held_out", held).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
