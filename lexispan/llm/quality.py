"""Quality by hierarchical empirical Bayes.

A logistic model of a text's form and of its words gives each document's evidence;
what a word says is its log odds in labelled texts, learnt on other texts than the
model's weights are. Hosts and paths
are groups whose share of good documents is drawn from a Beta prior: the global
mean for hosts, the host's posterior for paths. Grouped sums give the groups'
shares and, by moments, how strongly the priors hold, so sites with few documents
shrink toward them. The path's posterior without the document's own part is the
prior that its evidence then shifts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispan.llm.common import released, ship, written
from lexispan.llm.tokens import flat, slices
from lexispan.llm.toxicity import logistic

_KIND = np.zeros(256, np.uint8)  # 1 letter, 2 capital, 3 digit, 4 mark, 5 white space
_KIND[[*range(97, 123), *range(128, 256)]] = 1
_KIND[65:91], _KIND[48:58] = 2, 3
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 4
_KIND[[9, 10, 11, 12, 13, 32]] = 5


def word_odds(texts: list[bytes], good: np.ndarray, least: int = 4) -> dict[bytes, float]:
    """Log odds of good for the words, lower-cased, that stand in at least ``least`` texts: by the texts of each class that hold them, smoothed by a half."""
    held: dict[bytes, list[int]] = {}
    for b, y in zip(texts, good.astype(int).tolist(), strict=True):
        for w in set(b.lower().split()):
            held.setdefault(w, [0, 0])[y] += 1
    n = np.bincount(good.astype(int), minlength=2) + 1
    return {w: float(np.log((k[1] + 0.5) / n[1]) - np.log((k[0] + 0.5) / n[0])) for w, k in held.items() if sum(k) >= least}


def features(data: np.ndarray, at: np.ndarray, odds: dict[bytes, float]) -> np.ndarray:
    """Of each text: length, word length, shares of capitals, digits, marks and line ends, distinct words, words that repeat the one before; mean of its words' log odds, and share of words that have any."""
    body, out = data.tobytes(), np.zeros((len(at) - 1, 11))
    for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        n = np.bincount(_KIND[data[a:b]], minlength=6)
        words, own = body[a:b].split(), max(1, b - a)
        w = max(1, len(words))
        letters = max(1, n[1] + n[2])
        again = sum(x == y for x, y in zip(words, words[1:]))  # noqa: B905  one is shorter
        told = [o for o in map(odds.get, body[a:b].lower().split()) if o is not None]
        out[i] = (np.log1p(len(words)), own / w, n[2] / letters, n[3] / own, n[4] / own, n[4] / w, np.log1p(len(set(words))) - np.log1p(len(words)), again / w, body.count(b"\n", a, b) / w, sum(told) / w, len(told) / w)
    return out


def fit(docs: DataFrame, labels: DataFrame, each: int = 6000) -> dict:
    """Words' odds from every second, and logistic weights from the others, of at most ``each`` labelled texts of the smallest hashed ids, whose crc32(id) mod 3 is not 1; of one class or none: no evidence."""
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    chosen = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64(F.lit(5), "doc_id")).limit(each)
    # one text for each id, so that what the driver gets is bounded by the ids
    rows = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (r.doc_id, r.text))
    y = np.array([r.quality for r in rows], float)
    if len(set(y.tolist())) < 2:
        return {"weights": None, "prior": float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5}
    texts = [r.text.encode() for r in rows]
    half = np.arange(len(y)) % 2 == 0
    if len(set(y[half])) < 2 or len(set(y[~half])) < 2:  # too few to part
        odds, half = {}, np.zeros(len(y), bool)
    else:
        odds = word_odds([t for t, h in zip(texts, half, strict=True) if h], y[half])
    y = y[~half]
    data, at = flat(pa.array([r.text for r, h in zip(rows, half, strict=True) if not h]))
    x = features(data, at, odds)
    mean, spread = x.mean(0), x.std(0) + 1e-9
    z = np.clip((x - mean) / spread, -8, 8)
    return {"odds": odds, "mean": mean, "spread": spread, "weights": logistic(np.hstack((z, z * z)), y, ridge=1.0), "prior": float(np.clip(y.mean(), 0.01, 0.99))}


def evidence(docs: DataFrame, model: dict) -> DataFrame:
    """Documents (doc_id, host, path) with p, the classifier's probability of good; null and empty texts are scored as such."""
    ship(docs.sparkSession)

    def scored(batches):
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                data, at = flat(part.column("text"))
                if model["weights"] is None:
                    p = np.full(len(part), model["prior"])
                else:
                    z = np.clip((features(data, at, model["odds"]) - model["mean"]) / model["spread"], -8, 8)
                    p = 1 / (1 + np.exp(-np.clip(np.hstack((z, z * z)) @ model["weights"][:-1] + model["weights"][-1], -12, 12)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "host", "path")), pa.array(p)], ["doc_id", "host", "path", "p"])

    return docs.select("doc_id", "host", "path", "text").mapInArrow(released(scored), "doc_id long, host string, path string, p double")


def prior_weight(spread: float, groups: int, drawn: float, total: float, most: float = 1000.0) -> float:
    """Documents that a Beta prior counts as, by moments.

    With g groups of n documents, shares s around a mean m and drawn = m (1 - m), the sum
    of n (s - m)^2 has the expectation (g - 1) drawn (1 + (average n - 1) / (weight + 1)).
    """
    over = spread / max(groups - 1, 1) / max(drawn, 1e-6) - 1
    return min(max((total / groups - 1) / over - 1, 1.0), most) if groups > 1 and over > 0 else most


def posteriors(rows: DataFrame) -> tuple[DataFrame, float, float, float]:
    """(host, path, n, good, host_n, host_good) with the sums of p, and three numbers: the global mean and the weights of the priors of hosts and paths."""
    path = written(rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("good")), "paths")
    host = written(path.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good")), "hosts")
    total, good, groups = host.agg(F.sum("host_n"), F.sum("host_good"), F.count("*")).first()
    if not total:
        return path.withColumns({"host_n": F.col("n"), "host_good": F.col("good")}), 0.5, 1.0, 1.0
    mean, share = good / total, F.col("host_good") / F.col("host_n")
    spread = host.agg(F.sum(F.col("host_n") * (share - mean) * (share - mean))).first()[0]
    joined = path.join(host, path.host.eqNullSafe(host.host)).drop(host.host)
    d = F.col("good") / F.col("n") - share
    low = joined.agg(F.sum(F.col("n") * d * d), F.count("*"), F.sum(F.col("n") * share * (1 - share)) / F.sum("n")).first()
    return joined, mean, prior_weight(spread, groups, mean * (1 - mean), total), prior_weight(low[0], low[1], low[2], total)


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, each: int = 6000, threshold: float = 0.5) -> DataFrame:
    """(doc_id, host, path, evidence, host_posterior, path_posterior, score, keep) of each row.

    Documents without host or path form groups of their own (null). Without labels
    of both classes the sites alone decide. Rows that share an id are rows of their
    site each. Other columns are not read. The global mean and the priors' weights are
    all that the driver sees of the sites, whose tables are joined by key.
    """
    model = fit(docs, labels, each)
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), host.cast("string").alias("host"), path.cast("string").alias("path"), "text")
    rows = written(evidence(named, model), "evidence")
    sites, mean, host_weight, path_weight = posteriors(rows)
    sites = sites.withColumnsRenamed({"host": "_host", "path": "_path"})
    met = rows.join(sites, rows.host.eqNullSafe(sites._host) & rows.path.eqNullSafe(sites._path))
    own = lambda total, part: F.greatest(F.col(total) - F.col(part), F.lit(0.0))  # noqa: E731  the others of the group
    met = met.withColumn("host_posterior", (own("host_good", "p") + host_weight * mean) / (F.col("host_n") - 1 + host_weight))
    met = met.withColumn("path_posterior", (own("good", "p") + path_weight * F.col("host_posterior")) / (F.col("n") - 1 + path_weight))
    logit = lambda c: F.log(c / (1 - c))
    inside = lambda c: F.least(F.greatest(c, F.lit(1e-4)), F.lit(1 - 1e-4))
    met = met.withColumn("evidence", logit(inside(F.col("p"))) - F.lit(float(np.log(model["prior"] / (1 - model["prior"])))))
    met = met.withColumn("score", 1 / (1 + F.exp(-(logit(inside(F.col("path_posterior"))) + F.col("evidence")))))
    return met.select("doc_id", "host", "path", "evidence", "host_posterior", "path_posterior", "score", (F.col("score") >= threshold).alias("keep"))
