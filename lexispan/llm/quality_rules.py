"""Quality rules whose cutoffs are chosen under a controlled risk of false rejection.

A rule is a whole-number signal of a text and a list of cutoffs from lenient to
strict. Labelled texts are parted by a checksum of their ids. In each stratum one part
proposes: for every rule the cutoff that parts bad from good best, and the order of the
rules by the bad texts that those before them miss. That makes a path of nested sets of
rejected texts, each step one cutoff stricter. The other part, the holdout, tests the
steps in order: the exact binomial tail says whether so few good texts would be
rejected if the true share were above the limit. Steps in a fixed order need no
correction among themselves as testing ends at the first failure; over the strata the
error is divided (Bonferroni). So with probability 1 - error no stratum loses more
than the limit of its good texts. A stratum with too few labels to prove anything
rejects nothing.
"""

from __future__ import annotations

from math import exp, fsum, lgamma, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispan.llm.common import released, ship, written
from lexispan.llm.tokens import flat, slices
from lexispan.llm.words import interned

#: Per thousand, from lenient to strict: each a quarter or so stricter than the one before.
_SHARES = (900, 720, 580, 460, 370, 290, 230, 190, 150, 120, 95, 75)
#: Signal of each rule, and its cutoffs; a text is rejected from a cutoff on, or by ``short_words`` down to one.
RULES = {
    "symbols": tuple(2 * c for c in _SHARES),
    "repeats": _SHARES,
    "same_lines": _SHARES,
    "capitals": _SHARES,
    "marks": tuple(2 * c for c in _SHARES),
    "long_words": (24000, 19000, 15000, 12500, 10500, 9500, 8800, 8200, 7700, 7300, 7000, 6700),
    "short_words": (1200, 1600, 2000, 2300, 2600, 2900, 3100, 3300, 3500, 3650, 3800, 3950),
}
STEPS = len(_SHARES)

_SPACE, _SYMBOL, _CAPITAL, _MARK = (np.zeros(256, bool) for _ in range(4))
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_CAPITAL[65:91] = True
_MARK[[33, 63]] = True

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marks")


def repeated_windows(ids: np.ndarray, width: int = 3) -> int:
    """Number of words in windows of so many words that the text has twice or more."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    key = ids
    for k in range(1, width):
        key = np.unique(key[:n] * (int(ids.max()) + 1) + ids[k : k + n], return_inverse=True)[1]
    twice = np.bincount(key)[key] > 1
    held = np.zeros(len(ids), bool)
    for k in range(width):
        held[k : k + n] |= twice
    return int(held.sum())


def counts(docs: DataFrame, stratum: Column) -> DataFrame:
    """(doc_id, stratum, and the COUNTS as long) of each row's whole text; null: a text without words."""
    ship(docs.sparkSession)

    def counted(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                data, at = flat(part.column("text"))
                body = data.tobytes()
                upto = lambda mask: np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
                of = lambda mask: (s := upto(mask))[at[1:]] - s[at[:-1]]
                letters, symbols, capitals, marks = (of(m) for m in (((data & 0xC0) != 0x80) & ~_SPACE[data], _SYMBOL[data], _CAPITAL[data], _MARK[data]))
                words, repeats, lines, same = (np.zeros(len(part), np.int64) for _ in range(4))
                for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                    text = body[a:b]
                    ids = interned(text)[1]
                    words[i], repeats[i] = len(ids), repeated_windows(ids)
                    own = [x for x in text.split(b"\n") if x.strip()]
                    lines[i], same[i] = len(own), len(own) - len(set(own))
                columns = (words, letters, symbols, same, repeats, lines, capitals, marks)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("stratum"), *map(pa.array, columns)], ["doc_id", "stratum", *COUNTS])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), stratum.cast("string").alias("stratum"), "text")
    return rows.mapInArrow(released(counted), "doc_id long, stratum string, " + ", ".join(f"{c} long" for c in COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def steps() -> dict[str, Column]:
    """For each rule the number of its first cutoff that rejects the text; STEPS if none does."""
    share = lambda part, whole: F.expr(f"1000 * {part} div greatest({whole}, 1)")
    signal = {
        "symbols": share("n_symbols", "n_words"), "repeats": share("n_repeat_words", "n_words"), "same_lines": share("n_dup_lines", "n_lines"),
        "capitals": share("n_capitals", "word_chars"), "marks": share("n_marks", "n_words"), "long_words": share("word_chars", "n_words"), "short_words": share("word_chars", "n_words"),
    }
    spared = lambda rule: (lambda c: signal[rule] > c) if rule == "short_words" else (lambda c: signal[rule] < c)
    return {rule: F.size(F.filter(F.array(*map(F.lit, cutoffs)), spared(rule))) for rule, cutoffs in RULES.items()}


def tail(n: int, few: int, share: float) -> float:
    """Probability of at most ``few`` of n, each with probability ``share``: the exact binomial tail."""
    if few >= n:
        return 1.0
    term = lambda i: lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(share) + (n - i) * log1p(-share)
    return min(1.0, fsum(exp(term(i)) for i in range(few + 1)))


def proposed(tuning: DataFrame, limit: float, broadcast_rows: int = 50_000) -> DataFrame:
    """(stratum, rule, nth, cutoff): per stratum the rules worth having, in order, each with its strictest cutoff to test.

    ``tuning`` has a row per labelled text: stratum, good, and a step per rule. A rule's cutoff is that which finds the most
    bad texts less the good ones that it rejects, of those rejecting at most limit / rules of the good; of equal
    ones the middle. Rules are taken by the bad less the good texts that those before them leave,
    then by name, as long as there are more bad ones.
    """
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("step")) for r in RULES])).alias("x")
    cells = tuning.select("stratum", "good", rules).groupBy("stratum", "x.rule", "x.step").agg(F.sum(F.col("good").cast("long")).alias("good"), F.sum((~F.col("good")).cast("long")).alias("bad"))
    # STEPS + 1 cells a rule and stratum at most: their running sums are made as arrays of one row
    per = cells.groupBy("stratum", "rule").agg(F.collect_list(F.struct("step", "good", "bad")).alias("cells"), F.sum("good").alias("all_good"))
    upto = lambda k, what: F.aggregate("cells", F.lit(0).cast("long"), lambda s, c: s + F.when(c["step"] <= k, c[what]).otherwise(0))
    borne = F.filter(F.sequence(F.lit(0), F.lit(STEPS - 1)), lambda k: upto(k, "good") * len(RULES) <= F.col("all_good") * limit)
    gain = F.transform(borne, lambda k: F.struct((upto(k, "bad") - upto(k, "good")).alias("gain"), k.alias("k")))
    per = per.select("stratum", "rule", gain.alias("gains")).withColumn("most", F.array_max("gains")["gain"]).where("most > 0")
    best = F.filter("gains", lambda g: g["gain"] == F.col("most"))
    per = per.select("stratum", "rule", F.element_at(best, ((F.size(best) + 1) / 2).cast("int"))["k"].alias("cutoff"))
    cutoffs = per.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs"))
    met = _by_stratum(tuning, cutoffs, broadcast_rows, "inner")
    # texts by the rules that reject them: at most twice as many cells a stratum as there are sets of rules
    sets = met.groupBy("stratum", "cutoffs", "good", _rejecting().alias("by")).agg(F.count("*").alias("n"))

    @F.udf("array<string>")
    def order(sets):
        """The rules in the order in which they are worth having."""
        left, out = [(set(s.by), s.n if not s.good else -s.n) for s in sets], []
        while left:
            gain = {r: sum(n for by, n in left if r in by) for r in RULES}
            rule = min(gain, key=lambda r: (-gain[r], r))
            if gain[rule] <= 0:
                break
            out.append(rule)
            left = [(by, n) for by, n in left if rule not in by]
        return out

    paths = sets.groupBy("stratum").agg(F.first("cutoffs").alias("cutoffs"), order(F.collect_list(F.struct("good", "by", "n"))).alias("rules"))
    return paths.select("stratum", "cutoffs", F.posexplode("rules").alias("nth", "rule")).select("stratum", "rule", "nth", F.col("cutoffs")[F.col("rule")].alias("cutoff"))


def _rejecting() -> Column:
    """Names of the rules that reject a text by its stratum's ``cutoffs``."""
    return F.array_compact(F.array(*[F.when(F.col(r) <= F.col("cutoffs")[r], F.lit(r)) for r in RULES]))


def _by_stratum(rows: DataFrame, facts: DataFrame, broadcast_rows: int, how: str = "left") -> DataFrame:
    """The rows with the facts of their stratum, which are broadcast only if counted to be few."""
    few = facts.limit(broadcast_rows + 1).count() <= broadcast_rows
    facts = facts.withColumnRenamed("stratum", "_stratum")
    return rows.join(F.broadcast(facts) if few else facts, rows.stratum.eqNullSafe(F.col("_stratum")), how).drop("_stratum")


def controlled(holdout: DataFrame, paths: DataFrame, limit: float, error: float, broadcast_rows: int = 50_000) -> DataFrame:
    """(stratum, cutoffs): the cutoffs, a map of rules, of the last step that the holdout passes in each stratum.

    ``holdout`` has a row per good labelled text: stratum and a step per rule. Its rows are counted by the step of
    the path that first rejects them, so what is tested is at most rules * STEPS + 1 rows of a stratum.
    """
    path = paths.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", F.struct("nth", "cutoff")))).alias("path"))
    met = _by_stratum(holdout, path, broadcast_rows)
    turn = lambda r: F.when(F.col(r) <= F.col("path")[r]["cutoff"], F.col("path")[r]["nth"] * STEPS + F.col(r))  # noqa: E731  null: never rejected
    hist = met.where("path IS NOT NULL").groupBy("stratum", F.least(*map(turn, RULES)).alias("turn")).agg(F.count("*").alias("n"))
    strata = max(1, paths.select("stratum").distinct().count())
    seen = hist.groupBy("stratum").agg(F.collect_list(F.struct("turn", "n")).alias("turns"))

    @F.udf("long")
    def passed(turns, steps):
        """Number of steps that pass, in order."""
        total, lost, at = sum(t.n for t in turns), 0, {t.turn: t.n for t in turns}
        for k, step in enumerate(steps):
            lost += at.get(step, 0)
            if tail(total, lost, limit) > error / strata:
                return k
        return len(steps)

    ordered = F.sort_array(F.collect_list(F.struct("nth", "rule", "cutoff")))
    sequence = F.flatten(F.transform("path", lambda r: F.sequence(r["nth"] * STEPS, r["nth"] * STEPS + r["cutoff"])))
    tested = _by_stratum(paths.groupBy("stratum").agg(ordered.alias("path")), seen, broadcast_rows, "inner")
    last = tested.withColumn("steps", sequence).withColumn("last", F.element_at(F.expr("concat(array(-1), steps)"), (passed("turns", "steps") + 1).cast("int")))
    # of the rules up to the last step that passes: whole cutoffs, and of that step's own rule as far as it went
    held = F.filter("path", lambda r: r["nth"] * STEPS <= F.col("last"))
    return last.select("stratum", F.map_from_entries(F.transform(held, lambda r: F.struct(r["rule"], F.least(r["cutoff"], F.col("last") - r["nth"] * STEPS)))).alias("cutoffs"))


def judge(docs: DataFrame, labels: DataFrame, stratum: Column, limit: float = 0.05, error: float = 0.05, broadcast_rows: int = 50_000) -> DataFrame:
    """(doc_id, stratum, the COUNTS, base_failed, rejected_by, kept) of each row.

    ``rejected_by`` names the rules that reject the text. Null texts have no words and so fail
    the base rules; a null stratum is one of its own; repeated rows are judged each; a
    label of a repeated or null id counts for none or each of its rows; without labels of both classes no rule
    rejects. Other columns are not read. Labels with crc32(id as text) mod 3 of 0 propose, those with 2 are
    the holdout, and those with 1 are never used.
    """
    rows = written(counts(docs, stratum).withColumn("base_failed", base_failed()).withColumns(steps()), "counts")
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality") == 1).alias("good"))
    labelled = rows.where("NOT base_failed").join(known, "doc_id").withColumn("part", F.crc32(F.col("doc_id").cast("string")) % 3).where("part <> 1")
    labelled = written(labelled.select("stratum", "part", "good", *RULES), "labelled")
    paths = written(proposed(labelled.where("part = 0"), limit, broadcast_rows), "paths")
    cutoffs = written(controlled(labelled.where("part = 2 AND good"), paths, limit, error, broadcast_rows), "cutoffs")
    met = _by_stratum(rows, cutoffs, broadcast_rows)
    met = met.withColumn("rejected_by", _rejecting())
    return met.select("doc_id", "stratum", *COUNTS, "base_failed", "rejected_by", (~F.col("base_failed") & (F.size("rejected_by") == 0)).alias("kept"))
