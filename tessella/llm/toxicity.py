"""Toxic passages as maximal-scoring segments of token log-odds.

Every token scores its log-odds between toxic and clean labelled documents
under a Dirichlet prior, less one and a half standard errors and a
drift, so that clean text scores negative on average. A linear-time scan finds
all maximal-scoring segments; Karlin-Altschul statistics, calibrated on clean
documents, tell which are significant for the length of the document, and the
summed significance is mapped to a probability.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import staged

#: Bound of the labelled sample that the classifier is fitted on.
SAMPLE_ROWS = 20_000
BUCKETS = 1 << 18
PRIOR = 4.0
CAUTION = 1.5
#: What every token pays; the fit takes the one under which labels are likeliest.
DRIFTS = (0.5, 1.0, 2.0, 3.0)
GRID = 0.05
STEPS = 400
CACHED_WORDS = 200_000
MARKS = ".,;:!?\"'()[]{}<>*&%$#@~^_=+-/\\|`«»“”‘’…"


def bucket(unit: str) -> int:
    """Hash bucket of a unit."""
    return crc32(unit.encode("utf-8", "surrogatepass")) & (BUCKETS - 1)


def units(token: str) -> set[int]:
    """Buckets of a token (marks at its ends dropped) and of its stems of five and four letters."""
    word = token.strip(MARKS)
    return {bucket("w:" + word), bucket("5:" + word[:5]), bucket("4:" + word[:4])} if word else set()


@dataclass(frozen=True)
class Model:
    """Unit scores and z values, drift, Karlin-Altschul lambda and log K, logistic intercept and slope."""

    value: np.ndarray
    weight: np.ndarray
    drift: float
    decay: float
    log_k: float
    intercept: float
    slope: float


def log_odds(toxic: np.ndarray, clean: np.ndarray, prior: float = PRIOR) -> tuple[np.ndarray, np.ndarray]:
    """Scores (log-odds moved ``CAUTION`` standard errors towards 0) and z values of all units.

    ``toxic`` and ``clean`` count the documents that hold each unit. Each class
    has a Dirichlet prior of ``prior`` pseudo-counts per unit, shared between
    the classes as their sizes are.
    """
    sizes = np.array([toxic.sum(), clean.sum()]) + 1.0
    parts, spread = [], 0.0
    for own, size in zip((toxic, clean), sizes):
        alpha = prior * size / sizes.sum()
        total = own.sum() + alpha * len(own)
        parts.append(np.log((own + alpha) / (total - own - alpha)))
        spread = spread + 1 / (own + alpha)
    odds = parts[0] - parts[1]
    error = np.sqrt(spread)
    return np.sign(odds) * np.maximum(np.abs(odds) - CAUTION * error, 0.0), odds / error


class TokenScores:
    """Scores of tokens, through bounded caches of tokens and stems.

    A token takes the score of its unit with the largest z value.
    """

    def __init__(self, value: np.ndarray, weight: np.ndarray):
        self.value, self.weight = value.tolist(), np.abs(weight).tolist()
        self.known: dict[str, float] = {}
        self.stems: dict[str, tuple[float, float]] = {}

    def stem(self, word: str) -> tuple[float, float]:
        got = self.stems.get(word)
        if got is None:
            if len(self.stems) > CACHED_WORDS:
                self.stems.clear()
            both = [bucket("5:" + word), bucket("4:" + word[:4])]
            got = self.stems[word] = max((self.weight[u], self.value[u]) for u in both)
        return got

    def of(self, text: str) -> np.ndarray:
        words = text.lower().split()
        known = self.known
        if len(known) > CACHED_WORDS:
            known.clear()
        for w in {w for w in words if w not in known}:
            word = w.strip(MARKS)
            if word:
                own = bucket("w:" + word)
                known[w] = max((self.weight[own], self.value[own]), self.stem(word[:5]))[1]
            else:
                known[w] = 0.0
        return np.fromiter(map(known.__getitem__, words), float, len(words))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score), in one pass.

    A list of candidates is kept with the sums before (left) and after (right)
    each; a new one joins the nearest earlier candidate with a smaller left sum
    while that has a smaller right sum.
    """
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    found: list[list] = []
    for i in np.flatnonzero(scores > 0).tolist():
        start, left, right = i, sums[i], sums[i + 1]
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= left:
                j = found[j][4]
            if j < 0 or found[j][3] >= right:
                found.append([start, i + 1, left, right, j])
                break
            start, left = found[j][0], found[j][2]
            up = found[j][4]
            del found[j:]
            j = up
    return [(s, e, r - l) for s, e, l, r, _ in found]


def karlin_decay(counts: np.ndarray) -> float:
    """Lambda: the positive root of E[exp(lambda * score)] = 1 over a score histogram.

    ``counts`` covers the grid of scores -STEPS..STEPS times GRID. Without
    positive scores, or with a mean that is not negative, lambda is 1.
    """
    held = counts > 0
    scores = (np.arange(-STEPS, STEPS + 1) * GRID)[held]
    p = counts[held] / max(counts.sum(), 1)
    if not (p[scores > 0].sum() > 0 and (p * scores).sum() < 0):
        return 1.0
    low, high = 1e-6, 1.0
    while (p * np.exp(high * scores)).sum() < 1 and high < 50:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(mid * scores)).sum() < 1 else (low, mid)
    return low


def evidence(found: list[tuple[int, int, float]], n: int, decay: float, log_k: float) -> tuple[float, list[tuple[int, int, float]]]:
    """Summed significance of the segments in nats, and those that are significant.

    A segment of normalised score s = lambda * S - log(K n) has the expected
    number exp(-s) of equals by chance; it counts s + 2 where that exceeds 0.
    """
    base = log_k + math.log(max(n, 1))
    good = [(a, b, decay * s - base) for a, b, s in found if decay * s - base > -2]
    return sum(s + 2 for _, _, s in good), good


def logistic(x: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> tuple[float, float, float]:
    """Intercept and slope fitted to counts by label at each x, slightly ridged, and the log-likelihood."""
    w = np.zeros(2)
    design = np.stack([np.ones_like(x), x], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        n = toxic + clean + 1e-9
        gradient = design.T @ (toxic - n * p) - np.array([0.01, 0.1]) * w
        hessian = design.T @ (design * (n * p * (1 - p))[:, None]) + np.diag([0.01, 0.1])
        step = np.linalg.solve(hessian, gradient)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    w[1] = max(w[1], 0.0)
    logit = np.clip(design @ w, -30, 30)
    return float(w[0]), float(w[1]), float((toxic * -np.log1p(np.exp(-logit)) + clean * -np.log1p(np.exp(logit))).sum())


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Fit on a bounded sample of labelled rows.

    ``labels`` (doc_id, toxic) may repeat a doc_id; any 1 wins. At most ``rows``
    of them, in the order of a hash, are taken, so the broadcast sample and the
    driver's unit counts (``BUCKETS`` numbers) have a bound. Without labels of
    both kinds every document scores the base rate.
    """
    spark = docs.sparkSession
    sample = (
        labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    marked = docs.select("doc_id", "text").join(F.broadcast(staged(sample, "toxic-sample")), "doc_id")
    # One text of each id, so repeated ids do not pass the bound of the sample.
    owned = staged(marked.groupBy("doc_id").agg(F.max("text").alias("text"), F.first("toxic").alias("toxic")).select("text", "toxic"), "toxic-texts")

    def count(batches):
        both = np.zeros((2, BUCKETS), np.int64)
        known: dict[str, tuple] = {}
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if len(known) > CACHED_WORDS:
                    known.clear()
                own = set()
                for w in set((text or "").lower().split()):
                    if w not in known:
                        known[w] = units(w)
                    own.update(known[w])
                both[int(label), list(own)] += 1
        at = np.flatnonzero(both.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(both[1, at]), pa.array(both[0, at])], ["unit", "toxic", "clean"])

    counted = owned.mapInArrow(count, "unit long, toxic long, clean long").groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).toPandas()
    toxic, clean = np.zeros(BUCKETS), np.zeros(BUCKETS)
    toxic[counted["unit"]], clean[counted["unit"]] = counted["toxic"], counted["clean"]
    value, weight = log_odds(toxic, clean)
    if not toxic.sum() or not clean.sum():
        value = np.zeros(BUCKETS)
    value, weight = value.astype(np.float32), weight.astype(np.float32)
    shared = spark.sparkContext.broadcast((value, weight))

    def scan(batches):
        look = TokenScores(*shared.value)
        for batch in batches:
            out = []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = look.of(text or "")
                for d, drift in enumerate(DRIFTS):
                    s = raw - drift
                    cells = np.clip(np.rint(s / GRID), -STEPS, STEPS).astype(int) + STEPS
                    at, n = np.unique(cells, return_counts=True)
                    out.append((d, int(label), len(s), [x for _, _, x in segments(s)], at.tolist(), n.tolist()))
            columns = list(zip(*out)) or [[]] * 6
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["drift", "toxic", "n", "scores", "cells", "counts"])

    scanned = staged(owned.mapInArrow(scan, "drift int, toxic int, n long, scores array<double>, cells array<long>, counts array<long>"), "toxic-scan")
    grid = (
        scanned.where("toxic = 0")
        .select("drift", F.explode(F.arrays_zip("cells", "counts")).alias("c"))
        .groupBy("drift", F.col("c.cells").alias("cell"))
        .agg(F.sum("c.counts").alias("n"))
        .toPandas()
    )
    decays = []
    for d in range(len(DRIFTS)):
        histogram, own = np.zeros(2 * STEPS + 1), grid[grid["drift"] == d]
        histogram[own["cell"].to_numpy(int)] = own["n"]
        decays.append(karlin_decay(histogram))
    # K n exp(-lambda M) is exponential with mean 1 over clean documents of n tokens and best segment M.
    decay = F.element_at(F.array(*[F.lit(x) for x in decays]), F.col("drift") + 1)
    mass = F.sum(F.col("n") * F.exp(-decay * F.coalesce(F.array_max("scores"), F.lit(0.0))))
    facts = {r["drift"]: r for r in scanned.where("toxic = 0 AND n > 0").groupBy("drift").agg(F.count(F.lit(1)).alias("docs"), mass.alias("mass")).collect()}
    logs = [math.log(facts[d]["docs"] / facts[d]["mass"]) if d in facts else 0.0 for d in range(len(DRIFTS))]
    base = F.element_at(F.array(*[F.lit(x) for x in logs]), F.col("drift") + 1) + F.log(F.greatest("n", F.lit(1)))
    summed = F.aggregate(F.transform("scores", lambda s: s * decay - base + 2), F.lit(0.0), lambda a, s: a + F.greatest(F.lit(0.0), s))
    cells = scanned.groupBy("drift", F.least(F.rint(summed * 4), F.lit(400.0)).alias("x")).agg(F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("all")).toPandas()
    best = None
    for d, drift in enumerate(DRIFTS):
        own = cells[cells["drift"] == d]
        toxic_at = own["toxic"].to_numpy(float)
        intercept, slope, likelihood = logistic(own["x"].to_numpy(float) / 4, toxic_at, own["all"].to_numpy(float) - toxic_at)
        if best is None or likelihood > best[0]:
            best = (likelihood, Model(value, weight, drift, decays[d], logs[d], intercept, slope))
    return best[1]


def probability(text: str, look: TokenScores, m: Model) -> tuple[float, list[tuple[int, int, float]]]:
    """Probability that a text is toxic and its significant passages."""
    s = look.of(text) - m.drift
    total, good = evidence(segments(s), len(s), m.decay, m.log_k)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, m.intercept + m.slope * min(total, 100.0))))), good


def toxic_passages(docs: DataFrame, model: Model) -> DataFrame:
    """Add ``score`` (0 to 1), ``predicted`` and ``passages`` to every row.

    ``passages``: start and end token and significance (nats) of each
    significant segment. Null and empty texts have none and score the base
    rate; repeated rows score alike; texts are read whole. Only doc_id and text
    are read; doc_id is not part of the score.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        look = TokenScores(m.value, m.weight)
        for batch in batches:
            scores, passages = [], []
            for text in batch.column(1).to_pylist():
                score, good = probability(text or "", look, m)
                scores.append(score)
                passages.append([{"start": a, "end": b, "significance": e} for a, b, e in good])
            passage = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("significance", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(passages, passage)], ["doc_id", "score", "passages"])

    schema = f"doc_id {kind}, score double, passages array<struct<start: long, end: long, significance: double>>"
    return docs.select("doc_id", "text").mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def held_out(doc_id):
    """Whether a document is kept from training: crc32 of its id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """Rows of ``docs`` (all columns) that the model does not predict toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        look = TokenScores(m.value, m.weight)
        for batch in batches:
            kept = [probability(text or "", look, m)[0] < 0.5 for text in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
