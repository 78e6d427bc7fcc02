"""Quality classifier by positive-unlabelled learning.

Texts become some thirty numbers on their signs, words and lines, in one pass over whole texts.
Documents labelled 1 in the learning folds are the trusted positives; all texts of those folds
together, labels unseen, are the unlabelled web text. Label 0 is never read. The class prior is estimated from those two
kinds of rows: networks that tell positives from unlabelled rows score the thirds they weren't fitted on,
and the prior is the least share of unlabelled over the share of positives above one score, where that
is surest (best-bin estimation, Garg et al., 2021), less the sampling error. A second network minimises the non-negative unbiased risk (Kiryo et al., 2017): prior * E_p[l(f)] + max(0, E_u[l(-f)] - prior * E_p[l(-f)]), logistic loss.

The fit uses at most ``positives`` and ``unlabelled`` rows, the first by a hash of doc_id, so that a
model's size and time don't grow with the corpus; every text is scored.

Defined results: null and empty texts are scored as empty ones; rows that repeat a document get equal
scores; a doc_id labelled both ways counts as unlabelled; rows without a doc_id are left out; without
a positive in the learning folds every score is the prior of 0.5; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, stored
from .kernels import Slab, grams, lean, slabs, word_bounds, word_hashes

#: Groups of ASCII signs whose shares are features.
GROUPS = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "stop": b".,;:", "shout": b"!?", "odd": b"#$%&*+=@^~\\", "bar": b"|/_", "bracket": b"()[]{}<>", "quote": b"\"'`-", "space": b" \t", "line": b"\n\r\v\f"}
N_FEATURES = 2 * len(GROUPS) + 12


def features(s: Slab) -> np.ndarray:
    """A row of numbers for each document of a slab."""
    n = np.diff(s.bounds)
    docs = len(n)
    doc_of = np.repeat(np.arange(docs), n)
    cols: list[np.ndarray] = []
    size = np.maximum(n, 1)
    kind = np.full(256, len(GROUPS), np.int64)
    for i, signs in enumerate(GROUPS.values()):
        kind[list(signs)] = i
    shares = np.bincount(doc_of * (len(GROUPS) + 1) + kind[s.data], minlength=docs * (len(GROUPS) + 1)).reshape(docs, -1) / size[:, None]
    cols += [shares[:, i] for i in range(len(GROUPS))]
    cols += [np.sqrt(shares[:, i]) for i in range(len(GROUPS))]
    starts, ends, first = word_bounds(s.data, s.bounds)
    words = np.diff(first)
    some = np.maximum(words, 1)
    word_doc = np.repeat(np.arange(docs), words)
    h = word_hashes(s.data, starts, ends)
    cols += [np.log1p(n), np.log1p(words), n / some]

    def share(flags: np.ndarray, docs_of: np.ndarray) -> np.ndarray:
        return np.bincount(docs_of[flags], minlength=docs) / some

    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (word_doc[1:] == word_doc[:-1])
    cols.append(share(same, word_doc))
    for k in (1, 3, 8):
        g = grams(h, k)
        of = word_doc[: len(g)]
        ok = np.flatnonzero(np.arange(len(g)) + k <= first[1:][of]) if len(g) else np.zeros(0, np.int64)
        order = np.lexsort((g[ok], of[ok]))
        g, of = g[ok][order], of[ok][order]
        again = np.zeros(len(g), bool)
        again[1:] = (g[1:] == g[:-1]) & (of[1:] == of[:-1])
        cols.append(share(again, of))
    letter = ((s.data | 0x20) >= 0x61) & ((s.data | 0x20) <= 0x7A) | (s.data >= 0x80)
    upper = (s.data >= 0x41) & (s.data <= 0x5A)
    tail = ~letter[ends - 1] if len(ends) else np.zeros(0, bool)
    two = tail & (ends - starts > 1)
    two[two] = ~letter[ends[two] - 2]
    cols += [share(tail, word_doc), share(two, word_doc)]
    cols.append(share(upper[starts] if len(starts) else tail, word_doc))
    length = ends - starts
    cols += [share(length >= 14, word_doc), np.sqrt(np.maximum(np.bincount(word_doc, weights=length.astype(float) ** 2, minlength=docs) / some - (np.bincount(word_doc, weights=length.astype(float), minlength=docs) / some) ** 2, 0))]
    return np.stack(cols, 1).astype(np.float32)


def feature_rows(docs: DataFrame) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("features", pa.binary())])

    def work(batches):
        for b in batches:
            for s in slabs(b.column("doc_id").to_numpy(), b.column("text")):
                yield pa.RecordBatch.from_arrays([pa.array(s.ids), pa.array([x.tobytes() for x in features(s)], pa.binary())], schema=schema)

    return documents(docs).mapInArrow(lean(work), "doc_id long, features binary")


class PuModel:
    """One hidden layer, fitted by Adam on mini-batches of positives and unlabelled rows."""

    def __init__(self, hidden: int = 24, seed: int = 17):
        self.hidden, self.seed = hidden, seed
        self.prior, self.parts = 0.5, None

    def fit(self, positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None, steps: int = 1000, batch: int = 2048, rate: float = 0.01) -> PuModel:
        """Without a ``prior`` it is estimated first."""
        if not len(positive) or not len(unlabelled):
            return self
        both = np.concatenate([positive, unlabelled]).astype(np.float64)
        self.mean, self.std = both.mean(0), both.std(0) + 1e-6
        p, u = self._scaled(positive), self._scaled(unlabelled)
        if prior is None:
            prior = self._estimated(p, u, max(150, steps // 5), batch, rate)
        self.prior = float(np.clip(prior, 0.01, 0.99))
        start = np.log(self.prior / (1 - self.prior))
        self.parts = self._descend(p, u, start, lambda f, n: risk_slope(f, n, self.prior), steps, batch, rate)
        return self

    def _estimated(self, p: np.ndarray, u: np.ndarray, steps: int, batch: int, rate: float) -> float:
        if len(p) < 6 or len(u) < 6:
            return 0.5
        f_p, f_u = np.empty(len(p)), np.empty(len(u))
        mine, others = np.arange(len(p)) % 3, np.arange(len(u)) % 3
        for k in range(3):
            self.parts = self._descend(p[mine != k], u[others != k], 0.0, told_apart, steps, batch, rate)
            f_p[mine == k], f_u[others == k] = self._logits(p[mine == k]), self._logits(u[others == k])
        cuts = np.sort(f_p)
        q_p = 1 - np.arange(len(cuts)) / len(cuts)
        q_u = 1 - np.searchsorted(np.sort(f_u), cuts, "left") / len(f_u)
        doubt = 1.01 * (np.sqrt(np.log(40) / 2 / len(f_u)) + np.sqrt(np.log(40) / 2 / len(f_p)))
        best = int(np.argmin((q_u + doubt) / q_p))
        # the lower end of what the sample of unlabelled rows allows: a prior too high hides negatives
        return float(q_u[best] / q_p[best] - np.sqrt(np.log(40) / 2 / len(f_u)))

    def _descend(self, p: np.ndarray, u: np.ndarray, start: float, slope_of, steps: int, batch: int, rate: float) -> list[np.ndarray]:
        rng = np.random.default_rng(self.seed)
        d = p.shape[1]
        w = [rng.normal(0, d**-0.5, (d, self.hidden)), np.zeros(self.hidden), rng.normal(0, self.hidden**-0.5, self.hidden), np.array(float(start))]
        m, v = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
        for t in range(1, steps + 1):
            x = np.concatenate([p[rng.integers(0, len(p), batch)], u[rng.integers(0, len(u), batch)]])
            a = np.tanh(x @ w[0] + w[1])
            slope = slope_of(a @ w[2] + w[3], batch)
            back = np.outer(slope, w[2]) * (1 - a * a)
            grad = [x.T @ back + 1e-4 * w[0], back.sum(0), a.T @ slope + 1e-4 * w[2], slope.sum()]
            step = rate * min(1.0, 3 * (1 - t / (steps + 1)))
            for i, g in enumerate(grad):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                w[i] = w[i] - step * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        return w

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x.astype(np.float64) - self.mean) / self.std, -8, 8)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.parts is None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self._logits(self._scaled(x)), -30, 30)))

    def _logits(self, scaled: np.ndarray) -> np.ndarray:
        return np.tanh(scaled @ self.parts[0] + self.parts[1]) @ self.parts[2] + self.parts[3]


def risk(f: np.ndarray, n: int, prior: float) -> tuple[float, float]:
    """The positives' share of the risk and the estimate of the negatives', of logits of n positives and then unlabelled rows."""
    return prior * np.logaddexp(0, -f[:n]).mean(), np.logaddexp(0, f[n:]).mean() - prior * np.logaddexp(0, f[:n]).mean()


def risk_slope(f: np.ndarray, n: int, prior: float) -> np.ndarray:
    """Where to go down from: the slope of the whole risk, or, once the negatives' estimate has fallen
    under 0, the reverse of that estimate's."""
    up = 1 / (1 + np.exp(-np.clip(f, -30, 30)))  # the slope of l(-f); that of l(f) is up - 1
    if risk(f, n, prior)[1] >= 0:
        return np.concatenate([-prior * np.ones(n) / n, up[n:] / (len(f) - n)])
    return np.concatenate([prior * up[:n] / n, -up[n:] / (len(f) - n)])


def told_apart(f: np.ndarray, n: int) -> np.ndarray:
    """The slope of the logistic loss that tells n positives from the rows behind them, both kinds of equal weight."""
    up = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
    return np.concatenate([(up[:n] - 1) / n, up[n:] / (len(f) - n)])


def held_out(doc_id="doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def first_rows(rows: DataFrame, order, k: int) -> list:
    """The features of the first k rows by a 64-bit hash. A bound on the hash leaves little more than k
    rows before they are sorted, so what tasks send doesn't grow with their number."""
    n = rows.count()
    share = min(1.0, 1.2 * k / n + 50 / n) if n else 1.0
    some = rows if share == 1.0 else rows.where(order < F.lit(int(-(2**63) + share * (2**64 - 2))))
    got = some.orderBy(order, "doc_id").limit(k).select("features").collect()
    return got if len(got) >= min(k, n) else rows.orderBy(order, "doc_id").limit(k).select("features").collect()


def train(rows: DataFrame, labels: DataFrame, positives: int = 20_000, unlabelled: int = 40_000) -> PuModel:
    """Fits on at most so many rows of each kind. ``rows``: doc_id, features."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    marks = marks.groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("high")).where("low = high").select("doc_id", F.col("high").alias("quality"))
    order = F.xxhash64("doc_id", F.lit(11))
    rows = rows.where(~held_out())
    trusted = rows.join(marks.where("quality = 1"), "doc_id", "left_semi")
    taken = [first_rows(x, order, k) for x, k in ((trusted, positives), (rows, unlabelled))]
    p, u = (np.frombuffer(b"".join(bytes(r["features"]) for r in t), np.float32).reshape(-1, N_FEATURES) for t in taken)
    return PuModel().fit(p, u)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, positives: int = 20_000, unlabelled: int = 40_000) -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1, higher where label 1 is likelier), predicted."""
    rows = stored(feature_rows(docs), "features")
    model = train(rows, labels, positives, unlabelled)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def work(batches):
        for b in batches:
            if b.num_rows:
                x = np.frombuffer(b"".join(b.column("features").to_pylist()), np.float32).reshape(-1, N_FEATURES)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(x))], schema=schema)

    scored = rows.mapInArrow(lean(work), "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, positives: int = 20_000, unlabelled: int = 40_000) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject, every column as it was."""
    model = train(stored(feature_rows(docs), "features"), labels, positives, unlabelled)
    shape = docs.where(F.col("doc_id").isNotNull()).select(F.struct(*docs.columns).alias("row"))
    place = docs.columns.index("text")

    def work(batches):
        for b in batches:
            row = b.column("row")
            keep = np.zeros(len(row), bool)
            for s in slabs(np.arange(len(row)), row.field(place).cast(pa.string())):
                keep[s.first : s.first + len(s.ids)] = model.score(features(s)) >= threshold
            yield pa.RecordBatch.from_struct_array(row.filter(pa.array(keep)))

    return shape.mapInArrow(lean(work), shape.schema["row"].dataType)
