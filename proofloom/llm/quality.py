"""Quality classifier by Bradley-Terry pairwise ranking.

A document's strength is w . f(text); in a preference pair the better document wins with probability
sigmoid(w . (f(better) - f(worse))). w is learned by logistic loss on feature differences of pairs of labelled documents
(label 1 preferred to label 0). All labelled rows are learned from: they are dealt by hash over blocks of about FIT_ROWS, each row of
a block stands in its pairs, and w is the mean of the blocks' weights. The cut is a quantile of the strengths of all training
rows: the share of label 0 among them. Scores are sigmoid(slope * (strength - cut) + logit(0.3)), so that score >= 0.3 is strength >= cut.

Features are read from the text alone: shares of character classes, word shapes, repetition and line shapes, each cut into
bins at training quantiles, so that a linear strength can follow any curve of a feature; and what the text says, as square
roots of the shares of its words and of its runs of three bytes, hashed into GRAMS buckets each.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofloom.llm.common import documents, staged, text_or_empty, wrapped
from proofloom.llm.textnum import Tokens, slices

THRESHOLD = 0.3
FIT_ROWS = 16_000  # labelled rows of a block, about
PAIRS = 30_000  # of a block at least; more if a label has more rows
RARE = 256  # rows of each label in a block, about; a rarer label's rows stand in several blocks
BROADCAST_ROWS = 1 << 20
GRAMS = 512  # buckets of hashed words, and as many of hashed runs of three bytes
SLICE = 1 << 19
BINS = 8
ROUNDS = 300
RIDGE = 1e-3
SEED = 7

_CLASS = np.zeros(256, dtype=np.int64)  # 0 other, 1 upper, 2 lower, 3 digit, 4 blank, 5 sentence mark, 6 odd symbol, 7 above ASCII
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 7
_CLASS[[9, 10, 11, 12, 13, 32]] = 4
_CLASS[[ord(c) for c in ".,;:?'\"-()"]] = 5
_CLASS[[ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]] = 6
NAMES = ("log_size", "upper", "lower", "digit", "blank", "mark", "symbol", "high", "entropy", "word_len", "distinct_words", "top_word", "same_as_last", "symbol_words", "upper_words", "long_words", "lines", "distinct_lines", "line_len", "words_per_mark", "distinct_pairs")


def text_features(text: str) -> list[float]:
    """The features NAMES of a text; all zero but for none if it is empty."""
    raw = text.encode()
    n = len(raw)
    if not n:
        return [0.0] * len(NAMES)
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    shares = np.bincount(_CLASS, weights=counts, minlength=8) / n
    p = counts[counts > 0] / n
    words = raw.split()
    m = max(1, len(words))
    seen = Counter(words)
    last = words[-1:] + words[:-1]
    lines = raw.split(b"\n")
    marks = sum(int(counts[ord(c)]) for c in ".?!")
    return [
        np.log1p(n), *shares[1:8], float(-(p * np.log2(p)).sum()),
        sum(map(len, words)) / m, len(seen) / m, max(seen.values(), default=0) / m, sum(a == b for a, b in zip(words, last, strict=True)) / m if len(words) > 1 else 0.0,
        sum(c for w, c in seen.items() if _CLASS[w[-1]] == 6) / m, sum(c for w, c in seen.items() if w.isupper()) / m, sum(c for w, c in seen.items() if len(w) > 20) / m,
        len(lines) / m, len(set(lines)) / len(lines), n / len(lines), m / (1 + marks), len(set(zip(words, words[1:], strict=False))) / m,
    ]


def gram_features(texts: list[bytes]) -> np.ndarray:
    """A row of 2 * GRAMS bytes for each text: square roots of the shares of its hashed words, then of its hashed runs of
    three bytes, each scaled to 255."""
    out = np.zeros((len(texts), 2 * GRAMS), dtype=np.uint8)

    def fill(first: int, doc: np.ndarray, bucket: np.ndarray, lo: int, hi: int) -> None:
        counts = np.bincount((doc * GRAMS + bucket), minlength=(hi - lo) * GRAMS).reshape(hi - lo, GRAMS)
        share = counts / np.maximum(1, counts.sum(axis=1, keepdims=True))
        out[lo:hi, first : first + GRAMS] = np.rint(255 * np.sqrt(share))

    for lo, hi in slices(texts, SLICE):
        t = Tokens(texts[lo:hi])
        fill(0, t.doc, (t.hashes >> np.uint64(40)).astype(np.int64) % GRAMS, lo, hi)
        data = np.frombuffer(b"".join(texts[lo:hi]), dtype=np.uint8).astype(np.int64)
        doc = np.repeat(np.arange(hi - lo), [len(x) for x in texts[lo:hi]])
        if len(data) > 2:
            three = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
            own = doc[:-2] == doc[2:]
            fill(GRAMS, doc[:-2][own], (three[own] * 0x9E3779B1 >> 15) % GRAMS, lo, hi)
    return out


def features_of(texts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """(shapes, grams) of texts."""
    return np.array([text_features(t) for t in texts], dtype=np.float64).reshape(-1, len(NAMES)), gram_features([t.encode() for t in texts])


@dataclass(frozen=True)
class Ranker:
    edges: np.ndarray  # features x (BINS - 1)
    weights: np.ndarray
    cut: float
    slope: float

    def design(self, x: np.ndarray, grams: np.ndarray) -> np.ndarray:
        bins = np.stack([np.searchsorted(e, col, side="right") for e, col in zip(self.edges, x.T, strict=True)], axis=1)
        return np.concatenate([(bins[:, :, None] == np.arange(BINS)).reshape(len(x), -1), grams / np.float32(255)], axis=1, dtype=np.float32)

    def score(self, x: np.ndarray, grams: np.ndarray) -> np.ndarray:
        strength = self.design(x, grams) @ self.weights
        return 1 / (1 + np.exp(-np.clip(self.slope * (strength - self.cut) + np.log(THRESHOLD / (1 - THRESHOLD)), -50, 50)))


def fit_pairs(x: np.ndarray, better: np.ndarray, worse: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Weights of the Bradley-Terry model for pairs of row numbers: accelerated gradient descent on the mean logistic loss of
    feature differences. The gradient is summed by row first, so that no difference is held."""
    rate = 1 / max(1e-9, float((x**2).sum(axis=1).max()))  # a difference is at most four times that, its loss a quarter curved
    w = momentum = np.zeros(x.shape[1], dtype=np.float32)
    for k in range(rounds):
        strength = x @ momentum
        wrong = 1 / (1 + np.exp(np.clip(strength[better] - strength[worse], -50, 50)))
        by_row = np.bincount(better, wrong, len(x)) - np.bincount(worse, wrong, len(x))
        grad = -(x.T @ by_row.astype(np.float32)) / len(better) + RIDGE * momentum
        new = momentum - rate * grad
        momentum = new + k / (k + 3) * (new - w)
        w = new
    return w


def arrays_of(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(shapes, grams) of rows: features, grams."""
    return np.array(rows["features"].tolist(), dtype=np.float64).reshape(-1, len(NAMES)), np.frombuffer(b"".join(rows["grams"]), dtype=np.uint8).reshape(-1, 2 * GRAMS)


def block_weights(design: np.ndarray, y: np.ndarray) -> np.ndarray | None:
    """Weights learned from the rows of a block, each of which stands in a pair. None if a label is missing."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return None
    rng = np.random.default_rng(SEED)
    m = max(PAIRS, len(good), len(bad))
    dealt = lambda rows: np.concatenate([rng.permutation(rows) for _ in range(-(-m // len(rows)))])[:m]
    return fit_pairs(design, dealt(good), dealt(bad))


@dataclass(frozen=True)
class Training:
    """Labelled rows (h, features, grams, quality) as a table, and how many there are of each label."""

    rows: DataFrame
    bad: int
    good: int

    def __len__(self) -> int:
        return self.bad + self.good


def fit(rows: pd.DataFrame | Training) -> Ranker | None:
    """rows: features, grams, quality. None if a label is missing: then nothing can be preferred."""
    if isinstance(rows, Training):
        return fit_blocks(rows)
    x, grams = arrays_of(rows)
    y = rows["quality"].to_numpy(dtype=np.int64)
    if not (y == 1).any() or not (y == 0).any():
        return None
    edges = np.quantile(x, np.arange(1, BINS) / BINS, axis=0).T
    design = Ranker(edges, np.zeros(0), 0.0, 1.0).design(x, grams)
    w = block_weights(design, y)
    cut = float(np.quantile(design @ w, (y == 0).mean()))
    return Ranker(edges, w, cut, 2.0)


def quantile(values: np.ndarray, counts: np.ndarray, share: float) -> float:
    """Of values that occur so often, the least that a share of all are at or below."""
    order = np.argsort(values)
    at = np.searchsorted(np.cumsum(counts[order]), share * counts.sum() - 1e-9)
    return float(values[order][min(at, len(order) - 1)])


def fit_blocks(given: Training, block: int = FIT_ROWS) -> Ranker | None:
    """The model of all rows of a table. Quantiles are of the counts of all values, rounded to ten bits (a feature) or to 1/1,024 (a
    strength), so the driver gets counts of a grid and a block's weights, never rows."""
    if not given.good or not given.bad:
        return None
    bits = F.pow(F.lit(2.0), F.floor(F.log2(F.abs("v"))) - F.lit(9))
    grid = F.when(F.col("v") == 0, F.lit(0.0)).otherwise(F.round(F.col("v") / bits) * bits)
    shapes = given.rows.select(F.posexplode("features").alias("f", "v")).groupBy("f", grid.alias("v")).agg(F.count("*").alias("n")).toPandas()
    edges = np.array([[quantile(g["v"].to_numpy(), g["n"].to_numpy(), k / BINS) for k in range(1, BINS)] for _, g in shapes.groupby("f", sort=True)])
    plain = Ranker(edges, np.zeros(0), 0.0, 1.0)
    blocks = max(1, -(-len(given) // block))
    copies = {y: min(blocks, -(-RARE * blocks // n)) for y, n in ((0, given.bad), (1, given.good))}
    several = F.when(F.col("quality") == 0, copies[0]).otherwise(copies[1])
    dealt = given.rows.withColumn("i", F.explode(F.sequence(F.lit(0), several - 1))).withColumn("block", F.pmod(F.pmod("h", F.lit(blocks)) + F.col("i"), F.lit(blocks)))

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.iloc[np.lexsort((rows["quality"], [hash(tuple(x)) for x in rows["features"]], rows["h"]))]  # in an order of their own
        w = block_weights(plain.design(*arrays_of(rows)), rows["quality"].to_numpy(dtype=np.int64))
        return pd.DataFrame({"block": rows["block"].iloc[:1], "w": [w]} if w is not None else {"block": [], "w": []})

    learned = dealt.groupBy("block").applyInPandas(learn, "block long, w array<float>").toPandas().sort_values("block")
    if not len(learned):
        return None
    w = np.mean(np.stack(learned["w"]).astype(np.float64), axis=0).astype(np.float32)

    @F.pandas_udf("double")
    def strength(features: pd.Series, grams: pd.Series) -> pd.Series:
        x = arrays_of(pd.DataFrame({"features": features, "grams": grams}))
        return pd.Series((plain.design(*x) @ w).astype(np.float64))

    strengths = given.rows.select((F.round(strength("features", "grams") * 1024) / 1024).alias("v")).groupBy("v").agg(F.count("*").alias("n")).toPandas()
    return Ranker(edges, w, quantile(strengths["v"].to_numpy(), strengths["n"].to_numpy(), given.bad / len(given)), 2.0)


def training_rows(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", fold: int = 0) -> Training:
    """All labelled rows outside the held-out fold, their features written once. An id with several labels counts as its largest."""
    held = F.coalesce(F.crc32(F.col("k").cast("string")) % 5 == fold, F.lit(False))
    known = labels.select(F.col(key).alias("k"), "quality").filter("quality IS NOT NULL").groupBy("k").agg(F.max("quality").alias("quality")).filter(~held)

    @F.pandas_udf("features array<double>, grams binary")
    def features(texts: pd.Series) -> pd.DataFrame:
        x, grams = features_of(texts)
        return pd.DataFrame({"features": list(x), "grams": [g.tobytes() for g in grams]})

    # features are made where the texts are, which are not moved while the labels are few
    rows = docs.select(F.col(key).alias("k"), text_or_empty(text).alias("text")).join(F.broadcast(known) if known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else known, "k")
    made = staged(rows.select(F.xxhash64("k").alias("h"), "quality", features("text").alias("f")).select("h", "quality", "f.*"), "training")
    counts = {r["quality"]: r["n"] for r in made.filter("quality IN (0, 1)").groupBy("quality").agg(F.count("*").alias("n")).collect()}
    return Training(made.filter("quality IN (0, 1)"), counts.get(0, 0), counts.get(1, 0))


def score_documents(df: DataFrame, ranker: Ranker | None, text: str = "text") -> DataFrame:
    """df plus score and predicted (replaced if present). Null text is the empty text; without a model every score is 0.5.
    Texts of any length are read whole. Equal texts get equal scores whatever their ids, null ones too; an empty table gives an empty one."""
    df = df.drop("score", "predicted")

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if ranker is None:
            return pd.Series(np.full(len(texts), 0.5))
        return pd.Series(ranker.score(*features_of(texts)))

    scored = wrapped(df, score=score(text_or_empty(text)))
    return scored.select("row.*", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op8_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    ranker = fit(training_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return score_documents(docs, ranker).select("doc_id", held.alias("held_out"), "score", "predicted")
