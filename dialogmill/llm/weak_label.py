"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every document. A document's votes form one of at most
3**9 patterns; only the counts of the patterns, over all documents, go to the driver, where
expectation-maximisation estimates how often each labeller is right in each class and with that the
probability that each pattern is good. These probabilities are the labels of a logistic model over hashed words and
hashed word shapes, fitted on at most ``TRAIN_DOCS`` documents picked by a hash: half of patterns that are clearly good, half
of clearly bad ones, and where no pattern is clear in a class, of those nearest to it. The model scores every whole
text. A document is kept at a score of ``THRESHOLD`` or more, so ties at the threshold are kept.

Nulls: a null text counts as the empty text; texts without a word have score 0 and are rejected. Repeated rows
get equal scores. Texts are scored whole, whatever their length. An empty table gives an empty result. Extra columns stay
with their row (classify; its own quality_score and kept are replaced) or are ignored (the query).
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dialogmill.llm.common import WORD, materialize, prepare_python, table, text_of

BITS = 16
TRAIN_DOCS = 3_000
THRESHOLD = 0.5
CLEAR = 0.9
CACHE = 200_000
#: Common words of the four languages.
COMMON = "the of and to in is that it for on with as was are be this by at an der die und das ist zu den von mit für auf nicht eine des le la les de et un une du en que est pour pas par el los las que y con del se por no su al".split()
INSULTS = "clown disgusting idiot loser moron pathetic scum stupid trash worthless".split()


def measures() -> dict[str, Column]:
    """What the labellers look at, over text and words. Each is computed once, as a column of its own."""
    among = lambda terms, ends: ", ".join(repr(t + e) for t in dict.fromkeys(terms) for e in ends)
    listed = lambda terms, ends=("", ".", ",", "!", "?"): F.expr(f"size(filter(words, w -> lower(w) IN ({among(terms, ends)})))")
    return {
        "n": F.greatest(F.size("words"), F.lit(1)),
        "chars": F.length(F.array_join("words", "")),
        "symbols": F.length("text") - F.length(F.translate("text", "#*$%&|<>{}[]=_~^\\", "")),
        "bangs": F.length("text") - F.length(F.replace("text", F.lit("!"), F.lit(""))),
        "upper": F.length("text") - F.length(F.regexp_replace("text", r"\p{Lu}+", "")),
        "letters": F.length("text") - F.length(F.regexp_replace("text", r"\p{L}+", "")),
        "distinct": F.size(F.array_distinct("words")),
        "stutters": F.expr("size(filter(words, (w, i) -> i > 0 AND words[greatest(i - 1, 0)] = w))"),
        "common": listed(COMMON, ("", ",")),
        "insults": listed(INSULTS),
    }


def labellers() -> list[tuple[str, Column]]:
    """(name, vote): 1 good, 2 bad, 0 nothing; over the measures. Most only know what is bad, so that what they
    don't see isn't counted as many times good; insults come last, as they say little about quality."""
    m = {k: F.col(k) for k in measures()}
    n, chars, letters, distinct = m["n"], m["chars"], F.greatest(m["letters"], F.lit(1)), m["distinct"]
    vote = lambda bad, good=F.lit(False): F.when(bad, 2).when(good, 1).otherwise(0)
    return [
        ("symbols", vote(m["symbols"] * 10 > n)),
        ("exclamations", vote(m["bangs"] * 5 > n)),
        ("capitals", vote((n >= 8) & (m["upper"] * 3 > letters))),
        ("word_length", vote((chars < F.lit(2.2) * n) | (chars > 14 * n))),
        ("repetition", vote((n >= 12) & (distinct * 4 < n), distinct * 10 >= 4 * n)),
        ("stutter", vote(m["stutters"] * 5 > n)),
        ("letters", vote(letters * 10 < 8 * chars)),
        ("common_words", vote(F.lit(False), m["common"] * 20 >= n)),
        ("insults", vote(m["insults"] >= 3)),
    ]


def votes(docs: DataFrame) -> DataFrame:
    """doc_id, text, pattern: the votes as digits of base 3; -1 without words."""
    rows = docs.select("doc_id", text_of().alias("text"))
    rows = rows.select("doc_id", "text", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"))
    rows = rows.select("doc_id", "text", (F.size("words") > 0).alias("some"), *[c.alias(k) for k, c in measures().items()])
    digits = [v * 3**i for i, (_, v) in enumerate(labellers())]
    pattern = digits[0]
    for d in digits[1:]:
        pattern = pattern + d
    return rows.select("doc_id", "text", F.when(F.col("some"), pattern).otherwise(F.lit(-1)).alias("pattern"))


def expectation_maximisation(counts: dict[int, int], n_labellers: int, rounds: int = 50) -> tuple[dict[int, float], np.ndarray]:
    """(pattern -> probability that it is good, accuracy[class, labeller, vote]). Starts at the bad votes."""
    patterns = sorted(p for p in counts if p >= 0)
    if not patterns:
        return {}, np.full((2, n_labellers, 3), 1 / 3)
    v = np.array([[(p // 3**j) % 3 for j in range(n_labellers)] for p in patterns])
    w = np.array([counts[p] for p in patterns], float)
    good, bad = (v == 1).sum(1), (v[:, : max(1, n_labellers - 1)] == 2).sum(1)
    post = np.where(bad >= np.maximum(1, good - 1), 0.1, 0.9)
    theta = np.empty((2, n_labellers, 3))
    for _ in range(rounds):
        for c, share in ((0, w * (1 - post)), (1, w * post)):
            for j in range(n_labellers):
                theta[c, j] = np.bincount(v[:, j], share, 3) + 0.5
            theta[c] /= theta[c].sum(1, keepdims=True)
        prior = np.clip((w * post).sum() / w.sum(), 0.05, 0.95)
        log = [math.log(p) + sum(np.log(theta[c, j, v[:, j]]) for j in range(n_labellers)) for c, p in ((0, 1 - prior), (1, prior))]
        post = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
    return dict(zip(patterns, post.tolist(), strict=True)), theta


def shape(word: str) -> str:
    """The word with letters as A or a, digits as 0 and runs collapsed."""
    out = []
    for c in word:
        s = ("A" if c.isupper() else "a") if c.isalpha() else "0" if c.isdigit() else c
        if not out or out[-1] != s:
            out.append(s)
    return "".join(out)


def buckets(word: str) -> tuple[int, int]:
    mask = (1 << BITS) - 1
    return zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) & mask, zlib.crc32(b"shape " + shape(word).encode("utf-8", "surrogatepass")) & mask


def repeats(words: list[str]) -> float:
    """Share of words that equal the one before."""
    return sum(map(str.__eq__, words, words[1:])) / len(words)


def words_of(text: str) -> list[str]:
    return [w.decode("utf-8", "surrogatepass") for w in text.encode("utf-8", "surrogatepass").split()]


def train(sample: list[tuple[np.ndarray, np.ndarray, float]], steps: int = 150, rate: float = 4.0, decay: float = 1e-5) -> np.ndarray:
    """Weights, the bias last, of a logistic model by full-batch Adagrad; sample: (buckets, shares, label)."""
    size = (1 << BITS) + 2
    if not sample:
        return np.zeros(size)
    at = np.concatenate([a for a, _, _ in sample])
    x = np.concatenate([s for _, s, _ in sample])
    row = np.repeat(np.arange(len(sample)), [len(a) for a, _, _ in sample])
    y = np.array([label for _, _, label in sample])
    each = np.where(y > 0.5, 0.5 / max(1, (y > 0.5).sum()), 0.5 / max(1, (y <= 0.5).sum()))
    w, seen = np.zeros(size), np.full(size, 1e-8)
    for _ in range(steps):
        z = np.bincount(row, w[at] * x, len(y)) + w[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) * each
        grad = np.bincount(at, error[row] * x, size) + decay * w
        grad[-1] = error.sum()
        seen += grad * grad
        w -= rate / 10 * grad / np.sqrt(seen)
    return w


def sample_features(docs: DataFrame, labels: dict[int, float]) -> DataFrame:
    """h, at, share: hashed features of the texts whose hashes are in ``labels``, once each, made on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            h, at, share = [], [], []
            for text, own in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                if own in seen:
                    continue
                seen.add(own)
                words = words_of(text.as_py())
                found, n = np.unique(np.array([b for w in words for b in buckets(w)], np.int32), return_counts=True)
                h.append(own)
                at.append(np.append(found, 1 << BITS).astype(np.int32))
                share.append(np.append(n / len(words), repeats(words)).astype(np.float32))
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(at, pa.list_(pa.int32())), pa.array(share, pa.list_(pa.float32()))], names=["h", "at", "share"])

    found = docs.select("text", F.xxhash64("text").alias("h")).where(F.col("h").isin(list(labels)))
    return found.mapInArrow(run, "h long, at array<int>, share array<float>").dropDuplicates(["h"])


def nearest(post: dict[int, float], good: bool) -> list[int]:
    """The patterns that are clear in a class, else those nearest to it, if they lie on its side."""
    own = {p: x if good else 1 - x for p, x in post.items()}
    clear = [p for p, x in own.items() if x >= CLEAR]
    most = max(own.values(), default=0.0)
    return clear or [p for p, x in own.items() if x == most and x >= 0.5]


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> tuple[np.ndarray, dict[int, float]]:
    """(weights, pattern -> probability): patterns are counted over all documents, the model is fitted on a sample.

    The votes are written once; a filter on them over the texts would be pushed down into their expressions.
    """
    voted = materialize(votes(docs).select(F.xxhash64("text").alias("h"), "pattern"), "votes")
    counts = {r["pattern"]: r["n"] for r in voted.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()}  # 3**9 rows at most
    post, _ = expectation_maximisation(counts, len(labellers()))
    labels: dict[int, float] = {}
    for good in (True, False):
        if patterns := nearest(post, good):
            picked = voted.where(F.col("pattern").isin(patterns)).groupBy("h").agg(F.min("pattern").alias("pattern")).orderBy("h").limit(train_docs // 2)
            labels |= {r["h"]: label_of(post[r["pattern"]]) for r in picked.collect()}
    rows = sample_features(docs, labels).collect() if labels else []
    sample = [(np.array(r["at"]), np.array(r["share"]), labels[r["h"]]) for r in sorted(rows, key=lambda r: r["h"])]
    return train(sample), post


def label_of(probability: float) -> float:
    """Clear probabilities are whole labels."""
    return 1.0 if probability >= CLEAR else 0.0 if probability <= 1 - CLEAR else probability


class _WordWeights(dict):
    """word -> its weight; bounded."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights.tolist()

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHE:
            self.clear()
        a, b = buckets(word)
        value = self[word] = self.weights[a] + self.weights[b]
        return value


def score_text(text: str | None, weights: _WordWeights) -> float:
    words = words_of(text or "")
    if not words:
        return 0.0
    z = sum(map(weights.__getitem__, words)) / len(words) + weights.weights[1 << BITS] * repeats(words) + weights.weights[-1]
    return round(1 / (1 + math.exp(-max(-50.0, min(50.0, z)))), 6)


def classify(docs: DataFrame, train_docs: int = TRAIN_DOCS, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` (doc_id, text, ...) with quality_score and kept."""
    spark = docs.sparkSession
    prepare_python(spark)
    docs = docs.drop("quality_score", "kept")
    weights, _ = fit(docs.select("doc_id", "text"), train_docs)
    sent = spark.sparkContext.broadcast(weights.astype(np.float64))
    at = docs.columns.index("text")
    names = [*docs.columns, "quality_score", "kept"]
    schema = T.StructType([*docs.schema.fields, T.StructField("quality_score", T.DoubleType()), T.StructField("kept", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _WordWeights(sent.value)
        for batch in batches:
            scores = [score_text(t.as_py(), own) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array([s >= threshold for s in scores], pa.bool_())], names=names)

    return docs.mapInArrow(run, schema)


def op6_quality_classifier(spark, sf_dir: str) -> DataFrame:
    out = classify(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "quality_score", "kept")
