"""Toxicity by a classifier chain: categories in a fixed order, each seeing the probabilities of those before it."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_rows, text_of

#: Labelled documents fitted at most; a larger table gives those with the smallest hashes of their ids.
MAX_LABELLED = 8192
#: Words the models see: those whose presence tells most about the label.
FEATURES = 128
FOLDS = 5
RIDGE = 1.0
#: Words that split the labelled toxic documents into the chain's earlier categories.
SEEDS = {
    "insult": ("idiot", "moron", "stupid", "loser", "clown", "fool", "dumb", "imbecile"),
    "contempt": ("trash", "scum", "worthless", "pathetic", "disgusting", "garbage", "filth", "vermin"),
}
CHAIN = (*SEEDS, "toxic")
THRESHOLD = 0.5
_TABLE = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Lower-cased words, in UTF-8: runs of ASCII letters and digits and of signs beyond ASCII."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_TABLE).split()


@dataclass
class ToxicityModel:
    """Linear models of a chain over log(1 + count) of the vocabulary's words; weights[k] also has those of the k earlier probabilities and, last, the bias."""

    vocabulary: list[bytes]
    chain: tuple[str, ...]
    weights: list[np.ndarray]

    def features(self, texts: list[str]) -> np.ndarray:
        index = {w: i for i, w in enumerate(self.vocabulary)}
        known = frozenset(index)
        x = np.zeros((len(texts), len(index)))
        for r, t in enumerate(texts):
            words = words_of(t)
            if known.intersection(words):
                for w, n in Counter(words).items():
                    if w in index:
                        x[r, index[w]] = np.log1p(n)
        return x

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """A column for each category of the chain; each is computed with those before it."""
        p = np.zeros((len(x), 0))
        for w in self.weights:
            p = np.column_stack([p, sigmoid(np.column_stack([x, p, np.ones(len(x))]) @ w)])
        return p


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = 25) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method; the last, the bias, isn't shrunk."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    prior = np.clip(y.mean() if len(y) else 0.0, 1e-4, 1 - 1e-4)
    w[-1] = np.log(prior / (1 - prior))
    if not len(y) or y.min() == y.max():
        return w
    penalty = np.full(a.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = sigmoid(a @ w)
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty), a.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-5:
            break
    return w


def fit_chain(x: np.ndarray, labels: np.ndarray, folds: int = FOLDS, ridge: float = RIDGE) -> list[np.ndarray]:
    """Weights of the chain. A model is trained with earlier categories' out-of-fold probabilities: those of models that haven't seen the row."""
    fold = np.arange(len(x)) % folds
    seen = np.zeros((len(x), 0))
    out = []
    for k in range(labels.shape[1]):
        z, y = np.column_stack([x, seen]), labels[:, k]
        held_out = np.zeros(len(x))
        for f in range(folds):
            w = fit_logistic(z[fold != f], y[fold != f], ridge)
            held_out[fold == f] = sigmoid(np.column_stack([z[fold == f], np.ones((fold == f).sum())]) @ w)
        out.append(fit_logistic(z, y, ridge))
        seen = np.column_stack([seen, held_out])
    return out


def train_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = MAX_LABELLED, features: int = FEATURES, folds: int = FOLDS) -> ToxicityModel:
    """Fits the chain on at most ``max_labelled`` labelled documents.

    The words' document counts under either label are aggregated on the executors; the ``features`` words of the largest
    chi-square, and a row of numbers for each sampled document, come to the driver. Labels without a document, null labels
    and null ids are left out; of several labels of an id the largest counts. Without any labelled row every probability
    is near 0.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    marked = labels.select(labels[id_col].alias("_id"), labels[label_col].cast("int").alias("_y")).filter("_id is not null and _y is not null").groupBy("_id").agg(F.max("_y").alias("_y"))
    sample = marked.orderBy(F.xxhash64("_id"), "_id").limit(max_labelled)
    texts = docs.select(docs[id_col].alias("_id"), text_of(docs, text_col).alias("_text"))
    picked = texts.join(F.broadcast(sample), "_id").select("_id", "_y", "_text")  # at most max_labelled rows of two numbers

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: list[Counter[bytes]] = [Counter(), Counter()]
        for b in batches:
            for y, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                n[y > 0].update(set(words_of(t)))
                n[y > 0][b""] += 1
        words = [*n[0], *(w for w in n[1] if w not in n[0])]
        yield pa.RecordBatch.from_pydict({"w": words, "neg": [n[0][w] for w in words], "pos": [n[1][w] for w in words]}, schema=pa.schema([("w", pa.binary()), ("neg", pa.int64()), ("pos", pa.int64())]))

    counts = picked.mapInArrow(count, "w binary, neg long, pos long").groupBy("w").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    whole = counts.filter(F.length("w") == 0).collect()
    neg, pos = (whole[0]["neg"], whole[0]["pos"]) if whole else (0, 0)
    total = neg + pos
    chosen: list[bytes] = []
    if neg and pos:
        a, b = F.col("pos").cast("double"), F.col("neg").cast("double")
        chi = total * (a * (neg - b) - b * (pos - a)) ** 2 / ((a + b) * (total - a - b + F.lit(0.5)) * F.lit(float(neg)) * F.lit(float(pos)))
        best = counts.filter((F.length("w") > 0) & (a + b >= 5)).orderBy(chi.desc(), "w").limit(features)
        chosen = [bytes(r["w"]) for r in best.select("w").collect()]
    model = ToxicityModel(chosen, CHAIN, [])
    seeds = [frozenset(w.encode() for w in SEEDS[c]) for c in SEEDS]

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t, y = b.column(2).to_pylist(), [int(v > 0) for v in b.column(1).to_pylist()]
            marks = [[int(v and bool(s.intersection(words_of(x)))) for s in seeds] + [v] for x, v in zip(t, y, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), pa.array(marks, pa.list_(pa.int32())), pa.array(model.features(t).astype(np.float32).tolist(), pa.list_(pa.float32()))], names=["id", "y", "x"])

    rows = sorted(picked.mapInArrow(vectors, "id string, y array<int>, x array<float>").collect(), key=lambda r: (r["id"], r["x"]))
    x = np.array([r["x"] for r in rows], dtype=np.float64).reshape(len(rows), len(chosen))
    model.weights = fit_chain(x, np.array([r["y"] for r in rows], dtype=np.float64).reshape(len(rows), len(CHAIN)), folds)
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, text_col: str = "text", threshold: float = THRESHOLD, prefix: str = "p_") -> DataFrame:
    """docs with a probability for each category and ``is_toxic``; no row moves. New columns take the place of those of the same names. A null text counts as empty."""
    arrow_rows(docs.sparkSession)
    names = [prefix + c for c in model.chain]
    kept = [c for c in docs.columns if c not in {*names, "is_toxic"}]
    rows = docs.select(*(F.col(f"`{c}`") for c in kept), text_of(docs, text_col).alias("_scored_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), *(f"`{c}` double" for c in names), "is_toxic boolean"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = model.probabilities(model.features(b.column(b.num_columns - 1).to_pylist()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(p[:, k]) for k in range(p.shape[1])), pa.array(p[:, -1] >= threshold)], names=[*kept, *names, "is_toxic"])

    return rows.mapInArrow(score, schema)
