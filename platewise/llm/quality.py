"""Quality classifier by Bradley-Terry pairwise ranking.

Every text has a vector of surface features.  The model is a score ``w . x`` so
that, of a preferred and a rejected text, the preferred one wins with
probability ``sigmoid(w . (x1 - x0))``; ``w`` minimises the logistic loss of the
feature differences of many pairs.  The decision threshold is a quantile of
the training scores, and the reported score is the sigmoid of a text's margin
over it, so 0.5 is the threshold.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

FEATURES = [
    "word_length", "distinct_words", "repeated_neighbours", "repeated_pairs", "upper_case", "upper_words",
    "symbols", "bars", "exclamations", "repeated_lines",
]
#: Words at which a text's deviations count half.
HALF_WORDS = 15
_CLASSES = np.zeros((5, 256))
for _row, _bytes in enumerate([b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"#$%&*<>=@^_`~{}[]\\/+", b"|", b"!"]):
    _CLASSES[_row, list(_bytes)] = 1


def features(text: str) -> np.ndarray:
    """The number of words of a whole text, and its surface features, each about 0 to 1 or a logarithm; 0 without words."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    if not n:
        return np.zeros(1 + len(FEATURES))
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    upper, lower, symbols, bars, marks = _CLASSES @ counts
    rows = [x for x in data.split(b"\n") if x.strip()]
    pairs = list(zip(words, words[1:]))
    return np.array([
        n, np.log1p(len(data) / n), np.log1p(len(set(words))) / np.log1p(n), sum(map(operator.eq, words, words[1:])) / n,
        1 - len(set(pairs)) / max(1, len(pairs)), upper / max(1, upper + lower), sum(map(bytes.isupper, words)) / n,
        symbols / n, bars / n, marks / n, 1 - len(set(rows)) / len(rows),
    ])


def spread(x: np.ndarray) -> np.ndarray:
    """The features with their square roots, which tell small shares of noise from none."""
    return np.concatenate([x[..., 1:], np.sqrt(np.abs(x[..., 1:]))], axis=-1)


def standard(x: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Deviations from a usual text, smaller for short texts, whose shares say little."""
    return np.clip((spread(x) - centre) / scale, -8, 8) * (x[..., :1] / (x[..., :1] + HALF_WORDS))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    threshold: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        return standard(x, self.centre, self.scale) @ self.weights - self.threshold

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, n_pairs: int = 60_000, steps: int = 300, l2: float = 1e-4, seed: int = 0) -> Model:
    """Bradley-Terry weights from preference pairs of a text labelled 1 and one labelled 0.

    Without both labels nothing is preferred: every text then scores 0.5.
    """
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        width = 2 * len(FEATURES)
        return Model(np.zeros(width), np.zeros(width), np.ones(width), 0.0)
    centre, scale = np.median(spread(x[good]), 0), spread(x).std(0) + 1e-6
    z = standard(x, centre, scale)
    rng = np.random.default_rng(seed)
    differences = z[rng.choice(good, n_pairs)] - z[rng.choice(bad, n_pairs)]
    w, m, v = np.zeros(z.shape[1]), 0.0, 0.0
    for t in range(1, steps + 1):  # Adam over all pairs
        losing = 1 / (1 + np.exp(np.clip(differences @ w, -30, 30)))
        g = -(differences * losing[:, None]).mean(0) + l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    scores = z @ w
    # the quantile that parts the labels best, among those up to twice the share of rejected texts
    share = len(bad) / len(y)
    quantiles = np.quantile(scores, np.linspace(0, min(1, 2 * share), 201))
    balanced = [(scores[good] >= q).mean() + (scores[bad] < q).mean() for q in quantiles]
    # the lowest of the about equally good ones, which keeps the most texts
    return Model(w, centre, scale, float(quantiles[np.argmax(np.array(balanced) >= max(balanced) - 0.002)]))


def labelled(docs: DataFrame, labels: DataFrame, where: Column | None = None, id_col: str = "doc_id",
             text_col: str = "text", label_col: str = "quality", bound: int = 20_000, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``bound`` labelled texts, those with the smallest seeded hash of the id.

    ``where`` restricts the rows of ``labels``.  Labels other than 0 and 1, and null ids, are left out.
    """
    marked = labels if where is None else labels.filter(where)
    marked = (marked.select(marked[id_col].cast("long").alias("l_id"), marked[label_col].cast("int").alias("label"))
              .filter("label IN (0, 1) AND l_id IS NOT NULL").distinct()
              .withColumn("h", F.xxhash64(F.lit(seed), "l_id")).orderBy("h", "l_id", "label").limit(bound))
    rows = common.id_text(docs, id_col, text_col)
    # at most ``bound`` narrow rows
    chosen = rows.join(F.broadcast(marked), rows["doc_id"] == marked["l_id"]).select("text", "label", "h", "l_id")
    vectors = common.map_arrow(chosen, _vectors, "label int, h long, l_id long, x array<double>")
    got = sorted((r["h"], r["l_id"], r["label"], r["x"]) for r in vectors.collect())
    return np.array([r[3] for r in got]).reshape(len(got), 1 + len(FEATURES)), np.array([r[2] for r in got], int)


def _vectors(batches):
    for b in common.slices(batches):
        x = [features(t) for t in b["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([b["label"], b["h"], b["l_id"], pa.array(x, pa.list_(pa.float64()))], names=["label", "h", "l_id", "x"])


def train(docs: DataFrame, labels: DataFrame, where: Column | None = None, bound: int = 20_000, **columns) -> Model:
    """A model from at most ``bound`` labelled rows (:func:`labelled`); the fit itself is small and runs on the driver."""
    return fit(*labelled(docs, labels, where, bound=bound, **columns))


def _scores(keep: list[str], model: Model, text: str = "text"):
    def run(batches):
        for b in common.slices(batches):
            x = np.array([features(t) for t in common.texts_of(b, text)]).reshape(b.num_rows, 1 + len(FEATURES))
            yield pa.RecordBatch.from_arrays([*[b[c] for c in keep], pa.array(model.score(x), pa.float64())], names=[*keep, "score"])
    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` for every row: the whole text's score from 0 to 1.

    Null and empty texts have the features of nothing, and so the score of a
    usual text.  Repeated rows and null ids each give their row.
    """
    return common.map_arrow(common.id_text(docs, id_col, text_col), _scores(["doc_id"], model), "doc_id long, score double")


def accepted(docs: DataFrame, model: Model, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores ``least`` or more, unchanged."""
    own, text = common.carried(docs, text_col)
    keep = [f"c_{c}" for c in docs.columns]
    schema = ", ".join(f"`{c}` {kind}" for c, kind in own.dtypes if c in keep)
    scored = common.map_arrow(own, _scores(keep, model, text), f"{schema}, score double")
    return scored.filter(F.col("score") >= least).select(*[F.col(f"`c_{c}`").alias(c) for c in docs.columns])
