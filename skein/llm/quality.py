"""Quality scores: random-indexing word vectors, pooled, and a two-layer network.

A word is read as two units: itself, if it is among the frequent words, and its shape (runs of
upper case, lower case, digits, and other characters as they are). Each unit has an index vector
with a few random signs. Its word vector adds to that the index vectors of the units around it in
the training texts. A run of LONG or more characters without blanks (Chinese prose, encoded or
minified junk) is read as its overlapping groups of GRAM characters, over its whole length, and
counts as one word for every GRAM groups. A document is the mean of its words' vectors, beside a
few rates that a bag of words can't show (words that repeat the one before, words and lines seen
before, length). A network with one hidden layer in numpy turns that into a logit; dividing it by
a temperature fitted on rows that the training didn't see gives calibrated probabilities.

Only the fit is bounded: it takes at most SAMPLE labelled rows, spread by a hash of doc_id, and
so the driver holds SAMPLE * (DIM + RATES) numbers. Scoring is one pass over all rows.

Defined results: null or empty texts have a score too, that of a document without words; without
any label every score is 0.5; a null doc_id is scored and counts as not held out; labels that are
null are left out; of several labels of a doc_id, the lowest holds. Repeated rows give repeated
rows; extra columns aren't read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import as_texts, batches_of, doc_text, saved, table
from skein.llm.vocab import Memo

SAMPLE = 8192
WORDS, SHAPES = 2000, 400
DIM, SIGNS, AROUND = 96, 6, 2
RATES = 6
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 40, 128, 2e-3, 1e-4
CALIBRATION = 8  # every so many rows of the sample
SEED = 11
LONG, GRAM = 64, 3
BLOCK = 1 << 16  # units that are held at once


def shape(word: str) -> str:
    """Runs of like characters, one sign each: A, a, 9, or the character itself."""
    out = ""
    for c in word:
        s = "A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c
        if out[-1:] != s:
            out += s
    return out


def grams(run: str, start: int = 0, most: int | None = None) -> Iterator[str]:
    """The overlapping groups of GRAM characters, from one on, at most so many."""
    end = len(run) - GRAM + 1
    return (run[i : i + GRAM] for i in range(start, end if most is None else min(end, start + most)))


def pieces(words: list[str]) -> Iterator[str]:
    """The words in their order, long ones as their groups of characters."""
    for w in words:
        if len(w) < LONG:
            yield w
        else:
            yield from grams(w)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def index_vector(unit: str) -> np.ndarray:
    """A few random signs at random places, the same for a unit everywhere."""
    rng = np.random.Generator(np.random.PCG64(zlib.crc32(unit.encode())))
    out = np.zeros(DIM, np.float32)
    out[rng.choice(DIM, SIGNS, replace=False)] = rng.choice([-1, 1], SIGNS)
    return out


@dataclass
class Units:
    """Numbers of the known words and shapes; each kind has one number for all others, its last."""

    words: dict[str, int]
    shapes: dict[str, int]

    def __post_init__(self) -> None:
        self.n_words, self.n_shapes = len(self.words) + 1, len(self.shapes) + 1
        self.size = self.n_words + self.n_shapes
        self.pair = Memo(self._pair, 150_000)

    def __getstate__(self):
        return self.words, self.shapes

    def __setstate__(self, state):
        self.words, self.shapes = state
        self.__post_init__()

    def _pair(self, word: str) -> int:
        w = self.words.get(word.lower(), self.n_words - 1)
        return w * self.n_shapes + self.shapes.get(shape(word), self.n_shapes - 1)

    def read(self, words: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words, and of their shapes after all words' numbers."""
        w, s = np.divmod(np.fromiter(map(self.pair.__getitem__, words), np.int64), self.n_shapes)
        return w, s + self.n_words

    def index_vectors(self) -> np.ndarray:
        names = [*(f"word {w}" for w in self.words), "word", *(f"shape {s}" for s in self.shapes), "shape"]
        return np.stack([index_vector(n) for n in names])


def rates(text: str, words: list[str]) -> list[float]:
    """What order and repetition show: RATES numbers."""
    n = max(1, len(words))
    h = np.fromiter(map(hash, words), np.int64, len(words))
    lines = text.split("\n")
    letters = len(text) or 1
    return [
        np.log1p(len(words)) / 8,
        float((h[1:] == h[:-1]).sum()) / n,
        1 - len(set(words)) / n if words else 0.0,
        1 - len(set(lines)) / len(lines),
        len(text) / n / 10 if n < letters else 0.1,
        np.log1p(len(lines)) / 8,
    ]


def features(texts: list[str], units: Units, vectors: np.ndarray) -> np.ndarray:
    """[texts, DIM + RATES]"""
    out = np.zeros((len(texts), DIM + RATES), np.float32)
    for i, text in enumerate(texts):
        words = text.split()
        if words:
            long_ = [w for w in words if len(w) >= LONG]
            w, s = units.read(x for x in words if len(x) < LONG) if long_ else units.read(words)
            count, n = np.bincount(np.concatenate([w, s]), minlength=units.size), len(w)
            for run in long_:
                for start in range(0, len(run) - GRAM + 1, BLOCK):
                    w, s = units.read(grams(run, start, BLOCK))
                    count = count + np.bincount(np.concatenate([w, s]), minlength=units.size) / GRAM
                    n += len(w) / GRAM
            some = np.flatnonzero(count)
            out[i, :DIM] = count[some].astype(np.float32) @ vectors[some] / n
        out[i, DIM:] = rates(text, words)
    return out


@dataclass
class Model:
    units: Units
    vectors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    layers: list[np.ndarray]
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return forward((x - self.mean) / self.spread, self.layers)[1]

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logits(features(texts, self.units, self.vectors)) / self.temperature))


def forward(x: np.ndarray, layers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.maximum(x @ layers[0] + layers[1], 0)
    return hidden, (hidden @ layers[2] + layers[3])[:, 0].astype(np.float64)


def train(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Two layers by Adam on the logistic loss."""
    rng = np.random.Generator(np.random.PCG64(SEED))
    layers = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN, 1)), np.zeros(1)]
    first, second, step = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers], 0
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(len(x))
        for part in np.array_split(order, max(1, len(x) // BATCH)):
            hidden, z = forward(x[part], layers)
            d = ((1 / (1 + np.exp(-z))) - y[part])[:, None] / len(part)
            back = d @ layers[2].T * (hidden > 0)
            step += 1
            for i, g in enumerate([x[part].T @ back, back.sum(0), hidden.T @ d, d.sum(0)]):
                g = g + DECAY * layers[i]
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                layers[i] = layers[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return layers


def fit_temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature of the least logistic loss, from a grid of ratios."""
    if not len(z):
        return 1.0
    loss = lambda t: float(np.mean(np.logaddexp(0, np.where(y > 0, -z, z) / t)))
    return min((2.0 ** (k / 8) for k in range(-16, 33)), key=loss)


def count_units(sample: DataFrame) -> Units:
    """The most frequent words and shapes of the sample, by documents."""
    out = pa.schema([("kind", pa.int32()), ("unit", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for text in as_texts(batch.column("text")):
                words = set(pieces(text.split()))
                found.update({(0, w.lower()) for w in words} | {(1, shape(w)) for w in words})
            yield batches_of({"kind": [k for k, _ in found], "unit": [u for _, u in found], "n": list(found.values())}, out)

    total = sample.mapInArrow(run, "kind int, unit string, n long").groupBy("kind", "unit").agg(F.sum("n").alias("n"))
    top = lambda kind, most: {r["unit"]: i for i, r in enumerate(total.where(F.col("kind") == kind).orderBy(F.desc("n"), "unit").limit(most).collect())}
    return Units(top(0, WORDS), top(1, SHAPES))


def word_vectors(sample: DataFrame, units: Units) -> np.ndarray:
    """Index vectors and the normed sums of the index vectors around each unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((units.size, DIM), np.float32)
        index = units.index_vectors()
        for batch in batches:
            for text in as_texts(batch.column("text")):
                words = text.split()
                if len(words) > 1 or len(text) >= LONG:
                    w, s = units.read(pieces(words))
                    unit = np.where(w < units.n_words - 1, w, s)
                    for start in range(0, len(unit), BLOCK):
                        first = max(0, start - AROUND)
                        own = index[unit[first : start + BLOCK + AROUND]]
                        around = np.zeros_like(own)
                        for k in range(1, AROUND + 1):
                            around[k:] += own[:-k]
                            around[:-k] += own[k:]
                        at = unit[start : start + BLOCK]
                        np.add.at(total, at, around[start - first :][: len(at)])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    sums = sum((np.frombuffer(r["sums"], np.float32).reshape(-1, DIM) for r in sample.coalesce(8).mapInArrow(run, "sums binary").collect()), np.zeros((units.size, DIM), np.float32))
    norm = np.linalg.norm(sums, axis=1, keepdims=True)
    return units.index_vectors() + np.sqrt(SIGNS) * sums / np.maximum(norm, 1e-6)


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", most: int = SAMPLE) -> Model | None:
    """A model from at most so many labelled rows that aren't held out; None without any."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("y")).dropna()
    own = own.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("y").alias("y"))
    chosen = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    sample = saved(doc_text(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y"))
    units = count_units(sample)
    vectors = word_vectors(sample, units)
    out = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("x", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(as_texts(batch.column("text")), units, vectors)
            yield batches_of({"doc_id": batch.column("doc_id"), "y": batch.column("y"), "x": [r.tobytes() for r in x]}, out)

    rows = sorted(sample.mapInArrow(run, "doc_id long, y int, x binary").orderBy(F.xxhash64("doc_id")).limit(most).collect())
    if not rows:
        return None
    x = np.frombuffer(b"".join(r["x"] for r in rows), np.float32).reshape(len(rows), -1).astype(np.float64)
    y = np.array([float(r["y"] > 0) for r in rows])
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-3
    seen = np.arange(len(x)) % CALIBRATION > 0 if len(x) >= 4 * CALIBRATION else np.ones(len(x), bool)
    layers = train((x[seen] - mean) / spread, y[seen])
    model = Model(units, vectors, mean, spread, layers, 1.0)
    model.temperature = fit_temperature(model.logits(x[~seen]), y[~seen])
    return model


def score(docs: DataFrame, model: Model | None, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; no shuffle."""
    out = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_texts(batch.column("text"))
            yield batches_of({"doc_id": batch.column("doc_id"), "score": model.scores(texts) if model else np.full(len(texts), 0.5)}, out)

    scored = doc_text(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model | None, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, with all their columns, whose score reaches the threshold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = pa.array(model.scores(as_texts(batch.column("text"))) >= threshold) if model else pa.array([True] * batch.num_rows)
            yield batch.filter(good)

    return docs.mapInArrow(run, docs.schema)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
