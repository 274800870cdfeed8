"""Quality classifier: supervised subword embeddings, trained by numpy gradient descent.

A document is the average of learned vectors: one for each word and for each of
its character n-grams, all hashed into one table. A softmax layer on the
average gives the class. The vectors of a word's n-grams are summed once per
worker and word, so that scoring a text costs a lookup per word.

Training runs on the driver over a bounded sample of the labelled rows
(``sample_rows`` rows of at most ``sample_chars`` characters each); the model
has a fixed size, ``buckets * dim`` floats, whatever the corpus. Scoring is one
map stage over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import mixed

#: Stands for "the same word as the one before" (a word pair of one kind); no text holds it as a word.
SAME = b"\x00 same"
#: Words a worker remembers before it starts anew, and new ones it takes up at a time.
WORDS, NEW = 200_000, 10_000
MULTIPLIER = np.uint64(0x9FB21C651E98DF25)


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 16
    dim: int = 16
    n_min: int = 3
    n_max: int = 5
    epochs: int = 12
    rate: float = 0.4
    #: Bounds of the training sample: rows, taken in the order of a hash of the id, and characters of a row.
    sample_rows: int = 3000
    sample_chars: int = 20_000
    #: Bound of the factor, a document's number of distinct buckets, by which its vectors' steps are lengthened.
    most_steps: int = 200
    seed: int = 7


def grams(words: list[bytes], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, count for each word): each word's own bucket, then those of its n-grams of bytes.

    ``<`` and ``>`` mark the ends of a word, and case counts. Sorted by word.
    """
    text = [b"<%b>" % w for w in words]
    sizes = np.fromiter(map(len, text), np.int64, len(text))
    begin = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(text)), sizes)
    left = np.repeat(begin + sizes, sizes) - np.arange(len(owner))
    data = np.frombuffer(b"".join(text), np.uint8).astype(np.uint64) + np.uint64(1)
    whole = np.fromiter((xxhash.xxh3_64_intdigest(w, 1) for w in words), np.uint64, len(words))
    ids, owners = [whole % np.uint64(s.buckets)], [np.arange(len(words))]
    h = np.zeros(len(data), np.uint64)
    for n in range(1, s.n_max + 1):
        h = h * MULTIPLIER
        h[: len(data) - n + 1] += data[n - 1 :]
        if n >= s.n_min:
            fits = left >= n
            ids.append(mixed(h[fits] + np.uint64(n)) % np.uint64(s.buckets))
            owners.append(owner[fits])
    own = np.concatenate(owners)
    return np.concatenate(ids)[np.argsort(own, kind="stable")].astype(np.int64), np.bincount(own, minlength=len(words))


def tokens(text: str | None) -> list[bytes]:
    words = (text or "").encode("utf-8", "surrogatepass").split()
    return words + [SAME] * sum(map(bytes.__eq__, words, words[1:]))


class Bags(dict):
    """Word to the row of a table of summed vectors; new words get theirs a block at a time."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.new = model, []
        dim = model.settings.dim
        self.sums, self.counts = np.zeros((WORDS, dim), np.float32), np.zeros(WORDS, np.float32)

    def __missing__(self, word: bytes) -> int:
        k = self[word] = len(self)
        self.new.append(word)
        return k

    def rows(self, words: list[bytes]) -> np.ndarray:
        found = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if len(self) > len(self.counts):
            more = max(len(self) - len(self.counts), len(self.counts) // 2)
            self.sums = np.concatenate([self.sums, np.zeros((more, self.sums.shape[1]), np.float32)])
            self.counts = np.concatenate([self.counts, np.zeros(more, np.float32)])
        return found

    def learn(self) -> None:
        at = len(self) - len(self.new)
        for k in range(0, len(self.new), NEW):
            ids, counts = grams(self.new[k : k + NEW], self.model.settings)
            own = slice(at + k, at + k + len(counts))
            self.sums[own] = np.add.reduceat(self.model.vectors[ids], np.cumsum(counts) - counts)
            self.counts[own] = counts
        self.new = []

    def averages(self, texts: list[str | None]) -> np.ndarray:
        if len(self) > WORDS:
            self.clear()
        each = [self.rows(tokens(t)) for t in texts]
        self.learn()
        out = np.zeros((len(texts), self.sums.shape[1]), np.float32)
        for k, rows in enumerate(each):
            if len(rows):
                out[k] = self.sums[rows].sum(0) / self.counts[rows].sum()
        return out


@dataclass
class Model:
    vectors: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    settings: Settings

    def score(self, averages: np.ndarray) -> np.ndarray:
        """Softmax probability of label 1."""
        z = averages @ self.weights + self.bias
        e = np.exp(z - z.max(1, keepdims=True))
        return (e / e.sum(1, keepdims=True))[:, 1].astype(np.float64)


def train(rows: list[tuple[str | None, int]], s: Settings = Settings()) -> Model:
    """Stochastic gradient descent, one document at a time, over (text, 0 or 1)."""
    rng = np.random.default_rng(s.seed)
    vectors = rng.uniform(-1 / s.dim, 1 / s.dim, (s.buckets, s.dim)).astype(np.float32)
    weights, bias = np.zeros((s.dim, 2), np.float32), np.zeros(2, np.float32)
    numbers: dict[bytes, int] = {}
    docs = [np.unique([numbers.setdefault(w, len(numbers)) for w in tokens(text)], return_counts=True) for text, _ in rows]
    ids, sizes = grams(list(numbers), s) if numbers else (np.empty(0, np.int64), np.empty(0, np.int64))
    ids, ends = ids.astype(np.int32), np.cumsum(sizes)
    bags = []
    for (words, counts), (_, label) in zip(docs, rows, strict=True):
        if len(words):
            n = sizes[words]
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            keys, back = np.unique(ids[np.repeat(ends[words] - n, n) + inner], return_inverse=True)
            part = np.bincount(back, weights=np.repeat(counts, n))
            bags.append((keys, (part / part.sum()).astype(np.float32), int(label)))
        else:
            bags.append((np.empty(0, np.int32), np.empty(0, np.float32), int(label)))
    share = np.clip(np.bincount([b[2] for b in bags], minlength=2) / max(1, len(bags)), 1e-3, 1)
    bias += np.log(share).astype(np.float32)
    steps, total = 0, max(1, s.epochs * len(bags))
    for _ in range(s.epochs):
        for k in rng.permutation(len(bags)):
            keys, part, label = bags[k]
            rate = np.float32(s.rate * (1 - steps / total))
            steps += 1
            own = vectors[keys]
            x = part @ own
            z = x @ weights + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back = weights @ p
            weights -= rate * np.outer(x, p)
            bias -= rate * p
            # Averages are small steps for each vector; the length of the bag evens that out, up to ``most_steps``.
            vectors[keys] = own - (rate * min(len(keys), s.most_steps)) * np.outer(part, back)
    return Model(vectors, weights, bias, s)


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text: str, label: str, s: Settings) -> list[tuple[str | None, int]]:
    """The training rows: of the labelled texts of ``sample_chars`` characters at most, the first by a hash of the id.

    Null labels are left out. Longer texts are scored like all others.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(label).cast("int").alias("_label"))
    fit = docs.where(F.length(F.coalesce(F.col(text), F.lit(""))) <= s.sample_chars)
    ids = fit.select(id_col).distinct().join(known, id_col).orderBy(F.xxhash64(F.lit(s.seed), id_col), id_col).limit(s.sample_rows)
    # At most sample_rows ids, so that texts needn't be shuffled to meet them.
    both = fit.select(id_col, text).join(F.broadcast(ids), id_col).groupBy(id_col).agg(F.min(text).alias(text), F.min("_label").alias("_label"))
    return [(r[text], r["_label"]) for r in sorted(both.collect(), key=lambda r: (r[id_col], r[text] or ""))]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_col`` and ``score`` for each row of ``docs``; null and empty texts get the model's score of nothing."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        bags = Bags(m)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                scores = m.score(bags.averages(batch.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=[id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 5, cut: float = 0.3, s: Settings = Settings()) -> DataFrame:
    """``id_col``, ``held_out``, ``score`` and ``predicted`` for each row of ``docs``.

    Rows whose crc32 of the id (as text) is a multiple of ``folds`` are held out
    of training. A null id isn't held out and has no label. Without a labelled
    row every score is that of the prior. Repeated rows get one score each;
    other columns, and the id itself, are no input of a score.
    """
    held = F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0
    rows = sample(docs, labels.where(~held), id_col, text, label, s)
    out = score(docs, train(rows, s), id_col, text)
    return out.select(id_col, F.coalesce(held, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= cut, 1).otherwise(0).alias("predicted"))
