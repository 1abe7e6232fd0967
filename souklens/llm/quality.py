"""Document quality from a linear-chain conditional random field over lines (operator 10).

Every line of a text is good or bad; a line's potential comes from its own features and those of the lines before and
after it, and neighbouring labels are tied by transition weights.  Training takes a document's label for each of its
lines.  The forward-backward marginals, weighted by line length, give the document's score.

Defined cases: a null text is an empty text, and an empty text is one empty line, so it gets a score too.  Labels that
are null or contradict each other, and labels of unknown documents, teach nothing.  With no usable label of either kind
the model is flat and every score is 0.5.  Rows are scored one by one: repeated rows get equal scores, and other columns
pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from souklens.llm.text import chunks

OWN = 17
WIDTH = 3 * OWN + 3
SAMPLE_DOCS = 4_000   # bound of the labelled rows that the model is fitted on
THRESHOLD = 0.3
_STEPS, _RATE, _PENALTY = 250, 0.15, 1e-4


def _classes() -> bytes:
    def kind(b: int) -> str:
        c = chr(b)
        if b >= 128:
            return "n"
        if c.isupper():
            return "u"
        if c.islower():
            return "l"
        if c.isdigit():
            return "d"
        if c in " \t\r\x0b\x0c":
            return "s"
        if c in "|!":
            return c
        return "p" if c in ".,;:?'\"()-" else "y"
    return "".join(map(kind, range(256))).encode()


_CLASSES = _classes()
_COUNTED = (b"u", b"d", b"y", b"|", b"!", b"n", b"s", b"p")


def line_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Features of each line (lines x WIDTH, float32) and the lines' weights (bytes plus one)."""
    lines = text.split(b"\n")
    own = np.zeros((len(lines), OWN), np.float32)
    weight = np.empty(len(lines))
    seen_lines, seen_pairs = set(), set()
    for i, line in enumerate(lines):
        n = len(line)
        weight[i] = n + 1
        words = line.split()
        if not words:
            own[i, 14] = 1
            continue
        kinds = line.translate(_CLASSES)
        pairs = set(zip(words, words[1:]))
        k = len(words)
        own[i] = (*[kinds.count(c) / n for c in _COUNTED], np.log1p(k) / 5, n / k / 10, 1 - len(set(words)) / k,
                  1 - (len(pairs) + 1) / k, len(pairs & seen_pairs) / (len(pairs) or 1), line in seen_lines, 0,
                  97 <= words[0][0] <= 122, np.log1p(n) / 8)
        seen_lines.add(line)
        seen_pairs |= pairs
    all_ = np.zeros((len(lines), WIDTH), np.float32)
    all_[:, :OWN] = own
    all_[1:, OWN:2 * OWN] = own[:-1]
    all_[:-1, 2 * OWN:3 * OWN] = own[1:]
    all_[0, 3 * OWN] = all_[-1, 3 * OWN + 1] = 1
    all_[:, 3 * OWN + 2] = 1
    return all_, weight


def forward_backward(unary: list[np.ndarray], tie: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each chain, given the potential of "good" against "bad" for its lines and the 2 x 2 tie of neighbours: the
    probability that each line is good, the log partition sums, and the expected numbers of the four neighbour pairs.

    All chains advance together, longest first, so a step is one array operation."""
    sizes = np.array([len(u) for u in unary])
    order = np.argsort(-sizes, kind="stable")
    longest = int(sizes.max(initial=0))
    alive = np.searchsorted(-sizes[order], -np.arange(longest), "left")  # chains with more than t lines
    starts = np.concatenate([[0], np.cumsum(sizes[order])])[:-1]
    flat = np.concatenate([unary[k] for k in order]) if len(order) else np.zeros(0)
    pot = np.stack([np.zeros_like(flat), flat], 1)
    ahead, back = np.zeros_like(pot), np.zeros_like(pot)
    for t in range(longest):
        at = starts[:alive[t]] + t
        ahead[at] = pot[at] if t == 0 else pot[at] + _lse(ahead[at - 1][:, :, None] + tie, 1)
    log_z = np.zeros(len(order))
    log_z[order] = _lse(ahead[starts + sizes[order] - 1], 1) if len(order) else 0
    for t in range(longest - 2, -1, -1):
        at = starts[:alive[t + 1]] + t
        back[at] = _lse(tie + (pot + back)[at + 1][:, None, :], 2)
    z = np.repeat(log_z[order], sizes[order])
    good = np.exp(ahead[:, 1] + back[:, 1] - z)
    pairs = np.zeros((len(order), 2, 2))
    inner = np.ones(len(flat), bool)
    inner[starts] = False
    at = np.flatnonzero(inner)
    chain = np.repeat(order, sizes[order])[at]
    p = np.exp(ahead[at - 1][:, :, None] + tie + (pot + back)[at][:, None, :] - z[at][:, None, None])
    for a in (0, 1):
        for b in (0, 1):
            pairs[:, a, b] = np.bincount(chain, p[:, a, b], len(order))
    out: list = [None] * len(order)
    for k, s in zip(order.tolist(), starts.tolist()):
        out[k] = good[s:s + sizes[k]]
    return out, log_z, pairs


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


class LineField:
    """A fitted field: feature weights, neighbour ties and the scaling of the features."""

    def __init__(self, weights: np.ndarray, tie: np.ndarray, mean: np.ndarray, scale: np.ndarray):
        self.weights, self.tie, self.mean, self.scale = weights, tie, mean, scale

    @classmethod
    def fit(cls, chains: list[np.ndarray], labels: list[int]) -> "LineField":
        """Gradient steps (Adam) on the conditional log-likelihood; each document counts the same."""
        mean, scale = np.zeros(WIDTH), np.ones(WIDTH)
        weights, tie = np.zeros(WIDTH), np.zeros((2, 2))
        if len(set(labels)) < 2:
            return cls(weights, tie, mean, scale)
        flat = np.concatenate(chains).astype(np.float64)
        mean, scale = flat.mean(0), flat.std(0) + 1e-3
        mean[-1], scale[-1] = 0, 1
        flat = (flat - mean) / scale
        sizes = np.array([len(c) for c in chains])
        ends, y = np.cumsum(sizes), np.array(labels, float)
        share = np.repeat(1 / sizes, sizes) / len(sizes)
        same = np.zeros((len(sizes), 2, 2))
        same[np.arange(len(sizes)), y.astype(int), y.astype(int)] = sizes - 1
        want = np.repeat(y, sizes)
        first, second = np.zeros(WIDTH + 4), np.zeros(WIDTH + 4)
        for step in range(1, _STEPS + 1):
            good, _, pairs = forward_backward(np.split(flat @ weights, ends[:-1]), tie)
            g = np.concatenate([flat.T @ ((want - np.concatenate(good)) * share) - _PENALTY * weights,
                                (((same - pairs) / sizes[:, None, None]).mean(0) - _PENALTY * tie).ravel()])
            first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
            move = _RATE * (1 - step / (_STEPS + 1)) * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-8)
            weights, tie = weights + move[:WIDTH], tie + move[WIDTH:].reshape(2, 2)
        return cls(weights, tie, mean, scale)

    def line_marginals(self, texts: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each text: the probability that each of its lines is good, and the lines' weights."""
        made = [line_features(t) for t in texts]
        w = self.weights / self.scale
        shift = float(self.mean @ w)
        return forward_backward([x @ w - shift for x, _ in made], self.tie)[0], [n for _, n in made]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        good, weight = self.line_marginals(texts)
        return np.array([min(1.0, max(0.0, float(g @ n / n.sum()))) for g, n in zip(good, weight)])


def is_held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_on_labels(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE_DOCS) -> LineField:
    """Fit on at most ``most`` labelled documents that are not held out, taken in the order of a hash of their ids; only
    their line features reach the driver."""
    known = (labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out())
             .groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("other"))
             .filter("y = other").select("doc_id", F.col("y").cast("int").alias("y"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches, "text", 1 << 20):
            rows = [line_features(t)[0] for t in texts]
            yield pa.record_batch([part.column(0), part.column(1), pa.array([r.tobytes() for r in rows], pa.binary())],
                                  ["doc_id", "y", "x"])

    sample = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", "y", "text")
    got = sorted(((r["doc_id"], r["y"], bytes(r["x"])) for r in
                  sample.mapInArrow(features, f"doc_id {_type(docs, 'doc_id')}, y int, x binary").toLocalIterator()))
    return LineField.fit([np.frombuffer(x, np.float32).reshape(-1, WIDTH) for _, _, x in got], [y for _, y, _ in got])


def _type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def score_quality(docs: DataFrame, field: LineField, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) for every row of ``docs(doc_id, text)``."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches, "text", 2 << 20):
            s = field.scores(texts)
            yield pa.record_batch([part.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                                  ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(
        score, f"doc_id {_type(docs, 'doc_id')}, score double, predicted int")


def keep_good(docs: DataFrame, field: LineField, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text scores ``threshold`` or more, all columns as they are."""
    place = docs.columns.index("text")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            renamed = batch.rename_columns([f"c{i}" for i in range(batch.num_columns)])
            for part, texts in chunks(iter([renamed]), f"c{place}", 2 << 20):
                yield part.filter(pa.array(field.scores(texts) >= threshold)).rename_columns(batch.schema.names)

    return docs.mapInArrow(pick, docs.schema)


def op10_line_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    field = fit_on_labels(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, field).select("doc_id", is_held_out().alias("held_out"), "score", "predicted")
