"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. A line's potential adds weights of its own binned features and of those of the line before
and after it; a transition weight joins neighbouring labels. Marginals from the forward-backward recursion, weighted with
the lines' lengths, give the document's mean, and a two-parameter logistic turns it into the score.

Labels exist for documents only. Training starts with every line labelled as its document, then moves lines
of bad documents to good where the model says so (the line of a bad document with the smallest marginal stays bad), and fits again.
It uses a bounded sample of labelled rows: at most SAMPLE documents of each label, those with the smallest md5 of doc_id, whole
texts. Everything else covers all rows. Scores depend on the text alone.

Defined results: null and empty texts have one empty line; a null doc_id is scored and not held out; repeated rows are scored
alike; without labels of both kinds every score is the share of label 1 among labels, or 0.5; an empty table gives no rows;
further columns are ignored. Memory: a chunk of texts, with the longest one whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.llm import shared, textnum

SAMPLE, THRESHOLD, BINS, ROUNDS, STEPS = 1500, 0.3, 8, 3, 120


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=np.uint8)
    out[[ord(c) for c in chars]] = 1
    return out


_KINDS = [
    _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("abcdefghijklmnopqrstuvwxyz"), _table("0123456789"), _table(".,;:'\"()-"), _table("!?"),
    _table("#$%&*@^~+=_\\"), _table("|<>[]{}/"), np.array([b >= 128 for b in range(256)], dtype=np.uint8),
]
FEATURES = ("length", "upper", "lower", "digits", "stops", "shouts", "signs", "frames", "foreign", "words", "word_length", "distinct", "seen", "sentences", "capital")


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines (rows), their lengths in bytes, and each text's bounds in lines."""
    n, texts = len(data), len(offsets) - 1
    breaks = np.flatnonzero(data == 10) + 1
    own = np.searchsorted(offsets, breaks - 1, side="right") - 1  # the text of each line feed
    breaks = breaks[breaks < offsets[own + 1]] if len(breaks) else breaks  # a last line feed starts no line
    starts = np.sort(np.concatenate((offsets[:-1], breaks)))
    bounds = np.searchsorted(starts, offsets[:-1], side="left")
    # empty texts share a first byte with the next text: count them one by one
    line_text = np.searchsorted(breaks, offsets[:-1], side="left") + np.arange(texts)
    bounds = np.append(line_text, len(starts))
    stops = np.append(starts[1:], n)
    lengths = stops - starts
    size = np.maximum(lengths, 1).astype(np.float64)

    def count(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return sums[stops] - sums[starts]

    kinds = [count(k[data]) for k in _KINDS]
    hashes, first, last, _ = textnum.words(data, np.append(starts, n))
    at = np.searchsorted(first, np.append(starts, n))
    words = np.diff(at)
    line_of = np.repeat(np.arange(len(starts)), words)
    pairs = (hashes >> np.uint64(24)) | (line_of.astype(np.uint64) << np.uint64(40))
    pairs.sort()
    fresh = np.ones(len(pairs), dtype=bool)
    fresh[1:] = pairs[1:] != pairs[:-1]
    distinct = np.bincount((pairs[fresh] >> np.uint64(40)).astype(np.int64), minlength=len(starts))[: len(starts)]
    many = np.maximum(words, 1)
    whole = np.zeros(len(starts), dtype=np.uint64)
    if len(hashes):
        odd = hashes * (np.arange(len(hashes), dtype=np.uint64) - at[line_of].astype(np.uint64) + np.uint64(3))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(odd)))
        whole = sums[at[1:]] - sums[at[:-1]]
    text_of = np.repeat(np.arange(texts), np.diff(bounds))
    order = np.lexsort((np.arange(len(starts)), whole, text_of))
    again = np.zeros(len(starts), dtype=bool)
    again[order[1:]] = (whole[order[1:]] == whole[order[:-1]]) & (text_of[order[1:]] == text_of[order[:-1]]) & (words[order[1:]] > 0)
    letters = np.maximum(kinds[0] + kinds[1], 1)
    head = np.zeros(len(starts))
    some = lengths > 0
    head[some] = _KINDS[0][data[starts[some]]]
    columns = [
        np.log2(size), kinds[0] / letters, kinds[1] / size, kinds[2] / size, kinds[3] / many, kinds[4] / many, kinds[5] / many, kinds[6] / many, kinds[7] / size,
        np.log2(many), lengths / many, distinct / many, again.astype(float), count(_table(".")[data]) / many, head,
    ]
    return np.stack(columns, axis=1), lengths, bounds


@dataclass
class Model:
    edges: list[np.ndarray]
    own: np.ndarray
    before: np.ndarray
    after: np.ndarray
    transitions: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def bins(self, features: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, features[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def unary(self, bins: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        js = np.arange(bins.shape[1])
        own = self.own[js, bins].sum(axis=1)
        left, right = self.before[js, bins].sum(axis=1), self.after[js, bins].sum(axis=1)
        out = own.copy()
        out[1:] += left[:-1]
        out[:-1] += right[1:]
        inner = bounds[1:-1]
        inner = inner[(inner > 0) & (inner < len(out))]
        out[inner] -= left[inner - 1]  # nothing crosses from one text to the next
        out[inner - 1] -= right[inner]
        return out

    def score(self, mean: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * logit(mean) + self.shift)))


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def forward_backward(unary: np.ndarray, bounds: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(line is good), and the summed pair probabilities (2 x 2). Texts advance together, line by line."""
    sizes = np.diff(bounds)
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = bounds[:-1][order], sizes[order]
    n = len(unary)
    if not n:
        return np.zeros(0), np.zeros((2, 2))
    # ratios of good to bad, scaled so that each pair sums to 1
    e = np.exp(np.clip(unary, -30, 30))
    emit = np.stack((1 / (1 + e), e / (1 + e)), axis=1)
    trans = np.exp(transitions)
    alpha, beta = np.empty((n, 2)), np.ones((n, 2))
    longest = int(sizes[0])
    active = np.searchsorted(-sizes, -np.arange(longest), side="left")  # texts with more than t lines
    for t in range(longest):
        at = starts[: active[t]] + t
        a = emit[at] if t == 0 else (alpha[at - 1] @ trans) * emit[at]
        alpha[at] = a / a.sum(axis=1, keepdims=True)
    for t in range(longest - 2, -1, -1):
        at = starts[: active[t + 1]] + t
        b = (beta[at + 1] * emit[at + 1]) @ trans.T
        beta[at] = b / b.sum(axis=1, keepdims=True)
    both = alpha * beta
    both /= both.sum(axis=1, keepdims=True)
    inner = np.ones(n, dtype=bool)
    inner[bounds[1:] - 1] = False
    at = np.flatnonzero(inner)
    pair = alpha[at][:, :, None] * trans[None] * (emit[at + 1] * beta[at + 1])[:, None, :]
    pair /= pair.sum(axis=(1, 2), keepdims=True)
    return both[:, 1], pair.sum(axis=0)


def means(p: np.ndarray, lengths: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    w = np.maximum(lengths, 1).astype(float)
    return np.add.reduceat(p * w, bounds[:-1]) / np.add.reduceat(w, bounds[:-1])


def fit(features: np.ndarray, lengths: np.ndarray, bounds: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> Model:
    """weights: of the documents, for the calibration."""
    edges = [np.unique(np.quantile(features[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(features.shape[1])]
    edges = [np.unique(np.concatenate((e, [0.5]))) if len(e) < 2 else e for e in edges]
    k = features.shape[1]
    model = Model(edges, *(np.zeros((k, BINS + 1)) for _ in range(3)), np.zeros((2, 2)))
    bins = model.bins(features)
    sizes = np.diff(bounds)
    doc = np.repeat(np.arange(len(labels)), sizes)
    y = labels[doc].astype(float)
    inner = np.ones(len(y), dtype=bool)
    inner[bounds[1:] - 1] = False
    at = np.flatnonzero(inner)
    flat = bins + np.arange(k) * (BINS + 1)
    width = k * (BINS + 1)
    n = len(labels)
    for _ in range(ROUNDS):
        params = np.concatenate((model.own.ravel(), model.before.ravel(), model.after.ravel(), model.transitions.ravel()))
        first = second = np.zeros_like(params)
        yi = y.astype(int)
        seen = np.bincount(yi[at] * 2 + yi[at + 1], minlength=4).astype(float)
        for step in range(1, STEPS + 1):
            p, pairs = forward_backward(model.unary(bins, bounds), bounds, model.transitions)
            r = y - p
            left, right = np.zeros_like(r), np.zeros_like(r)
            left[at] = r[at + 1]  # a line's features also act on the next line, and on the one before
            right[at + 1] = r[at]
            grad = np.concatenate([*(np.bincount(flat.ravel(), np.repeat(x, k), width) for x in (r, left, right)), seen - pairs.ravel()]) / n - 0.002 * params
            first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad * grad
            params = params + 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
            parts = np.split(params, [width, 2 * width, 3 * width])
            model.own, model.before, model.after = (x.reshape(k, -1) for x in parts[:3])
            model.transitions = parts[3].reshape(2, 2)
        p, _ = forward_backward(model.unary(bins, bounds), bounds, model.transitions)
        worst = np.minimum.reduceat(p, bounds[:-1])[doc]
        y = np.where(labels[doc] == 1, 1.0, ((p > 0.5) & (p > worst)).astype(float))
    z = logit(means(p, lengths, bounds))
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton's steps of a logistic with a small prior on the slope
        q = 1 / (1 + np.exp(-(a * z + b)))
        g = np.array([((labels - q) * z * weights).sum() - 0.01 * (a - 1), ((labels - q) * weights).sum() - 0.01 * b])
        v = q * (1 - q) * weights
        h = np.array([[(v * z * z).sum() + 0.01, (v * z).sum()], [(v * z).sum(), v.sum() + 0.01]])
        da, db = np.linalg.solve(h, g)
        a, b = float(np.clip(a + np.clip(da, -1, 1), 0.05, 10)), float(b + np.clip(db, -2, 2))
    model.slope, model.shift = a, b
    return model


def sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in textnum.chunks(batch.column("text")):
            x, lengths, bounds = line_features(data, offsets)
            cut = [slice(bounds[i], bounds[i + 1]) for i in range(b - a)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(a, b - a), "quality": batch.column("quality").slice(a, b - a), "x": [x[c].astype("<f4").tobytes() for c in cut], "lengths": [lengths[c].astype("<i8").tobytes() for c in cut]})


def held_out(doc_id):
    """The fold that training never sees: crc32 of the id's text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | float:
    """The model, or the share of label 1 where labels of both kinds are missing."""
    own = labels.where("quality in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    counts = {r["quality"]: r["n"] for r in own.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return float(next(iter(counts), 0.5))
    drawn = [own.where(f"quality = {q}").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(sample) for q in (0, 1)]
    few = F.broadcast(drawn[0].union(drawn[1]))  # at most two times ``sample`` rows
    rows = docs.select("doc_id", "text").join(few, "doc_id").mapInArrow(sample_features, "doc_id long, quality int, x binary, lengths binary").toArrow().to_pylist()
    rows = sorted({(r["doc_id"], r["quality"], r["x"], r["lengths"]) for r in rows})
    y = np.array([r[1] for r in rows])
    if len(set(y.tolist())) < 2:
        return float(y.mean()) if len(y) else 0.5
    x = np.concatenate([np.frombuffer(r[2], "<f4").reshape(-1, len(FEATURES)) for r in rows]).astype(float)
    lengths = np.concatenate([np.frombuffer(r[3], "<i8") for r in rows])
    bounds = np.concatenate(([0], np.cumsum([len(r[3]) // 8 for r in rows])))
    share = counts[1] / (counts[0] + counts[1])
    weights = np.where(y == 1, share / (y == 1).mean(), (1 - share) / (y == 0).mean())
    return fit(x, lengths, bounds, y, weights)


def scorer(model: Model | float):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in textnum.chunks(batch.column("text")):
                x, lengths, bounds = line_features(data, offsets)
                if isinstance(model, float):
                    out = np.full(b - a, model)
                else:
                    x = x.astype("<f4").astype(float)
                    p, _ = forward_backward(model.unary(model.bins(x), bounds), bounds, model.transitions)
                    out = model.score(means(p, lengths, bounds))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in batch.schema.names), pa.array(out, pa.float64()), pa.array(np.diff(bounds), pa.int64())], [*batch.schema.names, "__score", "__n_lines"])

    return score


def score_documents(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",), sample: int = SAMPLE) -> DataFrame:
    """The columns ``keep`` and text with __score and __n_lines."""
    shared.bounded_batches(docs.sparkSession, rows=1000, mb=8)
    model = train(docs, labels, sample)
    rows = docs.select(*keep, *(["text"] if "text" not in keep else []))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(scorer(model), f"{fields}, __score double, __n_lines long")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    scored = score_documents(docs, labels, sample=sample)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= threshold).cast("int").alias("predicted"), F.col("__n_lines").alias("n_lines"))
