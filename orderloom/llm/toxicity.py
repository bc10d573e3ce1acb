"""Toxicity: a convolutional text classifier in numpy over hashed word embeddings.

Filters of several widths slide over the words' embeddings, each filter's maximum over the whole text goes through a
rectifier, and a dense layer gives the logit. A bounded sample of labelled rows is fitted in one task; a part of it
that takes no part in the fit turns logits to probabilities and finds a threshold for each language. All texts are then
scored whole on the executors: the product of embeddings and filters is one table of the model, so a filter's value at
a place is a sum of its table rows.

Inputs of a score are the words alone. Edge cases: null and empty texts score like a text without words, from the bias;
very long texts are scored whole, in chunks that overlap by a filter's width; rows without a label are only scored;
repeated labels of a document count once, as the largest; without labels of both kinds every score is the share of
label 1, 0 if there is none; repeated rows score alike; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import bounded_sample, packed, release_memory

BUCKETS = 1 << 17
DIMENSIONS = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
#: At most so many labelled rows, first in the order of a hash of doc_id, are fitted.
FIT_ROWS = 14_000
CHUNK = 1 << 16
BLANK = bytes(b if chr(b).isalnum() or b >= 128 else 32 for b in range(256))
PAD = 0
BEGINNING = 4


def held_out(doc_id: Column) -> Column:
    """Rows that no fit may see: crc32 of doc_id as text leaves 1 modulo 3."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


class Words:
    """Numbers of a text's words, as they come, and the two buckets of each: of the word and of its beginning.

    Beginnings let inflected forms share what was learned. Word 0 is the pad.
    """

    def __init__(self, buckets: int):
        self.buckets, self.known, self.pairs = buckets, {}, [(PAD, PAD)]

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode().lower().translate(BLANK).split()
        known = self.known
        for w in set(words).difference(known):
            known[w] = len(self.pairs)
            self.pairs.append((1 + zlib.crc32(w) % (self.buckets - 1), 1 + zlib.crc32(b"^" + w[:BEGINNING]) % (self.buckets - 1)))
        return np.fromiter(map(known.__getitem__, words), np.int32, len(words))

    def both(self) -> np.ndarray:
        return np.array(self.pairs, np.int32)


@dataclass
class Model:
    """Weights; also the map from logit to probability, and thresholds by language."""

    embedding: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    dense: np.ndarray
    bias: float
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)
    constant: float | None = None

    def tables(self) -> list[list[np.ndarray]]:
        return [[self.embedding @ part for part in f] for f in self.filters]

    @staticmethod
    def of_words(tables: list[list[np.ndarray]], pairs: np.ndarray) -> list[list[np.ndarray]]:
        """Table rows of words from those of their buckets."""
        return [[t[pairs[:, 0]] + t[pairs[:, 1]] for t in parts] for parts in tables]

    def pooled(self, words: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        """Maxima of all filters over one text; the text stands between pads, so each width has a place."""
        out = []
        for parts, bias in zip(tables, self.biases):
            width = len(parts)
            line = np.concatenate((words, np.full(max(width - len(words), 0), PAD, np.int32))) if len(words) < width else words
            best = np.full(FILTERS, -np.inf, np.float32)
            for at in range(0, len(line) - width + 1, CHUNK):
                n = min(CHUNK, len(line) - width + 1 - at)
                total = parts[0][line[at:at + n]]
                for j in range(1, width):
                    total = total + parts[j][line[at + j:at + j + n]]
                np.maximum(best, total.max(0), out=best)
            out.append(best + bias)
        return np.concatenate(out)

    def logits(self, lines: list[np.ndarray], tables: list[list[np.ndarray]]) -> np.ndarray:
        return np.array([np.maximum(self.pooled(w, tables), 0) @ self.dense + self.bias for w in lines], float)

    def probability(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * logits + self.shift, -30, 30)))


class _Adam:
    def __init__(self, rate: float):
        self.rate, self.state, self.step = rate, {}, 0

    def move(self, name: str, weights: np.ndarray, gradient: np.ndarray, rows: np.ndarray | None = None) -> None:
        m, v = self.state.setdefault(name, (np.zeros_like(weights), np.zeros_like(weights)))
        at = slice(None) if rows is None else rows
        m[at] = 0.9 * m[at] + 0.1 * gradient
        v[at] = 0.99 * v[at] + 0.01 * gradient * gradient
        weights[at] -= self.rate * m[at] / (np.sqrt(v[at]) + 1e-7)


def fit(lines: list[np.ndarray], labels: np.ndarray, buckets: int = BUCKETS, epochs: int = 4, least_steps: int = 400, batch: int = 64, rate: float = 0.02, seed: int = 7) -> Model:
    """Train on texts given as arrays of the two buckets of each word. The first embedding dimension starts from the buckets' smoothed log odds."""
    rng = np.random.default_rng(seed)
    seen = [np.zeros(buckets), np.zeros(buckets)]
    for words, label in zip(lines, labels):
        seen[int(label)][np.unique(words)] += 1
    totals = [max(1, int((labels == c).sum())) for c in (0, 1)]
    odds = np.log((seen[1] + 0.5) / (totals[1] + 1)) - np.log((seen[0] + 0.5) / (totals[0] + 1))
    odds[(seen[0] + seen[1]) < 2] = 0
    model = Model(rng.normal(0, 0.05, (buckets, DIMENSIONS)).astype(np.float32),
                  [rng.normal(0, 0.2, (w, DIMENSIONS, FILTERS)).astype(np.float32) for w in WIDTHS],
                  [np.zeros(FILTERS, np.float32) for _ in WIDTHS], rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32), -1.0)
    model.embedding[:, 0] = np.clip(odds, -2, 4) / 4
    model.embedding[PAD] = 0
    for f in model.filters:
        f[0, 0, 0] = 1.0
        f[1:, :, 0] = 0.0
    model.dense[::FILTERS] = 1.0
    adam, gap = _Adam(rate), max(WIDTHS)
    bias = np.array([model.bias], np.float32)
    for _ in range(max(epochs, -(-least_steps * batch // max(1, len(lines))))):
        order = rng.permutation(len(lines))
        for at in range(0, len(order), batch):
            mine = order[at:at + batch]
            parts, starts, n = [], [], 0
            for i in mine:
                starts.append(n)
                parts += [lines[i], np.full((gap, 2), PAD, np.int32)]
                n += len(lines[i]) + gap
            flat, starts = np.concatenate(parts), np.array(starts)
            ends = np.append(starts[1:], n)
            rows = model.embedding[flat[:, 0]] + model.embedding[flat[:, 1]]
            pooled, places = [], []
            for f, b in zip(model.filters, model.biases):
                w = len(f)
                total = np.zeros((n, FILTERS), np.float32)
                for j in range(w):
                    total[:n - j] += rows[j:] @ f[j]
                # A place counts if its first word belongs to the text; a text without words has its pads.
                length = np.maximum(ends - starts - gap - (w - 1), 1)
                alive = np.zeros(n + 1, np.int32)
                np.add.at(alive, starts, 1)
                np.add.at(alive, starts + length, -1)
                total[np.cumsum(alive[:n]) == 0] = -np.inf
                best = np.maximum.reduceat(total, starts, axis=0)
                owner = np.repeat(np.arange(len(mine)), ends - starts)
                hit_row, hit_col = np.nonzero(total == best[owner])
                place = np.zeros((len(mine), FILTERS), np.int64)
                place[owner[hit_row[::-1]], hit_col[::-1]] = hit_row[::-1]
                pooled.append(best + b)
                places.append(place)
            z = np.concatenate(pooled, 1)
            hidden = np.maximum(z, 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ model.dense + bias[0], -30, 30)))
            error = ((p - labels[mine]) / len(mine)).astype(np.float32)
            back = error[:, None] * model.dense[None] * (z > 0)
            adam.move("dense", model.dense, hidden.T @ error)
            adam.move("bias", bias, np.array([error.sum()], np.float32))
            touched, moves = [], []
            for i, (f, b) in enumerate(zip(model.filters, model.biases)):
                g, place = back[:, i * FILTERS:(i + 1) * FILTERS], places[i]
                grad = np.zeros_like(f)
                for j in range(len(f)):
                    at_words = np.minimum(place + j, n - 1)
                    e = rows[at_words]
                    grad[j] = np.einsum("df,dfk->kf", g, e)
                    move = (g[:, :, None] * f[j].T[None]).reshape(-1, DIMENSIONS)
                    touched += [flat[at_words, 0].ravel(), flat[at_words, 1].ravel()]
                    moves += [move, move]
                adam.move(f"filter{i}", f, grad)
                adam.move(f"bias{i}", b, g.sum(0))
            ids, inverse = np.unique(np.concatenate(touched), return_inverse=True)
            total = np.zeros((len(ids), DIMENSIONS), np.float32)
            np.add.at(total, inverse, np.concatenate(moves))
            total[ids == PAD] = 0
            used = np.abs(total).sum(1) > 0
            adam.move("embedding", model.embedding, total[used], ids[used])
    model.bias = float(bias[0])
    return model


def calibrate(model: Model, logits: np.ndarray, labels: np.ndarray, languages: list[str], least: int = 30) -> None:
    """Map logits to probabilities by logistic regression on rows that were not fitted, then one threshold a language.

    A language's threshold is where its F1 is best, the middle of the gap; languages with fewer than `least` rows of
    label 1 take the threshold of all rows together, under "".
    """
    a, b = 1.0, 0.0
    ones = labels.sum()
    target = np.where(labels > 0, (ones + 1) / (ones + 2), 1 / (len(labels) - ones + 2))  # keeps the slope finite where nothing overlaps
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * logits + b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-6)
        x = np.stack((logits, np.ones_like(logits)), 1)
        step = np.linalg.solve((x * w[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (target - p) - 1e-3 * np.array([a - 1, b]))
        step *= min(1.0, 1 / np.abs(step).max()) if np.abs(step).max() else 1.0
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-6:
            break
    if np.isfinite(a) and np.isfinite(b) and a > 0:
        model.scale, model.shift = float(a), float(b)
    score = model.probability(logits)

    def best(mine: np.ndarray) -> float:
        order = np.argsort(-score[mine], kind="stable")
        s, y = score[mine][order], labels[mine][order]
        hits = np.cumsum(y)
        f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
        f1[:-1][s[:-1] == s[1:]] = -1
        k = int(np.argmax(f1))
        return float((s[k] + (s[k + 1] if k + 1 < len(s) else 0)) / 2)

    kinds = np.array(languages, dtype=object)
    if labels.sum():
        model.thresholds[""] = best(np.ones(len(labels), bool))
    for kind in set(languages):
        mine = kinds == kind
        if kind and labels[mine].sum() >= least:
            model.thresholds[kind] = best(mine)


def _fitted(rows: list[dict], buckets: int) -> Model:
    """Fit and calibrate on rows of doc_id, lang, toxic and words (the buckets' bytes), a fifth of them for calibration."""
    rows = sorted({r["doc_id"]: r for r in sorted(rows, key=lambda r: r["words"])}.values(), key=lambda r: zlib.crc32(b"fit%d" % r["doc_id"]))
    y = np.array([min(1, max(0, int(r["toxic"]))) for r in rows], float)
    if len(set(y)) < 2:
        return Model(np.zeros((1, DIMENSIONS), np.float32), [], [], np.zeros(0), 0.0, constant=float(y.mean()) if len(y) else 0.0)
    x = [np.frombuffer(r["words"], np.int32).reshape(-1, 2) for r in rows]
    split = len(x) - len(x) // 5
    if len(set(y[:split])) < 2 or len(set(y[split:])) < 2:
        split = len(x)
    model = fit(x[:split], y[:split], buckets)
    test = slice(split, None) if split < len(x) else slice(None)
    flat, back = np.unique(np.concatenate([np.zeros(1, np.int64), *[w[:, 0].astype(np.int64) << 32 | w[:, 1] for w in x[test]]]), return_inverse=True)
    flat = np.stack((flat >> 32, flat & 0xFFFFFFFF), 1)
    numbers = np.split(back[1:].astype(np.int32), np.cumsum([len(w) for w in x[test]])[:-1])
    calibrate(model, model.logits(numbers, model.of_words(model.tables(), flat)), y[test], [r["lang"] for r in rows][test])
    return model


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, buckets: int = BUCKETS) -> Model:
    """Fit and calibrate on labelled rows that are not held out, fit_rows at most, in one task; only the model is sent back."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out(F.col("doc_id")))
    sample = bounded_sample(known, fit_rows, "doc_id")
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit("")
    rows = (docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(lang, F.lit("")).alias("lang"))
            .join(F.broadcast(sample), "doc_id"))  # fit_rows bounds the broadcast

    def lines(text: pd.Series) -> pd.Series:
        words = Words(buckets)
        numbers = [words(t) for t in text]
        pairs = words.both()
        return pd.Series([pairs[n].tobytes() for n in numbers], dtype=object)

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _fitted([r for batch in batches for r in batch.to_dict("records")], buckets)
        yield pd.DataFrame({"model": [pickle.dumps(model)]})
        release_memory()

    hashed = rows.select("doc_id", "lang", "toxic", F.pandas_udf(lines, "binary")("text").alias("words"))
    got = hashed.repartition(1).mapInPandas(learn, "model binary").collect()
    return pickle.loads(got[0]["model"]) if got else _fitted([], buckets)


def score(docs: DataFrame, model: Model, buckets: int = BUCKETS, kept: list[str] | None = None) -> DataFrame:
    """row (the columns kept) and the score of every row."""
    row = packed(docs, *(kept or ["doc_id"]))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    if model.constant is not None:
        return docs.select(row, F.lit(model.constant).alias("score"))
    light = Model(np.zeros((0, DIMENSIONS), np.float32), [], model.biases, model.dense, model.bias, model.scale, model.shift)
    sent = docs.sparkSession.sparkContext.broadcast((light, model.tables()))

    def run(column: pd.Series) -> pd.Series:
        shared, tables = sent.value
        out = []
        for at in range(0, len(column), 2_000):  # bounds the word table
            words = Words(buckets)
            lines = [words(t) for t in column[at:at + 2_000]]
            out.append(shared.logits(lines, shared.of_words(tables, words.both())))
        return pd.Series(shared.probability(np.concatenate(out)) if out else [], dtype=float)

    return docs.select(row, F.pandas_udf(run, "double")(text).alias("score"))


def toxicity_report(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= threshold) of every document."""
    return score(docs, train(docs, labels)).select(
        "row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Whole rows of documents whose score is below the threshold of their language."""
    model = train(docs, labels)
    if model.constant is not None:
        return docs
    common = F.lit(model.thresholds.get("", 0.5))
    own = {k: v for k, v in model.thresholds.items() if k}
    limit = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in own.items() for x in pair]), F.col("row.lang").cast("string")), common) if own and "lang" in docs.columns else common
    return score(docs, model, kept=docs.columns).where(F.col("score") < limit).select("row.*")
