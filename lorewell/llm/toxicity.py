"""Toxicity scores from weak supervision.

1. Features of a text are its words and the 4, 5 and 6 letter beginnings of longer words
   (stems of inflected abuse). Training rows tell which features mark toxic texts: the
   lexicon, the ``LEXICON`` best by the likelihood ratio of their counts.
2. Many voters look at a text: lexicon groups by kind and precision, a curated list, density,
   variety, absence, and surface patterns. Each votes toxic, clean or nothing.
3. A generative label model estimates by EM how each voter votes given the unseen class (the
   label of a training row is one more voter, of known accuracy), and how votes are correlated
   within a class; a voter's evidence is divided by its summed correlations.
4. A linear classifier is fitted to the model's posterior labels and scores every text.

Steps 1 to 4 use at most ``SAMPLE`` labelled rows, those with the smallest hash of their id, from the
training fold only. All texts are scored whole. Labels, language, source and id are no inputs.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorewell.llm.merges import Cache

SAMPLE = 12_000
LEXICON = 600
SLICE = 1024  # rows of the fit held as 8-byte numbers
LABEL_ACCURACY = 0.97
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"

# Common abuse, known without any label.
CURATED = (
    "clown", "creep", "disgusting", "dumb", "fool", "garbage", "hate", "idiot", "imbecile", "jerk", "loser", "moron",
    "pathetic", "scum", "stupid", "trash", "ugly", "vermin", "worthless",
)
STEMS = (4, 5, 6)
WORDS = re.compile(r"[^\W\d_]+").findall


def features_of(word: str) -> tuple[str, ...]:
    return (f"w:{word}", *(f"{n}:{word[:n]}" for n in STEMS if len(word) > n))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


@dataclass
class Lexicon:
    """Chosen features in order of strength, and the third of precision each belongs to."""

    names: list[str]
    third: list[int]

    def __post_init__(self) -> None:
        places = {name: i for i, name in enumerate(self.names)}
        curated = set(CURATED)
        self.of_word = Cache(lambda w: (tuple(places[f] for f in features_of(w) if f in places), w in curated))

    @property
    def voter_names(self) -> list[str]:
        kinds = ["w", *map(str, STEMS)]
        return [f"{k}/{t}" for k in kinds for t in range(3)] + ["curated", "dense", "very dense", "varied", "no strong", "none", "weak only", "shouting", "exclaiming"]

    def look(self, text: str) -> tuple[list[tuple[int, int]], list[int]]:
        """Counts of lexicon features in a text, and the votes on it (1 toxic, -1 clean, 0 none)."""
        words = WORDS(text.lower())
        known = self.of_word
        hits = [(w, h) for w in words if (h := known[w])[0] or h[1]]
        counts = Counter(f for _, (found, _) in hits for f in found)
        groups = Counter((self.names[f].split(":")[0], self.third[f]) for f in counts)
        votes = [int(groups[(k, t)] > 0) for k in ["w", *map(str, STEMS)] for t in range(3)]
        strong = [w for w, (found, listed) in hits if listed or any(self.third[f] == 0 for f in found)]
        share = len(strong) / max(len(words), 1)
        letters = sum(map(len, words))
        votes += [
            int(any(listed for _, (_, listed) in hits)), int(share >= 0.005), int(share >= 0.02), int(len(set(strong)) >= 2),
            0 if strong else -1, 0 if hits else -1, -1 if hits and not strong else 0,
            int(letters > 20 and sum(map(str.isupper, text)) > 0.5 * letters), int("!!" in text),
        ]
        return sorted(counts.items()), votes


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray
    bias: float

    def score(self, text: str) -> float:
        counts, votes = self.lexicon.look(text)
        total = self.bias + float(self.weights[len(self.lexicon.names) :] @ np.array(votes))
        total += sum(self.weights[f] * np.log1p(c) for f, c in counts)
        return float(1 / (1 + np.exp(-np.clip(total, -40, 40))))


def label_model(votes: np.ndarray, labels: np.ndarray, accuracy: float = LABEL_ACCURACY, rounds: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of the toxic class per row, P(vote | class) per voter, and correlations of voters within a class."""
    n, m = votes.shape
    one_hot = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
    label_odds = np.where(labels == 1, 1, -1) * np.log(accuracy / (1 - accuracy))
    posterior = np.where(labels == 1, accuracy, 1 - accuracy)
    share = np.ones(m)
    for _ in range(rounds):
        prior = np.clip(posterior.mean(), 1e-3, 1 - 1e-3)
        table = np.stack([(one_hot * w[:, None, None]).sum(axis=0) + 0.5 for w in (1 - posterior, posterior)])
        table /= table.sum(axis=2, keepdims=True)
        evidence = np.einsum("nmv,mv->nm", one_hot, np.log(table[1]) - np.log(table[0]))
        expected = (1 - posterior)[:, None] * np.einsum("mv,v->m", table[0], [-1.0, 0.0, 1.0]) + posterior[:, None] * np.einsum("mv,v->m", table[1], [-1.0, 0.0, 1.0])
        rest = votes - expected
        scale = np.sqrt((rest**2).mean(axis=0)) + 1e-9
        correlation = (rest / scale).T @ (rest / scale) / n
        share = 1 / np.maximum(np.abs(correlation).sum(axis=1), 1.0)
        odds = np.log(prior / (1 - prior)) + evidence @ share + label_odds
        posterior = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
    return posterior, table, correlation


def logistic(x: np.ndarray, target: np.ndarray, ridge: float = 1.0, rounds: int = 15) -> np.ndarray:
    """Weights of a ridge logistic regression on soft labels; the last one is the bias. ``x`` is read in slices of rows."""
    width = x.shape[1]
    penalty = np.append(np.full(width, ridge), 1e-3)
    w = np.zeros(width + 1)
    for _ in range(rounds):
        curved, slope = np.zeros((width + 1, width + 1)), np.zeros(width + 1)
        for a in range(0, len(x), SLICE):
            part = np.hstack([x[a : a + SLICE], np.ones((len(x[a : a + SLICE]), 1))])
            p = 1 / (1 + np.exp(-np.clip(part @ w, -30, 30)))
            curved += part.T @ (part * np.maximum(p * (1 - p), 1e-4)[:, None])
            slope += part.T @ (target[a : a + SLICE] - p)
        step = np.linalg.solve(curved + np.diag(penalty), slope - penalty * w)
        w += step * min(1.0, 10 / (np.abs(step).max() + 1e-12))
    return w


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def _text(raw: bytes | None) -> str:
    return (raw or b"").decode("utf-8", "replace")


def learn_lexicon(training: DataFrame, positives: int, negatives: int, size: int = LEXICON) -> Lexicon:
    """Features at least twice as frequent in toxic texts, by the likelihood ratio of their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, every = Counter(), Counter()
            for raw, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = {f for w in set(WORDS(_text(raw).lower())) for f in features_of(w)}
                every.update(found)
                toxic.update(found if y else ())
            yield pa.RecordBatch.from_arrays([pa.array(every.keys(), pa.string()), pa.array(every.values(), pa.int64()), pa.array([toxic[f] for f in every], pa.int64())], names=["feature", "n", "toxic"])

    counts = training.select("text", "toxic").mapInArrow(run, "feature string, n long, toxic long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("toxic").alias("pos"))
    pos, neg, n = F.col("pos"), F.col("n") - F.col("pos"), F.col("n")
    share = positives / (positives + negatives)
    surprise = 2 * (pos * F.log(pos / (n * share)) + F.when(neg > 0, neg * F.log(neg / (n * (1 - share)))).otherwise(0.0))
    best = (
        counts.where((pos >= 3) & (pos > 2 * share * n)).withColumn("surprise", surprise).where(F.col("surprise") >= 8)
        .withColumn("precision", (pos + 0.5) / (n + 1)).orderBy(F.desc("surprise"), "feature").limit(size).select("feature", "precision").collect()
    )
    return Lexicon([r["feature"] for r in best], [0 if r["precision"] >= 0.9 else 1 if r["precision"] >= 0.6 else 2 for r in best])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled rows outside the held-out fold."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = known.where(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    training = _source(docs).join(F.broadcast(chosen), "doc_id")  # at most ``sample`` rows of two numbers
    by_class = {r["toxic"]: r["n"] for r in training.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    plain = Lexicon([], [])
    voters = len(plain.voter_names)
    if not (by_class.get(0) and by_class.get(1)):
        weights = np.zeros(voters)
        weights[plain.voter_names.index("curated")] = 6.0
        return Model(plain, weights, -3.0)
    lexicon = learn_lexicon(training, by_class[1], by_class[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = [lexicon.look(_text(raw)) for raw in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([[f for f, _ in c] for c, _ in seen], pa.list_(pa.int32())), pa.array([[n for _, n in c] for c, _ in seen], pa.list_(pa.int32())), pa.array([v for _, v in seen], pa.list_(pa.int32())), batch.column(1)],
                names=["features", "counts", "votes", "toxic"])

    rows = training.select("text", "toxic").mapInArrow(run, "features array<int>, counts array<int>, votes array<int>, toxic int").toArrow()
    y, n = rows.column("toxic").to_numpy(), rows.num_rows
    column = lambda name: rows.column(name).combine_chunks().flatten().to_numpy()
    votes = column("votes").reshape(n, voters)
    posterior, _, _ = label_model(votes, y)
    # the one matrix on the driver: at most ``sample`` rows of 4-byte numbers
    x = np.zeros((n, len(lexicon.names) + voters), np.float32)
    x[:, len(lexicon.names) :] = votes
    x[np.repeat(np.arange(n), np.diff(rows.column("features").combine_chunks().offsets.to_numpy())), column("features")] = np.log1p(column("counts"))
    del rows, votes
    w = logistic(x, posterior)
    return Model(lexicon, w[:-1], float(w[-1]))


def score(self, text: str) -> float:
        counts, votes = self.lexicon.look(text)
        total = self.bias + float(self.weights[len(self.lexicon.names) :] @ np.array(votes))
        total += sum(self.weights[f] * np.log1p(c) for f, c in counts)
        return float(1 / (1 + np.exp(-np.clip(total, -40, 40))))


def label_model(votes: np.ndarray, labels: np.ndarray, accuracy: float = LABEL_ACCURACY, rounds: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of the toxic class per row, P(vote | class) per voter, and correlations of voters within a class."""
    n, m = votes.shape
    one_hot = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
    label_odds = np.where(labels == 1, 1, -1) * np.log(accuracy / (1 - accuracy))
    posterior = np.where(labels == 1, accuracy, 1 - accuracy)
    share = np.ones(m)
    for _ in range(rounds):
        prior = np.clip(posterior.mean(), 1e-3, 1 - 1e-3)
        table = np.stack([(one_hot * w[:, None, None]).sum(axis=0) + 0.5 for w in (1 - posterior, posterior)])
        table /= table.sum(axis=2, keepdims=True)
        evidence = np.einsum("nmv,mv->nm", one_hot, np.log(table[1]) - np.log(table[0]))
        expected = (1 - posterior)[:, None] * np.einsum("mv,v->m", table[0], [-1.0, 0.0, 1.0]) + posterior[:, None] * np.einsum("mv,v->m", table[1], [-1.0, 0.0, 1.0])
        rest = votes - expected
        scale = np.sqrt((rest**2).mean(axis=0)) + 1e-9
        correlation = (rest / scale).T @ (rest / scale) / n
        share = 1 / np.maximum(np.abs(correlation).sum(axis=1), 1.0)
        odds = np.log(prior / (1 - prior)) + evidence @ share + label_odds
        posterior = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
    return posterior, table, correlation


def logistic(x: np.ndarray, target: np.ndarray, ridge: float = 1.0, rounds: int = 15) -> np.ndarray:
    """Weights of a ridge logistic regression on soft labels; the last one is the bias. ``x`` is read in slices of rows."""
    width = x.shape[1]
    penalty = np.append(np.full(width, ridge), 1e-3)
    w = np.zeros(width + 1)
    for _ in range(rounds):
        curved, slope = np.zeros((width + 1, width + 1)), np.zeros(width + 1)
        for a in range(0, len(x), SLICE):
            part = np.hstack([x[a : a + SLICE], np.ones((len(x[a : a + SLICE]), 1))])
            p = 1 / (1 + np.exp(-np.clip(part @ w, -30, 30)))
            curved += part.T @ (part * np.maximum(p * (1 - p), 1e-4)[:, None])
            slope += part.T @ (target[a : a + SLICE] - p)
        step = np.linalg.solve(curved + np.diag(penalty), slope - penalty * w)
        w += step * min(1.0, 10 / (np.abs(step).max() + 1e-12))
    return w


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def _text(raw: bytes | None) -> str:
    return (raw or b"").decode("utf-8", "replace")


def learn_lexicon(training: DataFrame, positives: int, negatives: int, size: int = LEXICON) -> Lexicon:
    """Features at least twice as frequent in toxic texts, by the likelihood ratio of their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, every = Counter(), Counter()
            for raw, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = {f for w in set(WORDS(_text(raw).lower())) for f in features_of(w)}
                every.update(found)
                toxic.update(found if y else ())
            yield pa.RecordBatch.from_arrays([pa.array(every.keys(), pa.string()), pa.array(every.values(), pa.int64()), pa.array([toxic[f] for f in every], pa.int64())], names=["feature", "n", "toxic"])

    counts = training.select("text", "toxic").mapInArrow(run, "feature string, n long, toxic long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("toxic").alias("pos"))
    pos, neg, n = F.col("pos"), F.col("n") - F.col("pos"), F.col("n")
    share = positives / (positives + negatives)
    surprise = 2 * (pos * F.log(pos / (n * share)) + F.when(neg > 0, neg * F.log(neg / (n * (1 - share)))).otherwise(0.0))
    best = (
        counts.where((pos >= 3) & (pos > 2 * share * n)).withColumn("surprise", surprise).where(F.col("surprise") >= 8)
        .withColumn("precision", (pos + 0.5) / (n + 1)).orderBy(F.desc("surprise"), "feature").limit(size).select("feature", "precision").collect()
    )
    return Lexicon([r["feature"] for r in best], [0 if r["precision"] >= 0.9 else 1 if r["precision"] >= 0.6 else 2 for r in best])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled rows outside the held-out fold."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = known.where(~held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    training = _source(docs).join(F.broadcast(chosen), "doc_id")  # at most ``sample`` rows of two numbers
    by_class = {r["toxic"]: r["n"] for r in training.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    plain = Lexicon([], [])
    voters = len(plain.voter_names)
    if not (by_class.get(0) and by_class.get(1)):
        weights = np.zeros(voters)
        weights[plain.voter_names.index("curated")] = 6.0
        return Model(plain, weights, -3.0)
    lexicon = learn_lexicon(training, by_class[1], by_class[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = [lexicon.look(_text(raw)) for raw in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([[f for f, _ in c] for c, _ in seen], pa.list_(pa.int32())), pa.array([[n for _, n in c] for c, _ in seen], pa.list_(pa.int32())), pa.array([v for _, v in seen], pa.list_(pa.int32())), batch.column(1)],
                names=["features", "counts", "votes", "toxic"])

    rows = training.select("text", "toxic").mapInArrow(run, "features array<int>, counts array<int>, votes array<int>, toxic int").collect()
    votes, y = np.array([r["votes"] for r in rows]), np.array([r["toxic"] for r in rows])
    x = np.zeros((len(rows), len(lexicon.names)), np.float64)
    for i, r in enumerate(rows):
        x[i, r["features"]] = np.log1p(r["counts"])
    posterior, _, _ = label_model(votes, y)
    w = logistic(np.hstack([x, votes]), posterior)
    return Model(lexicon, w[:-1], float(w[-1]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every whole text of ``docs(doc_id, text)``.

    A null text is empty and gets the score of an empty text; a null ``doc_id`` is kept and
    counts as not held out; repeated rows give repeated results; other columns are
    ignored; an empty table gives no rows. Without labels of both classes only the
    curated list scores.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(_text(raw)) for raw in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return _source(docs).select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, SCHEMA)


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with all columns, less the rows whose score is 0.5 or more."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            yield batch.filter(pa.array([model.score(_text(raw)) < 0.5 for raw in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
