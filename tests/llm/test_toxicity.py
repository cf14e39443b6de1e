"""Label model, classifier and held-out accuracy."""

import random
import zlib

import numpy as np

import odd
from lorewell.llm import toxicity

DOCS = "doc_id long, text string"
LABELS = "doc_id long, toxic int, quality int"


def corpus(n=900):
    """Clean words, insults of the curated list, and inflected insults that only labels reveal."""
    rnd = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        words = odd.words(i, rnd.randint(20, 80)).split()
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                words.insert(rnd.randrange(len(words)), rnd.choice(["idiot", "scum"]) if i % 12 else "zuqqo" + rnd.choice(["ra", "lin", "ment", "s", "et"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic) if rnd.random() > 0.02 else 1 - int(toxic), 1))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, DOCS)
    model = toxicity.train(docs, spark.createDataFrame(labels, LABELS))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    truth = {i: int(i % 6 == 0) for i, _ in rows}
    right = [got[i].predicted == truth[i] for i in got if got[i].held_out]
    assert np.mean(right) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    kept = {r.doc_id for r in toxicity.without_toxic(docs.withColumn("n", docs.doc_id), model).collect()}
    assert kept == {i for i in got if got[i].predicted == 0}


def test_labels_of_the_held_out_fold_are_not_read(spark):
    rows, labels = corpus(300)
    docs = spark.createDataFrame(rows, DOCS)
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y, q) for i, y, q in labels]
    one = toxicity.train(docs, spark.createDataFrame(labels, LABELS))
    two = toxicity.train(docs, spark.createDataFrame(flipped, LABELS))
    assert one.lexicon.names == two.lexicon.names and np.allclose(one.weights, two.weights)


def test_label_model_finds_accuracies_and_correlations():
    rnd = np.random.default_rng(0)
    truth = rnd.random(4000) < 0.3
    say = lambda accuracy: np.where(rnd.random(4000) < accuracy, np.where(truth, 1, -1), np.where(truth, -1, 1))
    good, poor = say(0.9), say(0.6)
    votes = np.stack([good, good, poor, say(0.8)], axis=1)
    labels = np.where(rnd.random(4000) < 0.9, truth, ~truth).astype(int)
    posterior, table, correlation = toxicity.label_model(votes, labels, accuracy=0.9)
    assert abs(table[1][0][2] - 0.9) < 0.05 and abs(table[1][2][2] - 0.6) < 0.08
    assert correlation[0, 1] > 0.95 and abs(correlation[0, 3]) < 0.15
    assert ((posterior > 0.5) == truth).mean() > 0.93


def test_odd_rows_and_missing_labels(spark):
    docs = odd.documents(spark)
    model = toxicity.train(docs, spark.createDataFrame([(1, None, 1), (None, 1, 1), (77, 1, 0)], LABELS))
    out = toxicity.score(docs, model).collect()
    assert len(out) == len(odd.rows()) and all(r.predicted == 0 for r in out)
    angry = spark.createDataFrame([(1, "You IDIOT, worthless scum")], DOCS)
    assert toxicity.score(angry, model).first().predicted == 1
    assert toxicity.score(docs.limit(0), model).count() == 0
