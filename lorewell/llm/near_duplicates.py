"""Near-duplicate documents by SetSketch registers.

A document's set holds its distinct five-word shingles. A register is an exponentially
spaced, truncated minimum over the set, so sketches of parts merge by maximum. Bands of
registers are bucket keys; two sets of similarity 0.85 (0.8) share none of the 32 bands
with probability 7e-9 (3e-6).

Documents with equal sets are one class. Pairs of classes are formed without listing all
pairs of a bucket: first every class meets one leader, the smallest class of the bucket it
shares most often. Crowded buckets that still hold several components choose a new leader, whom
all members of other components meet, as long as that leaves a tenth fewer members outside. Then,
in buckets that still hold several components, the members outside the largest component meet the
rest, in crowded ones by the rarest shingles that set them apart. A pair goes to the exact test
unless the joint likelihood of both sketches speaks against the limit by e^18; links are
confirmed on full sets, and components follow by contraction. Nothing is collected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorewell.functions.batches import small_batches
from lorewell.llm.common import stored
from lorewell.llm.components import components
from lorewell.llm.repeats import Units, _mix, gram_hashes

BANDS, ROWS = 32, 5
REGISTERS = BANDS * ROWS
BASE = 1.02
TOP = 65_534
DOUBT = 18.0  # nats of likelihood below which a pair is never dropped
CROWDED = 256  # pairs of one bucket from which a shared rare shingle is asked for too
DRAWN, COMMON = 64, 1024  # classes of a crowded group that tell which shingles are common, and how many of these are told
SHINGLE = 5
PART = 65_536  # shingles sketched at once

_WORDS = Units(size=SHINGLE, gram=SHINGLE, words=True, across=False)
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SEEDS = np.random.default_rng(5).integers(1, 2**63, REGISTERS, dtype=np.uint64)


def shingles(text: bytes, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; a shorter text is one shingle; no words, none."""
    buf = np.frombuffer(text.translate(_LOWER), np.uint8)
    starts, ends = _WORDS.spans(buf)
    if not len(starts):
        return np.zeros(0, np.uint64)
    words = _WORDS.hashes(buf, starts, ends)
    return np.unique(gram_hashes(words, k) if len(words) >= k else gram_hashes(words, len(words)) + np.uint64(len(words)))


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """Sketch of each non-empty set: floor(1 - log_b of the smallest exponential value), cut to 0 .. TOP."""
    lengths = np.array([len(s) for s in sets])
    least = np.full((len(sets), REGISTERS), np.iinfo(np.uint64).max, np.uint64)
    every = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), lengths)
    for a in range(0, len(every), PART):
        part, whose = every[a : a + PART], owner[a : a + PART]
        heads = np.flatnonzero(np.append(True, whose[1:] != whose[:-1]))
        own = whose[heads]
        for i, seed in enumerate(_SEEDS):
            least[own, i] = np.minimum(least[own, i], np.minimum.reduceat(_mix((part ^ seed) * np.uint64(0x9E3779B97F4A7C15)), heads))
    value = -np.log1p(-np.clip(least.astype(np.float64) / 2.0**64, 1e-300, 1 - 2**-53))
    return np.clip(np.floor(1 - np.log(value) / np.log(BASE)), 0, TOP).astype("<u2")


def merge_registers(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def keep_pair(one: np.ndarray, two: np.ndarray, n_one: np.ndarray, n_two: np.ndarray, percent: int) -> np.ndarray:
    """False where the joint likelihood of two sketches rules out ``percent`` similarity."""
    more, fewer = (one > two).sum(axis=1), (one < two).sum(axis=1)
    equal = one.shape[1] - more - fewer
    u = n_one / (n_one + n_two)
    grid = np.linspace(0, 1, 201)[None, :] * np.minimum(u / (1 - u), (1 - u) / u)[:, None]

    def part(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    up, down = part(u[:, None] - (1 - u)[:, None] * grid), part((1 - u)[:, None] - u[:, None] * grid)
    log = lambda p: np.log(np.clip(p, 1e-12, 1))
    like = more[:, None] * log(up) + fewer[:, None] * log(down) + equal[:, None] * log(1 - up - down)
    allowed = np.where(grid * 100 >= percent - 0.5, like, -np.inf).max(axis=1)
    return allowed >= like.max(axis=1) - DOUBT


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id, n, set_key, sketch`` per row; the last two are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            sets = [shingles(t or b"") for t in batch.column(1).to_pylist()]
            full = [i for i, s in enumerate(sets) if len(s)]
            sketch = dict(zip(full, registers([sets[i] for i in full])))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                pa.array([sketch[i].tobytes() if i in sketch else None for i in range(len(sets))], pa.binary()),
            ], names=["doc_id", "n", "set_key", "sketch"])

    return _source(docs).mapInArrow(run, "doc_id long, n long, set_key binary, sketch binary")


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").reshape(-1, BANDS, ROWS).astype(np.uint64)
        keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), values.shape[:2]).copy()
        for r in range(ROWS):
            keys = _mix((keys ^ values[:, :, r]) * np.uint64(0xD6E8FEB86659FD93))
        ids = np.repeat(batch.column(0).to_numpy(), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(ids)], names=["bucket", "class_id"])


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Full sets of the wanted classes, from the text of their smallest document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t or b"").tobytes() for t in batch.column(1).to_pylist()], pa.binary())], names=["class_id", "items"])

    return _source(docs).join(wanted, F.col("doc_id") == F.col("class_id"), "left_semi").mapInArrow(run, "class_id long, items binary")


def _links(pairs: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` that hold the limit on full sets."""

    def probable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            if batch.num_rows:
                one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, REGISTERS) for c in (2, 3))
                keep = keep_pair(one, two, batch.column(4).to_numpy().astype(float), batch.column(5).to_numpy().astype(float), percent)
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = ([np.frombuffer(x, np.uint64) for x in batch.column(c).to_pylist()] for c in (2, 3))
            shared = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(one, two)]
            keep = [100 * s >= percent * (len(x) + len(y) - s) for s, x, y in zip(shared, one, two)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sketch = lambda end: classes.select(F.col("class_id").alias(end), F.col("sketch").alias(f"sketch_{end}"), F.col("n").alias(f"n_{end}"))
    items = lambda end: sets.select(F.col("class_id").alias(end), F.col("items").alias(f"items_{end}"))
    sized = pairs.join(sketch("a"), "a").join(sketch("b"), "b").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    likely = sized.select("a", "b", "sketch_a", "sketch_b", "n_a", "n_b").mapInArrow(probable, "a long, b long")
    return likely.join(items("b"), "b").join(items("a"), "a").select("a", "b", "items_a", "items_b").mapInArrow(exact, "a long, b long")


def _mixed(rows: DataFrame) -> DataFrame:
    """``bucket, class_id, root`` of buckets with several components, with the largest one and whether the bucket is crowded."""
    groups = rows.groupBy("bucket", "root").agg(F.count("*").alias("size"))
    mixed = (
        groups.groupBy("bucket").agg(F.max(F.struct("size", "root")).alias("large"), F.sum("size").alias("total"), F.count("*").alias("parts")).where("parts > 1")
        .select("bucket", F.col("large.root").alias("large"), ((F.col("total") - F.col("large.size")) * F.col("total") > CROWDED).alias("crowded"))
    )
    return rows.join(mixed, "bucket")


def _meet(rows: DataFrame) -> DataFrame:
    """Members outside their bucket's largest component with all members of other components."""
    few = rows.where("root <> large").select("bucket", F.col("class_id").alias("x"), F.col("root").alias("root_x"))
    every = rows.select("bucket", F.col("class_id").alias("y"), F.col("root").alias("root_y"))
    return few.join(every, "bucket").where("root_x <> root_y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _differences(own: bytes, base: bytes) -> tuple[int, np.ndarray]:
    """The size of a set, and the shingles that it adds to the base or (inverted) lacks."""
    own, base = np.frombuffer(own, np.uint64), np.frombuffer(base, np.uint64)
    return len(own), np.concatenate([np.setdiff1d(own, base, assume_unique=True), ~np.setdiff1d(base, own, assume_unique=True)]).view(np.int64)


def _common(crowded: DataFrame, sets: DataFrame, base: DataFrame) -> DataFrame:
    """``large, common``: shingles that set several of ``DRAWN`` classes of a group apart, the commonest last.

    It only gives the order of places, and any order gives the same pairs of similar classes.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups: dict[int, list[np.ndarray]] = {}
            for large, own, base in zip(*(c.to_pylist() for c in batch.columns)):
                groups.setdefault(large, []).append(_differences(own, base)[1])
            for large, apart in groups.items():
                item, held = np.unique(np.concatenate(apart), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(item), large), pa.int64()), pa.array(item), pa.array(held, pa.int64())], names=["large", "item", "held"])

    draw = F.row_number().over(Window.partitionBy("large").orderBy(F.xxhash64("class_id"), "class_id"))
    drawn = crowded.where("class_id <> large").select("class_id", "large").withColumn("draw", draw).where(F.col("draw") <= DRAWN)
    both = drawn.join(sets, "class_id").join(base, "large").select("large", "items", "base")
    held = both.mapInArrow(count, "large long, item long, held long").groupBy("large", "item").agg(F.sum("held").alias("held")).where("held > 1")
    most = F.row_number().over(Window.partitionBy("large").orderBy(F.desc("held"), "item"))
    return held.withColumn("most", most).where(F.col("most") <= COMMON).groupBy("large").agg(F.sort_array(F.collect_list(F.struct("held", "item"))).getField("item").alias("common"))


def _places(crowded: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The first M + 1 places of every class's difference, rarest first, in one row; ``d`` is the size of the whole difference."""

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ranked, places = None, np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            kept, sizes, first = [], [], []
            for at in range(batch.num_rows):  # nothing but one row's difference is held beside the batch
                n, apart = _differences(*(batch.column(c)[at].as_buffer() for c in (3, 4)))
                if not len(apart):
                    continue
                if (group := batch.column(2)[at].as_py()) != last:
                    common = batch.column(5)[at].values
                    told = np.zeros(0, np.int64) if common is None else common.to_numpy()
                    last, places = group, np.argsort(told)
                    ranked = told[places]
                rank = np.full(len(apart), -1)
                if len(ranked):
                    near = np.minimum(np.searchsorted(ranked, apart), len(ranked) - 1)
                    rank = np.where(ranked[near] == apart, places[near], -1)
                kept.append(at)
                sizes.append((n, len(apart)))
                first.append(apart[np.lexsort((apart, rank))[: n * (100 - percent) // percent + 1]])
            items = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, first)]), pa.int32()), pa.array(np.concatenate(first) if first else np.zeros(0, np.int64)))
            n, d = (pa.array([size[k] for size in sizes], pa.int32()) for k in range(2))
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(kept, pa.int64())) for c in range(3)] + [n, d, items], names=["class_id", "root", "large", "n", "d", "items"])

    base = sets.select(F.col("class_id").alias("large"), F.col("items").alias("base"))
    both = crowded.where("class_id <> large").join(sets, "class_id").join(base, "large").join(_common(crowded, sets, base), "large", "left")
    return stored(both.select("class_id", "root", "large", "items", "base", "common").mapInArrow(differ, "class_id long, root long, large long, n int, d int, items array<long>"), "places")


def _rare_meet(crowded: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of crowded buckets that the limit leaves possible, by what sets them apart from a reference.

    The reference is the root of the bucket's largest component, and every class meets it.
    A class is described by its *difference*: shingles it adds and shingles it lacks. Two
    similar classes differ in at most T shingles, so their differences share at least
    o = (d_x + d_y - T) / 2; in rare-first order the first shared one then stands at
    place d - o + 1 or before on both sides. If o <= 0 one class is within T / 2 of the reference
    and the other within T, so both are linked to it already.

    T is at most M = n (100 - percent) / percent of either class, and d_x <= d_y + T. So places are cut before
    classes meet: the class with the smaller difference brings its first M / 2 + 1 places, the other one its first
    (M + min(M, d - least d of the group)) / 2 + 1, which leaves out the shingles that many classes share.
    No more than M + 1 places of a class leave its task, however far it is from the reference.
    """
    apart = _places(crowded, sets, percent)
    least = apart.groupBy("large").agg(F.min("d").alias("least"))
    most = F.floor(F.col("n") * (100 - percent) / percent)
    # classes meet their group's least before they are taken apart into places
    sized = stored(apart.join(least, "large").withColumn("first", F.floor(most / 2) + 1).withColumn("bound", F.floor((most + F.least(most, F.col("d") - F.col("least"))) / 2) + 1), "places")

    def side(end: str, bound: str) -> DataFrame:
        own = [F.col("root").alias(f"root_{end}"), F.col("class_id").alias(end), F.col("n").alias(f"n_{end}"), F.col("d").alias(f"d_{end}")]
        return sized.select("large", *own, F.posexplode(F.slice("items", F.lit(1), F.col(bound).cast("int"))).alias(f"place_{end}", "item")).withColumn(f"place_{end}", F.col(f"place_{end}") + 1)

    apart_most = F.floor((F.col("n_x") + F.col("n_y")) * (100 - percent) / (100 + percent))
    shared = F.ceil((F.col("d_x") + F.col("d_y") - apart_most) / 2)
    possible = (shared > 0) & (F.col("place_x") <= F.col("d_x") - shared + 1) & (F.col("place_y") <= F.col("d_y") - shared + 1) & (F.col("root_x") != F.col("root_y"))
    # x is the class with the smaller difference; of two components one is not the largest
    met = side("x", "first").join(side("y", "bound"), ["large", "item"]).where(F.struct("d_x", "x") < F.struct("d_y", "y")).where(possible)
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).unionByName(
        crowded.where("root <> large").select(F.least("class_id", "large").alias("a"), F.greatest("class_id", "large").alias("b"))).distinct()


def _rooted(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(labels.select(F.col("node").alias("class_id"), "root"), "class_id", "left").select("bucket", "class_id", F.coalesce("root", "class_id").alias("root"))


def _new_leaders(rows: DataFrame, turn: int) -> DataFrame:
    """Every crowded bucket's leader of this turn with the members of other components: at most one pair per row."""
    crowded = rows.where("crowded")
    leaders = crowded.groupBy("bucket").agg(F.max(F.struct(F.xxhash64(F.lit(turn), "class_id").alias("draw"), F.col("class_id").alias("leader"), F.col("root").alias("leads"))).alias("l"))
    met = crowded.join(leaders, "bucket").where(F.col("root") != F.col("l.leads"))
    return met.select(F.least("class_id", "l.leader").alias("a"), F.greatest("class_id", "l.leader").alias("b")).distinct()


def _contracted(members: DataFrame, links: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """``links`` with those to further leaders, and the members of buckets that still hold several components.

    Every turn costs one pair per row. Turns end when less than a tenth of the outsiders of
    crowded buckets has been linked; whoever is left is for ``_open_pairs``.
    """
    turn, outside = 0, None
    while True:
        rows = stored(_mixed(_rooted(members, components(links))), "mixed")
        left = rows.where("crowded and root <> large").select("class_id").distinct().count()
        if not left or (outside is not None and 10 * left > 9 * outside):
            return links, rows
        turn, outside = turn + 1, left
        links = stored(links.unionByName(_links(_new_leaders(rows, turn), classes, sets, percent)), "links")


def _open_pairs(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that share a bucket and may still be similar."""
    crowded = rows.where("crowded").select("class_id", "root", "large").distinct()
    return _meet(rows.where("not crowded")).unionByName(_rare_meet(crowded, sets, percent)).distinct()


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """Groups of documents that are linked by 100 * shared >= ``percent`` * united shingles.

    One row per row of ``docs(doc_id, text)``: ``doc_id, n_shingles, component_id`` (smallest
    ``doc_id`` reachable) and ``kept`` (``doc_id`` is that one). Words are lower-cased (A-Z)
    runs of non-space; a text of fewer than five words is one shingle; a null, empty or
    blank text has none and is linked with nothing. A null ``doc_id`` takes no part: its
    component is null and it is kept. Rows that repeat a ``doc_id`` stand for one document
    and are linked if any of their texts is. Other columns are ignored; an empty
    table gives no rows.
    """
    rows = stored(signatures(docs), "signatures")
    full = rows.where(F.col("doc_id").isNotNull() & F.col("set_key").isNotNull())
    keyed = full.groupBy("set_key").agg(F.min("doc_id").alias("class_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = stored(keyed.groupBy("class_id").agg(F.min(F.struct("set_key", "n", "sketch")).alias("s")).select("class_id", "s.n", "s.sketch"), "classes")
    bands = classes.select("class_id", "sketch").mapInArrow(_bands, "bucket long, class_id long")
    shared = bands.groupBy("bucket").agg(F.min("class_id").alias("leader"), F.count("*").alias("size")).where("size > 1").select("bucket", "leader")
    members = stored(bands.join(shared, "bucket"), "members")
    sets = stored(_sets(docs, members.select("class_id").distinct()), "sets")
    leaders = members.where("class_id <> leader").groupBy("class_id", "leader").agg(F.count("*").alias("bands"))
    first = leaders.groupBy("class_id").agg(F.max(F.struct("bands", (-F.col("leader")).alias("minus"))).alias("m")).select((-F.col("m.minus")).alias("a"), F.col("class_id").alias("b"))
    links = stored(_links(first, classes, sets, percent), "links")
    links, rest = _contracted(members, links, classes, sets, percent)
    more = stored(_links(_open_pairs(rest, sets, percent), classes, sets, percent), "links")
    labels = components(links.unionByName(more))
    by_key = keyed.select("set_key", "class_id").join(labels, F.col("class_id") == F.col("node"), "left").select("set_key", F.coalesce("root", "class_id").alias("root"))
    out = rows.join(by_key, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
