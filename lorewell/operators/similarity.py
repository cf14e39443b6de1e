"""Top-k by cosine similarity, exact and approximate.

Vectors are packed into blocks, blocks meet in an ordinary equi-join on the
tenant (or bucket) key, and each pair of blocks is one matrix product that
keeps only the best ``k`` per question. No (question, chunk) pair outside those
is ever a row. Questions are broadcast when their measured size allows it, so
the chunk vectors are not shuffled at all; otherwise the chunks of a key are dealt
over as many partitions as their count asks for, and the question blocks of such a
key are copied to each. Keys with few chunks, as most are, copy nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorewell.functions.batches import small_batches
from lorewell.operators.ordered import top_per_key
from lorewell.session import BROADCAST_LIMIT_BYTES, fits_broadcast, shared_folder

BLOCK_ROWS = 2048
# Vector bytes waiting in one task over all keys before every open block is written out.
OPEN_BYTES = 32 * 1024 * 1024
# Questions scored against a block of chunks at once, and pairs scored in double precision at once.
TILE_ROWS = 256
PAIRS_AT_ONCE = 4096
# Questions whose best scores a task remembers while it goes through blocks of chunks.
QUESTIONS_HELD = 1 << 17
# Chunks of one key that one task scores against the key's questions.
SALT_ROWS = 1 << 15
# Scores are rounded so that equal vectors tie whatever block they are in.
SCORE_DIGITS = 12

_NO_LOWER, _NO_UPPER = -(2 ** 63), 2 ** 63 - 1


def _micros(column: str):
    return F.unix_micros(F.col(column).cast("timestamp"))


def pack_vectors(
    df: DataFrame, keys: list[str], ident: str, vector: str, extras: list[str], prefix: str, planes: "Planes | None" = None
) -> DataFrame:
    """Rows to blocks ``(keys, <p>_ids, <p>_mat, <p>_<extra>...)`` inside each partition.

    Vectors become unit length; NULL and zero vectors cannot be compared and are
    left out. Extras are stored as lists beside the ids. With ``planes`` a vector
    goes to one block per hash table, keyed by ``hash_table`` and ``bucket`` too.
    """
    key_fields = [df.schema[k] for k in keys]
    if planes:
        key_fields = key_fields + [T.StructField("hash_table", T.IntegerType()), T.StructField("bucket", T.LongType())]
    list_fields = [ident, *extras]
    schema = T.StructType(
        key_fields
        + [T.StructField(f"{prefix}_ids", T.ArrayType(df.schema[ident].dataType))]
        + [T.StructField(f"{prefix}_{e}", T.ArrayType(df.schema[e].dataType)) for e in extras]
        + [T.StructField(f"{prefix}_mat", T.BinaryType())]
    )
    width = len(keys)

    def run(batches):
        open_blocks: dict[tuple, list] = {}
        waiting = 0  # bytes
        arrow = None
        signs = planes.matrix() if planes else None

        def close(target):
            entries = open_blocks.pop(target)
            lists = map(list, zip(*(e[0] for e in entries)))
            row = (*target, *lists, np.concatenate([e[1] for e in entries]).tobytes())
            return pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(row, arrow)], schema=arrow)

        for batch in small_batches(batches):
            if arrow is None:
                types = {f.name: f.type for f in batch.schema}
                arrow = pa.schema(
                    [(k, types[k]) for k in keys] + ([("hash_table", pa.int32()), ("bucket", pa.int64())] if planes else [])
                    + [(f"{prefix}_{'ids' if c == ident else c}", pa.list_(types[c])) for c in list_fields]
                    + [(f"{prefix}_mat", pa.binary())]
                )
            heads = [batch.column(i).to_pylist() for i in range(width + len(list_fields))]
            vectors = batch.column(width + len(list_fields))
            present = vectors.is_valid().to_numpy(zero_copy_only=False)
            # rows of unlike length cannot share a matrix; contract-checked data has one group
            sizes = np.where(present, np.diff(vectors.offsets.to_numpy()), 0)
            starts = np.cumsum(sizes) - sizes
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            records = list(zip(*heads))
            for size in np.unique(sizes[sizes > 0]):
                rows = np.flatnonzero(sizes == size)
                matrix = flat[starts[rows][:, None] + np.arange(size)]
                length = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
                rows, matrix, length = rows[length > 0], matrix[length > 0], length[length > 0]
                codes = planes.codes(signs, matrix) if planes else None
                unit = matrix / length[:, None]
                for i, at in enumerate(rows):
                    record = records[at]
                    key = record[:width]
                    entry = (record[width:], unit[i].copy())  # a view would hold the whole batch
                    for target in ([(*key, t, code) for t, code in enumerate(codes[i])] if planes else [key]):
                        entries = open_blocks.setdefault(target, [])
                        entries.append(entry)
                        waiting += unit[i].nbytes
                        if len(entries) >= BLOCK_ROWS:
                            waiting -= unit[i].nbytes * len(entries)
                            yield close(target)
                    if waiting >= OPEN_BYTES:
                        yield from map(close, list(open_blocks))
                        waiting = 0
        yield from map(close, list(open_blocks))

    return df.select(*keys, ident, *extras, vector).mapInArrow(run, schema)


def _merged_best(best: np.ndarray, row: np.ndarray, score: np.ndarray) -> np.ndarray:
    """The best scores of every question with those of one more block; ``row`` ascends."""
    k = best.shape[1]
    fresh = np.full(best.shape, -np.inf)
    fresh[row, np.arange(len(row)) - np.searchsorted(row, row, side="left")] = score
    return np.partition(np.concatenate([best, fresh], axis=1), k, axis=1)[:, k:]


def _best_pairs(q: np.ndarray, c: np.ndarray, place: np.ndarray, k: int, cut: np.ndarray, allowed: np.ndarray | None):
    """Row, column and score of the best ``k`` of every row by (score desc, place asc) that reach the row's cut.

    Single precision finds the pairs that can be among them, by its largest possible error; only these
    are scored in double precision and compared.
    """
    slack = (q.shape[1] + 8) * 2.0 ** -23
    single = c.astype(np.float32).T
    parts = []
    for start in range(0, len(q), TILE_ROWS):
        rough = q[start:start + TILE_ROWS].astype(np.float32) @ single
        if allowed is not None:
            rough[~allowed[start:start + TILE_ROWS]] = -np.inf
        least = (cut[start:start + TILE_ROWS] - slack).astype(np.float32)
        close = rough >= least[:, None]
        many = np.flatnonzero(np.count_nonzero(close, axis=1) > k)
        if len(many):
            at = rough.shape[1] - k
            kth = np.partition(rough[many], at, axis=1)[:, at] - np.float32(2 * slack)
            close[many] &= rough[many] >= kth[:, None]
        row, col = np.nonzero(close)
        score = np.empty(len(row))
        for i in range(0, len(row), PAIRS_AT_ONCE):
            pairs = slice(i, i + PAIRS_AT_ONCE)
            score[pairs] = np.einsum("ij,ij->i", q[start + row[pairs]], c[col[pairs]])
        score = np.round(score, SCORE_DIGITS)
        # everything tied with the k-th is kept until the ids have decided
        keep = score >= cut[start + row]
        row, col, score = row[keep], col[keep], score[keep]
        order = np.lexsort((place[col], -score, row))
        row, col, score = row[order], col[order], score[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row, side="left") < k
        parts.append((start + row[keep], col[keep], score[keep]))
    return tuple(np.concatenate(p) for p in zip(*parts))


def _places(ids: pa.Array) -> np.ndarray:
    place = np.empty(len(ids), dtype=np.int64)
    place[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
    return place


def _score_blocks(k: int, floor: float, filtered: bool, once: bool):
    """Best pairs of each joined pair of blocks. With ``once`` (a chunk meets a question in one block only)
    a block of questions keeps its best scores, and later chunk blocks give only what reaches them."""

    def run(batches):
        held: dict[tuple, np.ndarray] = {}
        questions_held = 0
        for batch in batches:
            at = {name: i for i, name in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                cell = lambda name: batch.column(at[name])[i]  # noqa: B023, E731
                questions, chunks = cell("q_ids").values, cell("c_ids").values
                q = np.frombuffer(cell("q_mat").as_buffer()).reshape(len(questions), -1)
                c = np.frombuffer(cell("c_mat").as_buffer()).reshape(len(chunks), -1)
                if q.shape[1] != c.shape[1]:
                    raise ValueError(f"question vectors have {q.shape[1]} elements, chunk vectors {c.shape[1]}")
                allowed = None
                if filtered:
                    row = {name: cell(name).as_py() for name in at if not name.endswith(("_ids", "_mat")) or name == "q_doc_ids"}
                    allowed = _allowed(row, len(questions), len(chunks))
                name = tuple(questions.to_pylist()) if once else ()
                best = held.get(name)
                cut = np.full(len(q), floor) if best is None else np.maximum(best.min(axis=1), floor)
                asked, found, score = _best_pairs(q, c, _places(chunks), k, cut, allowed)
                if once:
                    if best is None:
                        best, questions_held = np.full((len(q), k), -np.inf), questions_held + len(q)
                        while held and questions_held > QUESTIONS_HELD:  # their blocks only give more than is needed
                            questions_held -= len(held.pop(next(iter(held))))
                    held[name] = _merged_best(best, asked, score)
                if len(asked):
                    yield pa.RecordBatch.from_arrays(
                        [questions.take(pa.array(asked)), chunks.take(pa.array(found)), pa.array(score)], names=["query_id", "chunk_id", "similarity"])

    return run


def _allowed(row: dict, n_questions: int, n_chunks: int) -> np.ndarray:
    """Which chunks each question may see under its own optional filters."""
    mask = np.ones((n_questions, n_chunks), dtype=bool)
    language, created = np.array(row["c_language"], dtype=object), np.array(row["c_created"], dtype=object)
    documents = np.array(row["c_doc_id"], dtype=object)
    when = np.array([x if x is not None else _NO_LOWER for x in created], dtype=np.int64)
    dated = np.array([x is not None for x in created])
    for i in range(n_questions):
        if row["q_language"][i]:
            mask[i] &= language == row["q_language"][i]
        if row["q_after"][i] is not None:
            mask[i] &= dated & (when >= row["q_after"][i])
        if row["q_before"][i] is not None:
            mask[i] &= dated & (when <= row["q_before"][i])
        if row["q_doc_ids"][i]:
            mask[i] &= np.isin(documents, row["q_doc_ids"][i])
    return mask


def _dealt(chunks: DataFrame, q: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Chunks with a salt, and question blocks copied to each salt of their key; keys of up to ``SALT_ROWS`` chunks have one.

    Only larger keys are listed, one row for ``SALT_ROWS`` chunks at least. The list is stored, so that
    Spark knows its size and broadcasts it only if it is small.
    """
    path = shared_folder(chunks.sparkSession, "salts")
    counted = chunks.groupBy(*keys).agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("_salts")).where("_salts > 1")
    counted.write.parquet(path)
    salts = chunks.sparkSession.read.schema(counted.schema).parquet(path)
    n = F.coalesce("_salts", F.lit(1))
    # The salt belongs to the row, not to its block: a repeated task may
    # build other blocks but sends every row to the same place.
    salted = chunks.join(salts, keys, "left").withColumn("_salt", F.pmod(F.xxhash64("chunk_id"), n).cast("int"))
    copies = q.join(salts, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), n - 1)))
    return salted.drop("_salts"), copies.drop("_salts")


def top_k_join(
    questions: DataFrame,
    chunks: DataFrame,
    keys: list[str],
    k: int,
    min_similarity: float,
    filtered: bool = False,
    broadcast_limit: int = BROADCAST_LIMIT_BYTES,
    dimension: int | None = None,
) -> DataFrame:
    """Best ``k`` chunks per question among chunks with equal ``keys``.

    ``questions(keys, query_id, qvec)`` and ``chunks(keys, chunk_id, embedding)``.
    With ``filtered`` questions also carry ``doc_ids, language, uploaded_after,
    uploaded_before`` and chunks ``doc_id, language, created_at``; an absent or
    empty filter admits everything. With ``dimension`` given, the size check
    counts rows without computing the question vectors.
    """
    if filtered:
        questions = questions.withColumn("after", _micros("uploaded_after")).withColumn("before", _micros("uploaded_before"))
        chunks = chunks.withColumn("created", _micros("created_at"))
    q_extras = ["doc_ids", "language", "after", "before"] if filtered else []
    c_extras = ["doc_id", "language", "created"] if filtered else []
    q = pack_vectors(questions, keys, "query_id", "qvec", q_extras, "q")

    # 8 bytes per element once packed, plus ids and document filters
    elements = F.lit(dimension) if dimension else F.greatest(F.size("qvec"), F.lit(0))
    payload = elements.cast("long") * 8 + 64
    if filtered:
        payload = payload + F.greatest(F.size("doc_ids"), F.lit(0)).cast("long") * 48
    if fits_broadcast(questions, payload, broadcast_limit):
        pairs = pack_vectors(chunks, keys, "chunk_id", "embedding", c_extras, "c").join(F.broadcast(q), keys)
    else:
        salted, copies = _dealt(chunks, q, keys)
        on = [*keys, "_salt"]
        pairs = pack_vectors(salted, on, "chunk_id", "embedding", c_extras, "c").join(copies, on)

    scored = _scored_pairs(pairs, k, min_similarity, filtered, once=True)
    return top_per_key(scored, ["query_id"], [F.desc("similarity"), F.asc("chunk_id")], k)


def _scored_pairs(pairs: DataFrame, k: int, min_similarity: float, filtered: bool = False, once: bool = False) -> DataFrame:
    """Joined blocks to the best pairs of each pair of blocks."""
    types = [pairs.schema[c].dataType.elementType for c in ("q_ids", "c_ids")]
    schema = T.StructType([
        T.StructField("query_id", types[0]), T.StructField("chunk_id", types[1]), T.StructField("similarity", T.DoubleType()),
    ])
    needed = [c for c in pairs.columns if c.startswith(("q_", "c_"))]
    return pairs.select(*needed).mapInArrow(_score_blocks(k, min_similarity, filtered, once), schema)


# ---------------------------------------------------------------- approximate

def plane_sign(table: int, bit: int, element: int) -> int:
    """Fixed +-1 hyperplane entries from a multiplicative rule, the same in every task."""
    mixed = (table * 7919 + bit * 104729 + element * 1299709 + 15485863) * 2654435761 % (1 << 32)
    return 1 if (mixed >> 16) % 2 else -1


@dataclass(frozen=True)
class Planes:
    """Hash tables of random hyperplanes; a bucket is the sign pattern of a vector in one table."""

    dimension: int
    tables: int = 8
    bits: int = 4

    def matrix(self) -> np.ndarray:
        return np.array([
            [plane_sign(t, b, e) for e in range(self.dimension)] for t in range(self.tables) for b in range(self.bits)
        ], dtype=np.float64)

    def codes(self, signs: np.ndarray, vectors: np.ndarray) -> list[list[int]]:
        on = (vectors @ signs.T > 0).reshape(-1, self.tables, self.bits)
        return (on @ (1 << np.arange(self.bits))).tolist()


def build_index(chunks: DataFrame, keys: list[str], planes: Planes) -> DataFrame:
    """Packed blocks per (keys, hash table, bucket), to be stored once and searched often.

    The rebalance hint gathers a tenant's rows for full blocks and splits a hot
    tenant over several tasks. Written with ``partitionBy("hash_table",
    "bucket")``, a search reads only the buckets its questions fall into.
    """
    usable = chunks.select(*keys, "chunk_id", "embedding").filter(F.size("embedding") == planes.dimension)
    grouped = usable.hint("rebalance", *keys).sortWithinPartitions(*keys)
    return pack_vectors(grouped, keys, "chunk_id", "embedding", [], "c", planes)


def search_index(
    questions: DataFrame, index: DataFrame, keys: list[str], planes: Planes, k: int, min_similarity: float,
    broadcast_limit: int = BROADCAST_LIMIT_BYTES,
) -> DataFrame:
    """Candidates share a bucket in some table; their scores are exact.

    Each bucket is a list of blocks, so a hot one is spread and no candidate is
    dropped. A pair found in several tables is kept once.
    """
    usable = questions.select(*keys, "query_id", "qvec").filter(F.size("qvec") == planes.dimension)
    q = pack_vectors(usable, keys, "query_id", "qvec", [], "q", planes)
    payload = F.lit((planes.dimension * 8 + 64) * planes.tables).cast("long")
    small = fits_broadcast(questions, payload, broadcast_limit)
    pairs = index.join(F.broadcast(q) if small else q, [*keys, "hash_table", "bucket"])
    once = _scored_pairs(pairs, k, min_similarity).groupBy("query_id", "chunk_id").agg(F.max("similarity").alias("similarity"))
    return top_per_key(once, ["query_id"], [F.desc("similarity"), F.asc("chunk_id")], k)


def approximate_top_k(
    questions: DataFrame, chunks: DataFrame, keys: list[str], planes: Planes, k: int, min_similarity: float
) -> DataFrame:
    """Index and search in one go; only worthwhile as a check, as a stored index saves the scan."""
    return search_index(questions, build_index(chunks, keys, planes), keys, planes, k, min_similarity)


def recall_at_k(exact: DataFrame, approximate: DataFrame) -> DataFrame:
    """Share of the exact hits of each question that the approximate search found."""
    got = approximate.select("query_id", "chunk_id", F.lit(1).alias("_hit"))
    return (
        exact.select("query_id", "chunk_id").join(got, ["query_id", "chunk_id"], "left")
        .groupBy("query_id")
        .agg(F.count("*").alias("n_exact"), F.count("_hit").alias("n_found"))
        .withColumn("recall", F.round(F.col("n_found") / F.col("n_exact"), 6))
    )
