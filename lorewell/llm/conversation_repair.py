"""Cheapest repair of the turn structure of conversations.

A repair keeps, reroles or deletes every row and inserts empty ones, so that the initials of the
roles read ``(s?(ua)+)?``. Its edits form a path over nodes (rows read, state of that pattern):

1. a cost DP from the end gives every node the least cost of finishing, for all conversations
   of a batch at once, one row of each per step;
2. arcs that keep this cost are *optimal*; every path over them is a cheapest repair;
3. prefix-doubling path ranking finds the ASCII-least audit among them: nodes are ranked by the
   least audits of 1, 2, 4, 8, ... letters that start there. A pointer leads from a node over the
   letters ranked so far; of several, those to the node of least rank are kept and doubled.

Conversations are dealt by id and sorted; a task holds the rows of a few at a time. One of more than
``LONG`` rows is cut into pieces by range instead: each piece gives the least costs between its first
and last states, these are added up from the end over one small row a piece, and every piece
then ranks its own paths for all states it may be entered in. Only its text is hashed in one stream, as a
hash must be.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.llm.common import partitions, stored

LONG = 20_000  # rows of a conversation held at once
SPACE = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)  # states: nothing yet, or the last role
STATES = 4
EDITS = "DIKR"  # delete, insert, keep, rerole: in ASCII order
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5  # costs
NO = 1 << 40
NULL_ID = -(1 << 63)  # stands for a null id among long conversations

# Row codes: what the row's initial is, and whether it is truncated or must go.
OTHER, INITIALS = 0, {"s": 1, "u": 2, "a": 3}
MUST_GO, IS_TRUNCATED = 8, 4

_EXPECTED = np.array([USER, USER, ASSISTANT, USER])  # state after the next user or assistant
_KEPT = np.full((4, STATES), -1)  # state after keeping an initial
_KEPT[1, START] = SYSTEM
_KEPT[2, [START, SYSTEM, ASSISTANT]] = USER
_KEPT[3, USER] = ASSISTANT
_LEGAL = {"su", "ua", "au"}

SCHEMA = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, gone`` after the damage; a dropped row stays as a mark (``gone``) of its conversation."""
    said = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return said.withColumn("kind", kind).select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"),
        F.explode(F.array_repeat(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def is_blank(text: str) -> bool:
    return not text.strip(SPACE)


def is_truncated(text: str) -> bool:
    return text.rstrip(SPACE)[-1:] not in (".", "!", "?")


def _moves(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Target state and cost of D, K, R from every state of rows with the given codes: arrays (rows, 3, states)."""
    n = len(code)
    target = np.empty((n, 3, STATES), np.int64)
    cost = np.empty((n, 3, STATES), np.int64)
    target[:, 0], cost[:, 0] = np.arange(STATES), DELETE
    kept = _KEPT[code & 3]
    late = np.where(code & IS_TRUNCATED, TRUNCATED, 0)[:, None]
    stay = np.where(code & MUST_GO, NO, 0)[:, None]
    target[:, 1], cost[:, 1] = np.maximum(kept, 0), np.where(kept < 0, NO, late + stay)
    target[:, 2], cost[:, 2] = _EXPECTED, REROLE + late + stay
    return target, cost


def _with_insertions(cost: np.ndarray) -> np.ndarray:
    """Least cost where rows may also be inserted before going on (twice at most: a third undoes the first)."""
    for _ in range(2):
        cost = np.minimum(cost, INSERT + cost[..., _EXPECTED])
    return cost


_FINISH = _with_insertions(np.array([0, NO, NO, 0]))


def finishing_costs(code: np.ndarray, length: np.ndarray, ends: np.ndarray = _FINISH) -> np.ndarray:
    """Least cost of finishing from every node, (rows + conversations, states); a conversation of n rows has n + 1 nodes.

    ``ends``: the costs of the last nodes.
    """
    nodes = length + 1
    last = np.cumsum(nodes) - 1
    cost = np.empty((int(nodes.sum()), STATES), np.int64)
    cost[last] = ends
    row_of = last - np.arange(len(length))  # rows before the end of each conversation
    by = np.argsort(-length, kind="stable")
    for t in range(1, int(length.max(initial=0)) + 1):
        use = by[: int(np.searchsorted(-length[by], -t, "right"))]
        target, price = _moves(code[row_of[use] - t])
        ahead = np.take_along_axis(np.broadcast_to(cost[last[use] - t + 1][:, None, :], price.shape), target, axis=2)
        cost[last[use] - t] = _with_insertions((price + ahead).min(axis=1))
    return cost


def optimal_arcs(code: np.ndarray, length: np.ndarray, cost: np.ndarray, final: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``source, label, target`` of the arcs on cheapest paths; labels are places in ``EDITS``. Node (i, q) is 4 i + q.

    Unless ``final``, what is inserted at the last nodes belongs to the piece that follows.
    """
    count = len(cost)
    last = np.cumsum(length + 1) - 1
    inner = np.setdiff1d(np.arange(count), last, assume_unique=True)  # nodes that have a row
    target, price = _moves(code)
    ahead = np.take_along_axis(np.broadcast_to(cost[inner + 1][:, None, :], price.shape), target, axis=2)
    node = lambda i, q: i * STATES + q
    found = []
    for k, label in ((0, 0), (1, 2), (2, 3)):
        row, state = np.nonzero((price[:, k] + ahead[:, k] == cost[inner]) & (cost[inner] < NO))
        found.append((node(inner[row], state), np.full(len(row), label), node(inner[row] + 1, target[row, k, state])))
    may_insert = np.ones(count, bool)
    may_insert[last] = final
    at, state = np.nonzero((INSERT + cost[:, _EXPECTED] == cost) & (cost < NO) & may_insert[:, None])
    found.append((node(at, state), np.full(len(at), 1), node(at, _EXPECTED[state])))
    source, label, goal = (np.concatenate(c) for c in zip(*found))
    return source, label, goal


def least_labels(count: int, source: np.ndarray, label: np.ndarray, target: np.ndarray, start: np.ndarray) -> list[np.ndarray]:
    """The least label string over paths from each of ``start`` to a node without arcs, in an acyclic graph of ``count`` nodes.

    A string that ends is less than one that goes on. Arcs of a node may share a label.
    """
    # node ``count`` is the end, reached from every node without arcs; it leads to itself by label 0
    ends = np.append(np.setdiff1d(np.arange(count), source), count)
    src, rank_of = np.concatenate([source, ends]), np.concatenate([label + 1, np.zeros(len(ends), np.int64)])
    dst = np.concatenate([target, np.full(len(ends), count)])
    first = np.full(count + 1, np.iinfo(np.int64).max)
    np.minimum.at(first, src, rank_of)
    keep = rank_of == first[src]
    by = np.lexsort((dst[keep], src[keep]))
    src, dst, rank = src[keep][by], dst[keep][by], first
    jumps = []
    while True:
        # of the pointers of a node, those to the least rank stay
        least = np.minimum.reduceat(rank[dst], np.searchsorted(src, np.arange(count + 1)))
        keep = rank[dst] == least[src]
        src, dst = src[keep], dst[keep]
        begin = np.searchsorted(src, np.arange(count + 2))
        jumps.append(dst[begin[:-1]])
        if (jumps[-1] == count).all():
            break
        rank = np.unique(rank * (int(least.max()) + 1) + least, return_inverse=True)[1]
        fan = begin[dst + 1] - begin[dst]
        at = np.repeat(begin[dst] - (np.cumsum(fan) - fan), fan) + np.arange(int(fan.sum()))
        pairs = np.unique(np.repeat(src, fan) * (count + 1) + dst[at])
        src, dst = pairs // (count + 1), pairs % (count + 1)
    path = np.asarray(start)[:, None]
    for jump in reversed(jumps):
        path = np.stack([path, jump[path]], axis=2).reshape(len(path), -1)
    letters = first[path] - 1  # the end's label 0 becomes -1
    return [row[row >= 0] for row in letters]


def audits(code: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """Cost and least audit of each conversation."""
    cost = finishing_costs(code, length)
    start = (np.cumsum(length + 1) - length - 1) * STATES + START
    labels = least_labels(len(cost) * STATES, *optimal_arcs(code, length, cost), start)
    return cost.ravel()[start], ["".join(map(EDITS.__getitem__, row)) for row in labels]


def repaired(audit: str, rows: list[tuple[str, str]], state: int = START) -> list[str]:
    """``role:text`` of the repaired conversation, or of a piece that is entered in ``state``."""
    out, at = [], 0
    for edit in audit:
        if edit == "D":
            at += 1
            continue
        expected = "assistant" if state == USER else "user"
        role, text = (expected, "") if edit == "I" else rows[at]
        at += edit != "I"
        state = int(_KEPT[INITIALS[role[0]], state]) if edit == "K" else int(_EXPECTED[state])
        out.append(f"{role if edit == 'K' else expected}:{text}")
    return out


def _facts(rows: list[tuple[str, str]]) -> tuple[list[int], int, int, int, int]:
    """Codes of a conversation's rows and its blank, duplicate, truncated and illegal counts."""
    codes, faults, seen = [], [0, 0, 0], set()
    for row in rows:
        role, text = row
        code = INITIALS.get(role[:1], OTHER)
        fault = 0 if is_blank(text) else 1 if row in seen else 2 if is_truncated(text) else None
        seen.add(row)
        if fault is not None:
            faults[fault] += 1
            code |= IS_TRUNCATED if fault == 2 else MUST_GO
        codes.append(code)
    illegal = sum(a[0][:1] + b[0][:1] not in _LEGAL for a, b in zip(rows, rows[1:]))
    return codes, *faults, illegal


def gaps(turns: list[int | None]) -> int:
    known = {t for t in turns if t is not None}
    return max(known) - min(known) + 1 - len(known) if known else 0


def _solve(ids: list, turns: list, roles: list, texts: list, gone: list) -> pa.RecordBatch:
    """Result rows of whole conversations, given row by row in order."""
    cuts = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1]), len(ids)]
    codes, length, rows, facts, keys = [], [], [], [], []
    for a, z in zip(cuts, cuts[1:]):
        stay = [i for i in range(a, z) if not gone[i]]
        said = [(roles[i], texts[i]) for i in stay]
        code, *counts = _facts(said)
        codes += code
        length.append(len(said))
        rows.append(said)
        facts.append([gaps([turns[i] for i in stay]), *counts])
        keys.append(ids[a])
    cost, audit = audits(np.array(codes, np.int64), np.array(length, np.int64))
    digest = [hashlib.sha256("\n".join(repaired(a, r)).encode("utf-8", "surrogatepass")).hexdigest() for a, r in zip(audit, rows)]
    numbers = [pa.array(c, pa.int64()) for c in (*zip(*facts), cost.tolist())]
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *numbers, pa.array(audit, pa.string()), pa.array(digest, pa.string())], names=names)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[list] = [[], [], [], [], []]
    for batch in batches:
        for column, new in zip(held, batch.columns):
            column += new.to_pylist()
        ids = held[0]
        cut = len(ids)
        while cut and ids[cut - 1] == ids[-1]:  # the last conversation may go on in the next batch
            cut -= 1
        if cut:
            yield _solve(*(c[:cut] for c in held))
            held = [c[cut:] for c in held]
    if held[0]:
        yield _solve(*held)


def _numbered(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pieces of ``size`` rows of each sorted range, and the places of the rows in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, part = 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            place = np.arange(at, at + batch.num_rows)
            at += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part + place // size), pa.array(place % size)], names=[*batch.schema.names, "piece", "place"])

    return run


def _by_place(table: pa.Table) -> pa.Table:
    return table.sort_by("place")


def _piece(key: tuple, table: pa.Table) -> pa.Table:
    """Least costs between the states before and behind a piece, and its pairs of roles that may not meet."""
    table = _by_place(table)
    code, first = table.column("code").to_numpy(), table.column("initial").to_pylist()
    ends = np.where(np.eye(STATES, dtype=bool), 0, NO)
    cost = finishing_costs(np.tile(code, STATES), np.full(STATES, len(code)), ends)
    through = np.minimum(cost[np.arange(STATES) * (len(code) + 1)].T, NO)  # entry state, last state
    illegal = sum(a + b not in _LEGAL for a, b in zip(first, first[1:]))
    return pa.table([pa.array([v], t) for v, t in zip((key[0].as_py(), key[1].as_py(), through.ravel().tolist(), first[0], first[-1], illegal), _PIECE_TYPES)], names=_PIECE_NAMES)


_PIECE_TYPES = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string(), pa.string(), pa.int64()]
_PIECE_NAMES = ["conv_id", "piece", "through", "first", "last", "illegal"]
_PIECE_SCHEMA = "conv_id long, piece long, through array<long>, first string, last string, illegal long"


def _chained(table: pa.Table) -> pa.Table:
    """From one row a piece: the costs behind each piece, the whole cost and all illegal pairs."""
    table = table.sort_by("piece")
    first, last = table.column("first").to_pylist(), table.column("last").to_pylist()
    illegal = sum(table.column("illegal").to_pylist()) + sum(a + b not in _LEGAL for a, b in zip(last, first[1:]))
    ahead, behind = _FINISH, []
    for through in reversed(table.column("through").to_pylist()):
        behind.append(ahead.tolist())
        ahead = np.minimum((np.array(through).reshape(STATES, STATES) + ahead).min(axis=1), NO)
    n = table.num_rows
    return table.select(["conv_id", "piece"]).append_column("behind", pa.array(behind[::-1], pa.list_(pa.int64()))).append_column(
        "final", pa.array([i == n - 1 for i in range(n)])).append_column("cost", pa.array([int(ahead[START])] * n, pa.int64())).append_column("illegal", pa.array([illegal] * n, pa.int64()))


def _ranked(key: tuple, facts: pa.Table, chain: pa.Table) -> pa.Table:
    """For each state a piece may be entered in, the least audit through it and the state behind it."""
    code = _by_place(facts).column("code").to_numpy()
    final = chain.column("final")[0].as_py()
    cost = finishing_costs(code, np.array([len(code)]), np.array(chain.column("behind")[0].as_py()))
    labels = least_labels(len(cost) * STATES, *optimal_arcs(code, np.array([len(code)]), cost, final), np.arange(STATES))
    out, leaves = ["".join(map(EDITS.__getitem__, row)) for row in labels], []
    for state, audit in enumerate(out):
        at = 0
        for edit in audit:
            if edit != "D":
                state = int(_KEPT[code[at] & 3, state]) if edit == "K" else int(_EXPECTED[state])
            at += edit != "I"
        leaves.append(state)
    return pa.table({"conv_id": pa.array([key[0].as_py()], pa.int64()), "piece": pa.array([key[1].as_py()], pa.int64()), "audits": pa.array([out], pa.list_(pa.string())), "leaves": pa.array([leaves], pa.list_(pa.int32()))})


def _entered(table: pa.Table) -> pa.Table:
    table = table.sort_by("piece")
    state, enters = START, []
    for leaves in table.column("leaves").to_pylist():
        enters.append(state)
        state = leaves[state]
    return table.select(["conv_id", "piece"]).append_column("enters", pa.array(enters, pa.int32()))


def _written(key: tuple, rows: pa.Table, chosen: pa.Table) -> pa.Table:
    """The repaired lines of a piece."""
    rows = _by_place(rows)
    lines = repaired(chosen.column("audit")[0].as_py(), list(zip(rows.column("role").to_pylist(), rows.column("text").to_pylist())), chosen.column("enters")[0].as_py())
    n = len(lines)
    return pa.table({"conv_id": pa.array([key[0].as_py()] * n, pa.int64()), "piece": pa.array([key[1].as_py()] * n, pa.int64()), "place": pa.array(range(n), pa.int64()), "line": pa.array(lines, pa.string())})


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash per conversation over its lines in order, without holding them."""
    now, digest, out = None, None, []
    for batch in batches:
        for conv, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if digest is None or conv != now:
                if digest is not None:
                    out.append((now, digest.hexdigest()))
                now, digest = conv, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(line.encode("utf-8", "surrogatepass"))
    if digest is not None:
        out.append((now, digest.hexdigest()))
    ids, hashes = zip(*out) if out else ((), ())
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.string())], names=["conv_id", "repaired_sha256"])


def _long(rows: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """The results of conversations that are cut into pieces of ``size`` rows; ``conv_id`` is not null here."""
    width = partitions(rows.sparkSession)
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "text"]
    cut = rows.repartitionByRange(width, *order).sortWithinPartitions(*order)
    ordered = stored(cut.mapInArrow(_numbered(size), "conv_id long, turn long, role string, text string, piece long, place long"), "ordered")
    # the first of equal rows, found by digest; a row repeated very often is one number per task
    where = F.struct("piece", "place")
    known = ordered.withColumn("said", F.sha2(F.concat("role", F.lit("\0"), "text"), 256))
    firsts = known.groupBy("conv_id", "said").agg(F.min(where).alias("first_place"))
    solid = F.expr(r"rtrim('\u0020\t\n\u000b\f\r', text)")
    initial = F.substring("role", 1, 1)
    blank, again, cropped = solid == "", where > F.col("first_place"), ~F.substring(solid, -1, 1).isin(".", "!", "?")
    fault = F.when(blank, "blank").when(again, "duplicate").when(cropped, "truncated")
    letter = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(OTHER)
    mark = F.when(F.col("fault") == "truncated", IS_TRUNCATED).when(F.col("fault").isNotNull(), MUST_GO).otherwise(0)
    facts = stored(known.join(firsts, ["conv_id", "said"]).withColumn("fault", fault).select(
        "conv_id", "piece", "place", "turn", "fault", initial.alias("initial"), (letter + mark).cast("long").alias("code")), "facts")
    own = facts.select("conv_id", "piece", "place", "code", "initial")
    through = own.groupBy("conv_id", "piece").applyInArrow(_piece, _PIECE_SCHEMA)
    chain = stored(through.groupBy("conv_id").applyInArrow(_chained, "conv_id long, piece long, behind array<long>, final boolean, cost long, illegal long"), "chain")
    ranked = stored(own.groupBy("conv_id", "piece").cogroup(chain.groupBy("conv_id", "piece")).applyInArrow(_ranked, "conv_id long, piece long, audits array<string>, leaves array<int>"), "ranked")
    enters = ranked.select("conv_id", "piece", "leaves").groupBy("conv_id").applyInArrow(_entered, "conv_id long, piece long, enters int")
    chosen = ranked.join(enters, ["conv_id", "piece"]).select("conv_id", "piece", "enters", F.col("audits")[F.col("enters")].alias("audit"))
    lines = ordered.select("conv_id", "piece", "place", "role", "text").groupBy("conv_id", "piece").cogroup(chosen.groupBy("conv_id", "piece")).applyInArrow(_written, "conv_id long, piece long, place long, line string")
    hashes = lines.repartition(width, "conv_id").sortWithinPartitions("conv_id", "piece", "place").select("conv_id", "line").mapInArrow(_hashed, "conv_id long, repaired_sha256 string")
    count = lambda name: F.count(F.when(F.col("fault") == name, 1)).alias(name)
    counts = facts.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).alias("gaps"), count("blank"), count("duplicate"), count("truncated"))
    whole = chosen.groupBy("conv_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("piece", "audit")))["audit"], "").alias("audit"))
    costs = chain.where("final").select("conv_id", "cost", "illegal")
    joined = ids.join(counts, "conv_id", "left").join(costs, "conv_id", "left").join(whole, "conv_id", "left").join(hashes, "conv_id", "left")
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def repair(conversations: DataFrame, long: int = LONG) -> DataFrame:
    """Faults of the damaged ``conversations(conv_id, turn, role, text)`` and their cheapest repair, a row per ``conv_id``.

    A null role or text is one space, also a null id or turn where the damage is drawn. Rows go by
    turn (null first), then role and text, so rows of one turn have one order; all rows without a
    ``conv_id`` are one conversation. Repeated rows count as rows, and all but the first are
    duplicates. A conversation that lost all rows has zeros, an empty audit and the hash of
    nothing. Other columns are ignored; an empty table gives no rows.
    """
    rows = damaged(conversations).select("conv_id", "turn", "role", "text", "gone")
    sizes = stored(rows.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > long).select("conv_id"), "long")
    width = partitions(conversations.sparkSession)
    if not sizes.limit(1).count():
        return _short(rows, width)
    same = rows["conv_id"].eqNullSafe(F.col("long_id"))
    ids = sizes.select(F.col("conv_id").alias("long_id"))
    known = _long(rows.join(ids, same, "left_semi").where("NOT gone").drop("gone").withColumn("conv_id", F.coalesce("conv_id", F.lit(NULL_ID))), sizes.select(F.coalesce("conv_id", F.lit(NULL_ID)).alias("conv_id")), long)
    named = known.withColumn("conv_id", F.when(F.col("conv_id") != NULL_ID, F.col("conv_id")))
    return _short(rows.join(ids, same, "left_anti"), width).unionByName(named)


def _short(rows: DataFrame, width: int) -> DataFrame:
    dealt = rows.repartition(width, "conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text", "gone")
    return dealt.mapInArrow(_whole, SCHEMA)
