"""Deletes, patches, action logs, ordered columns and rate windows."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from lorewell.operators import analytics, maintenance
from lorewell.operators.analytics import error_alarm
from lorewell.operators.ordered import carry_forward
from lorewell.operators.ratelimit import anchored_windows
from lorewell.schemas import TABLES, conform, rule_violation


def test_subtree_depth_and_cycle(spark):
    chain = [(i, i - 1 if i else None) for i in range(70)] + [(100, None), (101, 100)]
    nodes = spark.createDataFrame(chain, "id int, parent_id int")
    roots = spark.createDataFrame([(40,), (101,), (999,)], "id int")
    assert sorted(r[0] for r in maintenance.subtree(nodes, roots).collect()) == [*range(40, 70), 101]
    loop = spark.createDataFrame([(1, 2), (2, 1), (3, None)], "id int, parent_id int")
    with pytest.raises(ValueError, match="cycle"):
        maintenance.subtree(loop, roots, max_rounds=5)


def _frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def test_cascade(spark):
    tables = {
        "users": _frame(spark, "id string", ("u1",), ("u2",)),
        "knowledge_bases": _frame(spark, "id string, owner_id string, parent_folder_id string", ("k1", "u1", None), ("k2", "u2", None), ("k3", "u2", "k4"), ("k4", "u2", "k2"), ("k5", "u2", None)),
        "documents": _frame(spark, "id string, knowledge_base_id string, owner_id string", ("d1", "k1", "u1"), ("d3", "k3", "u2"), ("d5", "k5", "u2"), ("d6", "k5", "u2")),
        "document_chunks": _frame(spark, "chunk_id string, doc_id string", ("c1", "d1"), ("c5", "d5"), ("c6", "d6")),
        "chat_sessions": _frame(spark, "id string, knowledge_base_id string, owner_id string", ("s1", "k1", "u1"), ("s5", "k5", "u2")),
        "chat_messages": _frame(spark, "id string, session_id string", ("m1", "s1"), ("m5", "s5")),
        "chat_citations": _frame(spark, "id string, message_id string, document_id string, chunk_id string", ("x1", "m1", "d1", "c1"), ("x5", "m5", "d5", "c5"), ("x6", "m5", "d6", "c6")),
        "audit_logs": _frame(spark, "id string, user_id string", ("a1", "u1"), ("a2", "u2"), ("a3", None)),
        "api_usage_logs": _frame(spark, "id string, user_id string", ("l1", "u1"), ("l2", "u2")),
    }
    dead = {"users": _frame(spark, "id string", ("u1",)), "knowledge_bases": _frame(spark, "id string", ("k2",)), "documents": _frame(spark, "id string", ("d6",))}
    left = {n: sorted(tuple(r) for r in df.collect()) for n, df in maintenance.cascade_delete(tables, dead).items()}
    ids = {n: [r[0] for r in rows] for n, rows in left.items()}
    assert ids == {
        "users": ["u2"], "knowledge_bases": ["k5"], "documents": ["d5"], "document_chunks": ["c5"], "chat_sessions": ["s5"],
        "chat_messages": ["m5"], "chat_citations": ["x5"], "api_usage_logs": ["l2"], "audit_logs": ["a1", "a2", "a3"]}
    assert left["audit_logs"] == [("a1", None), ("a2", "u2"), ("a3", None)]


def test_cascade_takes_replies_along(spark):
    messages = _frame(spark, "id string, session_id string, parent_message_id string", ("m1", "s", None), ("m2", "s", "m1"), ("m3", "s", "m2"), ("m4", "s", None))
    left = maintenance.cascade_delete({"chat_messages": messages}, {"chat_messages": _frame(spark, "id string", ("m2",))})
    assert sorted(r["id"] for r in left["chat_messages"].collect()) == ["m1", "m4"]


def test_patch_sets_null_explicitly(spark):
    df = _frame(spark, "id int, a string, b string", (1, "x", "y"), (2, "x", "y"))
    patches = _frame(spark, "id int, set_fields array<string>, a string, b string", (1, ["a"], None, "ignored"))
    assert sorted(tuple(r) for r in maintenance.apply_patches(df, patches, ["a", "b"]).collect()) == [(1, None, "y"), (2, "x", "y")]


def test_token_sweep(spark):
    t = dt.datetime(2024, 1, 1)
    tokens = _frame(spark, "token_hash string, user_id string, revoked boolean, expires_at timestamp",
                    ("a", "u", True, t), ("b", "u", False, t), ("c", "v", False, t), ("d", "w", True, t))
    shown = _frame(spark, "token_hash string, ts timestamp", ("a", t), ("c", t + dt.timedelta(1)), ("z", t))
    out = maintenance.sweep_replayed_tokens(tokens, shown)
    assert {r["token_hash"]: r["verdict"] for r in out["verdicts"].collect()} == {"a": "replayed", "c": "expired", "z": "unknown"}
    assert {r["token_hash"]: r["revoked"] for r in out["tokens"].collect()} == {"a": True, "b": True, "c": False, "d": True}


def test_actions(spark):
    targets = _frame(spark, "id int, is_suspended boolean", (1, False), (2, True), (3, False))
    log = _frame(spark, "actor int, target int, action string, ts int, seq int",
                 (9, 1, "suspend", 1, 1), (9, 1, "unsuspend", 2, 2), (9, 1, "suspend", 2, 3), (3, 3, "suspend", 1, 4), (9, 2, "delete", 1, 5), (9, 7, "suspend", 1, 6))
    out = maintenance.apply_actions(targets, log, "is_suspended")
    assert sorted(tuple(r) for r in out["updated"].collect()) == [(1, True), (3, False)]
    assert sorted((r["seq"], r["reason"]) for r in out["rejected"].collect()) == [(4, "own account"), (6, "not found")]
    assert sorted((r["action"], r["resource_id"]) for r in out["audit"].collect()) == [("delete_user", "2"), ("suspend_user", "1"), ("suspend_user", "1")]


def test_carry_forward_equals_brute_force(spark):
    rng = random.Random(5)
    rows = [(f"k{rng.choice('aab')}", i, i // 6, rng.choice([None, None, f"v{i}"])) for i in range(200)]
    df = _frame(spark, "k string, n int, b int, v string", *rows)
    for current in (True, False):
        got = {r["n"]: r["out"] for r in carry_forward(df, ["k"], "b", ["n"], "v", "out", current).collect()}
        for k, n, _, _ in rows:
            past = [r[3] for r in rows if r[0] == k and (r[1] < n or (current and r[1] == n)) and r[3]]
            assert got[n] == (past[-1] if past else None)


@pytest.mark.parametrize("seed", range(4))
def test_anchored_windows_equal_walk(spark, seed):
    rng = random.Random(seed)
    window, slice_ms = 1000, rng.choice([1000, 1700, 5000])
    rows, t = [], {"a": 0, "b": -5000}
    for _ in range(1500):
        k = "a" if rng.random() < 0.9 else "b"
        t[k] += rng.choice([0, 0, 1, 30, 200, 999, 1000, 1001, 7000 if rng.random() < 0.1 else 5])
        rows.append((k, t[k]))
    rng.shuffle(rows)
    df = _frame(spark, "k string, ms long", *rows)
    got = sorted((r["k"], r["window_start_ms"], r["n_requests"], r["breach"]) for r in
                 anchored_windows(df, "k", F.timestamp_millis("ms"), 3, window, slice_ms).collect())
    want = []
    for k in "ab":
        start, n = None, 0
        for ms in sorted(m for kk, m in rows if kk == k):
            if start is None or ms >= start + window:
                if start is not None:
                    want.append((k, start, n, n > 3))
                start, n = ms, 0
            n += 1
        want.append((k, start, n, n > 3))
    assert got == sorted(want)


@pytest.mark.parametrize("fan", [2, 3, 64])
def test_anchored_windows_of_a_hot_key_come_down_a_tree(spark, fan):
    """Any height of the tree gives the windows of a walk, over gaps, negative times and requests without a time."""
    rng = random.Random(fan)
    rows, t = [("a", None), ("c", None)], {"a": -90_000, "b": 400}
    for _ in range(3000):
        k = "a" if rng.random() < 0.95 else "b"
        t[k] += rng.choice([0, 1, 40, 333, 999, 1000, 1001, 25_000 if rng.random() < 0.02 else 7])
        rows.append((k, t[k]))
    df = _frame(spark, "k string, ms long", *rows)
    out = anchored_windows(df, "k", F.timestamp_millis("ms"), 3, 1000, 1000, fan=fan)
    want = []
    for k in "ab":
        start, n = None, 0
        for ms in sorted(m for kk, m in rows if kk == k and m is not None):
            if start is None or ms >= start + 1000:
                if start is not None:
                    want.append((k, start, n, n > 3))
                start, n = ms, 0
            n += 1
        want.append((k, start, n, n > 3))
    assert sorted(tuple(r) for r in out.collect()) == sorted(want)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(key" in plan and not re.search(r"hashpartitioning\(key#\d+, \d+\)", plan)
    assert anchored_windows(df.limit(0), "k", F.timestamp_millis("ms"), 3, 1000, 1000, fan=fan).count() == 0


def test_alarm_needs_consecutive_periods(spark):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    rows = [(at(m), True) for m in (0, 1, 6, 7, 15, 16, 25, 26, 31, 32, 36, 37)] + [(at(11), True), (at(12), False)]
    log = _frame(spark, "ts timestamp, bad boolean", *rows)
    got = sorted(r["alarm_at"] for r in error_alarm(log, F.col("bad"), threshold=1).collect())
    assert got == [at(5), at(30), at(35)]
    assert [r["alarm_at"] for r in error_alarm(log, F.col("bad"), threshold=1, periods=3).collect()] == [at(35)]


def test_table_contracts(spark):
    rows = _frame(spark, "id string, status string", ("a", "completed"), ("b", "COMPLETED"), ("c", None))
    docs = conform(rows, "documents")
    assert docs.schema == TABLES["documents"]
    assert {r["id"]: r["v"] for r in docs.select("id", rule_violation("documents").alias("v")).collect()} == {"a": None, "b": "status", "c": None}


def test_identities(spark):
    users = _frame(spark, "id string, email string, external_id string, is_active boolean, is_suspended boolean, is_verified boolean, last_login_at timestamp",
                   ("u1", "a@x", "g1", True, False, True, None), ("u2", "b@x", None, True, True, False, None), ("u3", "c@x", "g3", False, False, False, None))
    incoming = _frame(spark, "external_id string, email string, name string, email_verified boolean",
                      ("g1", "b@x", "A", True), ("g2", "b@x", "B", True), ("g3", "c@x", "C", True), ("g9", "n@x", "N", False), ("g8", "n@x", "M", True))
    now = F.lit("2024-05-01").cast("timestamp")
    matched, refused, inserts = maintenance.match_identities(users, incoming, now)
    assert {(r["external_id"], r["user_id"], r["matched_by"]) for r in matched.collect()} == {("g1", "u1", "external_id"), ("g2", "u2", "email")}
    assert [r["user_id"] for r in refused.collect()] == ["u3"]
    assert [(r["email"], r["external_id"], r["full_name"]) for r in inserts.collect()] == [("n@x", "g8", "M")]
    linked = {r["id"]: (r["external_id"], r["is_verified"], r["last_login_at"] is not None) for r in maintenance.link_identities(users, matched).collect()}
    assert linked == {"u1": ("g1", True, True), "u2": ("g2", True, True), "u3": ("g3", False, False)}


def test_disposable_objects(spark):
    docs = _frame(spark, "id string, temp_storage_key string", ("a", "k"), ("b", None), ("c", "z"))
    assert [r[0] for r in maintenance.disposable_objects(docs, _frame(spark, "id string", ("a",), ("b",))).collect()] == ["k"]


def test_parquet_table_round_trip(spark, tmp_path):
    from lorewell.sources.tables import read_table, write_table

    rows = _frame(spark, "id string, role string", ("u", "admin"))
    write_table(rows, str(tmp_path), "users")
    back = read_table(spark, str(tmp_path), "users")
    assert back.schema == TABLES["users"] and back.select("id", "role").collect() == rows.collect()


def test_merged_hours_give_the_percentile_of_the_log(spark):
    rows = [(i % 3, "/a" if i % 5 else "/b", "m", dt.datetime(2024, 1, 1, i % 24), float((i * 7919) % 5000) if i % 50 else None, 500 if i % 10 == 0 else 200) for i in range(5000)]
    rows.append((9, "/none", "m", dt.datetime(2024, 1, 1), None, 200))
    log = _frame(spark, "user_id int, endpoint string, model string, created_at timestamp, latency_ms double, status_code int", *rows)
    hours = analytics.usage_hours(log)
    assert hours.count() == len({(r[0], r[1], r[3]) for r in rows})
    for keys in (["endpoint"], ["user_id", "endpoint"]):
        for got in analytics.usage_percentiles(hours, keys).collect():
            own = [r for r in rows if all(r[{"user_id": 0, "endpoint": 1}[k]] == got[k] for k in keys)]
            known = sorted(r[4] for r in own if r[4] is not None)
            assert got.calls == len(own) and got.errors == sum(r[5] == 500 for r in own)
            if not known:
                assert got.latency_high is None and got.latency_mean is None
            else:
                assert abs(sum(v <= got.latency_high for v in known) / len(known) - 0.95) < 0.005 + 1 / len(known)
                assert abs(got.latency_mean - sum(known) / len(known)) < 1e-6
    # merging halves of the hours in two steps is merging them at once
    early, late = (analytics.usage_hours(log.where(c)) for c in ("hour(created_at) < 12", "hour(created_at) >= 12"))
    both = {r.endpoint: r.calls for r in analytics.usage_percentiles(early.unionByName(late), ["endpoint"]).collect()}
    assert both == {r.endpoint: r.calls for r in analytics.usage_percentiles(hours, ["endpoint"]).collect()}
