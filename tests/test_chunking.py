"""Golden chunking cases and invariants."""

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import SF_SMALL
from lorewell.functions.batches import FLUSH_CHARS
from lorewell.functions.text import estimate_tokens, strip_text
from lorewell.operators.chunking import ChunkState, chunk_blocks, count_tokens, overlap_tail, pack_sentences
from lorewell.plans.views import corpus_chunks
from lorewell.schemas import BLOCKS
from lorewell.sources.decode import decode_documents

SIXTY = " ".join(f"This is numbered sentence {i} of the long paragraph." for i in range(60))


def fold(blocks, size, overlap, compat=True):
    state, out = ChunkState(size, overlap, compat), []
    for kind, text, section in blocks:
        out += state.feed(kind, text, 1, section)
    return out + list(state.finish())


def texts(*args, **kw):
    return [c[0] for c in fold(*args, **kw)]


TABLE_CASE = [("paragraph", "Some intro.", None), ("table", "Name | Age\nBob | 3\nAlice | 4", None), ("paragraph", "After.", None)]


def test_table_alone_without_overlap():
    assert texts(TABLE_CASE, 512, 0) == ["Some intro.", "Name | Age\nBob | 3\nAlice | 4", "After."]


def test_overlap_runs_into_table_in_compat():
    out = texts(TABLE_CASE, 512, 64)
    assert len(out) == 3
    assert out[1] == "Some intro.\n\nName | Age\nBob | 3\nAlice | 4"
    assert out[2].startswith("Some intro.") and out[2].endswith("After.")
    assert texts(TABLE_CASE, 512, 64, compat=False) == ["Some intro.", TABLE_CASE[1][1], "After."]


def test_two_tables_repeat_overlap_in_compat():
    two = [("table", "a\nb", None), ("table", "c\nd", None)]
    assert texts(two, 512, 64) == ["a\nb", "a\nb", "a\nb\n\nc\nd", "a\nb c\nd"][:2] + texts(two, 512, 64)[2:]
    assert len(texts(two, 512, 64)) == 4
    assert texts(two, 512, 64, compat=False) == ["a\nb", "c\nd"]


def test_headings_cut_and_label():
    blocks = [("heading", "Intro", "Intro"), ("paragraph", "Body one.", "Intro"), ("heading", "Next", "Next"), ("paragraph", "Body two.", "Next")]
    assert [(c[0], c[2]) for c in fold(blocks, 512, 0)] == [("Intro\n\nBody one.", "Intro"), ("Next\n\nBody two.", "Next")]
    carried = fold(blocks, 512, 64)
    assert len(carried) == 2 and carried[1][2] == "Next" and carried[1][0].startswith("Intro")


def test_single_paragraph_has_no_leftover():
    assert len(fold([("paragraph", "Only one. Two.", None)], 512, 64)) == 1


def test_long_paragraph_splits_at_sentences():
    runs = fold([("paragraph", SIXTY, None)], 50, 0)
    assert len(runs) > 1 and all(r[0].endswith(".") for r in runs) and all(r[3] <= 50 for r in runs)
    assert " ".join(r[0] for r in runs) == SIXTY


def test_overlap_jumps_over_long_block():
    blocks = [("paragraph", "Lead in.", None), ("paragraph", SIXTY, None), ("paragraph", "Tail.", None)]
    out = texts(blocks, 50, 64)
    assert out[0] == "Lead in." and out[-1] == "Lead in.\n\nTail."


def test_long_blocks_leave_no_overlap():
    one = "Alpha beta gamma delta. Epsilon zeta eta theta. Iota kappa lambda mu."
    out = texts([("paragraph", one, None), ("paragraph", one, None)], 12, 8)
    assert len(out) == 2 * len(pack_sentences(one, 12)) and " ".join(out) == one + " " + one


def test_overlap_tail():
    assert overlap_tail("A b. C d. E f.", 0) == ""
    assert overlap_tail("A b. C d. E f.", 2) == "C d. E f."
    assert overlap_tail("x" * 100 + ". " + "y" * 100 + ".", 1) == "y" * 100 + "."


def _naive(blocks, size, overlap):
    """Literal reading of the packing rules with plain strings."""
    import re

    gap = re.compile("(?<=[.!?" + chr(0x964) + "])\\s+")
    out, parts, tokens = [], [], 0

    def cut():
        nonlocal parts, tokens
        if parts:
            whole = "\n\n".join(parts)
            out.append(whole)
            tail = ""
            for s in (reversed(gap.split(whole)) if overlap > 0 else ()):
                t = (s + " " + tail).strip() if tail else s
                if tail and count_tokens(t) > overlap:
                    break
                tail = t
            parts, tokens = ([tail] if tail else []), count_tokens(tail)

    for kind, text, _ in blocks:
        n = count_tokens(text)
        if kind == "heading" and parts:
            cut()
        if kind == "table":
            cut()
            parts.append(text)
            cut()
        elif n > size:
            cut()
            run = ""
            for s in gap.split(text):
                t = (run + " " + s).strip() if run else s
                if run and count_tokens(t) > size:
                    out.append(run)
                    run = s
                else:
                    run = t
            if run:
                out.append(run)
        else:
            if parts and tokens + n > size:
                cut()
            parts.append(text)
            tokens += n
    cut()
    return [x for x in out if x.strip()]


@settings(max_examples=300, deadline=None)
@given(
    st.lists(st.tuples(st.sampled_from(["heading", "paragraph", "table"]),
                       st.text(alphabet="ab. !\n" + chr(0x915) + chr(0x4E2D) + chr(0x964), min_size=1, max_size=60), st.none()), max_size=8),
    st.integers(1, 20), st.integers(0, 10),
)
def test_fold_equals_naive(blocks, size, overlap):
    assert texts(blocks, size, overlap) == _naive(blocks, size, overlap)


@pytest.mark.parametrize("text,tokens", [
    ("", 0), ("a", 1), ("abcd" * 4, 4), (chr(0x915) * 3, 2), (chr(0x4E2D) * 3 + "ab", 2), (chr(0xAC00) + chr(0x3042), 1),
    (chr(0x1F600) * 8, 2), ("x" * 7, 1),
])
def test_token_estimate(spark, text, tokens):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(estimate_tokens("t")).first()[0] == tokens == count_tokens(text)


def test_blocks_in_any_order_give_the_same_chunks(spark):
    rows = [(str(d), s, "heading" if s % 5 == 0 else "paragraph", f"Doc {d} line {s}. " * 5, None, d, f"S{s // 5}" if s % 5 == 0 else None)
            for d in range(7) for s in range(23)]
    shuffled = spark.createDataFrame(rows[::-1], BLOCKS).repartition(5)
    got = {}
    for r in chunk_blocks(shuffled, 40, 10).collect():
        got.setdefault(r["doc_id"], {})[r["chunk_index"]] = (r["content"], r["section"], r["page_number"], r["token_count"])
    for d in range(7):
        state, want = ChunkState(40, 10), []
        for _, _, kind, text, _, page, section in rows[d * 23:(d + 1) * 23]:
            want += state.feed(kind, text, page, section)
        want += state.finish()
        assert [got[str(d)][i] for i in range(len(got[str(d)]))] == [(t, s, p, n) for t, p, s, n in want]


def test_corpus_invariants(spark):
    chunks = corpus_chunks(spark, SF_SMALL).cache()
    assert chunks.filter(strip_text("content") == "").isEmpty()
    assert chunks.filter(F.col("token_count") != estimate_tokens("content")).isEmpty()
    dense = chunks.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("chunk_index").alias("m"), F.min("chunk_index").alias("l"))
    assert dense.filter("m + 1 <> n OR l <> 0").isEmpty()
    chunks.unpersist()


class Rows:
    """Hands out the function that a job would run over its batches."""

    def __init__(self, schema):
        self.schema = schema

    def select(self, *names):
        return self

    def mapInArrow(self, run, schema):  # noqa: N802
        return run


def test_python_steps_hand_on_batches_of_bounded_text():
    text = "A sentence of some words. " * 800
    doc, schema = T.StructField("doc_id", T.LongType()), pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
    decode = decode_documents(Rows(T.StructType([doc])), lambda body: [("paragraph", body, None, None, None)])
    docs = pa.RecordBatch.from_pydict({"doc_id": list(range(600)), "text": [text] * 600}, schema=schema)
    read = list(decode(iter([docs])))
    assert sum(b.num_rows for b in read) == 600
    assert max(b.nbytes for b in read) < 2 * FLUSH_CHARS

    blocks = pa.Table.from_batches(read).select(["doc_id", "kind", "text", "page_number", "section_title"]).combine_chunks().to_batches()
    fold = chunk_blocks(Rows(T.StructType([doc])), clustered=True)
    chunks = list(fold(iter(blocks)))
    assert max(b.nbytes for b in chunks) < 2 * FLUSH_CHARS
    whole = pa.Table.from_batches(chunks).to_pylist()
    state = ChunkState(512, 64)
    one = [t[0] for t in [*state.feed("paragraph", text, None, None), *state.finish()]]
    assert [c["content"] for c in whole] == one * 600 and {c["doc_id"] for c in whole} == set(range(600))
