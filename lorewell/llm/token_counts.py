"""Token counts of whole texts under a sentencepiece BPE model, with a whole-token shortcut.

No merge of such a model crosses the start of a run of spaces, nor touches a
character that is part of no longer piece. So a text falls into independent
pre-tokens. Before the job, every vocabulary string that can be a pre-token is
merged by itself; those that come out as one token are *proved* and counted from
then on by a plain look-up. Everything else is merged once per worker and
remembered in a bounded cache.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewell.llm.merges import Cache, merge_symbols

SPACE = "▁"
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


@dataclass
class PieceModel:
    """Normal pieces with their scores, and the facts proved from them."""

    scores: dict[str, float]
    byte_fallback: bool
    alone: frozenset[str] = frozenset()
    pattern: str = ""
    ranks: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.ranks = {p: -s for p, s in self.scores.items()}
        if any(SPACE in p.lstrip(SPACE) or (p.startswith(SPACE * 2) and p.strip(SPACE)) for p in self.scores):
            raise ValueError("a piece joins text across spaces; pre-tokens would not be independent")
        joined = {c for p in self.scores if len(p) > 1 for c in p}
        lone = "".join(re.escape(c) for c in "\n\t\r" if c not in joined)
        self.pattern = f"{SPACE}*[^{SPACE}{lone}]+|{SPACE}+" + (f"|[{lone}]+" if lone else "")
        split = re.compile(self.pattern).findall
        self.alone = frozenset(p for p in self.scores if split(p) == [p] and self.merged(p) == 1)

    def merged(self, pre_token: str) -> int:
        ranks, known = self.ranks, self.scores
        parts = merge_symbols(list(pre_token), lambda a, b: ranks.get(a + b))
        return sum(1 if s in known or not self.byte_fallback else len(s.encode("utf-8", "surrogatepass")) for s in parts)

    def count(self, text: str, cache: Cache) -> int:
        if not text:
            return 0
        marked = SPACE + text.replace(" ", SPACE)  # the model puts a space before every text
        return sum(map(cache.__getitem__, re.findall(self.pattern, marked)))


@lru_cache(maxsize=4)
def load(path: str) -> PieceModel:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    normal = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    return PieceModel({model.id_to_piece(i): model.get_score(i) for i in normal}, any(model.is_byte(i) for i in ids))


@lru_cache(maxsize=4)
def worker_cache(path: str) -> tuple[PieceModel, Cache]:
    model = load(path)
    return model, Cache(model.merged, dict.fromkeys(model.alone, 1))


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """Tokens of every text of ``docs(doc_id, text)``; the model file must be installed on every worker.

    One row per input row: ``doc_id, n_bytes, n_tokens, over_limit``. A null text is
    empty (0 tokens); a null ``doc_id`` is kept as null; repeated rows give repeated
    results; other columns are ignored; an empty table gives no rows. A text without
    any boundary is one pre-token, merged in n log n by a heap.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache = worker_cache(model_path)
        for batch in batches:
            raw = [t or b"" for t in batch.column(1).to_pylist()]
            counts = [model.count(t.decode("utf-8", "replace"), cache) for t in raw]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, raw), pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return source.mapInArrow(run, SCHEMA)
