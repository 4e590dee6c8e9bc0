"""Cost-balanced packing of token documents into fixed-length sequences.

A sequence's cost is estimated as linear in its tokens plus quadratic in each document's
part (attention stays within a document). Documents are taken in descending length, each
to the sequence of lowest cost that has room; a document that fits nowhere is cut.

Each task packs its own rows in windows of some million tokens and emits pieces, so tokens
are never shuffled and a task needs memory for one window only. A window opens
as many sequences as its tokens need, so padding is below one sequence per window.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tessera.llm.common import slices

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@lru_cache(2)
def encoder(ranks_path: str | None = None, json_path: str | None = None) -> Callable[[str], list[int]]:
    """Text -> ids of the public 50k byte-level BPE vocabulary, as ``tokenizers`` gives them with ``json_path`` by default.

    The ids come from the same vocabulary's rank file, at over three times the speed; the tests hold the two against each other.
    The JSON file's added tokens are cut out of a text wherever they stand and have their own ids, as there.
    """
    import public_tokenizers as tokenizers_dir
    import tiktoken

    with open(ranks_path or tokenizers_dir.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f)}
    with open(json_path or tokenizers_dir.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    encoding = tiktoken.Encoding("byte_bpe", pat_str=tokenizers_dir.PATTERN, mergeable_ranks=ranks, special_tokens=added)
    return partial(encoding.encode, allowed_special=set(added), disallowed_special=())


def plan(lengths: list[int], capacity: int, linear: float, quadratic: float) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Pieces (document, start, length, sequence, offset) of one window, and the number of sequences."""
    pieces, rests = [], []
    sequences = 0
    for d, n in enumerate(lengths):
        for start in range(0, n - n % capacity, capacity):
            pieces.append((d, start, capacity, sequences, 0))
            sequences += 1
        if n % capacity:
            rests.append((n % capacity, d, n - n % capacity))
    rests.sort(key=lambda r: (-r[0], r[1]))
    n_open = -(-sum(r[0] for r in rests) // capacity)
    room, cost = np.full(n_open, capacity), np.zeros(n_open)

    def put(d: int, start: int, n: int, s: int) -> None:
        pieces.append((d, start, n, sequences + s, int(capacity - room[s])))
        room[s] -= n
        cost[s] += linear * n + quadratic * n * n

    for n, d, start in rests:
        s = int(np.argmin(np.where(room >= n, cost, np.inf)))
        if room[s] >= n:
            put(d, start, n, s)
            continue
        while n:
            s = int(np.argmin(np.where(room > 0, cost, np.inf)))
            part = min(n, int(room[s]))
            put(d, start, part, s)
            start, n = start + part, n - part
    return pieces, sequences + n_open


def pack(
    docs: DataFrame,
    *,
    capacity: int = 1024,
    end_id: int = 0,
    window_tokens: int = 2_000_000,
    linear: float = 1.0,
    quadratic: float = 1 / 512,
    ranks_path: str | None = None,
    json_path: str | None = None,
    with_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece; with ``with_ids`` its token ids as well.

    Null and empty texts are the end id alone. The vocabulary's special tokens have their own ids inside a text too. Null ids stay null; repeated ids are packed each by
    themselves. Texts of any length are cut into pieces. An empty table gives an empty result.
    Other columns don't matter. Sequence ids are unique in the table; the partition is in the upper bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks_path, json_path)
        base = TaskContext.get().partitionId() << 40
        ids, tokens, held = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal base, held
            pieces, sequences = plan([len(t) for t in tokens], capacity, linear, quadratic)
            pieces.sort(key=lambda p: (p[3], p[4]))
            parts = [tokens[d][start : start + n] for d, start, n, _, _ in pieces]
            columns = [
                pa.array([ids[p[0]] for p in pieces], pa.int64()),
                *[pa.array(c, pa.int64()) for c in ([p[1] for p in pieces], [p[2] for p in pieces], [zlib.crc32(x.tobytes()) for x in parts], [len(tokens[p[0]]) for p in pieces], [base + p[3] for p in pieces], [p[4] for p in pieces])],
            ]
            names = [f.split()[0] for f in SCHEMA.split(", ")]
            if with_ids:
                columns.append(pa.array([x.astype(np.int32) for x in parts], pa.list_(pa.int32())))
                names.append("ids")
            base, held = base + sequences, 0
            ids.clear()
            tokens.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(doc_id)
                tokens.append(np.array([*(encode(text) if text else ()), end_id], "<u4"))
                held += len(tokens[-1])
                if held >= window_tokens:
                    yield flush()
        if tokens:
            yield flush()

    rows = docs.select(docs[id_col].cast("long"), docs[text_col])
    return rows.mapInArrow(run, SCHEMA + ", ids array<int>" * with_ids)
