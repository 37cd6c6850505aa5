"""Sum-of-squares packing of tokenised documents into sequences.

Each piece goes where the sum of the squared numbers of open sequences per residual gap becomes smallest: into an open sequence of
some gap, or into a new one if none has room. Only the counts per gap matter for the choice, so a task holds at most one list of open sequences per gap.
"""

from __future__ import annotations

import base64
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 1024
END = 2
#: Rows packed by one task.
ROWS = 30_000
#: Cuts whose ids a Python worker remembers.
REMEMBERED = 150_000


class _Known(dict):
    """Ids of `lead` and a cut, as bytes, worked out at the first request; None if the cut may not stand alone."""

    def __init__(self, lead: str, encoding, special: list[str]):
        super().__init__()
        self.lead, self.encoding, self.special = lead, encoding, special
        self.piece = encoding._core_bpe.encode_single_piece

    def __missing__(self, cut: str) -> bytes | None:
        text = self.lead + cut
        if cut.isalpha():  # letters, with or without a space before them, are one piece of the vocabulary's pattern
            ids = array("I", self.piece(text.encode())).tobytes()
        elif not cut or cut[0].isspace() or cut[-1].isspace() or any(s in cut for s in self.special):
            ids = None
        else:
            ids = array("I", self.encoding.encode_ordinary(text)).tobytes()
        if len(self) < REMEMBERED:
            self[cut] = ids
        return ids


class Tokenizer:
    """Token ids as little-endian 32-bit bytes, by a byte-level BPE file of `tokenizers`.

    `ranks` names the same vocabulary as a `tiktoken` file, which gives the same ids faster. Words repeat, and no token of such a
    vocabulary crosses from a non-space into a space, so a text is cut before each space and the ids of the cuts are
    remembered. A text with a cut that touches other white space, or that holds a special token's text, goes to `tokenizers` whole.
    """

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.model = tokenizers.Tokenizer.from_file(path)
        self.first = None
        if ranks:
            with open(ranks, "rb") as f:
                merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            encoding = tiktoken.Encoding(os.path.basename(ranks), pat_str=pattern, mergeable_ranks=merges, special_tokens={})
            special = [t.content for t in self.model.get_added_tokens_decoder().values()]
            self.first, self.later = _Known("", encoding, special), _Known(" ", encoding, special)

    def whole(self, text: str) -> bytes:
        return array("I", self.model.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        if self.first is None:
            return self.whole(text)
        cuts = text.split(" ")
        ids = [self.first[cuts[0]]]
        ids += map(self.later.__getitem__, cuts[1:])
        try:
            return b"".join(ids)
        except TypeError:
            return self.whole(text)


_TOKENIZERS: dict[tuple, Tokenizer] = {}


def tokenizer(*paths: str | None) -> Tokenizer:
    """One per Python worker, so that what it remembers lasts over tasks."""
    if paths not in _TOKENIZERS:
        _TOKENIZERS[paths] = Tokenizer(*paths)
    return _TOKENIZERS[paths]


_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids binary"
_PACKED = _PIECES + ", sequence_id bigint, offset bigint"


def pieces(docs: DataFrame, paths: tuple, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids): each document's ids and the END id, cut into pieces of `capacity` if longer.

    The first piece of a cut document is the shorter one. ids are little-endian unsigned 32-bit numbers. Null text counts as empty: END alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(*paths)
        end = np.array([END], dtype="<u4").tobytes()
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])
        out: list[tuple] = []
        held = 0

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
            out.clear()
            return made

        for got in batches:
            texts = got.column(1)
            for i, doc in enumerate(got.column(0).to_pylist()):
                ids = own.encode(texts[i].as_py() or "") + end
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                out += [(doc, k, a, b - a, ids[4 * a : 4 * b]) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
                held += len(ids)
                if held >= 1 << 22:
                    yield batch()
                    held = 0
        if out:
            yield batch()

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, _PIECES)


class SumOfSquares:
    """Open sequences by residual gap. place(n) gives the sequence's number and the offset in it."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity = capacity
        self.open = np.zeros(capacity + 1, dtype=np.int64)  # how many have each gap
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.made = 0

    def place(self, n: int) -> tuple[int, int]:
        """Moving a sequence from gap g to g - n changes the sum by 2 (open[g - n] - open[g]) + 2.

        A sequence without a gap is no longer open and counts nowhere, so closing one changes it by 1 - 2 open[g]. Ties go to the smallest gap.
        A new sequence is begun only if no open one has room: pieces come longest first, where this needs 1.0015 times the least
        number of sequences, and 1.027 times if the sum may also choose a new one (30,000 and more pieces of the sample documents).
        """
        count = self.open
        fits = np.flatnonzero(count[n:] > 0)
        if len(fits):
            change = 2 * (count[fits] - count[fits + n]) + 2
            if fits[0] == 0:
                change[0] = 1 - 2 * count[n]
            gap = int(fits[np.argmin(change)]) + n
            sequence = self.at[gap].pop()
            count[gap] -= 1
        else:
            gap, sequence = self.capacity, self.made
            self.made += 1
        if gap > n:
            count[gap - n] += 1
            self.at[gap - n].append(sequence)
        return sequence, self.capacity - gap


def packed(docs: DataFrame, paths: tuple, capacity: int = CAPACITY, rows: int = ROWS) -> DataFrame:
    """Pieces with sequence_id and offset: no sequence is longer than `capacity`, its pieces lie without gaps from 0.

    Pieces are dealt out evenly over tasks of about `rows` documents, whatever their ids; each task packs what it gets, longer pieces
    first. Sequence ids are unique over tasks and otherwise arbitrary. Repeated rows are packed each; an empty table gives no row.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        bins = SumOfSquares(capacity)
        for batch in batches:
            placed = np.array([bins.place(n) for n in batch.column(3).to_pylist()], dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(placed[:, 0] + base), pa.array(placed[:, 1])], schema=schema)

    tasks = max(1, -(-docs.count() // rows))
    dealt = pieces(docs, paths, capacity).repartition(tasks)
    return dealt.sortWithinPartitions(F.desc("length"), "doc_id", "piece", "start", "ids").mapInArrow(run, _PACKED)
