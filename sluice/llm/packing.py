"""Order-preserving packing: dynamic programming over window cuts with a monotone queue."""

from __future__ import annotations

import base64
import os
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import bounded_batches, read

WIDTH, SEPARATOR = 1024, 0
#: Cost, in padded tokens, of a cut behind a sentence and of one inside it; one behind a document is free.
SENTENCE, INSIDE = 4, 16
#: A stretch without a boundary may be cut at every STEP-th token.
STEP = 32
#: Tokens over which one run of the programming goes; its last window is carried over into the next.
BLOCK = 1 << 20
SPECIAL = "<|endoftext|>"
COLUMNS = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def choose_cuts(at: list[int], cost: list[int], width: int) -> list[int]:
    """Indices of the cuts that minimise padding + cost, from the first candidate to the last.

    at: growing candidate positions, neighbours at most width apart. With g(j) = f(j) + at[j] the
    recurrence f(j) = min f(i) + width - (at[j] - at[i]) + cost[j] reads g(j) = min g(i) + width + cost[j]
    over the i within width of j: a sliding minimum, which a queue of growing g gives in linear time.
    """
    n = len(at)
    g, back, queue = [0] * n, [0] * n, deque([0])
    for j in range(1, n):
        least = at[j] - width
        while at[queue[0]] < least:
            queue.popleft()
        back[j] = queue[0]
        g[j] = v = g[queue[0]] + width + cost[j]
        while queue and g[queue[-1]] >= v:
            queue.pop()
        queue.append(j)
    cuts, j = [n - 1], n - 1
    while j:
        j = back[j]
        cuts.append(j)
    return cuts[::-1]


def candidates(ids: np.ndarray, doc_ends: np.ndarray, closes: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Positions behind which a window may end, and their costs. doc_ends: positions behind documents."""
    cost = np.full(len(ids) + 1, -1, np.int32)
    cost[np.flatnonzero(closes[ids]) + 1] = SENTENCE
    cost[doc_ends] = 0
    cost[0] = cost[len(ids)] = 0
    at = np.flatnonzero(cost >= 0)
    wide = np.flatnonzero(np.diff(at) > step)
    if len(wide):
        extra = np.concatenate([np.arange(at[k] + step, at[k + 1], step) for k in wide])
        cost[extra] = INSIDE
        at = np.flatnonzero(cost >= 0)
    return at, cost[at]


class Coder:
    """Ids as the tokenizers library gives them, by the same vocabulary's ranks, which are four times as fast.

    Only texts that hold the special token's string differ; those go to the tokenizers library itself.
    """

    def __init__(self, folder: str | None):
        import public_tokenizers as P
        import tiktoken

        at = (lambda name: os.path.join(folder, name)) if folder else P.path
        with open(at("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("byte_bpe_50k", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.file, self.slow = at("byte_bpe_50k.json"), None
        self.closes = np.zeros(max(ranks.values()) + 2, bool)
        for token, i in ranks.items():
            self.closes[i] = token.rstrip(b" \"')")[-1:] in (b".", b"!", b"?", b"\n") and token.strip() != b"" or b"\n" in token
        self.closes[SEPARATOR] = False

    def __call__(self, text: str) -> np.ndarray:
        if SPECIAL in text:
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.file)
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode_ordinary(text), np.uint32)


_CODERS: dict = {}


def _coder(folder: str | None) -> Coder:
    if folder not in _CODERS:
        _CODERS[folder] = Coder(folder)
    return _CODERS[folder]


class Packer:
    """Takes documents in order, gives rows (doc key, start, length, crc, doc_tokens, sequence, offset)."""

    def __init__(self, closes: np.ndarray, first: int, width: int, block: int):
        self.closes, self.next, self.width, self.block = closes, first, width, block
        self.docs: list[tuple] = []  # key, tokens of the document, start of what is left, ids
        self.held = 0

    def add(self, key, ids: np.ndarray) -> Iterator[tuple]:
        self.docs.append((key, len(ids), 0, ids))
        self.held += len(ids)
        if self.held >= self.block:
            yield from self.flush(False)

    def flush(self, last: bool) -> Iterator[tuple]:
        if not self.docs:
            return
        ids = np.concatenate([d[3] for d in self.docs])
        ends = np.cumsum([len(d[3]) for d in self.docs])
        at, cost = candidates(ids, ends, self.closes, min(STEP, self.width))
        cuts = [int(at[k]) for k in choose_cuts(at.tolist(), cost.tolist(), self.width)]
        if not last and len(cuts) > 2:
            cuts.pop()  # the last window may still grow
        d, begin = 0, 0  # the document at hand and its place in the stream
        for a, b in zip(cuts, cuts[1:]):
            while a < b:
                key, total, start, own = self.docs[d]
                stop = min(b, begin + len(own))
                piece = own[a - begin : stop - begin]
                yield key, start + a - begin, stop - a, zlib.crc32(piece.astype("<u4").tobytes()), total, self.next, a - cuts_start(cuts, a)
                a = stop
                if stop == begin + len(own):
                    begin, d = stop, d + 1
            self.next += 1
        rest = self.docs[d:]
        if rest and cuts[-1] > begin:
            key, total, start, own = rest[0]
            rest[0] = (key, total, start + cuts[-1] - begin, own[cuts[-1] - begin :])
        self.docs, self.held = ([], 0) if last else (rest, sum(len(x[3]) for x in rest))


def cuts_start(cuts: list[int], a: int) -> int:
    import bisect

    return cuts[bisect.bisect_right(cuts, a) - 1]


def pack(docs: DataFrame, width: int = WIDTH, folder: str | None = None, block: int = BLOCK, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row for each piece of a document.

    Documents are packed in the order in which they stand in their input split, without a shuffle;
    a sequence never leaves its split, so a split ends with one part-filled sequence. Windows end
    behind documents or sentences, or inside a stretch of over STEP tokens without either. A null or
    empty text is its separator alone, repeated rows are documents of their own, an empty table has
    no pieces. sequence_id is the split's number times 2^33 plus a count. Memory is bounded by block and the
    longest document. folder: where the vocabulary files are (None: where the installed package says).
    """
    bounded_batches(docs.sparkSession)
    d = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    kind = dict(d.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        coder = _coder(folder)
        packer = Packer(coder.closes, (context.partitionId() if context else 0) << 33, width, block)
        tail, key_type = np.array([SEPARATOR], np.uint32), None

        def table(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], key_type), *[pa.array(c, pa.int64()) for c in cols[1:]]], ["doc_id", *[c.split()[0] for c in COLUMNS.split(", ")]])

        rows: list[tuple] = []
        for b in batches:
            key_type = b.column(0).type
            for key, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows.extend(packer.add(key, np.concatenate([coder(t), tail])))
                if len(rows) >= 20_000:
                    yield table(rows)
                    rows = []
        rows.extend(packer.flush(True))
        if rows:
            yield table(rows)

    return d.mapInArrow(run, f"doc_id {kind}, {COLUMNS}")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
