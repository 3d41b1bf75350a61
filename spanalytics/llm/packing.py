"""Order-preserving sequence packing by dynamic programming.

Each partition is one stream of token ids in the order of its rows. Candidate cuts are ends of documents, ends of
sentences and, where neither comes for a while, plain positions. The cost of a sequence is its padding plus a penalty
for where it is cut; f[j] = min over i in (j - size, j) of f[i] + padding(j - i) + penalty(j) is a sliding-window minimum of
f[i] + i, kept in a monotone queue, so the work is linear in the number of candidates. The program runs over the first
BUFFER tokens that are held, as often as there are so many, and the sequences that it settles on are given out, but for
the last one, whose start carries over; so a task holds the ids of its longest text (as an array) and a buffer. There is no shuffle: packing is independent in each partition.
"""

from __future__ import annotations

import base64
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from . import common

#: Penalties in tokens, for a cut at a sentence's end and elsewhere; a cut between documents is free.
SENTENCE, PLAIN = 5, 15
#: Distance of plain candidates, and tokens of the buffer that one run of the program sees.
GRID, BUFFER = 24, 1 << 18


class Tokenizer:
    """Byte-level BPE ids. Texts with the special token's own string go through the slower reference path."""

    def __init__(self, vocabulary: str, ranks: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer as Slow

        self.slow = Slow.from_file(vocabulary)
        self.special = [str(t) for t in self.slow.get_added_tokens_decoder().values()] if hasattr(self.slow, "get_added_tokens_decoder") else ["<|endoftext|>"]
        with open(ranks, "rb") as f:
            pairs = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=pairs, special_tokens={})
        ends = [i for t, i in pairs.items() if b"\n" in t or t.rstrip(b"\"')]} ").endswith((b".", b"!", b"?"))]
        self.ends = np.zeros(max([*pairs.values(), *self.slow.get_added_tokens_decoder()], default=0) + 1, bool)
        self.ends[ends] = True

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if any(s in text for s in self.special):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode_ordinary(text), np.uint32)


def padding(n: int, size: int) -> int:
    return 0 if n & (n - 1) == 0 else size - n


def cuts(total: int, doc_ends: np.ndarray, sentence_ends: np.ndarray, size: int, final: bool) -> list[int]:
    """Cut positions (0 and, if final, total among them) of least cost over a buffer of ``total`` tokens."""
    pen = {}
    known = np.union1d(doc_ends, sentence_ends)
    known = known[(known > 0) & (known <= total)]
    edges = np.concatenate([[0], known, [total]])
    for a, b in zip(edges[:-1][np.diff(edges) > GRID], edges[1:][np.diff(edges) > GRID]):
        pen.update(dict.fromkeys(range(int(a) + GRID, int(b), GRID), PLAIN))
    pen.update(dict.fromkeys(sentence_ends[(sentence_ends > 0) & (sentence_ends <= total)].tolist(), SENTENCE))
    pen.update(dict.fromkeys(doc_ends[(doc_ends > 0) & (doc_ends <= total)].tolist(), 0))
    if final or total not in pen:
        pen[total] = 0
    pos = [0, *sorted(pen)]
    cost, back, queue = [0.0], [0], deque([0])
    for j in range(1, len(pos)):
        p = pos[j]
        while pos[queue[0]] < p - size:
            queue.popleft()
        i = queue[0]
        cost.append(cost[i] + padding(p - pos[i], size) + pen[p])
        back.append(i)
        while queue and cost[queue[-1]] + pos[queue[-1]] >= cost[j] + p:
            queue.pop()
        queue.append(j)
    out, j = [], len(pos) - 1
    while j:
        out.append(pos[j])
        j = back[j]
    out = [0, *out[::-1]]
    return out if final else out[:-1]


def tail(n: int, size: int) -> list[int]:
    """Lengths for the last n < size tokens of a partition: powers of two while they save more than they fragment."""
    out = []
    while n and padding(n, size) > size // 8:
        out.append(1 << (n.bit_length() - 1))
        n -= out[-1]
    return out + [n] * bool(n)


def pack(docs: DataFrame, vocabulary: str, ranks: str, pattern: str, id_col: str = "doc_id", size: int = 2048, end_id: int = 1) -> DataFrame:
    """One row per piece of a document in a sequence.

    (id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset): piece [start, start + length) of the document's
    ids lies at ``offset`` of the sequence. A document's ids are its text's and then ``end_id``; a null or
    empty text has ``end_id`` alone. Rows that repeat an id and rows with a null id are packed as documents of their own.
    The sequence's number is the partition's number * 2^32 and a count. A sequence is padded to ``size`` unless its
    length is a power of two. An empty table gives no rows; columns but id_col and text are ignored.
    """
    import pyspark.sql.types as T

    kind = docs.schema[id_col].dataType.simpleString()
    assert isinstance(docs.schema[id_col].dataType, T.DataType)
    schema = f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

    def run(it):
        tok = Tokenizer(vocabulary, ranks, pattern)
        base = TaskContext.get().partitionId() << 32
        made = 0
        held: list = []  # (id, ids, ends of sentences, tokens of it given out already)
        n = 0  # tokens held

        def flush(final):
            nonlocal made, held, n
            ends = np.cumsum([len(x[1]) - x[3] for x in held])
            starts = ends - [len(x[1]) - x[3] for x in held]
            inner = np.concatenate([x[2][x[2] > x[3]] - x[3] + s for x, s in zip(held, starts)])
            at = cuts(n if final else min(n, BUFFER), ends, inner, size, final)
            if final and len(at) > 1 and (k := tail(at[-1] - at[-2], size)):
                at[-1:] = (at[-2] + np.cumsum(k)).tolist()
            rows = {f: [] for f in (id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
            d = 0
            for a, b in zip(at, at[1:]):
                p = a
                while p < b:
                    while ends[d] <= p:
                        d += 1
                    q = min(b, int(ends[d]))
                    key, ids, _, given = held[d]
                    s = given + p - int(starts[d])
                    piece = ids[s : s + q - p]
                    for f, v in zip(rows, (key, s, q - p, zlib.crc32(piece.astype("<u4").tobytes()), len(ids), base + made, p - a)):
                        rows[f].append(v)
                    p = q
                made += 1
            done = at[-1]
            left = []
            for x, s, e in zip(held, starts, ends):
                if e > done:
                    left.append((*x[:3], x[3] + max(0, done - int(s))))
            held, n = left, n - done
            return rows

        for batch in it:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.append(tok(text), np.uint32(end_id)).astype(np.uint32)
                held.append((key, ids, np.flatnonzero(tok.ends[ids[:-1]]) + 1, 0))
                n += len(ids)
                while n >= BUFFER:
                    yield flush(False)
        if n:
            yield flush(True)

    return common.arrow(docs.select(id_col, F.col("text")), run, schema)
