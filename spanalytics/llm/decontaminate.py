"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

Texts and items are sequences of normalised words (runs of letters and digits, in lower case). A document is contaminated by
an item of m words if some stretch of it is within edit distance floor((1 - similarity) * m), in words, of the item.

* Region filter, lossless by the q-gram lemma: an item of 20 words or more has ten consecutive words with at most two edits,
  of whose nine word pairs five survive, so a match must hold a stretch of eleven word pairs of which five occur in one item
  (each shorter length has the lemma's bound for the whole item). It says which stretches, and which items at them, can match.
* CGK: from each window start a random walk reads a word, writes it, and stays or moves on by a random bit of the
  word and the step. Two windows at small edit distance get walks at small Hamming distance with constant probability.
* LSH: each of the repeated embeddings (own random bits) is sampled at random steps for several tables. A window
  as long as the item, of an item that the filter admits nearby, that agrees with it on all sampled steps of a table is a
  candidate. The number of tables is set by a target recall, which the walks reach for short items only: they re-couple
  ever more seldom.
* Verification: the exact edit distance of the item to the best stretch around the window.
* Completion: every item that the filter admits at a stretch, and that was not found there without an edit, is verified too
  where the lemma's bound for the whole item holds. So no match is lost, and the edits are the least, for any length.

The items go to the executors in blocks; each block is matched against all documents. An item's text is in one block, once,
with the list of its ids. A block's index is built on the driver and broadcast: the blocks are so many that an index takes about
BLOCK_BYTES, reckoned from the numbers of items and words (a longer item is a block of its own).
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, functions as F

from . import common

#: Bytes of a block's index, about; and what an item and each of its words take in it: signatures and their tables of low bits
#: (60 tables of 16 + 2 * SLOTS bytes); the words, their pairs, and the postings with theirs.
BLOCK_BYTES, ITEM_BYTES, WORD_BYTES = 96 << 20, 3000, 64
#: Entries of the tables of low bits for each signature.
SLOTS = 16
#: Words of an item from which on the filter looks at blocks of ten of its words.
LONG = 20
SAMPLES = 4
PAD = np.uint64(0)


_BASE = 0x9E3779B97F4A7C15 | 1


@lru_cache(maxsize=1)
def _alnum() -> np.ndarray:
    """Whether a code point is a letter or a digit."""
    return np.array([chr(c).isalnum() for c in range(0x110000)])


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64, for i < n."""
    with np.errstate(over="ignore"):
        up = np.full(n, np.uint64(_BASE))
        down = np.full(n, np.uint64(pow(_BASE, -1, 1 << 64)))
        up[0] = down[0] = 1
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


def word_ids(texts: list[str | None], step: int = 1 << 18) -> list[np.ndarray]:
    """64-bit ids of the words (runs of letters and digits, lower case) of each text.

    A word's id is a polynomial hash of its code points, taken from running sums over many texts at once.
    """
    out = []
    for a, b in common.batches(texts, step):
        low = [(t or "").lower() for t in texts[a:b]]
        codes = np.frombuffer("\n".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(codes)
        up, down = _powers(1 << max(18, n.bit_length()))
        mask = np.zeros(n + 2, np.int8)
        mask[1:-1] = _alnum()[codes]
        turn = np.diff(mask)
        starts, ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
            ids = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)) | np.uint64(1)
        ends_of_texts = np.cumsum([len(t) + 1 for t in low])
        out += np.split(ids, np.searchsorted(starts, ends_of_texts[:-1]))
    return out


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def pairs(a: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(a[:-1] * np.uint64(0x9E3779B97F4A7C15) + a[1:])


def embed(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, steps: int, seed: int) -> np.ndarray:
    """CGK walks (steps, len(starts)) over flat[start:end]; PAD after the end."""
    out = np.empty((steps, len(starts)), np.uint64)
    at = starts.copy()
    padded = np.append(flat, PAD)
    odd = mix(np.arange(1, steps + 1, dtype=np.uint64) + np.uint64(seed * 1009)) | np.uint64(1)
    for j in range(steps):
        w = padded[at]
        w[at >= ends] = PAD
        out[j] = w
        # the step's random bit of the word: the top bit of its product with the step's odd number
        with np.errstate(over="ignore"):
            w *= odd[j]
        w >>= np.uint64(63)
        at += w.view(np.int64)
        np.minimum(at, ends, out=at)
    return out


def edit_within(item: np.ndarray, region: np.ndarray) -> int:
    """Least edit distance of the item to any stretch of the region."""
    row = np.zeros(len(region) + 1, np.int32)
    steps = np.arange(len(region) + 1, dtype=np.int32)
    for i, w in enumerate(item):
        new = np.empty_like(row)
        new[0] = i + 1
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (region != w))
        row = np.minimum.accumulate(new - steps) + steps
    return int(row.min()) if len(row) else len(item)


def edits(m: int, similarity: float) -> int:
    return math.floor((1 - similarity) * m + 1e-9)


@dataclass
class Index:
    ids: list
    items: list[np.ndarray]
    similarity: float
    filters: list  # (Postings, function of a document's words that gives their keys, span, need)
    lengths: list[int]
    reps: int
    tables: dict  # length -> [rep] -> (samples (tables, SAMPLES), sorted signatures, item numbers, low bits)
    most: int


def tables_needed(share: float, recall: float, reps: int) -> int:
    """Tables in each of ``reps`` embeddings so that a pair whose walks agree on ``share`` of the steps is met."""
    hit = share**SAMPLES
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - hit) / reps))


def signatures(walk: np.ndarray, samples: np.ndarray, salt: int) -> np.ndarray:
    """(tables, windows): a hash of the words at each table's sampled steps."""
    with np.errstate(over="ignore"):
        acc = np.full((len(samples), walk.shape[1]), np.uint64(salt + 1))
        for s in range(samples.shape[1]):
            acc *= np.uint64(0x9E3779B97F4A7C15)
            acc += walk[samples[:, s]]
        return mix(acc) + np.arange(len(samples), dtype=np.uint64)[:, None]


def build(ids: list, texts: list[str | None], similarity: float = 0.8, recall: float = 0.995, share: float = 0.55, reps: int = 5, seed: int = 11) -> Index:
    """Index of a block of items. ``share``: of the steps on which the walks of a pair at the threshold agree."""
    seqs = word_ids(texts)
    keep = [i for i, s in enumerate(seqs) if len(s)]
    ids, items = [ids[i] for i in keep], [seqs[i] for i in keep]
    of = lambda a, b: [i for i, s in enumerate(items) if a <= len(s) < b]
    lengths = sorted({len(s) for s in items})
    by_length: dict[int, list[int]] = {m: [] for m in lengths}
    for i, x in enumerate(items):
        by_length[len(x)].append(i)
    per = tables_needed(share, recall, reps)
    r = np.random.default_rng(seed)
    tables = {}
    for m in lengths:
        mine = by_length[m]
        flat = np.concatenate([items[i] for i in mine])
        starts = np.arange(len(mine), dtype=np.int64) * m
        row = []
        for rep in range(reps):
            # the walk reads about half a word a step, so 3/2 m steps stay in the window and all are informative
            samples = r.integers(0, max(1, m * 3 // 2), (per, SAMPLES))
            sig = signatures(embed(flat, starts, starts + m, max(1, m * 3 // 2), rep), samples, m).ravel()
            order = np.argsort(sig, kind="stable")
            # most signatures are told off by a table of low bits, before the sorted array is searched
            low = np.zeros(1 << (len(sig) * SLOTS).bit_length(), bool)
            low[sig & np.uint64(len(low) - 1)] = True
            row.append((samples, sig[order], np.tile(np.array(mine), per)[order], low))
        tables[m] = row
    filters = []
    for a, b in [*((m, m + 1) for m in range(1, LONG)), (LONG, 1 << 60)]:
        if rows := of(a, b):
            keys = pairs if a > 1 else _words
            filters.append((Postings([keys(items[i]) for i in rows], rows), keys, *bound([len(items[i]) for i in rows], similarity)))
    return Index(ids, items, similarity, filters, lengths, reps, tables, max((len(s) for s in items), default=0))


def _words(a: np.ndarray) -> np.ndarray:
    return a


def bound(lengths: list[int], similarity: float) -> tuple[int, int]:
    """(span, need): a match of an item of one of these lengths has ``need`` of the item's pairs within ``span`` positions.

    An edit spoils two pairs at most and adds one word at most. Lengths from LONG on are seen by blocks of ten words, the
    best of which has at most its share of the edits; shorter ones (all alike) as a whole.
    """
    m = lengths[0]
    if m == 1:
        return 1, 1
    n, k = (m, edits(m, similarity)) if m < LONG else (10, max(edits(x, similarity) // (x // 10) for x in lengths))
    if n - 1 - 2 * k < 1:
        raise ValueError(f"no word pair need survive at a similarity of {similarity}")
    return n - 1 + k, n - 1 - 2 * k


class Postings:
    """For each word pair (or single word), the items that hold it."""

    def __init__(self, keys: list[np.ndarray], items: list[int]):
        uniq = [np.unique(k) for k in keys]
        flat = np.concatenate(uniq) if uniq else np.zeros(0, np.uint64)
        item = np.repeat(np.array(items, np.int64), [len(u) for u in uniq])
        order = np.lexsort((item, flat))
        self.keys, self.first, self.size = np.unique(flat[order], return_index=True, return_counts=True)
        self.item = item[order]
        # most words of a document are told off by a table of low bits, before the sorted array is searched
        self.low = np.zeros(1 << max(14, len(self.keys).bit_length() + 3), bool)
        self.low[self.keys & np.uint64(len(self.low) - 1)] = True

    def hits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of x that are keys, and their places among the keys."""
        if not len(self.keys) or not len(x):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        maybe = np.flatnonzero(self.low[x & np.uint64(len(self.low) - 1)])
        at = np.searchsorted(self.keys, x[maybe])
        at[at == len(self.keys)] = 0
        same = self.keys[at] == x[maybe]
        return maybe[same], at[same]

    def dense(self, x: np.ndarray, span: int, need: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions, with the item, of ``need`` hits of one item within ``span`` positions."""
        pos, at = self.hits(x)
        if len(pos) < need:
            return pos[:0], pos[:0]
        # any items at all, then one item
        ok = np.flatnonzero(pos[need - 1 :] - pos[: len(pos) - need + 1] < span)
        near = np.zeros(len(pos) + 1, np.int64)
        near[ok] += 1
        np.subtract.at(near, ok + need, 1)
        keep = np.cumsum(near)[:-1] > 0
        pos, at = pos[keep], at[keep]
        if not len(pos):
            return pos, pos
        n = self.size[at]
        p = np.repeat(pos, n)
        i = self.item[np.repeat(self.first[at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        order = np.lexsort((p, i))
        p, i = p[order], i[order]
        first = np.flatnonzero((i[need - 1 :] == i[: len(i) - need + 1]) & (p[need - 1 :] - p[: len(p) - need + 1] < span))
        both = np.unique(np.concatenate([first + j for j in range(need)])) if len(first) else first
        return p[both], i[both]


def admitted(ix: Index, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the document's words, with the item that the filter admits there, by item and then by position."""
    keys = {f: f(a) for f in (pairs, _words)} if len(a) else {}
    got = [post.dense(keys[f], span, need) for post, f, span, need in ix.filters] if len(a) else []
    at, item = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*got) if got else ([], [])))
    order = np.lexsort((at, item))
    return at[order], item[order]


def regions(ix: Index, a: np.ndarray, at: np.ndarray) -> list[tuple[int, int]]:
    """Stretches around the positions ``at`` that may hold a match, widened by the longest item either way."""
    at = np.unique(at)
    if not len(at):
        return []
    wide = ix.most + edits(ix.most, ix.similarity) + 2
    cuts = np.flatnonzero(np.diff(at) > 2 * wide)
    firsts, lasts = at[np.concatenate([[0], cuts + 1])], at[np.concatenate([cuts, [len(at) - 1]])]
    return [(max(0, int(f) - wide), min(len(a), int(x) + 2 + wide)) for f, x in zip(firsts, lasts)]


def match(ix: Index, docs: list[np.ndarray], step: int = 1 << 13) -> list[list[tuple[int, int]]]:
    """(item number, edit distance) of each item that each document holds."""
    found: list[dict[int, int]] = [{} for _ in docs]
    near = [admitted(ix, a) for a in docs]
    spots = [(d, s, e) for d, a in enumerate(docs) for s, e in regions(ix, a, near[d][0])]
    lengths = [sorted({len(ix.items[i]) for i in np.unique(item).tolist()}) for _, item in near]
    part: list = []
    n = 0
    for k, spot in enumerate(spots):
        # a long region is cut into overlapping pieces, so that a step stays bounded
        d, s, e = spot
        most = max(step, 8 * ix.most)
        while e - s > most:
            _match_part(ix, docs, [(d, s, s + most)], found, lengths[d])
            s += most - 2 * ix.most - 2
        part.append((d, s, e))
        n += e - s
        if n >= step or k + 1 == len(spots):
            _match_part(ix, docs, part, found, sorted({m for d_, _, _ in part for m in lengths[d_]}))
            part, n = [], 0
    for a, (at, item), f in zip(docs, near, found):
        _complete(ix, a, at, item, f)
    return [sorted(f.items()) for f in found]


def _complete(ix: Index, a: np.ndarray, at: np.ndarray, item: np.ndarray, found: dict[int, int]) -> None:
    """Verify the items that the filter admits in document ``a``, where the lemma's bound for the whole item holds."""
    firsts = np.flatnonzero(np.diff(item, prepend=-1))
    for i, p in zip(item[firsts].tolist(), np.split(at, firsts[1:])):
        m, k = len(ix.items[i]), edits(len(ix.items[i]), ix.similarity)
        if found.get(i) == 0:
            continue
        if m == 1:
            found[i] = 0
            continue
        # a match has at most m + k words, and a position of the filter is in it
        for q in np.split(p, np.flatnonzero(np.diff(p) > 2 * (m + k)) + 1):
            region = a[max(0, int(q[0]) - m - k) : int(q[-1]) + m + k + 2]
            hit = np.isin(pairs(region), pairs(ix.items[i]))
            sums = np.concatenate([[0], np.cumsum(hit), np.full(m + k, hit.sum())])
            starts = np.flatnonzero(sums[m + k - 1 : m + k - 1 + len(hit)] - sums[: len(hit)] >= m - 1 - 2 * k)
            for w in np.split(starts, np.flatnonzero(np.diff(starts) > m + k) + 1) if len(starts) else []:
                x = edit_within(ix.items[i], region[w[0] : w[-1] + m + k])
                if x <= k and x < found.get(i, k + 1):
                    found[i] = x


def _match_part(ix: Index, docs, spots, found, lengths: list[int]) -> None:
    flat = np.concatenate([docs[d][s:e] for d, s, e in spots])
    sizes = np.array([e - s for _, s, e in spots])
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(spots)), sizes)
    starts = np.arange(len(flat), dtype=np.int64)
    limit = ends[owner]
    met: dict[tuple[int, int], set] = {}
    for rep in range(ix.reps):
        walk = embed(flat, starts, limit, max(1, lengths[-1] * 3 // 2), rep)
        for m in lengths:
            samples, sig, item, low = ix.tables[m][rep]
            own = signatures(walk, samples, m).ravel()
            maybe = np.flatnonzero(low[own & np.uint64(len(low) - 1)])
            own = own[maybe]
            at = np.searchsorted(sig, own)
            at[at == len(sig)] = 0
            for h in np.flatnonzero(sig[at] == own):
                j, w = int(at[h]), int(maybe[h]) % len(flat)
                while j < len(sig) and sig[j] == own[h]:
                    met.setdefault((int(owner[w]), int(item[j])), set()).add(w)
                    j += 1
    for (o, i), at in met.items():
        d, s, e = spots[o]
        k, m = edits(len(ix.items[i]), ix.similarity), len(ix.items[i])
        base = int(ends[o] - sizes[o])
        # windows that overlap are verified together
        w = np.array(sorted(at)) - base
        first = np.flatnonzero(np.diff(w, prepend=w[0] - m - 4 * k - 3) > m + 4 * k + 2)
        for p, q in zip(w[first], w[np.append(first[1:], len(w)) - 1]):
            x = edit_within(ix.items[i], flat[base + max(0, p - 2 * k - 1) : base + min(e - s, q + m + 2 * k + 1)])
            if x <= k and x < found[d].get(i, k + 1):
                found[d][i] = x


def decontaminate(docs: DataFrame, benchmark: DataFrame, keep: list[str], item_col: str = "item_id", similarity: float = 0.8) -> DataFrame:
    """``keep`` columns of every row of ``docs`` with hits (underscores added if a kept column has that name): array of
    (item, edits, words), by item.

    A null, empty or wordless text holds nothing; a null, empty or wordless item is held by nothing. Repeated items (or
    ids) each count; repeated documents get the same hits each. Without items every document has no hits.
    """
    texts = benchmark.groupBy("text").agg(F.collect_list(F.struct(F.col(item_col).alias("id"))).alias("ids"))
    words = F.size(F.split(F.trim("text"), r"[^\p{L}\p{N}]+"))
    total = texts.filter("text is not null").agg(F.sum(words * WORD_BYTES + ITEM_BYTES)).first()[0] or 0
    blocks = max(1, math.ceil(total / BLOCK_BYTES))
    hit = f"array<struct<item:{benchmark.schema[item_col].dataType.simpleString()},edits:int,words:int>>"
    out, cols = docs, []
    for b in range(blocks):
        rows = texts.filter("text is not null").filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).orderBy("text").collect()
        ix = build([[x["id"] for x in r["ids"]] for r in rows], [r["text"] for r in rows], similarity)

        def work(texts, ix=ix):
            return [[[{"item": x, "edits": k, "words": len(ix.items[i])} for i, k in found for x in ix.ids[i]] for found in match(ix, word_ids(texts))]]

        before = [c for c in dict.fromkeys([*keep, "text"])] if b + 1 < blocks else keep
        out = common.per_text(out, [*before, *cols], f"hits {hit}", work)
        cols.append(out.columns[-1])
    name = common.free(keep, ["hits"])[0]
    return out.select(*map(common.quoted, keep), F.array_sort(F.concat(*map(common.quoted, cols))).alias(name))
