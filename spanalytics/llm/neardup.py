"""Near-duplicate documents by bottom-k sketches from one hash function.

1. One pass over the texts gives each document's number of distinct word shingles, a 128-bit fingerprint of that set
   and the ``k`` smallest hashes of it (the sketch).
2. Documents with equal fingerprints form a class, whose members are confirmed on the full sets of both texts; from
   here on only class representatives (the smallest id) take part.
3. Inverted lists of the retained values generate overlaps. A pair that is similar enough shares at least ``t`` of
   the ``k`` values (all but about 1e-8 of the pairs at the threshold), so each representative needs to appear only in
   its ``k - t + 1`` rarest lists; this keeps values of passages that many documents share out of the way. For sets
   of at most ``k`` shingles the sketch is the set, and the same step is exact; where the partner may be larger, what its
   sketch can lack is taken off.
4. Star round: in each list, every member is paired with the smallest one. The sketch of the union estimates the
   similarity and drops pairs far below the threshold; the rest are confirmed on the full sets of both texts. Confirmed
   links give components.
5. Completion: in lists that still hold several components, members outside the list's largest component are paired
   with the members of other components. All other pairs of the list are already in one component, so no link
   that could change the result is left out. Short lists do this by pairs.
6. The members of long lists that are still open (documents that share a passage and little else) go through steps 3 to 5
   again with their whole sets: a pair at the threshold shares a value among the rarest fifth of both sets, where
   a shared passage stands only if it is nearly all of the text. What is long and open even then forms groups by smallest
   member, which are dealt into pairs of bounded blocks; a block compares whole sets by incidence matrices and
   returns only links that join two components, so a large group never becomes rows for all its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from . import common
from .components import components

#: Lists of up to so many members are completed by pairs, and larger ones by blocks of about BLOCK members.
SMALL, BLOCK = 32, 512
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) words ``[^\\x20\\x09-\\x0D]+``, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


class WordHashes(dict):
    """64-bit hash of each word, remembered; emptied when it grows large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(ws: list[bytes], hashes: WordHashes, width: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; of all its words, if they are fewer than ``width``."""
    if not ws:
        return np.zeros(0, np.uint64)
    h = np.array([hashes[w] for w in ws], np.uint64)
    m = min(width, len(h))
    with np.errstate(over="ignore"):
        acc = np.full(len(h) - m + 1, np.uint64(m) * _ODD[4], np.uint64)
        for j in range(m):
            acc = mix(acc + h[j : len(h) - m + 1 + j] * _ODD[j % 5])
    return np.unique(acc)


def shingles(text: str | None, width: int) -> set:
    """The set of shingles itself, for the exact check."""
    ws = words(text)
    if len(ws) < width:
        return {tuple(ws)} if ws else set()
    return set(zip(*(ws[j:] for j in range(width))))


def sketches(docs: DataFrame, id_col: str, width: int, k: int) -> DataFrame:
    """(id, n, f1, f2, sketch) of each document."""

    def run(it):
        hashes = WordHashes()
        for batch in it:
            text = common.column(batch, "text")
            n, f1, f2, sk = [], [], [], []
            for t in text:
                s = shingle_hashes(words(t), hashes, width)
                n.append(len(s))
                with np.errstate(over="ignore"):
                    f1.append(int(np.bitwise_xor.reduce(mix(s + _ODD[0])).astype(np.int64)) if len(s) else 0)
                    f2.append(int(mix(s ^ _ODD[2]).sum(dtype=np.uint64).astype(np.int64)) if len(s) else 0)
                sk.append(s[:k].astype(np.int64))
            yield {"id": batch.column(0), "n": n, "f1": f1, "f2": f2, "sketch": sk}

    return common.arrow(docs.select(F.col(id_col).alias("id"), "text"), run, "id long, n long, f1 long, f2 long, sketch array<long>")


def _sizes(x: str, y: str, percent: int):
    """Whether two sets are not too different in size to be linked."""
    return (F.col(x) * 100 >= F.col(y) * percent) & (F.col(y) * 100 >= F.col(x) * percent)


def union_estimate(a: np.ndarray, b: np.ndarray, k: int) -> float:
    """Jaccard similarity from the sketch of the union: the share of its values that both sketches hold."""
    a, b = a.astype(np.uint64), b.astype(np.uint64)
    union = np.union1d(a, b)[:k]
    if not len(union):
        return 0.0
    return np.isin(union, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum() / len(union)


def _estimated(pairs: DataFrame, sk: DataFrame, k: int, least: float) -> DataFrame:
    """Pairs (a, b) whose union sketch puts the similarity at ``least`` or more."""
    one, two = sk.select(F.col("id").alias("a"), F.col("sketch").alias("sa")), sk.select(F.col("id").alias("b"), F.col("sketch").alias("sb"))

    def run(it):
        for batch in it:
            sa, sb = (batch.column(i).flatten().to_numpy() for i in (2, 3))
            oa, ob = (np.concatenate([[0], np.cumsum(batch.column(i).value_lengths().to_numpy())]) for i in (2, 3))
            keep = np.array([union_estimate(sa[oa[i] : oa[i + 1]], sb[ob[i] : ob[i + 1]], k) >= least for i in range(batch.num_rows)], bool)
            yield {"a": batch.column(0).to_numpy()[keep], "b": batch.column(1).to_numpy()[keep]}

    return common.arrow(pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb"), run, "a long, b long")


def _texts(docs: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """(id, text) of the documents in ``ids``, written once: the other texts are never shuffled if ids are few. An id that
    rows with several texts repeat has them all."""
    rows = docs.select(F.col(id_col).alias("id"), "text").join(common.materialize(ids.distinct(), "ids"), "id", "left_semi")
    return common.materialize(rows.dropDuplicates(["id", "text"]), "texts")


def _against_hubs(pairs: DataFrame, docs: DataFrame, id_col: str, width: int, same) -> DataFrame:
    """The pairs (a, b), a written table, where ``same(set of a, set of b)`` holds for one of their texts, as (u, v) = (b, a).

    The b of each a are dealt into blocks of about BLOCK by a hash, so that no a is a hot key; a block's rows are the
    text of a, once, and those of its b.
    """
    texts = _texts(docs, id_col, pairs.select(F.col("a").alias("id")).union(pairs.select("b")))
    blocks = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    others = pairs.join(blocks, "a").select("a", F.col("b").alias("id"), F.pmod(F.xxhash64("b"), "blocks").alias("block")).join(texts, "id")
    hubs = blocks.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")).join(texts.withColumnRenamed("id", "a"), "a")
    rows = hubs.select("a", "block", F.lit(None).cast("long").alias("b"), "text").union(others.select("a", "block", F.col("id").alias("b"), "text"))
    rows = rows.repartition("a", "block").sortWithinPartitions("a", "block", F.col("b").asc_nulls_first())

    def run(it):
        place, held = None, []
        for batch in it:
            u, v = [], []
            for a, block, b, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if place != (a, block):
                    place, held = (a, block), []
                own = shingles(text, width)
                if b is None:
                    held.append(own)
                elif any(same(x, own) for x in held):
                    u.append(b)
                    v.append(a)
            yield {"u": u, "v": v}

    return common.arrow(rows, run, "u long, v long").distinct()


def _verified(pairs: DataFrame, docs: DataFrame, id_col: str, width: int, percent: int) -> DataFrame:
    """Pairs whose full shingle sets reach the threshold: 100 * intersection >= percent * union."""

    def similar(x, y):
        both = len(x & y)
        return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)

    return _against_hubs(pairs, docs, id_col, width, similar)


def _similar(x: list[np.ndarray], y: list[np.ndarray], percent: int, step: int = 1 << 13) -> np.ndarray:
    """Matrix of the pairs of sets (x, y) that reach the threshold, by incidence matrices over the shared hashes."""
    nx, ny = np.array([len(a) for a in x]), np.array([len(a) for a in y])
    shared = np.intersect1d(np.concatenate(x), np.concatenate(y))

    def places(sets):
        flat = np.concatenate(sets)
        at = np.minimum(np.searchsorted(shared, flat), max(0, len(shared) - 1))
        hit = shared[at] == flat if len(shared) else np.zeros(len(flat), bool)
        return np.repeat(np.arange(len(sets)), [len(a) for a in sets])[hit], at[hit]

    (rx, px), (ry, py) = places(x), places(y)
    both = np.zeros((len(x), len(y)), np.float32)
    for a in range(0, len(shared), step):
        m = []
        for rows, at, size in ((rx, px, len(x)), (ry, py, len(y))):
            here = (at >= a) & (at < a + step)
            one = np.zeros((size, min(step, len(shared) - a)), np.float32)
            one[rows[here], at[here] - a] = 1
            m.append(one)
        both += m[0] @ m[1].T
    return (100 * both >= percent * (nx[:, None] + ny[None, :] - both)) & (both > 0)


def _block_links(groups: DataFrame, docs: DataFrame, id_col: str, width: int, percent: int) -> DataFrame:
    """Links (a, b) between the components of large groups (hub, id, component), enough of them to join the components.

    The members outside a group's largest component are dealt into blocks of about BLOCK, and so are all members; each
    pair of blocks is one bounded group that compares whole sets and returns a link only if it joins two components.
    """
    size = groups.groupBy("hub", "component").agg(F.count("*").alias("size"))
    size = size.groupBy("hub").agg(F.sum("size").alias("all"), F.max(F.struct("size", "component")).alias("top"))
    size = size.select("hub", F.col("top.component").alias("main"), F.ceil(F.col("all") / BLOCK).alias("by"), F.ceil((F.col("all") - F.col("top.size")) / BLOCK).alias("bx"))
    rows = common.materialize(groups.join(size, "hub").join(_texts(docs, id_col, groups.select("id")), "id"), "groups")
    block = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    cols = ["hub", "x", "y", "side", "id", "component", "text"]
    xs = rows.filter("component <> main").withColumns({"x": block("bx", 1), "y": every("by"), "side": F.lit(0)}).select(cols)
    ys = rows.filter("bx > 0").withColumns({"x": every("bx"), "y": block("by", 2), "side": F.lit(1)}).select(cols)

    def run(table: pa.Table) -> pa.Table:
        hashes = WordHashes()
        col = {c: table[c].to_pylist() for c in ("side", "id", "component", "text")}
        sets = [shingle_hashes(words(t), hashes, width) for t in col["text"]]
        xi, yi = ([i for i, s in enumerate(col["side"]) if s == side] for side in (0, 1))
        out, up = [], {}

        def top(c):
            while up.get(c, c) != c:
                c = up[c]
            return c

        if xi and yi:
            for i, j in zip(*np.nonzero(_similar([sets[i] for i in xi], [sets[j] for j in yi], percent))):
                i, j = xi[i], yi[j]
                a, b = top(col["component"][i]), top(col["component"][j])
                if a != b:
                    up[max(a, b)] = min(a, b)
                    out.append((min(col["id"][i], col["id"][j]), max(col["id"][i], col["id"][j])))
        return pa.table({"a": pa.array([p[0] for p in out], pa.int64()), "b": pa.array([p[1] for p in out], pa.int64())})

    return xs.union(ys).groupBy("hub", "x", "y").applyInArrow(run, "a long, b long")


def least_shared(n: int, percent: int, k: int) -> int:
    """Values that the sketches of a set of n <= k shingles and of any similar enough set share at least.

    A partner of b shingles has ceil(percent * (n + b) / (100 + percent)) in common with it, of which its sketch may lack
    all b - k that it does not retain.
    """
    return max(1, min(-(-percent * (n + b) // (100 + percent)) - max(0, b - k) for b in range(-(-n * percent // 100), n * 100 // percent + 1)))


def _labelled(lists: DataFrame, comp: DataFrame | None) -> DataFrame:
    """Lists (value, id, n) with each member's component so far."""
    if comp is None:
        return lists.withColumn("component", F.col("id"))
    return lists.join(comp.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))


def _hubs(lists: DataFrame) -> DataFrame:
    """Smallest member of each list that has several: (value, a, na, ca)."""
    least = lists.groupBy("value").agg(F.min(F.struct("id", "n", "component")).alias("hub"), F.count("*").alias("df")).filter("df > 1")
    return least.select("value", F.col("hub.id").alias("a"), F.col("hub.n").alias("na"), F.col("hub.component").alias("ca"))


def _star(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of the smallest member of each list with each other one that is in no component with it."""
    return lists.join(_hubs(lists), "value").filter((F.col("component") != F.col("ca")) & _sizes("n", "na", percent)).select("a", F.col("id").alias("b")).distinct()


def _open(lists: DataFrame) -> DataFrame:
    """Members of the lists that hold several components: (value, id, n, component, members, main, hub)."""
    per = lists.groupBy("value", "component").agg(F.count("*").alias("size"), F.min("id").alias("hub"))
    main = per.groupBy("value").agg(F.count("*").alias("comps"), F.sum("size").alias("members"), F.max(F.struct("size", "component")).alias("top"), F.min("hub").alias("hub"))
    main = main.filter("comps > 1").select("value", "members", F.col("top.component").alias("main"), "hub")
    return common.materialize(lists.join(main, "value"), "open")


def _pairs(open_: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components in the short lists."""
    small = open_.filter(F.col("members") <= SMALL)
    x = small.filter("component <> main").select("value", F.col("id").alias("x"), F.col("n").alias("nx"), F.col("component").alias("cx"))
    y = small.select("value", F.col("id").alias("y"), F.col("n").alias("ny"), F.col("component").alias("cy"), F.col("main").alias("my"))
    cross = x.join(y, "value").filter((F.col("cx") != F.col("cy")) & _sizes("nx", "ny", percent) & ((F.col("cy") == F.col("my")) | (F.col("x") < F.col("y"))))
    return cross.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _whole_lists(ids: DataFrame, docs: DataFrame, id_col: str, width: int, percent: int) -> DataFrame:
    """Lists (value, id, n) of the rarest values of the whole sets of ``ids``: a pair at the threshold shares percent / 100
    of either set, so it shares a value among the n - ceil(n * percent / 100) + 1 rarest of both."""

    def run(it):
        hashes = WordHashes()
        for batch in it:
            ids_, text = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            sets = [shingle_hashes(words(t), hashes, width) for t in text]
            yield {"id": ids_, "n": [len(x) for x in sets], "values": [x.astype(np.int64) for x in sets]}

    sets = common.arrow(_texts(docs, id_col, ids), run, "id long, n long, values array<long>")
    entry = common.materialize(sets.select("id", "n", F.xxhash64("values").alias("text"), F.explode("values").alias("value")), "entries")
    df = entry.groupBy("value").agg(F.count("*").alias("df"))
    place = F.row_number().over(W.partitionBy("id", "n", "text").orderBy("df", "value"))
    rare = entry.join(df, "value").withColumn("place", place).filter((F.col("df") > 1) & (F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1))
    return rare.select("id", "n", "value").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", width: int = 5, percent: int = 80, k: int = 32) -> DataFrame:
    """One row per row of ``docs``: (id_col, n_shingles, component_id, kept).

    Two documents are linked where 100 * |A and B| >= percent * |A or B| for their sets of ``width``-word shingles;
    component_id is the smallest id reachable over links. A null, empty or wordless text has an empty set and is linked
    with nothing. Rows that repeat an id, with equal or different texts, are one document for the links: it has those of
    all its texts (each row is returned). A null id stays null and is its own component (kept); it takes no part in
    links. ``docs`` needs the columns id_col and text; any others are ignored.
    """
    t = max(1, k * 3 // 8)
    sk = common.materialize(sketches(docs, id_col, width, k), "sketches")
    known = sk.filter("id is not null and n > 0")
    mark = ["n", "f1", "f2"]
    classes = common.materialize(known.groupBy(*mark).agg(F.min("id").alias("rep"), F.max("id").alias("last")), "classes")
    guess = known.select("id", *mark).join(classes.filter("last > rep").select("rep", *mark), mark).filter("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"), *mark)
    guess = common.materialize(guess.distinct(), "guess")
    alike = _against_hubs(guess.select("a", "b"), docs, id_col, width, lambda x, y: x == y)
    copies = common.materialize(guess.join(alike.select(F.col("v").alias("a"), F.col("u").alias("b")), ["a", "b"]), "copies")
    # members of a class that is confirmed are left out from here on; a row that isn't confirmed stands for itself
    own = known.join(copies.select(F.col("b").alias("id"), *mark), ["id", *mark], "left_anti")
    reps = common.materialize(own.dropDuplicates(["id", *mark]).select("id", *mark, "sketch"), "reps")

    # the rarest lists of each representative
    entry = reps.select("id", *mark, F.explode("sketch").alias("value"))
    shared = entry.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1")
    listed = entry.join(shared, "value").select("id", *mark, F.struct("df", "value").alias("e"))
    whole = F.element_at(F.lit([least_shared(n, percent, k) for n in range(1, k + 1)]), F.least("n", F.lit(k)).cast("int"))
    need = F.when(F.col("n") <= k, whole).otherwise(F.lit(t))
    cut = F.least("n", F.lit(k)) - need + 1
    ordered = listed.groupBy("id", *mark).agg(F.array_sort(F.collect_list("e")).alias("es"))  # at most k entries
    # values with df = 1 come first in the order of rarity; they take places of the prefix without making pairs
    left = F.greatest(F.lit(0), cut - (F.least("n", F.lit(k)) - F.size("es"))).cast("int")
    lists = common.materialize(ordered.select("id", "n", F.explode(F.slice("es", F.lit(1), left)).alias("e")).select("id", "n", F.col("e.value").alias("value")), "lists")

    least = percent / 100 - 6 * (percent / 100 * (1 - percent / 100) / k) ** 0.5
    sk_reps = reps.select("id", "sketch")

    def confirmed(pairs, more=None):
        found = _estimated(pairs, sk_reps, k, least)
        found = common.materialize((found.union(more) if more is not None else found).distinct(), "pairs")
        return common.materialize(_verified(found, docs, id_col, width, percent), "links")

    def closed(*links):
        out = links[0]
        for x in links[1:]:
            out = out.union(x)
        return common.materialize(components(out), "comp")

    star = common.materialize(_star(_labelled(lists, None), percent), "star")
    links = [_several_texts(known, copies, mark), confirmed(star)]
    comp = closed(*links)
    open_ = _open(_labelled(lists, comp))
    if not open_.isEmpty():
        links.append(confirmed(_pairs(open_, percent).join(star, ["a", "b"], "left_anti")))
        comp = closed(*links)
        if not (long := open_.filter(F.col("members") > SMALL)).isEmpty():
            lists = common.materialize(_whole_lists(long.select("id").distinct(), docs, id_col, width, percent), "lists")
            links.append(confirmed(_star(_labelled(lists, comp), percent)))
            open_ = _open(_labelled(lists, closed(*links)))
            groups = common.materialize(open_.filter(F.col("members") > SMALL).select("hub", "id", "component").distinct(), "large")
            links.append(confirmed(_pairs(open_, percent), _block_links(groups, docs, id_col, width, percent)))
            comp = closed(*links)
    final = known.select("id", *mark).join(copies.select(F.col("a").alias("rep"), F.col("b").alias("id"), *mark), ["id", *mark], "left").select("id", F.coalesce("rep", "id").alias("node"))
    final = final.distinct().join(comp, "node", "left").groupBy("id").agg(F.min(F.coalesce("component", "node")).alias("component"))
    out = sk.select("id", "n").join(final, "id", "left").withColumn("component", F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def _several_texts(known: DataFrame, copies: DataFrame, mark: list[str]) -> DataFrame:
    """Links (u, v) of a document with the representatives of its texts, where it has several texts."""
    several = known.groupBy("id").agg(F.count_distinct(*mark).alias("texts")).filter("texts > 1")
    return copies.join(several.select(F.col("id").alias("b")), "b", "left_semi").select(F.col("b").alias("u"), F.col("a").alias("v"))
