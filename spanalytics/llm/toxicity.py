"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic examples are the positives; unlabelled text is drawn from the learning rows without looking at their
labels. The classifier is linear over the density of vocabulary words (how often one occurs, in proportion to the
text's length): words and stems that are denser, or in more texts, among the positives than the unlabelled texts by several
standard errors, counted by distinct neighbouring words and by groups of near copies, not by texts: a toxic text that has
many copies counts once, for its rare words and against the words that other texts confirm too. It is trained in
numpy on the non-negative risk pi * R_p(+) + max(0, R_u(-) - pi * R_p(-)) with the logistic loss: where the second term falls below zero, the step
goes against it. The class prior pi is the share of toxic rows among the labelled learning rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from . import common

_TOKEN = re.compile(r"[^\W\d_]+")
#: Words of a text over which one occurrence of a vocabulary word counts half.
DENSE = 60
#: Minhashes of a text: bands that bring near copies together, and values of a band.
BANDS, ROWS = 16, 4
_ODD = np.random.default_rng(17).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass
class Model:
    words: dict[str, int]
    weights: np.ndarray
    bias: float
    prior: float


def stems(word: str) -> tuple[str, ...]:
    """The word and, of a longer one, its first four and five letters."""
    return (word, word[:4] + "*", word[:5] + "*") if len(word) > 5 else (word,)


def density(count: float, words: int) -> float:
    return min(1.0, count / (1 + words / DENSE))


def contexts(text: str | None) -> dict[str, tuple[int, float]]:
    """Lower-cased runs of letters of the whole text, and their stems: each with a hash of the words before and after its first
    place, and its density."""
    ws, out = _TOKEN.findall((text or "").lower()), {}
    counts: Counter = Counter()
    for w, n in Counter(ws).items():
        for x in stems(w):
            counts[x] += n
    for i, w in enumerate(ws):
        if w not in out:
            around = zlib.crc32(" ".join([*ws[max(0, i - 1) : i], "", *ws[i + 1 : i + 2]]).encode("utf-8", "surrogatepass"))
            for x in stems(w):
                out.setdefault(x, (around, density(counts[x], len(ws))))
    return out


def signature(found: dict[str, tuple[int, float]]) -> list[int]:
    """Minhashes (BANDS x ROWS) of a text's tokens with their contexts."""
    if not found:
        return []
    x = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) << 32 | a for w, (a, _) in found.items()], np.uint64)
    with np.errstate(over="ignore"):
        h = x[None, :] * _ODD[:, None]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(33)).min(axis=1).astype(np.int64).tolist()


def copy_groups(signatures: list[list[int]], alike: float = 0.4) -> list[int]:
    """A group number for each signature: those that share a band and ``alike`` of their minhashes are linked."""
    up = list(range(len(signatures)))

    def top(i):
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    s = np.array(signatures, np.int64).reshape(len(signatures), BANDS * ROWS)
    for b in range(BANDS):
        first, last = {}, {}
        for i, key in enumerate(map(tuple, s[:, b * ROWS : (b + 1) * ROWS].tolist())):
            for j in {first.setdefault(key, i), last.get(key, i)}:
                if top(i) != top(j) and (s[i] == s[j]).mean() >= alike:
                    up[max(top(i), top(j))] = min(top(i), top(j))
            last[key] = i
    return [top(i) for i in range(len(signatures))]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(positive: list[list], unlabelled: list[list], size: int, prior: float, epochs: int = 60, least_steps: int = 800, batch: int = 512, rate: float = 0.05, decay: float = 3e-5, seed: int = 3) -> tuple[np.ndarray, float]:
    """Weights and bias of the nnPU risk's minimiser, by Adam: ``epochs`` over the rows, and more where that is less than
    ``least_steps``. A row is a list of pairs of a word's number and its density."""

    def matrix(rows):
        x = np.zeros((len(rows), size), np.float32)
        for i, r in enumerate(rows):
            for j, v in r:
                x[i, j] = v
        return x

    r = np.random.default_rng(seed)
    w, b = np.zeros(size), -2.0
    m, v, step = np.zeros(size + 1), np.zeros(size + 1), 0
    xp, xu = matrix(positive), matrix(unlabelled)
    for _ in range(max(epochs, least_steps // max(1, len(xu) // batch))):
        up = np.array_split(r.permutation(len(xu)), max(1, len(xu) // batch))
        pp = np.array_split(r.permutation(len(xp)), len(up)) if len(xp) >= len(up) else [np.arange(len(xp))] * len(up)
        for iu, ip in zip(up, pp):
            p, u = xp[ip], xu[iu]
            w32 = w.astype(np.float32)
            sp, su = _sigmoid(p @ w32 + b), _sigmoid(u @ w32 + b)
            # logistic loss: l(+) = -log s, l(-) = -log(1 - s)
            negative = -np.log1p(-su + 1e-12).mean() + prior * np.log1p(-sp + 1e-12).mean()
            gp = prior * (sp - 1) / len(p)
            gn_u, gn_p = su / len(u), -prior * sp / len(p)
            if negative < 0:  # overfitted: step back up
                gp, gn_u, gn_p = 0 * gp, -gn_u, -gn_p
            gw = p.T @ (gp + gn_p).astype(np.float32) + u.T @ gn_u.astype(np.float32) + decay * w
            g = np.append(gw, (gp + gn_p).sum() + gn_u.sum())
            step += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            d = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            w, b = np.maximum(w - d[:-1], 0), b - d[-1]  # the vocabulary only speaks for toxicity
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame, learn, most: int = 6000, vocabulary: int = 4096, z: float = 7.0, varied: float = 0.5) -> Model:
    """A model from at most about ``most`` confirmed toxic rows and as many unlabelled ones, both among rows of ``docs``
    where ``learn`` holds, drawn by hashes of the id, and for the unlabelled ones of id and text: copies of a text are drawn
    one by one, so a text that a third of all rows copy can't fill the sample. A word needs 2 % of the groups of confirmed texts,
    2 at least and 5 at most, to confirm it. With no confirmed row every text scores 0.
    """
    labelled = docs.select("doc_id", "text").filter(learn & F.col("text").isNotNull())
    known = labels.filter(learn & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = known.agg(F.count("*").alias("n"), F.sum("toxic").alias("p")).first()
    if not counts["p"]:
        return Model({}, np.zeros(0), -30.0, 0.0)
    prior = counts["p"] / counts["n"]
    rows = labelled.agg(F.count("*")).first()[0]
    draw = lambda seed, *c: F.xxhash64(*c, F.lit(seed)).bitwiseAND(F.lit((1 << 30) - 1)) / float(1 << 30)
    # the confirmed rows' ids are drawn first: about ``most`` of them, so that they can be broadcast and no text but the
    # sample's is shuffled
    share = min(1.0, most / counts["p"])
    toxic = known.filter("toxic = 1").withColumn("draw", draw(2, "doc_id")).filter(F.col("draw") < share).orderBy("draw", "doc_id").limit(2 * most).select("doc_id", F.lit(True).alias("hit"))
    # whether a text is in the unlabelled sample does not look at its label
    both = labelled.withColumn("u", draw(1, "doc_id", "text") < min(1.0, most / max(1, rows))).join(F.broadcast(toxic), "doc_id", "left").withColumn("p", F.coalesce("hit", F.lit(False)))

    def words(it):
        for batch in it:
            text = common.column(batch, "text")
            for a, e in common.batches(text):
                part = batch.slice(a, e - a)
                found, p = [contexts(t) for t in text[a:e]], part.column(1).to_pylist()
                yield {"u": part.column(0), "p": part.column(1), "words": [sorted((w, a, v) for w, (a, v) in f.items()) for f in found], "sign": [signature(f) if x else [] for f, x in zip(found, p)]}

    seen = common.materialize(common.arrow(both.filter("u or p").select("u", "p", "text").repartition(32, F.xxhash64("text", "p")), words, "u boolean, p boolean, words array<struct<word:string,around:long,value:double>>, sign array<long>"), "toxicity")
    n = seen.agg(F.count_if("u").alias("u")).first()
    # groups of near copies among the confirmed rows: at most 2 * most signatures come to the driver, and their groups go back
    signs = seen.filter("p and size(sign) > 0").select(F.xxhash64("sign").alias("key"), "sign").dropDuplicates(["key"]).orderBy("key").collect()
    group = copy_groups([r["sign"] for r in signs])
    groups = docs.sparkSession.createDataFrame([(r["key"], g) for r, g in zip(signs, group)], "key long, group long")
    many = max(1, len(set(group)))
    support = max(2, min(5, -(-many // 50)))  # groups that a word must be confirmed by
    told = seen.withColumn("key", F.when(F.col("p"), F.xxhash64("sign"))).join(F.broadcast(groups), "key", "left")
    value = lambda side: F.when(F.col(side), F.col("value"))
    per = told.select("u", "p", "group", F.inline("words")).groupBy("word").agg(
        F.count_if("u").alias("u"), F.coalesce(F.sum(value("u")), F.lit(0.0)).alias("sum_u"), F.coalesce(F.sum(value("u") ** 2), F.lit(0.0)).alias("squares_u"), F.avg(value("p")).alias("mean_p"),
        F.count_distinct(F.when(F.col("p"), F.col("group"))).alias("texts"), F.count_distinct(F.when(F.col("p"), F.col("around"))).alias("around"),
    )
    per = per.withColumn("p", F.least("texts", "around"))
    # deviations of the densities, and of the numbers of texts; half a text more, so that rare words have a deviation
    rate_p, half = F.col("p") / many, F.col("mean_p") / 2
    mean_u, rate_u = (F.col("sum_u") + half) / (n["u"] + 1), (F.col("u") + 0.5) / (n["u"] + 1)
    var_u = (F.col("squares_u") + half * F.col("mean_p")) / (n["u"] + 1) - mean_u**2
    apart = lambda p, u, var: (p - u) / F.sqrt(F.greatest(var, F.lit(0.0)) / many + 1e-12)
    score = F.greatest(apart(rate_p * F.col("mean_p"), mean_u, var_u), apart(rate_p, rate_u, rate_u * (1 - rate_u)))
    chosen = per.filter(F.col("p") >= F.greatest(F.lit(support), F.col("texts") * varied)).withColumn("z", score).filter(F.col("z") >= z).orderBy(F.desc("z"), "word").limit(vocabulary)
    index = {r["word"]: i for i, r in enumerate(chosen.collect())}
    known_words = F.lit(sorted(index)).cast("array<string>")
    density_of = F.map_from_entries(F.transform("words", lambda x: F.struct(x["word"], x["value"])))
    keep = F.transform(F.array_intersect("words.word", known_words), lambda w: F.struct(w.alias("word"), F.element_at(density_of, w).alias("value")))
    x_p, x_u = [], []
    for r in seen.select("u", "p", keep.alias("words")).orderBy("u", "p", F.xxhash64("words")).toLocalIterator():
        ids = [(index[w["word"]], w["value"]) for w in r["words"]]
        if r["p"]:
            x_p.append(ids)
        if r["u"]:
            x_u.append(ids)
    common.drop_table(seen)
    if not x_p or not x_u or not index:
        return Model(index, np.zeros(len(index)), float(np.log(prior / (1 - prior + 1e-9))), prior)
    w, b = fit(x_p, x_u, len(index), prior)
    return Model(index, w, b, prior)


def scores(m: Model, texts: list[str | None]) -> list[float]:
    """Probability of each text; of a null or empty one, that of a text without any known word."""
    weight = {w: m.weights[i] for w, i in m.words.items()}
    four, five = ({w[:-1]: x for w, x in weight.items() if w.endswith("*") and len(w) == n + 1} for n in (4, 5))
    out = []
    for t in texts:
        ws = _TOKEN.findall(t.lower()) if t and weight else []
        found: Counter = Counter()
        for w, n in Counter(ws).items():
            if w in weight:
                found[w] += n
            if len(w) > 5:
                if w[:4] in four:
                    found[w[:4] + "*"] += n
                if w[:5] in five:
                    found[w[:5] + "*"] += n
        out.append(float(_sigmoid(m.bias + sum(weight[w] * density(n, len(ws)) for w, n in found.items()))))
    return out


def score_toxicity(docs: DataFrame, m: Model, keep: list[str]) -> DataFrame:
    """``keep`` columns of every row of ``docs`` with its score from 0 to 1.

    A null or empty text scores like one without a known word. Repeated rows give repeated results, an empty table an empty
    one; a result name that clashes with a kept column gets underscores.
    """
    return common.per_text(docs, keep, "score double", lambda texts: [scores(m, texts)])
