"""Language identification with interpolated Kneser-Ney character language models.

One trigram model per language. All languages share the sorted arrays of hashed n-grams (the hash packs three
code points into 63 bits, so it has no collisions); a row of the value matrix holds the n-gram's log probability
in each language, already interpolated, so that most positions cost one binary search. The language with the
lowest cross-entropy per character wins. Rejection thresholds and the scale of the confidence are calibrated on
labelled rows that are kept out of the counts, and on these alone: a text's cross-entropy is standardised by its language and
length band, and the tail of all held rows beyond their 90 % quantile, taken for exponential, gives the limit that a stated
share of accepted texts would pass.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, functions as F

from . import common

SEP = 1  # code point that marks a boundary between texts
BANDS = (0, 40, 160, 640, 2560)
UND = "und"
_MASK = (1 << 21) - 1


@dataclass
class Model:
    langs: list[str]
    keys3: np.ndarray
    lp3: np.ndarray
    ctx2: np.ndarray
    gamma3: np.ndarray
    keys2: np.ndarray
    lp2: np.ndarray
    ctx1: np.ndarray
    gamma2: np.ndarray
    keys1: np.ndarray
    lp1: np.ndarray
    floor: float
    limits: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: float = 1.0


def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, two separators before each; and where each text's own start."""
    low = [t.lower().replace("\x01", " ") for t in texts]
    joined = "".join("\x01\x01" + t for t in low)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    sizes = np.fromiter((len(t) + 2 for t in low), dtype=np.int64, count=len(low))
    return codes, np.cumsum(sizes) - sizes


def trigrams(codes: np.ndarray) -> np.ndarray:
    """Keys of the trigrams that end at positions 2.. ; those that end in a separator are to be skipped."""
    return (codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:]


def has_letter(text: str, first=re.compile(r"[^\W\d_]")) -> bool:
    return any(m[0].isalpha() for m in first.finditer(text))


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, keys[at] == wanted


def fit(langs: list[str], lang: np.ndarray, key: np.ndarray, n: np.ndarray, discount: float = 0.75) -> Model:
    """Models from rows (language number, trigram key, count)."""
    k3, k2, c2, k1, c1 = (np.unique(x) for x in (key, key & (1 << 42) - 1, key >> 21, key & _MASK, (key >> 21) & _MASK))
    size = len(langs)
    v = max(1, len(k1))
    lp3, g3 = np.zeros((len(k3), size)), np.zeros((len(c2), size))
    lp2, g2 = np.zeros((len(k2), size)), np.zeros((len(c1), size))
    lp1 = np.zeros((len(k1), size))
    floor = 1.0 / (v + 1)
    for j in range(size):
        mine = lang == j
        key_j, n_j = key[mine], n[mine].astype(float)
        # continuation counts: distinct left neighbours
        big, big_n = np.unique(key_j & (1 << 42) - 1, return_counts=True)
        uni, uni_n = np.unique(big & _MASK, return_counts=True)
        p1 = np.full(len(k1), discount * len(uni) / max(1, uni_n.sum()) * floor if len(uni) else floor)
        p1[np.searchsorted(k1, uni)] += np.maximum(uni_n - discount, 0) / max(1, uni_n.sum())
        lp1[:, j] = p1
        total1, kinds1 = np.zeros(len(c1)), np.zeros(len(c1))
        mid = np.searchsorted(c1, big >> 21)
        np.add.at(total1, mid, big_n)
        np.add.at(kinds1, mid, 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            g2[:, j] = np.where(total1 > 0, discount * kinds1 / total1, 1.0)
        p2 = np.zeros(len(k2))
        mid2 = np.searchsorted(c1, k2 >> 21)
        p2[np.searchsorted(k2, big)] = np.maximum(big_n - discount, 0)
        p2 = p2 / np.maximum(total1[mid2], 1) + g2[mid2, j] * p1[np.searchsorted(k1, k2 & _MASK)]
        lp2[:, j] = p2
        total2, kinds2 = np.zeros(len(c2)), np.zeros(len(c2))
        ctx = np.searchsorted(c2, key_j >> 21)
        np.add.at(total2, ctx, n_j)
        np.add.at(kinds2, ctx, 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            g3[:, j] = np.where(total2 > 0, discount * kinds2 / total2, 1.0)
        p3 = np.zeros(len(k3))
        p3[np.searchsorted(k3, key_j)] = np.maximum(n_j - discount, 0)
        ctx3 = np.searchsorted(c2, k3 >> 21)
        lp3[:, j] = p3 / np.maximum(total2[ctx3], 1) + g3[ctx3, j] * p2[np.searchsorted(k2, k3 & (1 << 42) - 1)]
    log = lambda a: np.log(np.maximum(a, 1e-12)).astype(np.float32)
    return Model(langs, k3, log(lp3), c2, log(g3), k2, log(lp2), c1, log(g2), k1, log(lp1), float(np.log(floor)))


def log_probs(m: Model, key: np.ndarray) -> np.ndarray:
    """Log probability of each trigram's last character, for each language."""
    if not len(m.keys3):
        return np.full((len(key), len(m.langs)), m.floor, np.float32)
    at, hit = _find(m.keys3, key)
    out = m.lp3[at]
    if len(miss := np.flatnonzero(~hit)):
        k = key[miss]
        at, hit = _find(m.ctx2, k >> 21)
        back = np.where(hit[:, None], m.gamma3[at], np.float32(0))
        at, hit = _find(m.keys2, k & (1 << 42) - 1)
        low = m.lp2[at]
        if len(miss2 := np.flatnonzero(~hit)):
            k2 = k[miss2]
            at, hit = _find(m.ctx1, (k2 >> 21) & _MASK)
            at1, hit1 = _find(m.keys1, k2 & _MASK)
            low[miss2] = np.where(hit[:, None], m.gamma2[at], np.float32(0)) + np.where(hit1[:, None], m.lp1[at1], np.float32(m.floor))
        out[miss] = back + low
    return out


def cross_entropy(m: Model, texts: list[str], step: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """(characters, nats per character in each language) of each text; whole texts, in steps of bounded memory."""
    codes, starts = encode(texts)
    total, n = np.zeros((len(texts), len(m.langs))), np.zeros(len(texts), np.int64)
    if len(codes) > 2:
        owner_end = np.append(starts[1:], len(codes))
        for a in range(2, len(codes), step):
            b = min(a + step, len(codes))
            part = codes[a - 2 : b]
            lp = log_probs(m, trigrams(part))
            own = part[2:] != SEP
            lp[~own] = 0
            first, last = np.searchsorted(owner_end, a, "right"), np.searchsorted(owner_end, b - 1, "right")
            cuts = np.maximum(starts[first : last + 1], a) - a
            total[first : last + 1] -= np.add.reduceat(lp, cuts, axis=0, dtype=np.float64)
            n[first : last + 1] += np.add.reduceat(own, cuts, dtype=np.int64)
    return n, total / np.maximum(n, 1)[:, None]


def _confidence(h: np.ndarray, n: np.ndarray, scale: float) -> np.ndarray:
    z = -(h - h.min(axis=1, keepdims=True)) * scale * np.sqrt(np.maximum(n, 1))[:, None]
    e = np.exp(z)
    return e.max(axis=1) / e.sum(axis=1)


def predict(m: Model, texts: list[str | None]) -> dict[str, list]:
    """Prediction, confidence, cross-entropy and rejection of each text; ``und`` for a null or letterless text."""
    known = [t or "" for t in texts]
    ok = np.array([bool(t) and has_letter(t) for t in known], bool)
    if not m.langs:
        return {"lang_pred": [UND] * len(texts), "score": [0.0] * len(texts), "cross_entropy": [0.0] * len(texts), "rejected": [True] * len(texts)}
    n, h = cross_entropy(m, known)
    best = h.argmin(axis=1)
    xent = h.min(axis=1)
    band = np.searchsorted(BANDS, n, "right") - 1
    rejected = ~ok | (xent > m.limits[band, best] if len(m.limits) else False)
    score = np.where(ok, _confidence(h, n, m.scale), 0.0)
    return {
        "lang_pred": [m.langs[b] if o else UND for b, o in zip(best, ok)],
        "score": score, "cross_entropy": np.where(ok, xent, 0.0), "rejected": rejected,
    }


def rejection_limits(band: np.ndarray, truth: np.ndarray, own: np.ndarray, langs: int, rate: float) -> np.ndarray:
    """(bands, languages): cross-entropies that about ``rate`` of the texts of their own language exceed.

    ``own``: of held rows, in their own language. Means and deviations of a language and band with few rows lean on those of
    the language (as five rows would) and of all rows. Without held rows nothing is rejected.
    """
    limits = np.full((len(BANDS), langs), np.inf)
    if not len(own):
        return limits
    lean, all_sd = 5, max(float(own.std()), 1e-3)
    mean, sd = np.zeros_like(limits), np.zeros_like(limits)
    for j in range(langs):
        mine = own[truth == j]
        m_j = mine.mean() if len(mine) else own.mean()
        v_j = (((mine - m_j) ** 2).sum() + lean * all_sd**2) / (len(mine) + lean)
        for b in range(len(BANDS)):
            x = own[(truth == j) & (band == b)]
            mean[b, j] = (x.sum() + lean * m_j) / (len(x) + lean)
            sd[b, j] = np.sqrt((((x - mean[b, j]) ** 2).sum() + lean * v_j) / (len(x) + lean))
    z = (own - mean[band, truth]) / sd[band, truth]
    u = np.quantile(z, 0.9)
    excess = z[z > u] - u
    limit = u + (excess.mean() if len(excess) else 1.0) * np.log(0.1 / rate)
    limits = mean + limit * sd
    return np.maximum.accumulate(limits[::-1])[::-1]  # a shorter text varies more, so its limit is no lower


def train(docs: DataFrame, learn, per_lang: int = 1500, calibrate: float = 0.25, rate: float = 1e-4, most_langs: int = 256) -> Model:
    """A model from at most about ``per_lang`` labelled rows of each language among those where ``learn`` holds.

    The sample is drawn by a hash of the text, so it doesn't depend on the partitioning, and holds each text once: a text
    that a third of all rows copy is one row of it. A share ``calibrate`` of it stays out of the counts; from these rows alone
    come the rejection limits, see ``rejection_limits``, and the scale of the confidence. The ``most_langs`` languages
    with the most rows are learned.
    """
    spark = docs.sparkSession
    rows = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_langs).collect()}
    langs = sorted(counts)
    if not langs:
        return Model([], *(np.zeros(0, np.int64) for _ in range(10)), 0.0)
    share = F.create_map(*(F.lit(x) for p in counts.items() for x in (p[0], min(1.0, per_lang / p[1]))))
    draw = (F.xxhash64("text", F.lit(7)).bitwiseAND(F.lit((1 << 30) - 1))) / float(1 << 30)
    keep = F.xxhash64("text", F.lit(8)).bitwiseAND(F.lit(1023)) < int(calibrate * 1024)
    sample = common.materialize(rows.filter(draw < F.coalesce(share[F.col("lang")], F.lit(0.0))).select("lang", "text", keep.alias("held")).distinct(), "langid")

    def count(it):
        for batch in it:
            lang, text = common.column(batch, "lang"), common.column(batch, "text")
            for a, b in common.batches(text):
                parts = []
                for j in set(lang[a:b]):
                    codes, _ = encode([t for t, x in zip(text[a:b], lang[a:b]) if x == j])
                    keys, n = np.unique(trigrams(codes)[codes[2:] != SEP], return_counts=True)
                    parts.append((j, keys, n))
                yield {"lang": [j for j, k, _ in parts for _ in k], "key": np.concatenate([k for _, k, _ in parts] or [[]]), "n": np.concatenate([n for _, _, n in parts] or [[]])}

    got = common.arrow(sample.filter(~F.col("held")), count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")).toArrow()
    number = {x: j for j, x in enumerate(langs)}
    model = fit(langs, np.array([number[x] for x in got["lang"].to_pylist()], np.int64), got["key"].to_numpy().astype(np.int64), got["n"].to_numpy())

    def measure(it):
        for batch in it:
            lang, text = common.column(batch, "lang"), common.column(batch, "text")
            for a, b in common.batches(text):
                n, h = cross_entropy(model, text[a:b])
                yield {"lang": lang[a:b], "n": n, "h": list(h)}

    seen = common.arrow(sample.filter("held"), measure, "lang string, n long, h array<double>").collect()
    common.drop_table(sample)
    truth, n, h = np.array([number[r["lang"]] for r in seen], np.int64), np.array([r["n"] for r in seen]), np.array([r["h"] for r in seen]).reshape(-1, len(langs))
    band, own = np.searchsorted(BANDS, n, "right") - 1, h[np.arange(len(h)), truth]
    model.limits = rejection_limits(band, truth, own, len(langs), rate)
    if not len(seen):
        return model
    # scale of the confidence: least log loss on the held rows
    losses = []
    for s in (grid := np.geomspace(0.05, 20, 25)):
        z = -(h - h.min(axis=1, keepdims=True)) * s * np.sqrt(np.maximum(n, 1))[:, None]
        p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
        losses.append(-np.log(np.maximum(p[np.arange(len(p)), truth], 1e-6)).mean())
    model.scale = float(grid[int(np.argmin(losses))])
    return model


def identify(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` columns of every row of ``docs`` with lang_pred, score, cross_entropy and rejected.

    A null, empty or letterless text is ``und``, scores 0 and is rejected; so is every text if no language was learned.
    Repeated rows give repeated results, an empty table an empty one; result names that clash with kept columns get
    underscores.
    """
    names = ("lang_pred", "score", "cross_entropy", "rejected")

    def work(texts):
        got = predict(model, texts)
        return [got[n] for n in names]

    return common.per_text(docs, keep, "lang_pred string, score double, cross_entropy double, rejected boolean", work)
