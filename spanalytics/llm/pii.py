"""Personal data: pattern spans plus a character-level bidirectional LSTM with CRF transitions, trained in numpy.

The network reads characters (lower-case ASCII letters, digits as one symbol, upper-case and other letters, each ASCII sign) and
is trained on labelled spans: texts of invented words that hold personal data in usual and unusual writings
("joe at example dot com", 10[.]0[.]0[.]1, cards with dots), and look-alikes that are none. Its gates are the piecewise linear ones
(clip(x / 4 + 1/2, 0, 1), and clip(x, -1, 1) for the cell), which numpy computes several times faster than exponentials.

Every text is tiled whole by overlapping windows, and the network reads all of them. A window where no tag but "outside" can pay
at any position, whatever the path, needs no search: its best path is known. The others are decoded by Viterbi. A span that a
window's edge cuts is joined to its continuation in the next window, over as many windows as it has; the spans of all windows of a
text are then reconciled globally by weighted interval scheduling. Those that pass their kind's check and overlap no
pattern span are added.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_right
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from . import common

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
#: Characters of a window and from one to the next, and of a window of the training.
WIDTH, STRIDE, LEARNT = 256, 208, 64
#: Windows that Viterbi decodes at a time.
DECODED = 256
HIDDEN = 16
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
Span = tuple[int, int, int]  # kind number, start, end


def digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """Leftmost non-overlapping matches, found from each @ outwards so that long runs of letters stay linear."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        s = at
        while s > free and text[s - 1] in _LOCAL:
            s -= 1
        m = _DOMAIN.match(text, at + 1) if s < at else None
        if m:
            out.append((0, s, m.end()))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    return out


def pattern_spans(text: str) -> list[Span]:
    """Spans of the patterns: by kind as in KINDS, then by start."""
    out = emails(text)
    if re.search("[0-9]", text):
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        out += [(2, m.start(), m.end()) for m in _CARD.finditer(text) if 16 <= len(d := digits(m[0])) <= 19 and luhn(d)]
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]
    return out


# characters ------------------------------------------------------------------------------------------------------------


def _symbols() -> np.ndarray:
    t = np.full(0x250, 3, np.uint8)  # other characters: taken for letters
    t[:128] = 4
    t[48:58], t[65:91] = 0, 1
    t[[32, 160]], t[[9, 10, 11, 12, 13]] = 5, 6
    for i, c in enumerate("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~abcdefghijklmnopqrstuvwxyz"):
        t[ord(c)] = 7 + i
    return t


_TABLE = _symbols()
SYMBOLS = int(_TABLE.max()) + 2  # and one for the padding
PAD = SYMBOLS - 1


def symbols(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _TABLE[np.minimum(codes, len(_TABLE) - 1)]


# the network -----------------------------------------------------------------------------------------------------------
# Both directions are one array: axis 0 is the direction, and the second one reads and writes in reverse.


def init(rng: np.random.Generator) -> dict[str, np.ndarray]:
    p = {"X": rng.normal(0, 0.3, (2, 4, SYMBOLS, HIDDEN)), "U": rng.normal(0, HIDDEN**-0.5, (2, 4, HIDDEN, HIDDEN)), "W": rng.normal(0, 0.2, (2, HIDDEN, TAGS)), "c": np.zeros(TAGS), "T": rng.normal(0, 0.1, (TAGS, TAGS))}
    p["X"][:, 0] += 1  # gates: forget, in, out, new
    return {k: v.astype(np.float32) for k, v in p.items()}


def states(p, x: np.ndarray, tape: list | None = None) -> np.ndarray:
    """Hidden states (2, steps, n, HIDDEN) of windows of symbols (steps, n); the second direction's are in reverse order.

    One direction after the other, so that what a step works on stays in a core's cache.
    """
    steps, n = x.shape
    kind, h_ = p["X"].dtype, HIDDEN
    # the gates' slope and middle are put into the weights
    slope, middle = (np.array(v, kind)[:, None, None] for v in ([0.25, 0.25, 0.25, 1], [0.5, 0.5, 0.5, 0]))
    table, u = p["X"] * slope + middle, p["U"] * slope
    hs = np.empty((2, steps, n, h_), kind)
    if tape is not None:
        tape += [tuple(np.empty((2, *more, n, h_), kind) for more in ((4,), (), ())) for _ in range(steps)]
    a, b = np.empty((4, n, h_), kind), np.empty((4, n, h_), kind)
    f, i, o, new = a
    c, work = np.empty((n, h_), kind), np.empty((n, h_), kind)
    x = x.astype(np.intp)
    for d in (0, 1):
        c[:], h = 0, np.zeros((n, h_), kind)
        for t in range(steps):
            for gate in range(4):
                table[d, gate].take(x[t] if d == 0 else x[-1 - t], 0, a[gate], "clip")
            a += np.matmul(h, u[d], out=b)
            a[:3].clip(0, 1, out=a[:3])
            new.clip(-1, 1, out=new)
            if tape is not None:
                for to, now in zip(tape[t], (a, c, h)):
                    to[d] = now
            np.multiply(c, f, out=c)
            np.multiply(i, new, out=work)
            c += work
            h = hs[d, t]
            c.clip(-1, 1, out=h)
            h *= o
    return hs


def emissions(p, hs: np.ndarray) -> np.ndarray:
    """Tag scores (steps, n, TAGS)."""
    return hs[0] @ p["W"][0] + hs[1, ::-1] @ p["W"][1] + p["c"]


def _states_back(p, x, tape, dhs, g) -> None:
    steps, n = x.shape
    dh, dc = np.zeros_like(dhs[:, 0]), np.zeros_like(dhs[:, 0])
    das = np.empty((2, 4, steps, n, HIDDEN), dhs.dtype)
    back = p["U"].transpose(0, 1, 3, 2)
    for t in range(steps - 1, -1, -1):
        a, c0, h0 = tape[t]
        f, i, o, new = (a[:, j] for j in range(4))
        c = c0 * f + i * new
        dh = dh + dhs[:, t]
        dc = dc + dh * o * (np.abs(c) < 1)
        da = np.stack([dc * c0, dc * new, dh * np.clip(c, -1, 1), dc * i], 1)
        da[:, :3] *= 0.25 * ((a[:, :3] > 0) & (a[:, :3] < 1))
        da[:, 3] *= np.abs(new) < 1
        das[:, :, t] = da
        g["U"] += h0[:, None].transpose(0, 1, 3, 2) @ da
        dh, dc = (da @ back).sum(1), dc * f
    for d in (0, 1):
        hot = np.zeros((steps * n, SYMBOLS), dhs.dtype)
        hot[np.arange(steps * n), (x if d == 0 else x[::-1]).ravel()] = 1
        g["X"][d] = hot.T @ das[d].reshape(4, -1, HIDDEN)


def gradients(p, x: np.ndarray, y: np.ndarray):
    """Mean negative log likelihood of the CRF for symbols and tags (steps, n), and its gradients."""
    tape: list = []
    hs = states(p, x, tape)
    s = emissions(p, hs)
    steps, n, _ = s.shape
    top = s.max(2, keepdims=True)
    e, m = np.exp(s - top), np.exp(p["T"])
    a, b, z = np.empty_like(s), np.ones_like(s), np.empty((steps, n, 1), s.dtype)
    for t in range(steps):
        a[t] = e[t] * (a[t - 1] @ m if t else 1)
        z[t] = a[t].sum(1, keepdims=True)
        a[t] /= z[t]
    for t in range(steps - 2, -1, -1):
        b[t] = (e[t + 1] * b[t + 1] / z[t + 1]) @ m.T
    at = np.ogrid[:steps, :n]
    gold = s[(*at, y)].sum() + p["T"][y[:-1], y[1:]].sum()
    ds = a * b
    ds[(*at, y)] -= 1
    ds /= n
    pair = a[:-1].reshape(-1, TAGS).T @ (e[1:] * b[1:] / z[1:]).reshape(-1, TAGS) * m
    np.subtract.at(pair, (y[:-1].ravel(), y[1:].ravel()), 1)
    g = {k: np.zeros_like(v) for k, v in p.items()}
    g["T"], g["c"] = pair / n, ds.sum((0, 1))
    two = np.stack([ds, ds[::-1]])
    flat = two.reshape(2, -1, TAGS)
    g["W"] = hs.reshape(2, -1, HIDDEN).transpose(0, 2, 1) @ flat
    _states_back(p, x, tape, (flat @ p["W"].transpose(0, 2, 1)).reshape(hs.shape), g)
    return float((np.log(z).sum() + top.sum() - gold) / n), g


def allowed() -> np.ndarray:
    """-inf where a tag can't follow: an inside tag needs its kind's begin or inside before it."""
    a = np.zeros((TAGS, TAGS), np.float32)
    for k in range(len(KINDS)):
        a[:, 2 + 2 * k] = -np.inf
        a[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = 0
    return a


def viterbi(p, s: np.ndarray) -> np.ndarray:
    """Best paths (steps, n). The first tag may be an inside one: the span begins before the window.

    The tag before one is sought on the way back, for the path's tag alone.
    """
    steps, n, _ = s.shape
    t_ = p["T"] + allowed()
    best = np.empty((steps, TAGS, n), np.result_type(s, t_))
    best[0] = s[0].T
    m = np.empty((TAGS, TAGS, n), best.dtype)
    for t in range(1, steps):
        np.add(best[t - 1][:, None], t_[:, :, None], out=m)
        m.max(0, out=best[t])
        best[t] += s[t].T
    path = np.empty((steps, n), np.int8)
    path[-1] = best[-1].argmax(0)
    for t in range(steps - 1, 0, -1):
        path[t - 1] = (best[t - 1].T + t_.T[path[t]]).argmax(1)
    return path


def undecided(p, hs: np.ndarray) -> np.ndarray:
    """The windows whose best path may not be all outside.

    Against that path, a stretch of other tags gains at most each position's best gain over outside, plus the best gain of the
    transitions into, in and out of it (at the window's edges there is none into or out of it). Where no stretch of a window
    comes above zero by this bound (its largest sum, found in one pass), no path beats the one outside.
    """
    _, steps, n, _ = hs.shape
    w = p["W"][:, :, 1:] - p["W"][:, :, :1]
    # a product for each step: larger ones would start threads, which wait busily in every task
    gain = np.empty((steps, n), hs.dtype)
    over = (p["c"][1:] - p["c"][0])[:, None]
    one, two = (np.empty((TAGS - 1, n), hs.dtype) for _ in range(2))
    for t in range(steps):
        np.matmul(w[0].T, hs[0, t].T, out=one)
        one += np.matmul(w[1].T, hs[1, steps - 1 - t].T, out=two)
        one += over
        one.max(0, out=gain[t])
    t_ = p["T"] + allowed() - p["T"][0, 0]
    into, inside, out = t_[0, 1:].max(), t_[1:, 1:].max(), t_[1:, 0].max()
    run = gain[0].copy()
    best = run + (out if steps > 1 else 0)
    for t in range(1, steps):
        np.maximum(run + inside, into, out=run)
        run += gain[t]
        np.maximum(best, run + (out if t + 1 < steps else 0), out=best)
    return np.flatnonzero(best > -1e-3)


# labelled spans ----------------------------------------------------------------------------------------------------------

_LETTERS, _LOWER = "aeioubcdfghklmnprstvwzéñü", "abcdefghijklmnopqrstuvwxyz"
_SMALL = ("at", "dot", "a", "of", "the", "le", "la", "de", "der", "und", "el", "y", "en", "to", "in")


def _some(r: random.Random, least: int, most: int, of: str = _LOWER) -> str:
    return "".join(r.choices(of, k=r.randint(least, most)))


def _card_number(r: random.Random, n: int) -> str:
    head = r.choice("123456789") + _some(r, n - 2, n - 2, "0123456789")
    return next(head + str(c) for c in range(10) if luhn(head + str(c)))


def sample_span(r: random.Random) -> tuple[int, str]:
    """A kind and a text of that kind, or kind -1 and a look-alike."""
    kind, digits_ = r.randint(-3, 3), "0123456789"
    num = lambda n: _some(r, n, n, digits_)
    if kind == 0:
        at = r.choice(["@"] * 6 + [" @ ", "@ ", " (@) ", "[@]", " at ", " (at) ", "[at]", " AT "])
        dot = "." if "@" in at else r.choice([" dot ", ".", " (dot) ", "[dot]"] if at != " AT " else [" DOT "])
        user = r.choice([_some(r, 3, 9), f"{_some(r, 2, 7)}.{_some(r, 3, 8)}", f"{_some(r, 2, 7)}.{num(2)}", f"{_some(r, 3, 7)}_{_some(r, 3, 7)}", f"{_some(r, 3, 6)}+{_some(r, 2, 5)}", f"{_some(r, 1, 4).upper()}{_some(r, 2, 6)}"])
        host = r.choice([f"{_some(r, 3, 9)}{dot}{r.choice(['com', 'org', 'net', 'example', _some(r, 2, 4)])}", f"mail{num(1)}{dot}{_some(r, 4, 8)}{dot}com", f"{_some(r, 3, 8)}-{_some(r, 3, 6)}{dot}org"])
        return 0, user + at + host
    if kind == 1:
        return 1, r.choice(["."] * 5 + [" . ", "[.]", " dot ", "(.)"]).join(str(r.randrange(256)) for _ in range(4))
    if kind == 2:
        n = _card_number(r, r.choice([16, 16, 16, 15, 19]))
        return 2, r.choice(["", " ", "-", ".", "/", "_", "  "]).join(n[i : i + 4] for i in range(0, len(n), 4))
    if kind == 3:
        a, b, c, land = num(3), num(3), num(4), r.randint(1, 99)
        return 3, r.choice([f"+{land} ({a}) {b}-{c}", f"+1 {a}-{b}-{c}", f"+{land}{a}{b}{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"00{land} {a} {b} {c}", f"+{land} {a}/{b}{c}", f"{a}.{b}.{c}"])
    hexes = lambda n: _some(r, n, n, "0123456789abcdef")
    return -1, r.choice([
        num(r.randint(1, 12)), f"{r.randint(1, 9)}.{r.randint(0, 9)}.", f"v{r.randint(1, 9)}.{r.randint(0, 99)}.{r.randint(0, 9)}", f"{r.randint(1900, 2099)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", f"@{_some(r, 3, 8)}",
        "password=" + hexes(18), f'token = "{hexes(40)}"', "AKIA" + _some(r, 16, 16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), f"{r.randint(1, 99)}:{r.randint(10, 59)}", f"${r.randint(1, 9999)}.{num(2)}", f"({num(2)})", f"§{r.randint(1, 99)}.{r.randint(1, 9)}",
        f"{_some(r, 3, 8)} at {_some(r, 3, 8)}", f"a dot {_some(r, 2, 3)}", f"{_some(r, 3, 8)}.{_some(r, 3, 8)}", f"https://{_some(r, 3, 8)}.com/{_some(r, 2, 5)}",
    ])


def sample_text(r: random.Random, least: int, often: float = 0.2) -> tuple[str, list[Span]]:
    """A text of ``least`` characters or more, and its labelled spans."""
    parts, spans, n = [], [], 0
    while n < least:
        if r.random() < often:
            kind, s = sample_span(r)
            if kind >= 0:
                spans.append((kind, n, n + len(s)))
            s += r.choice([" ", ". ", ", ", "\n", "; "])
        else:
            s = r.choice(_SMALL) if r.random() < 0.15 else _some(r, 2, 9, _LETTERS if r.random() < 0.5 else _LOWER)
            s = (s.capitalize() if r.random() < 0.15 else s) + r.choice([" "] * 7 + [". ", ", ", ".\n"])
        parts.append(s)
        n += len(s)
    return "".join(parts), spans


def sample_window(r: random.Random, width: int = LEARNT) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and tags of a window cut out of a labelled text."""
    text, spans = sample_text(r, 2 * width)
    y = np.zeros(len(text), np.int64)
    for k, a, b in spans:
        y[a], y[a + 1 : b] = 1 + 2 * k, 2 + 2 * k
    a = r.randrange(len(text) - width + 1)
    return symbols(text)[a : a + width], y[a : a + width]


@lru_cache(maxsize=2)
def train(windows: int = 8192, epochs: int = 3, batch: int = 64, rate: float = 0.04, seed: int = 5) -> dict[str, np.ndarray]:
    """Adam on ``windows`` labelled windows; the same weights for the same parameters."""
    draw, r = random.Random(seed), np.random.default_rng(seed)
    x, y = map(np.stack, zip(*(sample_window(draw) for _ in range(windows))))
    p = init(r)
    m, v = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}
    steps, step = epochs * (windows // batch), 0
    for _ in range(epochs):
        for part in np.array_split(r.permutation(windows), windows // batch):
            _, g = gradients(p, np.ascontiguousarray(x[part].T), y[part].T)
            step += 1
            norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
            lr, clip = rate * min(1.0, step / 20) * max(0.02, 1 - step / steps), min(1, 20 / max(norm, 1e-9))
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * clip * g[k]
                v[k] = 0.99 * v[k] + 0.01 * (clip * g[k]) ** 2
                p[k] = (p[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return p


# texts -------------------------------------------------------------------------------------------------------------------

_SIGN_AT = re.compile(r"\s?(?:@|\(@\)|\[@\]|\(at\)|\[at\]|(?<=\s)at(?=\s))\s?", re.I)
_SIGN_DOT = re.compile(r"\.|\s?(?:\(dot\)|\[dot\]|(?<=\s)dot(?=\s))\s?", re.I)
_HOST = re.compile(r"[A-Za-z0-9-]*[A-Za-z0-9](?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
_USER = re.compile(r"(?=.*[A-Za-z0-9])[A-Za-z0-9._%+-]+")
_BETWEEN = re.compile(r"\s?(?:\.|\[\.\]|\(\.\)|(?<=\s)dot(?=\s))\s?")
_NUMBERS = re.compile(r"[+(0][0-9 ()./+-]+|[0-9]{3}[-. ][0-9]{3}[-. ][0-9]{4}")


def valid(kind: int, s: str) -> bool:
    """Whether what the network marked can be of its kind, in any of the writings that it was taught."""
    d = digits(s)
    if kind == 0:
        parts = _SIGN_AT.split(s)
        return len(parts) == 2 and bool(_USER.fullmatch(parts[0])) and bool(_HOST.fullmatch(_SIGN_DOT.sub(".", parts[1])))
    if kind == 1:
        parts = _BETWEEN.split(s)
        return len(parts) == 4 and all(x.isascii() and x.isdigit() and len(x) <= 3 and int(x) <= 255 for x in parts)
    if kind == 2:
        return 13 <= len(d) <= 19 and luhn(d)
    return 9 <= len(d) <= 15 and bool(_NUMBERS.fullmatch(s))


def window_starts(n: int) -> np.ndarray:
    """Starts of the windows over a text of n characters; each is in one, the last ends with the text."""
    return np.minimum(np.arange(0, max(n - WIDTH, 0) + STRIDE, STRIDE), max(n - WIDTH, 0))


def schedule(found: dict[Span, float]) -> list[Span]:
    """Non-overlapping spans of the largest total weight."""
    spans = sorted(found, key=lambda s: (s[2], s[1], s[0]))
    ends = [s[2] for s in spans]
    best, take = [0.0], []
    for i, s in enumerate(spans):
        j = bisect_right(ends, s[1], 0, i)
        w = best[j] + found[s]
        take.append((w > best[-1], j))
        best.append(max(best[-1], w))
    out, i = [], len(spans)
    while i:
        chosen, j = take[i - 1]
        if chosen:
            out.append(spans[i - 1])
        i = j if chosen else i - 1
    return out[::-1]


def joined(pieces: list[tuple[int, int, int, int, float, bool, bool]]) -> dict[Span, float]:
    """Weighted spans from the pieces (window number, kind, start, end, weight, cut at the left, cut at the right) of one text.

    A piece cut at its right goes on with the piece of its kind in the next window that reaches over its end; where there
    is none, the neighbour, which sees more, says that it is no span, and it is dropped.
    """
    out: dict[Span, float] = {}
    chain = None
    for w, k, s, e, weight, left, right in sorted(pieces):
        if chain and chain[0] == w - 1 and chain[1] == k and s <= chain[3] <= e:
            s0, weight, left = chain[2], chain[4] + weight * (e - chain[3]) / (e - s), chain[5]
            s, now = s0, (w, k, s0, e, weight, left)
        else:
            now = (w, k, s, e, weight, left)
        if right:
            chain = now
        elif not left:
            out[k, s, e] = max(out.get((k, s, e), 0.0), weight)
    return out


def network_spans(p, texts: list[str], step: int = 1024) -> list[list[Span]]:
    """Spans that the network marks in each text, reconciled over its windows; all windows of all texts are read."""
    flat = symbols("".join(texts))
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    starts = [window_starts(len(t)) for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(s) for s in starts])
    number = np.concatenate([np.arange(len(s)) for s in starts] or [np.zeros(0, np.int64)])
    start = np.concatenate([*starts, np.zeros(0, np.int64)]).astype(np.int64)
    long = np.minimum(WIDTH, sizes[owner] - start)
    order = np.argsort(long, kind="stable")
    order = order[long[order] > 0]
    pieces: list[list] = [[] for _ in texts]
    for a in range(0, len(order), step):
        part = order[a : a + step]
        steps = int(long[part].max())
        first, end = (ends - sizes)[owner[part]] + start[part], ends[owner[part]]
        at = first[None, :] + np.arange(steps)[:, None]
        x = np.where(at < end, flat[np.minimum(at, len(flat) - 1)], PAD)
        hs = states(p, x)
        left = undecided(p, hs)
        for some in (left[i : i + DECODED] for i in range(0, len(left), DECODED)):
            score = emissions(p, hs[:, :, some])
            path = viterbi(p, score)
            gain = np.take_along_axis(score, path[:, :, None].astype(np.int64), 2)[:, :, 0] - score[:, :, 0]
            begin = path % 2 == 1
            begin[0] |= path[0] > 0
            for r, t in zip(*np.nonzero(begin.T)):
                w = part[some[r]]
                kind, e, last = (int(path[t, r]) - 1) // 2, int(t) + 1, int(long[w])
                while e < last and path[e, r] == 2 + 2 * kind:
                    e += 1
                s = int(start[w])
                if t < last:
                    pieces[owner[w]].append((int(number[w]), kind, s + int(t), s + e, float(gain[t:e, r].sum()), t == 0 and s > 0, e == last and s + e < sizes[owner[w]]))
        del hs  # or it would be there beside the next one
    return [schedule(joined(f)) for f in pieces]


def detect(p, texts: list[str | None]) -> tuple[list[list[Span]], list[list[Span]]]:
    """(pattern spans, all spans) of each text, by kind as in KINDS and then by start."""
    texts = [t or "" for t in texts]
    base = [pattern_spans(t) for t in texts]
    every = []
    for t, b, more in zip(texts, base, network_spans(p, texts)):
        taken = sorted((s, e) for _, s, e in b)
        starts, reach = [s for s, _ in taken], np.maximum.accumulate([e for _, e in taken]) if taken else []
        new = []
        for k, s, e in more:
            j = bisect_right(starts, e - 1)
            if (not j or reach[j - 1] <= s) and valid(k, t[s:e]):
                new.append((k, s, e))
        every.append(sorted(b + new))
    return base, every


def redacted(text: str | None, spans: list[Span]) -> str | None:
    """The text with each span (overlapping ones together, as the first's kind) replaced by its kind in brackets."""
    if not text or not spans:
        return text
    out, end = [], 0
    for k, s, e in sorted(spans, key=lambda x: (x[1], x[0])):
        if s >= end:
            out += [text[end:s], f"[{KINDS[k].upper()}]"]
        end = max(end, e)
    return "".join(out) + text[end:]


def find_personal_data(docs: DataFrame, keep: list[str], params: dict | None = None) -> DataFrame:
    """``keep`` columns with base (array of kind, start, end), spans (the same with the network's) and redacted text.

    Offsets are code points, ends exclusive. A null text has no spans and stays null; an empty one has none. Every row is
    handled alone, so repeated rows give repeated results, and an empty table an empty one. Result names that clash
    with kept columns get underscores.
    """
    p = params or train()
    spans = "array<struct<kind:int,start:int,end:int>>"

    def work(texts):
        base, every = detect(p, texts)
        rows = [[[dict(zip(("kind", "start", "end"), s)) for s in x] for x in found] for found in (base, every)]
        return [*rows, [redacted(t, s) for t, s in zip(texts, every)]]

    return common.per_text(docs, keep, f"base {spans}, spans {spans}, redacted string", work)
