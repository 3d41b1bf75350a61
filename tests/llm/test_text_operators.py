"""PII, secrets, quality, language ID, decontamination and toxicity: against brute force and on edge cases."""

import math
import random
import re
import time
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanalytics.llm import common, decontaminate as D, langid, pii, quality, secrets, toxicity

from .conftest import WORDS, prose

# personal data ---------------------------------------------------------------------------------------------------------

TRICKY = [
    "a@b.c, x.y+z@mail-1.example.com. @no a@ a@b b@c.d@e.f", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 001.002.003.0004 12.34", "4532 0151 1283 0366 and 4532015112830366 and 4532015112830367",
    "+1 (784) 555-9263 +1 +12 3 call +49(0)30.123456 ++12345678", "é+1 784 555 9263 5-5 " * 3, "1" * 50, "a." * 40 + "@x.y", "", "\U0001f600 me@x.org",
]


def brute_pii(t):
    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(2, m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(pii.digits(m[0])) <= 19 and pii.luhn(pii.digits(m[0]))]
    return out + [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(pii.digits(m[0])) <= 15]


def test_pii_patterns():
    r = random.Random(2)
    texts = TRICKY + ["".join(r.choice("ab1234567890 .@+-()") for _ in range(200)) for _ in range(300)]
    for t in texts:
        assert pii.pattern_spans(t) == brute_pii(t)


def random_net(seed, scale=1.0):
    return {k: v.astype(float) * scale for k, v in pii.init(np.random.default_rng(seed)).items()}


def test_pii_gradient():
    p = random_net(1)
    x, y = map(np.stack, zip(*(pii.sample_window(random.Random(i)) for i in range(3))))
    _, g = pii.gradients(p, x.T, y.T)
    for k, at in (("T", (1, 1)), ("W", (0, 1, 1)), ("W", (1, 2, 3)), ("U", (0, 1, 2, 3)), ("U", (1, 3, 1, 1)), ("X", (0, 2, 5, 1)), ("X", (1, 3, 5, 2)), ("c", (0,))):
        two = []
        for e in (1e-5, -2e-5, 1e-5):
            p[k][at] += e
            two.append(pii.gradients(p, x.T, y.T)[0])
        assert g[k][at] == pytest.approx((two[0] - two[1]) / 2e-5, rel=1e-2, abs=1e-4)


def test_pii_states_and_paths():
    """The network step by step, and the best path among all of them."""
    p, r = random_net(3, 2.0), np.random.default_rng(3)
    x = r.integers(0, pii.SYMBOLS, (4, 5))
    hs = pii.states(p, x)
    for d in (0, 1):
        for j in range(5):
            c = h = np.zeros(pii.HIDDEN)
            for t, sym in enumerate(x[:, j] if d == 0 else x[::-1, j]):
                a = p["X"][d, :, sym] + h @ p["U"][d]
                f, i, o = np.clip(a[:3] / 4 + 0.5, 0, 1)
                c = c * f + i * np.clip(a[3], -1, 1)
                h = np.clip(c, -1, 1) * o
                assert np.allclose(hs[d, t, j], h)
    s = pii.emissions(p, hs)
    t_ = p["T"] + pii.allowed()
    paths = np.stack(np.meshgrid(*[np.arange(pii.TAGS)] * 4, indexing="ij"), -1).reshape(-1, 4)
    for j, got in enumerate(pii.viterbi(p, s).T):
        total = s[np.arange(4), j, paths].sum(1) + t_[paths[:, :-1], paths[:, 1:]].sum(1)
        assert total[(paths == got).all(1)][0] == pytest.approx(total.max())


def test_pii_skips_no_path():
    """Windows that are not searched have the path outside; there are some, and others that must be searched."""
    skipped = 0
    for seed in range(40):
        p = random_net(seed, 1.5)
        p["c"][0] += seed / 8
        hs = pii.states(p, np.random.default_rng(seed).integers(0, pii.SYMBOLS, (12, 50)))
        path = pii.viterbi(p, pii.emissions(p, hs))
        some = set(pii.undecided(p, hs).tolist())
        assert set(np.flatnonzero(path.any(0)).tolist()) <= some
        skipped += 50 - len(some)
    assert 100 < skipped < 1900


def test_pii_joins_cut_spans():
    join = pii.joined
    assert join([(0, 1, 5, 20, 2.0, False, False)]) == {(1, 5, 20): 2.0}
    assert join([(0, 0, 100, 256, 3.0, False, True), (1, 0, 208, 300, 92.0, True, False)]) == {(0, 100, 300): 47.0}
    assert join([(0, 0, 9, 256, 1.0, False, True), (1, 0, 208, 464, 1.0, True, True), (2, 0, 416, 500, 1.0, True, False)]).keys() == {(0, 9, 500)}
    # no continuation of its kind in the next window, and none before
    assert join([(0, 0, 9, 256, 1.0, False, True), (1, 2, 208, 300, 1.0, True, False), (3, 0, 700, 720, 1.0, True, False)]) == {}


def test_pii_reads_every_window(monkeypatch):
    texts = ["", "a", "b" * 255, "c" * 256, "d" * 257, "e" * 1000, "word " * 5000]
    for t in texts:
        at = pii.window_starts(len(t))
        assert at[0] == 0 and at[-1] == max(0, len(t) - pii.WIDTH) and (np.diff(at) <= pii.STRIDE).all()
    read, run = [], pii.states
    monkeypatch.setattr(pii, "states", lambda p, x: read.append(x.shape[1]) or run(p, x))
    pii.network_spans(random_net(1), texts, step=7)
    assert sum(read) == sum(len(pii.window_starts(len(t))) for t in texts if t)


def test_pii_viterbi_is_quick():
    """Against the plain search, which keeps the best predecessor of every tag: the same paths in much less time."""
    p, s = pii.init(np.random.default_rng(3)), np.random.default_rng(4).normal(size=(64, 500, pii.TAGS)).astype(np.float32)

    def plain():
        t_, best, back = p["T"] + pii.allowed(), s[0], []
        for t in range(1, len(s)):
            m = best[:, :, None] + t_
            back.append(m.argmax(1))
            best = m.max(1) + s[t]
        path = [best.argmax(1)]
        for b in back[::-1]:
            path.append(b[np.arange(s.shape[1]), path[-1]])
        return np.stack(path[::-1])

    def seconds(f):
        began = time.process_time()
        f()
        return time.process_time() - began

    assert (plain() == pii.viterbi(p, s)).all()
    assert min(seconds(lambda: pii.viterbi(p, s)) for _ in range(5)) < 0.6 * min(seconds(plain) for _ in range(5))


def test_pii_memory_of_undecided_windows():
    """Where Viterbi has to decode all windows, they aren't there twice."""
    text, read = "joe at example dot com " * 9000, []
    p = {k: v.astype(np.float32) for k, v in random_net(1).items()}
    p["W"] *= 20  # no window is decided beforehand
    assert len(pii.undecided(p, pii.states(p, np.tile(pii.symbols(text[:200])[:, None], 3)))) == 3
    tracemalloc.start()
    read = pii.network_spans(p, [text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    states = 2 * pii.WIDTH * len(pii.window_starts(len(text))) * pii.HIDDEN * 4
    assert len(read) == 1 and peak < 2 * states


def test_workers_give_memory_back():
    """What a task freed leaves the process, though something that came later stays."""
    resident, kept = lambda: int(open("/proc/self/statm").read().split()[1]) * 4096, []

    def run(it):
        rows = [np.ones(10_000) for _ in it]  # each too small to be mapped by itself
        kept.append(np.ones(10_000))
        yield len(rows)

    before = resident()
    assert list(common.tidy(run)(range(2500))) == [2500] and resident() - before < 80e6


def test_pii_network_on_labelled_texts():
    """Recall and precision on labelled texts that it was not trained on, whatever their windows."""
    p, r = pii.train(), random.Random(77)
    texts, truth = zip(*(pii.sample_text(r, 1200, 0.08) for _ in range(60)))
    right = marked = 0
    for t, want, got in zip(texts, truth, pii.network_spans(p, list(texts))):
        got = {s for s in got if pii.valid(s[0], t[s[1] : s[2]])}
        right, marked = right + len(got & set(want)), marked + len(got)
    assert right >= 0.93 * sum(map(len, truth)) and right >= 0.97 * marked
    texts = ["thon " * (shift // 5) + "x" * (shift % 5) + " whon joe.kelly at example dot com ends" for shift in range(0, 260, 13)]
    base, every = pii.detect(p, texts)
    assert not any(base) and sum([t[s:e] for _, s, e in x] == ["joe.kelly at example dot com"] for t, x in zip(texts, every)) >= 18


def test_pii_network_adds_and_keeps(spark, docs, none):
    p = pii.train()
    texts = ["the card 4532/0151/1283/0366 of thonnt", "call (784) 555-9263 or +1 (988) 555-2485 4532015112830366 now", "version 4.0. of 2019-03-04, 12 pieces", "whon write to joe.77@mail3.example.com today"]
    base, every = pii.detect(p, texts)
    assert all(set(b) <= set(e) for b, e in zip(base, every))
    assert every[0] == [(2, 9, 28)] and every[2] == [] and len(every[1]) == 3 and len(every[3]) == 1
    assert pii.redacted(texts[3], every[3]) == "whon write to [EMAIL] today"
    got = pii.find_personal_data(docs, docs.columns, p)
    assert got.count() == docs.count() and got.columns[-3:] == ["base_", "spans_", "redacted_"]
    row = {r.doc_id: r for r in got.filter("doc_id >= 400 and doc_id < 500").collect()}
    assert row[400].redacted_ is None and row[401].spans_ == []
    assert pii.find_personal_data(none, none.columns, p).isEmpty()


@pytest.mark.parametrize("kind, s, ok", [(0, "joe at example dot com", True), (0, "a (at) b[dot]org", True), (0, "look at this", False), (0, "the dot at a dot", False), (0, "@b.com", False), (1, "10[.]0[.]0[.]1", True), (1, "1 dot 2 dot 3 dot 4", True), (1, "1.2.3", False), (1, "1.2.3.256", False), (2, "4532.0151.1283.0366", True), (2, "4532.0151.1283.0367", False), (3, "784.555.9263", True), (3, "2019-03-04", False)])
def test_pii_checks(kind, s, ok):
    assert pii.valid(kind, s) == ok


def test_schedule_prefers_total_weight():
    assert pii.schedule({(0, 0, 10): 5.0, (0, 0, 5): 3.0, (0, 5, 10): 3.0}) == [(0, 0, 5), (0, 5, 10)]
    assert pii.schedule({}) == []


# secrets ---------------------------------------------------------------------------------------------------------------


def brute_secrets(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(secrets.ASSIGN, t, re.A) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])


def test_secrets_against_brute_force(spark, docs, none):
    r = random.Random(8)
    parts = ["password=", "TOKEN : '", "api_key\": \"", "secret=abc ", "passwd = token=abcdefgh", "AKIA" + "Z9" * 9, "AKIA12", "0123456789abcdef" * 2, "deadbeef", " é\U0001f600 ", "xY9+/_.=-", "ſecret=abcdefgh", "\n"]
    texts = ["".join(r.choice(parts) for _ in range(12)) for _ in range(200)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in secrets.find_secrets(df, ["doc_id", "text"]).collect():
        assert [tuple(x) for x in row.base] == brute_secrets(row.text or "")
    got = secrets.find_secrets(docs, docs.columns)
    assert got.count() == docs.count() and got.columns[-2:] == ["base_", "spans_"]
    assert secrets.find_secrets(none, none.columns).isEmpty()


def test_many_secrets_in_one_text(spark):
    """Places over many blocks of matches."""
    r = random.Random(7)
    text = " ".join(f"token={'x' * r.randrange(3, 12)}é" + " " * r.randrange(3) for _ in range(5000))
    (row,) = secrets.find_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string"), ["doc_id"]).collect()
    assert [tuple(x) for x in row.base] == brute_secrets(text) and len(row.base) > 2 * secrets.BLOCK


def test_random_tokens_are_found(spark):
    r = random.Random(3)
    ordinary = ["".join(r.choice(["tion", "ment", "ing", "over", "the"]) for _ in range(8)) for _ in range(400)]
    keys = ["".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(28)) for _ in range(40)]
    plain = ["section-2-of-the-documentation-2", "z" * 30 + "1", "xy" * 14 + "7", "ab-12/" * 50_000]
    rows = [(i, f"see {w} here") for i, w in enumerate(ordinary + keys + plain)]
    got = {x.doc_id: [s.kind for s in x.spans] for x in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).collect()}
    hits = sum(got[len(ordinary) + i] == [3] for i in range(len(keys)))
    assert hits >= 30 and not any(got[i] for i in range(len(ordinary))) and not any(got[len(ordinary) + len(keys) + i] for i in range(len(plain)))


# quality ---------------------------------------------------------------------------------------------------------------


def brute_quality(t):
    ws = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
    covered = {j for i in range(len(ws) - 4) if windows[tuple(ws[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_against_brute_force(spark, docs, none):
    r = random.Random(6)
    texts = [" ".join(r.choice("abc#é") for _ in range(r.randrange(40))) + r.choice(["\n", "\x0b", " ", "\n\n"]) * 2 + "a b\na b" for _ in range(150)] + [None, "", "a b c d e f a b c d e", "x " * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, None), (None, 1), (2, 0), (2, 1)], "doc_id long, quality int")
    for row in quality.judge(df, labels).collect():
        n, chars, symbols, dup, rep = want = brute_quality(texts[row.doc_id] or "")
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == want
        assert row.base_failed == (n < 10 or 100 * rep > 20 * n) and row.kept == (not row.base_failed)
    assert quality.judge(docs, labels).count() == docs.count()
    assert quality.judge(none, labels.filter("false")).isEmpty()


@pytest.mark.parametrize("n, k, a", [(10, 0, 0.1), (1000, 2, 0.01), (5000, 30, 0.01), (100000, 200, 0.0033), (50, 5, 0.3)])
def test_binomial_tail(spark, n, k, a):
    exact = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(a) + (n - i) * math.log1p(-a)) for i in range(k + 1))
    got = spark.range(1).select(quality.binomial_tail(F.lit(n), F.lit(k), a)).first()[0]
    assert got == pytest.approx(exact, rel=1e-8)


def brute_kept(texts, labels, allowed=0.05, delta=0.05):
    """The verdict by plain loops, from (id, text) and {id: quality}."""
    grid, shares = quality.GRID, len(quality.SHARES)
    rows, failed = {}, {}
    for i, t in texts:
        t = t or ""
        n, chars, symbols, dup, rep = brute_quality(t)
        ws, lines = re.findall(r"[^\x20\x09-\x0D]+", t), [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        share = lambda a, b: min(1.0, a / b) if b else 0.0
        import unicodedata as u

        kinds = [u.category(c) for c in t]
        upper, letters = kinds.count("Lu"), sum(k[0] == "L" for k in kinds)
        marks = sum(not (k[0] in "LN" or c in " \t\n\x0b\f\r") for c, k in zip(t, kinds))
        x = (share(symbols, chars), share(dup, len(lines)), share(rep, n), share(upper, letters), share(marks, chars), share(n - len(set(ws)), n))
        failed[i] = n < 10 or 100 * rep > 20 * n
        rows[i] = sum(n >= least for least in quality.BANDS), [math.floor(v * grid) for v in x]
    passed = [i for i in rows if not failed[i]]
    bad, good, free = ([i for i in passed if labels.get(i) == q] for q in (0, 1, None))
    prior = len(bad) / max(1, len(bad) + len(good))
    score = {}
    for i in passed:
        s, bs = rows[i]
        mine = [j for j in free if rows[j][0] == s]
        score[i] = max(min(1.0, prior * (sum(rows[j][1][k] >= bs[k] for j in bad) / (len(bad) + 1)) / ((sum(rows[j][1][k] >= bs[k] for j in mine) + 1) / (len(mine) + 1))) for k in range(shares))
    cuts = {}
    for s in range(len(quality.BANDS) + 1):
        levels = [math.floor(score[i] * grid) for i in good if rows[i][0] == s]
        for cut in range(grid, grid // 2 - 1, -1):
            n, k = len(levels), sum(x >= cut for x in levels)
            if k >= n * allowed or sum(math.comb(n, j) * allowed**j * (1 - allowed) ** (n - j) for j in range(k + 1)) > delta / (len(quality.BANDS) + 1):
                break
            cuts[s] = cut
    return {i: not failed[i] and math.floor(score[i] * grid) < cuts.get(rows[i][0], grid + 1) for i in rows}, cuts


def test_quality_verdict_against_brute_force(spark):
    """The given tables: the verdict of all rows, from the same labels, by plain loops; the method rejects on them."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    known = {x.doc_id: x.quality for x in labels.collect() if x.quality is not None}
    want, cuts = brute_kept([(x.doc_id, x.text) for x in docs.select("doc_id", "text").collect()], known)
    got = quality.judge(docs, labels).collect()
    assert {x.doc_id: x.kept for x in got} == want
    assert len(cuts) >= 2 and sum(not x.kept and not x.base_failed for x in got) > 5


def test_cutoffs_limit_false_rejection(spark):
    """Half of the labels choose the cutoffs; on the other half each stratum loses no more good rows than allowed."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    got = quality.judge(docs, labels.filter(half)).join(labels.filter(~half).select("doc_id", "quality"), "doc_id").filter("not base_failed")
    rows = got.select("n_words", "quality", "kept").collect()
    good = [x for x in rows if x.quality == 1]
    for low, high in zip((0, *quality.BANDS), (*quality.BANDS, 10**9)):
        mine = [x.kept for x in good if low <= x.n_words < high]
        assert mine.count(False) <= 0.05 * len(mine)
    bad = [x.kept for x in rows if x.quality == 0]
    assert bad.count(False) >= 0.7 * len(bad) > 70


# languages -------------------------------------------------------------------------------------------------------------


def test_kneser_ney_sums_to_one():
    texts = ["abracadabra", "banana band"]
    codes, _ = langid.encode(texts)
    keys, n = np.unique(langid.trigrams(codes)[codes[2:] != langid.SEP], return_counts=True)
    m = langid.fit(["x"], np.zeros(len(keys), int), keys, n)
    letters = np.unique(codes[codes != langid.SEP])
    for a, b in (("a", "b"), ("b", "a"), ("z", "q"), ("n", "a")):
        key = (np.int64(ord(a)) << 42) | (np.int64(ord(b)) << 21) | letters.astype(np.int64)
        assert 0.95 < np.exp(langid.log_probs(m, key)).sum() < 1.0001


def test_langid(spark, docs, none, corpus):
    model = langid.train(docs, common.fold(F.col("doc_id")) != 2)
    got = langid.identify(docs, model, docs.columns)
    assert got.columns[-4:] == ["lang_pred_", "score_", "cross_entropy", "rejected_"]
    rows = got.collect()
    assert len(rows) == len(corpus)
    prose_rows = [x for x in rows if x.doc_id is not None and x.doc_id < 400 or x.doc_id == 500]
    assert sum(x.lang == x.lang_pred_ for x in prose_rows) >= 0.95 * len(prose_rows)
    assert all(not x.rejected_ for x in prose_rows) and all(0 <= x.score_ <= 1 for x in rows)
    odd = {x.doc_id: x for x in rows}
    assert all(odd[i].lang_pred_ == "und" and odd[i].rejected_ for i in (400, 401, 402, 403, 502, 503))
    assert langid.identify(none, model, none.columns).isEmpty()
    empty = langid.train(none, F.lit(True))
    assert {x.lang_pred_ for x in langid.identify(docs, empty, docs.columns).collect()} == {"und"}


def test_rejection_limits():
    """About the stated share of held texts of one's own language is rejected, and texts of no known language are."""
    r = np.random.default_rng(2)
    truth, band = r.integers(0, 3, 6000), r.integers(0, 5, 6000)
    own = 2 + truth * 0.3 - band * 0.1 + r.normal(0, 0.1, 6000) / (1 + band)
    for rate in (0.05, 0.01, 0.002):
        limits = langid.rejection_limits(band[:3000], truth[:3000], own[:3000], 3, rate)
        out = (own[3000:] > limits[band[3000:], truth[3000:]]).mean()
        assert out <= 3 * rate + 0.001 and (rate < 0.01 or out >= rate / 4)
    assert np.isinf(langid.rejection_limits(band[:0], truth[:0], own[:0], 3, 0.01)).all()


def test_training_rows_never_reach_calibration(spark, monkeypatch):
    """The texts that are counted and those that calibrate are apart, and both come from the learning rows."""
    r = random.Random(4)
    rows = [(i, prose(r, "en", 20) + f" x{i}", "en") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    parts, run = [], common.arrow

    def seen(table, f, schema):
        if "text" in table.columns:
            parts.append({x.text for x in table.select("text").collect()})
        return run(table, f, schema)

    monkeypatch.setattr(common, "arrow", seen)
    langid.train(df, F.col("doc_id") < 200)
    counted, held = parts
    assert not counted & held and counted | held == {t for i, t, _ in rows if i < 200} and len(held) > 25


def test_copies_do_not_fill_the_samples(spark, monkeypatch):
    """A text that most rows copy is one row of the language sample, and is drawn copy by copy for toxicity."""
    r = random.Random(2)
    rows = [(i, "one and the same text", "en", 0) for i in range(4000)] + [(4000 + i, prose(r, "en", 20) + " zorkface" * (i % 2), "en", i % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int").repartition(4, "doc_id")
    sizes, write = {}, common.materialize

    def counted(table, name):
        out = write(table, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(common, "materialize", counted)
    langid.train(df.select("doc_id", "text", "lang"), F.lit(True), per_lang=4400)
    assert sizes["langid"] == 401
    toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"), F.lit(True), most=300)
    assert 300 <= sizes["toxicity"] <= 600


def test_cross_entropy_in_steps():
    r = random.Random(1)
    texts = [prose(r, "en", 300), "", prose(r, "de", 50), "é"]
    codes, _ = langid.encode(texts)
    keys, n = np.unique(langid.trigrams(codes)[codes[2:] != langid.SEP], return_counts=True)
    m = langid.fit(["x", "y"], np.arange(len(keys)) % 2, keys, n)
    whole, parts = langid.cross_entropy(m, texts), langid.cross_entropy(m, texts, step=37)
    assert (whole[0] == parts[0]).all() and np.allclose(whole[1], parts[1], rtol=1e-5)


# benchmark -------------------------------------------------------------------------------------------------------------


def words(r, n):
    return [f"w{r.randrange(3000)}" for _ in range(n)]


def edited(r, ws, k):
    ws = list(ws)
    for _ in range(k):
        at, how = r.randrange(len(ws)), r.randrange(3)
        if how == 0:
            ws[at] = f"new{r.random()}".replace(".", "")
        elif how == 1 and len(ws) > 1:
            del ws[at]
        else:
            ws.insert(at, f"more{r.random()}".replace(".", ""))
    return ws


def brute_match(item, text):
    a, b = D.word_ids([" ".join(item)])[0], D.word_ids([" ".join(text)])[0]
    row = [0] * (len(b) + 1)
    for i, w in enumerate(a):
        new = [i + 1]
        for j, v in enumerate(b):
            new.append(min(row[j + 1] + 1, new[-1] + 1, row[j] + (w != v)))
        row = new
    return min(row) <= D.edits(len(a), 0.8)


def test_decontamination_recall_and_precision():
    r = random.Random(12)
    items = [words(r, n) for n in (1, 2, 3, 4, 6, 9, 10, 14, 20, 33, 47, 59) for _ in range(4)]
    ix = D.build(list(range(len(items))), [" ".join(x).upper() + "!" for x in items])
    texts = []
    for n in range(240):
        item = items[n % len(items)]
        body = words(r, 80)
        at = r.randrange(80)
        texts.append(body[:at] + edited(r, item, r.randrange(D.edits(len(item), 0.8) + 1)) + body[at:])
    found = D.match(ix, D.word_ids([" ".join(t) for t in texts]))
    want = {(d, i) for d, t in enumerate(texts) for i, item in enumerate(items) if brute_match(item, t)}
    got = {(d, i) for d, f in enumerate(found) for i, _ in f}
    assert got <= want and len(got) >= 0.99 * len(want)


@pytest.mark.parametrize("kind", ["delete", "insert", "replace", "mixed"])
def test_decontamination_finds_all_at_the_limit(kind):
    """Items of every length with exactly as many edits as the limit allows, of one kind."""
    r = random.Random(21)
    items = [words(r, n) for n in (5, 9, 10, 14, 15, 17, 19, 20, 29, 40, 59, 100, 200, 300) for _ in range(2)]
    ix = D.build(list(range(len(items))), [" ".join(x) for x in items])
    texts = []
    for item in items:
        ws = [[w] for w in item]
        for at in r.sample(range(len(item)), D.edits(len(item), 0.8)):
            how = r.choice(["delete", "insert", "replace"]) if kind == "mixed" else kind
            ws[at] = [] if how == "delete" else [f"new{r.randrange(10**9)}"] + (ws[at] if how == "insert" else [])
        texts.append(words(r, 50) + [w for x in ws for w in x] + words(r, 50))
    for n, found in enumerate(D.match(ix, D.word_ids([" ".join(t) for t in texts]))):
        a, b = D.word_ids([" ".join(items[n]), " ".join(texts[n])])
        assert dict(found).get(n) == D.edit_within(a, b) <= D.edits(len(items[n]), 0.8)


def test_decontamination_filter_keeps_every_placement():
    """The shortest lengths of the filter's bounds, with edits where they spoil most of its word pairs."""
    items = [[f"i{m}w{j}" for j in range(m)] for m in range(5, 34)]
    ix = D.build(list(range(len(items))), [" ".join(x) for x in items])
    r = random.Random(3)
    for n, item in enumerate(items):
        k = D.edits(len(item), 0.8)
        places = [sorted(r.sample(range(1, len(item) - 1), k)) for _ in range(8)] + [[len(item) * (2 * j + 1) // (2 * k) for j in range(k)]]
        docs = [["x"] * 9 + [f"no{j}" if j in at else w for j, w in enumerate(item)] + ["y"] * 9 for at in places]
        assert all([i for i, _ in f] == [n] for f in D.match(ix, D.word_ids([" ".join(d) for d in docs])))


def test_decontamination_filter_alone_is_lossless():
    """Before any walk: the item is admitted wherever it stands with as many edits as the limit allows, of any kind."""
    r = random.Random(31)
    items = [words(r, n) for n in [*range(5, 45), 60, 90, 150]]
    ix = D.build(list(range(len(items))), [" ".join(x) for x in items])
    for n, item in enumerate(items):
        for _ in range(12):
            text = words(r, 20) + edited(r, item, D.edits(len(item), 0.8)) + words(r, 20)
            at, admitted = D.admitted(ix, D.word_ids([" ".join(text)])[0])
            assert n in admitted.tolist()


def test_decontamination_index_is_as_large_as_reckoned():
    """The index of a block of short items and of long ones stays within what the blocks are cut by."""
    import pickle

    r = random.Random(5)
    for n, m in ((8000, 6), (2000, 40), (60, 3000)):
        texts = [" ".join(words(r, m)) for _ in range(n)]
        size = len(pickle.dumps(D.build(list(range(n)), texts)))
        assert size <= n * (D.ITEM_BYTES + m * D.WORD_BYTES) * 1.25 + (2 << 20)


def test_decontamination_table(spark, docs, none, corpus):
    r = random.Random(7)
    long_ = next(t for i, t, *_ in corpus if i == 500).split()
    bench = spark.createDataFrame([(1, " ".join(long_[31000:31040])), (2, None), (3, " "), (4, " ".join(words(r, 30))), (5, "the house which never was in the light of the water and people"), (None, "the house which never was in the light of the water and people"), (5, "the house which never was in the light of the water and people")], "item_id long, text string")
    got = {x.doc_id: x.hits_ for x in D.decontaminate(docs, bench, docs.columns).collect()}
    assert got[500][0].item == 1 and got[500][0].edits == 0 and got[400] == [] and got[501] == []
    assert D.decontaminate(none, bench, none.columns).isEmpty()
    assert D.decontaminate(docs, bench.filter("false"), ["doc_id"]).filter("size(hits) > 0").isEmpty()
    try:
        D.BLOCK_BYTES, before = 3500, D.BLOCK_BYTES
        again = {x.doc_id: x.hits_ for x in D.decontaminate(docs, bench, docs.columns).collect()}
    finally:
        D.BLOCK_BYTES = before
    assert again == got


# toxicity --------------------------------------------------------------------------------------------------------------


def test_toxicity(spark, docs, none):
    r = random.Random(5)
    bad = ["zorkface", "grumblor", "vilething"]
    rows, labels = [], []
    for i in range(1200):
        toxic = i % 6 == 0
        ws = [r.choice(WORDS["en"]) + r.choice(["", "er", "ing"]) for _ in range(40)]
        if toxic:
            ws[3], ws[20] = r.choice(bad), r.choice(bad)
        rows.append((i, " ".join(ws)))
        if i * 7919 % 10 < 5:
            labels.append((i, int(toxic)))
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(None, 1), (3, None), (0, 1)], "doc_id long, toxic int")
    m = toxicity.train(df, lab, common.fold(F.col("doc_id")) != 2)
    got = {x.doc_id: x.score for x in toxicity.score_toxicity(df, m, ["doc_id"]).collect()}
    right = sum((got[i] >= 0.3) == (i % 6 == 0) for i in range(1200))
    assert right >= 0.98 * 1200
    out = toxicity.score_toxicity(docs, m, docs.columns)
    assert out.columns[-1] == "score_" and out.filter("score_ is null or score_ < 0 or score_ > 1").isEmpty() and out.count() == docs.count()
    assert toxicity.score_toxicity(none, m, none.columns).isEmpty()
    unknown = toxicity.train(docs, lab.filter("false"), F.lit(True))
    assert toxicity.score_toxicity(docs, unknown, ["doc_id"]).filter("score >= 0.3").isEmpty()
    assert toxicity.train(none, lab, F.lit(True)).prior > 0


def test_words_of_copied_toxic_texts_are_no_evidence(spark):
    r = random.Random(6)
    copied = [prose(r, "en", 30).split() for _ in range(4)]
    rows = []
    for i in range(2400):
        if i % 30 == 0:  # copies of a few toxic texts with rare words of their own
            ws = [*copied[i // 30 % 4], f"rare{'abcd'[i // 30 % 4]}", *copied[i // 30 % 4][:9]]
            ws[r.randrange(20)] = "other"
        else:
            ws = prose(r, "en", 40).split()
        if toxic := i % 10 == 0:
            ws.insert(r.randrange(len(ws)), "zorkface")
        rows.append((i, " ".join(ws), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    m = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"), F.lit(True))
    assert "zorkface" in m.words and not any(w.startswith("rare") for w in m.words)


def test_a_hot_toxic_text_does_not_remove_its_insults(spark):
    """Near copies of one toxic text are most of the rows with an insult, which other texts confirm."""
    r = random.Random(8)
    hot = [*prose(r, "en", 20).split(), "zorkface", *prose(r, "en", 10).split(), "rareword", *prose(r, "en", 10).split()]
    rows = []
    for i in range(2400):
        ws = prose(r, "en", 40).split()
        if i % 4 == 0:
            ws = list(hot)
            ws[r.randrange(len(ws))] = f"odd{r.randrange(10**6)}"
            ws[20], ws[31] = "zorkface", "rareword"
        elif i % 24 == 1:
            ws.insert(r.randrange(len(ws)), "zorkface")
        rows.append((i, " ".join(ws), int(i % 4 == 0 or i % 24 == 1)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    m = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"), F.lit(True))
    assert "zorkface" in m.words and "rareword" not in m.words
    hits = toxicity.scores(m, [t for _, t, x in rows if x])
    assert min(hits) >= 0.3


def test_copy_groups():
    r = random.Random(4)
    apart = [prose(r, "en", 40) for _ in range(300)]
    near = [apart[0].split() for _ in range(100)]
    for ws in near:
        ws[r.randrange(40)] = f"x{r.random()}"
    got = toxicity.copy_groups([toxicity.signature(toxicity.contexts(t)) for t in [*apart, *map(" ".join, near)]])
    assert len(set(got[:300])) >= 295 and set(got[300:]) == {got[0]}


def test_scores_and_contexts_agree():
    """What is learned from a text is what scoring sees in it."""
    r = random.Random(9)
    for t in [prose(r, "de", 60), "", None, "Worthless! worthless", "\ud800 x", prose(r, "en", 3000)]:
        seen = toxicity.contexts(t)
        m = toxicity.Model({w: i for i, w in enumerate(seen)}, r_ := np.random.default_rng(1).random(len(seen)) / 50, -1.0, 0.1)
        want = -1 + sum(r_[i] * v for i, (_, v) in enumerate(seen.values()))
        assert toxicity.scores(m, [t])[0] == pytest.approx(1 / (1 + math.exp(-want)))


def test_toxicity_of_a_small_table(spark):
    """Four confirmed texts are enough for a model that tells texts apart."""
    r = random.Random(3)
    rows = [(i, " ".join([*prose(r, "en", 30).split(), *(["zorkface", "grumblor"] if i % 15 == 0 else [])]), int(i % 15 == 0)) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    m = toxicity.train(df.select("doc_id", "text"), df.filter("doc_id < 60").select("doc_id", "toxic"), F.lit(True))
    got = toxicity.scores(m, [t for _, t, _ in rows])
    assert all((x >= 0.3) == bool(y) for x, (_, _, y) in zip(got, rows))


def test_nnpu_risk_separates():
    r = np.random.default_rng(0)
    p = [[(0, 1.0)] for _ in range(100)]
    u = [[(0, 1.0)] if r.random() < 0.2 else [] for _ in range(1000)]
    w, b = toxicity.fit(p, u, 1, 0.2)
    assert 1 / (1 + np.exp(-w[0] - b)) > 0.6 and 1 / (1 + np.exp(-b)) < 0.15


# the queries' base columns -----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["base_pii", "base_secrets", "base_quality"])
def test_base_columns_against_sql(spark, name):
    import duckdb

    from spanalytics.llm import registry

    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = db.sql(registry.SQL[name])
    got = registry.QUERIES[name](spark, sf)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
