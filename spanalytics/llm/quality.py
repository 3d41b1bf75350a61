"""Quality rules with risk-controlled thresholds, DataFrame and SQL functions only.

Six shares between 0 and 1 describe a text (symbols, repeated lines, repeated 5-word windows, upper-case letters, marks,
repeated words); a high share speaks against it. Only texts that pass the base rules count below.

1. Purity: documents labelled bad and documents without a label say, for each stratum (a band of the number of words), share
   and grid point, which part of the texts with a share as high is bad: (prior of bad) * P(share >= x | bad) / P(share >= x).
   A text's score is the largest purity of its shares. Documents labelled good have no part in it but for the prior.
2. Risk control: the documents labelled good are the holdout. In each stratum the cutoffs of the score are tested from the
   strictest one downwards, to one half, by the exact binomial tail P(Bin(n, allowed) <= k) of the k rejections among n
   holdout rows, at the level delta / strata (Bonferroni over the strata). The sequence is fixed before the holdout is seen
   and stops at the first cutoff that can't be proven, so it needs no further correction, and with probability 1 - delta no
   stratum loses more than ``allowed`` of its good documents. A stratum of fewer than ln(strata / delta) / -ln(1 - allowed)
   holdout rows (86 by default) can prove nothing and rejects nothing beyond the base rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from . import common

GRID = 64
SHARES = ("symbols", "lines", "windows", "upper", "marks", "words")
BANDS = (50, 200, 800)
#: Terms of the binomial tail that are summed; what is left is bounded from above, which only makes a test stricter.
TERMS = 4000


def let(value: Column, f) -> Column:
    """f(value), with value computed once: a lambda variable is bound, where a column would be copied into the lambda."""
    return F.transform(F.array(value), f)[0]


def repeat_words(ws: Column) -> Column:
    """Words that lie in a 5-word window found twice or more. Windows are compared by 64-bit hashes; only a text with
    equal hashes has its positions sorted."""
    windows = F.sequence(F.lit(0), F.size(ws) - 5)
    key = lambda i: F.xxhash64(*(F.get(ws, i + j) for j in range(5)))

    def covered(hs):
        pairs = F.array_sort(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))

        def positions(s):
            same = lambda x, j: F.get(s, j)["h"].eqNullSafe(x["h"])
            return F.array_sort(F.transform(F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["p"]))

        step = lambda acc, p: F.struct((p + 5).alias("end"), (acc["n"] + p + 5 - F.greatest(acc["end"], p)).alias("n"))
        union = lambda ps: F.aggregate(ps, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), step, lambda acc: acc["n"])
        return F.when(F.size(F.array_distinct(hs)) < F.size(hs), union(let(pairs, positions))).otherwise(0)

    return F.when(F.size(ws) < 6, 0).otherwise(let(F.transform(windows, key), covered))


def measures(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the shares."""
    text = F.coalesce("text", F.lit(""))
    words = F.regexp_extract_all(text, F.lit(common.WORD), F.lit(0))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(common.WORD))
    by_words = let(words, lambda ws: F.struct(
        F.size(ws).cast("long").alias("n_words"), F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
        repeat_words(ws).cast("long").alias("n_repeat_words"), F.size(F.array_distinct(ws)).alias("kinds")))
    by_lines = let(lines, lambda ls: F.struct(F.size(ls).alias("n"), (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("dup")))
    count = lambda p: F.regexp_count(text, F.lit(p)).cast("long")
    df = docs.select(*keep, by_words.alias("w"), by_lines.alias("l"), count("[#*$%&|<>]").alias("n_symbols"), count(r"\p{Lu}").alias("upper"), count(r"\p{L}").alias("letters"), count(r"[^\p{L}\p{N}\s]").alias("marks"))
    share = lambda a, b: F.coalesce(F.least(F.lit(1.0), a / F.nullif(b.cast("double"), F.lit(0.0))), F.lit(0.0))
    c = F.col
    return df.select(
        *keep, c("w.n_words"), c("w.word_chars"), "n_symbols", c("l.dup").alias("n_dup_lines"), c("w.n_repeat_words"),
        share(c("n_symbols"), c("w.word_chars")).alias("symbols"), share(c("l.dup"), c("l.n")).alias("lines"), share(c("w.n_repeat_words"), c("w.n_words")).alias("windows"),
        share(c("upper"), c("letters")).alias("upper"), share(c("marks"), c("w.word_chars")).alias("marks"), share(c("w.n_words") - c("w.kinds"), c("w.n_words")).alias("words"),
    )


def stratum() -> Column:
    out = F.lit(0)
    for i, least in enumerate(BANDS):
        out = F.when(F.col("n_words") >= least, i + 1).otherwise(out)
    return out


def _ln_factorial(x: Column) -> Column:
    """ln(x!) by Stirling's series at x + 9; exact to about 1e-12."""
    y = x + 9
    series = (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return series - sum((F.log(x + j) for j in range(2, 9)), F.log(x + 1))


def binomial_tail(n: Column, k: Column, a: float) -> Column:
    """P(Bin(n, a) <= k) for k < n * a, else 1: the largest TERMS terms, and a geometric bound on the rest."""
    n, k = n.cast("double"), k.cast("double")
    top = _ln_factorial(n) - _ln_factorial(k) - _ln_factorial(n - k) + k * F.log(F.lit(a)) + (n - k) * F.log(F.lit(1 - a))
    ratio = lambda j: (k - j) * (1 - a) / ((n - k + j + 1) * a)
    js = F.sequence(F.lit(0), F.least(k, F.lit(float(TERMS))).cast("int"))
    step = lambda acc, j: F.struct((acc["term"] * ratio(j)).alias("term"), (acc["sum"] + acc["term"] * ratio(j)).alias("sum"))
    first = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    total = F.aggregate(js, first, step, lambda acc: acc["sum"] + acc["term"] * F.when(k > TERMS, 1 / F.greatest(F.lit(1e-9), 1 - ratio(F.lit(TERMS)))).otherwise(0.0))
    return F.when(k >= n * a, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.exp(top) * total))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def bins() -> Column:
    """Grid points of the shares, as an array in the order of SHARES: floor(GRID * share)."""
    return F.array(*(F.floor(F.col(s) * GRID).cast("int") for s in SHARES))


def purity(rows: DataFrame) -> DataFrame:
    """One row, ``purity``: an array by ((stratum * shares) + share) * (GRID + 1) + bin.

    rows: (quality 1, 0 or null, stratum, bins). Counts of the bad are taken over all strata, those of the texts without
    a label in each; both are smoothed by one, against rejection.
    """
    size = (len(BANDS) + 1) * len(SHARES) * (GRID + 1)
    long = rows.select("quality", "stratum", F.posexplode("bins").alias("share", "bin"))
    n = long.groupBy("stratum", "share", "bin").agg(F.count_if(F.col("quality").isNull()).alias("free"), F.count_if(F.col("quality") == 0).alias("bad"), F.count_if(F.col("quality") == 1).alias("good"))
    index = F.expr(f"explode(sequence(0, {size - 1}))").alias("i")
    grid = rows.sparkSession.range(1).select(index).select("i", F.floor(F.col("i") / (len(SHARES) * (GRID + 1))).cast("int").alias("stratum"), (F.floor(F.col("i") / (GRID + 1)) % len(SHARES)).cast("int").alias("share"), (F.col("i") % (GRID + 1)).alias("bin"))
    n = grid.join(F.broadcast(n), ["stratum", "share", "bin"], "left").fillna(0, ["free", "bad", "good"])
    one, every = W.partitionBy("stratum", "share"), W.partitionBy("share")
    up = lambda c, w: F.sum(c).over(w.orderBy(F.desc("bin")).rangeBetween(W.unboundedPreceding, W.currentRow))
    all_bad, all_good = F.sum("bad").over(every), F.sum("good").over(every)
    tail_bad, tail_free = up("bad", every) / (all_bad + 1), (up("free", one) + 1) / (F.sum("free").over(one) + 1)
    prior = all_bad / F.greatest(F.lit(1), all_bad + all_good)
    n = n.select("i", F.least(F.lit(1.0), prior * tail_bad / tail_free).alias("p"))
    return n.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "p"))), lambda x: x["p"]).alias("purity"))


def share_purities() -> Column:
    """Purity of each share of a row with the columns stratum, bins and purity."""
    return F.transform("bins", lambda b, i: F.get("purity", (F.col("stratum") * len(SHARES) + i) * (GRID + 1) + b))


def cutoffs(good: DataFrame, allowed: float, delta: float) -> DataFrame:
    """(stratum, cut): reject where floor(GRID * score) >= cut. good: (stratum, level) of the holdout rows."""
    strata = len(BANDS) + 1
    n = good.groupBy("stratum", F.greatest("level", F.lit(GRID // 2 - 1)).alias("level")).agg(F.count("*").alias("n"))
    grid = n.select("stratum").distinct().withColumn("level", F.explode(F.sequence(F.lit(GRID // 2 - 1), F.lit(GRID))))
    n = grid.join(n, ["stratum", "level"], "left").fillna(0, ["n"])
    whole = W.partitionBy("stratum")
    n = n.select("stratum", "level", F.sum("n").over(whole).alias("n"), F.sum("n").over(whole.orderBy(F.desc("level"))).alias("k"))
    proven = binomial_tail(F.col("n"), F.col("k"), allowed) <= delta / strata
    # the level below the grid's last always fails: the sequence ends there
    stop = F.max(F.when(~proven | (F.col("level") < GRID // 2), F.col("level")))
    return n.groupBy("stratum").agg((stop + 1).alias("cut")).filter(F.col("cut") <= GRID)


def judge(docs: DataFrame, labels: DataFrame, allowed: float = 0.05, delta: float = 0.05) -> DataFrame:
    """Every row of ``docs`` (doc_id, text): measures, base_failed, score, failed_shares (names) and kept.

    labels: (doc_id, quality), 1 for good and 0 for bad; other values and nulls are no labels, and an id with both counts as
    good. A null, empty or wordless text has no words and fails the base rules. Repeated rows are judged (and count) each; an
    empty table gives none. Without labels nothing is rejected beyond the base rules.
    """
    rows = common.materialize(measures(docs, ["doc_id"]).withColumns({"base_failed": base_failed(), "stratum": stratum(), "bins": bins()}), "quality")
    known = labels.filter("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    told = rows.filter(~F.col("base_failed")).select("doc_id", "stratum", "bins").join(known, "doc_id", "left")
    table = common.materialize(purity(told), "purity")
    scored = lambda df: df.join(F.broadcast(table)).withColumn("purities", share_purities())  # one row
    level = lambda p: F.floor(p * GRID).cast("int")
    holdout = scored(rows.filter(~F.col("base_failed")).join(known.filter("quality = 1"), "doc_id", "left_semi")).select("stratum", level(F.array_max("purities")).alias("level"))
    cut = F.lit(GRID + 1)
    for r in cutoffs(holdout, allowed, delta).collect():  # at most a row a stratum
        cut = F.when(F.col("stratum") == r["stratum"], F.lit(r["cut"])).otherwise(cut)
    out = scored(rows).withColumn("cut", cut)
    names = F.filter(F.transform("purities", lambda p, i: F.when(level(p) >= F.col("cut"), F.get(F.array(*map(F.lit, SHARES)), i))), lambda x: x.isNotNull())
    out = out.withColumns({"score": F.array_max("purities"), "failed_shares": F.when(F.col("base_failed"), F.array().cast("array<string>")).otherwise(names)})
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_shares") == 0)).drop("purity", "purities", "cut", "bins", "stratum")
