"""Secret scan with DataFrame and SQL functions only: patterns plus a battery of randomness tests.

Base spans are matches of three patterns. Beside them, every run of 20 or more key characters that overlaps no base span
is a token. Its encoding is inferred (hex, base32, upper case and digits, letters, alphanumeric, base64), and three
tests are taken over that alphabet: chi-squared uniformity, Wald-Wolfowitz runs about the middle, and lag-1 serial
correlation. Fisher's statistic S of the three is small for random strings. Tokens made of words are the reference for
ordinary text; the share of them, in a length band, with an S as small is a token's p-value for "ordinary". The
Benjamini-Hochberg rule within the band, over histograms of S, gives the band's cutoff, so long and short tokens
are held to the same false-discovery rate. Thresholds are one row a band, from distinct tokens. A band
with fewer ordinary tokens than 1 / rate - 1 (99 by default) can't show so small a rate, and takes none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from . import common

#: The kinds and their patterns.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"(AKIA[A-Z0-9]{16,})"
HEX = r"(?<![0-9a-f])([0-9a-f]{24,})"
TOKEN = r"(?<![A-Za-z0-9+/_=-])([A-Za-z0-9+/_=-]{20,})"
#: Tokens that are words, or words and short numbers joined by signs: the reference for ordinary text. The loop is possessive:
#: a word ends where a sign comes, so nothing is lost, and Java matches it without recursion however long the token is.
ORDINARY = "^[A-Z]?[a-z]+(?:[-_/=+]+(?:[A-Z]?[a-z]+|[0-9]{1,4}))*+[-_/=+]*$"
#: First lengths of the bands, and the highest bin of S.
BANDS, TOP = (20, 32, 48, 80), 240


def _quoted(s: str) -> str:
    return "r'" + s.replace("'", "\\x27") + "'"


#: Matches whose places are found in one run; a longer list goes by blocks, as appending to one list is quadratic in it.
BLOCK = 256


def matches(text: str, pattern: str, group: int = 1) -> str:
    """SQL for the array of (s, e, v) of a pattern's matches: start, end and group, counted in code points.

    Matches and the gaps between them come from one pass each; the second is taken only where there is a match. Places are
    running sums of gaps and matches: first over blocks of matches, then within each block.
    """
    p = _quoted(pattern)
    kind = "array<struct<s:int,e:int,v:string>>"
    state = f"struct<at:int,found:{kind}>"
    within = f"""aggregate(b, cast(struct(s as at, array() as found) as {state}),
        (acc, x) -> cast(struct(acc.at + x.g + x.n as at, concat(acc.found, array(struct(acc.at + x.g as s, acc.at + x.g + x.n as e, x.v as v))) as found) as {state}), acc -> acc.found)"""
    starts = """aggregate(bs, cast(struct(0 as at, array() as found) as struct<at:int,found:array<int>>),
        (acc, b) -> cast(struct(aggregate(b, acc.at, (t, x) -> t + x.g + x.n) as at, concat(acc.found, array(acc.at)) as found) as struct<at:int,found:array<int>>), acc -> acc.found)"""
    return f"""transform(array(regexp_extract_all({text}, {p}, 0)), m -> if(size(m) = 0, cast(array() as {kind}),
        transform(transform(array(zip_with(zip_with(m, regexp_extract_all({text}, {p}, {group}), (a, v) -> struct(a, v)), slice(split({text}, {p}, -1), 1, size(m)), (x, g) -> struct(length(g) as g, length(x.a) as n, x.v as v))),
            z -> transform(sequence(0, (size(z) - 1) div {BLOCK}), i -> slice(z, cast(i * {BLOCK} + 1 as int), {BLOCK}))),
            bs -> flatten(zip_with(bs, {starts}, (b, s) -> {within})))[0]))[0]"""


def _normal(z: str) -> str:
    """Standard normal distribution function, to 2e-4."""
    return f"(1 / (1 + exp(-greatest(-30D, least(30D, 1.5976D * ({z}) + 0.07056D * pow({z}, 3))))))"


def statistic(token: str) -> str:
    """SQL for Fisher's S of the three tests of a token."""
    encoding = f"""case when {token} rlike '^([0-9a-f]+|[0-9A-F]+)$' then struct(lower({token}) as t, '0123456789abcdef' as a)
        when {token} rlike '^[a-z]+$' then struct({token} as t, 'abcdefghijklmnopqrstuvwxyz' as a)
        when {token} rlike '^[A-Z2-7]+$' then struct({token} as t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567' as a)
        when {token} rlike '^[A-Z0-9]+$' then struct({token} as t, '0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ' as a)
        when {token} rlike '^[A-Za-z0-9]+$' then struct({token} as t, '0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz' as a)
        else struct(rtrim('=', translate({token}, '-_', '+/')) as t, '0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/' as a) end"""
    tail = lambda z: f"greatest(1e-12D, 2 * (1 - {_normal(f'abs({z})')}))"
    return f"""transform(transform(transform(array({encoding}), x -> struct(
          cast(length(x.t) as double) as n, cast(length(x.a) as double) as k,
          aggregate(sequence(1, length(x.a)), 0D, (s, j) -> s + pow(length(x.t) - length(replace(x.t, substr(x.a, j, 1), '')), 2)) as squares,
          transform(split(x.t, ''), c -> cast(instr(x.a, c) - 1 as double)) as q)), x -> struct(x.n as n, x.k as k, x.q as q,
          x.k / greatest(x.n, 1) * x.squares - x.n as chi,
          cast(size(filter(x.q, v -> v >= x.k / 2)) as double) as high,
          1 + size(filter(x.q, (v, i) -> i > 0 and (v >= x.k / 2) != (x.q[greatest(i - 1, 0)] >= x.k / 2))) as runs,
          aggregate(x.q, 0D, (s, v) -> s + v) / greatest(x.n, 1) as mean)), x -> struct(
          (pow(greatest(x.chi, 0) / (x.k - 1), 1D / 3) - (1 - 2 / (9 * (x.k - 1)))) / sqrt(2 / (9 * (x.k - 1))) as z1,
          coalesce((x.runs - (2 * x.high * (x.n - x.high) / x.n + 1)) / nullif(sqrt(greatest(0D, 2 * x.high * (x.n - x.high) * (2 * x.high * (x.n - x.high) - x.n) / (x.n * x.n * (x.n - 1)))), 0), 0D) as z2,
          coalesce(sqrt(x.n) * aggregate(slice(x.q, 2, cast(x.n as int)), struct(0D as s, x.q[0] as last), (t, v) -> struct(t.s + (t.last - x.mean) * (v - x.mean) as s, v as last), t -> t.s)
            / nullif(aggregate(x.q, 0D, (s, v) -> s + pow(v - x.mean, 2)), 0), 0D) as z3))[0]""", tail


def score(token: str) -> str:
    zs, tail = statistic(token)
    return f"transform(array({zs}), z -> -2 * (ln(greatest(1e-12D, 1 - {_normal('z.z1')})) + ln({tail('z.z2')}) + ln({tail('z.z3')})))[0]"


def band(length: Column) -> Column:
    out = F.lit(0)
    for i, least in enumerate(BANDS):
        out = F.when(length >= least, F.lit(i)).otherwise(out)
    return out


def cutoffs(tokens: DataFrame, rate: float) -> DataFrame:
    """(band, cutoff): the largest bin of S taken for random; bands without one are left out. tokens: (tok, bin).

    A token counts once, however many texts hold it: copies are no evidence that ordinary tokens look random."""
    ordinary = F.col("tok").rlike(ORDINARY)
    n = tokens.distinct().groupBy(band(F.length("tok")).alias("band"), "bin").agg(F.count_if(ordinary).alias("ref"), F.count_if(~ordinary).alias("cand"))
    up_to = W.partitionBy("band").orderBy("bin")
    whole = W.partitionBy("band")
    n = n.select("band", "bin", F.sum("ref").over(up_to).alias("ref_le"), F.sum("cand").over(up_to).alias("cand_le"), F.sum("ref").over(whole).alias("refs"), F.sum("cand").over(whole).alias("cands"))
    p = (1 + F.col("ref_le")) / (1 + F.col("refs"))
    return n.filter((F.col("cand_le") > 0) & (p * F.col("cands") <= rate * F.col("cand_le"))).groupBy("band").agg(F.max("bin").alias("cutoff"))


def find_secrets(docs: DataFrame, keep: list[str], rate: float = 0.01) -> DataFrame:
    """``keep`` columns with base and spans: arrays of (start, kind, end), by start and then by kind.

    Offsets are code points, ends exclusive. A null text counts as empty: no spans. Repeated rows give repeated results,
    and an empty table an empty one. Result names that clash with kept columns get underscores.
    """
    t = "coalesce(text, '')"
    three = [f"transform(filter({matches(t, p, g)}, x -> length(x.v) >= {least}), x -> struct(x.s as start, {k} as kind, x.e as end))" for k, (p, g, least) in enumerate(((ASSIGN, 2, 6), (ACCESS, 1, 20), (HEX, 1, 24)))]
    kept = F.struct(*map(common.quoted, keep)).alias("kept")
    found = docs.select(kept, F.expr(f"array_sort(concat({', '.join(three)}))").alias("base"), F.expr(matches(t, TOKEN)).alias("tokens"))
    own = "filter(tokens, x -> not exists(base, b -> b.start < x.e and x.s < b.end))"
    scored = found.select("kept", "base", F.expr(f"transform({own}, x -> struct(x.s as s, x.e as e, x.v as tok, cast(least({TOP}, floor({score('x.v')})) as int) as bin))").alias("tokens"))
    scored = common.materialize(scored, "secrets")
    limits = {r["band"]: r["cutoff"] for r in cutoffs(scored.select(F.explode("tokens").alias("x")).select("x.tok", "x.bin"), rate).collect()}  # at most a row a band

    def taken(x):
        at = F.lit(-1)
        for b, c in limits.items():
            at = F.when(band(F.length(x["tok"])) == b, F.lit(c)).otherwise(at)
        return (x["bin"] <= at) & ~x["tok"].rlike(ORDINARY)

    more = F.transform(F.filter("tokens", taken), lambda x: F.struct(x["s"].alias("start"), F.lit(3).alias("kind"), x["e"].alias("end")))
    spans = F.array_sort(F.concat("base", more)) if limits else F.col("base")
    names = common.free(keep, ["base", "spans"])
    return scored.select(*(F.col("kept")[c].alias(c) for c in keep), F.col("base").alias(names[0]), spans.alias(names[1]))

