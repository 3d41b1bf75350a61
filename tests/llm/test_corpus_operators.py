"""Near-duplicates, packing, WARC, tool calls and the pipeline: against brute force and on edge cases."""

import json
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spanalytics.llm import common, components, decontaminate, neardup, packing, pii, registry, toolcalls, warc

from .conftest import prose

SF = "/root/testdata/sf0.001"


def reach(nodes, links):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {n: top(n) for n in nodes}


def brute_neardup(rows, width, percent):
    sets = {i: neardup.shingles(t, width) for i, t in rows}
    links = []
    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                links.append((i, j))
    return {i: len(s) for i, s in sets.items()}, reach(ids, links)


@pytest.mark.parametrize("width", [4, 5])
def test_neardup_corpus(spark, docs, none, corpus, width):
    sizes, comp = brute_neardup({i: t for i, t, *_ in corpus if i is not None}.items(), width, 80)
    got = neardup.near_duplicates(docs, "doc_id", width).collect()
    assert len(got) == len(corpus)
    for x in got:
        if x.doc_id is None:
            assert x.component_id is None and x.kept
        else:
            assert (x.n_shingles, x.component_id, x.kept) == (sizes[x.doc_id], comp[x.doc_id], comp[x.doc_id] == x.doc_id)
    assert neardup.near_duplicates(none).isEmpty()


@pytest.mark.parametrize("small", [2, 32])
def test_neardup_large_group(spark, monkeypatch, small):
    """A group of near copies around the threshold, whose members are not all linked to the smallest."""
    monkeypatch.setattr(neardup, "SMALL", small)
    monkeypatch.setattr(neardup, "BLOCK", 16)
    r = random.Random(3)
    base = [f"w{i}" for i in range(140)]
    rows = []
    for i in range(90):
        ws = list(base)
        for _ in range(r.randrange(8)):
            at = r.randrange(len(ws))
            ws[at] = f"x{r.randrange(12)}at{at}"
        rows.append((i, " ".join(ws)))
    rows += [(200 + i, " ".join(f"v{r.randrange(400)}" for _ in range(40)) + " " + " ".join(base[:20])) for i in range(40)]
    _, comp = brute_neardup(rows, 4, 80)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {x.doc_id: x.component_id for x in neardup.near_duplicates(df, "doc_id", 4).collect()} == comp


def test_neardup_across_the_sketch_size(spark):
    """Sets around the sketch's size inside sets at the threshold, or one shingle beyond it."""
    rows = []
    for n in range(25, 42):
        for i in range(12):
            ws = [f"n{n}d{i}w{j}" for j in range(n * 100 // 80 + 5)]
            more = n * 100 // 80 - (i % 3 == 1) + (i % 3 == 2)
            rows += [(len(rows), " ".join(ws[: n + 3])), (len(rows) + 1, " ".join(ws[: more + 3]))]
    _, comp = brute_neardup(rows, 4, 80)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {x.doc_id: x.component_id for x in neardup.near_duplicates(df, "doc_id", 4).collect()} == comp
    assert all(comp[i] == (i - i % 2 if i // 2 % 12 % 3 < 2 else i) for i in comp)


def boilerplate(r, n):
    """Documents that share a passage of half their words, and pairs of near copies among them."""
    shared = [f"p{j}" for j in range(60)]
    rows = []
    for i in range(n):
        own = [f"v{r.randrange(10**6)}" for _ in range(60)]
        rows.append((2 * i, " ".join(shared + own)))
        own[r.randrange(60)] = "odd"
        if i % 5 == 0:
            rows.append((2 * i + 1, " ".join(shared + own)))
    return rows


def test_neardup_shared_passage(spark, monkeypatch):
    """Long lists that stay open go through the whole sets' rarest values, and no block is compared."""
    monkeypatch.setattr(neardup, "SMALL", 8)
    called, blocks = [], neardup._block_links
    monkeypatch.setattr(neardup, "_block_links", lambda groups, *a: called.append(groups.count()) or blocks(groups, *a))
    rows = boilerplate(random.Random(5), 60)
    _, comp = brute_neardup(rows, 4, 80)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {x.doc_id: x.component_id for x in neardup.near_duplicates(df, "doc_id", 4).collect()} == comp
    assert called == [0]


def test_neardup_one_id_with_two_texts(spark):
    """A document has the links of all its texts; each of its rows is returned."""
    r = random.Random(11)
    a, b, c = (prose(r, "en", 50) for _ in range(3))
    rows = [(1, a), (2, a + " more"), (2, b), (3, b), (4, c), (4, a), (4, ""), (5, c + " end"), (6, prose(r, "de", 40)), (6, prose(r, "de", 40)), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = neardup.near_duplicates(df, "doc_id", 4).collect()
    assert len(got) == len(rows)
    assert {(x.doc_id, x.component_id) for x in got} == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (6, 6), (7, 7)}


def test_neardup_confirms_classes(spark, monkeypatch):
    """With fingerprints that all collide, classes of equal size come apart by their full sets."""
    make = neardup.sketches
    monkeypatch.setattr(neardup, "sketches", lambda *a: make(*a).withColumns({"f1": F.lit(0).cast("long"), "f2": F.lit(0).cast("long")}))
    rows = [(i, " ".join(f"d{i % 4}w{j}" for j in range(20))) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {x.doc_id: x.component_id for x in neardup.near_duplicates(df, "doc_id", 4).collect()} == {i: i % 4 for i in range(12)}


def test_least_shared():
    """Against the worst split of shared shingles for every size of the partner."""
    for percent, n in [(80, n) for n in range(1, 33)] + [(60, 30), (90, 31)]:
        worst = min(c - min(c, max(0, b - 32)) for b in range(1, 200) for c in range(min(n, b) + 1) if 100 * c >= percent * (n + b - c) and c)
        assert neardup.least_shared(n, percent, 32) == max(1, worst)
    assert neardup.least_shared(32, 80, 32) == 24


def test_sketch_of_union():
    r = np.random.default_rng(4)
    all_ = np.unique(r.integers(0, 2**63, 3000, dtype=np.uint64))
    side = r.random(len(all_))
    a, b = all_[side < 5 / 6], all_[side > 1 / 6]
    k = 1024
    est = neardup.union_estimate(a[:k], b[:k], k)
    assert abs(est - ((side < 5 / 6) & (side > 1 / 6)).mean()) < 0.06


def test_components(spark):
    r = random.Random(1)
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(40)] + [(r.randrange(200, 400), r.randrange(200, 400)) for _ in range(120)] + [(5, 5), (None, 3)]
    df = spark.createDataFrame(links, "u long, v long")
    real = [(a, b) for a, b in links if a is not None and a != b]
    want = reach({x for p in real for x in p}, real)
    got = components.components(df).collect()
    assert len(got) == len(want) and {x.node: x.component for x in got} == want
    assert components.components(df.filter("false")).isEmpty()


# packing -----------------------------------------------------------------------------------------------------------------


def test_packing_round_trip(spark, docs, none, corpus):
    files = registry.tokenizer_files()
    tok = packing.Tokenizer(*files)
    huge = prose(random.Random(2), "en", 200_000)  # more tokens than the buffer
    extra = docs.select("doc_id", "text").union(spark.createDataFrame([(900, "a <|endoftext|> b"), (901, "<|endoftext|>" * 3), (902, huge)], "doc_id long, text string"))
    rows = packing.pack(extra, *files).collect()
    texts = {i: t for i, t, *_ in corpus if i is not None} | {900: "a <|endoftext|> b", 901: "<|endoftext|>" * 3, 902: huge}
    pieces, seqs = defaultdict(list), defaultdict(list)
    for x in rows:
        pieces[x.doc_id].append(x)
        seqs[x.sequence_id].append(x)
    for i, t in texts.items():
        ids = np.append(np.array(tok.slow.encode(t or "", add_special_tokens=False).ids, np.uint32), np.uint32(1))
        mine = sorted(pieces[i], key=lambda x: (x.start, x.sequence_id))
        assert sum(x.length for x in mine) == len(ids) * (2 if i == 0 else 1)  # id 0 is there twice
        for x in mine:
            assert x.doc_tokens == len(ids) and x.ids_crc32 == zlib.crc32(ids[x.start : x.start + x.length].astype("<u4").tobytes())
    used = padded = 0
    for s in seqs.values():
        s.sort(key=lambda x: x.offset)
        n = sum(x.length for x in s)
        assert [x.offset for x in s] == list(np.cumsum([0] + [x.length for x in s[:-1]])) and 0 < n <= 2048
        used, padded = used + n, padded + packing.padding(n, 2048)
    assert padded <= 0.02 * used
    assert packing.pack(none, *files).isEmpty()


@pytest.mark.parametrize("seed", range(4))
def test_cuts_are_optimal(seed):
    r = np.random.default_rng(seed)
    total, size = 300, 64
    docs_, sent = np.unique(r.integers(1, total, 6)), np.unique(r.integers(1, total, 25))
    got = packing.cuts(total, docs_, sent, size, True)
    pen = {p: packing.SENTENCE for p in sent.tolist()} | dict.fromkeys(docs_.tolist(), 0) | {total: 0}
    edges = sorted({0, total, *pen})
    for a, b in zip(edges, edges[1:]):
        for p in range(a + packing.GRID, b, packing.GRID):
            pen[p] = packing.PLAIN
    best = {0: 0}
    for p in sorted(pen):
        best[p] = min(best[q] + size - (p - q) + pen[p] for q in best if 0 < p - q <= size)
    cost = sum(size - (b - a) + pen[b] for a, b in zip(got, got[1:]))
    assert got[0] == 0 and got[-1] == total and cost == best[total]


def test_tail():
    for n in range(2048):
        k = packing.tail(n, 2048)
        assert sum(k) == n and all(packing.padding(x, 2048) <= 256 for x in k)


# archives ----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("split", [1, 7, 100, 1000, 1 << 20])
def test_members_in_any_split(split):
    r = random.Random(split)
    data = [warc.build(i if i % 5 else None, "http://a/\r\nX: é" if i % 2 else None, r.randbytes(r.randrange(3000)), None if i % 3 else 4) for i in range(40)]
    blob = b"".join(data)
    got = [x for s in range(0, len(blob), split) for x in warc.members(lambda o, k: blob[o : o + k], len(blob), s, min(len(blob), s + split))]
    assert [o for o, _ in got] == list(np.cumsum([0] + [len(d) for d in data[:-1]]))
    first = warc.parse(got[1][1])
    assert first["page_id"] == 1 and first["url"] == "http://a/%0D%0AX:%20%C3%A9" and first["record_type"] == "response"


def test_members_behind_false_magic():
    blob = warc.MAGIC * 3 + warc.build(1, None, b"a", None) + b"junk" + warc.MAGIC + b"\0" * 20 + zlib.compress(b"x") + warc.build(2, None, b"b", None)
    assert [warc.parse(d)["page_id"] for _, d in warc.members(lambda o, k: blob[o : o + k], len(blob), 0, len(blob))] == [1, 2]
    broken = bytearray(warc.build(1, None, b"a" * 50, None))
    with pytest.raises(ValueError, match="digest"):
        warc.parse(zlib.decompress(bytes(broken), 31).replace(b"aaa", b"bbb"))


def test_damaged_archives_are_not_passed_over():
    blob = warc.build(1, None, random.Random(1).randbytes(5000), None)
    every = lambda b: list(warc.members(lambda o, k: b[o : o + k], len(b), 0, len(b)))
    assert len(every(blob)) == 1
    with pytest.raises(ValueError, match="cut short"):
        every(blob[:-100])
    with pytest.raises(ValueError, match="damaged|cut short"):
        every(blob[:2000] + bytes(200) + blob[2200:])


def test_records_that_are_lost_are_told(spark):
    manifest = spark.createDataFrame([("a", 9, 2), ("b", 9, 1), ("c", 9, 1)], "file string, bytes long, records long")
    records = spark.createDataFrame([("a",), ("a",), ("b",), ("b",)], "file string")
    assert {tuple(x) for x in warc.incomplete(manifest, records).collect()} == {("b", 1, 2), ("c", 1, 0)}


def test_round_trip(spark):
    import hashlib

    big, other = "é" * 600, "x" * 5000
    rows = [(1, "u", big), (2, "u", big), (3, None, other), (9, "u", big), (9, "u", big), (None, "u", big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "u", ""), (8, "u", "y" * 3_000_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"digest": F.lit(1), "top": F.lit(2), "refers_to": F.lit(3)}).repartition(3)
    got = sorted(map(tuple, warc.round_trip(df, split=500).collect()), key=str)
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        copy = html == big and i != 9
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if copy else "response", 9 if copy else None))
    assert got == sorted(want, key=str)
    assert warc.round_trip(df.filter("false")).isEmpty()


# tool calls ----------------------------------------------------------------------------------------------------------------

SCHEMA = {"type": "object", "required": ["q"], "additionalProperties": False, "properties": {"q": {"type": "string", "minLength": 1}, "n": {"type": "integer", "minimum": 0}, "xs": {"type": "array", "items": {"type": "number"}}}}


@pytest.mark.parametrize("value, n", [({"q": "a"}, 0), ({"q": ""}, 1), ({}, 1), ({"q": 1, "z": 2}, 2), ([], 1), ({"q": "a", "n": True}, 1), ({"q": "a", "n": -1}, 1), ({"q": "a", "xs": [1, "b", 2.5]}, 1)])
def test_schema(value, n):
    assert len(toolcalls.problems(value, SCHEMA)) == n


def test_canonical():
    assert toolcalls.canonical({"b": 1.0, "a": ["é", {"y": None, "x": 2.5}]}) == '{"a":["é",{"x":2.5,"y":null}],"b":1}'


def test_link(spark):
    calls = spark.createDataFrame([
        (1, "a", 0, "find", '{"q": "x"}', []), (1, "b", 2, "find", '{"q": ""}', ["a", "gone"]), (1, "c", 4, "find", "nope", ["b", "a"]), (1, "x", 5, "find", "{}", ["y"]), (1, "y", 5, "other", "{}", ["x"]), (2, "a", 0, "find", None, None), (None, "a", 0, "find", '{"q":"x"}', []),
    ], "conv long, call_id string, turn long, name string, arguments string, needs array<string>")
    results = spark.createDataFrame([(1, "a", 1, "fine"), (1, "b", 3, None), (1, "lost", 7, "?"), (2, "a", 1, "one"), (2, "a", 2, "two"), (None, "a", 1, "no")], "conv long, call_id string, turn long, content string")
    got = toolcalls.link(calls, results, {"find": SCHEMA}).collect()
    by = defaultdict(list)
    for x in got:
        by[x.conv, x.call_id].append(x)
    assert [(by[1, i][0].status, by[1, i][0].level, by[1, i][0].valid) for i in "abc"] == [("linked", 0, True), ("linked", 1, False), ("unanswered", 2, False)]
    assert by[1, "x"][0].level is None and by[1, "y"][0].problems == ["$: unknown tool"] and by[1, "lost"][0].status == "orphan"
    assert len(by[2, "a"]) == 2 and sorted(x.status for x in by[None, "a"]) == ["orphan", "unanswered"]
    assert json.loads(by[1, "a"][0].json) == {"call": {"id": "a", "name": "find", "arguments": {"q": "x"}}, "result": {"id": "a", "content": "fine"}, "status": "linked"}
    assert toolcalls.link(calls.filter("false"), results.filter("false"), {}).isEmpty()


def test_arguments_that_are_hard_to_write(spark):
    odd = {"deep": "[" * 50_000 + "]" * 50_000, "open": "[" * 100_000, "nan": '{"q":NaN}', "huge": '{"q":1e999}', "half": '{"q":"\\ud800","\\udfff":1}', "null": "null", "empty": "", "wide": '{"q":"' + "[{" * 5000 + '"}'}
    calls = spark.createDataFrame([(1, k, 0, "find", v, []) for k, v in odd.items()], "conv long, call_id string, turn long, name string, arguments string, needs array<string>")
    results = calls.select("conv", "call_id", F.lit(1).cast("long").alias("turn"), F.lit("x").alias("content"))
    got = {x.call_id: x for x in toolcalls.link(calls, results, {"find": SCHEMA}).collect()}
    for k in ("deep", "open", "nan", "huge", "empty"):
        assert got[k].problems == ["$: not JSON"] and json.loads(got[k].json)["call"]["arguments"] == odd[k]
    assert json.loads(got["half"].json)["call"]["arguments"] == {"q": "\ud800", "\udfff": 1} and len(got["half"].problems) == 1
    assert json.loads(got["null"].json)["call"]["arguments"] is None and got["wide"].valid


def test_conversation_calls(spark):
    rows = spark.createDataFrame([(1, 0, "system", "s", 1), (1, 1, "user", "hi", 1), (1, 2, "assistant", "ho", 1), (1, 3, "user", None, 1), (None, 0, "user", "x", 1), (2, None, "user", "x", 1), (3, 0, None, "odd", 1), (1, 1, "user", "hi", 1)], "conv_id long, turn long, role string, text string, first long")
    got = toolcalls.link(*toolcalls.conversation_calls(rows), {"reply": toolcalls.REPLY}).collect()
    assert sorted((x.call_id, x.status, x.valid) for x in got) == [("1:1", "linked", True), ("1:1", "linked", True), ("1:3", "unanswered", False), ("3:-1", "orphan", False)]


# pipeline ------------------------------------------------------------------------------------------------------------------


def test_stages_on_edge_cases(spark, docs, none, tmp_path):
    spark.createDataFrame([(1, " ".join(["zebra quince"] * 10)), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for rows in (docs, none):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, rows, str(tmp_path))
            assert out.columns == docs.columns and out.count() <= rows.count()
            assert out.schema.simpleString() == docs.schema.simpleString()
        assert corpus_pipeline.pack(spark, rows, str(tmp_path)).filter("length <= 0").isEmpty()


def test_near_duplicate_stage_with_repeated_ids(spark):
    """The smallest id of a group stays, once; of its texts the shortest."""
    r = random.Random(12)
    a, b, c = (prose(r, "en", 40) for _ in range(3))
    rows = [(1, a + " longer", "en"), (1, a, "en"), (1, a, None), (2, a, "en"), (3, b, "en"), (3, b, "en"), (4, None, "de"), (4, "", "de"), (None, a, "en"), (None, a, "en"), (5, c, "en"), (6, c + " end", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = sorted(map(tuple, corpus_pipeline.near_duplicates(spark, df, "").collect()), key=str)
    assert got == sorted([(1, a, None), (3, b, "en"), (4, "", "de"), (5, c, "en"), (None, a, "en"), (None, a, "en")], key=str)


def test_pipeline_against_brute_force(spark, tmp_path):
    r = random.Random(21)
    rows = [(i, prose(r, ("en", "de")[i % 2], 60), ("en", "de")[i % 2], "s") for i in range(200)]
    item = " ".join(f"bench{i}" for i in range(20))
    rows += [(300, rows[0][1], "en", "s"), (301, rows[1][1] + " more", "de", "s"), (302, prose(r, "en", 30) + " " + item, "en", "s"), (303, None, "en", "s"), (304, "12 !!", "de", "s"), (305, prose(r, "en", 40) + " joe@mail.example.com ok", "en", "s")]
    spark.createDataFrame([(i, t, a, b, len(t or "")) for i, t, a, b in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    _, comp = brute_neardup([(i, t) for i, t, *_ in rows], 5, 80)
    want = {i for i, t, *_ in rows if t and i != 304 and comp[i] == i and item not in t}
    assert {x.doc_id for x in got} == want and {300, 301, 302, 303, 304} & want == set()
    tok = packing.Tokenizer(*registry.tokenizer_files())
    texts = {i: pii.redacted(t, pii.detect(pii.train(), [t])[1][0]) for i, t, *_ in rows if i in want}
    assert "[EMAIL]" in texts[305]
    assert {x.doc_id: x.doc_tokens for x in got} == {i: len(tok(t)) + 1 for i, t in texts.items()}


def test_levels_are_never_cut_short(spark):
    calls = spark.createDataFrame([(1, f"c{i}", [f"c{i - 1}"] if i else []) for i in range(4)], "conv long, call_id string, needs array<string>")
    assert {x.call_id: x.level for x in toolcalls.levels(calls).collect()} == {f"c{i}": i for i in range(4)}
    with pytest.raises(RuntimeError, match="settle"):
        toolcalls.levels(calls, most_rounds=2)
