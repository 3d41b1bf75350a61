"""The queries of the training-data operators, and DuckDB SQL for those that it can express on whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import common, decontaminate, langid, neardup, packing, pii, quality, secrets, toolcalls, toxicity, warc


def _spans(spans: str, kinds: tuple) -> Column:
    names = ", ".join(f"'{k}'" for k in kinds)
    return F.expr(f"array_join(transform({spans}, x -> concat_ws(':', element_at(array({names}), x.kind + 1), x.start, x.end)), ',')")


def _count(spans: str, kind: int) -> Column:
    return F.expr(f"cast(size(filter({spans}, x -> x.kind = {kind})) as long)")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(common.read(spark, sf_dir, "documents"), ["doc_id"])
    counts = [_count("base", k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(_spans("base", pii.KINDS), 256).alias("base_sha256"), _spans("spans", pii.KINDS).alias("spans"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(common.read(spark, sf_dir, "documents"), ["doc_id"])
    counts = [_count("base", k).alias(f"n_{name}") for k, name in enumerate(secrets.KINDS[:3])]
    return found.select("doc_id", *counts, F.sha2(_spans("base", secrets.KINDS), 256).alias("base_sha256"), _spans("spans", secrets.KINDS).alias("spans"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    model = langid.train(docs, common.fold(F.col("doc_id")) != 2)
    got = langid.identify(docs.select("doc_id", "text"), model, ["doc_id"])
    return got.select("doc_id", (common.fold(F.col("doc_id")) == 2).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(common.read(spark, sf_dir, "pages"))


def op6_toolcalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = toolcalls.conversation_calls(common.read(spark, sf_dir, "conversations"))
    return toolcalls.link(calls, results, {"reply": toolcalls.REPLY}).select(F.col("conv").alias("conv_id"), "call_id", "call_turn", "result_turn", "status", "level", "valid", "json")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontaminate.decontaminate(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"), ["doc_id"])
    return got.select("doc_id", (F.size("hits") > 0).alias("contaminated"), F.size("hits").alias("n_items"), F.col("hits.item").alias("item_ids"), F.col("hits.edits").alias("edits"))


def op8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(common.read(spark, sf_dir, "documents"), "doc_id", width=4, percent=80)


def tokenizer_files() -> tuple[str, str, str]:
    """Vocabulary, the same as ranks, and the pattern of the public byte-level BPE."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.read(spark, sf_dir, "documents"), *tokenizer_files())


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, common.read(spark, sf_dir, "labels").select("doc_id", "toxic"), common.fold(F.col("doc_id")) != 2)
    got = toxicity.score_toxicity(docs, model, ["doc_id"])
    return got.select("doc_id", (common.fold(F.col("doc_id")) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def base_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pattern part of op1's result, which SQL can express."""
    return op1_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def base_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pattern part of op2's result."""
    return op2_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def base_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measures and base rules of op3's result."""
    return op3_quality(spark, sf_dir).drop("kept")


QUERIES = {f.__name__: f for f in (op1_pii, op2_secrets, op3_quality, op4_langid, op5_warc, op6_toolcalls, op7_decontamination, op8_neardup, op9_packing, op10_toxicity, base_pii, base_secrets, base_quality)}

#: The words of the key before an assigned secret, in letters of either case.
_KEYS = "(" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")) + ")"

SQL = {
    "base_pii": r"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        m AS (SELECT doc_id, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS email, regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS ip,
            list_transform(regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS card, list_transform(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS phone FROM t)
        SELECT doc_id, CAST(len(email) AS BIGINT) AS n_email,
            CAST(len(list_filter(ip, lambda x: len(list_filter(string_split(x, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(TRY_CAST(p AS BIGINT), 256) > 255)) = 0)) AS BIGINT) AS n_ip,
            CAST(len(list_filter(card, lambda x: length(x) BETWEEN 16 AND 19 AND list_sum(list_transform(range(0, length(x)), lambda i: list_extract([CAST(reverse(x)[i + 1] AS INTEGER), [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][CAST(reverse(x)[i + 1] AS INTEGER) + 1]], i % 2 + 1))) % 10 = 0)) AS BIGINT) AS n_card,
            CAST(len(list_filter(phone, lambda x: length(x) BETWEEN 8 AND 15)) AS BIGINT) AS n_phone
        FROM m""",
    "base_secrets": r"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
        SELECT doc_id, CAST(len(list_filter(regexp_extract_all(t, 'KEYS["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 6)) AS BIGINT) AS n_assign,
            CAST(len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) AS BIGINT) AS n_access, CAST(len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 24)) AS BIGINT) AS n_hex
        FROM t""".replace("KEYS", _KEYS),
    "base_quality": r"""
        WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS symbols,
            list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
        w AS (SELECT doc_id, i, ws[i : i + 4] AS five FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1))) AS i FROM t)),
        r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM w QUALIFY count(*) OVER (PARTITION BY doc_id, five) > 1) GROUP BY doc_id)
        SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(length(array_to_string(ws, '')), 0) AS BIGINT) AS word_chars, CAST(symbols AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
            CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, len(ws) < 10 OR 100 * coalesce(r.n, 0) > 20 * len(ws) AS base_failed
        FROM t LEFT JOIN r USING (doc_id)""",
    "op5_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
        d AS (SELECT page_id, octet_length(payload) AS n, lower(sha1(payload)) AS digest FROM p),
        g AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS top FROM d)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
            CASE WHEN n >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN n >= 1000 AND page_id < top THEN top END AS refers_to
        FROM g""",
    "op6_toolcalls": """
        WITH q AS (SELECT *, min(turn) FILTER (role = 'user') OVER (PARTITION BY conv_id) AS first FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
        c AS (SELECT conv_id, conv_id || ':' || turn AS call_id, turn, text, CASE WHEN turn > first THEN 1 ELSE 0 END AS level,
                '{"arguments":{"role":"user","text":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || ',"turn":' || turn || '},"id":"' || conv_id || ':' || turn || '","name":"reply"}' AS j FROM q WHERE role = 'user'),
        r AS (SELECT conv_id, conv_id || ':' || (turn - 1) AS call_id, turn, '{"content":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || ',"id":"' || conv_id || ':' || (turn - 1) || '"}' AS j
            FROM q WHERE role IS NULL OR role NOT IN ('user', 'system'))
        SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, c.turn AS call_turn, r.turn AS result_turn,
            CASE WHEN r.call_id IS NULL THEN 'unanswered' WHEN c.call_id IS NULL THEN 'orphan' ELSE 'linked' END AS status, c.level,
            c.call_id IS NOT NULL AND c.turn >= 0 AND coalesce(c.text, '') <> '' AS valid,
            CASE WHEN r.call_id IS NULL THEN '{"call":' || c.j || ',"status":"unanswered"}' WHEN c.call_id IS NULL THEN '{"result":' || r.j || ',"status":"orphan"}'
                ELSE '{"call":' || c.j || ',"result":' || r.j || ',"status":"linked"}' END AS json
        FROM c FULL JOIN r ON c.conv_id = r.conv_id AND c.call_id = r.call_id""",
    "op8_neardup": """
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
        s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
            ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i : i + 3], ' ')) END) AS ss FROM w),
        e AS (SELECT doc_id, len(ss) AS n, unnest(ss) AS sh FROM s),
        pairs AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.sh = b.sh AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
        links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
        reach AS (SELECT doc_id AS node, doc_id AS top FROM documents UNION SELECT links.b, reach.top FROM reach JOIN links ON links.a = reach.node AND reach.top < links.b),
        c AS (SELECT node, min(top) AS component_id FROM reach GROUP BY node)
        SELECT s.doc_id, CAST(len(ss) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept FROM s JOIN c ON c.node = s.doc_id""",
}
