"""The registered queries of these operators, and their DuckDB twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import repetition_quality

    return repetition_quality(_table(spark, sf_dir, "documents"))


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import as_text, scan_secrets

    found = scan_secrets(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "random")
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", number("assign"), number("access"), number("hex"), F.sha2(as_text(base), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"), number("random"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import genre, mix_to_targets

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    margins = {"source": (F.col("source"), 0.7), "lang": (F.col("lang"), 0.9), "topic": (genre(F.col("text"), F.col("tokens")), 1.0)}
    return mix_to_targets(docs, margins).select("doc_id", "source", "lang", F.col("mix_topic").alias("topic"), "tokens", F.round("probability", 9).alias("probability"), "kept", "targets", F.round("targets_off", 6).alias("targets_off"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import fit, identify

    docs = _table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), fit(docs))
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(_table(spark, sf_dir, "pages"), min_bytes=0)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import remove_repeats

    out = remove_repeats(_table(spark, sf_dir, "documents"), length=200)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import exact_topk

    vectors = _table(spark, sf_dir, "embeddings")
    return exact_topk(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents
    from .tokens import vocabulary

    return pack_documents(_table(spark, sf_dir, "documents"), vocabulary(), capacity=1024, end_id=2)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import dedup_lines

    out = dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"), n=5, percent=80)


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .phrases import collocations

    return collocations(_table(spark, sf_dir, "documents"), most=3, least=10, first=2000, share=50)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import merkle_manifest

    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0
    return merkle_manifest(_table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], tampered)


def op13_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_components

    return simhash_components(_table(spark, sf_dir, "documents"), n=3, most=3)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_secret_scans": op2_secret_scans,
    "op3_mixing": op3_mixing,
    "op4_language_id": op4_language_id,
    "op5_warc": op5_warc,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_exact_topk": op7_exact_topk,
    "op8_line_dedup": op8_line_dedup,
    "op9_packing": op9_packing,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_phrase_mining": op11_phrase_mining,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_simhash_dedup": op13_simhash_dedup,
}

_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _quality_sql() -> str:
    from .quality import COVERAGE, LINE_CHARS, MAX_REPEAT_PERCENT, MIN_WORDS

    chars = ", ".join(f"CAST(coalesce(max(chars) FILTER (n = {k}), 0) AS BIGINT) AS dup_{k}gram_chars" for k in COVERAGE)
    names = ", ".join(f"coalesce(dup_{k}gram_chars, 0) AS dup_{k}gram_chars" for k in COVERAGE)
    within = " AND ".join(f"dup_{k}gram_chars <= CAST({most} AS DOUBLE) * word_chars" for k, most in COVERAGE.items())
    return f"""
        WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[' || {_WS} || ']+'), lambda x: x <> '') AS ws FROM documents),
        i AS (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, (SELECT unnest([3, {", ".join(map(str, COVERAGE))}]) AS n)),
        g AS (SELECT doc_id, n, i, list_aggregate(ws[i : i + n - 1], 'string_agg', ' ') AS gram FROM i),
        d AS (SELECT doc_id, n, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, n, gram) > 1),
        c AS (SELECT DISTINCT doc_id, n, i + k AS pos FROM d, (SELECT unnest(range(10)) AS k) WHERE k < n),
        m AS (SELECT doc_id, n, count(*) AS words, sum(length(ws[pos])) AS chars FROM c JOIN w USING (doc_id) GROUP BY ALL),
        r AS (SELECT doc_id, coalesce(max(words) FILTER (n = 3), 0) AS n_repeat_words, {chars} FROM m GROUP BY doc_id),
        l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
        u AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) > 1 AND trim(line, {_WS}) <> '' AS again FROM l),
        q AS (SELECT doc_id, count(*) FILTER (again) AS n_dup_lines, CAST(coalesce(sum(length(line)) FILTER (again), 0) AS BIGINT) AS dup_line_chars FROM u GROUP BY doc_id),
        b AS (
            SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
                   length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols, length(coalesce(text, '')) AS n_chars_all, n_dup_lines, dup_line_chars,
                   coalesce(n_repeat_words, 0) AS n_repeat_words, {names}
            FROM documents JOIN w USING (doc_id) JOIN q USING (doc_id) LEFT JOIN r USING (doc_id)),
        f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM b)
        SELECT * EXCLUDE (n_chars_all), NOT base_failed AND dup_line_chars <= CAST({LINE_CHARS} AS DOUBLE) * n_chars_all AND {within} AS kept FROM f"""


ORACLE: dict[str, str] = {
    "op1_quality_rules": _quality_sql(),
    "op5_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS x FROM pages),
        f AS (SELECT body, min(page_id) AS first FROM p GROUP BY body)
        SELECT page_id, octet_length(encode(p.body)) AS payload_bytes,
               list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(x, (i // 4) * 5 + 1, 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) + 1, 1)), 'string_agg', '') AS payload_digest,
               CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
        FROM p JOIN f ON p.body = f.body""",
    "op7_exact_topk": """
        WITH x AS (
            SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(1024 * CAST(e AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM x q JOIN x c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
            WHERE q.vec_id % 100 = 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op8_line_dedup": f"""
        WITH l AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
            FROM documents),
        k AS (SELECT *, translate(trim(line, {_WS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        common AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
        j AS (SELECT k.*, common.key IS NOT NULL AND doc_id < last AS lost FROM k LEFT JOIN common ON k.key = common.key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
        FROM j GROUP BY doc_id""",
    "op10_jaccard_join": f"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[' || {_WS} || ']+'), lambda x: x <> '') AS words
            FROM documents),
        g AS (
            SELECT doc_id, list_distinct(CASE WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda i: list_aggregate(words[i : i + 4], 'string_agg', ' '))
                WHEN len(words) > 0 THEN [list_aggregate(words, 'string_agg', ' ')] ELSE [] END) AS grams
            FROM w),
        s AS (SELECT doc_id, unnest(grams) AS gram FROM g),
        n AS (SELECT doc_id, len(grams) AS n FROM g),
        shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
        e AS (SELECT a, b FROM shared JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * i >= 80 * (x.n + y.n - i)),
        r AS (SELECT doc_id AS v, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON r.v = e.a),
        m AS (SELECT v, min(c) AS component_id FROM r GROUP BY v)
        SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, m.component_id FROM n JOIN m ON n.doc_id = m.v""",
    "op11_phrase_mining": r"""
        WITH p AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents),
        w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
        g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i : i + k - 1], ' '))) AS phrase FROM w, (SELECT unnest([1, 2, 3]) AS k) WHERE len(ws) >= k),
        f AS (SELECT lang, k, phrase, lang || chr(1) || phrase AS key, count(*) AS a FROM g GROUP BY ALL),
        t AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
        c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND a >= 10),
        x AS (SELECT c.*, cut FROM c, (SELECT unnest([1, 2]) AS cut) WHERE cut < k),
        s AS (
            SELECT x.lang, x.k, x.phrase, x.a, x.ws, cut, l.a AS l, r.a AS r, CAST((1000000::HUGEINT * x.a * x.a) // (l.a::HUGEINT * r.a) AS BIGINT) AS score
            FROM x JOIN f l ON l.key = x.lang || chr(1) || array_to_string(ws[1 : cut], ' ') JOIN f r ON r.key = x.lang || chr(1) || array_to_string(ws[cut + 1 :], ' ')
            QUALIFY row_number() OVER (PARTITION BY x.lang, x.phrase ORDER BY score, cut) = 1),
        m AS (SELECT lang, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase, a FROM c WHERE k = 3),
        o AS (SELECT lang, phrase, max(a) AS over FROM m GROUP BY ALL),
        b AS (SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank FROM s LEFT JOIN o USING (lang, phrase) WHERE over IS NULL OR 100 * over < 50 * a)
        SELECT lang, rank, phrase, a, l, r, n, score FROM b JOIN t USING (lang) WHERE rank <= 2000""",
    "op12_merkle_manifest": """
        WITH RECURSIVE f AS (
            SELECT *, coalesce('=' || lang, '-') AS tree, coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS head,
                   coalesce(octet_length(encode(text)) || ':' || text, '-') AS tail,
                   xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i::INTEGER, 1))::BIGINT)),
                       lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END))) AS crc
            FROM documents),
        l AS (
            SELECT doc_id, tree, sha256(head || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
                   sha256(head || coalesce(octet_length(encode((n_chars + CASE WHEN crc % 7 = 0 THEN 1 ELSE 0 END)::VARCHAR)) || ':' || (n_chars + CASE WHEN crc % 7 = 0 THEN 1 ELSE 0 END), '-') || tail) AS seen
            FROM f),
        o AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM l),
        t AS (
            SELECT tree, 0 AS level, i, n, leaf AS h FROM o
            UNION ALL
            SELECT tree, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY tree, level, i // 2, n),
        s AS (SELECT tree, h, level AS depth, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
        u AS (
            SELECT 0 AS level, i, n, h FROM s
            UNION ALL
            SELECT level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY level, i // 2, n),
        nodes AS (
            SELECT tree, level, i, n, h FROM t WHERE n > 1
            UNION ALL
            SELECT s.tree, s.depth + u.level, u.i, u.n, u.h FROM s, u WHERE u.n > 1),
        steps AS (SELECT s.tree, s.depth, s.i AS top FROM s),
        w AS (
            SELECT o.doc_id, o.tree, o.i AS leaf_at, 0 AS level, CASE WHEN depth = 0 THEN top ELSE o.i END AS i, depth, top, o.seen AS h, '' AS proof FROM o JOIN steps USING (tree)
            UNION ALL
            SELECT w.doc_id, w.tree, leaf_at, w.level + 1, CASE WHEN w.level + 1 = depth THEN top ELSE w.i // 2 END, depth, top,
                   sha256(CASE WHEN b.h IS NULL THEN w.h WHEN w.i % 2 = 1 THEN b.h || w.h ELSE w.h || b.h END), proof || coalesce(b.h, '')
            FROM w JOIN nodes a ON a.tree = w.tree AND a.level = w.level AND a.i = w.i LEFT JOIN nodes b ON b.tree = w.tree AND b.level = w.level AND b.i = xor(w.i, 1)),
        done AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY tree, leaf_at ORDER BY level DESC) = 1)
        SELECT o.doc_id, o.leaf, s.h AS subroot, root.h AS root, sha256(proof) AS proof_sha256, done.h AS folded_root, done.h = root.h AS verified
        FROM o JOIN done ON done.tree = o.tree AND done.leaf_at = o.i JOIN s ON s.tree = o.tree, (SELECT h FROM u WHERE n = 1) AS root""",
}
