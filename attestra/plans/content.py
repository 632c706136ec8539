"""Queries over the content of source documents: what lies where in them. Inputs are built from the driver's tables by SQL that both engines run; the twins
then work the answers out in their own words."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import bindings, closure, delivery, intervals, patterns, questions, scope, segment, snapshots
from .catalogue import query, table
from .evidence import _LINES, INPUTS, SHARED, made, twin

_BOUGHT = f"{_LINES} JOIN {{orders}} ON o_orderkey = l_orderkey"
SHARED["bought"] = (_BOUGHT, f"SELECT l_orderkey, l_linenumber, o_custkey FROM {_BOUGHT}")
#: Orders have two blocks where they have more than four lines. Each order is a question, its lines are options. By order number: % 11: one option has
#: a text; % 13: a block is missing, % 17: or has no range; % 3 = 1: assets are wider than their options; % 23: one asset lies in no option and one is
#: missing; % 29: one has no range; % 31: an option without a label.
INPUTS |= {
    "choices": f"SELECT o_custkey AS document, l_orderkey AS question, CAST(l_linenumber AS INT) AS position, CASE WHEN l_orderkey % 31 = 0 AND l_linenumber = 1 THEN ' ' ELSE substring('ABCDEFGH', CAST(l_linenumber AS INT), 1) END AS label, CAST(l_orderkey * 2 + CASE WHEN l_linenumber > 4 THEN 1 ELSE 0 END AS STRING) AS block, CAST(l_linenumber * 10 AS INT) AS start, CAST(l_linenumber * 10 + 6 AS INT) AS z, NOT (l_orderkey % 11 = 0 AND l_linenumber = 2) AS asset_only FROM {_BOUGHT}",
    "blocks": "SELECT o_custkey AS document, CAST(o_orderkey * 2 + k AS STRING) AS block, o_orderkey * 300 + k * 150 AS range_start, CASE WHEN o_orderkey % 17 = 0 AND k = 0 THEN o_orderkey * 300 ELSE o_orderkey * 300 + k * 150 + 120 END AS range_end FROM {orders} CROSS JOIN (VALUES (0), (1)) AS v(k) WHERE NOT (o_orderkey % 13 = 0 AND k = 1)",
    "assets": f"SELECT o_custkey AS document, CAST(l_orderkey * 10 + l_linenumber AS STRING) AS asset, CAST(100 - l_linenumber AS INT) AS ordinal, l_orderkey * 300 + CASE WHEN l_linenumber > 4 THEN 150 ELSE 0 END + l_linenumber * 10 + CASE WHEN l_orderkey % 3 = 1 THEN -1 ELSE 2 END AS range_start, l_orderkey * 300 + CASE WHEN l_linenumber > 4 THEN 150 ELSE 0 END + l_linenumber * 10 + CASE WHEN l_orderkey % 29 = 0 AND l_linenumber = 2 THEN -5 WHEN l_orderkey % 3 = 1 THEN 9 ELSE 6 END AS range_end FROM {_BOUGHT} WHERE NOT (l_orderkey % 23 = 0 AND l_linenumber = 1)",
}


@query("""WITH r AS (SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS id, l_orderkey AS a, l_orderkey + CAST(l_quantity AS BIGINT) % 40 AS z FROM lineitem)
    SELECT x.l_suppkey, count(*) AS pairs, CAST(sum(least(x.z, y.z) - greatest(x.a, y.a)) AS BIGINT) AS shared FROM r x JOIN r y ON x.l_suppkey = y.l_suppkey AND x.a < y.z AND y.a < x.z AND x.id < y.id GROUP BY x.l_suppkey""")
def overlap_pairs(spark, sf_dir):
    """Ranges of one supplier that overlap, empty ones among them: how many pairs, and how much they share."""
    ranges = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("start"), (F.col("l_orderkey") + F.col("l_quantity").cast("long") % 40).alias("end"))
    met = intervals.overlaps_among(ranges, ["l_suppkey"], "id")
    return met.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("pairs"), F.sum(F.least("end", "other_end") - F.greatest("start", "other_start")).alias("shared"))


@query("""WITH m AS (SELECT user_id, event_id, event_id AS p FROM events WHERE event_type <> 'view'), r AS (SELECT user_id, event_id AS a, event_id + CAST(floor(value * 8) AS BIGINT) AS z, event_id AS owner FROM events WHERE event_type = 'view'),
    h AS (SELECT m.user_id, m.event_id, count(DISTINCT owner) AS n, min(owner) AS owner FROM m LEFT JOIN r ON r.user_id = m.user_id AND a <= p AND p < z GROUP BY ALL)
    SELECT event_id, CASE WHEN n = 1 THEN owner END AS owner, CASE WHEN n = 0 THEN 'unassigned' WHEN n = 1 THEN 'assigned' ELSE 'ambiguous' END AS assignment FROM h""")
def range_owners(spark, sf_dir):
    """Places in a user's ledger, and the one range that holds each."""
    events = table(spark, sf_dir, "events")
    marks = events.where("event_type <> 'view'").select("user_id", "event_id", F.col("event_id").alias("at"))
    ranges = events.where("event_type = 'view'").select("user_id", F.col("event_id").alias("a"), (F.col("event_id") + F.floor(F.col("value") * 8)).alias("z"), F.col("event_id").alias("owner"))
    return segment.owners(marks, ranges, "user_id", "at", "a", "z", "owner").select("event_id", "owner", "assignment")


@query(
    twin(
        ("choices", "blocks", "assets"),
        "q AS (SELECT document, question, bool_and(asset_only) AS pure, bool_or(trim(label) = '') AS unnamed FROM choices GROUP BY ALL HAVING bool_or(asset_only))",
        "c AS (SELECT c.*, q.pure, q.unnamed, b.block IS NOT NULL AS found, coalesce(range_end > range_start, false) AS valid, range_start AS f, range_end AS t FROM choices c JOIN q USING (document, question) LEFT JOIN blocks b USING (document, block))",
        "g AS (SELECT * FROM assets WHERE range_end > range_start)",
        "s AS (SELECT c.document, c.question, c.position, count(g.asset) AS n, min(g.asset) AS asset FROM c LEFT JOIN g ON g.document = c.document AND c.valid AND g.range_start >= c.f + c.start AND g.range_end <= c.f + c.z GROUP BY ALL)",
        "e AS (SELECT c.document, c.question, c.block, min(c.position) AS first, count(*) AS many, bool_and(s.n = 1) AND count(DISTINCT s.asset) = count(*) AS exact, any_value(found) AS found, any_value(valid) AS valid, any_value(f) AS f, any_value(t) AS t FROM c JOIN s USING (document, question, position) GROUP BY ALL)",
        "i AS (SELECT e.document, e.block, g.asset, row_number() OVER (PARTITION BY e.document, e.block ORDER BY g.range_start, g.range_end, ordinal, g.asset) AS r, count(*) OVER (PARTITION BY e.document, e.block) AS inside FROM e JOIN g ON g.document = e.document AND e.valid AND g.range_start >= e.f AND g.range_end <= e.t)",
        "w AS (SELECT e.*, CASE WHEN NOT found THEN 'asset_only_option_block_missing' WHEN NOT valid THEN 'asset_only_option_block_range_invalid' WHEN NOT exact AND coalesce((SELECT max(inside) FROM i WHERE i.document = e.document AND i.block = e.block), 0) <> many THEN 'asset_only_option_asset_count_mismatch' END AS why FROM e)",
        "v AS (SELECT document, question, arg_min(why, first) FILTER (WHERE why IS NOT NULL) AS why FROM w GROUP BY ALL)",
        "n AS (SELECT c.*, row_number() OVER (PARTITION BY c.document, c.question, c.block ORDER BY c.start, c.position) AS r FROM c)",
        "o AS (SELECT n.document, n.question, n.position, n.label, n.block, n.start, n.z, CASE WHEN NOT pure THEN 'asset_only_option_set_ambiguous' ELSE coalesce(v.why, CASE WHEN unnamed THEN 'asset_only_option_label_invalid' END) END AS reason, CASE WHEN w.exact THEN s.asset ELSE i.asset END AS asset, CASE WHEN w.exact THEN 'exact_marker_range' ELSE 'block_range_order' END AS mode FROM n JOIN v USING (document, question) JOIN w USING (document, question, block) JOIN s USING (document, question, position) LEFT JOIN i ON i.document = n.document AND i.block = n.block AND i.r = n.r)",
        """SELECT document, question, position, label, block, CASE WHEN reason IS NULL THEN asset END AS asset, CASE WHEN reason IS NULL THEN mode END AS mode, reason,
           CASE WHEN reason IS NULL THEN sha256('{"association_mode":"' || mode || '","character_range":[' || start || ',' || z || '],"option_label":"' || label || '","source_asset_id":"' || asset || '","source_block_id":"' || block || '"}') END AS evidence_sha256 FROM o""",
    )
)
def option_assets(spark, sf_dir):
    choices, blocks, assets = made(spark, sf_dir, "choices", "blocks", "assets")
    return bindings.bind_assets(choices.withColumnRenamed("z", "end"), blocks, assets)


_PARTS = f"{_LINES} JOIN {{part}} ON p_partkey = l_partkey"
SHARED["parts"] = (_PARTS, f"SELECT l_orderkey, l_linenumber, l_partkey, p_name, p_brand, p_type FROM {_PARTS}")
_N = "CAST(l_linenumber AS STRING)"
#: An order as a paper: a section, two blocks a line (a stem, then options by part number: with texts, of images alone, none, or with one label twice),
#: and answers, behind a heading or not, some of them empty. And as notes: a goal or points, then types with examples and what only teachers see.
INPUTS |= {
    "paper": f"""SELECT o_orderkey AS document, 0 AS ordinal, ' 一、选择题' AS raw_text FROM {{orders}} WHERE o_orderkey % 9 <> 8
        UNION ALL SELECT l_orderkey, CAST(l_linenumber * 2 - 1 AS INT), '　' || {_N} || '. ' || p_name || chr(7) || ' ' FROM {_PARTS}
        UNION ALL SELECT l_orderkey, CAST(l_linenumber * 2 AS INT), CASE l_partkey % 4 WHEN 0 THEN '(' || p_brand || ') A. ' || p_type || '  B．' || p_name || chr(7) WHEN 1 THEN 'A．' || chr(1) || ' B．' || chr(1) WHEN 2 THEN ' ' || p_type ELSE 'A、' || p_brand || ' A. ' || p_type END FROM {_PARTS}
        UNION ALL SELECT o_orderkey, 100, '【答案与解析】' FROM {{orders}} WHERE o_orderkey % 4 <> 3
        UNION ALL SELECT l_orderkey, CAST(100 + l_linenumber * 2 AS INT), {_N} || '．【答案】 ' || CASE WHEN l_partkey % 5 = 0 THEN '' ELSE p_brand END || ' 【解析】' || p_type || ' ' FROM {_PARTS}
        UNION ALL SELECT l_orderkey, CAST(101 + l_linenumber * 2 AS INT), p_name FROM {_PARTS} WHERE l_partkey % 3 = 0""",
    "notes": f"""SELECT o_orderkey AS document, 0 AS ordinal, CASE WHEN o_orderkey % 2 = 0 THEN ' 【学习目标】' ELSE '序' END AS raw_text FROM {{orders}}
        UNION ALL SELECT l_orderkey, CAST(l_linenumber AS INT), CASE WHEN l_partkey % 3 = 0 THEN '要点一、' || p_name ELSE '　' || p_type || chr(7) || ' ' END FROM {_PARTS}
        UNION ALL SELECT o_orderkey, 50, '【典型例题】' FROM {{orders}} WHERE o_orderkey % 3 <> 0
        UNION ALL SELECT o_orderkey, 51, '类型一、' || o_orderstatus FROM {{orders}} WHERE o_orderkey % 5 <> 0
        UNION ALL SELECT l_orderkey, CAST(50 + l_linenumber * 2 AS INT), CASE l_partkey % 3 WHEN 0 THEN {_N} || '. ' || p_name WHEN 1 THEN '【变式】' || p_brand ELSE p_type END FROM {_PARTS}
        UNION ALL SELECT l_orderkey, CAST(51 + l_linenumber * 2 AS INT), CASE WHEN l_partkey % 2 = 0 THEN '【思路点拨】' || p_type ELSE p_brand || ' ' END FROM {_PARTS} WHERE l_linenumber > 0""",
}
_W = r"[\s　]"
_SHOWN = "regexp_replace(translate({0}, chr(1) || chr(7), ''), '^" + _W + "+|" + _W + "+$', '', 'g')"
_OPT = f"(?:^|{_W})([A-D])[.．、]{_W}*"
_IMG = f"(?:^|{_W})([A-D])[^\\s　\\x01]{{1,4}}{_W}*\\x01"


def spans_text(spans: str):
    """block:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["block"].cast("string"), x["start"].cast("string"), x["end"].cast("string"))), ",")


@query(
    twin(
        ("paper",),
        rf"""b AS (SELECT *, regexp_matches(raw_text, '^{_W}*[0-9]+[.．、]') AS numbered, regexp_extract(raw_text, '^{_W}*([0-9]+)[.．、]', 1) AS num, nullif(regexp_extract(raw_text, '^{_W}*[一-鿿]+[.．、]{_W}*(选择题|填空题|计算题|解答题)', 1), '') AS kind FROM paper)""",
        "h AS (SELECT document, min(ordinal) AS at_ FROM b WHERE contains(raw_text, '【答案与解析】') OR (numbered AND contains(raw_text, '【答案】')) GROUP BY document)",
        "q AS (SELECT *, sum(CASE WHEN numbered THEN 1 ELSE 0 END) OVER (PARTITION BY document ORDER BY ordinal) AS item FROM (SELECT b.*, count(kind) OVER (PARTITION BY document ORDER BY ordinal) AS section FROM b LEFT JOIN h USING (document) WHERE at_ IS NULL OR ordinal < at_) WHERE section > 0)",
        rf"p AS (SELECT *, regexp_extract_all(raw_text, '{_OPT}', 1) AS told, regexp_extract_all(raw_text, '{_IMG}', 1) AS placed, regexp_split_to_array(raw_text, '{_OPT}') AS pieces FROM q WHERE item > 0)",
        f"s AS (SELECT *, CASE WHEN len(placed) > 0 THEN '' ELSE {_SHOWN.format('pieces[1]')} END AS stem, CASE WHEN len(placed) > 0 THEN list_transform(placed, lambda x: x || '|') ELSE list_transform(list_zip(told, pieces[2:]), lambda x: x[1] || '|' || {_SHOWN.format('x[2]')}) END AS options FROM p)",
        "o AS (SELECT document, item, min(ordinal) AS first, max(ordinal) AS last, min_by(num, ordinal) AS number, string_agg(stem, chr(10) ORDER BY ordinal) FILTER (WHERE stem <> '') AS stem, string_agg(ordinal || ':' || (strpos(raw_text, stem) - 1) || ':' || (strpos(raw_text, stem) - 1 + length(stem)), ',' ORDER BY ordinal) FILTER (WHERE stem <> '') AS stem_spans, flatten(list(options ORDER BY ordinal)) AS options, flatten(list(CASE WHEN len(placed) > 0 THEN [] ELSE list_transform(options, lambda x: ordinal || ':' || (strpos(raw_text, x[3:]) - 1) || ':' || (strpos(raw_text, x[3:]) - 1 + length(x[3:]))) END ORDER BY ordinal)) AS option_spans FROM s GROUP BY document, item)",
        "e AS (SELECT *, sum(CASE WHEN numbered THEN 1 ELSE 0 END) OVER (PARTITION BY document ORDER BY ordinal) AS entry FROM b JOIN h USING (document) WHERE ordinal > at_ OR (ordinal = at_ AND NOT contains(raw_text, '【答案与解析】'))) ",
        f"f AS (SELECT *, strpos(raw_text, '【答案】') - 1 AS a, strpos(raw_text, '【解析】') - 1 AS z FROM e WHERE entry > 0)",
        f"g AS (SELECT *, CASE WHEN a >= 0 AND {_SHOWN.format('raw_text[a + 5 : CASE WHEN z >= 0 THEN z ELSE length(raw_text) END]')} <> '' THEN raw_text[a + 1 : CASE WHEN z >= 0 THEN z ELSE length(raw_text) END] END AS answer, CASE WHEN z >= 0 THEN raw_text[z + 1 :] WHEN NOT numbered THEN raw_text END AS analysis FROM f)",
        "x AS (SELECT document, entry, min_by(num, ordinal) AS number, string_agg(answer, chr(10) ORDER BY ordinal) AS answer, string_agg(ordinal || ':' || a || ':' || (a + length(answer)), ',' ORDER BY ordinal) AS answer_spans, string_agg(analysis, chr(10) ORDER BY ordinal) AS analysis, string_agg(ordinal || ':' || greatest(z, 0) || ':' || (greatest(z, 0) + length(analysis)), ',' ORDER BY ordinal) AS analysis_spans FROM g GROUP BY document, entry QUALIFY row_number() OVER (PARTITION BY document, min_by(num, ordinal) ORDER BY entry DESC) = 1)",
        "SELECT o.document, o.number, o.stem, o.stem_spans, array_to_string(o.options, ' ') AS options, array_to_string(option_spans, ',') AS option_spans, coalesce(x.answer, '') AS answer, coalesce(answer_spans, '') AS answer_spans, coalesce(analysis, '') AS analysis, coalesce(analysis_spans, '') AS analysis_spans, first, last, CASE WHEN len(list_distinct(list_transform(o.options, lambda y: y[1]))) < len(o.options) THEN 'duplicate_option_label' END AS problem FROM o LEFT JOIN x USING (document, number)",
    )
)
def question_spans(spark, sf_dir):
    """Questions of papers with their options and answers, and where each of their texts lies."""
    out = questions.segment_questions(*made(spark, sf_dir, "paper"), "document")
    none = F.lit("")
    options = F.array_join(F.transform("options", lambda o: F.concat(o["label"], F.lit("|"), F.coalesce(o["text"], none))), " ")
    places = out.withColumn("_o", F.flatten("options.text_spans"))
    joined = lambda c: F.coalesce(F.array_join(c, "\n"), none).alias(c)
    told = lambda c: F.coalesce(spans_text(c), none).alias(c)
    return places.select("document", "number", "stem", told("stem_spans"), options.alias("options"), spans_text("_o").alias("option_spans"), joined("answer"), told("answer_spans"), joined("analysis"), told("analysis_spans"), "first", "last", "problem")


@query(
    twin(
        ("notes",),
        f"b AS (SELECT *, {_SHOWN.format('raw_text')} AS t, strpos(raw_text, {_SHOWN.format('raw_text')}) - 1 AS a FROM notes)",
        "k AS (SELECT *, regexp_matches(t, '^类型[一-鿿]+[、。]') AS is_type, min(CASE WHEN t = '【典型例题】' THEN ordinal END) OVER (PARTITION BY document) AS typical, min(CASE WHEN regexp_matches(t, '^类型[一-鿿]+[、。]') THEN ordinal END) OVER (PARTITION BY document) AS types FROM b)",
        "n AS (SELECT *, sum(CASE WHEN t = '【学习目标】' OR regexp_matches(t, '^要点[一-鿿]+、') THEN 1 ELSE 0 END) OVER (PARTITION BY document ORDER BY ordinal) AS item FROM k WHERE coalesce(ordinal < coalesce(typical, types), true))",
        r"e AS (SELECT *, sum(CASE WHEN NOT is_type AND (regexp_matches(t, '^\s*[0-9]+[,、.．]') OR starts_with(t, '【变式】')) THEN 1 ELSE 0 END) OVER (PARTITION BY document ORDER BY ordinal) AS item, last_value(CASE WHEN is_type THEN t END IGNORE NULLS) OVER (PARTITION BY document ORDER BY ordinal) AS name FROM k WHERE ordinal >= types)",
        "i AS (SELECT *, sum(CASE WHEN starts_with(t, '【思路点拨】') THEN 1 ELSE 0 END) OVER (PARTITION BY document, item ORDER BY ordinal) > 0 AS hidden FROM e WHERE item > 0)",
        "u AS (SELECT document, 'knowledge_note' AS item_kind, item, ordinal, t, a, false AS hidden, NULL AS name FROM n WHERE item > 0 UNION ALL SELECT document, 'worked_example', item, ordinal, t, a, hidden, name FROM i)",
        """SELECT document, item_kind, CASE WHEN item_kind = 'knowledge_note' THEN min_by(t, ordinal) ELSE min(name) || CASE WHEN starts_with(min_by(t, ordinal), '【变式】') THEN ' / variant' ELSE '' END END AS title,
           string_agg(t, chr(10) ORDER BY ordinal) FILTER (WHERE NOT hidden AND t <> '') AS student_text, string_agg(ordinal || ':' || a || ':' || (a + length(t)), ',' ORDER BY ordinal) FILTER (WHERE NOT hidden AND t <> '') AS student_spans,
           coalesce(string_agg(t, chr(10) ORDER BY ordinal) FILTER (WHERE hidden), '') AS internal_text, coalesce(string_agg(ordinal || ':' || a || ':' || (a + length(t)), ',' ORDER BY ordinal) FILTER (WHERE hidden), '') AS internal_spans, min(ordinal) AS first, max(ordinal) AS last
           FROM u GROUP BY document, item_kind, item""",
    )
)
def note_spans(spark, sf_dir):
    """Notes and worked examples, what students and what only teachers see, and where it lies."""
    out = questions.segment_notes(*made(spark, sf_dir, "notes"), "document")
    return out.select("document", "item_kind", "title", "student_text", spans_text("student_spans").alias("student_spans"), "internal_text", spans_text("internal_spans").alias("internal_spans"), "first", "last")


_WORDS = "SELECT DISTINCT word FROM (SELECT unnest(string_split(regexp_replace(text, '[^\\p{L}]+', ' ', 'g'), ' ')) AS word FROM benchmark) WHERE length(word) >= 4"


def _keywords(spark, sf_dir):
    words = F.split(F.regexp_replace("text", r"[^\p{L}]+", " "), " ")
    found = table(spark, sf_dir, "benchmark").select(F.explode(words).alias("pattern")).distinct().where(F.length("pattern") >= 4)
    return found.select(F.xxhash64("pattern").alias("pattern_id"), "pattern")


@query(f"SELECT word AS pattern, count(*) AS n_docs, CAST(sum(strpos(text, word) - 1) AS BIGINT) AS places FROM ({_WORDS}) JOIN documents ON contains(text, word) GROUP BY word")
def keyword_hits(spark, sf_dir):
    """In how many documents each word of the benchmark stands, and the sum of the places where it first does."""
    words = _keywords(spark, sf_dir)
    found = patterns.hits(table(spark, sf_dir, "documents"), words, "doc_id", "text")
    return found.groupBy("pattern_id").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("first").alias("places")).join(words, "pattern_id").select("pattern", "n_docs", "places")


@query("""WITH w AS (SELECT item_id, string_split(regexp_replace(text, '[^\\p{L}]+', ' ', 'g'), ' ') AS ws FROM benchmark),
    g AS (SELECT item_id AS rule, (i - 1) % 3 AS g, ws[i] AS word FROM w, (SELECT unnest(range(1, 13)) AS i) WHERE length(ws[i]) >= 4),
    d AS (SELECT DISTINCT doc_id, rule, g FROM g JOIN documents ON contains(text, word)), n AS (SELECT rule, count(DISTINCT g) AS n FROM g GROUP BY rule)
    SELECT doc_id, rule FROM d GROUP BY doc_id, rule HAVING count(*) = (SELECT n FROM n WHERE n.rule = d.rule)""")
def signal_rules(spark, sf_dir):
    """Documents that hold some word of every group of a benchmark item's words."""
    words = F.split(F.regexp_replace("text", r"[^\p{L}]+", " "), " ")
    rules = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("rule"), F.posexplode(F.slice(words, 1, 12)).alias("i", "pattern")).where(F.length("pattern") >= 4)
    rules = rules.select("rule", (F.col("i") % 3).alias("group"), F.xxhash64("pattern").alias("pattern_id"))
    return patterns.rules_of_texts(table(spark, sf_dir, "documents"), _keywords(spark, sf_dir), rules, "doc_id", "text")


#: Customers as questions, orders as their mappings to 25 textbooks of 4 nodes; by number each rule of the chain stops some.
INPUTS |= {
    "sq": "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'high' ELSE 'middle' END AS stage FROM {customer}",
    "sm": "SELECT o_custkey AS question_id, o_orderkey % 25 AS textbook_id, CASE WHEN o_orderkey % 37 = 0 THEN NULL ELSE o_orderkey % 25 * 10 + o_custkey % 4 END AS curriculum_node_id, CASE WHEN o_orderkey % 41 = 0 THEN 'rejected' WHEN o_orderkey % 43 = 0 THEN NULL ELSE 'approved' END AS fit_status, CASE WHEN o_orderkey % 47 = 0 THEN 'candidate' END AS classification_method FROM {orders}",
    "st": "SELECT n_nationkey AS id, 'v1' AS catalog_version FROM {nation}",
    "sn": "SELECT n_nationkey * 10 + k AS id, CASE WHEN n_nationkey = 3 AND k = 1 THEN 4 ELSE n_nationkey END AS textbook_id, CASE WHEN n_nationkey = 5 THEN 'high' WHEN n_nationkey % 7 = 6 THEN NULL ELSE 'middle' END AS stage, CASE WHEN n_nationkey = 8 AND k = 2 THEN 'v0' ELSE 'v1' END AS catalog_version, CASE WHEN k = 3 AND n_nationkey % 2 = 0 THEN 'retired' ELSE 'active' END AS status FROM {nation} CROSS JOIN (VALUES (0), (1), (2), (3)) AS v(k)",
    "sr": "SELECT n_nationkey AS id, n_nationkey AS textbook_id, 'v1' AS catalog_version, CASE WHEN n_nationkey = 1 THEN 'draft' ELSE 'approved' END AS status, CASE WHEN n_nationkey = 2 THEN '' ELSE n_name END AS source_reference, md5(n_name) AS source_hash FROM {nation} WHERE n_nationkey <> 9",
    "si": "SELECT n_nationkey AS catalog_release_id, n_nationkey + 100 AS import_run_id FROM {nation} WHERE n_nationkey <> 10",
    "su": "SELECT n_nationkey + 100 AS id, CASE WHEN n_nationkey = 11 THEN 'failed' ELSE 'validated' END AS status FROM {nation} UNION ALL SELECT n_nationkey, CASE WHEN n_nationkey = 12 THEN 'failed' ELSE 'approved' END FROM {nation}",
    "sa": "SELECT n_nationkey AS catalog_release_id, n_nationkey + 100 AS import_run_id, CASE WHEN n_nationkey = 14 THEN 'open' ELSE 'approved' END AS status FROM {nation}",
    "sp": "SELECT DISTINCT o_custkey AS question_id, o_orderkey % 25 AS textbook_id, o_orderkey % 25 * 10 + o_custkey % 4 AS curriculum_node_id, CASE WHEN o_custkey % 19 = 0 THEN 12 ELSE o_custkey % 12 END AS import_run_id, CASE WHEN o_custkey % 29 = 0 THEN '' ELSE md5(CAST(o_custkey AS STRING)) END AS mapping_hash FROM {orders} WHERE o_custkey % 23 <> 0",
    "sk": "SELECT DISTINCT o_custkey AS question_id, l_partkey AS knowledge_point_id, o_custkey % 12 AS import_run_id, md5(CAST(o_custkey AS STRING)) AS mapping_hash FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey WHERE o_custkey % 5 <> 0",
    "sc": "SELECT p_partkey AS knowledge_point_id, n_nationkey * 10 + p_partkey % 4 AS curriculum_node_id FROM {part} CROSS JOIN {nation} WHERE (p_partkey + n_nationkey) % 3 = 0",
    "sw": "SELECT p_partkey AS id, CASE WHEN p_size % 4 = 0 THEN 'pending' ELSE 'approved' END AS review_status FROM {part}",
    "sv": "SELECT o_custkey AS question_id, o_custkey AS id, max(o_orderkey % 25) AS textbook_id, max(o_orderkey % 25) * 10 + o_custkey % 4 AS curriculum_node_id, md5(CAST(o_custkey AS STRING)) AS mapping_hash FROM {orders} WHERE o_custkey % 4 = 1 GROUP BY o_custkey",
    "ss": "SELECT c_custkey AS question_id, md5(CAST(c_custkey AS STRING)) AS input_hash, 1 AS revision, CASE WHEN c_custkey % 13 = 0 THEN 'now' END AS invalidated_at FROM {customer} WHERE c_custkey % 17 <> 0",
    "sh": "SELECT c_custkey AS question_id, md5(CAST(c_custkey + CASE WHEN c_custkey % 11 = 0 THEN 1 ELSE 0 END AS STRING)) AS input_hash FROM {customer} WHERE c_custkey % 31 <> 0",
    "sd": "SELECT o_custkey AS source_revision_id, o_custkey AS question_id, max(o_orderkey % 25) AS textbook_id, max(o_orderkey % 25) * 10 + o_custkey % 4 AS curriculum_node_id, CASE WHEN o_custkey % 7 = 0 THEN 'open' ELSE 'approved' END AS status, md5(CAST(o_custkey AS STRING)) AS approval_input_hash, 1 AS approval_snapshot_revision FROM {orders} GROUP BY o_custkey",
    "sx": "SELECT DISTINCT o_custkey AS source_revision_id, l_partkey AS knowledge_point_id FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey WHERE o_custkey % 9 <> 0",
}
_SCOPE = ("sq", "sm", "st", "sn", "sr", "si", "su", "sa", "sp", "sk", "sc", "sw", "sv", "ss", "sh", "sd", "sx")
_JUDGED = (
    "good AS (SELECT sc.curriculum_node_id, sc.knowledge_point_id FROM sc JOIN sw ON sw.id = sc.knowledge_point_id AND sw.review_status = 'approved')",
    "r AS (SELECT sv.*, (SELECT count(*) FROM sx JOIN good g USING (knowledge_point_id) WHERE sx.source_revision_id = sv.id AND g.curriculum_node_id = sv.curriculum_node_id) AS n, ss.input_hash AS told, ss.invalidated_at AS gone, sh.input_hash AS now_, sd.status AS seen FROM sv LEFT JOIN ss USING (question_id) LEFT JOIN sh USING (question_id) LEFT JOIN sd ON sd.source_revision_id = sv.id AND sd.status = 'approved' AND sd.question_id = sv.question_id AND sd.textbook_id = sv.textbook_id AND sd.curriculum_node_id = sv.curriculum_node_id AND sd.approval_input_hash = ss.input_hash AND sd.approval_snapshot_revision = ss.revision)",
    "v AS (SELECT question_id, textbook_id, curriculum_node_id, n, CASE WHEN told IS NULL OR gone IS NOT NULL THEN 'p1_3c_approval_snapshot_missing_or_invalidated' WHEN now_ IS NULL THEN 'p1_3c_approval_input_unavailable' WHEN told <> now_ THEN 'p1_3c_approval_snapshot_stale' WHEN seen IS NULL THEN 'p1_3c_current_revision_audit_missing' WHEN n = 0 THEN 'p1_3c_current_revision_knowledge_missing' ELSE '' END AS why FROM r)",
    "k AS (SELECT sk.question_id, sk.import_run_id, sk.mapping_hash, g.curriculum_node_id, count(DISTINCT knowledge_point_id) AS n FROM sk JOIN good g USING (knowledge_point_id) GROUP BY ALL)",
    """j AS (SELECT m.question_id, m.textbook_id, m.curriculum_node_id, CASE WHEN m.fit_status = 'rejected' THEN 'f教材映射已被拒绝' WHEN m.classification_method = 'candidate' THEN 'u分类器映射仅为候选建议，不能作为教材范围批准依据' WHEN m.fit_status IS NULL THEN 'u教材映射尚未获自动批准' WHEN m.curriculum_node_id IS NULL THEN 'u映射缺少课程节点'
        WHEN n.textbook_id <> m.textbook_id OR n.catalog_version <> t.catalog_version THEN 'f教材与课程节点版本不一致' WHEN n.stage IS DISTINCT FROM q.stage THEN 'f题目学段与课程节点学段冲突' WHEN n.status <> 'active' THEN 'u课程节点未启用' WHEN r.id IS NULL OR r.status <> 'approved' OR r.source_reference = '' THEN 'u缺少已批准且可追溯的教材目录发布记录'
        WHEN i.import_run_id IS NULL OR u.status <> 'validated' OR a.status IS NULL THEN 'u缺少已批准且可追溯的受控导入教材目录记录' WHEN v.why <> '' THEN 'u' || v.why WHEN v.why = '' THEN 'p' WHEN x.status IS NULL OR x.status <> 'approved' OR p.mapping_hash = '' THEN 'u缺少已批准且可追溯的受控导入教材目录记录' WHEN k.n IS NULL THEN 'u缺少与课程节点一致的已批准知识点映射' ELSE 'p' END AS d,
        coalesce(v.n, k.n) AS points
        FROM sm m JOIN sq q ON q.id = m.question_id JOIN st t ON t.id = m.textbook_id LEFT JOIN sn n ON n.id = m.curriculum_node_id LEFT JOIN sr r ON r.textbook_id = m.textbook_id AND r.catalog_version = t.catalog_version LEFT JOIN si i ON i.catalog_release_id = r.id LEFT JOIN su u ON u.id = i.import_run_id LEFT JOIN sa a ON a.catalog_release_id = r.id AND a.import_run_id = i.import_run_id AND a.status = 'approved'
        LEFT JOIN sp p ON p.question_id = m.question_id AND p.textbook_id = m.textbook_id AND p.curriculum_node_id = m.curriculum_node_id LEFT JOIN su x ON x.id = p.import_run_id LEFT JOIN k ON k.question_id = m.question_id AND k.import_run_id = p.import_run_id AND k.mapping_hash = p.mapping_hash AND k.curriculum_node_id = m.curriculum_node_id
        LEFT JOIN v ON v.question_id = m.question_id AND v.textbook_id = m.textbook_id AND v.curriculum_node_id = m.curriculum_node_id)""",
)


def _judged(spark, sf_dir):
    t = dict(zip(_SCOPE, made(spark, sf_dir, *_SCOPE), strict=True))
    revised = scope.revision_scope(t["sv"], t["ss"], t["sh"], t["sd"], t["sx"], t["sc"], t["sw"])
    return t["sq"], scope.mapping_scope(t["sq"], t["sm"], t["st"], t["sn"], t["sr"], t["si"], t["su"], t["sa"], t["sp"], t["sk"], t["sc"], t["sw"], revised)


@query(twin(_SCOPE, *_JUDGED, "SELECT question_id, textbook_id, curriculum_node_id, CASE substr(d, 1, 1) WHEN 'f' THEN 'fail' WHEN 'p' THEN 'pass' ELSE 'unsupported' END AS status, substr(d, 2) AS reason, CASE WHEN d = 'p' THEN points END AS points FROM j"))
def textbook_scope(spark, sf_dir):
    """Each mapping with the first rule that decides it."""
    out = _judged(spark, sf_dir)[1]
    return out.select("question_id", "textbook_id", "curriculum_node_id", "status", "reason", F.size("knowledge_points").alias("points"))


@query(twin(_SCOPE, *_JUDGED, "SELECT q.id, CASE WHEN bool_or(d LIKE 'f%') THEN 'fail' WHEN bool_or(d = 'p') THEN 'pass' ELSE 'unsupported' END AS status, coalesce(string_agg(DISTINCT substr(d, 2), ';' ORDER BY substr(d, 2)) FILTER (WHERE d <> 'p'), CASE WHEN count(d) = 0 THEN '缺少受控教材课程映射' ELSE '' END) AS reasons FROM sq q LEFT JOIN j ON j.question_id = q.id GROUP BY q.id"))
def textbook_scope_of_questions(spark, sf_dir):
    questions_, judged = _judged(spark, sf_dir)
    return scope.question_scope(questions_, judged).select("id", "status", F.array_join("reasons", ";").alias("reasons"))


@query("""WITH RECURSIVE e AS (
        SELECT 'q' AS kind, c_custkey AS id, 'm' AS to_kind, c_custkey AS to_id FROM customer
        UNION ALL SELECT 'm', c_custkey, 'q', CASE WHEN c_custkey % 25 = 24 THEN c_custkey - 24 ELSE c_custkey + 1 END FROM customer
        UNION ALL SELECT 'm', c_custkey, 'q', c_custkey + 2 FROM customer WHERE c_custkey % 10 = 0),
    r AS (SELECT 'q' AS kind, c_custkey AS id, c_custkey AS cause, 0 AS depth FROM customer WHERE c_acctbal < -800
        UNION SELECT e.to_kind, e.to_id, r.cause, r.depth + 1 FROM r JOIN e ON e.kind = r.kind AND e.id = r.id WHERE r.depth < 60)
    SELECT kind, id, min(depth) AS depth, arg_min(cause, depth * 10000000 + cause) AS cause FROM r GROUP BY kind, id""")
def invalidation_closure(spark, sf_dir):
    """What customers in debt void: cycles of 25, each with diamonds, over two kinds of nodes, up to fifty steps deep."""
    c = table(spark, sf_dir, "customer")
    edge = lambda df, kind, to_kind, to: df.select(F.lit(kind).alias("kind"), F.col("c_custkey").alias("id"), F.lit(to_kind).alias("to_kind"), to.alias("to_id"))
    k = F.col("c_custkey")
    edges = edge(c, "q", "m", k).unionByName(edge(c, "m", "q", F.when(k % 25 == 24, k - 24).otherwise(k + 1))).unionByName(edge(c.where(k % 10 == 0), "m", "q", k + 2))
    return closure.reached(c.where("c_acctbal < -800").select(F.lit("q").alias("kind"), k.alias("id"), k.alias("cause")), edges)


_REQUESTS = """SELECT user_id AS document, event_id AS seq, event_type || CAST(event_id % 6 AS {text}) AS token, CASE event_type WHEN 'click' THEN 'plan' WHEN 'error' THEN 'generate' WHEN 'purchase' THEN 'bind' WHEN 'signup' THEN 'report' ELSE 'deliver' END AS kind,
    CASE WHEN event_id % 7 = 0 THEN event_id % 4 END AS expected, CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS shortage, event_id % 11 <> 0 AS progress, CASE WHEN event_id % 13 = 0 THEN ' ' ELSE 'h' || CAST(user_id % 2 AS {text}) END AS content, CASE WHEN event_id % 17 <> 0 THEN 'h' || CAST(user_id % 2 AS {text}) END AS evidence, event_id % 3 <> 0 AS gates, event_id % 4 <> 0 AS complete FROM {events}"""


@query(f"""WITH RECURSIVE v AS ({_REQUESTS.format(text="VARCHAR", events="events")}), n AS (SELECT *, row_number() OVER (PARTITION BY document ORDER BY seq, token) AS i FROM v),
    s AS (SELECT DISTINCT document, 0::BIGINT AS i, 'none' AS status, 0::BIGINT AS version, NULL::VARCHAR AS held, []::VARCHAR[] AS applied, NULL::BIGINT AS seq, ''::VARCHAR AS kind, ''::VARCHAR AS outcome, NULL::VARCHAR AS reason FROM v
        UNION ALL SELECT document, i, CASE WHEN outcome = 'applied' THEN to_ ELSE status END, version + CASE WHEN outcome = 'applied' THEN 1 ELSE 0 END, CASE WHEN outcome = 'applied' AND kind = 'bind' THEN trim(content) ELSE held END, CASE WHEN outcome = 'applied' THEN list_append(applied, token) ELSE applied END, seq, kind, outcome, CASE WHEN outcome = 'conflict' THEN why END
        FROM (SELECT *, CASE WHEN again THEN 'repeated' WHEN why IS NULL THEN 'applied' ELSE 'conflict' END AS outcome FROM (
            SELECT n.*, s.status, s.version, s.held, s.applied, list_contains(s.applied, n.token) AS again,
                CASE WHEN n.expected IS NOT NULL AND n.expected <> s.version THEN 'stale_version'
                    WHEN NOT list_contains(CASE n.kind WHEN 'plan' THEN ['none', 'shortage'] WHEN 'generate' THEN ['selected'] WHEN 'bind' THEN ['draft', 'pending_review', 'passed', 'blocked'] WHEN 'report' THEN ['pending_review', 'passed', 'blocked'] ELSE ['passed'] END, s.status) THEN 'wrong_state'
                    WHEN n.kind = 'report' AND n.evidence IS DISTINCT FROM s.held THEN 'evidence_mismatch' WHEN n.kind IN ('generate', 'bind', 'deliver') AND NOT n.progress THEN 'progress_changed'
                    WHEN n.kind = 'bind' AND trim(n.content) = '' THEN 'content_hash_missing' WHEN n.kind = 'deliver' AND NOT n.complete THEN 'usage_incomplete' END AS why,
                CASE n.kind WHEN 'plan' THEN CASE WHEN n.shortage > 0 THEN 'shortage' ELSE 'selected' END WHEN 'generate' THEN 'draft' WHEN 'bind' THEN 'pending_review' WHEN 'report' THEN CASE WHEN n.gates THEN 'passed' ELSE 'blocked' END ELSE 'delivered' END AS to_
            FROM s JOIN n ON n.document = s.document AND n.i = s.i + 1)))
    SELECT document, seq, kind, outcome, reason, status, version, held AS content FROM s WHERE i > 0""")
def delivery_states(spark, sf_dir):
    """A user's ledger as competing requests for one document: what became of each, and the document behind it."""
    requests = spark.sql(_REQUESTS.replace("{text}", "STRING"), events=table(spark, sf_dir, "events"))
    return delivery.fold(requests).select("document", "seq", "kind", "outcome", "reason", "status", "version", "content")


_ITEM = """'{{"c_acct":' || CAST(floor(c_acctbal) AS BIGINT) || ',"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name || '"}}'"""
_SETS = """o AS (SELECT o_custkey AS k, '[' || string_agg('{{"day":"' || strftime(o_orderdate, '%Y-%m-%d') || '","o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}}', ',' ORDER BY o_orderdate::DATE, o_orderkey) || ']' AS j FROM orders GROUP BY ALL),
    n AS (SELECT n_nationkey, '[{{"n_name":"' || n_name || '","region":' || coalesce('"' || r_name || '"', 'null') || '}}]' AS j FROM nation LEFT JOIN region ON r_regionkey = n_regionkey AND r_regionkey > 0),
    p AS (SELECT c.*, coalesce(o.j, '[]') AS oj, n.j AS nj, {item} AS ij, '{{"nations":' || n.j || ',"orders":' || coalesce(o.j, '[]') || ',"question":' || {item} || ',"snapshot_schema":"input-v1"}}' AS payload FROM customer c LEFT JOIN o ON o.k = c_custkey JOIN n ON n.n_nationkey = c.c_nationkey)"""


def _inputs(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    customers, region = t("customer"), t("region").where("r_regionkey > 0").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("region"))
    items = customers.select("c_custkey", "c_name", "c_mktsegment", F.floor("c_acctbal").alias("c_acct"))
    orders = t("orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    nations = t("nation").join(region, "n_regionkey", "left").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "region")
    nations = customers.select("c_custkey", "c_nationkey").join(nations, "c_nationkey").select("c_custkey", "n_name", "region")
    return items, {"orders": (orders, ["day", "o_orderkey"]), "nations": (nations, ["n_name"])}


@query(f"WITH {_SETS.format(item=_ITEM.replace('{{', '{').replace('}}', '}'))} SELECT c_custkey, sha256(payload) AS input_hash, sha256(oj) AS orders_hash, sha256(nj) AS nations_hash, sha256(ij) AS question_hash FROM p".replace("{{", "{").replace("}}", "}"))
def canonical_snapshots(spark, sf_dir):
    """Each customer with orders and nation as one canonical document: its hash, and those of its parts."""
    items, sets = _inputs(spark, sf_dir)
    out = snapshots.snapshot(items, "c_custkey", "question", sets, "input-v1")
    return out.select("c_custkey", "input_hash", *(F.col("set_hashes")[n].alias(f"{n}_hash") for n in ("orders", "nations", "question")))


@query("""WITH RECURSIVE c AS (SELECT c_custkey AS id, c_nationkey AS nation, CASE WHEN c_custkey % 8 = 0 THEN NULL WHEN c_custkey % 41 = 0 THEN -1 WHEN c_custkey % 43 = 0 THEN c_custkey ELSE c_custkey - 1 END AS parent FROM customer),
    t AS (SELECT id FROM c WHERE parent IS NULL OR parent NOT IN (SELECT id FROM c) UNION SELECT c.id FROM t JOIN c ON c.parent = t.id)
    SELECT 'nations' AS "table", CAST(n_nationkey AS VARCHAR) AS key, 'region' AS "column", CAST(n_regionkey AS VARCHAR) AS value, 'orphan' AS problem FROM nation WHERE n_regionkey = 2 AND n_nationkey % 5 <> 4
    UNION ALL SELECT 'customers', CAST(id AS VARCHAR), 'nation', CAST(nation AS VARCHAR), 'orphan' FROM c WHERE nation % 5 = 4
    UNION ALL SELECT 'customers', CAST(id AS VARCHAR), 'parent', CAST(parent AS VARCHAR), 'orphan' FROM c WHERE parent IS NOT NULL AND parent NOT IN (SELECT id FROM c)
    UNION ALL SELECT 'customers', CAST(id AS VARCHAR), 'parent', CAST(parent AS VARCHAR), 'row_cycle' FROM c WHERE id NOT IN (SELECT id FROM t)
    UNION ALL SELECT 'customers', NULL, 'best', NULL, 'table_cycle' UNION ALL SELECT 'orders', NULL, 'customer', NULL, 'table_cycle'""")
def dump_problems(spark, sf_dir):
    """Dumps of a thousand customers each, with their nations and regions, written and loaded again: rows whose parents are missing or that are their own."""
    import uuid

    from ..operators.tables import work_folder
    from ..sources import dump

    path = f"{work_folder(spark)}/attestra-engine/dump-{uuid.uuid4().hex}"
    k = F.col("c_custkey")
    parent = F.when(k % 8 == 0, None).when(k % 41 == 0, F.lit(-1).cast("long")).when(k % 43 == 0, k).otherwise(k - 1)
    customers = table(spark, sf_dir, "customer").select(F.floor(k / 1000).alias("d"), F.struct(k.alias("id"), F.col("c_nationkey").alias("nation"), parent.alias("parent")).alias("x"))
    documents = customers.groupBy("d").agg(F.collect_list("x").alias("customers")).select("customers")
    nations = table(spark, sf_dir, "nation").where("n_nationkey % 5 <> 4").select(F.struct(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("region"), F.col("n_name").alias("name")).alias("x")).agg(F.collect_list("x").alias("nations"))  # 25 rows
    regions = table(spark, sf_dir, "region").where("r_regionkey <> 2").select(F.struct(F.col("r_regionkey").alias("id")).alias("x")).agg(F.collect_list("x").alias("regions"))  # 5 rows
    documents.unionByName(nations, allowMissingColumns=True).unionByName(regions, allowMissingColumns=True).write.json(path)
    tables = {"regions": dump.Table("id long", "id"), "nations": dump.Table("id long, region long, name string", "id", "first"), "customers": dump.Table("id long, nation long, parent long, best long", "id"), "orders": dump.Table("id long, customer long", "id")}
    references = [dump.Reference("nations", "region", "regions"), dump.Reference("customers", "nation", "nations"), dump.Reference("customers", "parent", "customers"), dump.Reference("customers", "best", "orders"), dump.Reference("orders", "customer", "customers")]
    return dump.problems(dump.read_dump(spark, path, tables), tables, references)


@query("""WITH e AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS nx, max(ts) OVER () AS most FROM events)
    SELECT CAST(user_id AS VARCHAR) AS run, count(*) AS stalls, max(ts) AS last, CAST(sum(n) AS BIGINT) AS beats FROM e WHERE nx - ts > INTERVAL 20 HOUR OR (nx IS NULL AND ts + INTERVAL 20 HOUR < most) GROUP BY user_id""")
def stalled_runs(spark, sf_dir):
    """Structured Streaming with timers: users who were silent for longer than twenty hours, how often, and when last."""
    import uuid
    from datetime import timedelta

    from ..streaming.shared import work_folder
    from ..streaming.stalls import record

    base = f"{work_folder(spark)}/stalls-{uuid.uuid4().hex}"
    beats = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*").select(F.col("user_id").alias("run"), F.col("ts").alias("at"), F.lit("alive").alias("event"))
    record(beats, timedelta(hours=20), f"{base}/out", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out").groupBy("run").agg(F.count(F.lit(1)).alias("stalls"), F.max("last").alias("last"), F.sum("beats").alias("beats"))


@query(f"""WITH w AS (SELECT word FROM ({_WORDS}) WHERE length(word) >= 8)
    SELECT conv_id, turn FROM conversations c WHERE conv_id % 3 <> 0 AND (regexp_matches(text, '^[A-Z][a-z]+ of ') OR EXISTS (SELECT 1 FROM w WHERE contains(c.text, word)))""")
def answer_leaks(spark, sf_dir):
    """Turns of students' conversations that hold a long word of the benchmark or begin as answers do."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.when(F.col("conv_id") % 3 == 0, "teacher").otherwise("student").alias("audience"), F.col("turn").alias("index"), "text")
    told = patterns.leaks(turns, _keywords(spark, sf_dir).where(F.length("pattern") >= 8), "conv_id", answer_line="^[A-Z][a-z]+ of ")
    return told.select("conv_id", F.col("index").alias("turn"))


_THEMES = "SELECT n_nationkey AS rule, ws, ws[1] AS theme FROM (SELECT n_nationkey, (SELECT list(word ORDER BY md5(word || n_nationkey)) FROM w WHERE length(word) = 4) AS ws FROM nation)"


@query(f"""WITH w AS ({_WORDS}), r AS ({_THEMES}), g AS (SELECT rule, i % 2 AS g, ws[i + 2] AS word FROM r, (SELECT unnest(range(4)) AS i)),
    d AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '' ELSE split_part(text, ' ', 1) END AS theme, list_transform(range(3), lambda k: split_part(text, ' ', 2 + k)) AS names, doc_id % 3 AS unsure, text FROM documents WHERE text IS NOT NULL),
    a AS (SELECT d.doc_id, r.rule FROM d JOIN r ON (d.theme = '' OR contains(d.theme, r.theme)) WHERE (SELECT count(DISTINCT g) FROM g WHERE g.rule = r.rule AND contains(d.text, word)) = 2),
    m AS (SELECT a.doc_id, a.rule, g.g, string_agg(DISTINCT word, '/' ORDER BY word) AS label FROM a JOIN g USING (rule) JOIN d USING (doc_id) GROUP BY a.doc_id, a.rule, g.g, d.names, d.unsure HAVING NOT bool_or(len(list_filter(list_zip(names, range(3)), lambda x: contains(x[1], word) AND x[2] <> unsure)) > 0))
    SELECT doc_id, rule, string_agg(label, ',' ORDER BY g) AS missing FROM m GROUP BY doc_id, rule""")
def mapping_signals(spark, sf_dir):
    """Documents as mappings: their first word is the theme (of every other one), the next three the knowledge, of which one is not supported. Rules stand for nations, by words in an
    order of their own."""
    own = _keywords(spark, sf_dir).where(F.length("pattern") == 4)
    nations = table(spark, sf_dir, "nation").select("n_nationkey")  # 25 rows
    place = F.row_number().over(Window.partitionBy("n_nationkey").orderBy(F.md5(F.concat("pattern", F.col("n_nationkey").cast("string")))))
    ranked = nations.crossJoin(own).select("n_nationkey", "pattern", place.alias("i")).where("i <= 5")
    part = lambda cond, name, group: ranked.where(cond).select(F.col("n_nationkey").alias("rule"), F.lit(name).alias("part"), group.cast("int").alias("group"), "pattern")
    rules = part("i = 1", "theme", F.lit(0)).unionByName(part("i > 1", "signal", F.col("i") % 2)).unionByName(part("i > 1", "required", F.col("i") % 2))
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    word = lambda k: F.coalesce(F.get(F.split(F.col("text"), " ", -1), k), F.lit(""))
    evidence = docs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("question_id"), F.when(F.col("doc_id") % 2 == 0, "").otherwise(word(0)).alias("core_theme"), F.array(*(F.struct(word(1 + k).alias("name"), (F.col("doc_id") % 3 != k).alias("supported")) for k in range(3))).alias("knowledge"))
    found = patterns.signal_findings(evidence, docs.select(F.col("doc_id").alias("question_id"), "text"), rules)
    # Three findings a rule: that something is missing, the rule, and what.
    each = found.select("id", F.explode(F.sequence(F.lit(0), F.size("findings") - 1, F.lit(3))).alias("k"), "findings")
    told = lambda k, mark: F.replace(F.get("findings", F.col("k") + k), F.lit(mark), F.lit(""))
    return each.select(F.col("id").alias("doc_id"), told(1, "question_signal_rule:").cast("int").alias("rule"), told(2, "question_signal_missing_required:").alias("missing"))
