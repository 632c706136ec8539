"""The registered queries: each engine operator on the driver's tables, and its DuckDB twin.

events stand for a verification log: item = user_id, kind = event_type, seq = event_id, at = ts, and status by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import items as it
from ..functions import text as tx
from ..operators import candidates, gates, integrity, latest, reports, sampling, segment, selection, similarity, snapshots, tables, tree

KINDS = ("click", "error", "purchase", "signup", "view")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def status_of(value: Column) -> Column:
    return F.when(value <= 60, "pass").when(value <= 120, "unsupported").otherwise("fail")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", status_of(F.col("value")).alias("status"))


def joined(c: Column) -> Column:
    return F.array_join(c, ",")


_LOG = "(SELECT event_id, ts, user_id, event_type, value, CASE WHEN value <= 60 THEN 'pass' WHEN value <= 120 THEN 'unsupported' ELSE 'fail' END AS status FROM events)"
_LAST = f"(SELECT * FROM {_LOG} QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1)"
_PLAIN = "trim(regexp_replace(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


# --- gates ---------------------------------------------------------------------------------------------------------------


@query(f"SELECT event_type, status, count(*) AS n FROM {_LAST} GROUP BY ALL")
def latest_verification_state(spark, sf_dir):
    now = latest.latest_per_key(log(spark, sf_dir), ["user_id", "event_type"], ["ts", "event_id"], ["status"])
    return now.groupBy("event_type", "status").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT user_id, count(*) FILTER (status = 'pass') AS n_pass, count(*) FILTER (status <> 'pass') AS n_nonpass, count(*) FILTER (status = 'pass') = 5 AND count(*) FILTER (status <> 'pass') = 0 AS quorum FROM {_LAST} GROUP BY user_id")
def verification_quorum(spark, sf_dir):
    return gates.quorum(log(spark, sf_dir), "user_id", "event_type", "status", KINDS, ["event_id"])


@query("SELECT DISTINCT user_id FROM events o WHERE NOT EXISTS (SELECT 1 FROM " + _LAST + " l WHERE l.user_id = o.user_id AND l.status <> 'pass')")
def no_nonpass_latest(spark, sf_dir):
    now = latest.latest_per_key(log(spark, sf_dir), ["user_id", "event_type"], ["event_id"], ["status"])
    return now.groupBy("user_id").agg(F.bool_and(F.col("status") == "pass").alias("ok")).where("ok").select("user_id")


@query(f"""SELECT user_id, coalesce(string_agg(k, ',' ORDER BY k) FILTER (status IS NULL OR status <> 'pass'), '') AS missing, coalesce(string_agg(k, ',' ORDER BY k) FILTER (status <> 'pass'), '') AS blockers,
    count(*) FILTER (status = 'pass') = 5 AS eligible
    FROM (SELECT u.user_id, k, l.status FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT unnest(['click','error','purchase','signup','view']) AS k) LEFT JOIN {_LAST} l ON l.user_id = u.user_id AND l.event_type = k) GROUP BY user_id""")
def admission_reasons(spark, sf_dir):
    out = gates.admission(log(spark, sf_dir), "user_id", "event_type", "status", KINDS, ["ts", "event_id"])
    return out.select("user_id", joined(F.col("missing")).alias("missing"), joined(F.col("blockers")).alias("blockers"), "eligible")


@query("""WITH d AS (SELECT user_id, event_type, bool_and(value <= 480) AS clean, bool_or(value > 480) AS bad FROM events GROUP BY ALL)
    SELECT u.user_id, coalesce(string_agg(k, ',' ORDER BY k) FILTER (clean IS NULL OR NOT clean), '') AS missing, coalesce(string_agg(k, ',' ORDER BY k) FILTER (bad), '') AS blocking, count(*) FILTER (clean) = 5 AS approved
    FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT unnest(['click','error','purchase','signup','view']) AS k) LEFT JOIN d ON d.user_id = u.user_id AND d.event_type = k GROUP BY u.user_id""")
def review_quorum(spark, sf_dir):
    decision = F.when(F.col("value") <= 480, "approved").when(F.col("value") <= 485, "needs_revision").otherwise("rejected")
    out = gates.review_quorum(table(spark, sf_dir, "events").withColumn("decision", decision), "user_id", "event_type", "decision", KINDS)
    return out.select("user_id", joined(F.col("missing")).alias("missing"), joined(F.col("blocking")).alias("blocking"), "approved")


@query("""SELECT d.doc_id, m.doc_id IS NOT NULL AND k.doc_id IS NOT NULL AND t.doc_id IS NOT NULL AS content_eligible,
    CASE WHEN m.doc_id IS NULL THEN 'mathematical_validation_missing_or_nonpassing' WHEN k.doc_id IS NULL THEN 'validated_primary_knowledge_mapping_missing' WHEN t.doc_id IS NULL THEN 'validated_difficulty_evidence_missing' ELSE 'eligible_for_content_selection_only' END AS reason
    FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) m USING (doc_id) LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE toxic = 0) k USING (doc_id) LEFT JOIN (SELECT DISTINCT doc_id FROM documents WHERE n_chars >= 1000) t USING (doc_id)""")
def eligibility_reason(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "n_chars"), table(spark, sf_dir, "labels")
    return gates.eligibility(docs.select("doc_id"), "doc_id", labels.where("quality = 1"), labels.where("toxic = 0"), docs.where("n_chars >= 1000"))


@query("""SELECT o_orderkey, n_lines FROM (SELECT o_orderkey, 1 + o_orderkey % 7 AS n_lines FROM orders) o JOIN (SELECT l_orderkey, count(*) AS n, bool_and(l_discount <= 0.07) AS good FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey WHERE good AND n = n_lines""")
def universal_quantifier(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", (1 + F.col("o_orderkey") % 7).alias("n_lines"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_discount")
    return gates.all_and_complete(orders, lines, "o_orderkey", F.col("l_discount") <= 0.07, "n_lines")


@query("""SELECT source, CASE WHEN bool_or(o = 'loss') THEN 'suspected_loss' WHEN bool_and(o = 'nc') THEN 'not_comparable' WHEN bool_or(o = 'acc') THEN 'acceptable' WHEN bool_or(o = 'nc') THEN 'not_comparable' ELSE 'equal' END AS outcome
    FROM (SELECT d.source || '/' || (d.doc_id % 50) AS source, CASE WHEN toxic = 1 THEN 'loss' WHEN quality IS NULL THEN 'nc' WHEN quality = 0 THEN 'acc' ELSE 'eq' END AS o FROM documents d LEFT JOIN labels l USING (doc_id)) GROUP BY source""")
def outcome_precedence_fold(spark, sf_dir):
    """Checks of one sample: a loss decides; only if all are not comparable is the sample; an acceptable difference decides over some that are not."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", (F.col("doc_id") % 50).cast("string")).alias("source")).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    outcome = F.when(F.col("toxic") == 1, "suspected_loss").when(F.col("quality").isNull(), "not_comparable").when(F.col("quality") == 0, "acceptable").otherwise("equal")
    return gates.fold_outcomes(rows.withColumn("outcome", outcome), "source", "outcome", "suspected_loss", "acceptable", "not_comparable", "equal")


@query(f"""SELECT u.user_id, k AS event_type, CASE WHEN s IS NULL THEN 'missing' WHEN s = ['pass'] THEN 'pass' WHEN list_contains(s, 'unsupported') THEN 'unsupported' WHEN list_contains(s, 'fail') THEN 'fail' ELSE 'nonpass' END AS verdict, coalesce(len(s), 0) > 1 AS conflicting
    FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT unnest(['click','error','purchase','signup','view']) AS k) LEFT JOIN (SELECT user_id, event_type, list_distinct(list(status)) AS s FROM {_LOG} WHERE value > 40 GROUP BY ALL) x ON x.user_id = u.user_id AND x.event_type = k""")
def status_set_verdicts(spark, sf_dir):
    rows = log(spark, sf_dir).join(table(spark, sf_dir, "events").where("value > 40").select("event_id"), "event_id", "left_semi")
    everyone = log(spark, sf_dir).select("user_id").distinct()
    told = gates.status_sets(rows.select("user_id", "event_type", "status"), "user_id", "event_type", "status", KINDS)
    return everyone.withColumn("event_type", F.explode(F.array(*(F.lit(k) for k in KINDS)))).join(told, ["user_id", "event_type"], "left").select("user_id", "event_type", F.coalesce("verdict", F.lit("missing")).alias("verdict"), F.coalesce("conflicting", F.lit(False)).alias("conflicting"))


# --- selection -----------------------------------------------------------------------------------------------------------


@query("""WITH l AS (SELECT user_id, event_type, value <= 100 AS good FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1),
    ok AS (SELECT user_id FROM l GROUP BY 1 HAVING count(*) = 5 AND bool_and(good)),
    c AS (SELECT c_custkey, c_acctbal, audience FROM customer JOIN nation ON c_nationkey = n_nationkey CROSS JOIN (SELECT DISTINCT o_orderpriority AS audience FROM orders) WHERE n_regionkey IN (0, 1, 2) AND c_acctbal >= 0 AND c_custkey IN (SELECT user_id FROM ok)),
    f AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM orders u WHERE u.o_custkey = c_custkey AND u.o_orderpriority = audience AND u.o_orderstatus = 'F' AND NOT EXISTS (SELECT 1 FROM orders a WHERE a.o_custkey = u.o_custkey AND a.o_orderpriority = audience AND a.o_orderstatus = 'P')))
    SELECT audience, c_custkey, position FROM (SELECT *, row_number() OVER (PARTITION BY audience ORDER BY c_acctbal, c_custkey) AS position FROM f) WHERE position <= 25""")
def select_with_history(spark, sf_dir):
    """Flagship: per class, items of allowed nodes whose latest checks pass in all five kinds and that this class was not given before, unless
    an authorisation lets it have them again."""
    checks = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.when(F.col("value") <= 100, "pass").otherwise("fail").alias("status"))
    verified = gates.quorum(checks, "user_id", "event_type", "status", KINDS, ["event_id"]).where("quorum")
    nodes = table(spark, sf_dir, "nation").where(F.col("n_regionkey").isin(0, 1, 2))
    items = selection.matching(table(spark, sf_dir, "customer"), [F.col("c_acctbal") >= 0]).join(nodes, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").join(verified, F.col("c_custkey") == F.col("user_id"), "left_semi")
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("audience"), "o_orderstatus")
    classes = orders.select("audience").distinct()  # a few classes
    free = selection.not_delivered(items.crossJoin(F.broadcast(classes)), orders.where("o_orderstatus = 'F'"), orders.where("o_orderstatus = 'P'"), "c_custkey", "audience")
    place = F.row_number().over(Window.partitionBy("audience").orderBy("c_acctbal", "c_custkey")).cast("long")
    return free.withColumn("position", place).where("position <= 25").select("audience", "c_custkey", "position")


@query("""SELECT b.seg AS seg, b.prio AS prio, wanted, coalesce(found, 0) AS found, greatest(wanted - coalesce(found, 0), 0) AS shortage, CASE WHEN coalesce(found, 0) >= wanted THEN 'ready' ELSE 'blocked' END AS status
    FROM (SELECT DISTINCT c_mktsegment AS seg, o_orderpriority AS prio, 40 * length(c_mktsegment) AS wanted FROM customer CROSS JOIN (SELECT DISTINCT o_orderpriority FROM orders)) b
    LEFT JOIN (SELECT c_mktsegment AS seg, o_orderpriority AS prio, count(*) AS found FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 200000 GROUP BY ALL) s ON b.seg = s.seg AND b.prio = s.prio""")
def selection_shortage(spark, sf_dir):
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    segments, prios = customer.select(F.col("c_mktsegment").alias("seg")).distinct(), orders.select(F.col("o_orderpriority").alias("prio")).distinct()
    demand = segments.crossJoin(F.broadcast(prios)).withColumn("wanted", (40 * F.length("seg")).cast("long"))  # five by five buckets
    supply = orders.where("o_totalprice > 200000").join(customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("seg"), F.col("o_orderpriority").alias("prio"))
    return selection.shortage(demand, supply, ["seg", "prio"], "wanted")


@query("""SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders u WHERE u.o_custkey = c_custkey AND u.o_orderstatus = 'O' AND NOT EXISTS (SELECT 1 FROM orders a WHERE a.o_custkey = u.o_custkey AND a.o_orderpriority = u.o_orderpriority AND a.o_orderstatus = 'P'))""")
def nested_anti_reuse(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority")
    open_ = orders.where("o_orderstatus = 'O'").join(orders.where("o_orderstatus = 'P'"), ["o_custkey", "o_orderpriority"], "left_anti")
    return table(spark, sf_dir, "customer").join(open_, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT p_partkey, p_name, coalesce(n, 0) AS used_count FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey ORDER BY used_count, p_partkey LIMIT 50")
def least_used_first(spark, sf_dir):
    used = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"))
    return selection.least_used(table(spark, sf_dir, "part").select("p_partkey", "p_name"), used, "p_partkey", 50)


@query("""WITH b AS (SELECT o_orderkey AS d, k AS item FROM orders, (SELECT unnest([1, 2, 3]) AS k)), u AS (SELECT l_orderkey AS d, l_linenumber AS item, count(*) AS n FROM lineitem GROUP BY ALL),
    j AS (SELECT coalesce(b.d, u.d) AS d, b.item AS bi, n FROM b FULL JOIN u ON b.d = u.d AND b.item = u.item)
    SELECT d AS doc, count(*) FILTER (n IS NULL) AS n_missing, count(*) FILTER (bi IS NULL) AS n_extra, count(*) FILTER (n > 1) AS n_duplicate, count(*) FILTER (n IS NULL OR bi IS NULL OR n > 1) = 0 AS complete FROM j WHERE d IN (SELECT o_orderkey FROM orders) GROUP BY d""")
def usage_completeness(spark, sf_dir):
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"))
    bound = docs.withColumn("item", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    used = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("item"))
    return selection.usage_completeness(docs, bound, used, "doc", "item")


# --- joins ---------------------------------------------------------------------------------------------------------------


@query("SELECT user_id, event_id, event_type FROM events JOIN (SELECT user_id, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY 1) USING (user_id, event_id)")
def current_head_view(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    heads = latest.latest_per_key(events.where("event_type = 'view'").withColumn("head", F.col("event_id")), ["user_id"], ["event_id"], ["event_id"])
    return latest.current(events, heads, ["user_id"], "event_id").select("user_id", "event_id", "event_type")


@query("SELECT e.event_id FROM (SELECT user_id, event_id, event_id AS s, event_id + CAST(floor(value) AS BIGINT) AS t FROM events WHERE event_type = 'click') e WHERE NOT EXISTS (SELECT 1 FROM (SELECT user_id, event_id AS s, event_id + 100 AS t FROM events WHERE event_type = 'error') x WHERE x.user_id = e.user_id AND x.s < e.t AND x.t > e.s)")
def interval_overlap_anti(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    spans = e.where("event_type = 'click'").select("user_id", "event_id", F.col("event_id").alias("start"), (F.col("event_id") + F.floor("value")).alias("end"))
    shown = e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("start"), (F.col("event_id") + 100).alias("end"))
    return segment.overlapping_removed(spans, shown, ["user_id"]).select("event_id")


@query("""SELECT status, count(*) AS n FROM (SELECT CASE WHEN o_orderkey IS NULL THEN 'unsupported' WHEN c_custkey IS NULL THEN 'unsupported' WHEN o_orderstatus = 'F' THEN 'fail' WHEN s_suppkey IS NULL OR p_partkey IS NULL THEN 'unsupported' WHEN cn.n_regionkey <> sn.n_regionkey THEN 'fail' WHEN r_name IS NULL THEN 'unsupported' ELSE 'pass' END AS status
    FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation cn ON c_nationkey = cn.n_nationkey LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation sn ON s_nationkey = sn.n_nationkey LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN region ON cn.n_regionkey = r_regionkey) GROUP BY status""")
def left_chain_scope(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    nation = t("nation")
    cn, sn = nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("cr")), nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("sr"))
    chain = t("lineitem").select("l_orderkey", "l_suppkey", "l_partkey").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"), "left").join(cn, "c_nationkey", "left")
    chain = chain.join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "left").join(sn, "s_nationkey", "left").join(t("part"), F.col("l_partkey") == F.col("p_partkey"), "left").join(t("region"), F.col("cr") == F.col("r_regionkey"), "left")
    u = F.lit("unsupported")
    status = F.when(F.col("o_orderkey").isNull(), u).when(F.col("c_custkey").isNull(), u).when(F.col("o_orderstatus") == "F", "fail").when(F.col("s_suppkey").isNull() | F.col("p_partkey").isNull(), u).when(F.col("cr") != F.col("sr"), "fail").when(F.col("r_name").isNull(), u).otherwise("pass")
    return chain.select(status.alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT d.doc_id, coalesce(CASE WHEN l.quality = 1 THEN 'label' END, CASE WHEN b.t IS NOT NULL THEN 'benchmark' END, nullif(trim(d.lang), ''), 'none') AS origin FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN (SELECT DISTINCT text AS t FROM benchmark) b ON b.t = d.text")
def coalesced_lookup(spark, sf_dir):
    d, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").select(F.col("text").alias("t")).distinct()
    out = d.join(table(spark, sf_dir, "labels"), "doc_id", "left").join(bench, d["text"] == F.col("t"), "left")
    return out.select("doc_id", F.coalesce(F.when(F.col("quality") == 1, "label"), F.when(F.col("t").isNotNull(), "benchmark"), F.nullif(F.trim("lang"), F.lit("")), F.lit("none")).alias("origin"))


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM orders o WHERE o_orderkey = (SELECT i.o_orderkey FROM orders i WHERE i.o_custkey = o.o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1)")
def latest_correlated_top1(spark, sf_dir):
    return latest.latest_per_key(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderstatus"])


@query("SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_array_length(json_keys(props)) = 1 AND CAST(json_extract_string(props, '$.k') AS BIGINT) BETWEEN 0 AND 49 AS complete FROM events")
def json_bundle_audit(spark, sf_dir):
    bundle = F.from_json("props", "map<string,string>")
    k = F.try_element_at(F.col("b"), F.lit("k")).cast("long")
    e = table(spark, sf_dir, "events").select("event_id", "user_id", bundle.alias("b"))
    return e.select("event_id", "user_id", k.alias("k"), ((F.size("b") == 1) & F.forall(F.array(F.lit("k")), lambda x: F.map_contains_key("b", x)) & k.between(0, 49)).alias("complete"))


# --- aggregation and reports ---------------------------------------------------------------------------------------------


@query("SELECT coalesce(lang, '') AS lang, count(*) AS n, count(DISTINCT source) AS n_sources, count(l.doc_id) AS n_labelled, sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS n_toxic, sum(n_chars) AS chars FROM documents d LEFT JOIN labels l USING (doc_id) WHERE lang IS NOT NULL AND lang <> '' GROUP BY 1")
def grouped_stats(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("lang IS NOT NULL AND lang <> ''").select("doc_id", "lang", "source", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("n_sources"), F.count("quality").alias("n_labelled"), F.count_if(F.col("toxic") == 1).alias("n_toxic"), F.sum("n_chars").alias("chars"))


@query("""WITH r AS (SELECT lang, source, CASE WHEN quality IS NULL THEN 'unsupported' WHEN quality = 1 THEN 'pass' ELSE 'fail' END AS v FROM documents LEFT JOIN labels USING (doc_id))
    SELECT CASE grouping(lang, source) WHEN 1 THEN 'lang' WHEN 2 THEN 'source' ELSE 'all' END AS dimension, CASE grouping(lang, source) WHEN 1 THEN lang WHEN 2 THEN source ELSE '' END AS value, count(*) AS total,
    count(*) FILTER (v = 'pass') AS n_pass, count(*) FILTER (v = 'fail') AS n_fail, count(*) FILTER (v = 'unsupported') AS n_unsupported FROM r GROUP BY GROUPING SETS ((lang), (source), ())""")
def coverage_report(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    verdict = F.when(F.col("quality").isNull(), "unsupported").when(F.col("quality") == 1, "pass").otherwise("fail")
    return reports.coverage(rows.withColumn("v", verdict), ["lang", "source"], "v")


@query("""SELECT s_nationkey, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_orderkey END) AS n_returned, count(DISTINCT p_brand) AS n_brands, max(CASE WHEN contains(p_name, 'ring') THEN 1 ELSE 0 END) AS has_ring
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1 HAVING count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_orderkey END) > 0""")
def conditional_distinct_counts(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag")
    met = lines.join(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    out = met.groupBy("s_nationkey").agg(F.count_distinct(F.when(F.col("l_returnflag") == "R", F.col("l_orderkey"))).alias("n_returned"), F.count_distinct("p_brand").alias("n_brands"), F.max(F.when(F.contains("p_name", F.lit("ring")), 1).otherwise(0)).alias("has_ring"))
    return out.where("n_returned > 0")


@query("SELECT l_orderkey, md5(string_agg(CAST(l_linenumber AS VARCHAR) || ':' || CAST(l_partkey AS VARCHAR), '|' ORDER BY l_linenumber, l_partkey)) AS fingerprint, count(*) AS n FROM lineitem GROUP BY 1")
def ordered_fingerprint(spark, sf_dir):
    pair = F.struct("l_linenumber", "l_partkey")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(pair)), lambda s: F.concat_ws(":", s["l_linenumber"].cast("string"), s["l_partkey"].cast("string"))), "|")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.md5(text).alias("fingerprint"), F.count(F.lit(1)).alias("n"))


@query("""SELECT * FROM (SELECT 'toxic_labels' AS blocker, count(*) AS n FROM labels WHERE toxic = 1 UNION ALL SELECT 'short_documents', count(*) FROM documents WHERE n_chars < 50 UNION ALL SELECT 'negative_balance', count(*) FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'no_region', count(*) FROM nation WHERE n_regionkey IS NULL) WHERE n > 0""")
def readiness_blockers(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    return reports.blockers([("toxic_labels", t("labels"), "toxic = 1"), ("short_documents", t("documents"), "n_chars < 50"), ("negative_balance", t("customer"), "c_acctbal < 0"), ("no_region", t("nation"), "n_regionkey IS NULL")])


# --- text ----------------------------------------------------------------------------------------------------------------


@query("SELECT sha256(text) AS content_hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark, sf_dir):
    return similarity.exact_groups(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")


@query(f"SELECT doc_id, {_PLAIN.format('text')} AS plain FROM documents")
def text_normalise(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.plain(F.col("text")).alias("plain"))


_GRAMS = "list_distinct(CASE WHEN length({0}) = 0 THEN [] WHEN length({0}) < 3 THEN [{0}] ELSE list_transform(range(1, length({0}) - 1), lambda i: substr({0}, i, 3)) END)"


@query(f"WITH t AS (SELECT item_id, replace({_PLAIN.format('text')}, ' ', '') AS s FROM benchmark), g AS (SELECT item_id, list_sort({_GRAMS.format('s')}) AS grams FROM t) SELECT item_id, len(grams) AS n_grams, sha1(array_to_string(grams, '|')) AS fingerprint FROM g")
def trigram_profile(spark, sf_dir):
    s = F.replace(tx.plain(F.col("text")), F.lit(" "), F.lit(""))
    t = table(spark, sf_dir, "benchmark").select("item_id", s.alias("s"))
    return t.select("item_id", F.size(tx.char_ngrams(F.col("s"), 3)).cast("long").alias("n_grams"), tx.fingerprint(F.col("s")).alias("fingerprint"))


_SCORE = "round(greatest(CASE WHEN len(wa) + len(wb) = 0 THEN 0 ELSE len(list_intersect(wa, wb)) / (len(wa) + len(wb) - len(list_intersect(wa, wb))) END, CASE WHEN len(ga) + len(gb) = 0 THEN 0 ELSE len(list_intersect(ga, gb)) / (len(ga) + len(gb) - len(list_intersect(ga, gb))) END), 4)"


@query(f"""WITH t AS (SELECT p_partkey, {_PLAIN.format("p_name || ' ' || p_type")} AS s FROM part), c AS (SELECT s, min(p_partkey) AS first FROM t GROUP BY s),
    u AS (SELECT *, list_distinct(list_filter(string_split(s, ' '), lambda x: x <> '')) AS w, {_GRAMS.format("replace(s, ' ', '')")} AS g FROM c),
    p AS (SELECT a.first AS part_a, b.first AS part_b, a.w AS wa, b.w AS wb, a.g AS ga, b.g AS gb FROM u a JOIN u b ON a.first < b.first)
    SELECT first AS part_a, p_partkey AS part_b, 'exact_duplicate' AS decision, CAST(1.0 AS DOUBLE) AS score FROM t JOIN c USING (s) WHERE p_partkey <> first
    UNION ALL SELECT part_a, part_b, 'suspected_same_family', CAST({_SCORE} AS DOUBLE) FROM p WHERE {_SCORE} >= 0.74""")
def near_duplicate_families(spark, sf_dir):
    """Over all parts: each copy of a text with the first part that has it, and the pairs of such first parts whose texts are of one family. A
    part's text stands for both file and stem, so the higher threshold decides."""
    parts = table(spark, sf_dir, "part").select("p_partkey", tx.plain(F.concat_ws(" ", "p_name", "p_type")).alias("s"))
    firsts = parts.groupBy("s").agg(F.min("p_partkey").alias("first"))
    copies = parts.join(firsts, "s").where("p_partkey <> first").select(F.col("first").alias("part_a"), F.col("p_partkey").alias("part_b"), F.lit("exact_duplicate").alias("decision"), F.lit(1.0).alias("score"))
    family = similarity.similar_pairs(firsts, "first", "s", similarity.STEM_SCORE)
    return copies.unionByName(family.select(F.col("a").alias("part_a"), F.col("b").alias("part_b"), F.lit("suspected_same_family").alias("decision"), "score"))


_KEYWORDS = "list_distinct(list_concat(list_concat(list_transform(range(1, length({0}) - 2), lambda i: substr({0}, i, 4)), list_transform(range(1, length({0}) - 1), lambda i: substr({0}, i, 3))), list_transform(range(1, length({0})), lambda i: substr({0}, i, 2))))"


@query(f"""WITH i AS (SELECT DISTINCT p_name || ' ' || p_type AS s, regexp_replace(p_name || ' ' || p_type, '[^A-Za-z]', '', 'g') AS c FROM part), n AS (SELECT DISTINCT p_name AS node, regexp_replace(p_name, '[^A-Za-z]', '', 'g') AS d FROM part),
    k AS (SELECT *, {_KEYWORDS.format('c')} AS g FROM i), m AS (SELECT *, {_KEYWORDS.format('d')} AS h FROM n),
    x AS (SELECT s, node, length(node) >= 2 AND contains(replace(s, ' ', ''), replace(node, ' ', '')) AS whole, len(list_filter(g, lambda y: contains(node, y))) / len(g) AS p, len(list_filter(h, lambda y: contains(s, y))) / len(h) AS r FROM k CROSS JOIN m),
    z AS (SELECT s, node, round(CASE WHEN whole THEN 1.0 WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 4) AS score FROM x), o AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY score DESC, node) AS rank FROM z)
    SELECT p_partkey, node, score, rank FROM part JOIN o ON s = p_name || ' ' || p_type WHERE rank <= 3 AND score >= 0.35""")
def topk_classify(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    items = part.select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("stem"))
    nodes = part.select(F.col("p_name").alias("node"), F.col("p_name").alias("name")).distinct()
    return similarity.classify(items, nodes, "p_partkey", "stem", "node", "name", alphabet="A-Za-z")


@query("""WITH a AS (SELECT item_id, unnest(list_distinct(list_filter(string_split(text, ' '), lambda w: length(w) >= 4))) AS anchor FROM benchmark), d AS (SELECT doc_id, unnest(list_distinct(string_split(text, ' '))) AS w FROM documents WHERE text IS NOT NULL),
    m AS (SELECT doc_id, item_id, max(length(anchor)) AS longest FROM d JOIN a ON w = anchor GROUP BY ALL), c AS (SELECT *, least(1.0, longest / 5) AS c, item_id % 2 = 0 AS inside FROM m WHERE least(1.0, longest / 5) >= 0.75),
    k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, inside ORDER BY c DESC, item_id) AS r FROM c),
    b AS (SELECT doc_id, max(CASE WHEN inside AND r = 1 THEN c END) AS one, max(CASE WHEN inside AND r = 2 THEN c END) AS two, max(CASE WHEN inside AND r = 1 THEN item_id END) AS node, bool_or(NOT inside) AS outside FROM k GROUP BY 1),
    f AS (SELECT *, CASE WHEN one IS NULL THEN CASE WHEN outside THEN 'candidate_node_outside_allowed_progress' ELSE 'no_complete_evidence_chain' END WHEN one - coalesce(two, 0) < 0.15 THEN 'ambiguous_top_candidate' WHEN outside THEN 'candidate_node_outside_allowed_progress' ELSE 'unique_evidence_chain' END AS reason FROM b)
    SELECT doc_id, CASE WHEN reason = 'unique_evidence_chain' THEN 'candidate' ELSE 'rejected' END AS status, reason, CASE WHEN reason = 'unique_evidence_chain' THEN node END AS item_id FROM f""")
def anchor_scope_decision(spark, sf_dir):
    anchors = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array_distinct(F.filter(F.split("text", " "), lambda w: F.length(w) >= 4))).alias("w"))
    words = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.explode(F.array_distinct(F.split("text", " "))).alias("w"))
    anchors = similarity.deciding_anchors(anchors, "w", "item_id", F.col("item_id") % 2 == 0)
    found = words.join(anchors, "w").groupBy("doc_id", "item_id").agg(F.max(F.length("w")).alias("longest"))
    return similarity.scope_decision(found, "doc_id", "item_id", "longest", F.col("item_id") % 2 == 0)


@query("SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def containment_leak(spark, sf_dir):
    passages = table(spark, sf_dir, "benchmark").withColumnRenamed("text", "passage")
    return similarity.contained(table(spark, sf_dir, "documents").select("doc_id", "text"), passages, "doc_id", "text", "item_id", "passage")


@query("""WITH m AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS segment FROM conversations)
    SELECT conv_id, CAST(segment AS BIGINT) AS segment, min(turn) AS first, max(turn) AS last, count(*) AS n_blocks, md5(string_agg(text, chr(10) ORDER BY turn)) AS body FROM m GROUP BY conv_id, segment""")
def segment_blocks(spark, sf_dir):
    out = segment.segments(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("role") == "user", "text")
    return out.withColumn("body", F.md5("body"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, CAST(generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS INTEGER) AS line FROM documents),
    k AS (SELECT *, CASE WHEN contains(raw, ' | ') THEN 'table' WHEN regexp_matches(raw, '[0-9]{3}') THEN 'item' WHEN trim(raw) = '' THEN 'blank' ELSE 'text' END AS kind FROM l),
    i AS (SELECT *, sum(CASE WHEN kind = 'item' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS item, CASE WHEN kind = 'item' THEN regexp_extract(raw, '([0-9]{3})', 1) END AS number FROM k),
    a AS (SELECT *, CASE WHEN kind = 'item' THEN row_number() OVER (PARTITION BY doc_id, number ORDER BY line) > 1 END AS again FROM i),
    b AS (SELECT *, last_value(again IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bad FROM a)
    SELECT kind, CASE WHEN item = 0 THEN 'header' WHEN bad THEN 'quarantined' ELSE 'live' END AS status, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM b GROUP BY ALL""")
def line_state_machine(spark, sf_dir):
    lines = segment.lines_of(table(spark, sf_dir, "documents"), "doc_id", "text")
    out = segment.line_states(lines, "doc_id", [("table", r" \| "), ("item", "[0-9]{3}")], "item", "([0-9]{3})")
    return out.groupBy("kind", "status").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_docs"))


@query("SELECT page_id, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html[^>]*lang=\"([a-z]+)\"', 1) AS lang, len(regexp_extract_all(html, '<a href=')) AS n_links FROM pages")
def structure_extract(spark, sf_dir):
    x = F.regexp_extract
    n = F.size(F.regexp_extract_all("html", F.lit("<a href="), F.lit(0))).cast("long")
    return table(spark, sf_dir, "pages").select("page_id", x("url", "^https?://([^/:?#]+)", 1).alias("host"), x("html", "<title>([^<]*)</title>", 1).alias("title"), x("html", '<html[^>]*lang="([a-z]+)"', 1).alias("lang"), n.alias("n_links"))


_ANSWER = "CASE l_linenumber % 7 WHEN 0 THEN '' WHEN 1 THEN chr(65 + l_linenumber % 4) WHEN 2 THEN CAST(l_partkey AS VARCHAR) WHEN 3 THEN CAST(l_partkey AS VARCHAR) || '/' || CAST(l_suppkey + 1 AS VARCHAR) WHEN 4 THEN CAST(l_suppkey AS VARCHAR) || ' cm' WHEN 5 THEN 'x=' || CAST(l_suppkey AS VARCHAR) ELSE l_returnflag || l_linestatus END"


@query(f"""SELECT form, count(*) AS n FROM (SELECT CASE WHEN t = '' THEN 'missing' WHEN regexp_full_match(t, '[A-D]') THEN 'choice_letter' WHEN regexp_full_match(t, '[A-Z]{{2,6}}') THEN 'letter_abbrev' WHEN regexp_full_match(t, '-?\\d+(\\.\\d+)?') THEN 'pure_number' WHEN regexp_full_match(t, '-?\\d+/\\d+') THEN 'fraction'
    WHEN regexp_full_match(t, '-?\\d+(\\.\\d+)?\\s*[A-Za-z%°]+') THEN 'number_with_unit' WHEN length(t) > 40 THEN 'long_solution' WHEN regexp_matches(t, '[=+*/^]') THEN 'expression_multi' ELSE 'short_text' END AS form FROM (SELECT trim({_ANSWER}) AS t FROM lineitem)) GROUP BY form""")
def answer_form_classes(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(tx.answer_form(F.expr(_ANSWER.replace("VARCHAR", "STRING"))).alias("form")).groupBy("form").agg(F.count(F.lit(1)).alias("n"))


#: Pairs of answers by line: with units, fractions, percentages, radicals, alternatives, choices, count words and forms that cannot be told.
_PAIRS = (
    ("concat(l_partkey, '%')", "concat(l_suppkey, '/100')"), ("concat(l_partkey, '厘米')", "concat(l_suppkey, ' cm。')"), ("concat(l_partkey, '或', l_suppkey)", "concat(l_suppkey, '；', l_partkey + l_linenumber % 2)"), ("'A'", "'b'"),
    ("concat('x+', l_partkey)", "concat(l_partkey, '+x')"), ("concat(l_partkey, 'cm')", "concat(l_partkey, 'm')"), ("concat('√', l_suppkey * l_suppkey)", "concat('', l_suppkey + l_linenumber % 2)"), ("concat(l_partkey, '.0或2')", "concat(l_partkey, '或2')"),
    ("'ABC'", "'CBA'"), ("concat(l_partkey, '条')", "concat('', l_partkey + l_linenumber % 3)"), ("concat('2√(', l_suppkey, ')')", "concat('√', 4 * l_suppkey)"), ("concat(l_partkey, '个')", "concat(l_partkey, ' km')"),
    ("concat('３', l_suppkey, '度')", "concat('3', l_suppkey, '°')"), ("'F'", "concat('', l_partkey)"), ("concat(l_partkey, '×', l_suppkey)", "concat(l_partkey, 'x', l_suppkey, '。')"), ("''", "concat('', l_partkey)"),
)
_LEFT, _RIGHT = (f"CASE (l_partkey + l_linenumber) % {len(_PAIRS)} " + " ".join(f"WHEN {k} THEN {pair[i]}" for k, pair in enumerate(_PAIRS)) + " END" for i in (0, 1))


def _equivalent_sql() -> str:
    def norm(x: str) -> str:
        out = f"replace({x}, '３', '3')"
        out = f"replace({out}, '；', ';')"
        for word, sign in tx.UNITS:
            out = f"replace({out}, '{word}', '{sign}')"
        return f"rtrim(regexp_replace({out}, '\\s+', '', 'g'), '{tx.LAST}')"

    num = lambda x: f"coalesce(TRY_CAST(nullif(regexp_extract({x}, '^([+-]?(?:\\d+\\.?\\d*|\\.\\d+))$', 1), '') AS DOUBLE), TRY_CAST(nullif(regexp_extract({x}, '^([+-]?\\d+)/([+-]?\\d+)$', 1), '') AS DOUBLE) / TRY_CAST(nullif(regexp_extract({x}, '^([+-]?\\d+)/([+-]?\\d+)$', 2), '') AS DOUBLE), TRY_CAST(nullif(regexp_extract({x}, '^([+-]?\\d+)%$', 1), '') AS DOUBLE) / 100, coalesce(TRY_CAST(nullif(regexp_extract({x}, '^(\\d*)√', 1), '') AS DOUBLE), 1) * sqrt(TRY_CAST(nullif(regexp_extract({x}, '^\\d*√\\(?(\\d+)\\)?$', 1), '') AS DOUBLE)))"
    unit = lambda x: f"nullif(regexp_extract({x}, '^[+-]?\\d+(?:\\.\\d+)?([A-Za-z°%]+|[{tx.CJK_UNITS}]{{1,3}}|[一-鿿]{{1,2}})$', 1), '')"
    value = lambda x: f"TRY_CAST(nullif(regexp_extract({x}, '^([+-]?\\d+(?:\\.\\d+)?)(?:[A-Za-z°%]+|[一-鿿]{{1,3}})$', 1), '') AS DOUBLE)"
    parts = lambda x: f"list_filter(string_split(regexp_replace({x}, '或|；|;|,|，|、|和', '|', 'g'), '|'), lambda p: p <> '')"
    close = lambda a, b: f"abs({a} - {b}) <= greatest(1e-9 * greatest(abs({a}), abs({b})), 1e-9)"
    counts = lambda u: f"coalesce(contains('{tx.COUNTERS}', {u}) AND length({u}) = 1, false)"
    return f"""WITH a AS (SELECT l_orderkey, l_linenumber, {norm(_LEFT)} AS l, {norm(_RIGHT)} AS r FROM lineitem),
        b AS (SELECT *, {num('l')} AS nl, {num('r')} AS nr, {unit('l')} AS ul, {unit('r')} AS ur, {value('l')} AS vl, {value('r')} AS vr, {parts('l')} AS pl, {parts('r')} AS pr FROM a)
        SELECT l_orderkey, l_linenumber, CASE WHEN l = '' OR r = '' THEN NULL WHEN l = r THEN true WHEN regexp_full_match(l, '[A-Fa-f]') AND regexp_full_match(r, '[A-Fa-f]') THEN upper(l) = upper(r)
            WHEN len(pl) >= 2 AND len(pl) = len(pr) AND list_sort(list_distinct(pl)) = list_sort(list_distinct(pr)) THEN true WHEN nl IS NOT NULL AND nr IS NOT NULL THEN {close('nl', 'nr')}
            WHEN ul IS NOT NULL AND ur IS NOT NULL AND (ul = ur OR {counts('ul')} OR {counts('ur')}) THEN {close('vl', 'vr')} WHEN ul IS NULL AND nl IS NOT NULL AND {counts('ur')} THEN {close('nl', 'vr')} WHEN ur IS NULL AND nr IS NOT NULL AND {counts('ul')} THEN {close('nr', 'vl')} END AS same FROM b"""


@query(_equivalent_sql())
def answer_equivalence(spark, sf_dir):
    pairs = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr(_LEFT).alias("a"), F.expr(_RIGHT).alias("b"))
    return pairs.select("l_orderkey", "l_linenumber", tx.equivalent(F.col("a"), F.col("b")).alias("same"))


# --- item texts, candidates ----------------------------------------------------------------------------------------------


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_name || chr(10) || 'A. ' || p_brand ELSE p_name END AS stem, CASE WHEN p_size % 3 = 0 THEN '' ELSE 'A. ' || p_brand || '|B. ' || p_type END AS options, CASE WHEN p_size % 3 <> 0 THEN '选择题' WHEN contains(p_name, '____') THEN '填空题' ELSE '待分类' END AS kind FROM part""")
def option_split(spark, sf_dir):
    stem = F.when(F.col("p_size") % 3 == 0, F.concat("p_name", F.lit("\n A. "), "p_brand")).otherwise(F.concat("p_name", F.lit("\n\n A. "), "p_brand", F.lit("\tB、"), "p_type", F.lit(" ")))
    out = table(spark, sf_dir, "part").select("p_partkey", "p_name", it.split_options(stem).alias("x"))
    return out.select("p_partkey", "x.stem", joined(F.col("x.options")).alias("options"), it.question_type(F.col("x.stem"), F.col("x.options")).alias("kind")).withColumn("options", F.regexp_replace("options", ",B", "|B"))


@query("SELECT doc_id, (length(text) - length(replace(text, 'the', ''))) // 3 AS n, CASE WHEN contains(text, 'the') THEN strpos(text, 'the') - 1 END AS first FROM documents WHERE text IS NOT NULL")
def fragment_occurrences(spark, sf_dir):
    """Non-overlapping places of a fragment in every text."""
    at = it.occurrences(F.col("text"), F.lit("the"))
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", at.alias("at")).select("doc_id", F.size("at").cast("long").alias("n"), F.get("at", F.lit(0)).cast("long").alias("first"))


@query("SELECT l_orderkey, l_linenumber, sha256(l_partkey || chr(0) || l_suppkey || chr(0) || '' || chr(0) || l_returnflag) AS id, lower(substr(upper(sha256(l_partkey || chr(0) || l_suppkey || chr(0) || '' || chr(0) || l_returnflag)), 1, 12)) AS prefix FROM lineitem")
def composite_ids(spark, sf_dir):
    out = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", it.composite_id(F.col("l_partkey"), F.col("l_suppkey"), F.lit(None), F.col("l_returnflag")).alias("id"))
    return out.withColumn("prefix", it.hash_prefix(F.upper("id")))


@query("""SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderstatus = 'F' THEN 'missing stem' END, CASE WHEN o_totalprice < 50000 THEN 'missing answer' END, CASE WHEN o_orderkey % 30 > 20 THEN 'outside first objective-question batch' END) AS reasons FROM orders""")
def candidate_reasons(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    fields = {"stem": F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority")), "answer": F.when(F.col("o_totalprice") < 50000, " ").otherwise("x")}
    return o.select("o_orderkey", joined(candidates.review_reasons(fields, F.col("o_orderkey") % 30)).alias("reasons"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity % 2 = 0 THEN 'choice_options:false' WHEN l_returnflag = 'N' THEN 'choice_answer_matches_option:false' ELSE 'choice_answer_matches_option:true' END AS finding FROM lineitem WHERE l_linenumber % 2 = 1
    UNION ALL SELECT l_orderkey, l_linenumber, 'non_choice_options:' || (CASE WHEN l_quantity % 2 = 0 THEN 'true' ELSE 'false' END) FROM lineitem WHERE l_linenumber % 2 = 0""")
def consistency_findings(spark, sf_dir):
    """Choices have options A and R; every answer is the return flag, A, N or R."""
    even = F.col("l_quantity") % 2 == 0
    choice = F.col("l_linenumber") % 2 == 1
    options = F.when(even & choice, F.array(F.lit("A. one"))).when(even, F.array().cast("array<string>")).otherwise(F.array(F.lit("A. one"), F.lit(" B、two")))
    flag = F.when(F.col("l_returnflag") == "R", "B").otherwise(F.col("l_returnflag"))
    found = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.element_at(candidates.consistency(F.when(choice, "选择题").otherwise("填空题"), options, flag), 2).alias("f"))
    return found.select("l_orderkey", "l_linenumber", F.concat_ws(":", "f.check", F.col("f.passed").cast("string")).alias("finding"))


@query("SELECT o_orderkey, 'no_current_customer' AS reason FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0) UNION ALL SELECT o_orderkey, 'no_line' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def insert_guards(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    good = table(spark, sf_dir, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("o_custkey"))
    return candidates.insert_guard(o, "o_orderkey", [("no_current_customer", good, ["o_custkey"]), ("no_line", table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])])


@query("""SELECT l_orderkey AS k, count(*) * 2 AS expected, count(*) + count(*) FILTER (l_linenumber % 3 <> 0) AS found, count(*) FILTER (l_linenumber % 3 = 0) = 0 AS agree FROM lineitem GROUP BY 1""")
def key_multisets(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber")
    return candidates.keys_agree(rows.unionByName(rows), rows.unionByName(rows.where("l_linenumber % 3 <> 0")), "k", "l_linenumber")


# --- snapshots -----------------------------------------------------------------------------------------------------------


def _inputs(spark: SparkSession, sf_dir: str, status: Column) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("o_orderstatus", status).select("o_orderkey", "o_custkey", "o_orderstatus")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_returnflag")
    customer = o.select("o_orderkey", "o_custkey").join(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_custkey", "c_mktsegment")
    return snapshots.input_hashes(o, "o_orderkey", {"lines": (lines, ["l_linenumber", "l_partkey"]), "customers": (customer, ["c_custkey"])})


_INPUTS = """(SELECT o.o_orderkey, sha256('{"customers":' || coalesce('[' || c || ']', '[]') || ',"item":{"o_custkey":' || o_custkey || ',"o_orderkey":' || o.o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"},"lines":' || coalesce('[' || l || ']', '[]') || ',"schema":"input-v1"}') AS input_hash
    FROM orders o LEFT JOIN (SELECT l_orderkey, string_agg('{"l_linenumber":' || l_linenumber || ',"l_partkey":' || l_partkey || ',"l_returnflag":"' || l_returnflag || '"}', ',' ORDER BY l_linenumber, l_partkey, l_returnflag) AS l FROM lineitem GROUP BY 1) x ON l_orderkey = o.o_orderkey
    LEFT JOIN (SELECT c_custkey, '{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '"}' AS c FROM customer) y ON c_custkey = o_custkey)"""


@query(f"SELECT o_orderkey, input_hash FROM {_INPUTS}")
def input_snapshots(spark, sf_dir):
    """One hash of an order, its lines and its customer: what evidence on it rests on."""
    return _inputs(spark, sf_dir, F.col("o_orderstatus"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'snapshot_missing' WHEN o_orderkey % 11 = 0 THEN 'snapshot_invalidated' ELSE 'input_changed' END AS reason FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 OR (o_totalprice > 300000 AND o_orderstatus <> 'O')")
def snapshot_staleness(spark, sf_dir):
    """Snapshots taken while dear orders were open, some of them never, some invalidated since."""
    taken = _inputs(spark, sf_dir, F.when(F.col("o_totalprice") > 300000, "O").otherwise(F.col("o_orderstatus"))).where("o_orderkey % 7 <> 0")
    return snapshots.stale(taken.withColumn("invalidated", F.col("o_orderkey") % 11 == 0), _inputs(spark, sf_dir, F.col("o_orderstatus")), "o_orderkey")


@query("SELECT 'orders' AS \"table\", CAST(o_orderkey AS VARCHAR) AS id FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal < 0 UNION ALL SELECT DISTINCT 'lines', CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE c_acctbal < 0")
def invalidation_cascade(spark, sf_dir):
    voided = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.concat(F.lit("c"), "c_custkey").alias("k"))
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("id"), F.concat(F.lit("c"), "o_custkey").alias("on"))
    lines = table(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.concat(F.lit("o"), "l_orderkey").alias("on"))
    out = snapshots.cascade(voided, "k", [("orders", o, "id", "on"), ("lines", lines, "id", "on")])
    return out.withColumn("id", F.regexp_replace("id", "^o", ""))


@query(f"SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey NOT IN (SELECT user_id FROM {_LAST} GROUP BY user_id HAVING count(*) FILTER (status = 'pass') = 5 AND count(*) = 5)")
def approval_locks(spark, sf_dir):
    quorum = gates.quorum(log(spark, sf_dir), "user_id", "event_type", "status", KINDS, ["ts", "event_id"]).withColumnRenamed("user_id", "c_custkey")
    return snapshots.approval_lock(table(spark, sf_dir, "customer").withColumn("approved", F.col("c_mktsegment") == "BUILDING"), "c_custkey", "approved", quorum)


# --- trees, integrity ----------------------------------------------------------------------------------------------------


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, n, c = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    row = lambda df, i, p, s: df.select(F.expr(i).alias("node"), F.expr(p).alias("parent"), F.expr(s).cast("long").alias("sequence"))
    return row(r, "concat('r', r_regionkey)", "CAST(NULL AS STRING)", "r_regionkey + 1").unionByName(row(n, "concat('n', n_nationkey)", "concat('r', n_regionkey)", "n_nationkey + 1")).unionByName(row(c, "concat('c', c_custkey)", "concat('n', c_nationkey)", "c_custkey + 1"))


_NODES = "(SELECT 'r' || r_regionkey AS node, NULL AS parent, r_regionkey + 1 AS sequence FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey + 1 FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_custkey + 1 FROM customer)"


@query(f"""WITH RECURSIVE t AS (SELECT node, 0 AS level, lpad(CAST(sequence AS VARCHAR), 12, '0') || '~' || node || '/' AS path FROM {_NODES} WHERE parent IS NULL UNION ALL SELECT n.node, t.level + 1, t.path || lpad(CAST(n.sequence AS VARCHAR), 12, '0') || '~' || n.node || '/' FROM {_NODES} n JOIN t ON n.parent = t.node),
    h AS (SELECT path AS here FROM t WHERE node = 'n7') SELECT node, level FROM t, h WHERE path <= here OR starts_with(path, here)""")
def tree_scope(spark, sf_dir):
    return tree.allowed_prefix(tree.paths(_nodes(spark, sf_dir), "node", "parent", "sequence"), "node", F.lit("n7")).select("node", "level")


_BROKEN = "(SELECT 'n' || n_nationkey AS node, CASE WHEN n_nationkey % 5 = 0 THEN NULL WHEN n_nationkey = 7 THEN 'n7' WHEN n_nationkey = 8 THEN 'n99' ELSE 'n' || (n_nationkey - n_nationkey % 5) END AS parent, CASE WHEN n_nationkey = 11 THEN 0 WHEN n_nationkey = 13 THEN 2 ELSE n_nationkey % 5 + CASE WHEN n_nationkey % 5 = 0 THEN 1 + n_nationkey ELSE 0 END END AS sequence FROM nation)"


@query(f"""WITH RECURSIVE b AS {_BROKEN}, t AS (SELECT node FROM b WHERE parent IS NULL UNION SELECT b.node FROM b JOIN t ON b.parent = t.node)
    SELECT 'duplicate_node_id' AS rule, node FROM b GROUP BY node HAVING count(*) > 1 UNION ALL SELECT 'self_referencing_node', node FROM b WHERE node = parent UNION ALL SELECT 'missing_parent', node FROM b WHERE parent IS NOT NULL AND parent NOT IN (SELECT node FROM b) UNION ALL SELECT 'unordered_sequence', node FROM b WHERE sequence IS NULL OR sequence <= 0
    UNION ALL SELECT 'ambiguous_sibling_sequence', x.node FROM b x WHERE (SELECT count(*) FROM b y WHERE y.parent IS NOT DISTINCT FROM x.parent AND y.sequence = x.sequence) > 1
    UNION ALL SELECT 'not_reached_from_a_root', node FROM b WHERE parent IS NOT NULL AND parent <> node AND parent IN (SELECT node FROM b) AND node NOT IN (SELECT node FROM t)""")
def forest_validation(spark, sf_dir):
    nodes = table(spark, sf_dir, "nation").selectExpr("concat('n', n_nationkey) AS node", "CASE WHEN n_nationkey % 5 = 0 THEN NULL WHEN n_nationkey = 7 THEN 'n7' WHEN n_nationkey = 8 THEN 'n99' ELSE concat('n', n_nationkey - n_nationkey % 5) END AS parent", "CAST(CASE WHEN n_nationkey = 11 THEN 0 WHEN n_nationkey = 13 THEN 2 ELSE n_nationkey % 5 + CASE WHEN n_nationkey % 5 = 0 THEN 1 + n_nationkey ELSE 0 END END AS BIGINT) AS sequence")
    return tree.forest_problems(nodes, "node", "parent", "sequence")


@query("""SELECT 'line_without_order' AS rule, CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR) AS key FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
    UNION ALL SELECT 'line_key', CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR) FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
    UNION ALL SELECT 'balance_not_negative', CAST(c_custkey AS VARCHAR) FROM customer WHERE NOT c_acctbal >= 0 UNION ALL SELECT 'several_open', CAST(o_custkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'O' GROUP BY 1, 2 HAVING count(*) > 1""")
def integrity_violations(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    lines, key = t("lineitem"), ["l_orderkey", "l_linenumber"]
    out = integrity.orphans(lines, "l_orderkey", t("orders"), "o_orderkey", key, "line_without_order").unionByName(integrity.duplicate_keys(lines, key, "line_key"))
    out = out.unionByName(integrity.failed_checks(t("customer"), {"balance_not_negative": F.col("c_acctbal") >= 0}, ["c_custkey"]))
    return out.unionByName(integrity.several_active(t("orders"), "o_custkey", F.col("o_orderstatus") == "O", "several_open"))


@query("""WITH s AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS source FROM events)
    SELECT user_id, event_id AS at, source, event_type AS target FROM s WHERE source IS NOT NULL AND source <> event_type AND NOT (source || '>' || event_type IN ('signup>view', 'view>click', 'click>purchase') OR event_type = 'error')""")
def state_transitions(spark, sf_dir):
    return integrity.illegal_transitions(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type", [("signup", "view"), ("view", "click"), ("click", "purchase")], ["error"])


@query("SELECT CASE WHEN o_orderkey % 97 = 0 THEN 'deleted' ELSE 'updated' END AS rule, CAST(o_orderkey AS VARCHAR) AS key FROM orders WHERE o_orderkey % 97 = 0 OR o_orderkey % 89 = 0")
def append_only_drift(spark, sf_dir):
    before = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    after = before.where("o_orderkey % 97 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 89 == 0, "X").otherwise(F.col("o_orderstatus")))
    return integrity.drift(before, after, ["o_orderkey"], ["o_orderstatus", "o_totalprice"])


# --- samples -------------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, stratum, pick FROM (SELECT doc_id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY md5('s:' || CAST(doc_id AS VARCHAR)), doc_id) AS pick FROM (SELECT d.doc_id, CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 0 THEN 'poor' WHEN n_chars > 3000 THEN 'long' END AS stratum FROM documents d LEFT JOIN labels USING (doc_id)) WHERE stratum IS NOT NULL) WHERE pick <= 8")
def stratified_sample(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return sampling.priority_strata(d, [("toxic", F.col("toxic") == 1), ("poor", F.col("quality") == 0), ("long", F.col("n_chars") > 3000)], "doc_id", 8, "s").select("doc_id", "stratum", "pick")


@query("""WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), e AS (SELECT *, (n * 137) // (SELECT sum(n) FROM s) AS fl, (n * 137) % (SELECT sum(n) FROM s) AS rest FROM s),
    r AS (SELECT *, row_number() OVER (ORDER BY rest DESC, source) AS p, 137 - (SELECT sum(fl) FROM e) AS lft FROM e) SELECT source, n, CAST(least(n, fl + CASE WHEN p <= lft THEN 1 ELSE 0 END) AS BIGINT) AS quota FROM r""")
def proportional_allocation(spark, sf_dir):
    return sampling.allocation(table(spark, sf_dir, "documents"), "source", 137)


@query("SELECT doc_id, quality, pick FROM (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5('r:' || CAST(doc_id AS VARCHAR)), doc_id) AS pick, count(*) OVER (PARTITION BY quality) AS n FROM labels) WHERE pick <= greatest(1, ceil(n * 10 / 100))")
def ratio_review_sample(spark, sf_dir):
    return sampling.at_least_ratio(table(spark, sf_dir, "labels"), "quality", "doc_id", 10, "r").select("doc_id", "quality", "pick")


# --- beyond SQL ----------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, sha256(regexp_replace(nfc_normalize(text), '[\\s\\x0B]+', '', 'g')) AS nfkc_sha256 FROM documents")
def nfkc_normalise(spark, sf_dir):
    from ..functions.udfs import nfkc

    tables.small_batches(spark)
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(nfkc("text"), 256).alias("nfkc_sha256"))


@query("""SELECT event_id, sha256('{"k":' || json_extract_string(props, '$.k') || '}') AS props_sha256 FROM events""")
def canonical_json_hash(spark, sf_dir):
    from ..functions.udfs import canonical_hash

    return table(spark, sf_dir, "events").select("event_id", canonical_hash("props").alias("props_sha256"))


@query()
def difflib_similar(spark, sf_dir):
    """For each part the first earlier one of its brand whose name, type and price are as similar as 0.9."""
    from ..functions.udfs import similar

    parts = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type", F.col("p_size").cast("string")).alias("s"), "p_brand")
    return similarity.find_similar(parts, "p_partkey", "s", "p_brand", similar).withColumn("ratio", F.round("ratio", 6))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN CAST(l_partkey * (l_suppkey + l_linenumber) + (1 - l_linenumber % 2) AS VARCHAR) = CAST(l_partkey * l_suppkey + l_partkey * l_linenumber AS VARCHAR) THEN 'pass' ELSE 'fail' END AS status FROM lineitem")
def math_validate(spark, sf_dir):
    from ..functions.udfs import validate

    stem = F.expr("concat(l_partkey, '×(', l_suppkey, '+', l_linenumber, ')=')")
    answer = F.expr("CAST(l_partkey * (l_suppkey + l_linenumber) + (1 - l_linenumber % 2) AS STRING)")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", validate(F.lit("arithmetic"), stem, answer)["status"].alias("status"))


@query("SELECT event_type, count(*) AS n, max(event_id) AS last_event FROM events GROUP BY 1")
def ledger_stream(spark, sf_dir):
    """Structured Streaming: the ledger's new files, each event once, then its states."""
    import uuid

    from ..streaming.ledger import ingest
    from ..streaming.shared import work_folder

    base = f"{work_folder(spark)}/ledger-{uuid.uuid4().hex}"
    ingest(spark, f"{sf_dir}/events.parquet*", table(spark, sf_dir, "events").schema, f"{base}/out", f"{base}/checkpoint", "event_id", "ts", "3650 days")
    return spark.read.parquet(f"{base}/out").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_event"))
