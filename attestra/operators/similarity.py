"""Duplicate groups, source relationships, keyword classification and anchored scope decisions."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.bags import blocks, first_similar
from ..functions.text import char_ngrams, file_base, jaccard, keyword_f1, keyword_grams, plain, strip_space
from .patterns import hits
from .tables import small_batches, written

#: Least scores for sources of one family, compared after rounding to four places.
FILE_SCORE, STEM_SCORE = 0.72, 0.74
ACTIONS = {"exact_duplicate": ("low", "manual_review_for_dedupe"), "suspected_same_family": ("medium", "manual_review_only"), "no_match": ("low", "none"), "insufficient_input": ("high", "none")}


def exact_groups(df: DataFrame, key: str, text: str) -> DataFrame:
    """content_hash, n, first_id of the texts that occur more than once."""
    return df.groupBy(F.sha2(F.col(text), 256).alias("content_hash")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first_id")).where("n > 1")


def similarity(a: Column, b: Column) -> Column:
    """The larger of word and trigram Jaccard, rounded to four places."""
    words = lambda x: F.filter(F.array_distinct(F.split(x, " ")), lambda w: w != "")
    grams = lambda x: char_ngrams(F.replace(x, F.lit(" "), F.lit("")), 3)
    return F.round(F.greatest(jaccard(words(a), words(b)), jaccard(grams(a), grams(b))), 4)


def relationship(pairs: DataFrame, hash_a: str, hash_b: str, file_a: str, file_b: str, stem_a: str, stem_b: str) -> DataFrame:
    """pairs with file_score, stem_score, decision, uncertainty and action. Nothing is ever merged or deleted by it."""
    have = lambda c: F.coalesce(F.length(F.trim(c)), F.lit(0)) > 0
    full = have(F.col(file_a)) & have(F.col(file_b)) & have(F.col(stem_a)) & have(F.col(stem_b))
    out = pairs.withColumns({"file_score": F.when(full, similarity(file_base(F.col(file_a)), file_base(F.col(file_b)))), "stem_score": F.when(full, similarity(plain(F.col(stem_a)), plain(F.col(stem_b))))})
    same = F.coalesce(F.lower(hash_a) == F.lower(hash_b), F.lit(False))
    decision = F.when(same, "exact_duplicate").when(~full, "insufficient_input").when((F.col("file_score") >= FILE_SCORE) & (F.col("stem_score") >= STEM_SCORE), "suspected_same_family").otherwise("no_match")
    out = out.withColumn("decision", decision)
    look = lambda i: F.element_at(F.create_map(*(F.lit(x) for k, v in ACTIONS.items() for x in (k, v[i]))), F.col("decision"))
    return out.withColumns({"uncertainty": look(0), "action": look(1)})


def similar_pairs(texts: DataFrame, key: str, text: str, least: float) -> DataFrame:
    """a, b (keys, a < b), score: the pairs of texts (one row a text) whose similarity is at least `least`.

    Exact, without comparing all pairs: sets as similar as that share one of each other's rarest words (or trigrams), as many as may differ and one more.
    """
    bound = least - 0.00005  # scores are rounded
    words = F.filter(F.array_distinct(F.split(F.col(text), " ")), lambda w: w != "")
    both = F.array(F.struct(F.lit("w").alias("kind"), words.alias("s")), F.struct(F.lit("g").alias("kind"), char_ngrams(F.replace(text, F.lit(" "), F.lit("")), 3).alias("s")))
    sets = texts.select(F.col(key).alias("_k"), F.explode(both).alias("x")).select("_k", "x.kind", F.size("x.s").alias("n"), F.explode("x.s").alias("t"))
    often = sets.groupBy("kind", "t").agg(F.count(F.lit(1)).alias("often"))
    place = F.row_number().over(Window.partitionBy("_k", "kind").orderBy("often", "t"))
    rare = sets.join(often, ["kind", "t"]).withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * bound) + 1)
    side = lambda s: rare.select("kind", "t", F.col("_k").alias(s), F.col("n").alias(f"n{s}"))
    near = side("a").join(side("b"), ["kind", "t"]).where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= bound * F.greatest("na", "nb"))).select("a", "b").distinct()
    told = near.join(texts.select(F.col(key).alias("a"), F.col(text).alias("_ta")), "a").join(texts.select(F.col(key).alias("b"), F.col(text).alias("_tb")), "b")
    return told.select("a", "b", similarity(F.col("_ta"), F.col("_tb")).alias("score")).where(F.col("score") >= least)


#: Texts and characters of a block; blocks of a scope's first texts that all its texts meet (those left then meet the next ones, up to
#: four times as many, and so on); texts that a task puts in order, and texts that a task compares, about.
TEXTS, CHARACTERS, LEADERS, PLACED, MET = 512, 1 << 20, 4, 1 << 16, 1 << 10


def find_similar(items: DataFrame, key: str, text: str, scope: str, ratio, least: float = 0.9) -> DataFrame:
    """key, similar_to, ratio: for each item the first earlier item (by key) of its scope whose text is as similar; those without one are left out.
    ratio: a pandas UDF of two texts.

    Equal texts are compared once, and a text with texts before its own first item until one is similar: later ones come after its own. A ratio is at most
    twice the characters that two texts share (each as often as in both) by those of both; only pairs whose shared characters suffice are compared."""
    spark = items.sparkSession
    small_batches(spark)
    t = written(items.where(F.col(scope).isNotNull() & F.col(text).isNotNull()).groupBy(F.col(scope).alias("_s"), F.col(text).alias("_t")).agg(F.min(key).alias("_first")).where("_first IS NOT NULL"), "texts")
    ordered = t.repartitionByRange(t.count() // PLACED + 1, "_s", "_first").sortWithinPartitions("_s", "_first")
    placed = written(ordered.withColumn("_p", F.monotonically_increasing_id()), "places")
    kinds = {f.name: f.dataType for f in placed.schema}
    shape = T.StructType([T.StructField("_s", kinds["_s"]), T.StructField("_low", T.LongType()), T.StructField("_high", T.LongType()), T.StructField("_places", T.ArrayType(T.LongType())), T.StructField("_texts", T.ArrayType(T.StringType()))])
    block = lambda df, what: written(df.select("_s", "_p", "_t").mapInPandas(blocks(TEXTS, CHARACTERS), shape), what)
    live = all_blocks = block(placed, "blocks")
    turns = written(all_blocks.select("_s", "_low", (F.row_number().over(Window.partitionBy("_s").orderBy("_low")) - 1).alias("_j")), "turns")
    last, low, high, found = turns.agg(F.max("_j")).first()[0], 0, LEADERS, []
    while last is not None and low <= last and (n := live.agg(F.sum(F.size("_places"))).first()[0]):
        leaders = turns.where((F.col("_j") >= low) & (F.col("_j") < high)).join(all_blocks.select("_low", "_places", "_texts"), "_low")
        meet = live.select("_s", F.col("_low").alias("_id"), "_high").join(leaders, "_s").where(F.col("_low") < F.col("_high")).select("_id", "_j", "_places", "_texts")
        own = live.select(F.col("_low").alias("_id"), F.lit(-1).alias("_j"), "_places", "_texts")
        dealt = own.unionByName(meet).repartition(n // MET + 1, "_id").sortWithinPartitions("_id", "_j").select("_j", "_places", "_texts")
        told = written(dealt.mapInPandas(first_similar(ratio.func, least), "_p long, _o long, _r double"), "similar")
        found.append(told.where("_o >= 0"))
        after = turns.where(F.col("_j") == high).select("_s", F.col("_low").alias("_after"))
        low, high = high, high * 4
        if low <= last:
            left = placed.join(told.where("_o < 0").select("_p"), "_p").join(after, "_s").where(F.col("_p") > F.col("_after"))
            live = block(left.repartitionByRange(n // PLACED + 1, "_p").sortWithinPartitions("_p"), "blocks")
    if not found:
        return items.select(key, F.col(key).alias("similar_to"), F.lit(1.0).alias("ratio")).where(F.lit(False))
    similar = functools.reduce(DataFrame.unionByName, found)
    first = placed.select(F.col("_p").alias("_o"), F.col("_first").alias("_before"))
    best = placed.join(similar.join(first, "_o"), "_p", "left").select("_s", F.col("_t").alias("_a"), F.coalesce("_before", "_first").alias("_first"), F.coalesce("_r", F.lit(1.0)).alias("_r"))
    told = items.select(key, F.col(scope).alias("_s"), F.col(text).alias("_a")).join(best, ["_s", "_a"]).where(F.col("_first") < F.col(key))
    return told.groupBy(key).agg(F.min("_first").alias("similar_to"), F.min_by("_r", "_first").alias("ratio"))


def classify(items: DataFrame, nodes: DataFrame, item: str, stem: str, node: str, name: str, alphabet: str = "一-鿿", k: int = 3, least: float = 0.35) -> DataFrame:
    """item, node, score, rank: each item's k best nodes by keyword F1, of at least `least`. Items meet the nodes they share two characters in a row
    with, as they are or among those of the alphabet; others would score 0. Equal stems are scored once."""

    def keyed(df: DataFrame, own: str) -> DataFrame:
        pairs = F.array_union(keyword_grams(F.col(own), (2,), alphabet), char_ngrams(strip_space(F.col(own)), 2))
        return df.select(own, F.explode(pairs).alias("_x"))

    i = items.select(F.coalesce(stem, F.lit("")).alias("_s")).distinct().withColumn("_g", keyword_grams(F.col("_s"), alphabet=alphabet))
    n = nodes.select(F.col(node).alias("_n"), F.coalesce(name, F.lit("")).alias("_m")).withColumn("_h", keyword_grams(F.col("_m"), alphabet=alphabet))
    met = keyed(i, "_s").join(keyed(n.select("_m").distinct(), "_m"), "_x").select("_s", "_m").distinct()
    scored = met.join(i, "_s").join(n, "_m").select("_s", "_n", F.round(keyword_f1(F.col("_s"), F.col("_m"), F.col("_g"), F.col("_h")), 4).alias("score"))
    place = F.row_number().over(Window.partitionBy("_s").orderBy(F.desc("score"), "_n"))
    top = scored.withColumn("rank", place).where((F.col("rank") <= k) & (F.col("score") >= least))
    own = items.select(F.col(item).alias("_i"), F.coalesce(stem, F.lit("")).alias("_s"))
    return own.join(top, "_s").select(F.col("_i").alias(item), F.col("_n").alias(node), "score", F.col("rank").cast("long").alias("rank"))


def deciding_anchors(anchors: DataFrame, word: str, node: str, allowed: Column) -> DataFrame:
    """anchors (word, node) without those that no scope decision needs: of the nodes that a word stands for, the two smallest allowed ones and the
    smallest other one. An item that holds the word is as sure of each of its nodes, and only two of the allowed ones and whether there is another count."""
    place = F.row_number().over(Window.partitionBy(word, "_in").orderBy(node))
    ranked = anchors.select(word, node).distinct().withColumn("_in", F.coalesce(allowed, F.lit(False))).withColumn("_r", place)
    return ranked.where(F.col("_r") <= F.when(F.col("_in"), 2).otherwise(1)).select(word, node)


def scope_decision(matches: DataFrame, item: str, node: str, longest: str, allowed: Column, least: float = 0.75, margin: float = 0.15) -> DataFrame:
    """item, status, reason, node of items with anchors found in them. matches: item, node, longest (anchor length).

    A node's confidence is min(1, longest / 5). Without an allowed node of at least `least`: candidate_node_outside_allowed_progress if
    another one matched, else no_complete_evidence_chain; two best closer than `margin`: ambiguous_top_candidate; a match outside
    beside the best: candidate_node_outside_allowed_progress; else a candidate by unique_evidence_chain.
    """
    m = matches.withColumns({"_c": F.least(F.lit(1.0), F.col(longest) / 5), "_in": allowed}).where(F.col("_c") >= least)
    ranked = m.withColumn("_r", F.row_number().over(Window.partitionBy(item, "_in").orderBy(F.desc("_c"), node)))
    best = ranked.groupBy(item).agg(
        F.max(F.when(F.col("_in") & (F.col("_r") == 1), F.col("_c"))).alias("_one"), F.max(F.when(F.col("_in") & (F.col("_r") == 2), F.col("_c"))).alias("_two"),
        F.max(F.when(F.col("_in") & (F.col("_r") == 1), F.col(node))).alias("_node"), F.bool_or(~F.col("_in")).alias("_out"),
    )
    reason = F.when(F.col("_one").isNull(), F.when(F.col("_out"), "candidate_node_outside_allowed_progress").otherwise("no_complete_evidence_chain")).when(F.col("_one") - F.coalesce("_two", F.lit(0.0)) < margin, "ambiguous_top_candidate").when(F.col("_out"), "candidate_node_outside_allowed_progress").otherwise("unique_evidence_chain")
    out = best.withColumn("reason", reason)
    good = F.col("reason") == "unique_evidence_chain"
    return out.select(item, F.when(good, "candidate").otherwise("rejected").alias("status"), "reason", F.when(good, F.col("_node")).alias(node))


def contained(haystack: DataFrame, needles: DataFrame, key: str, text: str, needle: str, passage: str, words: int = 5) -> DataFrame:
    """key, needle of all pairs whose passage lies in the text. Texts and passages meet at the passage's rarest inner run of `words` words,
    as hashes; whole texts are compared for those pairs only. Empty passages lie in no text. Passages too short for an inner run are looked for all at once in one pass over the texts."""
    cut = lambda c: F.split(c, " ")

    def runs(c: Column) -> Column:
        """Hashes of an array's runs; the array is worked out once, not once a run."""
        return F.array_distinct(F.flatten(F.transform(F.array(c), lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - words), lambda i: F.xxhash64(F.array_join(F.slice(w, i + 1, words), " "))))))

    enough = F.size(cut(F.col(passage))) >= words + 2
    long, short = needles.where(enough), needles.where(~enough).select(needle, passage)
    inner = F.slice(cut(F.col(passage)), F.lit(2), F.size(cut(F.col(passage))) - 2)
    index = long.select(needle, F.explode(runs(inner)).alias("_g"))
    often = index.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    one = index.join(often, "_g").groupBy(needle).agg(F.min_by("_g", F.struct("_n", "_g")).alias("_g"))
    grams = haystack.where(F.size(cut(F.col(text))) >= words).select(key, F.explode(runs(cut(F.col(text)))).alias("_g"))
    met = grams.join(one, "_g").select(key, needle).distinct()
    found = met.join(needles, needle).join(haystack, key).where(F.contains(F.col(text), F.col(passage))).select(key, needle)
    numbered = short.select(F.xxhash64(passage).alias("pattern_id"), F.col(passage).alias("pattern")).where("pattern <> ''").distinct()
    told = hits(haystack, numbered, key, text).join(short.select(needle, F.xxhash64(passage).alias("pattern_id")), "pattern_id").select(key, needle)
    return found.unionByName(told)
