"""The corpus pipeline, stage by stage, against brute force on the smallest documents."""

import hashlib
import re
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_operators import WS, _components, _raked

from attestra.llm.shared import written

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "1234 !!", "en", "s", 7), (10**6 + 2, "", None, None, 0)], docs.schema)
    out = [docs.unionByName(odd)]
    for name, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], SF), f"test-{name}"))
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_columns_stay_until_the_last_stage(stages):
    assert all(d.columns == stages[0].columns for d in stages[:-1])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_duplicates", "source_mix", "packing"]


def test_language_keeps_what_has_letters(stages):
    before, after = rows(stages[0]), rows(stages[1])
    assert set(before) - set(after) == {10**6, 10**6 + 1, 10**6 + 2}
    assert all(before[i] == after[i] for i in after)


def test_lines(stages):
    before, after, held = rows(stages[1]), rows(stages[2]), {}
    for i, r in before.items():
        for x in r["text"].split("\n"):
            if len(x.strip(WS)) >= 20:
                held.setdefault(x.strip(WS).lower(), set()).add(i)
    for i, r in before.items():
        kept = [x for x in r["text"].split("\n") if len(own := held.get(x.strip(WS).lower(), ())) < 3 or i == max(own)]
        if kept or not r["text"]:
            assert after[i]["text"] == "\n".join(kept) and (kept == r["text"].split("\n") or after[i]["n_chars"] == len(after[i]["text"]))
        else:
            assert i not in after


def test_near_duplicates(stages):
    before = rows(stages[2])
    want = {i for (i, _, c) in _components([(i, r["text"]) for i, r in before.items()]) if i == c}
    assert set(rows(stages[3])) == want


def test_mix_and_packing(stages):
    kept, before = rows(stages[4]), rows(stages[3])
    cell = {}
    for i, r in before.items():
        n = len(re.split(f"[{WS}]+", r["text"].strip(WS))) if r["text"].strip(WS) else 0
        topic = "table" if " | " in r["text"] else "list" if "\n- " in r["text"] or "\n* " in r["text"] else "short" if n < 50 else "long" if n > 2000 else "prose"
        cell[i] = (r["source"], r["lang"], topic), n
    tokens = Counter()
    for c, n in cell.values():
        tokens[c] += n
    factor = _raked(tokens, (0.7, 0.9, 1.0), 2000)
    most = max(f for c, f in factor.items() if tokens[c])
    scale = min(1 / most, sum(tokens.values()) / sum(n * factor[c] for c, n in tokens.items()))
    drawn = {i: int(hashlib.md5(f"23:{i}".encode()).hexdigest()[:13], 16) / (1 << 52) for i in before}
    wrong = [i for i in before if (drawn[i] < factor[cell[i][0]] * scale) != (i in kept)]
    assert all(abs(drawn[i] - factor[cell[i][0]] * scale) < 1e-3 for i in wrong) and len(wrong) <= 1
    assert kept and all(r == before[i] for i, r in kept.items())
    pieces = stages[5].collect()
    assert {r["doc_id"] for r in pieces} == set(kept)
    assert max(r["offset"] + r["length"] for r in pieces) <= 1024


def test_stages_take_empty_tables_repeats_and_clashing_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = ["lang_pred", "kept", "n_lines", "kept_text", "tokens", "mix_topic", "doc", "th", "_salt", "letter", "hash", "hash_text"]
    odd = docs.unionByName(docs.where("doc_id < 30")).withColumns({c: F.concat(F.lit(f"{c}:"), "doc_id") for c in extra})
    odd = odd.unionByName(odd.where("doc_id < 3").withColumn("doc_id", F.lit(None).cast("long"))).unionByName(odd.where("doc_id = 5").withColumn("text", F.lit(None).cast("string")))
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, odd, SF), f"odd-{name}")
        none = stage(spark, odd.where("false"), SF)
        assert none.count() == 0 and none.columns == out.columns
        if name == "packing":
            assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in odd.collect()}
            continue
        assert out.columns == odd.columns and out.where("doc_id IS NOT NULL").where(" OR ".join(f"`{c}` <> concat('{c}:', doc_id)" for c in extra)).isEmpty()
        if name == "near_duplicates":
            assert out.where("doc_id IS NOT NULL AND text IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty()
            assert out.where("doc_id IS NULL").isEmpty() and out.where("doc_id = 5 AND text IS NULL").count() == 1
        if name == "source_mix":
            assert out.groupBy("doc_id").count().join(odd.groupBy("doc_id").count().withColumnRenamed("count", "n"), "doc_id").where("count <> n").isEmpty()
