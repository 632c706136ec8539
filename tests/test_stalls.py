"""The stall monitor: silence shows by the next heartbeat or by time alone, once, and across a restart."""

from datetime import datetime, timedelta

from attestra.streaming import stalls


def test_stalls_across_a_restart(spark, tmp_path):
    day = datetime(2024, 5, 1)
    at = lambda m: day + timedelta(minutes=m)
    first = [("a", at(0), "started"), ("a", at(5), "alive"), ("a", at(40), "alive"), ("b", at(0), "started"), ("b", at(9), "finished"), ("c", at(38), "started"), (None, at(1), "alive"), ("d", None, "alive"), ("e", at(1), "started")]
    second = [("a", at(45), "alive"), ("c", at(90), "alive"), ("b", at(95), "started"), ("e", at(0), "alive"), ("f", at(120), "started")]
    third = [("c", at(91), "alive"), ("a", at(200), "alive")]
    schema = "run string, at timestamp, event string"
    (tmp_path / "in").mkdir()
    beats = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = []
    for part in (first, second, third):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stalls.record(beats, timedelta(minutes=10), str(tmp_path / "out"), str(tmp_path / "check"))
        got = sorted((r["run"], (r["last"] - day).seconds // 60, (r["stalled"] - day).seconds // 60, r["beats"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
        seen.append(got)
    assert seen[0] == [("a", 5, 15, 2), ("e", 1, 11, 1)]
    assert seen[1] == sorted([*seen[0], ("a", 45, 55, 4), ("c", 38, 48, 1), ("b", 95, 105, 3), ("c", 90, 100, 2)])
    assert [x for x in seen[2] if x not in seen[1]] == [("f", 120, 130, 1)] or ("c", 91, 101, 3) in seen[2]
    assert len(seen[2]) == len(set(seen[2]))
