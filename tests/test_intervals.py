"""Range joins and asset bindings against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestra.operators import bindings, intervals, segment


def meet(a, b):
    return a[1] <= a[2] and b[1] <= b[2] and a[0] is not None and a[0] == b[0] and a[1] < b[2] and b[1] < a[2]


@pytest.fixture(scope="module")
def ranges():
    rng = random.Random(3)
    out = []
    for k in range(240):
        a = rng.randint(-70, 70)
        out.append((rng.choice(["x", "x", "y", None]), a, a + rng.choice([0, 0, 1, 2, 3, 8, 16, 17, 64, 100, -3])))
    out += [("x", 5, 5), ("x", 5, 6), ("x", 4, 6), ("x", 6, 9), ("x", -(1 << 40), 1 << 40), ("y", 1 << 50, (1 << 50) + 1)]
    return [(k, *r) for k, r in enumerate(out)]


def test_overlaps_of_nested_touching_and_empty_ranges(spark, ranges):
    df = spark.createDataFrame(ranges, "id int, k string, start long, end long")
    left, right = df.where("id % 2 = 0"), df.where("id % 2 = 1")
    a, b = [r for r in ranges if r[0] % 2 == 0], [r for r in ranges if r[0] % 2]
    want = Counter((x[0], y[0]) for x in a for y in b if meet(x[1:], y[1:]))
    got = Counter((r["id"], r["other_id"]) for r in intervals.overlap_pairs(left, right, ["k"]).collect())
    assert got == want and max(want.values()) == 1 and len(want) > 500
    hit = {x for x, _ in want}
    assert {r["id"] for r in intervals.not_overlapping(left, right, ["k"]).collect()} == {x[0] for x in a} - hit
    plan = intervals.overlap_pairs(left, right, ["k"])._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan.split("Physical Plan")[1]


def test_places_in_ranges(spark, ranges):
    rng = random.Random(4)
    places = [(i, rng.choice(["x", "y", None]), rng.choice([None, rng.randint(-80, 90)])) for i in range(120)]
    got = Counter((r["p"], r["id"]) for r in intervals.places_in_ranges(spark.createDataFrame(places, "p int, k string, at long"), spark.createDataFrame(ranges, "id int, k string, a long, z long"), ["k"], "at", "a", "z").collect())
    assert got == Counter((p, r[0]) for p, k, at in places for r in ranges if k is not None and k == r[1] and at is not None and r[2] <= at < r[3]) and got
    owned = segment.owners(spark.createDataFrame(places, "p int, k string, at long"), spark.createDataFrame(ranges, "id int, k string, a long, z long"), "k", "at", "a", "z", "id").collect()
    for r in owned:
        held = [x[0] for x in ranges if r["k"] is not None and x[1] == r["k"] and r["at"] is not None and x[2] <= r["at"] < x[3]]
        assert (r["assignment"], r["id"]) == (("unassigned", None) if not held else ("assigned", held[0]) if len(held) == 1 else ("ambiguous", None))


def test_many_ranges_of_one_key_take_work_by_what_is_found(spark):
    """200,000 short ranges side by side, and as many that never meet them: 4e10 pairs, of which none is listed in vain."""
    n = 200_000
    short = spark.range(n).select(F.lit(1).alias("k"), (F.col("id") * 10).alias("start"), (F.col("id") * 10 + 4).alias("end"))
    between = spark.range(n).select(F.lit(1).alias("k"), (F.col("id") * 10 + 4).alias("start"), (F.col("id") * 10 + 9).alias("end"))
    assert intervals.overlap_pairs(short, between, ["k"]).count() == 0
    assert intervals.not_overlapping(short, between, ["k"]).count() == n
    wide = spark.range(n).select(F.lit(1).alias("k"), (F.col("id") * 10 + 3).alias("start"), (F.col("id") * 10 + 11).alias("end"))
    assert intervals.overlap_pairs(short, wide, ["k"]).count() == 2 * n - 1
    l_, r_ = intervals._sides(short, wide, "start", "end")
    assert l_.count() + r_.count() < 24 * n
    rows = l_.join(r_, ["k", *intervals._ON]).count()
    assert rows == 2 * n - 1  # the join itself gives pairs alone


def bound(options, blocks, assets):
    """(position -> (asset, mode)) or a reason, for the options of one question, plainly."""
    if not all(o["asset_only"] for o in options):
        return "asset_only_option_set_ambiguous"
    real = [a for a in assets if a["range_start"] is not None and a["range_end"] is not None and a["range_end"] > a["range_start"]]
    used, out, order = set(), {}, []
    for o in sorted(options, key=lambda o: o["position"]):
        if o["block"] not in order:
            order.append(o["block"])
    for name in order:
        own = [o for o in sorted(options, key=lambda o: o["position"]) if o["block"] == name]
        b = blocks.get(name)
        if b is None:
            return "asset_only_option_block_missing"
        if b[0] is None or b[1] is None or b[1] <= b[0]:
            return "asset_only_option_block_range_invalid"
        free = [a for a in real if a["asset"] not in used]
        strict = [[a["asset"] for a in free if a["range_start"] >= b[0] + o["start"] and a["range_end"] <= b[0] + o["end"]] for o in own]
        if all(len(x) == 1 for x in strict) and len({x[0] for x in strict}) == len(own):
            found = [(o, x[0], "exact_marker_range") for o, x in zip(own, strict, strict=True)]
        else:
            inside = sorted((a["range_start"], a["range_end"], a["ordinal"], a["asset"]) for a in free if a["range_start"] >= b[0] and a["range_end"] <= b[1])
            if len(inside) != len(own):
                return "asset_only_option_asset_count_mismatch"
            found = [(o, a[3], "block_range_order") for o, a in zip(sorted(own, key=lambda o: o["start"]), inside, strict=True)]
        for o, asset, mode in found:
            out[o["position"]] = (asset, mode)
            used.add(asset)
    return out if all((o["label"] or "").strip() for o in options) else "asset_only_option_label_invalid"


def test_assets_are_bound_once_or_not_at_all(spark):
    """Blocks that overlap, so that one block's assets are another's too; empty and missing ranges."""
    rng = random.Random(8)
    options, blocks, assets = [], {}, []
    for d in range(160):
        for k in range(2):
            a = 40 * k if rng.random() < 0.5 else 10 * k
            if rng.random() > 0.05:
                blocks[d, f"b{k}"] = (None, 5) if rng.random() < 0.05 else (a, a if rng.random() < 0.05 else a + 40)
        used = rng.choice([1, 2])
        for p in range(rng.choice([2, 3, 4])):
            at = 10 * (p // used)
            options.append({"document": d, "question": d * 7, "position": p, "label": "ABCD"[p] if rng.random() > 0.02 else "", "block": f"b{p % used}", "start": at, "end": at + 8, "asset_only": rng.random() > 0.03})
            for _ in range(1 if rng.random() > 0.1 else rng.choice([0, 2])):
                s = blocks.get((d, f"b{p % used}"), (0, 0))[0] or 0
                wide = rng.random() < 0.3
                assets.append({"document": d, "asset": f"a{d}-{len(assets)}", "ordinal": rng.randint(0, 3), "range_start": s + at + (0 if wide else rng.randint(0, 2)), "range_end": s + at + rng.choice([9, 10] if wide else [4, 8, -9])})
    o = spark.createDataFrame([tuple(x.values()) for x in options] + [(999, 1, 0, "A", "b0", 0, 1, False)], "document int, question int, position int, label string, block string, start int, end int, asset_only boolean")
    b = spark.createDataFrame([(*k, *v) for k, v in blocks.items()], "document int, block string, range_start int, range_end int")
    a = spark.createDataFrame([tuple(x.values()) for x in assets], "document int, asset string, ordinal int, range_start int, range_end int")
    got = {(r["document"], r["position"]): (r["asset"], r["mode"], r["reason"]) for r in bindings.bind_assets(o, b, a).collect()}
    want = {}
    for d in range(160):
        own = [x for x in options if x["document"] == d]
        if not any(x["asset_only"] for x in own):
            continue
        told = bound(own, {k[1]: v for k, v in blocks.items() if k[0] == d}, [x for x in assets if x["document"] == d])
        for x in own:
            want[d, x["position"]] = (None, None, told) if isinstance(told, str) else (*told[x["position"]], None)
    assert got == want and len({x[2] for x in want.values()}) == 6 and {x[1] for x in want.values()} == {None, "exact_marker_range", "block_range_order"}


def test_bins_of_a_range_are_disjoint_and_fill_it():
    """The bins of a range are disjoint and fill it: worked out for random ranges in numpy as the columns do."""
    rng = np.random.default_rng(1)
    for a, z in zip(rng.integers(-1000, 1000, 300).tolist(), rng.integers(-1000, 1000, 300).tolist(), strict=True):
        a, z = min(a, z), max(a, z)
        bins = []
        for level in range(int(np.log2(max(z - a, 1))) + 2):
            up, low = -(-a >> level), z >> level
            if up < low:
                bins += [(level, up)] * (up % 2) + [(level, low - 1)] * (low % 2)
        covered = sorted(x for level, b in bins for x in range(b << level, (b + 1) << level))
        assert covered == list(range(a, z)) and len(bins) <= 2 * (int(np.log2(max(z - a, 1))) + 1)
