"""Views kept up to date by batches, against working them out anew."""

import random

import pytest

from attestra.operators import deltas
from attestra.operators.deltas import Ledger, Must, View

REVISIONS = Ledger("revisions", ("item",), ("version",))
PARTS = Ledger("parts", ("part",), ("version",))
BRANDS = Ledger("brands", ("brand",), ("version",))
BLOCKS = Ledger("blocks", ("part", "reason"), ("version",))
VIEW = View(REVISIONS, "flag <> 'void'", (Must(View(PARTS, "status = 'live'", (Must(View(BRANDS, "open"), {"brand": "brand"}),)), {"part": "part"}), Must(View(BLOCKS, "holds"), {"part": "part"}, absent=True)))
TYPES = {"revisions": "item int, part int, flag string, version int", "parts": "part int, brand int, status string, version int", "brands": "brand int, open boolean, version int", "blocks": "part int, reason string, holds boolean, version int"}


def some(rng, version, much):
    """New rows of each ledger; later versions may move to other parts or brands, and some columns are null."""
    null = lambda x: None if rng.random() < 0.1 else x
    return {
        "revisions": [(i, null(rng.randrange(8)), rng.choice(["a", "b", "void"]), version) for i in rng.sample(range(40), 4 * much)],
        "parts": [(i, null(rng.randrange(4)), rng.choice(["live", "live", "dead"]), version) for i in rng.sample(range(8), much)],
        "brands": [(i, rng.random() < 0.7, version) for i in rng.sample(range(4), min(much, 4))],
        "blocks": [(i, rng.choice("xy"), rng.random() < 0.5, version) for i in rng.sample(range(8), much // 2)],
    }


def brute(ledgers):
    last = lambda name, n: {r[:n]: r for r in sorted(ledgers[name], key=lambda r: r[-1])}
    open_brands = {r[0] for r in last("brands", 1).values() if r[1]}
    live = {r[0] for r in last("parts", 1).values() if r[2] == "live" and r[1] in open_brands}
    blocked = {r[0] for r in last("blocks", 2).values() if r[2]}
    return sorted(r for r in last("revisions", 1).values() if r[2] != "void" and r[1] in live and r[1] not in blocked)


def test_ten_batches_equal_a_full_recomputation(spark):
    rng = random.Random(5)
    ledgers = some(rng, 0, 8)
    frames = lambda d: {n: spark.createDataFrame(rows, TYPES[n]) for n, rows in d.items() if rows}
    log = [(*r, 1) for r in brute(ledgers)]
    moved = 0
    for version in range(1, 11):
        batch = {n: rows for n, rows in some(rng, version, 2).items() if rng.random() < 0.6}
        state = deltas.current(spark.createDataFrame(log, TYPES["revisions"] + ", sign int"))
        got = [tuple(r) for r in deltas.changes(VIEW, state, frames(ledgers), frames(batch)).collect()]
        ledgers = {n: rows + batch.get(n, []) for n, rows in ledgers.items()}
        log += got
        moved += len(got)
        now = deltas.current(spark.createDataFrame(log, TYPES["revisions"] + ", sign int"))
        assert sorted(map(tuple, now.collect())) == brute(ledgers), version
    assert moved > 10
    assert sorted(map(tuple, deltas.standing(VIEW, frames(ledgers)).collect())) == brute(ledgers)
    again = deltas.changes(VIEW, now, frames(ledgers), frames(batch))
    assert again.count() == 0  # the last batch comes again


def test_only_touched_keys_are_worked_out(spark):
    rng = random.Random(1)
    ledgers = some(rng, 0, 8)
    frames = {n: spark.createDataFrame(rows, TYPES[n]) for n, rows in ledgers.items()}
    batch = {"brands": spark.createDataFrame([(2, False, 1)], TYPES["brands"])}
    after = frames | {"brands": frames["brands"].unionByName(batch["brands"])}
    keys = {r[0] for r in deltas.touched(VIEW, after, batch).collect()}
    of_brand = {r[0] for r in ledgers["parts"] if r[1] == 2}
    assert keys == {r[0] for r in ledgers["revisions"] if r[1] in of_brand} and 0 < len(keys) < 32
    held = deltas.standing(VIEW, after, deltas.touched(VIEW, after, batch))
    assert {r["item"] for r in held.collect()} <= keys


@pytest.mark.parametrize("batch", [{}, {"revisions": []}])
def test_nothing_new_changes_nothing(spark, batch):
    ledgers = {n: spark.createDataFrame([], t) for n, t in TYPES.items()}
    state = spark.createDataFrame([(1, 1, "a", 0)], TYPES["revisions"])
    assert deltas.changes(VIEW, state, ledgers, {n: spark.createDataFrame(r, TYPES[n]) for n, r in batch.items()}).count() == 0
