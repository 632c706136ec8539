"""From plan to delivery: competing events of a document, folded in order into its state.

Events of one document are read in order by one task, whatever their number, with its state alone in memory; documents are dealt over all tasks.
Nothing is locked: of events that expect the same version the first one wins, and the others are told that they came too late.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .latest import latest_per_key

KINDS = ("plan", "generate", "bind", "report", "deliver")
_IN = ("document", "seq", "token", "kind", "expected", "shortage", "progress", "content", "evidence", "gates", "complete")


class State(NamedTuple):
    status: str = "none"
    version: int = 0
    content: str | None = None


def step(now: State, kind: str, shortage: int | None, progress: bool | None, content: str | None, evidence: str | None, gates: bool | None, complete: bool | None) -> tuple[State | None, str | None]:
    """The next state, or the reason why there is none."""
    after = lambda status, held=now.content: (State(status, now.version + 1, held), None)
    if kind == "plan":
        return after("shortage" if shortage else "selected") if now.status in ("none", "shortage") else (None, "wrong_state")
    if kind == "report":
        if now.status not in ("pending_review", "passed", "blocked"):
            return None, "wrong_state"
        if evidence is None or evidence != now.content:
            return None, "evidence_mismatch"
        return after("passed" if gates else "blocked")
    allowed = {"generate": ("selected",), "bind": ("draft", "pending_review", "passed", "blocked"), "deliver": ("passed",)}.get(kind)
    if allowed is None or now.status not in allowed:
        return None, "wrong_state" if allowed else "unknown_kind"
    if not progress:
        return None, "progress_changed"
    if kind == "generate":
        return after("draft")
    if kind == "bind":
        held = (content or "").strip()
        return after("pending_review", held) if held else (None, "content_hash_missing")
    return after("delivered") if complete else (None, "usage_incomplete")


def fold(events: DataFrame) -> DataFrame:
    """document, seq, token, kind, outcome (applied, repeated or conflict), reason, and the document's status, version and content behind each event.

    events: document, seq, token (of one request, the same when it is sent again), kind, expected (the version it was made for; null: any), and what was found
    out before: shortage (items that lack), progress (whether the class's active progress is still the plan's), content and evidence (hashes of the artifact and of what the
    report saw), gates (whether all passed), complete (whether there is one usage row for each bound item).

    An event whose token was applied before is repeated and changes nothing; one that expects another version is a conflict (stale_version), as is
    one that the state does not allow. Events without a document or kind are conflicts of their own. Ties of seq go by token.
    """
    kinds = dict(events.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, now, applied = object(), State(), set()
        for batch in batches:
            out = []
            for document, _, token, kind, expected, *found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if document != last or document is None:
                    last, now, applied = document, State(), set()
                if token is not None and token in applied:
                    out.append(("repeated", None, *now))
                    continue
                if document is None or kind is None:
                    after, reason = None, "unknown_kind" if document is not None else "document_missing"
                elif expected is not None and expected != now.version:
                    after, reason = None, "stale_version"
                else:
                    after, reason = step(now, kind, *found)
                if after is not None:
                    now = after
                    applied.add(token)
                out.append(("applied" if after is not None else "conflict", reason, *now))
            told = list(zip(*out, strict=True)) if out else [()] * 5
            types = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *(pa.array(c, t) for c, t in zip(told, types, strict=True))], names=[*_IN[:4], "outcome", "reason", "status", "version", "content"])

    schema = ", ".join(f"{c} {kinds[c]}" for c in _IN[:4]) + ", outcome string, reason string, status string, version long, content string"
    # One pass over events sorted within the tasks that hold their documents: no document's events are gathered in memory.
    return events.select(*_IN).repartition("document").sortWithinPartitions("document", "seq", "token").mapInArrow(run, schema)


def states(folded: DataFrame) -> DataFrame:
    """document, status, version and content as they are now."""
    return latest_per_key(folded.where("document IS NOT NULL"), ["document"], ["seq", "token"], ["status", "version", "content"])


def usage_rows(folded: DataFrame, bound: DataFrame) -> DataFrame:
    """document, item, seq: a row for each bound item (document, item) of the documents whose delivery was applied, once."""
    delivered = folded.where("kind = 'deliver' AND outcome = 'applied'").groupBy("document").agg(F.min("seq").alias("seq"))
    return bound.select("document", "item").distinct().join(delivered, "document")
