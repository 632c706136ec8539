"""Many patterns at once: which of a table of literal patterns a text holds, each text read once, and rules over what was found.

A pattern is met at one of its grams (three code points, fewer where it is shorter, as one number): the one that fewest patterns share. A table of bits over
hashed grams rules out almost all places of a text, what is left is looked up among the grams and compared letter by letter. This takes one
pass of vector operations a text, whatever the number of patterns, and patterns are data, never code.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Code points of all patterns up to which tasks hold them; beyond, texts' grams are joined with the patterns'.
HELD = 1 << 24
#: Code points of texts handled at once; a longer text is handled alone.
STEP = 1 << 19
_BITS = 22
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and where each begins."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.concatenate([[0], np.cumsum(size)])


def _grams(points: np.ndarray, n: int) -> np.ndarray:
    """n code points from each place on, as one number: 21 bits each, and a bit before them."""
    size = max(0, len(points) - n + 1)
    out = np.ones(size, np.uint64)
    for k in range(n):
        out = out << np.uint64(21) | points[k : k + size].astype(np.uint64)
    return out


def _slot(grams: np.ndarray) -> np.ndarray:
    return (grams * _ODD >> np.uint64(64 - _BITS)).astype(np.int64)


class Patterns:
    """Non-empty patterns by their gram. ids: any numbers."""

    def __init__(self, ids: list[int], texts: list[str]):
        self.ids = np.array(ids, np.int64)
        self.points, self.at = _points(texts)
        self.size = np.diff(self.at)
        self.of: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in (1, 2, 3):
            own = np.flatnonzero(self.size == n if n < 3 else self.size >= 3)
            if not len(own):
                continue
            every = _grams(self.points, n)
            many = self.size[own] - n + 1
            who = np.repeat(own, many)
            off = np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many)
            gram = every[self.at[who] + off]
            shared = np.unique(np.stack([gram, who.astype(np.uint64)], 1), axis=0)[:, 0]
            found, count = np.unique(shared, return_counts=True)
            order = np.lexsort((off, count[np.searchsorted(found, gram)], who))
            first = order[np.flatnonzero(np.append(True, who[order][1:] != who[order][:-1]))]
            who, off, gram = who[first], off[first], gram[first]
            by = np.argsort(gram, kind="stable")
            bits = np.zeros(1 << _BITS, bool)
            bits[_slot(gram)] = True
            self.of[n] = gram[by], who[by], off[by], bits

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """(id, gram) of each pattern."""
        parts = [(self.ids[who], gram) for gram, who, _, _ in self.of.values()]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.uint64))

    def first_places(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, pattern's id, place) of the first time that each text holds a pattern."""
        points, begin = _points(texts)
        found = [(np.zeros(0, np.int64),) * 2]
        for n, (gram, who, off, bits) in self.of.items():
            every = _grams(points, n)
            place = np.flatnonzero(bits[_slot(every)])
            low, high = np.searchsorted(gram, every[place], "left"), np.searchsorted(gram, every[place], "right")
            many = high - low
            place = np.repeat(place, many)
            k = np.repeat(low - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
            start, pattern = place - off[k], who[k]
            text = np.searchsorted(begin, place, "right") - 1
            good = (start >= begin[text]) & (start + self.size[pattern] <= begin[text + 1])
            start, pattern = start[good], pattern[good]
            live, step = np.arange(len(start)), 0
            same = np.ones(len(start), bool)
            while len(live):
                differ = points[start[live] + step] != self.points[self.at[pattern[live]] + step]
                same[live[differ]] = False
                step += 1
                live = live[~differ]
                live = live[self.size[pattern[live]] > step]
            found.append((start[same], pattern[same]))
        start, pattern = (np.concatenate(x) for x in zip(*found, strict=True))
        text = np.searchsorted(begin, start, "right") - 1
        order = np.lexsort((start, pattern, text))
        text, pattern, start = text[order], pattern[order], start[order]
        new = np.append(True, (text[1:] != text[:-1]) | (pattern[1:] != pattern[:-1]))[: len(text)]
        return text[new], self.ids[pattern[new]], start[new] - begin[text[new]]


def _batches(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of about STEP code points at once."""
    texts = [t or "" for t in column.to_pylist()]
    i = 0
    while i < len(texts):
        j, many = i, 0
        while j < len(texts) and (j == i or many + len(texts[j]) <= STEP):
            many += len(texts[j])
            j += 1
        yield i, texts[i:j]
        i = j


def hits(texts: DataFrame, patterns: DataFrame, id_col: str, text_col: str, pattern_id: str = "pattern_id", pattern: str = "pattern", held: int = HELD) -> DataFrame:
    """id_col, pattern_id and first (the place, in code points from 0) for each row of texts and each pattern that it holds.

    pattern_id: whole numbers, each once. Null and empty patterns are held by nothing, null texts hold nothing; rows that repeat are told like
    others. Patterns of more than `held` code points together stay distributed: the grams of texts are joined with the patterns' grams, and what
    meets is looked for in the text.
    """
    kind = dict(texts.dtypes)[id_col]
    real = patterns.where(F.length(pattern) > 0).select(F.col(pattern_id).cast("long").alias("pattern_id"), F.col(pattern).alias("pattern"))
    rows = texts.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    if (real.agg(F.sum(F.length("pattern"))).first()[0] or 0) <= held:
        kept = real.collect()  # of bounded size
        table = Patterns([r[0] for r in kept], [r[1] for r in kept])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i, own in _batches(batch.column(1)):
                    text, who, place = table.first_places(own)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text + i)), pa.array(who), pa.array(place.astype(np.int32))], names=["_id", "pattern_id", "first"])

        return rows.mapInArrow(run, f"_id {kind}, pattern_id long, first int").withColumnRenamed("_id", id_col)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = Patterns(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            who, gram = own.anchors()
            text = dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(who), pa.array([text[w] for w in who.tolist()], pa.string()), pa.array(gram.view(np.int64))], names=["pattern_id", "pattern", "gram"])

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(1).to_pylist()):
                points, _ = _points([text or ""])
                found = np.unique(np.concatenate([_grams(points, n) for n in (1, 2, 3)]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(len(found), i))), pa.array(found.view(np.int64))], names=["_row", "gram"])

    # A row's id may repeat: rows are known by a hash of id and text.
    keyed = rows.withColumn("_row", F.xxhash64("_id", "_text"))
    met = keyed.select("_row", "_text").mapInArrow(grams, "_row long, gram long").join(real.mapInArrow(anchors, "pattern_id long, pattern string, gram long"), "gram").select("_row", "pattern_id", "pattern").distinct()
    found = keyed.join(met, "_row").withColumn("first", F.position(F.col("pattern"), F.col("_text")) - 1).where("first >= 0")
    return found.select(F.col("_id").alias(id_col), "pattern_id", "first")


def rules_met(found: DataFrame, rules: DataFrame, id_col: str) -> DataFrame:
    """id_col and rule, where of every group of a rule some pattern was found. rules: rule, group, pattern_id."""
    all_ = rules.groupBy("rule").agg(F.count_distinct("group").alias("_all"))
    groups = found.join(rules, "pattern_id").select(id_col, "rule", "group").distinct().groupBy(id_col, "rule").agg(F.count(F.lit(1)).alias("_n"))
    return groups.join(all_, "rule").where("_n = _all").select(id_col, "rule")


def rules_of_texts(texts: DataFrame, patterns: DataFrame, rules: DataFrame, id_col: str, text_col: str, held: int = HELD) -> DataFrame:
    """id_col and rule, where of every group of a rule some pattern (pattern_id, pattern) stands in the texts of an id. rules: rule, group, pattern_id.

    A text gives one row with all it holds; rows are shuffled by id, and rules judged id by id, so no task gathers more than the rows it sorts. Where
    rules or patterns are more than `held`, what was found is joined with the rules instead.
    """
    asked = patterns.join(rules.select("pattern_id").distinct(), "pattern_id", "left_semi").where(F.length("pattern") > 0).select(F.col("pattern_id").cast("long").alias("pattern_id"), "pattern")
    said = rules.where(F.col("rule").isNotNull()).select("rule", "group", F.col("pattern_id").cast("long").alias("pattern_id")).distinct()
    if (asked.agg(F.sum(F.length("pattern"))).first()[0] or 0) > held or said.count() > held:
        return rules_met(hits(texts, patterns, id_col, text_col, held=held), rules, id_col)
    kept, rows = asked.collect(), said.collect()  # of bounded size
    known = np.array(sorted({r[0] for r in kept}), np.int64)
    table = Patterns(np.searchsorted(known, np.array([r[0] for r in kept], np.int64)).tolist(), [r[1] for r in kept])
    judge = Rules([tuple(r) for r in rows], known)
    kind, rule_kind = dict(texts.dtypes)[id_col], dict(rules.dtypes)["rule"]
    sent = said.schema["rule"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, own in _batches(batch.column(1)):
                text, who, _ = table.first_places(own)
                at = np.searchsorted(text, np.arange(len(own) + 1))
                some = np.flatnonzero(np.diff(at))
                found = pa.ListArray.from_arrays(pa.array(np.append(at[some], at[-1]).astype(np.int32)), pa.array(who.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i + some)), found], names=["_id", "found"])

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, of_last = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, own = batch.column(0).to_pylist(), batch.column(1)
            at, flat = np.concatenate([[0], np.cumsum(pc.list_value_length(own).to_numpy())]), own.flatten().to_numpy()
            start = [0, *(k for k in range(1, len(ids)) if ids[k] != ids[k - 1]), len(ids)]
            runs = [[ids[k], [flat[at[k] : at[z]]]] for k, z in zip(start, start[1:], strict=False)]
            if of_last and runs[0][0] == last:
                runs[0][1] = of_last + runs[0][1]
            elif of_last:
                runs.insert(0, [last, of_last])
            last, of_last = runs.pop()
            yield from answers(runs, batch.schema.field(0).type)
            kind_ = batch.schema.field(0).type
        if of_last:
            yield from answers([[last, of_last]], kind_)

    def answers(runs: list, type_: pa.DataType) -> Iterator[pa.RecordBatch]:
        for own, rule in judge.met([np.concatenate(found) for _, found in runs]):
            yield pa.RecordBatch.from_arrays([pa.array([runs[k][0] for k in own.tolist()], type_), pa.array([judge.names[k] for k in rule.tolist()], to_arrow_type(sent))], names=["_id", "rule"])

    found = texts.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, f"_id {kind}, found array<int>")
    return found.repartition("_id").sortWithinPartitions("_id").mapInArrow(tell, f"_id {kind}, rule {rule_kind}").withColumnRenamed("_id", id_col)


class Rules:
    """Rules by the patterns (their places in `known`) that their groups ask for."""

    def __init__(self, rows: list[tuple], known: np.ndarray):
        """rows: (rule, group, pattern's id)."""
        self.names = list(dict.fromkeys(r[0] for r in rows))
        rule = {n: k for k, n in enumerate(self.names)}
        groups = sorted({(rule[r], g is None, g) for r, g, _ in rows}, key=lambda x: x[:2])
        slot = {(r, g): k for k, (r, _, g) in enumerate(groups)}
        self.rule_of = np.array([r for r, _, _ in groups], np.int64)
        self.need = np.bincount(self.rule_of[[not none for _, none, _ in groups]], minlength=len(self.names))
        pattern = np.array([r[2] for r in rows], np.int64)
        place = np.searchsorted(known, pattern)
        there = (place < len(known)) & (known[np.minimum(place, max(len(known) - 1, 0))] == pattern) if len(known) else np.zeros(len(rows), bool)
        place, slots = place[there], np.array([slot[rule[r], g] for r, g, _ in rows], np.int64)[there]
        order = np.argsort(place, kind="stable")
        self.slots, self.at = slots[order], np.searchsorted(place[order], np.arange(len(known) + 1))

    def met(self, found: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(which of found, rule) of those whose every group has one of its patterns among what was found; about STEP rows of rules at once."""
        size = [int((self.at[f + 1] - self.at[f]).sum()) for f in found]
        i = 0
        while i < len(found):
            j, many = i, 0
            while j < len(found) and (j == i or many + size[j] <= STEP):
                many += size[j]
                j += 1
            hit, own = np.concatenate(found[i:j]), np.repeat(np.arange(i, j), [len(f) for f in found[i:j]])
            times = self.at[hit + 1] - self.at[hit]
            where = np.repeat(self.at[hit] - np.cumsum(times) + times, times) + np.arange(int(times.sum()))
            seen = np.unique(np.repeat(own, times) * len(self.rule_of) + self.slots[where])
            pair, count = np.unique(seen // max(len(self.rule_of), 1) * len(self.names) + self.rule_of[seen % max(len(self.rule_of), 1)], return_counts=True)
            good = pair[count == self.need[pair % max(len(self.names), 1)]]
            yield good // max(len(self.names), 1), good % max(len(self.names), 1)
            i = j


def signal_findings(evidence: DataFrame, texts: DataFrame, rules: DataFrame) -> DataFrame:
    """id and findings (array) of each mapping whose question shows a rule's signals while what the rule asks for is not all supported.

    evidence: id, question_id, core_theme, knowledge (array<struct<name, supported>>). texts: question_id, text. rules: rule, part (`theme`, `signal` or
    `required`), group, pattern. A rule is asked if the theme is empty or holds one of its theme patterns, and the text some pattern of every signal group;
    a required group is covered if supported knowledge holds one of its patterns. All patterns are looked for in one pass over texts, themes and names.
    """
    numbered = rules.select("pattern").distinct().select(F.xxhash64("pattern").alias("pattern_id"), "pattern")
    own = rules.select("rule", "part", "group", F.xxhash64("pattern").alias("pattern_id")).distinct()
    part = lambda name: own.where(F.col("part") == name).select("rule", "group", "pattern_id")
    signals = rules_of_texts(texts, numbered, part("signal"), "question_id", "text")
    asked = evidence.select("id", "question_id", "core_theme").join(signals, "question_id")
    themes = hits(evidence.where("core_theme <> ''").select("core_theme").distinct(), numbered, "core_theme", "core_theme").join(part("theme"), "pattern_id").select("core_theme", "rule").distinct()
    fits = themes.withColumn("_fits", F.lit(True))
    asked = asked.join(fits, ["core_theme", "rule"], "left").where("_fits OR core_theme IS NULL OR core_theme = ''").select("id", "rule")
    supported = evidence.select("id", F.explode("knowledge").alias("k")).where("k.supported").select("id", F.col("k.name").alias("name"))
    covered = hits(supported.select("name").distinct(), numbered, "name", "name").join(part("required"), "pattern_id").select("name", "rule", "group").distinct()
    covered = supported.join(covered, "name").select("id", "rule", "group").distinct()
    label = rules.where("part = 'required'").groupBy("rule", "group").agg(F.array_join(F.array_sort(F.collect_set("pattern")), "/").alias("label"))
    missing = asked.join(label, "rule").join(covered, ["id", "rule", "group"], "left_anti")
    told = missing.groupBy("id", "rule").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("group", "label"))), lambda x: x["label"]), ",").alias("_m"))
    finding = F.array(F.lit("required_knowledge_incomplete_against_question_signals"), F.concat(F.lit("question_signal_rule:"), "rule"), F.concat(F.lit("question_signal_missing_required:"), "_m"))
    return told.groupBy("id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("rule", finding.alias("f")))), lambda x: x["f"])).alias("findings"))


def leaks(paragraphs: DataFrame, tokens: DataFrame, artifact: str = "artifact", audience: str = "audience", answer_line: str | None = None) -> DataFrame:
    """artifact, index and text of paragraphs of students' artifacts that hold one of the tokens (pattern) or match `answer_line`. paragraphs: artifact,
    audience, index, text."""
    students = paragraphs.where(F.col(audience) == "student").select(artifact, "index", "text")
    numbered = tokens.select("pattern").distinct().select(F.xxhash64("pattern").alias("pattern_id"), "pattern")
    keyed = students.withColumn("_key", F.struct(F.col(artifact).alias("a"), F.col("index").alias("i")))
    told = hits(keyed.select(F.to_json("_key").alias("_json"), "text"), numbered, "_json", "text").select("_json").distinct()
    found = keyed.withColumn("_json", F.to_json("_key")).join(told.withColumn("_hit", F.lit(True)), "_json", "left")
    bad = F.coalesce(F.col("_hit"), F.lit(False))
    if answer_line:
        bad = bad | F.coalesce(F.col("text").rlike(answer_line), F.lit(False))
    return found.where(bad).select(artifact, "index", "text")
