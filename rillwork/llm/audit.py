"""How the filters of a corpus interact: what each filter removes under every order of them, by part of the corpus.

1. Each document gets a mask: a bit for each filter that it fails on its own, whatever the other filters do. Documents are counted by (part, mask) with partial aggregation, so at most 2^filters rows of a part
   go on, however many documents it has.
2. For each part a decision diagram is built over those counts: a level for each filter, at each node a branch for pass and one for fail, equal branches shared, and each node weighted with the documents below it.
3. All orders are visited so that each follows from the one before by one swap of neighbouring filters. Such a swap rewrites two neighbouring levels and leaves the rest of the diagram as it is.
   On the path of passing branches only, the weights are the steps of that order: what passes on is kept, what fails is removed.

Null texts count as empty (no words: A fails, the others pass, but E may). Null parts are the part of the empty string. A null id is neither smaller nor greater than any, so its row passes E and
makes no other row fail it. Repeated rows of one id count each, and don't make each other fail E. Labels of one id are put together by their maximum; rows without a label are neither good nor toxic.
An empty table has no parts and gives no rows. Texts are read whole. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PCT, UPPER_PCT = 200, 50, 2
_SPACES = r"[\x20\x09-\x0D]+"


def text_failures(text: Column) -> dict[str, Column]:
    """A: under 200 words; B: under half of the words distinct; C: over 2 % capital letters; D: any of # $ % & * |"""
    t = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(t, _SPACES), lambda w: w != "")
    return {
        "A": F.size(words) < MIN_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < DISTINCT_PCT * F.size(words),
        "C": 100 * F.length(F.regexp_replace(t, "[^A-Z]+", "")) > UPPER_PCT * F.length(t),
        "D": t.rlike("[#$%&*|]"),
    }


def failed_masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, mask, good, toxic of each document; bit k of mask is the failure of the k-th of FILTERS.

    E, the filter of repeated texts, is decided by SHA-256 of the text: what several ids share is a small table of digests, and rows without texts meet it (a hot digest is split by the skew join).
    """
    digest = F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))
    fails = text_failures(F.col(text_col))
    mask = reduce(lambda a, b: a + b, [fails[f].cast("int") * (1 << FILTERS.index(f)) for f in fails])
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), mask.alias("mask"), digest.alias("digest"))
    shared = docs.select(F.col(id_col).alias("doc_id"), digest.alias("digest")).groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("last > first").drop("last")
    marks = labels.select("doc_id", (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic")).groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    again = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).cast("int") * (1 << FILTERS.index("E"))
    rows = rows.join(shared, "digest", "left").select("doc_id", "part", (F.col("mask") + again).alias("mask")).join(marks, "doc_id", "left")
    return rows.select("part", "mask", *[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("good", "toxic")])


class _Node:
    __slots__ = ("lo", "hi", "total")

    def __init__(self, lo, hi, total: tuple):  # noqa: ANN001
        self.lo, self.hi, self.total = lo, hi, total


class Diagram:
    """A decision diagram over counts by mask. Each path visits each level; nodes of a level with the same branches are one."""

    def __init__(self, counts: dict[int, tuple], n_filters: int):
        width = len(next(iter(counts.values()))) if counts else 1
        self.order = list(range(n_filters))
        leaves: dict[tuple, _Node] = {}

        def leaf(mask: int) -> _Node:
            v = counts.get(mask, (0,) * width)
            return leaves.setdefault(v, _Node(None, None, v))

        self.levels: list[list[_Node]] = [[] for _ in range(n_filters)]
        row = [leaf(m) for m in range(1 << n_filters)]
        # row[m] is the node below the choices in m; the highest filter's level comes first from below
        for k in reversed(range(n_filters)):
            table: dict = {}
            row = [self._node(table, row[m], row[m | 1 << k]) for m in range(1 << k)]
            self.levels[k] = list(table.values())
        self.root = row[0]

    @staticmethod
    def _node(table: dict, lo: _Node, hi: _Node) -> _Node:
        key = (id(lo), id(hi))
        if key not in table:
            table[key] = _Node(lo, hi, tuple(a + b for a, b in zip(lo.total, hi.total, strict=True)))
        return table[key]

    def swap(self, k: int) -> None:
        """Levels k and k + 1 change places. Nodes of level k stay what they count, so nothing above them changes."""
        table: dict = {}
        for n in self.levels[k]:
            a, b = n.lo, n.hi
            n.lo, n.hi = self._node(table, a.lo, b.lo), self._node(table, a.hi, b.hi)
        self.levels[k + 1] = list(table.values())
        self.order[k], self.order[k + 1] = self.order[k + 1], self.order[k]

    def steps(self) -> list[tuple[int, tuple, tuple]]:
        """(filter, counts kept after it, counts removed by it) along the path that passes all."""
        out, n = [], self.root
        for f in self.order:
            out.append((f, n.lo.total, n.hi.total))
            n = n.lo
        return out


def plain_changes(n: int) -> Iterator[int]:
    """Places k whose swaps with k + 1, one after another, lead through all orders of n things."""
    if n < 2:
        return
    down = True
    for k in [*plain_changes(n - 1), None]:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        if k is not None:
            # the last thing now stands at the left end after going down, so the others' places are one further
            yield k + 1 if down else k
        down = not down


def order_steps(counts: dict[int, tuple], names: str) -> list[tuple]:
    """(order, step, kept, removed, redundant, unique_fails, *lost by further counts, shapley) for all orders of the filters."""
    d, rows, fails, alone, total = Diagram(counts, len(names)), [], {}, {}, dict.fromkeys(range(len(names)), 0)
    changes = plain_changes(len(names))
    while True:
        steps = d.steps()
        label = "".join(names[f] for f, _, _ in steps)
        for k, (f, kept, removed) in enumerate(steps):
            rows.append((label, k + 1, f, kept[0], removed))
            total[f] += removed[0]
        fails[steps[0][0]], alone[steps[-1][0]] = steps[0][2][0], steps[-1][2][0]
        k = next(changes, None)
        if k is None:
            break
        d.swap(k)
    return [(label, step, kept, removed[0], fails[f] - removed[0], alone[f], *removed[1:], total[f]) for label, step, f, kept, removed in rows]


_STEPS = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *[(c, pa.int64()) for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")]])
_STEPS_DDL = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def interactions(masks: DataFrame, names: str = FILTERS) -> DataFrame:
    """From part, mask, good and toxic of each document: a row for each part, order of the filters (all of them, so names are few) and step.

    kept, removed: documents after and by this step; redundant: those that fail its filter and were removed earlier; unique_fails: those that fail its filter only; good_lost and toxic_lost: of those removed;
    shapley: what its filter removes, summed over all orders.
    """
    counts = masks.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, rows in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got = order_steps({r["mask"]: (r["n"], r["good"], r["toxic"]) for r in rows}, names)
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(got)), *[pa.array(c, t) for c, t in zip(zip(*got, strict=True), _STEPS.types[1:], strict=True)]], schema=_STEPS)

    return parts.mapInArrow(apply, _STEPS_DDL)


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of FILTERS over all orders, by source."""
    return interactions(failed_masks(docs, labels))
