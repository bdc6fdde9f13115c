"""Repair of conversation structure: the cheapest edits that make each conversation an optional system row and then pairs of user and assistant rows.

Edits of a row: Keep (0), Rerole to user or assistant (3), Delete (4; the only one for blank and repeated rows), and Insert of a row without text anywhere (3). A truncated row that stays costs 3 more.
Of all cheapest edit lists the one whose initials, in order, come first in ASCII is taken.

1. Rows are sorted by conversation and turn across partitions and cut into segments of at most SEGMENT rows, a conversation going on in as many segments as it needs. Nearly all conversations are one segment.
2. A segment's edits are shortest paths in the edit lattice, whose nodes are (rows done, what the output ends with). Two searches, one from either end, take nodes from their heaps in turns. When the
   two least costs together exceed the best meeting, every crossing of that cost is known; the least concatenation of a forward and a reverse audit is the answer. No cheapest audit between two nodes
   is the beginning of another (it would differ by inserts, which cost), so least parts make the least whole.
3. A conversation of several segments: for each segment the audits between all pairs of states are searched, and such tables are put together in groups of FAN, round by round, like products of small
   matrices. Repeats of a row in an earlier segment are found by digests. No task holds more than a segment's rows or a group's tables (whose audits grow to one letter an edit).

Conversations: nulls of any column count as one space, but a null turn comes before all others and doesn't count for gaps. Rows of one turn are ordered by the first 32 characters of the role, the first 64 of the text
and a hash of both; equal rows are neighbours, so all but the first are repeats. Roles count by their first character, case and all: `u`, `a`, `s`; others can only be reroled or deleted. A system row after
the first output row can't be kept. Rows of a null conversation are one conversation. An empty table gives an empty table. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .neardup import shared_checkpoints

SEGMENT, SEGMENT_CHARS, FAN = 256, 1 << 20, 64
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
REROLE = INSERT = TRUNCATED = 3
DELETE = 4
_SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
_FAR = (1 << 60, "")


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that crc32 of `conv_id:turn`, modulo 20, deals: 0 drops a row, 1 empties its text, 2 removes its sentence ends, 3 repeats it, 4 makes it the user's."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    harm = F.crc32(F.concat(named[0], F.lit(":"), named[1]).cast("binary")) % 20
    role, text = F.coalesce(F.col("role"), F.lit(" ")), F.coalesce(F.col("text"), F.lit(" "))
    d = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.when(harm == 4, "user").otherwise(role).alias("role"),
        F.when(harm == 1, "").when(harm == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(harm == 0, 0).when(harm == 3, 2).otherwise(1))).alias("copy"),
    )
    return d.drop("copy")


def _into(state: int, user: bool) -> int | None:
    """The state after an output row of the user, or of the assistant; None where it isn't allowed."""
    if user:
        return USER if state != USER else None
    return ASSISTANT if state == USER else None


def _kept(state: int, initial: str) -> int | None:
    if initial == "s":
        return SYSTEM if state == START else None
    return _into(state, initial == "u") if initial in ("u", "a") else None


@lru_cache(1 << 16)
def cheapest(rows: str, entry: int, exits: tuple[int, ...]) -> tuple[int, str] | None:
    """(cost, least audit) of the edits that lead from the state entry to one of exits.

    rows: a letter for each row: the role's initial u, a, s, or x for others, in upper case if truncated; d for a row that must go. None where no edits lead there.
    """
    n = len(rows)

    def edges(i: int, state: int) -> Iterator[tuple[int, int, int, str]]:
        for user in (True, False):
            to = _into(state, user)
            if to is not None:
                yield i, to, INSERT, "I"
        if i < n:
            yield i + 1, state, DELETE, "D"
            c = rows[i]
            if c != "d":
                more = TRUNCATED if c.isupper() else 0
                to = _kept(state, c.lower())
                if to is not None:
                    yield i + 1, to, more, "K"
                for user in (True, False):
                    to = _into(state, user)
                    if to is not None:
                        yield i + 1, to, REROLE + more, "R"

    def edges_into(i: int, state: int) -> Iterator[tuple[int, int, int, str]]:
        for at in (i, i - 1) if i else (i,):
            for was in range(4):
                for j, to, cost, letter in edges(at, was):
                    if j == i and to == state:
                        yield at, was, cost, letter

    # labels: (cost, least audit) from the entry, and to an exit; equal costs are settled in the order in which free edges (all K) lead on
    labels: tuple[dict, dict] = ({(0, entry): (0, "")}, {(n, x): (0, "") for x in exits})
    heaps: tuple[list, list] = ([(0, 0, entry)], [(0, 0, x) for x in exits])
    done: tuple[set, set] = (set(), set())
    best = _FAR[0]
    while heaps[0] and heaps[1] and heaps[0][0][0] + heaps[1][0][0] <= best:
        side = 0 if len(heaps[0]) <= len(heaps[1]) else 1
        cost, at, state = heappop(heaps[side])
        node = (at if side == 0 else n - at, state)
        if node in done[side]:
            continue
        done[side].add(node)
        audit = labels[side][node][1]
        if node in labels[1 - side]:
            best = min(best, cost + labels[1 - side][node][0])
        for i, to, more, letter in edges(*node) if side == 0 else edges_into(*node):
            new = (cost + more, audit + letter if side == 0 else letter + audit)
            if new < labels[side].get((i, to), _FAR):
                labels[side][(i, to)] = new
                heappush(heaps[side], (new[0], i if side == 0 else n - i, to))
                if (i, to) in labels[1 - side]:
                    best = min(best, new[0] + labels[1 - side][(i, to)][0])
    if best == _FAR[0]:
        return None
    settled = (done[0] | {(0, entry)}, done[1] | {(n, x) for x in exits})
    crossings = []
    for node in settled[0]:
        cost, audit = labels[0][node]
        if node in settled[1] and cost + labels[1][node][0] == best:
            crossings.append(audit + labels[1][node][1])
        for i, to, more, letter in edges(*node):
            if (i, to) in settled[1] and cost + more + labels[1][(i, to)][0] == best:
                crossings.append(audit + letter + labels[1][(i, to)][1])
    return best, min(crossings)


def rebuilt(audit: str, entry: int, roles: list[str], texts: list[str]) -> list[tuple[str, str]]:
    """The output rows (role, text) that an audit makes of a segment's rows."""
    out, state, i = [], entry, 0
    for letter in audit:
        if letter == "K":
            state = _kept(state, roles[i][:1])
            out.append((roles[i], texts[i]))
        elif letter != "D":
            state = _into(state, state != USER)
            out.append(("user" if state == USER else "assistant", texts[i] if letter == "R" else ""))
        i += letter != "I"
    return out


def faults(roles: list[str], texts: list[str], seen_before: set[int] = frozenset()) -> tuple[str, list[int], list[bytes]]:
    """(a letter for each row as `cheapest` reads them, numbers of blank, repeated and truncated rows, digests of the rows that are neither blank nor repeated). seen_before: rows that an earlier segment has."""
    out, count, seen, digests = [], [0, 0, 0], set(), []
    for k, (role, text) in enumerate(zip(roles, texts, strict=True)):
        end = text.rstrip(_SPACES)[-1:]
        digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode(errors="surrogatepass")).digest()
        again, _ = digest in seen or k in seen_before, seen.add(digest)
        digests.append(digest)
        if not end or again:
            count[0 if not end else 1] += 1
            out.append("d")
        else:
            cut = end not in ".!?"
            count[2] += cut
            letter = role[:1] if role[:1] in ("u", "a", "s") else "x"
            out.append(letter.upper() if cut else letter)
    return "".join(out), count, digests


def _illegal(roles: list[str], before: str | None = None) -> int:
    initials = ([] if before is None else [before[:1]]) + [r[:1] for r in roles]
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials[:-1], initials[1:], strict=True))


def segments(rows: DataFrame) -> DataFrame:
    """conv_id, seg (in order within a conversation), whole (it is all of the conversation), turns, roles, texts, from conv_id, turn, role, text; checkpointed, as several steps read it."""
    shared_checkpoints(rows.sparkSession)
    # equal rows may be dealt to two partitions, by their place in the input
    keys = ["conv_id", "turn", "r", "t", "h", "tie"]
    d = rows.select("conv_id", "turn", "role", "text").withColumns({"r": F.substring("role", 1, 32), "t": F.substring("text", 1, 64), "h": F.xxhash64("role", "text"), "tie": F.monotonically_increasing_id()})
    d = d.repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv_id", "turn", "role", "text")
    schema = pa.schema([("conv_id", pa.int64()), ("seg", pa.int64()), ("whole", pa.bool_()), ("turns", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made, out = TaskContext.get().partitionId(), 0, []
        conv, held, chars, open_ = None, [], 0, True  # open_: the conversation may have begun before these rows

        def cut(ended: bool) -> None:
            nonlocal made, held, chars, open_
            turns, roles, texts = (list(c) for c in zip(*held, strict=True))
            out.append((conv, part << 32 | made, ended and not open_, turns, roles, texts))
            made, held, chars = made + 1, [], 0
            open_ = True

        def batch() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
            out.clear()
            return got

        for b in batches:
            for a in range(0, b.num_rows, 512):
                for c, turn, role, text in zip(*(b.column(k).slice(a, 512).to_pylist() for k in range(4)), strict=True):
                    if held and c != conv:
                        cut(True)
                        open_ = False
                    elif len(held) >= SEGMENT or chars >= SEGMENT_CHARS:
                        cut(False)
                    conv = c
                    held.append((turn, role, text))
                    chars += len(text)
                if len(out) >= 256:
                    yield batch()
        if held:
            cut(False)  # the next partition may go on with it
        if out:
            yield batch()

    return d.mapInArrow(apply, "conv_id long, seg long, whole boolean, turns array<long>, roles array<string>, texts array<string>").checkpoint()


_FIXED = pa.schema([("conv_id", pa.int64()), ("seg", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("distinct_turns", pa.int64()), *[(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()),
    ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])
_FIXED_DDL = "conv_id long, seg long, lo long, hi long, distinct_turns long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, roles array<string>, texts array<string>"


def _fixed_row(conv: int | None, seg: int, turns: list, last_turn: int | None, roles: list[str], texts: list[str], count: list[int], illegal: int, cost: int, audit: str, entry: int) -> tuple:
    known = [t for t in turns if t is not None]
    lines = rebuilt(audit, entry, roles, texts)
    distinct = len(set(known) - {last_turn})
    return conv, seg, min(known, default=None), max(known, default=None), distinct, *count, illegal, cost, audit, [r for r, _ in lines], [t for _, t in lines]


def _fixed_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _FIXED.types, strict=True)], schema=_FIXED)


def _repaired_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for a in range(0, b.num_rows, 256):
            rows = []
            for conv, seg, turns, roles, texts in zip(*(b.column(k).slice(a, 256).to_pylist() for k in range(5)), strict=True):
                letters, count, _ = faults(roles, texts)
                cost, audit = cheapest(letters, START, ENDS)
                rows.append(_fixed_row(conv, seg, turns, None, roles, texts, count, _illegal(roles), cost, audit, START))
            yield _fixed_batch(rows)


# --- conversations of several segments


def _tables(parts: DataFrame) -> DataFrame:
    """For each segment: the cheapest audits between states, as (entry, exit, cost, audit, cuts); cuts holds (seg, where its audit begins, its entry)."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                letters, _, _ = faults(row["roles"], row["texts"], set(row["repeats"]))
                table = []
                for entry in range(4) if row["idx"] else (START,):
                    for x in range(4):
                        got = cheapest(letters, entry, (x,))
                        if got:
                            table.append({"entry": entry, "exit": x, "cost": got[0], "audit": got[1], "cuts": [{"seg": row["seg"], "at": 0, "entry": entry}]})
                yield pa.RecordBatch.from_arrays([pa.array([row["key"]]), pa.array([row["idx"]], pa.int64()), pa.array([table], _TABLE)], ["key", "idx", "table"])

    return parts.mapInArrow(apply, f"key string, idx long, table {_TABLE_DDL}")


_CUT = pa.struct([("seg", pa.int64()), ("at", pa.int64()), ("entry", pa.int32())])
_TABLE = pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string()), ("cuts", pa.list_(_CUT))]))
_TABLE_DDL = "array<struct<entry:int,exit:int,cost:long,audit:string,cuts:array<struct<seg:long,at:long,entry:int>>>>"


def joined_tables(a: list[dict], b: list[dict]) -> list[dict]:
    """The table of two neighbouring stretches: for each pair of states the cheapest way through, and the least audit of those."""
    out: dict = {}
    for x in a:
        for y in b:
            if x["exit"] == y["entry"]:
                key, cost = (x["entry"], y["exit"]), x["cost"] + y["cost"]
                if key not in out or (cost, x["audit"] + y["audit"]) < out[key][0]:
                    out[key] = (cost, x["audit"] + y["audit"]), x, y
    return [
        {"entry": e, "exit": z, "cost": best[0], "audit": best[1], "cuts": x["cuts"] + [{"seg": c["seg"], "at": c["at"] + len(x["audit"]), "entry": c["entry"]} for c in y["cuts"]]}
        for (e, z), (best, x, y) in out.items()
    ]


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(b.num_rows):
            row = b.slice(k, 1).to_pylist()[0]
            tables = [t["table"] for t in row["tables"]]
            while len(tables) > 1:
                tables = [joined_tables(*tables[j : j + 2]) if j + 1 < len(tables) else tables[j] for j in range(0, len(tables), 2)]
            yield pa.RecordBatch.from_arrays([pa.array([row["key"]]), pa.array([row["idx"]], pa.int64()), pa.array([tables[0]], _TABLE)], ["key", "idx", "table"])


def _repaired_parts(parts: DataFrame) -> DataFrame:
    """The repaired segments of conversations that have several (or may have)."""
    # numbers of one conversation's segments meet in one task, without their rows: an audit is one string, which bounds them
    by_seg = Window.partitionBy("key").orderBy("seg")
    p = parts.withColumn("key", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    # each row's first place; a row's text is compared by digest
    row = F.explode(F.arrays_zip(F.sequence(F.lit(0), F.size("roles") - 1).alias("k"), F.col("roles").alias("role"), F.col("texts").alias("text")))
    each = p.select("key", "seg", row.alias("x")).select("key", "seg", F.col("x.k").alias("k"), F.sha2(F.concat(F.length("x.role").cast("string"), F.lit(":"), "x.role", "x.text").cast("binary"), 256).alias("digest"))
    first = each.groupBy("key", "digest").agg(F.min(F.struct("seg", "k")).alias("first"))
    repeats = each.join(first, ["key", "digest"]).filter(F.col("first.seg") < F.col("seg")).groupBy("key", "seg").agg(F.collect_list("k").alias("repeats"))
    about = p.select("key", "seg", F.element_at("roles", -1).alias("role"), F.array_max("turns").alias("turn"))
    about = about.select("key", "seg", (F.row_number().over(by_seg) - 1).cast("long").alias("idx"), F.lag("role").over(by_seg).alias("last_role"), F.max("turn").over(by_seg.rowsBetween(Window.unboundedPreceding, -1)).alias("last_turn"))
    p = p.join(about, ["key", "seg"]).join(repeats, ["key", "seg"], "left").withColumn("repeats", F.coalesce("repeats", F.array().cast("array<int>"))).checkpoint()
    tables = _tables(p.select("key", "seg", "idx", "roles", "texts", "repeats")).checkpoint()
    # groups of neighbours, until each conversation has one table
    while (most := tables.agg(F.max("idx")).first()[0]) is not None and most > 0:
        tables = tables.groupBy("key", F.floor(F.col("idx") / FAN).alias("idx")).agg(F.array_sort(F.collect_list(F.struct("idx", "table"))).alias("tables")).mapInArrow(_together, f"key string, idx long, table {_TABLE_DDL}").checkpoint()
    ways = tables.select("key", F.explode("table").alias("w")).filter(F.col("w.entry") == START).filter(F.col("w.exit").isin(*ENDS))
    best = ways.groupBy("key").agg(F.min(F.struct("w.cost", "w.audit", "w.cuts")).alias("w")).select("key", "w.*")
    # each segment's own part of the audit
    stop = F.coalesce(F.try_element_at("cuts", F.col("pos") + 2)["at"], F.length("audit").cast("long"))
    cut = best.select("key", "audit", "cuts", "cost", F.posexplode("cuts").alias("pos", "c"))
    cut = cut.select("key", F.col("c.seg").alias("seg"), F.col("c.entry").alias("entry"), F.col("cost"), F.expr("pos = 0").alias("leads"), F.substring("audit", (F.col("c.at") + 1).cast("int"), (stop - F.col("c.at")).cast("int")).alias("audit"))
    done = p.join(cut, ["key", "seg"]).select("conv_id", "seg", "turns", "roles", "texts", "repeats", "last_role", "last_turn", "audit", "entry", "cost", "leads")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                r = b.slice(k, 1).to_pylist()[0]
                _, count, _ = faults(r["roles"], r["texts"], set(r["repeats"]))
                # a conversation's cost is carried by its first segment
                yield _fixed_batch([_fixed_row(r["conv_id"], r["seg"], r["turns"], r["last_turn"], r["roles"], r["texts"], count, _illegal(r["roles"], r["last_role"]), r["cost"] if r["leads"] else 0, r["audit"], r["entry"])])

    return done.mapInArrow(apply, _FIXED_DDL)


def _halves(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    parts = segments(rows)
    whole = parts.filter("whole").select("conv_id", "seg", "turns", "roles", "texts").mapInArrow(_repaired_whole, _FIXED_DDL)
    return whole, _repaired_parts(parts.filter("NOT whole"))


def repair(rows: DataFrame) -> DataFrame:
    """Repaired segments of conversations (conv_id, turn, role, text): conv_id, seg, the segment's numbers, its audit, and roles and texts of its output rows, in order of seg within a conversation."""
    whole, parts = _halves(rows)
    return whole.unionByName(parts)


def repaired_rows(rows: DataFrame) -> DataFrame:
    """conv_id, seg, place, role, text of all rows after the repair."""
    d = repair(rows).select("conv_id", "seg", F.posexplode(F.arrays_zip("roles", "texts")).alias("place", "x"))
    return d.select("conv_id", "seg", "place", F.col("x.roles").alias("role"), F.col("x.texts").alias("text"))


_REPORT = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("repaired_sha256", pa.string())])
_REPORT_DDL = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def report(conversations: DataFrame) -> DataFrame:
    """A row for each conversation of the damaged table: its gaps and faults, the cost and audit of the repair, and the digest of the repaired rows. The segments of a conversation that has several stream through one task, as SHA-256 must."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, out = object(), None, []

        def close() -> None:
            if state is not None:
                lo, hi, distinct, numbers, audit, sha, _ = state
                gaps = 0 if lo is None else min(hi - lo + 1 - distinct, (1 << 63) - 1)
                out.append((conv, gaps, *numbers, "".join(audit), sha.hexdigest()))

        def batch() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _REPORT.types, strict=True)], schema=_REPORT)
            out.clear()
            return got

        for b in batches:
            for a in range(0, b.num_rows, 256):
                for r in zip(*(b.column(k).slice(a, 256).to_pylist() for k in range(b.num_columns)), strict=True):
                    if r[0] != conv or state is None:
                        close()
                        conv, state = r[0], [None, None, 0, [0] * 5, [], hashlib.sha256(), False]
                    _, _, lo, hi, distinct, *numbers, audit, roles, texts = r
                    if lo is not None:
                        state[0], state[1] = lo if state[0] is None else min(lo, state[0]), hi if state[1] is None else max(hi, state[1])
                    state[2] += distinct
                    state[3] = [x + y for x, y in zip(state[3], numbers, strict=True)]
                    state[4].append(audit)
                    for role, text in zip(roles, texts, strict=True):
                        state[5].update((("\n" if state[6] else "") + f"{role}:{text}").encode(errors="surrogatepass"))
                        state[6] = True
                if out:
                    yield batch()
        close()
        if out:
            yield batch()

    whole, parts = _halves(damaged(conversations))
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    done = whole.mapInArrow(apply, _REPORT_DDL).unionByName(parts.repartition("conv_id").sortWithinPartitions("conv_id", "seg").mapInArrow(apply, _REPORT_DDL))
    out = ids.alias("a").join(done.alias("b"), F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")), "left")
    zero = [F.coalesce(F.col(f"b.{c}"), F.lit(0)).cast(T.LongType()).alias(c) for c in _REPORT.names[1:7]]
    return out.select("a.conv_id", *zero, F.coalesce("b.audit", F.lit("")).alias("audit"), F.coalesce("b.repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
