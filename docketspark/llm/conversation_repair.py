"""Conversations brought back to turns of user and assistant by the cheapest edits.

Rows of a conversation are read in the order of turn (nulls first), role, hash of the text; equal rows stand together. Each
row's first fault counts: blank, duplicate (role and text seen earlier in the conversation), truncated (the last character
that is no white space is none of ``.!?``). Edits: Keep costs 0, Rerole to user or assistant 3, Delete 4 (blank and duplicate
rows must go), Insert of an empty turn of user or assistant 3; a truncated row that stays adds 3. The roles' initials must
then read ``(s?(ua)+)?``. Of the cheapest edits those count whose initials (D, I, K, R) come first in ASCII order.

Search: a layer of states (nothing yet, after system, after user, after assistant) for each row. A step is a macro, a run of up to two
inserts and what is done to the row; macros are prefix-free words, so they are numbered in ASCII order, and edits of the same
rows compare macro by macro. A layer keeps of each state its cost and the rank of its edits among those of the layer, in
place of the edits, and the state and macro it came from; the edits are read back from the end.

At scale: rows are sorted by ranges, so a conversation of any length is dealt over many tasks, and packed into chunks of
at most CHUNK rows. Each chunk is solved for every state it may begin in, all chunks of a batch at once; costs and ranks of a chunk
for (first state, last state) put together chunk by chunk are those of the conversation. Then each chunk, knowing its two states,
writes its turns. Only numbers of a chunk meet in the task of a conversation; the digest reads its turns as a stream.

Nulls: role and text count as one space, so a null text is blank; null ids are one conversation. An empty role is no role that may be
kept. Repeated rows count each. Other columns take no part. No rows, no result.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import cut

CHUNK = 256
#: copies of one row that a packed row stands for
COPIES = 1000
INSERT, REROLE, DELETE, TRUNCATED = 3, 3, 4, 3
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: macros in ASCII order
MACROS = sorted("I" * k + edit for k in range(3) for edit in "DKR")
#: what follows the last row, by the state after it: an end in an allowed state
TAILS = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
FAR = 1 << 40
WHITE = " \t\n\x0b\x0c\r"


def _free(state: int) -> int:
    """The state after a turn whose role may be chosen: user or assistant, whichever may follow."""
    return ASSISTANT if state == USER else USER


def _steps() -> tuple[np.ndarray, np.ndarray]:
    """Cost and number of the best macro by [kind of row, state before, state after].

    Kind 0 must be deleted; others are 1 + 2 * (system, user, assistant, other) + (1 if truncated).
    """
    cost, macro = np.full((9, 4, 4), FAR, np.int64), np.zeros((9, 4, 4), np.int64)
    for kind in range(9):
        for state in range(4):
            for number, name in enumerate(MACROS):
                after = reduce(lambda s, _: _free(s), name[:-1], state)
                price = INSERT * (len(name) - 1)
                if name[-1] == "D":
                    price += DELETE
                elif kind == 0:
                    continue
                else:
                    initial, cut_short = "sua-"[(kind - 1) // 2], (kind - 1) % 2
                    price += TRUNCATED * cut_short + (REROLE if name[-1] == "R" else 0)
                    if name[-1] == "R":
                        after = _free(after)
                    elif (after, initial) in NEXT:
                        after = NEXT[after, initial]
                    else:
                        continue
                if price < cost[kind, state, after]:  # of equal price the first in order stays
                    cost[kind, state, after], macro[kind, state, after] = price, number
    return cost, macro


COST, MACRO = _steps()


def solve(kind: np.ndarray, begin: np.ndarray, size: np.ndarray, cost: np.ndarray, parents: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Costs and ranks after the last row of each chunk, by [chunk, first state, state], and where each row's layer came from.

    cost is that before the first row. Chunks kind[begin : begin + size] are worked through row by row, all at once.
    """
    cost, rank = cost.copy(), np.zeros(cost.shape, np.int64)
    came = np.zeros((len(kind), *cost.shape[1:]), np.int8) if parents else None
    order = np.argsort(-size, kind="stable")
    for t in range(int(size.max(initial=0))):
        live = order[: int((size > t).sum())]
        k = kind[begin[live] + t]
        each = ((cost[live][:, :, :, None] + COST[k][:, None]) << 8) + rank[live][:, :, :, None] * len(MACROS) + MACRO[k][:, None]
        state = each.argmin(axis=2)
        best = np.take_along_axis(each, state[:, :, None], 2)[:, :, 0]
        cost[live] = np.minimum(best >> 8, FAR)
        key = np.where(best >> 8 >= FAR, 255, best & 255).reshape(len(live), -1)
        by = np.argsort(key, axis=1)
        ordered = np.take_along_axis(key, by, 1)
        dense = np.zeros(key.shape, np.int64)
        dense[:, 1:] = np.cumsum(ordered[:, 1:] != ordered[:, :-1], axis=1)
        placed = np.empty_like(dense)
        np.put_along_axis(placed, by, dense, 1)
        rank[live] = placed.reshape(best.shape)
        if came is not None:
            came[begin[live] + t] = state * len(MACROS) + (best & 255) % len(MACROS)
    return cost, rank, came


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, copies): what crc32 of "conv_id:turn" modulo 20 does to them.

    0 drops the row, 1 empties its text, 2 takes its ``.!?`` out, 3 repeats it, 4 sets its role to user. Null role and text are one
    space; an id or turn that is null is one space in the key.
    """
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text_of("role").alias("role"), text_of("text").alias("text"), (F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))) % 20).alias("_d"))
    text = F.when(F.col("_d") == 1, "").when(F.col("_d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_d") == 4, "user").otherwise(F.col("role"))
    return rows.where("_d != 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("_d") == 3, 2).otherwise(1).alias("copies"))


def _judged(rows: DataFrame) -> DataFrame:
    """Rows with kind (0: must be deleted), fault, and blocks of at most COPIES equal rows, the first of which (lead) may stay."""
    digest = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    same = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("n")).withColumn("_key", digest)
    # where a text comes first; turns that are null come before all others
    first = same.groupBy("conv_id", "_key").agg(F.max(F.col("turn").isNull()).alias("_null"), F.min("turn").alias("_turn"), F.count("*").alias("_rows")).where("_rows > 1").drop("_rows")
    a, b = same.alias("a"), first.alias("b")
    met = a.join(b, F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a._key") == F.col("b._key")), "left").select("a.conv_id", "a.turn", "a.role", "a.text", "a.n", "b._null", "b._turn")
    again = F.coalesce(F.when(F.col("_null"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("_turn")), F.lit(False))
    body = F.rtrim(F.col("text"), F.lit(WHITE))
    blank, short = body == "", ~F.substring(body, -1, 1).isin(".", "!", "?")
    fault = F.when(blank, 1).when(again, 2).when(short, 3).otherwise(0)
    initial = F.substring("role", 1, 1)
    place = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    out = met.withColumn("fault", fault.cast("byte")).withColumn("initial", place.cast("byte"))
    kind = F.when(F.col("fault").isin(1, 2), 0).otherwise(1 + 2 * F.col("initial") + (F.col("fault") == 3).cast("int"))
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES))).alias("block")
    out = out.withColumn("kind", kind.cast("byte")).drop("_null", "_turn").select("*", block)
    return out.withColumn("copies", F.least(F.lit(COPIES), F.col("n") - F.col("block") * COPIES).cast("int")).drop("n")


PACKED = "part int, seq long, conv_id long, kinds array<byte>, blank long, duplicate long, truncated long, illegal long, first_role byte, last_role byte, first_turn long, last_turn long, turns long, roles array<string>, texts array<string>"


def _pack(chunk: int):
    """Sorted rows to chunks of at most chunk rows, the copies of a row one by one; only rows that may stay carry their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            conv = batch.column("conv_id")
            ids, null = conv.fill_null(0).to_numpy(zero_copy_only=False), conv.is_null().to_numpy(zero_copy_only=False)
            copies, block = batch.column("copies").to_numpy(), batch.column("block").to_numpy()
            row = np.repeat(np.arange(n), copies)
            lead = np.ones(len(row), bool)
            lead[1:] = row[1:] != row[:-1]
            lead &= block[row] == 0
            fault = batch.column("fault").to_numpy()[row]
            fault = np.where((fault == 1) | lead, fault, 2)
            kind = np.where(lead, batch.column("kind").to_numpy()[row], 0).astype(np.int8)
            initial = batch.column("initial").to_numpy()[row]
            turn_column = batch.column("turn")
            turn, no_turn = turn_column.fill_null(0).to_numpy(zero_copy_only=False)[row], turn_column.is_null().to_numpy(zero_copy_only=False)[row]
            change = np.ones(len(row), bool)
            change[1:] = (ids[row[1:]] != ids[row[:-1]]) | (null[row[1:]] != null[row[:-1]])
            of_conv = np.maximum.accumulate(np.where(change, np.arange(len(row)), 0))
            change |= (np.arange(len(row)) - of_conv) % chunk == 0
            begin = np.flatnonzero(change)
            end = np.append(begin[1:], len(row))
            total = lambda flag: np.add.reduceat(flag.astype(np.int64), begin)
            pair = initial[:-1] * 4 + initial[1:]
            bad = np.zeros(len(row), bool)
            bad[1:] = ~np.isin(pair, (1, 6, 9)) & ~change[1:]  # su, ua, au
            new_turn = ~no_turn
            new_turn[1:] &= (turn[1:] != turn[:-1]) | no_turn[:-1] | change[1:]
            # within a chunk, turns are in order with nulls before the others
            some = total(~no_turn) > 0
            from_turn = np.minimum.reduceat(np.where(no_turn, np.iinfo(np.int64).max, turn), begin)
            offsets = pa.array(np.append(begin, len(row)).astype(np.int32))
            take = pa.array(np.where(kind > 0, row, -1), mask=kind == 0)
            columns = [
                pa.array(np.full(len(begin), batch.column("part")[0].as_py(), np.int32)), pa.array(seq + np.arange(len(begin))), conv.take(pa.array(row[begin])), pa.ListArray.from_arrays(offsets, pa.array(kind)),
                *(pa.array(total(fault == f)) for f in (1, 2, 3)), pa.array(total(bad)), pa.array(initial[begin].astype(np.int8)), pa.array(initial[end - 1].astype(np.int8)),
                pa.array(from_turn, mask=~some), pa.array(turn[end - 1], mask=~some), pa.array(total(new_turn)),
                *(pa.ListArray.from_arrays(offsets, batch.column(c).take(take)) for c in ("role", "text")),
            ]
            seq += len(begin)
            yield pa.record_batch(columns, names=[c.split()[0] for c in PACKED.split(", ")])

    return run


def _chunk_costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    begin_cost = np.where(np.eye(4, dtype=bool), 0, FAR)[None]
    for batch in batches:
        kinds = batch.column("kinds")
        offsets = kinds.offsets.to_numpy()
        flat = kinds.values.to_numpy(zero_copy_only=False)
        cost, rank, _ = solve(flat, offsets[:-1], np.diff(offsets), np.repeat(begin_cost, batch.num_rows, 0))
        sixteen = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * 16)
        keep = [c for c in batch.schema.names if c != "kinds"]
        lists = [pa.ListArray.from_arrays(sixteen, pa.array(x.reshape(-1))) for x in (cost, rank)]
        yield pa.record_batch([*(batch.column(c) for c in keep), *lists], names=[*keep, "costs", "ranks"])


CHOSEN = "part int, seq long, first_state byte, last_state byte, tail byte, conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
COUNTS = ("blank", "duplicate", "truncated", "illegal")


class _Conversation:
    """The chunks of one conversation in order, put together."""

    def __init__(self) -> None:
        self.parts, self.seqs, self.came = array("q"), array("q"), bytearray()
        self.cost, self.rank = [0, FAR, FAR, FAR], [0, 0, 0, 0]
        self.sums, self.turns, self.low, self.high, self.last_role = [0, 0, 0, 0], 0, None, None, None

    def add(self, r: dict) -> None:
        cost, rank = r["costs"], r["ranks"]
        best = [min((self.cost[p] + cost[4 * p + q], self.rank[p], rank[4 * p + q], p) for p in range(4)) for q in range(4)]
        keys = sorted({x[1:3] for x in best if x[0] < FAR})
        self.cost, self.rank = [min(x[0], FAR) for x in best], [keys.index(x[1:3]) if x[0] < FAR else 0 for x in best]
        self.came.extend(x[3] for x in best)
        self.parts.append(r["part"])
        self.seqs.append(r["seq"])
        self.sums = [a + r[c] for a, c in zip(self.sums, COUNTS, strict=True)]
        if self.last_role is not None and (self.last_role, r["first_role"]) not in ((0, 1), (1, 2), (2, 1)):
            self.sums[3] += 1
        self.last_role = r["last_role"]
        if r["first_turn"] is not None:
            self.turns += r["turns"] - (self.high == r["first_turn"])
            self.low, self.high = r["first_turn"] if self.low is None else self.low, r["last_turn"]

    def rows(self, conv: int | None) -> Iterator[tuple]:
        """A row for each chunk, its states, from the last to the first; the last one's has what holds for the whole."""
        ends = [(self.cost[q] + INSERT * len(TAILS[q]), self.rank[q], q) for q in range(4)]
        cost, _, state = min(ends)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        for k in range(len(self.seqs) - 1, -1, -1):
            before, last = self.came[4 * k + state], k == len(self.seqs) - 1
            yield (self.parts[k], self.seqs[k], before, state, len(TAILS[state]) if last else 0, conv, *((gaps, *self.sums, cost) if last else (None,) * 6))
            state = before


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks in the order of conversations to the states between them."""
    types = [pa.int32(), pa.int64(), pa.int8(), pa.int8(), pa.int8(), *[pa.int64()] * 7]
    names = [c.split()[0] for c in CHOSEN.split(", ")]
    now, conv = None, None

    def handed(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for x in rows:
            held.append(x)
            if len(held) == 1 << 14:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
                held = []
        if held:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)

    def all_rows() -> Iterator[tuple]:
        nonlocal now, conv
        for batch in batches:
            for r in batch.to_pylist():
                if now is None or r["conv_id"] != conv:
                    if now is not None:
                        yield from now.rows(conv)
                    now, conv = _Conversation(), r["conv_id"]
                now.add(r)
        if now is not None:
            yield from now.rows(conv)

    yield from handed(all_rows())


TURNS = "conv_id long, part int, seq long, place long, edit string, role string, text string"


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks with their first and last state to edits, one by one in order, with the turns that they leave (none for D)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        kinds = batch.column("kinds")
        offsets = kinds.offsets.to_numpy()
        begin, size, flat = offsets[:-1] - offsets[0], np.diff(offsets), kinds.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
        first, state = batch.column("first_state").to_numpy().astype(np.int64), batch.column("last_state").to_numpy().astype(np.int64)
        cost = np.full((n, 1, 4), FAR)
        cost[np.arange(n), 0, first] = 0
        _, _, came = solve(flat, begin, size, cost, parents=True)
        macro, before = np.zeros(len(flat), np.int64), np.zeros(len(flat), np.int64)
        for t in range(int(size.max(initial=0)) - 1, -1, -1):
            live = np.flatnonzero(size > t)
            from_ = came[begin[live] + t, 0, state[live]]
            macro[begin[live] + t], before[begin[live] + t] = from_ % len(MACROS), from_ // len(MACROS)
            state[live] = from_ // len(MACROS)
        ends, tails = batch.column("last_state").to_pylist(), batch.column("tail").to_pylist()
        keys = [batch.column(c).to_pylist() for c in ("conv_id", "part", "seq")]
        for k in range(n):
            roles, texts = batch.column("roles")[k].as_py(), batch.column("texts")[k].as_py()
            edits, role_out, text_out = [], [], []

            def insert(s: int, edits: list = edits, role_out: list = role_out, text_out: list = text_out) -> int:
                s = _free(s)
                edits.append("I")
                role_out.append(ROLES[s])
                text_out.append("")
                return s

            for i in range(int(size[k])):
                s, name = int(before[begin[k] + i]), MACROS[macro[begin[k] + i]]
                for _ in name[:-1]:
                    s = insert(s)
                edits.append(name[-1])
                role_out.append({"D": None, "K": roles[i], "R": ROLES[_free(s)]}[name[-1]])
                text_out.append(None if name[-1] == "D" else texts[i])
            s = ends[k]
            for _ in range(tails[k]):
                s = insert(s)
            m = len(edits)
            columns = [pa.array([key[k]] * m, t) for key, t in zip(keys, (pa.int64(), pa.int32(), pa.int64()), strict=True)]
            yield pa.record_batch([*columns, pa.array(range(m), pa.int64()), pa.array(edits), pa.array(role_out, pa.string()), pa.array(text_out, pa.string())], names=[c.split()[0] for c in TURNS.split(", ")])


def repair(rows: DataFrame, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(turns, summary) of rows (conv_id, turn, role, text, copies).

    turns: conv_id, part, seq, place, edit, role, text, in the order of (part, seq, place), a row for each edit; deleted rows have neither
    role nor text. summary: conv_id, gaps, blank, duplicate, truncated, illegal, cost, a row for each conversation.
    """
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("_h").asc(), F.col("block").asc()]
    ranged = _judged(rows).withColumn("_h", F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order, F.col("text").asc())
    packed = cut(ranged.drop("_h").withColumn("part", F.spark_partition_id()).mapInArrow(_pack(chunk), PACKED))
    numbers = [c.split()[0] for c in PACKED.split(", ") if c.split()[0] not in ("roles", "texts")]
    costs = packed.select(*numbers).mapInArrow(_chunk_costs, ", ".join(c for c in PACKED.split(", ") if c.split()[0] not in ("kinds", "roles", "texts")) + ", costs array<long>, ranks array<long>")
    sorted_ = costs.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "part", "seq")
    chosen = cut(sorted_.mapInArrow(_choose, CHOSEN))
    states = chosen.select("part", "seq", "first_state", "last_state", "tail")
    turns = packed.select("part", "seq", "conv_id", "kinds", "roles", "texts").join(states, ["part", "seq"]).mapInArrow(_turns, TURNS)
    return turns, chosen.where("cost is not null").select("conv_id", "gaps", *COUNTS, "cost")


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits in order to (conv_id, audit, sha256 of the turns left), read as a stream."""
    conv, started, audit, digest, any_turn = None, False, [], None, False

    def row() -> pa.RecordBatch:
        return pa.record_batch([pa.array([conv], pa.int64()), pa.array(["".join(audit)]), pa.array([digest.hexdigest()])], names=["conv_id", "audit", "repaired_sha256"])

    for batch in batches:
        for c, edit, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "edit", "role", "text")), strict=True):
            if not started or c != conv:
                if started:
                    yield row()
                conv, started, audit, digest, any_turn = c, True, [], hashlib.sha256(), False
            audit.append(edit)
            if edit != "D":
                digest.update(f"{chr(10) * any_turn}{role}:{text}".encode())
                any_turn = True
    if started:
        yield row()


def digest(conversations: DataFrame, turns: DataFrame, summary: DataFrame) -> DataFrame:
    """A row for each conv_id of conversations: its summary, audit and the hash of what is left; zeros and empty texts without rows."""
    ordered = turns.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "part", "seq", "place")
    audits = ordered.mapInArrow(_audits, "conv_id long, audit string, repaired_sha256 string")
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()

    def met(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
        a, b = left.alias("a"), right.alias("b")
        return a.join(b, F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")), "left").select("a.*", *(f"b.{c}" for c in columns))

    counts = ["gaps", *COUNTS, "cost"]
    out = met(met(ids, summary, counts), audits, ["audit", "repaired_sha256"])
    or_else = lambda c, v: F.coalesce(F.col(c), v).alias(c)
    filled: list[Column] = [or_else(c, F.lit(0).cast("long")) for c in counts]
    return out.select("conv_id", *filled, or_else("audit", F.lit("")), or_else("repaired_sha256", F.sha2(F.lit(""), 256)))
