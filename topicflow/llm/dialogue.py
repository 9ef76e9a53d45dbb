"""Repair of conversations by shortest paths over edits, with Dial's bucket queue.

A conversation's roles should read ``(system? (user assistant)+)?`` by their initials. Every row is
kept (0), given another role (2) or deleted (3; blank rows and duplicates must be), a row with an
empty text may be put in anywhere (2), and a truncated row that stays costs 1. Nodes are (rows
read, what came last); arcs cost 0 to 3, so distances to the end come from a queue of a few
buckets. The audit is the walk along tight arcs (an arc's cost is the difference of its ends'
distances) that takes the ASCII-least edit at every node: D, I, K, R.

At scale: rows without their texts are put in one global order by ranges and cut into blocks of
4,096 places, so a conversation of any length is many tasks' work. A block gives its distances
between the four states at its ends; a conversation's blocks are chained by them (its audit is one
string, so it has fewer than 2**31 rows and 2**19 blocks), and every block walks its own arcs for
each state that may enter it. Texts are shuffled once, by conversation, where blocks' edits sort
just before their rows: a conversation's texts pass as a stream of Arrow batches, never a group. The
order of one conversation's texts is one task's stream because a digest of them is sequential.

Defined results: a null role or text is one space (so blank); null turns come first; rows of one turn are
taken by role, the first 32 characters of the text, then its SHA-256; null conv_ids are a conversation of their own; gaps
that no long holds are null; an empty table gives no rows; repeated rows are rows, and all but the
first are duplicates; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, materialize, shuffle_partitions, text_batches

#: Classes of a role by its initial, and what came last in the repaired conversation.
SYSTEM, USER, ASSISTANT, OTHER = range(4)
START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
#: The state after a row that is put in or given another role, and the role that row has.
NEXT = [AFTER_USER, AFTER_USER, AFTER_ASSISTANT, AFTER_USER]
ROLE = {AFTER_USER: "user", AFTER_ASSISTANT: "assistant"}
CLASS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
#: A row's code: its class, plus these.
DELETE, TRUNCATED = 4, 8
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 2, 3, 2, 1
#: Behind the last row only insertions are left: their edits and costs by state.
CLOSING = ["", "II", "I", ""]
CLOSING_COST = [INSERT_COST * len(x) for x in CLOSING]
#: More than any two distances in the queue at a time differ by.
BUCKETS = 16
BLOCK_BITS = 12
BLANKS = " \t\n\x0b\x0c\r"
LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}


def kept(state: int, code: int) -> int | None:
    """The state after keeping a row of this code, None where that is no way."""
    role = code & 3
    if code & DELETE or role == OTHER:
        return None
    if role == SYSTEM:
        return AFTER_SYSTEM if state == START else None
    after = AFTER_USER if role == USER else AFTER_ASSISTANT
    return after if NEXT[state] == after else None


#: For every code, the arcs into each state from the states before the row: (state before, cost).
INTO = []
#: For every code, the arcs out of each state in ASCII order: (edit, state after, cost, rows read).
OUT = []
for _code in range(16):
    _more = TRUNCATED_COST if _code & TRUNCATED else 0
    _into: list[list[tuple[int, int]]] = [[] for _ in range(4)]
    _out: list[list[tuple[str, int, int, int]]] = []
    for _state in range(4):
        _arcs = [("D", _state, DELETE_COST, 1), ("I", NEXT[_state], INSERT_COST, 0)]
        if (_after := kept(_state, _code)) is not None:
            _arcs.append(("K", _after, _more, 1))
        if not _code & DELETE:
            _arcs.append(("R", NEXT[_state], REROLE_COST + _more, 1))
        _out.append(_arcs)
        for _, _after, _cost, _read in _arcs:
            if _read:
                _into[_after].append((_state, _cost))
    INTO.append(_into)
    OUT.append(_out)
INSERTED_FROM = [[s for s in range(4) if NEXT[s] == t] for t in range(4)]


def distances(codes: bytes, exits: list[int | None]) -> list[int | None]:
    """Dial: the least cost from every node (4 * rows read + state) to the end, where a state costs ``exits`` more.

    Arcs are followed backward from the end; nothing is put in behind the last row, which is up to
    ``exits``. None where there is no way.
    """
    end = 4 * len(codes)
    dist: list[int | None] = [None] * (end + 4)
    queue: list[list[int]] = [[] for _ in range(BUCKETS)]
    least = min(x for x in exits if x is not None)
    waiting = 0
    for state, x in enumerate(exits):
        if x is not None:
            dist[end + state] = x
            queue[x % BUCKETS].append(end + state)
            waiting += 1
    at = least
    while waiting:
        bucket = queue[at % BUCKETS]
        while bucket:
            node = bucket.pop()
            waiting -= 1
            if dist[node] != at:
                continue  # it was reached for less since
            row, state = node >> 2, node & 3
            if node < end:
                cost = at + INSERT_COST
                for s in INSERTED_FROM[state]:
                    other = (row << 2) + s
                    if dist[other] is None or dist[other] > cost:
                        dist[other] = cost
                        queue[cost % BUCKETS].append(other)
                        waiting += 1
            if row:
                for s, c in INTO[codes[row - 1]][state]:
                    other, cost = ((row - 1) << 2) + s, at + c
                    if dist[other] is None or dist[other] > cost:
                        dist[other] = cost
                        queue[cost % BUCKETS].append(other)
                        waiting += 1
        at += 1
    return dist


def walk(codes: bytes, dist: list[int | None], state: int) -> tuple[str, int]:
    """The least edits along tight arcs from a state before the first row to one behind the last."""
    edits, row = [], 0
    while row < len(codes):
        here = dist[4 * row + state]
        for edit, after, cost, read in OUT[codes[row]][state]:
            there = dist[4 * (row + read) + after]
            if there is not None and there + cost == here:
                edits.append(edit)
                row, state = row + read, after
                break
    return "".join(edits), state


def between(codes: bytes) -> list[list[int | None]]:
    """[state behind][state before]: least costs through a block."""
    return [distances(codes, [0 if s == t else None for s in range(4)])[:4] for t in range(4)]


def carried(through: list[list[int | None]], exits: list[int | None]) -> list[int | None]:
    """Distances before a block, from those behind it."""
    ways = [[c + x for row, x in zip(through, exits) if x is not None and (c := row[s]) is not None] for s in range(4)]
    return [min(w, default=None) for w in ways]


def _crc_key(*cols: str) -> Column:
    return F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in cols])


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that the CRC-32 of ``conv_id:turn`` modulo 20 chooses.

    0 drops a row, 1 empties its text, 2 takes out its full stops, exclamation and question marks, 3 repeats it, 4 gives it to the user.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"), F.pmod(F.crc32(_crc_key("conv_id", "turn").cast("binary")), F.lit(20)).alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    hurt = rows.filter("kind <> 0").select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("times"))
    return hurt.withColumn("copy", F.explode(F.sequence(F.lit(1), "times"))).select("conv_id", "turn", "role", "text")


#: A conversation's rows in order: all of a key but the texts themselves.
ORDER = ["turn", "role", "head", "digest"]


def _keyed(rows: DataFrame) -> DataFrame:
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    clean = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"))
    return clean.select("*", F.left("text", F.lit(32)).alias("head"), F.unhex(F.sha2("text", 256)).alias("digest"))


@dataclass
class Repair:
    """``rows``: conv_id, edit, role, text of the repaired conversations, in order inside one partition each; ``audits``: a row a conversation with rows."""

    rows: DataFrame
    audits: DataFrame


def repair(rows: DataFrame, block_bits: int = BLOCK_BITS) -> Repair:
    """Audits and repaired rows of the conversations in ``rows`` (conv_id, turn, role, text)."""
    spark = rows.sparkSession
    coded = _coded(_keyed(rows))
    counts = coded.groupBy("conv_id").agg(
        F.expr("coalesce(try_cast(cast(max(turn) as decimal(20)) - min(turn) + 1 - count(distinct turn) as bigint), if(max(turn) is null, 0L, null))").alias("gaps"),
        *[F.count_if(c).alias(c) for c in ("blank", "duplicate", "truncated")],
    )
    pieces = materialize(_pieces(coded, block_bits))
    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "piece"))), lambda x: x["piece"]), "").alias("audit")
    told = pieces.groupBy("conv_id").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), audit)
    nothing = lambda kind: F.lit(None).cast(kind)
    longs = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    parts = counts.select("conv_id", *longs[:4], *[nothing("long").alias(c) for c in longs[4:]], nothing("string").alias("audit"))
    parts = parts.union(told.select("conv_id", *[nothing("long") for _ in longs[:4]], "illegal", "cost", "audit"))
    audits = parts.groupBy("conv_id").agg(*[F.max(c).alias(c) for c in [*longs, "audit"]])
    text_batches(spark)
    return Repair(_edited(_keyed(rows), pieces), audits)


def _coded(keyed: DataFrame) -> DataFrame:
    """Rows without texts: place in the order of all rows, faults, and code."""
    spark = keyed.sparkSession
    trimmed = F.rtrim("text", F.lit(BLANKS))
    light = keyed.select("conv_id", *ORDER, F.monotonically_increasing_id().alias("nth"), (F.length(trimmed) == 0).alias("blank"), (~F.substring(trimmed, -1, 1).isin(".", "!", "?")).alias("cut"))
    light = materialize(light)
    # contents that a conversation has more than once, with the first place of each
    seen = light.filter("not blank").groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min(F.struct("turn", "nth")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    met = light.join(seen, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    again = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.struct("turn", "nth"))
    met = met.withColumn("duplicate", again).withColumn("truncated", F.col("cut") & ~F.col("blank") & ~F.col("duplicate"))
    klass = F.lit(OTHER)
    for initial, number in CLASS.items():
        klass = F.when(F.left("role", F.lit(1)) == initial, number).otherwise(klass)
    code = klass + F.when(F.col("blank") | F.col("duplicate"), DELETE).otherwise(0) + F.when(F.col("truncated"), TRUNCATED).otherwise(0)
    order = ["conv_id", *ORDER, "nth"]  # nth parts rows that are equal in all else
    dealt = met.select(*order, "blank", "duplicate", "truncated", code.cast("tinyint").alias("code")).repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    return materialize(dealt.withColumn("at", F.monotonically_increasing_id()).drop("nth"))


#: A block of a conversation in order: key of its first row, and its rows' codes.
_START = "struct<turn:bigint,role:string,head:string,digest:binary>"


def _pieces(coded: DataFrame, block_bits: int) -> DataFrame:
    """conv_id, block, start, piece (its edits), cost (the whole, at the first block), illegal."""
    conv = coded.schema["conv_id"].dataType.simpleString()
    placed = F.transform(F.array_sort(F.collect_list(F.struct("at", "code"))), lambda x: x["code"])
    blocks = materialize(coded.groupBy("conv_id", F.shiftright("at", block_bits).alias("block")).agg(F.min(F.struct(*ORDER)).alias("start"), placed.alias("codes")))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Distances through each block, its first and last class and the pairs inside that are not legal."""
        for b in batches:
            through, ends = [], []
            for codes in b["codes"]:
                c = bytes(codes.as_py())
                through.append([x for row in between(c) for x in row])
                ends.append([c[0] & 3, c[-1] & 3, sum((p & 3, q & 3) not in LEGAL for p, q in zip(c, c[1:]))])
            yield pa.RecordBatch.from_arrays([b["conv_id"], b["block"], pa.array(through, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64()))], names=["conv_id", "block", "through", "ends"])

    sums = blocks.mapInArrow(summed, f"conv_id {conv}, block long, through array<bigint>, ends array<bigint>")
    lists = sums.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("block", "through", "ends"))).alias("all"))

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The distances behind every block of a conversation, from its last block to its first."""
        for b in batches:
            where, block, exits, illegal, cost = [], [], [], [], []
            for k, items in enumerate(b["all"]):
                behind, following = list(CLOSING_COST), None
                found = items.as_py()
                for x in reversed(found):
                    where.append(k)
                    block.append(x["block"])
                    exits.append(behind)
                    first, last, inside = x["ends"]
                    illegal.append(inside + (following is not None and (last, following) not in LEGAL))
                    following = first
                    behind = carried([x["through"][4 * t : 4 * t + 4] for t in range(4)], behind)
                    cost.append(behind[START] if x is found[0] else 0)
            yield pa.RecordBatch.from_arrays([b["conv_id"].take(pa.array(where, pa.int64())), pa.array(block, pa.int64()), pa.array(exits, pa.list_(pa.int64())), pa.array(illegal, pa.int64()), pa.array(cost, pa.int64())], names=["conv_id", "block", "exits", "illegal", "cost"])

    known = lists.mapInArrow(chained, f"conv_id {conv}, block long, exits array<bigint>, illegal long, cost long")
    known = known.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), "exits", "illegal", "cost")
    met = blocks.join(known, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b"))).select("conv_id", "block", "start", "codes", "exits", "illegal", "cost")

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The walks through each block, one for each state before it."""
        for b in batches:
            ways = []
            for codes, exits in zip(b["codes"], b["exits"]):
                c = bytes(codes.as_py())
                dist = distances(c, exits.as_py())
                ways.append([{"piece": p, "state": s} for p, s in (walk(c, dist, state) for state in range(4))])
            kind = pa.list_(pa.struct([("piece", pa.string()), ("state", pa.int32())]))
            yield pa.RecordBatch.from_arrays([b["conv_id"], b["block"], b["start"], pa.array(ways, kind), b["illegal"], b["cost"]], names=["conv_id", "block", "start", "ways", "illegal", "cost"])

    walks = met.mapInArrow(walked, f"conv_id {conv}, block long, start {_START}, ways array<struct<piece:string,state:int>>, illegal long, cost long")
    paths = walks.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("block", "start", "ways", "illegal", "cost"))).alias("all"))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The walk taken in each block: the state behind one block is the state before the next."""
        for b in batches:
            where, pieces, state = [], [], START
            sizes = b["all"].value_lengths().to_pylist()
            flat = b["all"].flatten()
            ways = flat.field("ways").to_pylist()
            for k, size in enumerate(sizes):
                state = START
                for _ in range(size):
                    way = ways[len(pieces)][state]
                    pieces.append(way["piece"])
                    state = way["state"]
                    where.append(k)
                pieces[-1] += CLOSING[state]
            yield pa.RecordBatch.from_arrays([b["conv_id"].take(pa.array(where, pa.int64())), flat.field("block"), flat.field("start"), pa.array(pieces, pa.string()), flat.field("illegal"), flat.field("cost")], names=["conv_id", "block", "start", "piece", "illegal", "cost"])

    return paths.mapInArrow(chosen, f"conv_id {conv}, block long, start {_START}, piece string, illegal long, cost long")


def _edited(keyed: DataFrame, pieces: DataFrame) -> DataFrame:
    """The rows of the repaired conversations: a block's edits sort before its rows, and are used up by them."""
    conv = keyed.schema["conv_id"].dataType.simpleString()
    order = ["conv_id", *ORDER, "block"]
    edits = pieces.select("conv_id", *[F.col(f"start.{c}").alias(c) for c in ORDER], "block", F.lit("").alias("text"), "piece")
    texts = keyed.select("conv_id", *ORDER, F.lit(2**63 - 1).alias("block"), "text", F.lit(None).cast("string").alias("piece"))
    stream = edits.unionByName(texts).repartition(shuffle_partitions(keyed.sparkSession), "conv_id").sortWithinPartitions(*order).select("conv_id", "role", "text", "piece")
    schema = pa.schema([("at", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edits: deque[tuple[str, int]] = deque()  # of one conversation, not used up yet, with the length up to the last row's edit
        used, state = 0, START
        current: tuple = (object(),)
        for b in batches:
            out = []
            columns = (b[c].to_pylist() for c in ("conv_id", "role", "text", "piece"))
            for k, (conv_id, role, text, piece) in enumerate(zip(*columns)):
                if (conv_id,) != current:
                    current, edits, used, state = (conv_id,), deque(), 0, START
                if piece is not None:
                    edits.append((piece, len(piece.rstrip("I"))))
                    continue
                own, core = edits[0]
                edit = "I"
                while edit == "I" or core <= used < len(own):  # up to this row's edit; behind the last row's, all that is left
                    edit = own[used]
                    used += 1
                    if edit in "IR":
                        state = NEXT[state]
                    elif edit == "K":
                        state = kept(state, CLASS.get(role[:1], OTHER))
                    if edit != "D":
                        out.append((k, edit, role if edit == "K" else ROLE[state], "" if edit == "I" else text))
                    if used == len(own):
                        edits.popleft()
                        used = 0
                        break
            got = batch(schema, [list(c) for c in zip(*out)] if out else [[], [], [], []])
            yield pa.RecordBatch.from_arrays([b["conv_id"].take(got["at"]), got["edit"], got["role"], got["text"]], names=["conv_id", "edit", "role", "text"])

    return stream.mapInArrow(run, f"conv_id {conv}, edit string, role string, text string")


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of ``role:text`` lines, over rows as :func:`repair` leaves them; none for a conversation without rows."""
    conv = repaired.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, digest = None, None
        for b in batches:
            done_at, done, ids = [], [], b["conv_id"]
            carry = None
            for k, (conv_id, role, text) in enumerate(zip(ids.to_pylist(), b["role"].to_pylist(), b["text"].to_pylist())):
                if digest is None or current != conv_id:
                    if digest is not None:
                        if k:
                            done_at.append(k - 1)
                            done.append(digest.hexdigest())
                        else:
                            carry = (current, digest.hexdigest())
                    current, digest = conv_id, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
            if carry:
                yield pa.RecordBatch.from_arrays([pa.array([carry[0]], ids.type), pa.array([carry[1]])], names=["conv_id", "repaired_sha256"])
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(done_at, pa.int64())), pa.array(done, pa.string())], names=["conv_id", "repaired_sha256"])
            kind = ids.type
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([current], kind), pa.array([digest.hexdigest()])], names=["conv_id", "repaired_sha256"])

    return repaired.select("conv_id", "role", "text").mapInArrow(run, f"conv_id {conv}, repaired_sha256 string")


def report(conversations: DataFrame, rows: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """A row for every conv_id of ``conversations``: the audit of its rows in ``rows`` and the digest of what they become."""
    done = repair(rows, block_bits)
    longs = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    nothing = lambda kind: F.lit(None).cast(kind)
    none = [nothing("long").alias(c) for c in longs]
    parts = conversations.select("conv_id", *none, nothing("string").alias("audit"), nothing("string").alias("repaired_sha256"), F.lit(False).alias("here")).distinct()
    parts = parts.union(done.audits.select("conv_id", *longs, "audit", nothing("string"), F.lit(True)))
    parts = parts.union(digests(done.rows).select("conv_id", *none, nothing("string"), "repaired_sha256", F.lit(False)))
    whole = parts.groupBy("conv_id").agg(*[F.max(c).alias(c) for c in [*longs, "audit", "repaired_sha256", "here"]])
    gaps = F.when(F.col("here"), F.col("gaps")).otherwise(F.lit(0))
    nought = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in longs[1:]]
    return whole.select("conv_id", gaps.cast("long").alias("gaps"), *nought, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
