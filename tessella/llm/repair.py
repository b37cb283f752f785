"""Conversation structure repair by a min-plus matrix scan.

A conversation is in order if its role initials read (s?(ua)+)?.  Edits lead there:
Keep (0), Rerole to user or assistant (2), Delete (3, forced on blank and duplicate
turns), Insert an empty user or assistant turn (2); a truncated turn that stays
costs 1 more.  The cheapest edits are wanted, and of equally cheap ones the ASCII-
least string of their initials (the audit).

Which edits fit depends on one of four states only: start, after the system turn,
after a user turn, after an assistant turn.  So a turn is a 4x4 matrix of (cost,
audit) elements, from the state before it to the state after it, with any number of
inserts before its own edit (the insert closure).  Elements add by min and multiply
by adding costs and joining audits; that product is associative, because equally
cheap audits of the same turns are never prefixes of each other.  Hence:

1. equal turn rows are counted together (with a partial sum before the shuffle),
   the first of equal role and text is found by a narrow sum and joined back;
2. turns are dealt out by range of (conv_id, turn, role, text), so a conversation of
   any length spreads over partitions; each partition reads its turns in order and
   multiplies them to blocks of at most BLOCK_ROWS turns or BLOCK_BYTES of text;
3. blocks of a conversation are multiplied in a tree, FAN at a time, first inside a
   partition, then across partitions; the product also carries the counts;
4. the audit of a conversation is cut at its block borders (which the products
   mark), and every block turns its own piece into repaired turns.

No task sees more than FAN blocks; only the audit itself, one letter a turn, and
the digest of the query (a hash of one whole conversation in order, streamed) are
as long as the conversation.

Defined results: rows come by turn (null first), then role, then text; null role
and text are one space; equal rows are as many turns; a null conv_id is one
conversation; a role is judged by its first character, an empty role has none and
can't be kept; a conversation without rows is kept with zeros, an empty audit and
no repaired turns; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, narrow_batches, wide

START, SYSTEM, USER, ASSISTANT = range(4)
#: state -> what an insert or a rerole makes of it.
ADD = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAME = {USER: "user", ASSISTANT: "assistant"}
#: (state, initial) -> state after a kept turn.
KEEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
GOOD_PAIRS = {"su", "ua", "au"}
BLOCK_ROWS, BLOCK_BYTES, FAN = 512, 1 << 20, 64
SPACES = " \t\n\x0b\x0c\r"

Element = tuple[int, str] | None
Matrix = tuple[tuple[Element, ...], ...]


def product(a: Matrix, b: Matrix, border: bool = False) -> Matrix:
    """Min-plus product; border marks the state between the two with a digit in the audit."""
    out = []
    for row in a:
        best: list[Element] = [None] * 4
        for k, x in enumerate(row):
            if x is None:
                continue
            head = x[1] + str(k) if border else x[1]
            for j, y in enumerate(b[k]):
                if y is not None:
                    z = (x[0] + y[0], head + y[1])
                    if best[j] is None or z < best[j]:
                        best[j] = z
        out.append(tuple(best))
    return tuple(out)


def _one(steps: dict[tuple[int, int], tuple[int, str]]) -> Matrix:
    return tuple(tuple(steps.get((i, j)) for j in range(4)) for i in range(4))


UNIT = _one({(i, i): (0, "") for i in range(4)})


def _closure() -> Matrix:
    """Any number of inserts: the star of one insert."""
    more = _one({(i, j): (2, "I") for i, j in ADD.items()} | {(i, i): (0, "") for i in range(4)})
    star = more
    while (longer := tuple(tuple(min((e for e in (p, q) if e), default=None) for p, q in zip(r, s, strict=True)) for r, s in zip(star, product(star, more), strict=True))) != star:
        star = longer
    return star


INSERTS = _closure()


@lru_cache(1 << 14)
def turn_matrix(initial: str, truncated: bool, gone: bool, copies: int) -> Matrix:
    """Inserts, then the edit of a turn; copies beyond the first are duplicates.  gone: it must be deleted."""
    steps: dict[tuple[int, int], tuple[int, str]] = {(i, i): (3, "D") for i in range(4)}
    if not gone:
        for i in range(4):
            options = [(2 + truncated, "R", ADD[i])] + ([(0 + truncated, "K", KEEP[i, initial])] if (i, initial) in KEEP else [])
            for cost, letter, j in options:
                steps[i, j] = min(steps.get((i, j), (99, "")), (cost, letter))
    if copies > 1:
        more = (3 * (copies - 1), "D" * (copies - 1))
        steps = {ij: (c + more[0], a + more[1]) for ij, (c, a) in steps.items()}
    return product(INSERTS, _one(steps))


def cheapest(total: Matrix) -> tuple[int, str]:
    """The audit of a whole conversation: from the start to the start or an assistant turn, inserts at the end included."""
    end = product(total, INSERTS)[START]
    return min(e for e in (end[START], end[ASSISTANT]) if e)


COUNTS = ("n", "blank", "duplicate", "truncated", "illegal", "turns")
SEGMENT = "conv_id {conv}, part int, seq long, n long, blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, first string, last string, blocks array<long>, costs array<long>, audits array<string>"


def join_segments(a: dict, b: dict) -> dict:
    """Counts and matrix of two neighbouring stretches of a conversation; a stretch of no turns changes nothing."""
    if not a["n"] or not b["n"]:
        x, y = (b, a) if not a["n"] else (a, b)
        return {**x, "blocks": x["blocks"] or y["blocks"]}
    out = {k: a[k] + b[k] for k in COUNTS}
    out["illegal"] += a["last"] + b["first"] not in GOOD_PAIRS
    out["turns"] -= a["high"] is not None and a["high"] == b["low"]
    out["low"] = b["low"] if a["low"] is None else a["low"]
    out["high"] = a["high"] if b["high"] is None else b["high"]
    return out | {"first": a["first"], "last": b["last"], "blocks": a["blocks"] + b["blocks"], "matrix": product(a["matrix"], b["matrix"], border=True)}


def _pack(m: Matrix) -> tuple[list, list]:
    return [e and e[0] for r in m for e in r], [e and e[1] for r in m for e in r]


def _unpack(costs: list, audits: list) -> Matrix:
    flat = [None if c is None else (c, a) for c, a in zip(costs, audits, strict=True)]
    return tuple(tuple(flat[i : i + 4]) for i in range(0, 16, 4))


class _Block:
    """Turns of one conversation that follow each other in one partition."""

    def __init__(self, conv, block: int, seq: int, opens: bool) -> None:
        self.conv, self.block, self.seq, self.opens = conv, block, seq, opens
        self.rows: list[dict] = []
        self.bytes = 0
        self.matrix = UNIT
        self.counts = dict.fromkeys(COUNTS, 0)
        self.low = self.high = None
        self.first = self.last = ""

    def add(self, turn, role: str, text: str, copies: int, blank: bool, first: bool, truncated: bool) -> None:
        if not copies:
            return
        gone, initial, c = blank or not first, role[:1], self.counts
        self.matrix = product(self.matrix, turn_matrix(initial, truncated and not gone, gone, copies))
        c["blank"] += copies * blank
        c["duplicate"] += 0 if blank else copies - first
        c["truncated"] += truncated and not gone
        c["illegal"] += (self.last + initial not in GOOD_PAIRS if c["n"] else 0) + (copies - 1) * (initial * 2 not in GOOD_PAIRS)
        self.first = self.first if c["n"] else initial
        self.last = initial
        c["n"] += copies
        if turn is not None:
            c["turns"] += turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn
        self.rows.append({"turn": turn, "role": role, "text": None if gone else text, "copies": copies})
        self.bytes += len(text) + len(role)

    def out(self, part: int, closes: bool) -> dict:
        costs, audits = _pack(self.matrix)
        alone = not (self.opens or closes or self.seq)
        return {"conv_id": self.conv, "part": part, "seq": self.seq, **self.counts, "low": self.low, "high": self.high, "first": self.first, "last": self.last, "blocks": [self.block], "costs": costs, "audits": audits, "alone": alone, "rows": self.rows}


CONTENT = "alone boolean, rows array<struct<turn: long, role: string, text: string, copies: long>>"


def faults(turns: DataFrame, copies: Column | None = None) -> DataFrame:
    """Distinct (conv_id, turn, role, text) rows with their copies and faults; rows of no copies only hold their conversation's place."""
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), (F.lit(1) if copies is None else copies).cast("long").alias("copies"))
    held = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    trimmed = F.rtrim("text", F.lit(SPACES))
    judged = held.select("*", (trimmed == "").alias("blank"), (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("truncated"), F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256).alias("what"), F.struct(F.col("turn").isNotNull().alias("dated"), "turn").alias("at"))
    firsts = judged.where("copies > 0").groupBy(F.col("conv_id").alias("_c"), F.col("what").alias("_w")).agg(F.min("at").alias("first_at"))
    return judged.join(firsts, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("what") == F.col("_w")), "left").select("conv_id", "turn", "role", "text", "copies", "blank", F.coalesce(F.col("at").eqNullSafe(F.col("first_at")), F.lit(False)).alias("first"), "truncated")


def blocks(turns: DataFrame, copies: Column | None = None, partitions: int | None = None) -> DataFrame:
    """Turns multiplied to blocks, each with its matrix, counts and turns; written once."""
    spark = turns.sparkSession
    narrow_batches(spark)
    judged = faults(turns, copies)
    order = ("conv_id", "turn", "role", "text")
    conv = judged.schema["conv_id"].dataType.simpleString()
    schema = SEGMENT.format(conv=conv) + ", " + CONTENT

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        kind = None
        now: _Block | None = None
        done: list[dict] = []
        made = 0
        for batch in batches:
            kind = kind or _arrow(batch.schema.field(0).type)
            for conv_id, turn, role, text, n, blank, first, truncated in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                same = now is not None and conv_id == now.conv
                if now is None or not same or len(now.rows) >= BLOCK_ROWS or now.bytes >= BLOCK_BYTES:
                    opens = now is None or (same and now.opens)
                    if now is not None:
                        row = now.out(part, same)
                        done.append(row)
                    now = _Block(conv_id, (part << 40) | made, now.seq + 1 if same else 0, opens)
                    made += 1
                now.add(turn, role, text, n, blank, first, truncated)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=kind)
                done = []
        if now is not None:
            yield pa.RecordBatch.from_pylist([now.out(part, True)], schema=kind)

    ranged = judged.repartitionByRange(wide(turns, partitions), *order).sortWithinPartitions(*order)
    return materialize(ranged.mapInArrow(scan, schema), "repair-blocks")


def _arrow(conv: pa.DataType, content: bool = True) -> pa.Schema:
    long, text = pa.int64(), pa.string()
    fields = [("conv_id", conv), ("part", pa.int32()), ("seq", long), *((c, long) for c in (*COUNTS, "low", "high")), ("first", text), ("last", text), ("blocks", pa.list_(long)), ("costs", pa.list_(long)), ("audits", pa.list_(text))]
    if content:
        fields += [("alone", pa.bool_()), ("rows", pa.list_(pa.struct([("turn", long), ("role", text), ("text", text), ("copies", long)])))]
    return pa.schema(fields)


def _fold(key: tuple, table: pa.Table) -> pa.Table:
    """One segment for the neighbours of a group (conv_id, part, seq of the next level)."""
    rows = sorted(table.drop_columns(["_p", "_s"]).to_pylist(), key=lambda r: (r["part"], r["seq"]))
    total = reduce(join_segments, [{**r, "matrix": _unpack(r["costs"], r["audits"])} for r in rows])
    costs, audits = _pack(total["matrix"])
    conv, part, seq = (k.as_py() for k in key)
    return pa.Table.from_pylist([{**total, "conv_id": conv, "part": part, "seq": seq, "costs": costs, "audits": audits}], schema=_arrow(table.schema.field("conv_id").type, False))


def multiply(parts: DataFrame) -> DataFrame:
    """One segment for each conversation, by a tree of products of at most FAN neighbours."""
    schema = SEGMENT.format(conv=parts.schema["conv_id"].dataType.simpleString())
    seqs, last = parts.where("not alone").agg(F.coalesce(F.max("seq"), F.lit(0)), F.coalesce(F.max("part"), F.lit(0))).first()
    tree = parts.where("not alone").drop("alone", "rows")
    while seqs or last:
        if seqs:
            part, seq, seqs = F.col("part"), F.expr(f"seq div {FAN}"), seqs // FAN
        else:
            part, seq, last = F.expr(f"cast(part div {FAN} AS int)"), F.col("seq"), last // FAN
        tree = tree.withColumns({"_p": part, "_s": seq}).groupBy("conv_id", "_p", "_s").applyInArrow(_fold, schema)
    return parts.where("alone").drop("alone", "rows").unionByName(tree)


def repair_plan(parts: DataFrame) -> DataFrame:
    """Counts, cost, audit and the pieces of the audit (block, state before it, letters) of every conversation."""
    kind = parts.schema["conv_id"].dataType.simpleString()

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                cost, audit = cheapest(_unpack(r["costs"], r["audits"]))
                cut = re.split("([0-3])", audit)
                pieces = [{"block": b, "entry": int(e), "letters": p} for b, e, p in zip(r["blocks"], ["0", *cut[1::2]], cut[::2], strict=True)]
                gaps = 0 if r["low"] is None else r["high"] - r["low"] + 1 - r["turns"]
                out.append({**r, "gaps": gaps, "cost": cost, "audit": "".join(cut[::2]), "pieces": pieces})
            long = pa.int64()
            fields = [("conv_id", batch.schema.field("conv_id").type), *((c, long) for c in PLAN), ("audit", pa.string()), ("pieces", pa.list_(pa.struct([("block", long), ("entry", pa.int32()), ("letters", pa.string())])))]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema(fields))

    return multiply(parts).mapInArrow(finish, f"conv_id {kind}, {', '.join(f'{c} long' for c in PLAN)}, audit string, pieces array<struct<block: long, entry: int, letters: string>>")


PLAN = ("n", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def rewrite(rows: list[dict], state: int, letters: str) -> Iterator[tuple]:
    """(turn, role, text, edit) of the turns that a block's piece of the audit leaves or makes."""
    at, left, copy = -1, 0, False
    for letter in letters:
        if letter != "I":
            if not left:
                at += 1
                left = rows[at]["copies"]
            row, left = rows[at], left - 1
            if letter == "D":
                continue
            copy = letter == "K"
            state = KEEP[state, row["role"][:1]] if copy else ADD[state]
            yield row["turn"], row["role"] if copy else NAME[state], row["text"], letter
        else:
            state = ADD[state]
            yield None, NAME[state], "", letter


def repaired_turns(parts: DataFrame, plan: DataFrame) -> DataFrame:
    """conv_id, block, pos, turn, role, text, edit of the repaired conversations; block, then pos give the order."""
    pieces = plan.select(F.explode("pieces").alias("p")).select(F.col("p.block").alias("_block"), "p.entry", "p.letters")
    rows = parts.where(F.size("rows") > 0).select("conv_id", F.get("blocks", F.lit(0)).alias("block"), "rows")
    joined = rows.join(pieces, F.col("block") == F.col("_block")).select("conv_id", "block", "rows", "entry", "letters")
    kind = parts.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                conv, block, rows, entry, letters = (c[i] for c in batch.columns)
                made = list(rewrite(rows.as_py(), entry.as_py(), letters.as_py()))
                if made:
                    turn, role, text, edit = zip(*made, strict=True)
                    n = len(made)
                    yield pa.RecordBatch.from_arrays([pa.array([conv.as_py()] * n, batch.schema.field(0).type), pa.array([block.as_py()] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(turn, pa.int64()), *(pa.array(x, pa.string()) for x in (role, text, edit))], ["conv_id", "block", "pos", "turn", "role", "text", "edit"])

    return joined.mapInArrow(run, f"conv_id {kind}, block long, pos int, turn long, role string, text string, edit string")


def line_digest(lines: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of its lines (conv_id, block, pos, line), joined by newlines, streamed in order."""
    kind = lines.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hasher, ready, arrow = None, None, [], None
        for batch in batches:
            arrow = batch.schema.field(0).type
            for conv, line in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if hasher is None or conv != now:
                    if hasher is not None:
                        ready.append((now, hasher.hexdigest()))
                    now, hasher = conv, hashlib.sha256(line.encode())
                else:
                    hasher.update(b"\n" + line.encode())
            if ready:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in ready], arrow), pa.array([r[1] for r in ready])], ["conv_id", "sha256"])
                ready = []
        if hasher is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], arrow), pa.array([hasher.hexdigest()])], ["conv_id", "sha256"])

    dealt = lines.select("conv_id", "block", "pos", "line").repartition("conv_id").sortWithinPartitions("conv_id", "block", "pos")
    return dealt.mapInArrow(run, f"conv_id {kind}, sha256 string")


def damage(turns: DataFrame) -> tuple[DataFrame, Column]:
    """The query's turns: by crc32(conv_id:turn) % 20, 0 drops a row, 1 empties, 2 takes its sentence marks, 3 doubles, 4 makes it the user's."""
    id_, turn, role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text"))
    kind = F.crc32(F.concat(id_, F.lit(":"), turn).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("_copies"))
    return rows, F.col("_copies")


def repair_digest(turns: DataFrame) -> DataFrame:
    """The query's columns for every conversation of the damaged turns."""
    parts = blocks(*damage(turns))
    plan = materialize(repair_plan(parts), "repair-plan", small=True)
    fixed = repaired_turns(parts, plan).withColumn("line", F.concat("role", F.lit(":"), "text"))
    digest = line_digest(fixed).select(F.col("conv_id").alias("_c"), "sha256")
    empty = hashlib.sha256(b"").hexdigest()
    return plan.join(digest, F.col("conv_id").eqNullSafe(F.col("_c")), "left").select("conv_id", *PLAN[1:], "audit", F.coalesce("sha256", F.lit(empty)).alias("repaired_sha256"))
