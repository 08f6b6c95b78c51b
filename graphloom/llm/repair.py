"""Conversation structure repair: the cheapest edits that give a conversation a legal order of roles, by rank-convergence Viterbi.

Four states suffice: nothing said (0), system said (1), user's turn said (2), assistant's turn said (3); 0 and 3 may end. Costs to the
end of the conversation go backward over its turns. A conversation is cut into chunks of at most 2**BITS turns; every chunk starts at
once from a speculative vector of costs behind it. Then fix-up passes run the chunks again whose vector differs from what the next chunk
gave by more than a constant. What has not converged after PASSES such passes (a run of turns of one role need not) is settled exactly: the
chunk's cost matrix of all four states, combined by doubling over the chunks. Each chunk is then traced from every state, the maps
of states are combined by doubling too, and a last trace from the known state writes the edits: of the cheapest the one whose initials come
first (Delete, Insert, Keep, Rerole). Turns that must go (blank, duplicate) cost 3 in every state and take no part in this.

Order: turn (nulls first), then the SHA-256 of role and text, as rows of one turn have no order of their own. Defined results: null role
and text are one space, and so are a null conv_id and turn in the string whose crc32 decides the damage; rows without conv_id are one
conversation, its conv_id null. An empty role counts as a space. Repeated rows are duplicates, whatever their turn. An empty table gives no
rows. Other columns don't matter. A conversation's rows are spread over tasks throughout, but for the SHA-256 of its repaired text, which can
only be taken in order: one task streams it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: Turns a chunk: 2**BITS. Fix-up passes before the exact way.
BITS, PASSES = 12, 2
#: The one role that may come next by an inserted or reroled turn, as a state: 2 user, 3 assistant.
NEXT = np.array([2, 2, 3, 2])
#: Costs behind the last turn, insertions included.
END = np.array([0, 4, 2, 0], np.int64)
FAR = 1 << 40
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
LETTERS = "DKR"
OPS = "conv string, at bigint, inserts int, state int, letter string, said int"
VECTORS = "conv string, chunk bigint, " + ", ".join(f"v{i} bigint" for i in range(4))
MAPS = "conv string, chunk bigint, " + ", ".join(f"m{i} int" for i in range(4))


# ---- turns, their damage and their faults ----


def _plain(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text without nulls in the last two, and `conv`: conv_id as a text that is never null."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return turns.select("conv_id", "turn", text("role"), text("text"), F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("conv"))


def damage(turns: DataFrame) -> DataFrame:
    """The turns damaged by the crc32 of `conv_id:turn` modulo 20."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    rows = turns.withColumn("_kind", kind).filter("_kind <> 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.withColumns({"text": text, "role": F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))})
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.when(F.col("_kind") == 3, 1).otherwise(0)))).drop("_kind", "_copy")


def ordered(turns: DataFrame) -> DataFrame:
    """The turns of _plain() in order, written: `at` ascends over the conversation's turns, and at >> 12 of a conversation has 4096 turns
    at most. `h` tells equal turns, `initial` is the role's, `blank` and `cut` are faults of the text."""
    bare = F.rtrim("text", F.lit(" \t\n\v\f\r"))
    h = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    initial = F.when(F.col("role") == "", " ").otherwise(F.substring("role", 1, 1))
    rows = turns.withColumns({"h": h, "initial": initial, "blank": bare == "", "cut": ~F.right(bare, F.lit(1)).isin(".", "!", "?"), "_place": F.monotonically_increasing_id()})
    by = ["conv", F.col("turn").asc_nulls_first(), "h", "_place"]  # the place splits a turn that many rows repeat
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).drop("_place")
    return C.written(rows.withColumn("at", F.monotonically_increasing_id()), "turns")


def with_faults(rows: DataFrame) -> DataFrame:
    """ordered() rows without their texts, with `fault`: 1 blank, 2 duplicate, 3 truncated, else 0."""
    rows = rows.select("conv", "conv_id", "turn", "at", "h", "initial", "blank", "cut")
    seen = rows.groupBy("conv", "h").agg(F.min("at").alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    rows = rows.join(seen, ["conv", "h"], "left")
    fault = F.when(F.col("blank"), 1).when(F.col("at") > F.col("_first"), 2).when(F.col("cut"), 3).otherwise(0)
    return rows.select("conv", "conv_id", "turn", "at", "initial", fault.alias("fault"))


def statistics(rows: DataFrame, bits: int = BITS) -> DataFrame:
    """Per conversation of with_faults() rows: gaps, counts of first faults, illegal pairs of neighbours."""
    chunk = F.shiftright("at", bits)
    legal = lambda a, b: F.concat(a, b).isin("su", "ua", "au")
    before = F.lag("initial").over(Window.partitionBy("conv", chunk).orderBy("at"))
    rows = rows.withColumn("_illegal", (~legal(before, F.col("initial"))).cast("long"))
    count = lambda k, name: F.sum((F.col("fault") == k).cast("long")).alias(name)
    ends = [F.min_by("initial", "at").alias("first"), F.max_by("initial", "at").alias("last")]
    turns = [F.min("turn").alias("low"), F.max("turn").alias("high")]
    runs = rows.groupBy("conv", chunk.alias("chunk")).agg(count(1, "blank"), count(2, "duplicate"), count(3, "truncated"), F.sum("_illegal").alias("illegal"), *ends, *turns)
    over = Window.partitionBy("conv").orderBy("chunk")  # a row per chunk
    runs = runs.withColumn("illegal", F.coalesce("illegal", F.lit(0)) + F.coalesce((~legal(F.lag("last").over(over), F.col("first"))).cast("long"), F.lit(0)))
    whole = runs.groupBy("conv").agg(*(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")), F.min("low").alias("low"), F.max("high").alias("high"))
    distinct = rows.filter("turn IS NOT NULL").select("conv", "turn").distinct().groupBy("conv").agg(F.count("*").alias("turns"))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).cast("long").alias("gaps")
    return whole.join(distinct, "conv", "left").select("conv", gaps, "blank", "duplicate", "truncated", "illegal")


# ---- Viterbi over the chunks of a batch, all in step ----


class _Chunks:
    """Chunks of turns that lie one after the other: code is 0 system, 1 user, 2 assistant, 3 other, plus 4 if truncated."""

    def __init__(self, start: np.ndarray, code: np.ndarray):
        self.start, self.length = start, np.diff(np.append(start, len(code)))
        self.role, self.more = code % 4, (code >= 4).astype(np.int64) * TRUNCATED
        self.by_length = np.argsort(-self.length, kind="stable")
        self.sorted = -self.length[self.by_length]

    def active(self, step: int) -> np.ndarray:
        """Chunks of more than `step` turns."""
        return self.by_length[: np.searchsorted(self.sorted, -step, "left")]

    def kept(self, row: np.ndarray) -> np.ndarray:
        """The state that a kept turn leads to, by state; -1 where it can't be kept."""
        role = self.role[row][:, None]
        said = np.where((role == NEXT[None, :] - 1) & (role < 3), NEXT[None, :], -1)
        said[:, 0] = np.where(role[:, 0] == 0, 1, said[:, 0])
        return said

    def costs(self, behind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the costs `behind` each chunk (chunks x 4): those before each chunk, and before each turn."""
        now, each = behind.copy(), np.empty((len(self.role), 4), np.int64)
        for step in range(int(self.length.max(initial=0))):
            at = self.active(step)
            row = self.start[at] + self.length[at] - 1 - step
            then, more = now[at], self.more[row][:, None]
            said = self.kept(row)
            best = np.minimum(DELETE + then, REROLE + more + then[:, NEXT])
            best = np.minimum(best, np.where(said >= 0, more + np.take_along_axis(then, np.maximum(said, 0), 1), FAR))
            for _ in range(2):  # up to two insertions before the turn help
                best = np.minimum(best, INSERT + best[:, NEXT])
            now[at] = each[row] = best
        return now, each

    def trace(self, state: np.ndarray, behind: np.ndarray, each: np.ndarray) -> tuple[np.ndarray, ...]:
        """From each chunk's state: its last state, and of each turn the insertions before it, the state then, the edit (place in
        LETTERS) and the state after it."""
        n = len(self.role)
        inserts, before, letter, after = (np.zeros(n, np.int64) for _ in range(4))
        state = state.copy()
        for step in range(int(self.length.max(initial=0))):
            at = self.active(step)
            row, s, i = self.start[at] + step, state[at], np.arange(len(at))
            last = self.length[at] - 1 == step
            then = np.where(last[:, None], behind[at], each[np.minimum(row + 1, n - 1)])
            here, said = each[row], self.kept(row)
            before[row] = s
            for _ in range(2):
                first = (DELETE + then[i, s] != here[i, s]) & (INSERT + here[i, NEXT[s]] == here[i, s])
                inserts[row] += first
                s = np.where(first, NEXT[s], s)
            delete = DELETE + then[i, s] == here[i, s]
            to = said[i, s]
            keep = ~delete & (to >= 0) & (self.more[row] + then[i, np.maximum(to, 0)] == here[i, s])
            s = np.where(delete, s, np.where(keep, to, NEXT[s]))
            letter[row], after[row] = np.where(delete, 0, np.where(keep, 1, 2)), s
            state[at] = s
        return state, inserts, before, letter, after


def _by_chunk(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Tables of whole chunks (rows come in the order of `at`), with the chunks' first rows and their numbers."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        if not len(table):
            continue
        chunk = np.asarray(table["at"], np.int64) >> bits
        whole = int(np.searchsorted(chunk, chunk[-1], "left"))
        held = table.slice(whole)
        if whole:
            yield _starts(table.slice(0, whole), chunk[:whole])
    if held is not None and len(held):
        yield _starts(held, np.asarray(held["at"], np.int64) >> bits)


def _starts(table: pa.Table, chunk: np.ndarray) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    conv = np.asarray(table["conv"].combine_chunks().dictionary_encode().indices)
    new = np.append(True, (chunk[1:] != chunk[:-1]) | (conv[1:] != conv[:-1]))
    return table, np.flatnonzero(new), chunk[new]


def _numbers(table: pa.Table, names: list[str], first: np.ndarray) -> np.ndarray:
    return np.stack([np.asarray(table[c], np.int64)[first] for c in names], 1)


def _vectors(bits: int, basis: bool) -> Callable:
    """Costs before every chunk: for the costs e0..e3 behind it, or (basis) for each single state behind it, a row per state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first, chunk in _by_chunk(batches, bits):
            chunks = _Chunks(first, np.asarray(table["code"], np.int64))
            ends = [np.where(np.arange(4) == j, 0, FAR) * np.ones((len(first), 1), np.int64) for j in range(4)] if basis else [_numbers(table, ["e0", "e1", "e2", "e3"], first)]
            conv = table["conv"].combine_chunks().take(pa.array(first))
            for j, end in enumerate(ends):
                v, _ = chunks.costs(end)
                extra = {"j": pa.array(np.full(len(first), j, np.int32))} if basis else {}
                yield pa.record_batch({"conv": conv, "chunk": pa.array(chunk), **{f"v{i}": pa.array(np.minimum(v[:, i], FAR)) for i in range(4)}, **extra})

    return run


def _maps(bits: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first, chunk in _by_chunk(batches, bits):
            chunks, behind = _Chunks(first, np.asarray(table["code"], np.int64)), _numbers(table, ["e0", "e1", "e2", "e3"], first)
            _, each = chunks.costs(behind)
            ends = [chunks.trace(np.full(len(first), s), behind, each)[0].astype(np.int32) for s in range(4)]
            yield pa.record_batch({"conv": table["conv"].combine_chunks().take(pa.array(first)), "chunk": pa.array(chunk), **{f"m{i}": pa.array(e) for i, e in enumerate(ends)}})

    return run


def _edits(bits: int) -> Callable:
    """A row per turn, and one (at the greatest `at`) for what is inserted behind a conversation's last turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first, _ in _by_chunk(batches, bits):
            chunks, behind = _Chunks(first, np.asarray(table["code"], np.int64)), _numbers(table, ["e0", "e1", "e2", "e3"], first)
            _, each = chunks.costs(behind)
            known = _numbers(table, ["start", "ends"], first)
            state, inserts, before, letter, after = chunks.trace(known[:, 0], behind, each)
            conv = table["conv"].combine_chunks()
            yield pa.record_batch([conv, table["at"].combine_chunks(), pa.array(inserts.astype(np.int32)), pa.array(before.astype(np.int32)), pa.array(np.array(list(LETTERS), object)[letter], pa.string()), pa.array(after.astype(np.int32))], names=["conv", "at", "inserts", "state", "letter", "said"])
            tail = np.flatnonzero((known[:, 1] == 1) & ((state == 1) | (state == 2)))
            if len(tail):
                s, n = state[tail].astype(np.int32), len(tail)
                yield pa.record_batch([conv.take(pa.array(first[tail])), pa.array(np.full(n, 2**63 - 1)), pa.array((3 - s).astype(np.int32)), pa.array(s), pa.array([""] * n), pa.array(np.full(n, 3, np.int32))], names=["conv", "at", "inserts", "state", "letter", "said"])

    return run


def _in_chunks(rows: DataFrame, bits: int) -> DataFrame:
    return rows.repartition("chunk").sortWithinPartitions("at")


def _doubled(rows: DataFrame, far: str, step: Callable[[int], Column], merge: Callable[[], list[Column]], keep: list[str]) -> DataFrame:
    """rows (conv, idx, n, ...) combined with those 1, 2, 4, ... chunks away; `far` renames the columns of the other."""
    longest, reach = rows.agg(F.max("n")).first()[0], 1
    while reach < longest:
        other = rows.select("conv", step(reach).alias("idx"), *(F.col(c).alias(far + c) for c in keep))
        rows = C.checkpointed(rows.join(other, ["conv", "idx"], "left").select("conv", "chunk", "idx", "n", *merge()))
        reach *= 2
    return rows


def _stitched(codes: DataFrame, chunks: DataFrame, bits: int, passes: int) -> DataFrame:
    """(conv, chunk, e0..e3, start, ends) of the chunks (conv, chunk, idx, n) of conversations that have several: the costs behind
    each, up to a constant, the state it starts from, and whether it is the last."""
    vectors, numbers = [f"v{i}" for i in range(4)], [f"e{i}" for i in range(4)]
    end = [F.lit(int(e)).alias(c) for e, c in zip(END, numbers, strict=True)]
    relative = lambda names: [(F.col(c) - F.least(*names)) for c in names]
    rows = codes.join(chunks.select("conv", "chunk"), ["conv", "chunk"])

    def run(with_ends: DataFrame) -> DataFrame:
        again = _in_chunks(rows.join(with_ends.select("conv", "chunk", *numbers), ["conv", "chunk"]), bits)
        return again.mapInArrow(_vectors(bits, basis=False), VECTORS)

    known = chunks.select("*", *end)
    known = C.checkpointed(known.join(run(known), ["conv", "chunk"]))
    for attempt in range(passes + 1):
        after = known.select("conv", (F.col("idx") - 1).alias("idx"), *(c.alias(f"t{i}") for i, c in enumerate(relative(vectors))))
        seen = known.join(after, ["conv", "idx"], "left").withColumns({f"t{i}": F.coalesce(f"t{i}", F.lit(int(e))) for i, e in enumerate(END)})
        same = F.lit(True)
        for i, c in enumerate(relative(numbers)):
            same = same & (c == F.col(f"t{i}"))
        seen = C.checkpointed(seen.withColumn("same", same))
        if not seen.filter(~F.col("same")).limit(1).count():
            return _with_starts(rows, known, bits)
        if attempt == passes:
            break
        wrong = seen.filter(~F.col("same")).select("conv", "chunk", "idx", "n", *(F.col(f"t{i}").alias(f"e{i}") for i in range(4)))
        fixed = wrong.join(run(wrong), ["conv", "chunk"])
        known = C.checkpointed(seen.filter("same").select(known.columns).unionByName(fixed.select(known.columns)))
    # conversations that have not converged: cost matrices, combined by doubling
    open_ = seen.groupBy("conv").agg(F.min("same").alias("all")).filter(~F.col("all")).select("conv")
    some = chunks.join(open_, "conv", "left_semi")
    basis = _in_chunks(rows.join(some.select("conv", "chunk"), ["conv", "chunk"]), bits).mapInArrow(_vectors(bits, basis=True), VECTORS + ", j int")
    cells = [f"c{i}{j}" for i in range(4) for j in range(4)]
    matrix = basis.groupBy("conv", "chunk").agg(*(F.max(F.when(F.col("j") == j, F.col(f"v{i}"))).alias(f"c{i}{j}") for i in range(4) for j in range(4)))
    matrix = C.checkpointed(some.join(matrix, ["conv", "chunk"]))
    product = lambda: [F.when(F.col("o_c00").isNull(), F.col(f"c{i}{j}")).otherwise(F.least(F.lit(FAR), *(F.col(f"c{i}{k}") + F.col(f"o_c{k}{j}") for k in range(4)))).alias(f"c{i}{j}") for i in range(4) for j in range(4)]
    matrix = _doubled(matrix, "o_", lambda reach: F.col("idx") - reach, product, cells)
    exact = matrix.select("conv", (F.col("idx") - 1).alias("idx"), *(F.least(*(F.col(f"c{i}{j}") + int(END[j]) for j in range(4))).alias(f"v{i}") for i in range(4)))
    exact = exact.select("conv", "idx", *(c.alias(f"x{i}") for i, c in enumerate(relative(vectors))))
    settled = some.join(exact, ["conv", "idx"], "left").select("conv", "chunk", "idx", "n", *(F.coalesce(f"x{i}", F.lit(int(e))).alias(f"e{i}") for i, e in enumerate(END)))
    rest = known.join(open_, "conv", "left_anti").select(settled.columns)
    return _with_starts(rows, C.checkpointed(rest.unionByName(settled)), bits)


def _with_starts(rows: DataFrame, known: DataFrame, bits: int) -> DataFrame:
    numbers = [f"e{i}" for i in range(4)]
    maps = _in_chunks(rows.join(known.select("conv", "chunk", *numbers), ["conv", "chunk"]), bits).mapInArrow(_maps(bits), MAPS)
    maps = C.checkpointed(known.select("conv", "chunk", "idx", "n").join(maps, ["conv", "chunk"]))
    pick = lambda at: F.when(at == 0, F.col("m0")).when(at == 1, F.col("m1")).when(at == 2, F.col("m2")).otherwise(F.col("m3"))
    names = [f"m{i}" for i in range(4)]
    chained = _doubled(maps, "o_", lambda reach: F.col("idx") + reach, lambda: [F.when(F.col("o_m0").isNull(), F.col(c)).otherwise(pick(F.col(f"o_{c}"))).alias(c) for c in names], names)
    start = chained.select("conv", (F.col("idx") + 1).alias("idx"), F.col("m0").alias("start"))
    out = known.join(start, ["conv", "idx"], "left").select("conv", "chunk", *numbers, F.coalesce("start", F.lit(0)).alias("start"), (F.col("idx") == F.col("n") - 1).cast("int").alias("ends"))
    return C.checkpointed(out)


def edits(faults: DataFrame, bits: int = BITS, passes: int = PASSES) -> DataFrame:
    """OPS of with_faults() rows: a row per turn that is neither blank nor duplicate, and one for insertions at the end."""
    role = F.when(F.col("initial") == "s", 0).when(F.col("initial") == "u", 1).when(F.col("initial") == "a", 2).otherwise(3)
    codes = faults.filter("fault IN (0, 3)").select("conv", "at", F.shiftright("at", bits).alias("chunk"), (role + F.when(F.col("fault") == 3, 4).otherwise(0)).alias("code"))
    codes = C.written(codes, "codes")
    several = codes.groupBy("conv").agg((F.min("chunk") < F.max("chunk")).alias("several")).filter("several").select("conv")
    whole = [F.lit(int(e)).alias(f"e{i}") for i, e in enumerate(END)] + [F.lit(0).alias("start"), F.lit(1).alias("ends")]
    if not several.limit(1).count():
        return _in_chunks(codes.select("*", *whole), bits).mapInArrow(_edits(bits), OPS)
    several = C.checkpointed(several)
    found = codes.join(several, "conv", "left_semi").select("conv", "chunk").distinct()
    w = Window.partitionBy("conv").orderBy("chunk")  # a row per chunk
    chunks = C.checkpointed(found.select("conv", "chunk", (F.row_number().over(w) - 1).alias("idx"), F.count("*").over(Window.partitionBy("conv")).alias("n")))
    known = _stitched(codes, chunks, bits, passes)
    default = {f"e{i}": int(e) for i, e in enumerate(END)} | {"start": 0, "ends": 1}
    rows = codes.join(known, ["conv", "chunk"], "left").select(*codes.columns, *(F.coalesce(c, F.lit(v)).alias(c) for c, v in default.items()))
    return _in_chunks(rows, bits).mapInArrow(_edits(bits), OPS)


# ---- what comes out ----


def repaired(rows: DataFrame, faults: DataFrame, ops: DataFrame) -> DataFrame:
    """(conv, at, seq, edit, cost, role, text): the edits in order, with the turn that each leaves (null role where it deletes)."""
    gone = faults.filter("fault IN (1, 2)").select("conv", "at", F.lit(0).alias("inserts"), F.lit(0).alias("state"), F.lit("D").alias("letter"), F.lit(0).alias("said"))
    steps = ops.unionByName(gone).join(rows.select("at", "role", "text", "cut"), "at", "left")
    name = lambda s: F.when(s == 2, "user").otherwise("assistant")
    # insertions alternate from the first role that the state allows
    first = F.when(F.col("state") == 2, 3).otherwise(2)
    inserted = F.transform(F.when(F.col("inserts") > 0, F.sequence(F.lit(0), F.col("inserts") - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.struct(F.lit("I").alias("edit"), F.lit(INSERT).alias("cost"), name(F.when(i % 2 == 0, first).otherwise(5 - first)).alias("role"), F.lit("").alias("text")))
    more, letter = F.when(F.col("cut"), TRUNCATED).otherwise(0), F.col("letter")
    cost = F.when(letter == "D", DELETE).when(letter == "K", more).otherwise(REROLE + more)
    role = F.when(letter == "K", F.col("role")).when(letter == "R", name(F.col("said")))
    own = F.when(letter != "", F.array(F.struct(letter.alias("edit"), cost.alias("cost"), role.alias("role"), F.when(letter != "D", F.col("text")).alias("text")))).otherwise(F.array().cast("array<struct<edit:string,cost:int,role:string,text:string>>"))
    return steps.select("conv", "at", F.posexplode(F.concat(inserted, own)).alias("seq", "e")).select("conv", "at", "seq", "e.edit", "e.cost", "e.role", "e.text")


def costs(faults: DataFrame, ops: DataFrame) -> DataFrame:
    """(conv, cost) of all edits, without the texts: an undeleted turn's fault is that it is truncated, or it has none."""
    own = F.when(F.col("letter") == "D", DELETE).when(F.col("letter") == "R", REROLE).otherwise(0)
    paid = ops.select("conv", "at", (own + INSERT * F.col("inserts")).alias("cost"), F.col("letter").isin("K", "R").alias("said"))
    cut = faults.filter("fault = 3").select("at", F.lit(TRUNCATED).alias("more"))
    paid = paid.join(cut, "at", "left").select("conv", (F.col("cost") + F.when(F.col("said"), F.coalesce("more", F.lit(0))).otherwise(0)).alias("cost"))
    gone = faults.filter("fault IN (1, 2)").select("conv", F.lit(DELETE).alias("cost"))
    return paid.unionByName(gone).groupBy("conv").agg(F.sum("cost").alias("cost"))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The audit and the hash of each conversation; its edits come in order and none is held."""
    conv, letters, digest, empty = None, [], hashlib.sha256(), True

    def out() -> pa.RecordBatch:
        return pa.record_batch({"conv": [conv], "audit": ["".join(letters)], "repaired_sha256": [digest.hexdigest()]})

    for batch in batches:
        for c, edit, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv", "edit", "role", "text")), strict=True):
            if c != conv:
                if conv is not None:
                    yield out()
                conv, letters, digest, empty = c, [], hashlib.sha256(), True
            letters.append(edit)
            if role is not None:
                digest.update(("" if empty else "\n").encode() + f"{role}:{text}".encode())
                empty = False
    if conv is not None:
        yield out()


def repair_digests(turns: DataFrame, bits: int = BITS, passes: int = PASSES, damaged: bool = True) -> DataFrame:
    """One row per conv_id of `turns`: faults after damage, the cost and initials of the cheapest edits, the repaired text's hash."""
    plain = _plain(turns)
    rows = ordered(damage(plain) if damaged else plain)
    faults = C.written(with_faults(rows), "faults")
    ops = C.written(edits(faults, bits, passes), "edits")
    text = repaired(rows, faults, ops).repartition("conv").sortWithinPartitions("conv", "at", "seq").mapInArrow(_digest, "conv string, audit string, repaired_sha256 string")
    cost = costs(faults, ops)
    every = plain.groupBy("conv").agg(F.first("conv_id").alias("conv_id"))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    out = every.join(statistics(faults, bits), "conv", "left").join(cost, "conv", "left").join(text, "conv", "left")
    empty = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))


#: Forward, by (cost, audit) of every state after every turn; crc32 from its polynomial.
ORACLE_SQL = r"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
plain AS (SELECT conv_id, coalesce('=' || conv_id, '') AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
crc AS (SELECT plain.*, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda c: ascii(c)::BIGINT)), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]))) % 20 AS kind FROM plain, tab),
hurt AS (SELECT conv, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy FROM crc WHERE kind <> 0),
told AS (SELECT *, sha256(length(role) || ':' || role || text) AS h, CASE WHEN role = '' THEN ' ' ELSE left(role, 1) END AS i, rtrim(text, E' \t\n\x0B\x0C\r') AS bare FROM hurt),
ord AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, h) AS p FROM told),
f AS (SELECT *, CASE WHEN bare = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv, h ORDER BY p) > 1 THEN 2 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
    lag(i) OVER (PARTITION BY conv ORDER BY p) || i AS pair, right(bare, 1) NOT IN ('.', '!', '?') AS cut FROM ord),
st AS (SELECT conv, max(p) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
    count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv),
ins(s, t, c, a, o) AS (VALUES (0, 0, 0, '', []), (0, 2, 2, 'I', ['user:']), (0, 3, 4, 'II', ['user:', 'assistant:']), (1, 1, 0, '', []), (1, 2, 2, 'I', ['user:']), (1, 3, 4, 'II', ['user:', 'assistant:']),
    (2, 2, 0, '', []), (2, 3, 2, 'I', ['assistant:']), (3, 3, 0, '', []), (3, 2, 2, 'I', ['user:'])),
say(s, t, i, r) AS (VALUES (0, 1, 's', NULL), (0, 2, 'u', 'user'), (1, 2, 'u', 'user'), (2, 3, 'a', 'assistant'), (3, 2, 'u', 'user')),
edit AS (SELECT conv, p, s, s AS t, 3 AS c, 'D' AS a, []::VARCHAR[] AS o FROM f, (SELECT DISTINCT s FROM ins)
    UNION ALL SELECT conv, p, s, t, cut::INT, 'K', [role || ':' || text] FROM f JOIN say USING (i) WHERE fault IN (0, 3)
    UNION ALL SELECT conv, p, s, t, 2 + cut::INT, 'R', [r || ':' || text] FROM f, say WHERE fault IN (0, 3) AND r IS NOT NULL),
step AS (SELECT conv, p, ins.s, e.t, ins.c + e.c AS c, ins.a || e.a AS a, ins.o || e.o AS o FROM edit e JOIN ins ON ins.t = e.s),
dp AS (SELECT DISTINCT conv, 0::BIGINT AS p, 0 AS s, 0 AS c, '' AS a, []::VARCHAR[] AS o FROM f
    UNION ALL SELECT conv, p, t, b.c, b.a, b.o FROM (SELECT step.conv, step.p, t, min({'c': dp.c + step.c, 'a': dp.a || step.a, 'o': dp.o || step.o}) AS b
        FROM dp JOIN step ON step.conv = dp.conv AND step.p = dp.p + 1 AND step.s = dp.s GROUP BY ALL)),
fin AS (SELECT conv, min({'c': dp.c + ins.c, 'a': dp.a || ins.a, 'o': dp.o || ins.o}) AS b FROM dp JOIN st USING (conv) JOIN ins ON ins.s = dp.s WHERE dp.p = st.n AND ins.t IN (0, 3) GROUP BY conv)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
    coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b.c, 0)::BIGINT AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(array_to_string(b.o, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, conv FROM plain) LEFT JOIN st USING (conv) LEFT JOIN fin USING (conv)"""
