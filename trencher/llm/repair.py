"""Conversation structure repair by a square-root checkpointed dynamic programme.

A conversation is repaired by the cheapest edits after which its roles' initials
are ``(s?(ua)+)?``.  Four states tell how far that pattern is; the state-cost
vector of a row holds the cheapest end from each of them.

Rows are dealt into blocks of ``BLOCK`` in order.  A block's effect on costs is a
4 x 4 matrix, made where the block is, so vectors are stored only at block ends,
the checkpoints; a conversation's matrices are folded backwards over them.  Each
block then recomputes its own vectors from its checkpoint and walks forward from
all four states along tight edits, taking the ASCII-least at each row; joining
the walks needs only where each one ends.  One short row of letters stands for a
block, so a conversation with a third of all rows is spread over many tasks; it
is streamed through one task only for the digest of its texts, which is
sequential.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trencher.llm.shared import stored, type_of

BLOCK = 4096
INSERT, REROLE, DELETE = 2, 2, 3
STATES = range(4)
#: State after a user and after an assistant turn; a system turn leads from 0 to 1.
NEXT = {"u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "s": {0: 1}}
#: The cheapest inserts that complete the pattern.
ENDS = (0, 4, 2, 0)
NAMES = {"u": "user", "a": "assistant"}
FAR = 1 << 60
BARE = r"[^\x20\x09-\x0D]"
ENDED = r"[.!?][\x20\x09-\x0D]*\z"
FAULTS = ("blank", "duplicate", "truncated")


def _turn(state: int) -> str:
    return "a" if state == 2 else "u"


def _options(letter: str, state: int):
    """(edit, cost, next state) of a row: its initial, upper case if it must go, and ``!`` after a truncated one's."""
    yield "D", DELETE, state
    if not letter[0].isupper():
        cut = letter.endswith("!")
        if state in NEXT.get(letter[0], ()):
            yield "K", int(cut), NEXT[letter[0]][state]
        yield "R", REROLE + cut, NEXT[_turn(state)][state]


@lru_cache(100_000)
def _before(letter: str, after: tuple[int, ...]) -> tuple[int, ...]:
    """The state-cost vector before a row, inserts included."""
    own = [min(cost + after[to] for _, cost, to in _options(letter, q)) for q in STATES]
    for _ in range(2):  # two inserts at most are ever worth their cost
        own = [min(own[q], INSERT + own[NEXT[_turn(q)][q]]) for q in STATES]
    return tuple(own)


def _letters(codes: str):
    """One letter a row, an exclamation mark after a truncated one's."""
    return [c + "!" if codes[i + 1:i + 2] == "!" else c for i, c in enumerate(codes) if c != "!"]


def matrix(codes: str) -> list[list[int]]:
    """``m[p][q]``: the cheapest way through a block from state ``p`` to state ``q``."""
    columns = []
    for q in STATES:
        cost = tuple(0 if p == q else FAR for p in STATES)
        for letter in reversed(_letters(codes)):
            least = min(cost)
            cost = tuple(c + least for c in _before(letter, tuple(min(c - least, FAR) for c in cost)))
        columns.append(cost)
    return [[min(columns[q][p], FAR) for q in STATES] for p in STATES]


def walks(codes: str, after: list[int]) -> list[tuple[str, int]]:
    """For each state before a block: the ASCII-least cheapest edits and the state behind it, ``after`` being the costs from there on."""
    rows = _letters(codes)
    costs = [tuple(after)]
    for letter in reversed(rows):
        least = min(costs[-1])
        costs.append(tuple(c + least for c in _before(letter, tuple(c - least for c in costs[-1]))))
    costs.reverse()
    out = []
    for q in STATES:
        edits = []
        for i, letter in enumerate(rows):
            while True:
                left = costs[i][q]
                tight = {edit: to for edit, cost, to in _options(letter, q) if cost + costs[i + 1][to] == left}
                into = NEXT[_turn(q)][q]
                if INSERT + costs[i][into] == left and "D" not in tight:
                    edits.append("I")
                    q = into
                    continue
                edit = min(tight)
                edits.append(edit)
                q = tight[edit]
                break
        out.append(("".join(edits), q))
    return out


@lru_cache(10_000)
def _alone(codes: str) -> tuple[int, tuple]:
    """The cost of a conversation of one block, and its walks."""
    own = matrix(codes)
    return min(own[0][q] + ENDS[q] for q in STATES), tuple(walks(codes, list(ENDS)))


def coded(rows: DataFrame) -> DataFrame:
    """``conv, row, turn, initial, fault`` of stored ``rows`` (``row, conv, turn, role, text``): a row's place and its first fault.

    Rows stand by turn, nulls first; rows of equal turn by role, then by the MD5
    of the text, so equal rows are neighbours.
    """
    light = rows.select(F.col("row").alias("given"), "conv", "turn", "role", F.unhex(F.md5("text")).alias("md5"),
                        (~F.col("text").rlike(BARE)).alias("blank"), (~F.col("text").rlike(ENDED)).alias("cut"))
    order = [F.col(c).asc_nulls_first() for c in ("conv", "turn", "role", "md5", "given")]
    light = light.repartitionByRange(*order).sortWithinPartitions(*order)
    light = stored(light.withColumn("row", F.monotonically_increasing_id()), "ordered_turns")
    several = light.groupBy("conv", "role", "md5").agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1")
    seen = several.select(F.col("conv").alias("conv_"), F.col("role").alias("role_"), F.col("md5").alias("md5_"), "first")
    found = light.join(seen, F.col("conv").eqNullSafe(F.col("conv_")) & (F.col("role") == F.col("role_")) & (F.col("md5") == F.col("md5_")), "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("row") > F.col("first"), "duplicate").when(F.col("cut"), "truncated")
    return found.select("given", "conv", "row", "turn", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))


def _blocks(codes: DataFrame, block: int) -> DataFrame:
    """``conv, block, codes, first, last``: rows of one conversation in groups of at most ``block``, in order."""
    initial = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("x")
    letter = F.when(F.col("fault").isin("blank", "duplicate"), F.upper(initial)).when(F.col("fault") == "truncated", F.concat(initial, F.lit("!"))).otherwise(initial)
    own = codes.select("conv", F.expr(f"row DIV {block}").alias("block"), "row", letter.alias("letter"), "initial")
    own = own.groupBy("conv", "block").agg(F.array_sort(F.collect_list(F.struct("row", "letter", "initial"))).alias("rows"))
    pair = F.zip_with(F.slice("rows", 1, F.size("rows") - 1), F.slice("rows", 2, F.size("rows")), lambda x, y: F.concat(x["initial"], y["initial"]))
    return own.select("conv", "block", F.array_join(F.transform("rows", lambda r: r["letter"]), "").alias("codes"), F.element_at("rows", 1)["initial"].alias("first"),
                      F.element_at("rows", -1)["initial"].alias("last"), F.size(F.filter(pair, lambda p: ~p.isin("su", "ua", "au"))).alias("illegal"))


def _solved(blocks: DataFrame) -> DataFrame:
    """``conv, cost, illegal, parts``: per conversation its cost, and per block in order its edits (``block, edits``)."""
    def through(batches):
        import pyarrow as pa

        for batch in batches:
            codes = batch.column(0).to_pylist()
            flat = [[v for line in matrix(c) for v in line] if c is not None else None for c in codes]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(codes), pa.array(flat, pa.list_(pa.int64()))], [*batch.schema.names[1:], "codes", "through"])

    def checkpoints(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("block", pa.int64()), ("after", pa.list_(pa.int64()))]))
        for batch in batches:
            costs, ends, illegal = [], [], []
            for own in batch.column(1).to_pylist():
                after, places = list(ENDS), []
                for x in reversed(own):
                    places.append({"block": x["block"], "after": after})
                    after = [min(x["through"][4 * p + q] + after[q] for q in STATES) for p in STATES]
                costs.append(after[0])
                ends.append(places)
                illegal.append(sum(x["illegal"] for x in own) + sum(x["last"] + y["first"] not in ("su", "ua", "au") for x, y in zip(own, own[1:])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(costs, pa.int64()), pa.array(illegal, pa.int64()), pa.array(ends, kind)], ["conv", "cost", "illegal", "ends"])

    def walked(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("edits", pa.string()), ("to", pa.int32())]))
        for batch in batches:
            out = [[{"edits": e, "to": q} for e, q in walks(c, a)] for c, a in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, kind)], ["conv", "block", "ways"])

    def alone(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("block", pa.int64()), ("edits", pa.string()), ("state", pa.int32())]))
        for batch in batches:
            found = [_alone(c) for c in batch.column(2).to_pylist()]
            parts = [[{"block": b, "edits": f[1][0][0] + "I" * (ENDS[f[1][0][1]] // INSERT), "state": 0}] for b, f in zip(batch.column(1).to_pylist(), found)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.int64()), batch.column(3).cast(pa.int64()), pa.array(parts, kind)],
                                             ["conv", "cost", "illegal", "parts"])

    def chained(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("block", pa.int64()), ("edits", pa.string()), ("state", pa.int32())]))
        for batch in batches:
            parts = []
            for own in batch.column(3).to_pylist():
                q, chain = 0, []
                for x in own:
                    way = x["ways"][q]
                    chain.append({"block": x["block"], "edits": way["edits"], "state": q})
                    q = way["to"]
                chain[-1]["edits"] += "I" * (ENDS[q] // INSERT)
                parts.append(chain)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(parts, kind)], ["conv", "cost", "illegal", "parts"])

    conv = f"conv {type_of(blocks, 'conv')}"
    parts = "parts array<struct<block: bigint, edits: string, state: int>>"
    sizes = stored(blocks.groupBy("conv").agg(F.count("*").alias("n")).where("n > 1"), "long_conversations").select(F.col("conv").alias("of"))
    short = blocks.join(sizes, F.col("conv").eqNullSafe(F.col("of")), "left_anti").select("conv", "block", "codes", "illegal").mapInArrow(
        alone, f"{conv}, cost long, illegal long, {parts}")
    longer = blocks.join(sizes, F.col("conv").eqNullSafe(F.col("of")), "left_semi").select("codes", "conv", "block", "first", "last", "illegal")
    longer = stored(longer.mapInArrow(through, f"{conv}, block long, first string, last string, illegal int, codes string, through array<bigint>"), "block_matrices")
    ends = longer.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("block", "through", "first", "last", "illegal"))).alias("own"))
    ends = stored(ends.mapInArrow(checkpoints, f"{conv}, cost long, illegal long, ends array<struct<block: bigint, after: array<bigint>>>"), "checkpoints")
    at = ends.select(F.col("conv").alias("of"), F.inline("ends").alias("block_", "after"))
    ways = longer.join(at, F.col("conv").eqNullSafe(F.col("of")) & (F.col("block") == F.col("block_"))).select("conv", "block", "codes", "after").mapInArrow(
        walked, f"{conv}, block long, ways array<struct<edits: string, to: int>>")
    ways = ways.groupBy(F.col("conv").alias("of")).agg(F.array_sort(F.collect_list(F.struct("block", "ways"))).alias("own"))
    joined = ends.join(ways, F.col("conv").eqNullSafe(F.col("of"))).select("conv", "cost", "illegal", "own").mapInArrow(chained, f"{conv}, cost long, illegal long, {parts}")
    return short.unionByName(joined)


class _Lines:
    """The digest of one conversation's repaired lines, row by row."""

    def __init__(self):
        self.digest, self.started, self.edits, self.at, self.state = hashlib.sha256(), False, "", 0, 0

    def add(self, line: str, state: int) -> None:
        self.digest.update((("\n" if self.started else "") + line).encode("utf-8", "surrogatepass"))
        self.started, self.state = True, state

    def inserts(self) -> None:
        while self.edits[self.at:self.at + 1] == "I":
            own = _turn(self.state)
            self.at += 1
            self.add(NAMES[own] + ":", NEXT[own][self.state])

    def begin(self, edits: str, state: int) -> None:
        self.edits, self.at, self.state = edits, 0, state

    def row(self, role: str, text: str) -> None:
        self.inserts()
        edit, own = self.edits[self.at], _turn(self.state)
        self.at += 1
        if edit == "K":
            self.add(f"{role}:{text}", NEXT[role[0]][self.state])
        elif edit == "R":
            self.add(f"{NAMES[own]}:{text}", NEXT[own][self.state])


def _digests(rows: DataFrame, codes: DataFrame, parts: DataFrame, block: int) -> DataFrame:
    """``conv, repaired_sha256``: each conversation streamed once, in order."""
    def run(batches):
        import pyarrow as pa

        conv, lines, block_, out, kind = None, None, None, [], None

        def done():
            lines.inserts()
            out.append((conv, lines.digest.hexdigest()))

        def flushed():
            return pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], kind), pa.array([d for _, d in out])], ["conv", "repaired_sha256"])

        for batch in batches:
            kind = batch.column(0).type
            for of, at, role, text, edits, state in zip(*(c.to_pylist() for c in batch.columns)):
                if lines is None or of != conv:
                    if lines is not None:
                        done()
                    conv, lines, block_ = of, _Lines(), None
                if at != block_:
                    lines.inserts()
                    lines.begin(edits, state)
                    block_ = at
                lines.row(role, text)
            if len(out) > 1000:
                yield flushed()
                out = []
        if lines is not None:
            done()
            yield flushed()

    edits = parts.select(F.col("conv").alias("of"), F.inline("parts").alias("at", "edits", "state"))
    # A block's edits are bounded and go to its own rows.
    light = codes.select("conv", "given", "row", F.expr(f"row DIV {block}").alias("block")).join(edits, F.col("conv").eqNullSafe(F.col("of")) & (F.col("block") == F.col("at")))
    placed = light.drop("of", "at").join(rows.select(F.col("row").alias("given"), "role", "text"), "given")
    placed = placed.repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), "row")
    return placed.select("conv", "block", "role", "text", "edits", "state").mapInArrow(run, f"conv {type_of(rows, 'conv')}, repaired_sha256 string")


def repaired(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per conversation of ``turns``: ``conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    A row's first fault counts: blank (no character but white space), duplicate
    (role and text seen earlier in the conversation) or truncated (its last such
    character is none of ``.!?``).  ``illegal``: neighbours whose roles' initials
    are none of su, ua and au; ``gaps``: turns missing between the least and the
    greatest.  ``audit``: the edits in order, K(eep), R(erole), D(elete) and
    I(nsert); ``repaired_sha256``: of the lines ``role:text`` after them.

    Null roles and texts are one space; rows of null turn come first; rows of a
    null conversation are one conversation; rows of equal turn stand by role and
    the MD5 of the text; repeated rows are rows.  Other columns are not read.
    """
    filled = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    rows = turns.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), filled(role).alias("role"), filled(text).alias("text"))
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "turns").select("row", "conv", "turn", "role", "text")
    codes = stored(coded(rows), "codes")
    solved = stored(_solved(stored(_blocks(codes, block), "blocks")), "solved")
    digests = _digests(rows, codes, solved, block)
    turns_ = codes.groupBy("conv", "turn").agg(*[F.count_if(F.col("fault") == f).alias(f) for f in FAULTS])
    counts = turns_.groupBy("conv").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"),
                                        *[F.sum(f).alias(f) for f in FAULTS])
    audit = F.array_join(F.transform("parts", lambda p: p["edits"]), "")
    out = counts.join(solved.select(F.col("conv").alias("of"), "illegal", "cost", audit.alias("audit")), F.col("conv").eqNullSafe(F.col("of"))).drop("of")
    return out.join(digests.withColumnRenamed("conv", "of"), F.col("conv").eqNullSafe(F.col("of"))).select(
        F.col("conv").alias(conv), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damaged(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", of: int = 20) -> DataFrame:
    """``turns`` with planted faults, told by the CRC-32 of ``conv:turn`` modulo ``of``.

    0 drops a row, 1 empties its text, 2 takes its ``.!?`` away, 3 repeats it and
    4 makes its role user.  A null in any column is one space there.
    """
    filled = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(filled(conv), F.lit(":"), filled(turn)).cast("binary")) % of
    rows = turns.select(F.col(f"`{conv}`"), F.col(f"`{turn}`"), filled(role).alias(role), filled(text).alias(text), kind.alias("kind_")).where("kind_ != 0")
    hurt = F.when(F.col("kind_") == 1, "").when(F.col("kind_") == 2, F.regexp_replace(f"`{text}`", "[.!?]", "")).otherwise(F.col(f"`{text}`"))
    rows = rows.select(f"`{conv}`", f"`{turn}`", F.when(F.col("kind_") == 4, "user").otherwise(F.col(f"`{role}`")).alias(role), hurt.alias(text), F.col("kind_"),
                       F.explode(F.when(F.col("kind_") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy_"))
    return rows.drop("kind_", "copy_")


def repaired_after_damage(turns: DataFrame, conv: str = "conv_id", block: int = BLOCK) -> DataFrame:
    """``repaired`` of ``damaged`` turns, with a row for each conversation of ``turns``; one without rows left has zeros and empty strings."""
    found = repaired(damaged(turns), block=block)
    every = turns.select(F.col(conv).alias("of")).distinct()
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return every.join(found, F.col("of").eqNullSafe(F.col(conv)), "left").select(
        F.col("of").alias(conv), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
