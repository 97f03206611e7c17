"""Chat formatting: minimum-cost role repair by dynamic programming over a legal-turn automaton, then rendering.

A legal conversation is an optional system turn, then user and assistant turns in alternation, user first, assistant last. Each turn is kept under its
role or relabelled, and stands alone or is merged into the turn before; empty turns are inserted where the automaton needs them. The
cheapest sequence of edits wins; among equally cheap ones a hash of the turns decides, so the result does not depend on how rows are dealt out.

A conversation may hold any share of all rows. Rows are range-sorted by conversation and turn and written; each partition sums up its part of
a conversation as a matrix of costs from state to state (least-cost matrices multiply as min and plus). Only the parts at the two ends of a partition can
belong to conversations that go on elsewhere: their matrices, two a partition at most, are put together on the driver, which gives each
part its states at both ends. Then each partition repairs and renders its rows.

The result has one row a turn: the rendered text of a conversation is that of its rows' fragments, in order.

Null texts count as empty; very long ones are taken whole. Roles are trimmed, lower-cased and mapped by alias; null and unknown roles are relabelled. Null
conversation ids are one conversation. Null turns come first. Rows of equal turn are ordered by role and text; rows that repeat all four are turns of
their own, and which is which does not matter. An empty table gives an empty one. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duoscope.llm.common import ddl
from duoscope.runtime import materialize

ROLES = ("system", "user", "assistant")
ALIASES = {"system": "system", "developer": "system", "user": "user", "human": "user", "prompter": "user", "assistant": "assistant", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant"}
MERGE, INSERT, RELABEL, UNKNOWN = 2, 3, 4, 1
OPEN, CLOSE, JOIN = "<|{role}|>\n", "<|end|>\n", "\n"
#: States: nothing yet, or the role of the last turn. Inserted turns on the way from a state to a new turn of a role.
STATES = ("", *ROLES)
PATHS: dict[tuple[int, int], tuple[str, ...]] = {
    (0, 1): (), (0, 2): (), (0, 3): ("user",), (1, 2): (), (1, 3): ("user",), (2, 3): (), (2, 2): ("assistant",), (3, 2): (), (3, 3): ("user",),
}
ENDS: dict[int, tuple[str, ...]] = {0: (), 1: ("user", "assistant"), 2: ("assistant",), 3: ()}
SHIFT = 64
#: Bytes of text in a part, about; a worker holds one conversation of a part at a time.
PART_BYTES = 32 << 20
KEYS = ("conv", "turn", "role", "text", "place")
NEVER = 1 << 200


class Step(NamedTuple):
    """A way to take a turn: state before and after, role given, merged or not, inserted roles, cost."""

    before: int
    after: int
    merged: bool
    inserted: tuple[str, ...]
    cost: int


def steps(role: str | None, seed: int) -> list[Step]:
    """All legal ways. The low bits of a cost are a hash of the turn (seed) and the way: sums of them break ties alike wherever they are made."""
    own = ALIASES.get((role or "").strip().lower())
    out = []
    for before in range(4):
        for after in (1, 2, 3):
            label = (UNKNOWN if own is None else RELABEL) if own != ROLES[after - 1] else 0
            ways = [(True, (), MERGE)] if before == after else []
            if (before, after) in PATHS:
                ways.append((False, PATHS[before, after], INSERT * len(PATHS[before, after])))
            for merged, inserted, cost in ways:
                noise = xxhash.xxh64_intdigest(bytes((before, after, merged)), seed & (2**63 - 1)) >> 32
                out.append(Step(before, after, merged, inserted, ((label + cost) << SHIFT) + noise))
    return out


Vector = list[int]
START: Vector = [0, NEVER, NEVER, NEVER]


def advance(costs: Vector, ways: list[Step]) -> Vector:
    out = [NEVER] * 4
    for w in ways:
        out[w.after] = min(out[w.after], costs[w.before] + w.cost)
    return out


def final(costs: Vector) -> Vector:
    return [c + ((INSERT * len(ENDS[s])) << SHIFT) for s, c in enumerate(costs)]


def entry_state(costs: Vector, matrix: list[Vector], after: int) -> int:
    return min(range(4), key=lambda s: costs[s] + matrix[s][after])


def decode(turns: list[tuple], before: int, after: int) -> list[Step]:
    """The cheapest steps from one state to the other."""
    costs = [NEVER] * 4
    costs[before] = 0
    trail = []
    for _, role, seed, *_ in turns:
        ways, best = steps(role, seed), [None] * 4
        out = [NEVER] * 4
        for w in ways:
            c = costs[w.before] + w.cost
            if c < out[w.after]:
                out[w.after], best[w.after] = c, w
        costs = out
        trail.append(best)
    path, state = [], after
    for best in reversed(trail):
        path.append(best[state])
        state = best[state].before
    return path[::-1]


def runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv, role, seed, and turn and text where they are read) of sorted rows."""
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("conv", "role", "seed", "turn", "text") if c in batch.schema.names), strict=True)


def ends(part: int, batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """(part, conv, is first, is last, matrix) of the first and the last conversation of a partition."""
    first, conv, matrix, seen = True, None, None, False
    for c, role, seed, *_ in runs(batches):
        if seen and c != conv:
            if first:
                yield part, conv, True, False, matrix
                first = False
            matrix = None
        if matrix is None:
            matrix = [[0 if i == j else NEVER for j in range(4)] for i in range(4)]
        conv, seen = c, True
        ways = steps(role, seed)
        matrix = [advance(v, ways) for v in matrix]
    if seen:
        yield part, conv, first, True, matrix


#: Turns whose steps a worker holds at a time when it goes back over a conversation.
SEGMENT = 20_000


def repair(turns: Iterator[tuple], costs: Vector, matrix_end: int | None) -> Iterator[tuple[tuple, Step]]:
    """Steps of a part of a conversation that starts with these costs and ends in a given state (None: it ends there, in the cheapest one).

    Long parts are cut into segments: matrices give the states at the cuts, then each segment is decoded by itself.
    """
    segments: list[list[tuple]] = []
    for t in turns:
        if not segments or len(segments[-1]) >= SEGMENT:
            segments.append([])
        segments[-1].append(t)
    matrices = []
    for s in segments:
        m = [[0 if i == j else NEVER for j in range(4)] for i in range(4)]
        for _, role, seed, *_ in s:
            ways = steps(role, seed)
            m = [advance(v, ways) for v in m]
        matrices.append(m)
    vectors = [costs]
    for m in matrices:
        vectors.append([min(vectors[-1][i] + m[i][j] for i in range(4)) for j in range(4)])
    state = matrix_end if matrix_end is not None else min(range(4), key=lambda j: final(vectors[-1])[j])
    states = [state]
    for v, m in zip(reversed(vectors[:-1]), reversed(matrices), strict=True):
        states.append(entry_state(v, m, states[-1]))
    states.reverse()
    for k, s in enumerate(segments):
        yield from zip(s, decode(s, states[k], states[k + 1]), strict=True)


def fragment(step: Step, text: str, at_start: bool, last: bool) -> str:
    if step.merged:
        out = JOIN
    else:
        out = "" if at_start else CLOSE
        for role in step.inserted:
            out += OPEN.format(role=role) + CLOSE
        out += OPEN.format(role=ROLES[step.after - 1])
    out += text
    if last:
        out += CLOSE + "".join(OPEN.format(role=r) + CLOSE for r in ENDS[step.after])
    return out


def shared_states(rows: list[tuple]) -> dict[tuple[int, object], tuple[Vector, int | None, bool, bool]]:
    """For parts of conversations that lie in several partitions: costs at the start, state at the end (None: open), whether it starts and ends here."""
    by_conv: dict[object, list[tuple]] = {}
    for part, conv, _, _, matrix in rows:
        by_conv.setdefault(conv, []).append((part, matrix))
    out = {}
    for conv, parts in by_conv.items():
        if len(parts) == 1:
            continue
        parts.sort(key=lambda x: x[0])
        vectors = [START]
        for _, m in parts:
            vectors.append([min(vectors[-1][i] + m[i][j] for i in range(4)) for j in range(4)])
        state = min(range(4), key=lambda j: final(vectors[-1])[j])
        for k in range(len(parts) - 1, -1, -1):
            out[parts[k][0], conv] = (vectors[k], state, k == 0, k == len(parts) - 1)
            state = entry_state(vectors[k], parts[k][1], state)
    return out


def format_chats(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per turn: conversation, turn, role, new_role, action (keep, relabel), merged, inserted (roles of empty turns before it), closing (roles of
    empty turns after it), cost, fragment, place (in the order of all rows)."""
    rows = conversations.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    ).withColumn("place", F.monotonically_increasing_id())  # so that many equal rows can be cut apart
    spark = conversations.sparkSession
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text") + F.lit(64)), F.lit(0))).first()[0]
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(size) // PART_BYTES))
    kind = ddl(rows.schema["conv"].dataType)
    sorted_ = rows.repartitionByRange(n, *KEYS).sortWithinPartitions(*KEYS)
    seed = F.xxhash64("turn", "role", "text").bitwiseAND(F.lit((1 << 63) - 1))
    table = materialize(sorted_.select("conv", "turn", "role", "text", "place", seed.alias("seed"), F.spark_partition_id().alias("part")), "turns")
    ends_kind = f"part int, conv {kind}, first boolean, last boolean, matrix array<string>"

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, batches = opened(batches)
        if first is None:
            return
        found = list(ends(first.column("part")[0].as_py(), batches))
        kinds = [pa.int32(), first.schema.field("conv").type, pa.bool_(), pa.bool_(), pa.list_(pa.string())]
        columns = [[f[0] for f in found], [f[1] for f in found], [f[2] for f in found], [f[3] for f in found], [[str(x) for v in f[4] for x in v] for f in found]]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["part", "conv", "first", "last", "matrix"])

    bounds = one_task_per_part(table.drop("text"), n).mapInArrow(sums, ends_kind).collect()  # two rows a partition
    shared = shared_states([(r["part"], r["conv"], r["first"], r["last"], [[int(x) for x in r["matrix"][4 * i : 4 * i + 4]] for i in range(4)]) for r in bounds])
    states = spark.sparkContext.broadcast(shared)
    out_kind = f"conv {kind}, turn long, role string, new_role string, action string, merged boolean, inserted array<string>, closing array<string>, cost long, fragment string, place long"

    def render(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, batches = opened(batches)
        if first is None:
            return
        part, conv_kind = first.column("part")[0].as_py(), first.schema.field("conv").type
        names = ["conv", "turn", "role", "new_role", "action", "merged", "inserted", "closing", "cost", "fragment", "place"]
        kinds = [conv_kind, pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.string()), pa.int64(), pa.string(), pa.int64()]
        place = part << 40
        held: list[tuple] = []
        for conv, turns in conversations_of(runs(batches)):
            costs, end, starts_here, ends_here = states.value.get((part, conv), (START, None, True, True))
            count = len(turns)
            for i, ((_, role, _, turn, text), step) in enumerate(repair(iter(turns), costs, end)):
                last = ends_here and i == count - 1
                new = ROLES[step.after - 1]
                same = ALIASES.get((role or "").strip().lower()) == new
                closing = list(ENDS[step.after]) if last else []
                cost = (step.cost >> SHIFT) + INSERT * len(closing)
                held.append((conv, turn, role, new, "keep" if same else "relabel", step.merged, list(step.inserted), closing, cost, fragment(step, text, starts_here and i == 0, last), place))
                place += 1
                if len(held) >= 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
                    held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)

    return one_task_per_part(table, n).mapInArrow(render, out_kind).withColumnsRenamed({"conv": conv_col, "turn": turn_col, "role": role_col})


def opened(batches: Iterable[pa.RecordBatch]) -> tuple[pa.RecordBatch | None, Iterator[pa.RecordBatch]]:
    """The first batch with rows, and all batches from it on."""
    batches = iter(batches)
    first = next((b for b in batches if b.num_rows), None)
    return first, chain([first] if first is not None else [], batches)


def conversations_of(rows: Iterator[tuple]) -> Iterator[tuple[object, list[tuple]]]:
    held: list[tuple] = []
    for row in rows:
        if held and held[0][0] != row[0]:
            yield held[0][0], held
            held = []
        held.append(row)
    if held:
        yield held[0][0], held


def one_task_per_part(table: DataFrame, n: int) -> DataFrame:
    """A scan may cut a file; parts must be whole and in order, so each is dealt to a task of its own and sorted again."""
    return table.repartitionById(n, "part").sortWithinPartitions(*KEYS)


def rendered(fragments: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Whole rendered conversations, for tables whose conversations each fit in a row."""
    parts = F.sort_array(F.collect_list(F.struct(F.col("place").alias("p"), F.col("fragment").alias("f"))))
    return fragments.groupBy(conv_col).agg(F.array_join(F.transform(parts, lambda x: x["f"]), "").alias("text"), F.sum("cost").alias("cost"))
