"""Conversation structure repair by weighted finite-state composition.

Three machines are composed.  The input acceptor spells a conversation's rows in order, an
edit transducer keeps, renames, deletes or inserts rows at a cost, and a grammar acceptor
takes the role initials ``(s?(ua)+)?``.  A state is (row, grammar state); the arcs of a
kind of row are composed when such a row is first met.  At most two insertions stand
between two rows: a third comes back to a grammar state left before, and dearer, so the
machine has no cycles and its topological order is that of the rows.

Weights are (cost, labels), compared by cost and then by the labels' string.  Costs are
added up from the end, which gives every state the cost of its cheapest way out.  Labels
are then read from the start: from a state no two arcs bear one label, so taking the least
label among the arcs on a cheapest way gives the least string.  (Strings compared from
the start would go wrong where one begins the other.)

Rows are sorted over all conversations into ranges, as codes without texts, and cut into
chunks.  Conversations inside a chunk are solved where they lie.  Those that a cut may
divide, whatever their length, are solved from their pieces: a piece is a 4x4 matrix of
costs between grammar states, a conversation multiplies its matrices from the end to find
what each piece's exits cost, and each piece then gives its labels for the state it is
entered in.  Texts are shuffled once, to meet the labels, and stream through a task in
order; a task holds one row's text, and for the report a hash, never a conversation.

A row's first fault counts: blank (no character but white space), duplicate (role and text
seen earlier in the conversation), truncated (last such character is none of ``.!?``).
Blank rows and duplicates must go.

Null roles and texts are one space.  Rows are ordered by turn, null turns first; rows of one
turn by role, then by the text's MD5; equal rows are neighbours, the later ones duplicates.
Rows of a null conversation id are one conversation.  Role initials are compared as they
are, and an empty role has none that the grammar takes.  An empty table gives no rows.
Columns other than the four named play no part, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .shared import write_shared
from .workers import map_batches

KEEP, RENAME, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: The grammar's states, what each takes, and those that a conversation may end in.
START, SYSTEM, USER, ASSISTANT = STATES = range(4)
TAKES = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
ENDS = (START, ASSISTANT)
#: The one role of "user" and "assistant" that each state takes.
WANTED = tuple("a" if "a" in t else "u" for t in TAKES)
NAMES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
FAR = 1 << 60
#: Rows whose codes a task holds together, as a power of two.
CHUNK_BITS = 17

Costs = tuple[int, int, int, int]


@lru_cache(maxsize=None)
def arcs(initial: str, gone: bool, truncated: bool) -> tuple[tuple[tuple[str, int, int], ...], ...]:
    """For each grammar state the arcs that read a row of this kind: label, cost, next state, in the labels' order."""
    out = []
    for state in STATES:
        found = [("D", DELETE, state)]
        if not gone:
            more = TRUNCATED if truncated else 0
            if initial in TAKES[state]:
                found.append(("K", KEEP + more, TAKES[state][initial]))
            found.append(("R", RENAME + more, TAKES[state][WANTED[state]]))
        out.append(tuple(found))
    return tuple(out)


def kind(initial: str | None, gone: bool, truncated: bool) -> tuple:
    """The arguments of ``arcs``, initials that the grammar never takes being one."""
    return initial if initial in ("s", "u", "a") else "", gone, truncated and not gone


def with_insertions(costs: Costs) -> Costs:
    """Costs of the ways out of a place between rows, from those of the ways that insert nothing there."""
    c0, c1, c2, c3 = costs
    user, assistant = min(c2, INSERT + c3), min(c3, INSERT + c2)
    return min(c0, INSERT + user), min(c1, INSERT + user), user, assistant


END: Costs = with_insertions(tuple(0 if s in ENDS else FAR for s in STATES))


def costs_to_go(rows: list[tuple], exits: Costs) -> list[Costs]:
    """What the cheapest way out costs from each state before each row, and after the last. A row: its kind, and the number of copies to delete after it."""
    out = [exits]
    for row, copies in reversed(rows):
        after, gone = out[-1], DELETE * copies
        out.append(with_insertions(tuple(gone + min(cost + after[to] for _, cost, to in found) for found in arcs(*row))))
    return out[::-1]


def labels(rows: list[tuple], costs: list[Costs], state: int, last: bool) -> tuple[list[str], int]:
    """The least labels of a cheapest way from ``state``, by row, and the state at the end; insertions stand before a row, at the end after the last."""
    out = []
    for i, (row, copies) in enumerate(rows):
        said, after, gone = "", costs[i + 1], DELETE * copies
        while True:
            least, label, to = costs[i][state], "", state
            for name, cost, then in arcs(*row)[state]:
                if cost + gone + after[then] == least:
                    label, to = name, then
                    break
            inserted = TAKES[state][WANTED[state]]
            if label != "D" and INSERT + costs[i][inserted] == least:
                said, state = said + "I", inserted
                continue
            said, state = said + label, to
            break
        out.append(said + "D" * copies)
    while last and out and state not in ENDS:
        out[-1] += "I"
        state = TAKES[state][WANTED[state]]
    return out, state


def normalised(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text; null roles and texts are one space."""
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))


def damage(conversations: DataFrame) -> DataFrame:
    """Rows damaged by crc32 of ``conv_id:turn`` modulo 20: dropped, emptied, without stops, repeated, or given to the user."""
    rows = normalised(conversations)
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    marked = rows.withColumn("fault", F.crc32(key) % 20).filter("fault <> 0")
    text = F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.when(F.col("fault") == 3, 2).otherwise(1)
    return marked.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times)).alias("copy")).drop("copy")


#: A run of equal rows: codes in place of its text.
RUN = ["conv_id", "turn", "role", "digest", "blank", "truncated"]


def _coded(rows: DataFrame) -> DataFrame:
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    # a class that holds the stops as well would need the text's end twice: the last character that isn't white space, by itself
    last = F.substr(F.regexp_replace("text", r"[\x20\x09-\x0D]++\z", ""), F.lit(-1))
    return rows.select("conv_id", "turn", "role", F.md5(F.col("text")).alias("digest"), blank.alias("blank"), (~last.isin(".", "!", "?")).alias("truncated"), "text")


def _met(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``a`` and the further columns of ``b``, joined on keys of which nulls are equal."""
    other = b.withColumnsRenamed({k: f"other_{k}" for k in keys})
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"other_{k}")) for k in keys])
    return a.join(other, same, how).drop(*(f"other_{k}" for k in keys))


def _kinds(table: pa.Table) -> list[tuple]:
    """What ``costs_to_go`` takes of each run: its first row, which goes if it is blank or was seen before, and its further copies, which always go."""
    role, blank, first, truncated, copies = (table.column(c).to_pylist() for c in ("role", "blank", "first", "truncated", "copies"))
    return [(kind(r[:1], b or not f, t), n - 1) for r, b, f, t, n in zip(role, blank, first, truncated, copies, strict=True)]


def _solve_chunks() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Labels of the conversations that lie inside a chunk; null for its first and last one, which a cut may divide."""

    def solved(table: pa.Table) -> pa.Table:
        ids, kinds = table.column("conv_id").to_pylist(), _kinds(table)
        starts = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1]), len(ids)]
        said: list = [None] * starts[1]
        for a, b in zip(starts[1:-2], starts[2:-1], strict=True):
            rows = kinds[a:b]
            said += labels(rows, costs_to_go(rows, END), START, True)[0]
        said += [None] * (len(ids) - len(said))
        return table.append_column("edits", pa.array(said, pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            chunk = batch.column("chunk").to_pylist()
            cuts = [0, *(i for i in range(1, len(chunk)) if chunk[i] != chunk[i - 1]), len(chunk)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if held and held[-1].column("chunk")[0].as_py() != chunk[a]:
                    yield from solved(pa.Table.from_batches(held)).combine_chunks().to_batches()
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield from solved(pa.Table.from_batches(held)).combine_chunks().to_batches()

    return run


def _matrix(table: pa.Table) -> pa.Table:
    """The costs from each state before a piece to each state after it."""
    table = table.sort_by("place")
    rows = _kinds(table)
    columns = [costs_to_go(rows, tuple(0 if s == to else FAR for s in STATES))[0] for to in STATES]
    flat = [min(columns[to][at], FAR) for at in STATES for to in STATES]
    return pa.table({"conv_id": table.column("conv_id").slice(0, 1), "chunk": table.column("chunk").slice(0, 1), "matrix": pa.array([flat], pa.list_(pa.int64()))})


def _exits(table: pa.Table) -> pa.Table:
    """What the ways out cost at the end of each piece of a conversation."""
    table = table.sort_by("chunk")
    exits = [END]
    for flat in table.column("matrix").to_pylist()[:0:-1]:
        exits.append(tuple(min(flat[4 * at + to] + exits[-1][to] for to in STATES) for at in STATES))
    last = [False] * (table.num_rows - 1) + [True]
    return table.drop_columns("matrix").append_column("exits", pa.array([list(e) for e in exits[::-1]], pa.list_(pa.int64()))).append_column("last", pa.array(last))


def _options(table: pa.Table) -> pa.Table:
    """A piece's labels, by row, for each state that it may be entered in, and the states it then ends in."""
    table = table.sort_by("place")
    rows = _kinds(table)
    costs = costs_to_go(rows, tuple(table.column("exits")[0].as_py()))
    ways = [labels(rows, costs, s, table.column("last")[0].as_py()) for s in STATES]
    options = [list(x) for x in zip(*(w[0] for w in ways), strict=True)]
    return table.select(["conv_id", "chunk", "place"]).append_column("options", pa.array(options, pa.list_(pa.string()))).append_column("to", pa.array([[w[1] for w in ways]] * len(rows), pa.list_(pa.int32())))


def _entered(table: pa.Table) -> pa.Table:
    table = table.sort_by("chunk")
    state, states = START, []
    for to in table.column("to").to_pylist():
        states.append(state)
        state = to[state]
    return table.drop_columns("to").append_column("entered", pa.array(states, pa.int32()))


def _solve_pieces(runs: DataFrame) -> DataFrame:
    """place, edits of the rows of conversations that chunks left open."""
    id_type = runs.schema["conv_id"].dataType.simpleString()
    opened = runs.filter("edits is null").drop("edits")
    matrices = opened.groupBy("conv_id", "chunk").applyInArrow(_matrix, f"conv_id {id_type}, chunk long, matrix array<long>")
    exits = matrices.groupBy("conv_id").applyInArrow(_exits, f"conv_id {id_type}, chunk long, exits array<long>, last boolean")
    options, _ = write_shared(_met(opened, exits, ["conv_id", "chunk"]).groupBy("conv_id", "chunk").applyInArrow(_options, f"conv_id {id_type}, chunk long, place long, options array<string>, to array<int>"), "options")
    entered = options.select("conv_id", "chunk", "to").distinct().groupBy("conv_id").applyInArrow(_entered, f"conv_id {id_type}, chunk long, entered int")
    return _met(options, entered, ["conv_id", "chunk"]).select("place", F.get("options", F.col("entered")).alias("edits"))


def plan_repairs(rows: DataFrame, *, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """A row for each run of equal rows: conv_id, turn, role, digest, blank, truncated, copies, first, and its edits' initials in order."""
    runs = _coded(normalised(rows)).groupBy(*RUN).agg(F.count("*").alias("copies"))
    firsts = runs.groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn")).alias("t")).select("conv_id", "role", "digest", F.col("t.turn").alias("turn"), F.lit(True).alias("first"))
    met = _met(runs, firsts, ["conv_id", "turn", "role", "digest"], "left").withColumn("first", F.coalesce("first", F.lit(False)))
    coded, _ = write_shared(met, "runs")
    order = ["conv_id", "turn", "role", "digest"]
    placed = coded.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()).withColumn("chunk", F.shiftright("place", chunk_bits))
    schema = StructType([*placed.schema.fields, StructField("edits", StringType())])
    solved, _ = write_shared(map_batches(placed, _solve_chunks(), schema), "solved")
    pieces = _solve_pieces(solved)
    columns = [c for c in solved.columns if c not in ("place", "chunk", "edits")]
    inside = solved.filter("edits is not null").select(*columns, "edits")
    return inside.unionByName(solved.filter("edits is null").drop("edits").join(pieces, "place").select(*columns, "edits"))


#: A conversation's rows in the order in which they stream: its head, then each run's text (a row for each copy), then its plan.
HEAD, TEXT, PLAN = range(3)


def _stream(rows: DataFrame, plan: DataFrame, ids: DataFrame) -> DataFrame:
    columns = [c for c in plan.columns if c != "conv_id"]
    none = lambda have: [F.lit(None).cast(plan.schema[c].dataType).alias(c) for c in columns if c not in have]
    # a run that is deleted whole needs no text
    texts = _coded(normalised(rows)).filter("not blank").select("conv_id", "turn", "role", "digest", "text", *none(("turn", "role", "digest")), F.lit(TEXT).alias("part"))
    plans = plan.select("conv_id", *columns, F.lit(None).cast("string").alias("text"), F.lit(PLAN).alias("part"))
    heads = ids.select("conv_id").distinct().select("conv_id", *none(()), F.lit(None).cast("string").alias("text"), F.lit(HEAD).alias("part"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    union = texts.unionByName(plans).unionByName(heads)
    return union.repartition(parts, "conv_id").sortWithinPartitions("conv_id", F.col("part") != HEAD, "turn", "role", "digest", "part")


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """("head", conv_id) of each conversation, ("run", its plan) of each run, and ("row", label, role, text) of each label."""
    state, text = START, None
    for batch in batches:
        for row in batch.to_pylist():
            if row["part"] == HEAD:
                state, text = START, None
                yield "head", row["conv_id"]
            elif row["part"] == TEXT:
                text = row["text"]
            else:
                yield "run", row
                for label in row["edits"]:
                    if label == "D":
                        yield "row", label, row["role"], None
                        continue
                    initial = row["role"][:1] if label == "K" else WANTED[state]
                    state = TAKES[state][initial]
                    yield "row", label, row["role"] if label == "K" else NAMES[initial], "" if label == "I" else text
                text = None


def repaired(rows: DataFrame, plan: DataFrame | None = None) -> DataFrame:
    """conv_id, position (from 0), edit (K, R or I), role, text of every row of the repaired conversations."""
    plan = plan_repairs(rows) if plan is None else plan
    id_type = rows.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "position", "edit", "role", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, position, out, size, kind_of_id = None, 0, [], 0, None

        def counted() -> Iterator[pa.RecordBatch]:
            nonlocal kind_of_id
            for batch in batches:
                kind_of_id = batch.column("conv_id").type
                yield batch

        full = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (kind_of_id, pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], names=names)
        for what, *said in _replayed(counted()):
            if what == "head":
                conv, position = said[0], 0
            elif what == "row" and said[0] != "D":
                out.append((conv, position, *said))
                position, size = position + 1, size + len(said[2])
                if len(out) >= 2000 or size > 1 << 20:
                    yield full()
                    out, size = [], 0
        if out:
            yield full()

    return map_batches(_stream(rows, plan, rows), run, f"conv_id {id_type}, position long, edit string, role string, text string")


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def report(rows: DataFrame, ids: DataFrame, plan: DataFrame | None = None) -> DataFrame:
    """For every conversation of ``ids``: the faults of its rows, what the repair costs, its edits and a hash of its result."""
    plan = plan_repairs(rows) if plan is None else plan
    id_type = ids.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict = {}
        done: list[dict] = []
        types: list[pa.DataType] = []

        def seen() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                types[:] = [batch.column("conv_id").type]
                yield batch

        def closed() -> None:
            if now:
                spread = now["last"] - now["least"] + 1 - now["turns"] if now["turns"] else 0
                done.append({"conv_id": now["conv_id"], "gaps": spread, **{c: now[c] for c in COUNTS[1:]}, "audit": "".join(now["audit"]), "repaired_sha256": now["hash"].hexdigest()})

        def full() -> pa.RecordBatch:
            kinds = [types[0], *[pa.int64()] * len(COUNTS), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([d[c] for d in done], t) for c, t in zip(done[0], kinds, strict=True)], names=list(done[0]))

        for what, *said in _replayed(seen()):
            if what == "head":
                closed()
                if len(done) >= 2000:
                    yield full()
                    done = []
                now = dict.fromkeys(COUNTS, 0) | {"conv_id": said[0], "least": None, "last": None, "turns": 0, "before": None, "audit": [], "hash": hashlib.sha256(), "rows": 0, "cut": False}
            elif what == "run":
                r = said[0]
                if r["turn"] is not None and r["turn"] != now["last"]:
                    now["turns"] += 1
                    now["last"] = r["turn"]
                    now["least"] = r["turn"] if now["least"] is None else now["least"]
                now["cut"] = False
                if r["blank"]:
                    now["blank"] += r["copies"]
                else:
                    now["duplicate"] += r["copies"] - r["first"]
                    now["cut"] = r["first"] and r["truncated"]
                    now["truncated"] += now["cut"]
                initial = r["role"][:1]
                now["illegal"] += (now["before"] is not None and now["before"] + initial not in LEGAL) + r["copies"] - 1
                now["before"] = initial
                now["audit"].append(r["edits"])
            else:
                label, role, text = said
                now["cost"] += {"D": DELETE, "I": INSERT, "R": RENAME, "K": KEEP}[label] + (TRUNCATED if now["cut"] and label in "KR" else 0)
                if label != "D":
                    now["hash"].update(f"{chr(10) if now['rows'] else ''}{role}:{text}".encode())
                    now["rows"] += 1
        closed()
        if done:
            yield full()

    return map_batches(_stream(rows, plan, ids), run, f"conv_id {id_type}, {', '.join(f'{c} long' for c in COUNTS)}, audit string, repaired_sha256 string")
