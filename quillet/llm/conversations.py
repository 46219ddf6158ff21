"""Conversation structure repair by a bidirectional tight-arc DAG.

A conversation is repaired when the initials of its roles read (s?(ua)+)?: nothing, or an optional system message and
then user and assistant in turn. Nodes are (rows passed, state), a state being nothing yet, after system, after user or
after assistant; arcs are the edits Keep (0), Rerole to user or assistant (2), Delete (3; the only one for a blank or
repeated row) and Insert of an empty user or assistant message (2), and a truncated row that stays adds 1. Costs from
the start and costs to the end tell which arcs lie on a cheapest path (forward cost + arc + backward cost = least
cost); the edits are read by moving a set of nodes along such arcs, by the least letter (D, I, K, R) that any has.

A row becomes one byte (its role's initial and its fault); rows are ordered by ranges of (conversation, turn, role,
digest), so that a conversation of any size is cut into segments of at most SEGMENT rows in many tasks. A segment gives a
4 x 4 matrix of least costs from state to state; the matrices of a conversation (at most one for SEGMENT rows or for a
partition, 16 numbers each) are chained forward and backward, and then every segment finds its edits for each state in
which it may be entered. What one task does in order, with a bounded state, is to stream a conversation's texts
through its edits: its repaired text and their SHA-256 are one sequence.

Defined results: a null role or text counts as one space, a null conversation is one of its own, rows of null turns come
first, rows of equal turns go by role and then by a digest of the text, and equal rows lie side by side. Role and text
alike to an earlier row of the conversation make a repeated row, whatever its turn. An empty role has no initial and a role of another
initial than s, u, a cannot be kept. An empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections import deque

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillet.llm.common import SPACES, staged

#: Edits and their costs, and what a truncated row adds that stays.
DELETE, INSERT, KEEP, REROLE = "D", "I", "K", "R"
COST = {DELETE: 3, INSERT: 2, KEEP: 0, REROLE: 2}
TRUNCATED_COST = 1
#: States: nothing yet, after system, after user, after assistant. Which role an initial of s, u, a (0, 1, 2) leads to.
STATES = range(4)
FOLLOWS = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (2, 2): 3, (3, 1): 2}
#: An inserted or rerolled row is the one that the state asks for.
WANTED = (2, 2, 3, 2)
NAMES = {2: "user", 3: "assistant"}
#: Cost to the end after the last row: inserts until a user has an answer, or nothing at all.
AT_END = (0, 4, 2, 0)
NO = 1 << 50
#: Faults, as they count: the first that holds.
SOUND, TRUNCATED, DUPLICATE, BLANK = range(4)
SEGMENT = 1 << 16
#: Segments up to so many rows are remembered by their bytes.
REMEMBERED = 64


def code(initial: int, fault: int) -> int:
    return fault * 4 + initial


def arcs(of: int) -> list[tuple[str, int, int, int]]:
    """(letter, state, state, cost) of a row, by letter."""
    fault, initial = divmod(of, 4)
    found = [(DELETE, s, s, COST[DELETE]) for s in STATES]
    if fault < DUPLICATE:
        more = TRUNCATED_COST if fault == TRUNCATED else 0
        found += [(KEEP, s, FOLLOWS[s, initial], COST[KEEP] + more) for s in STATES if (s, initial) in FOLLOWS]
        found += [(REROLE, s, WANTED[s], COST[REROLE] + more) for s in STATES]
    return found


ARCS = [arcs(of) for of in range(16)]


def forward(costs: tuple, of: int) -> tuple[tuple, tuple]:
    """Costs before a row with inserts, and after the row."""
    now = list(costs)
    for _ in range(2):  # two inserts lead to any state that inserts lead to
        for s in STATES:
            now[WANTED[s]] = min(now[WANTED[s]], now[s] + COST[INSERT])
    after = [NO] * 4
    for _, s, t, c in ARCS[of]:
        if now[s] + c < after[t]:
            after[t] = now[s] + c
    return tuple(now), tuple(after)


def backward(costs: tuple, of: int) -> tuple:
    """Costs to the end from before a row, of the costs after it."""
    now = [NO] * 4
    for _, s, t, c in ARCS[of]:
        if c + costs[t] < now[s]:
            now[s] = c + costs[t]
    for _ in range(2):
        for s in STATES:
            now[s] = min(now[s], COST[INSERT] + now[WANTED[s]])
    return tuple(now)


def matrix(codes: bytes) -> list[int]:
    """Least costs from each state before the rows to each state after them, row by row."""
    return list(_matrix(codes) if len(codes) <= REMEMBERED else _matrix.__wrapped__(codes))


@functools.lru_cache(1 << 16)
def _matrix(codes: bytes) -> tuple:
    out = []
    for start in STATES:
        costs = tuple(0 if s == start else NO for s in STATES)
        for of in codes:
            costs = forward(costs, of)[1]
        out += [min(c, NO) for c in costs]
    return tuple(out)


def edits(codes: bytes, before: tuple, after: tuple, least: int) -> tuple[list, list]:
    """For each state in which a cheapest path may enter the rows: the state in which it leaves them and its letters."""
    return (_edits if len(codes) <= REMEMBERED else _edits.__wrapped__)(codes, before, after, least)


@functools.lru_cache(1 << 16)
def _edits(codes: bytes, before: tuple, after: tuple, least: int) -> tuple[list, list]:
    to_here, to_end = [], [after]
    costs = before
    for of in codes:
        now, costs = forward(costs, of)
        to_here.append(now)
    for of in reversed(codes):
        to_end.append(backward(to_end[-1], of))
    to_end.reverse()
    exits, letters = [None] * 4, [None] * 4
    for start in STATES:
        if before[start] + to_end[0][start] != least:
            continue
        frontier, found = {start}, []
        for i, of in enumerate(codes):
            while True:
                tight: dict[str, set] = {}
                for letter, s, t, c in ARCS[of]:
                    if s in frontier and to_here[i][s] + c + to_end[i + 1][t] == least:
                        tight.setdefault(letter, set()).add(t)
                for s in frontier:
                    if to_here[i][s] + COST[INSERT] + to_end[i][WANTED[s]] == least:
                        tight.setdefault(INSERT, set()).add(WANTED[s])
                letter = min(tight)
                frontier = tight[letter]
                found.append(letter)
                if letter != INSERT:
                    break
        # a state and a letter fix the next state, so that one state is left
        (exits[start],) = frontier
        letters[start] = "".join(found)
    return exits, letters


def _runs(batches, size: int):
    """Lists of rows (as tuples) with equal first values, whole, of batches sorted by it; at most size at once if size > 0."""
    run: list = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if run and (row[0] != run[-1][0] or len(run) == size):
                yield run
                run = []
            run.append(row)
    if run:
        yield run


def _out(batch_rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*batch_rows), schema)], schema=schema)


def _batched(rows, schema: pa.Schema, size: int = 2000):
    some: list = []
    for row in rows:
        some.append(row)
        if len(some) == size:
            yield _out(some, schema)
            some = []
    if some:
        yield _out(some, schema)


_ORDER = ["conv", "turn", "role", "digest"]


def rows_of(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, turn, role, digest (16 bytes of the text's SHA-256) and text, nulls as stated above."""
    text = F.coalesce(F.col(text_col), F.lit(" "))
    return df.select(
        F.col(id_col).alias("conv"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit(" ")).alias("role"),
        F.substring(F.unhex(F.sha2(text.cast("binary"), 256)), 1, 16).alias("digest"),
        text.alias("text"),
    )


def judged(rows: DataFrame) -> DataFrame:
    """One row for equal rows: conv, turn, role, digest, n, initial, fault of the first and of its repetitions."""
    last = F.substring(F.rtrim(F.col("text"), F.lit(SPACES)), -1, 1)
    text_fault = F.when(last == "", BLANK).when(last.isin(".", "!", "?"), SOUND).otherwise(TRUNCATED)
    alike = rows.select(*_ORDER, text_fault.alias("of_text")).groupBy(*_ORDER, "of_text").agg(F.count(F.lit(1)).alias("n"))
    place = F.struct(F.col("turn").isNotNull().alias("a"), F.coalesce("turn", F.lit(0)).alias("b"))
    again = alike.groupBy("conv", "role", "digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    again = again.select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    both = alike.join(again, F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    repeated = F.col("first").isNotNull() & (place != F.col("first"))
    initial = F.lit(3)
    for i, letter in enumerate("sua"):
        initial = F.when(F.col("role").startswith(letter), i).otherwise(initial)
    fault = F.when(F.col("of_text") == BLANK, BLANK).when(repeated, DUPLICATE).otherwise(F.col("of_text"))
    return both.select(
        *_ORDER, "n", initial.alias("initial"), fault.alias("fault"), F.when(F.col("of_text") == BLANK, BLANK).otherwise(DUPLICATE).alias("more")
    )


def _type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def segments(rows: DataFrame, size: int = SEGMENT) -> DataFrame:
    """The rows in order as segments: part and place number them, codes is a byte a row, costs their matrix; with the counts
    that are summed up and what two neighbours need of each other."""
    faults = judged(rows)
    schema = (
        f"conv {_type(rows, 'conv')}, part int, place int, turn long, role string, digest binary, codes binary, costs array<long>, "
        "blank long, duplicate long, truncated long, illegal long, low long, high long, turns long"
    )

    def cut(batches):
        part, place = TaskContext.get().partitionId(), 0

        def found():
            nonlocal place
            for run in _runs(batches, size):
                codes = bytearray()
                counts = [0] * 4
                turns = [r[1] for r in run if r[1] is not None]
                seen = len(set(turns))
                first = run[0]
                pieces = []
                for _, _, _, _, n, initial, fault, more in run:
                    codes.append(code(initial, fault))
                    counts[fault] += 1
                    while n > 1:
                        step = min(n - 1, size)
                        codes += bytes([code(initial, more)]) * step
                        counts[more] += step
                        n -= step
                        if len(codes) >= size:
                            pieces.append(bytes(codes))
                            codes.clear()
                if codes:
                    pieces.append(bytes(codes))
                for i, piece in enumerate(pieces):
                    end = i + 1 == len(pieces)  # what is counted goes with the last piece
                    illegal = sum(bad_pair(a, b) for a, b in zip(piece, piece[1:]))
                    yield (
                        first[0], part, place, first[1], first[2], first[3], piece, matrix(piece), *((counts[x] if end else 0) for x in (BLANK, DUPLICATE, TRUNCATED)), illegal,
                        turns[0] if turns and end else None, turns[-1] if turns and end else None, seen if end else 0,
                    )
                    place += 1

        yield from _batched(found(), target, 500)

    target = arrow_schema(rows.sparkSession, schema)
    ordered = faults.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER)
    return staged(ordered.mapInArrow(cut, schema), "segments")


def bad_pair(a: int, b: int) -> bool:
    """Neighbours other than system and user, user and assistant, assistant and user."""
    return (a & 3, b & 3) not in ((0, 1), (1, 2), (2, 1))


def arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], schema).schema)


def plan(rows: DataFrame, size: int = SEGMENT) -> DataFrame:
    """The edits of all conversations, a row a segment: conv, part, place, the key (turn, role, digest) of its first row,
    letters; and in the last segment of a conversation its counts and cost (null in the others)."""
    cut = segments(rows, size)
    conv = _type(rows, "conv")
    spark = rows.sparkSession

    def chain(batches):
        def found():
            for run in _runs(batches, 0):
                start, before = (0, NO, NO, NO), []
                for _, _, _, costs in run:
                    before.append(start)
                    start = tuple(min(NO, *(start[s] + costs[4 * s + t] for s in STATES)) for t in STATES)
                least = min(start[s] + AT_END[s] for s in STATES)
                after, end = [], AT_END
                for _, _, _, costs in reversed(run):
                    after.append(end)
                    end = tuple(min(costs[4 * s + t] + end[t] for t in STATES) for s in STATES)
                for (_, part, place, _), f, b in zip(run, before, reversed(after)):
                    yield part, place, list(f), [min(x, NO) for x in b], least

        yield from _batched(found(), bounds)

    bounds = arrow_schema(spark, "p int, q int, before array<long>, after array<long>, least long")
    chained = (
        cut.select("conv", "part", "place", "costs").repartition("conv").sortWithinPartitions("conv", "part", "place")
        .mapInArrow(chain, "p int, q int, before array<long>, after array<long>, least long")
    )

    def read(batches):
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            found = []
            for *kept, codes, before, after, least in zip(*columns):
                low, high = min(before), min(after)  # alike segments are alike wherever they lie
                exits, letters = edits(codes, tuple(min(x - low, NO) for x in before), tuple(min(x - high, NO) for x in after), least - low - high)
                found.append((*kept, codes[0] & 3, codes[-1] & 3, exits, letters, least))
            if found:
                yield _out(found, paths)

    kept = ["conv", "part", "place", "turn", "role", "digest", "blank", "duplicate", "truncated", "illegal", "low", "high", "turns"]
    counts = "blank long, duplicate long, truncated long, illegal long, low long, high long, turns long"
    path_schema = f"conv {conv}, part int, place int, turn long, role string, digest binary, {counts}, head int, tail int, exits array<int>, letters array<string>, least long"
    paths = arrow_schema(spark, path_schema)
    joined = cut.join(chained, (F.col("part") == F.col("p")) & (F.col("place") == F.col("q"))).select(*kept, "codes", "before", "after", "least")
    found = joined.mapInArrow(read, path_schema)

    def follow(batches):
        """State after state through a conversation's segments."""

        def rows():
            was, last = None, None
            for conv, part, place, turn, role, digest, *now, head, tail, exits, letters, least in (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))):
                if last is None or conv != was:
                    if last is not None:
                        yield finished()
                    was, state, sums, high, low, prior = conv, 0, [0] * 5, None, None, None
                else:
                    yield (*last, *[None] * 6)
                    sums[3] += bad_pair(prior, head)
                sums = [a + b for a, b in zip(sums, (*now[:4], now[6]))]
                if now[4] is not None:
                    sums[4] -= high is not None and high == now[4]
                    low, high = now[4] if low is None else low, now[5]
                last, prior = (conv, part, place, turn, role, digest, letters[state]), tail
                state, cost = exits[state], least

                def finished():
                    gaps = 0 if low is None else high - low + 1 - sums[4]
                    return (*last[:6], last[6] + INSERT * (AT_END[state] // COST[INSERT]), gaps, *sums[:4], cost)

            if last is not None:
                yield finished()

        yield from _batched(rows(), target, 500)

    plan_schema = f"conv {conv}, part int, place int, turn long, role string, digest binary, letters string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
    target = arrow_schema(spark, plan_schema)
    return staged(found.repartition("conv").sortWithinPartitions("conv", "part", "place").mapInArrow(follow, plan_schema), "edits")


def repaired(rows: DataFrame, edits_of: DataFrame) -> DataFrame:
    """The conversations as repaired, in order within a partition: conv, position, edit (I, K or R), turn, role, text."""
    texts = rows.select(*_ORDER, F.lit(1).alias("kind"), F.lit(0).alias("part"), F.lit(0).alias("place"), "text")
    lists = edits_of.select(*_ORDER, F.lit(0).alias("kind"), "part", "place", F.col("letters").alias("text"))
    both = texts.union(lists).repartition("conv").sortWithinPartitions(*_ORDER, "kind", "part", "place").select("conv", "turn", "role", "kind", "text")
    schema = f"conv {_type(rows, 'conv')}, position long, edit string, turn long, role string, text string"

    def apply(batches):
        def rows():
            was, todo, state, position = None, None, 0, 0

            def inserted():
                nonlocal state, position
                while todo and todo[0] == INSERT:
                    todo.popleft()
                    state = WANTED[state]
                    yield was, position, INSERT, None, NAMES[state], ""
                    position += 1

            for conv, turn, role, kind, text in (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))):
                if todo is None or conv != was:
                    if todo:
                        yield from inserted()
                    was, todo, state, position = conv, deque(), 0, 0
                if kind == 0:
                    todo.extend(text)
                    continue
                yield from inserted()
                letter = todo.popleft()
                if letter == DELETE:
                    continue
                if letter == REROLE:
                    state = WANTED[state]
                    role = NAMES[state]
                else:
                    state = FOLLOWS[state, "sua".index(role[0])]
                yield conv, position, letter, turn, role, text
                position += 1
            if todo:
                yield from inserted()

        yield from _batched(rows(), target)

    target = arrow_schema(rows.sparkSession, schema)
    return both.mapInArrow(apply, schema)


def digests(whole: DataFrame) -> DataFrame:
    """conv and the SHA-256 of its `role:text` lines, of rows that lie in order within a partition, as repaired() gives them."""

    def run(batches):
        def rows():
            was, sha = None, None
            for conv, role, text in (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in (0, 4, 5)))):
                line = f"{role}:{text}".encode("utf-8", "surrogatepass")
                if sha is None or conv != was:
                    if sha is not None:
                        yield was, sha.hexdigest()
                    was, sha = conv, hashlib.sha256(line)
                else:
                    sha.update(b"\n" + line)
            if sha is not None:
                yield was, sha.hexdigest()

        yield from _batched(rows(), target)

    schema = f"conv {_type(whole, 'conv')}, repaired_sha256 string"
    target = arrow_schema(whole.sparkSession, schema)
    return whole.mapInArrow(run, schema)


def audits(edits_of: DataFrame) -> DataFrame:
    """One row a conversation: its counts, cost and the letters of all its segments."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("part", "place", "letters"))), lambda x: x["letters"])  # the audit itself
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return edits_of.groupBy("conv").agg(*[F.max(c).alias(c) for c in counts], F.array_join(ordered, "").alias("audit"))


def report(damaged_rows: DataFrame, all_ids: DataFrame, size: int = SEGMENT) -> DataFrame:
    """Every id of all_ids (one column): counts, cost, audit and digest of its repaired rows."""
    id_col = all_ids.columns[0]
    edits_of = plan(damaged_rows, size)
    found = audits(edits_of).withColumnRenamed("conv", "c1")
    hashed = digests(repaired(damaged_rows, edits_of)).withColumnRenamed("conv", "c2")
    ids = all_ids.distinct()
    joined = ids.join(found, F.col(id_col).eqNullSafe(F.col("c1")), "left").join(hashed, F.col(id_col).eqNullSafe(F.col("c2")), "left")
    return joined.select(
        id_col,
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )


def damaged(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The rows with the faults that a hash of conversation and turn asks for: of 20 values, 0 drops a row, 1 empties its
    text, 2 takes its sentence ends, 3 repeats it and 4 makes it the user's."""
    written = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (id_col, turn_col)]
    draw = F.pmod(F.crc32(F.concat_ws(":", *written).cast("binary")), F.lit(20))
    text, role = (F.coalesce(F.col(c), F.lit(" ")) for c in (text_col, role_col))
    some = df.withColumn("__draw", draw).where(F.col("__draw") != 0)
    hurt = F.when(F.col("__draw") == 1, "").when(F.col("__draw") == 2, F.translate(text, ".!?", "")).otherwise(text)
    rows = some.select(
        id_col, turn_col, F.when(F.col("__draw") == 4, "user").otherwise(role).alias(role_col), hurt.alias(text_col), F.when(F.col("__draw") == 3, 2).otherwise(1).alias("__n")
    )
    return rows.select(id_col, turn_col, role_col, text_col, F.explode(F.array_repeat(F.lit(1), F.col("__n")))).drop("col")


def _crc_sql(text: str) -> str:
    """crc32 of an ASCII text, bit by bit."""
    byte = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, i: xor(r >> 1, CASE WHEN r % 2 = 1 THEN 3988292384 ELSE 0 END))"
    letters = f"list_transform(string_split({text}, ''), lambda t: ascii(t)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {letters}), lambda c, b: {byte}), 4294967295)"


def report_sql() -> str:
    """The query as DuckDB SQL: costs to the end alone, with the least letters and their texts carried along."""
    spaces = r"[\x20\x09-\x0D]"
    initial = "CASE substr(x.role, 1, 1) WHEN 's' THEN 0 WHEN 'u' THEN 1 WHEN 'a' THEN 2 ELSE 3 END"
    role = lambda t: f"'{NAMES[t]}:'"
    line = lambda head, rest: f"list_prepend({head}, {rest})"
    bare = []
    for s in STATES:
        w = WANTED[s]
        options = [f"{{'c': a.b{s}.c + {COST[DELETE]}, 'l': 'D' || a.b{s}.l, 't': a.b{s}.t}}"]
        for i in range(3):
            if (s, i) in FOLLOWS:
                t = FOLLOWS[s, i]
                dear = f"a.b{t}.c + CASE WHEN x.fault > 1 OR {initial} <> {i} THEN 1000000000 ELSE x.fault END"
                options.append(f"{{'c': {dear}, 'l': 'K' || a.b{t}.l, 't': {line('x.role || chr(58) || x.text', f'a.b{t}.t')}}}")
        dear = f"a.b{w}.c + 2 + CASE WHEN x.fault > 1 THEN 1000000000 ELSE x.fault END"
        options.append(f"{{'c': {dear}, 'l': 'R' || a.b{w}.l, 't': {line(f'{role(w)} || x.text', f'a.b{w}.t')}}}")
        bare.append(f"list_min([{', '.join(options)}])")
    put = lambda of, w: f"{{'c': {of}.c + 2, 'l': 'I' || {of}.l, 't': {line(role(w), f'{of}.t')}}}"
    # of states 2 and 3 one insert leads to the other, of 0 and 1 one leads to 2
    y2 = f"list_min([z.b2, {put('z.b3', 3)}])"
    y3 = f"list_min([z.b3, {put('z.b2', 2)}])"
    start = lambda c, l, t: f"{{'c': {c}::BIGINT, 'l': '{l}'::VARCHAR, 't': {t}::VARCHAR[]}}"
    ends = f"{{'b0': {start(0, '', '[]')}, 'b1': {start(4, 'II', '[' + role(2) + ', ' + role(3) + ']')}, 'b2': {start(2, 'I', '[' + role(3) + ']')}, 'b3': {start(0, '', '[]')}}}"
    return f"""
        WITH r AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                {_crc_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS d FROM conversations),
        h AS (SELECT conv_id, turn, CASE d WHEN 4 THEN 'user' ELSE role END AS role,
                CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE d WHEN 3 THEN 2 ELSE 1 END)) AS copy
              FROM r WHERE d <> 0),
        o AS (SELECT *, row_number() OVER w AS place, lag(substr(role, 1, 1)) OVER w AS before,
                row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
                regexp_extract(text, '([^\\x20\\x09-\\x0D]){spaces}*$', 1) AS last FROM h
              WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
        f AS (SELECT *, CASE WHEN last = '' THEN 3 WHEN seen > 1 THEN 2 WHEN last NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS fault FROM o),
        g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 3) AS blank, count(*) FILTER (fault = 2) AS duplicate,
                count(*) FILTER (fault = 1) AS truncated, count(*) FILTER (before IS NOT NULL AND before || substr(role, 1, 1) NOT IN ('su', 'ua', 'au')) AS illegal,
                list({{'role': role, 'text': text, 'fault': fault}} ORDER BY place DESC) AS rows FROM f GROUP BY conv_id),
        p AS (SELECT conv_id, gaps, blank, duplicate, truncated, illegal,
                list_reduce(list_transform(rows, lambda q: {{'role': q.role, 'text': q.text, 'fault': q.fault, 'b': {ends}}}),
                    lambda v, x: {{'role': '', 'text': '', 'fault': 0, 'b':
                        list_transform([list_transform([v.b], lambda a: {{{', '.join(f"'b{s}': {bare[s]}" for s in STATES)}}})[1]],
                            lambda z: {{'b0': list_min([z.b0, {put(y2, 2)}]), 'b1': list_min([z.b1, {put(y2, 2)}]), 'b2': {y2}, 'b3': {y3}}})[1]}},
                    {{'role': '', 'text': '', 'fault': 0, 'b': {ends}}}).b.b0 AS b FROM g)
        SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
            coalesce(illegal, 0) AS illegal, coalesce(b.c, 0) AS cost, coalesce(b.l, '') AS audit, sha256(coalesce(array_to_string(b.t, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN p ON p.conv_id IS NOT DISTINCT FROM i.conv_id"""
