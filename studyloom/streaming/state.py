"""Stateful processors of the live quiz and of study sessions.

State lies in Spark's state store. A call to the store takes far longer than
the work on a row, so sessions and questions are dealt over ``BUCKETS`` keys and
a bucket is one entry, as is what players of a shard have answered: it is read
and written once per batch, and only if the batch has rows for it. A room with
very many players is no bottleneck: its players are dealt over ``SHARDS`` keys
(room, shard), and an event of the whole room goes to each of them. What is
needed per room is summed per shard and batch before it meets.

State goes when its room or question ends or its session is paired. Rows that
come before the row they belong to (an answer before its question, an end before
its start) are held for ``HOLD_DAYS`` of processing time; a bucket forgets them
the next time it has rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SHARDS = 16
BUCKETS = 1024
PACK_BYTES = 16 << 20  # rows of a task that are packed at a time
PARTS = 32  # of the questions of a player
HOLD_DAYS = 7
NO_ANSWER = -1

_HOLD = HOLD_DAYS * 86_400_000
_SECOND = 1_000_000


ANSWER = "room_id long, user_id long, question_number long, selected_answer int, response_time double"
TOTAL = "room_id long, user_id long, score long, correct_answers long"
RESULT = f"{TOTAL}, ended_at long"
HISTOGRAM = "room_id long, question_number long, a long, b long, c long, d long, timeouts long"
CHANGE = "room_id long, kind string, question_number long, n long"
PROGRESS = "room_id long, current_question long, status string"
SESSION = "session_id long, user_id long, topic string, duration_seconds int, score double"


def _row(schema: str) -> Row:
    """Maker of rows with the names of a schema."""
    return Row(*[field.split()[0] for field in schema.split(", ")])


_histogram, _change, _progress = map(_row, (HISTOGRAM, CHANGE, PROGRESS))
_pack = _row("rows binary")


def _micros(rows: DataFrame, *names: str) -> DataFrame:
    """Times as microseconds, which come back from the state as they went in."""
    return rows.withColumns({c: F.unix_micros(c) for c in names})


def sharded(rows: DataFrame) -> DataFrame:
    """Rows with the shard of their room: that of their user, or every one for rows without a user."""
    own = F.array(F.pmod(F.hash("user_id"), F.lit(SHARDS)))
    everywhere = F.sequence(F.lit(0), F.lit(SHARDS - 1))
    return rows.withColumn("shard", F.explode(F.when(F.col("user_id").isNull(), everywhere).otherwise(own)))


def _folded(key: str) -> Column:
    """A number below ``BUCKETS``: all bits of a key, laid over each other."""
    bits = BUCKETS.bit_length() - 1
    folded = F.col(key)
    for shift in range(bits, 64, bits):
        folded = folded.bitwiseXOR(F.shiftrightunsigned(key, shift))
    return folded.bitwiseAND(F.lit(BUCKETS - 1).cast("long"))


class Held:
    """A value of Python in one entry of state: read once, written once."""

    def __init__(self, handle: StatefulProcessorHandle, name: str):
        self.entry = handle.getValueState(name, "value binary")

    def get(self, default):
        found = self.entry.get()
        return pickle.loads(bytes(found[0])) if found else default

    def put(self, value) -> None:
        """Keep a value; an empty one leaves no entry."""
        if value:
            self.entry.update((pickle.dumps(value, pickle.HIGHEST_PROTOCOL),))
        else:
            self.entry.clear()

    def clear(self) -> None:
        self.entry.clear()


def _packs(keys: list[str]):
    """Rows of equal keys as one row, keys and an Arrow stream, for some batches of a task at a time."""

    def one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches).sort_by([(k, "ascending") for k in keys]).combine_chunks()
        new = np.zeros(table.num_rows, dtype=bool)
        new[0] = True
        for k in keys:
            values = pc.fill_null(table.column(k), -1).to_numpy()
            new[1:] |= values[1:] != values[:-1]
            new[1:] |= np.diff(table.column(k).is_null().to_numpy().astype(np.int8)) != 0
        first = np.flatnonzero(new)
        packs = [_stream(table.slice(a, n)) for a, n in zip(first.tolist(), np.diff([*first, table.num_rows]).tolist())]
        heads = table.select(keys).take(pa.array(first)).combine_chunks()
        return pa.record_batch([*(heads.column(k).combine_chunks() for k in keys), pa.array(packs, pa.binary())], names=[*keys, "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
                size += batch.nbytes
            if size >= PACK_BYTES:
                yield one(waiting)
                waiting, size = [], 0
        if waiting:
            yield one(waiting)

    return run


def _stream(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def _unpacked(packs: Iterator[Row]) -> pa.Table:
    """All rows of a key."""
    return pa.concat_tables([pa.ipc.open_stream(bytes(p.rows)).read_all() for p in packs])


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for pack in batch.column("rows").to_pylist():
            yield from pa.ipc.open_stream(pack).read_all().to_batches()


def packed_state(rows: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str, mode: str, time: str) -> DataFrame:
    """A stream through a processor of packed rows (``Packed``): handing over single rows costs more than the work on them."""
    fields = ", ".join(f"{k} {dict(rows.dtypes)[k]}" for k in keys)
    packs = rows.mapInArrow(_packs(keys), f"{fields}, rows binary").groupBy(*keys)
    return packs.transformWithState(processor, "rows binary", mode, time).mapInArrow(_opened, schema)


class Packed(StatefulProcessor):
    """A processor whose rows come and go in packs; ``rows`` does the work on the table of a key."""

    schema: str

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}
        names, types = zip(*(field.split() for field in self.schema.split(", ")))
        out = list(self.results(key, rows, timerValues))
        if out:
            yield _pack(_stream(pa.table([pa.array(x, kinds[t]) for x, t in zip(zip(*out), types)], names=list(names))))

    def close(self) -> None:
        pass


class Answers(Packed):
    """First answers of the players of a shard, their running totals, and the totals when the room ends.

    ``give`` chooses what comes out: "answers", "totals" (of players with a new
    answer) or "results" (of all players once the room ends, and a row without
    a player). The earliest of several answers in a batch is the first. After
    the end of a room nothing counts.
    """

    def __init__(self, give: str):
        self.give = give
        self.schema = {"answers": ANSWER, "totals": TOTAL, "results": RESULT}[give]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.answered = Held(handle, "answered")  # players and questions
        self.totals = Held(handle, "totals")  # points and correct answers of each player
        self.ended = handle.getValueState("ended", "ended boolean")

    def results(self, key, rows, timerValues) -> Iterator[tuple]:
        if self.ended.exists():
            return
        table = _unpacked(rows)
        over = pc.equal(table.column("kind"), "finished")
        ended = table.filter(over).column("ts").to_pylist()
        over, ended_at = bool(ended), ended[-1] if ended else None
        said = table.filter(pc.equal(table.column("kind"), "answer"))
        # the first by time, and all other values to break ties; nulls first
        ties = [c for c in sorted(said.schema.names) if c not in ("ts", "kind", "shard")]
        said = said.take(pc.sort_indices(said, [(c, "ascending") for c in ["ts", *ties]], null_placement="at_start"))
        names = [c for c in ("selected_answer", "response_time", "points", "is_correct") if c in said.schema.names]
        first: dict[tuple, dict] = {}
        for user, question, *values in zip(*(said.column(c).to_pylist() for c in ("user_id", "question_number", *names))):
            first.setdefault((user, question), values)
        answered, totals = self.answered.get(set()), self.totals.get({})
        moved: dict[int, tuple] = {}
        for k, values in first.items():
            if k in answered:
                continue
            answered.add(k)
            if self.give == "answers":
                yield (key[0], *k, *values[:2])
                continue
            before = moved.get(k[0]) or totals.get(k[0]) or (0, 0)
            moved[k[0]] = (before[0] + values[2], before[1] + int(values[3]))
        totals.update(moved)
        if self.give == "totals":
            for user, total in moved.items():
                yield (key[0], user, *total)
        if over:
            if self.give == "results":
                yield (key[0], None, 0, 0, ended_at)
                for user, total in totals.items():
                    yield (key[0], user, *total, ended_at)
            self.answered.clear()
            self.totals.clear()
            self.ended.update((True,))
        elif first:
            self.answered.put(answered)
            self.totals.put(totals)


def answers(rows: DataFrame, give: str) -> DataFrame:
    """A stream of answers (kind "answer") and ended rooms ("finished"), through :class:`Answers`."""
    processor = Answers(give)
    mode = "Update" if give == "totals" else "Append"
    out = packed_state(sharded(_micros(rows, "ts")), ["room_id", "shard"], processor, processor.schema, mode, "None")
    return out.withColumn("ended_at", F.timestamp_micros("ended_at")) if give == "results" else out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows summed by everything but ``n``, one batch of a task at a time."""
    for batch in batches:
        keys = [c for c in batch.schema.names if c != "n"]
        table = pa.table(batch).group_by(keys).aggregate([("n", "sum")])
        yield from table.rename_columns([*keys, "n"]).select(batch.schema.names).to_batches()


def summed(rows: DataFrame) -> DataFrame:
    """Partial sums of ``n`` before the shuffle to the state, so a busy key sends few rows."""
    return rows.mapInArrow(_counts, rows.schema)


class Histogram(StatefulProcessor):
    """Answers per option of every question of a room, the changed ones after each batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getMapState("counts", "question_number long", "a long, b long, c long, d long, timeouts long")
        self.ended = handle.getValueState("ended", "ended boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new: dict[int, list[int]] = {}
        over = False
        for row in rows:
            if row.kind == "finished":
                over = True
                continue
            own = new.setdefault(row.question_number, [0] * 5)
            own[row.selected_answer % 4] += row.n
            own[4] += row.n * (row.selected_answer == NO_ANSWER)
        if self.ended.exists():
            return
        for question, counts in new.items():
            before = self.counts.getValue((question,)) or (0,) * 5
            after = tuple(x + y for x, y in zip(before, counts))
            self.counts.updateValue((question,), after)
            yield _histogram(key[0], question, *after)
        if over:
            self.counts.clear()
            self.ended.update((True,))

    def close(self) -> None:
        pass


def histogram(rows: DataFrame) -> DataFrame:
    """A stream of answers and ended rooms to the option counts that change; options lie in -1 to 3."""
    parts = summed(rows.select("room_id", "kind", "question_number", F.col("selected_answer").cast("int"), F.lit(1).cast("long").alias("n")))
    return parts.groupBy("room_id").transformWithState(Histogram(), HISTOGRAM, "Update", "None")


class Attendance(StatefulProcessor):
    """What a batch changes in a shard of a room: players present, and first answers per question.

    A player's latest event (by time, then id) tells whether they are present;
    an older one that comes late changes nothing.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.answered = handle.getMapState("answered", "user_id long, question_number long", "seen boolean")
        self.present = handle.getMapState("present", "user_id long", "ts long, id long, here boolean")
        self.ended = handle.getValueState("ended", "ended boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last: dict[int, tuple] = {}
        new: set[tuple[int, int]] = set()
        over = False
        for row in rows:
            if row.kind == "answer":
                new.add((row.user_id, row.question_number))
            elif row.kind == "finished":
                over = True
            else:
                event = (row.ts, row.id, row.kind == "connect")
                if row.user_id not in last or event[:2] > last[row.user_id][:2]:
                    last[row.user_id] = event
        if self.ended.exists():
            return
        players = 0
        for user, event in last.items():
            before = self.present.getValue((user,))
            if before is None or event[:2] > tuple(before)[:2]:
                self.present.updateValue((user,), event)
                players += event[2] - (before is not None and before[2])
        counts: dict[int, int] = {}
        for k in new:
            if not self.answered.containsKey(k):
                self.answered.updateValue(k, (True,))
                counts[k[1]] = counts.get(k[1], 0) + 1
        if players:
            yield _change(key[0], "players", None, players)
        for question, n in counts.items():
            yield _change(key[0], "answered", question, n)
        if over:
            yield _change(key[0], "ended", None, 1)
            self.answered.clear()
            self.present.clear()
            self.ended.update((True,))

    def close(self) -> None:
        pass


def attendance(rows: DataFrame) -> DataFrame:
    """A stream of answers, connects, disconnects and ended rooms to changes of counts per room."""
    return sharded(_micros(rows, "ts")).groupBy("room_id", "shard").transformWithState(Attendance(), CHANGE, "Append", "None")


class Barrier(StatefulProcessor):
    """The question a room is at: it moves on when as many have answered as are present.

    Answers of players who left still count. Checked after every batch, also
    where a player's leaving makes a question complete. ``end_rule`` "stay"
    ends at the last question, "pass" one past it.
    """

    def __init__(self, end_rule: str):
        if end_rule not in ("stay", "pass"):
            raise ValueError(f"unknown end rule {end_rule!r}")
        self.past = int(end_rule == "pass")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.room = handle.getValueState("room", "current long, players long, finished boolean")
        self.answered = handle.getMapState("answered", "question_number long", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        counts: dict[int, int] = {}
        joined, questions, over = 0, 0, False
        for row in rows:
            questions = row.num_questions
            if row.kind == "players":
                joined += row.n
            elif row.kind == "ended":
                over = True
            else:
                counts[row.question_number] = counts.get(row.question_number, 0) + row.n
        current, players, finished = self.room.get() or (1, 0, False)
        if finished or over and not (counts or joined):
            if over:
                self.answered.clear()
                self.room.clear()
            return
        players += joined
        for question, n in counts.items():
            before = self.answered.getValue((question,))
            self.answered.updateValue((question,), ((before[0] if before else 0) + n,))
        while current <= questions:
            given = self.answered.getValue((current,))
            if given is None or given[0] < players:
                break
            self.answered.removeKey((current,))
            current += 1
        finished = current > questions
        if finished or over:
            self.answered.clear()
        if over:
            self.room.clear()
        else:
            self.room.update((current, players, finished))
        yield _progress(key[0], min(current, questions + self.past), "finished" if finished else "in_progress")

    def close(self) -> None:
        pass


def barrier(changes: DataFrame, rooms: DataFrame, end_rule: str = "stay") -> DataFrame:
    """A stream of changes (:func:`attendance`) to where each room stands."""
    size = rooms.select(F.col("id").cast("long").alias("room_id"), F.col("num_questions").cast("long").alias("num_questions"))
    rows = changes.join(size, "room_id")
    return rows.groupBy("room_id").transformWithState(Barrier(end_rule), PROGRESS, "Update", "None")


class Sessions(Packed):
    """Sessions of a bucket, each from its start and its earliest end, whichever comes first."""

    schema = SESSION

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.started = Held(handle, "start")  # by session: user_id, topic and start_time
        self.ended = Held(handle, "end")  # by session without a start: its earliest end, and when it came

    def results(self, key, rows, timerValues) -> Iterator[tuple]:
        now = timerValues.getCurrentProcessingTimeInMs()
        starts: dict[int, tuple] = {}
        ends: dict[int, tuple] = {}
        names = ("kind", "session_id", "user_id", "topic", "start_time", "end_time", "score")
        table = _unpacked(rows)
        for kind, session, user, topic, start, end, score in zip(*(table.column(c).to_pylist() for c in names)):
            if kind == "start":
                starts.setdefault(session, (user, topic, start))
            else:
                own = (end, score is not None, score)
                ends[session] = min(ends.get(session, own), own)
        started = self.started.get({})
        ended = {session: held for session, held in self.ended.get({}).items() if held[1] + _HOLD > now}
        for session in starts.keys() | ends.keys():
            start = started.pop(session, None) or starts.get(session)
            held = [ended.pop(session)[0]] if session in ended else []
            end = min([*held, ends[session]] if session in ends else held, default=None)
            if start and end:
                yield (session, start[0], start[1], (end[0] - start[2]) // _SECOND, end[2])
            elif start:
                started[session] = start
            else:
                ended[session] = (end, now)
        self.started.put(started)
        self.ended.put(ended)


def sessions(rows: DataFrame) -> DataFrame:
    """A stream of starts (kind "start") and ends to sessions with their duration.

    A session without an end stays, however long; an end without a start is
    held for ``HOLD_DAYS``, a second end of a session as well.
    """
    dealt = _micros(rows, "start_time", "end_time").withColumn("bucket", _folded("session_id"))
    return packed_state(dealt, ["bucket"], Sessions(), SESSION, "Append", "ProcessingTime")


class Questions(Packed):
    """One decision per player and question of a bucket: the answer, or none after the time limit.

    The question stays until it is closed, so an answer that is repeated is
    not decided again. An answer or a close that comes before the question is
    held.
    """

    schema = ANSWER

    def __init__(self, limit: float, first_limit: float):
        self.limit, self.first_limit = limit, first_limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.asked = Held(handle, "asked")  # by room, player and question: when it was asked, whether it is decided
        self.early = Held(handle, "early")  # the same without a question: answer and when it came, when the close came

    def results(self, key, rows, timerValues) -> Iterator[tuple]:
        now = timerValues.getCurrentProcessingTimeInMs()
        new: dict[tuple, list] = {}
        names = ("room_id", "user_id", "question_number", "kind", "asked_at", "ts", "selected_answer", "response_time")
        table = _unpacked(rows)
        for room, user, question, kind, asked_at, ts, selected, seconds in zip(*(table.column(c).to_pylist() for c in names)):
            own = new.setdefault((room, user, question), [None, None, False])
            if kind == "asked":
                own[0] = own[0] or (asked_at,)
            elif kind == "closed":
                own[2] = True
            else:
                answer = (ts, selected, seconds)
                own[1] = min(own[1] or answer, answer)
        questions, early = self.asked.get({}), {}
        for k, (answer, since, closed) in self.early.get({}).items():
            answer = answer if answer and since + _HOLD > now else None
            closed = closed if closed and closed + _HOLD > now else None
            if answer or closed:
                early[k] = (answer, since, closed)
        for k, (asked, given, over) in new.items():
            asked, decided = questions.pop(k, None) or (asked, False)
            answer, since, closed = early.pop(k, (None, None, None))
            if not asked:
                # the first held answer stays, however many come
                early[k] = (answer or given, since if answer else now, now if over else closed)
                continue
            given = min((x for x in (answer, given) if x), default=None)
            over = over or closed is not None
            if not decided and (given or over):
                limit = self.first_limit if k[2] == 1 else self.limit
                decided = True
                if given and given[0] <= asked[0] + limit * _SECOND:
                    yield (*k, given[1], given[2])
                else:
                    yield (*k, NO_ANSWER, float(limit))
            if not over:
                questions[k] = (asked, decided)
        self.asked.put(questions)
        self.early.put(early)


def questions(rows: DataFrame, limit: float, first_limit: float | None = None) -> DataFrame:
    """A stream of asked questions, answers and closed questions to one decision each.

    ``first_limit`` is another limit, in seconds, for a player's first question.
    """
    processor = Questions(limit, limit if first_limit is None else first_limit)
    part = F.pmod(F.xxhash64("room_id", "question_number"), F.lit(PARTS))
    dealt = _micros(rows, "asked_at", "ts").withColumns({"part": part, "bucket": F.pmod("user_id", F.lit(BUCKETS // PARTS))})
    return packed_state(dealt, ["part", "bucket"], processor, ANSWER, "Append", "ProcessingTime")
