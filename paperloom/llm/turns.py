"""Conversation structure repair: the cheapest edits that make a conversation well formed.

A repaired conversation is empty, or an optional system turn and then pairs of a user's and an
assistant's turn: role initials ``(s?(ua)+)?``. Keeping a row costs nothing, giving it the other
role 2, deleting it 3, inserting an empty turn 2, and a truncated row that stays 1 more. Blank and
repeated rows must go. Of equally cheap edits the one whose letters (D, I, K, R) come first wins.

The search is Viterbi's over four states (nothing kept, a system turn last, a user's, an
assistant's), row by row as they stream in. Survivors are leaves of a tree of back pointers, whose
nodes count what refers to them: a node that nothing refers to is freed, and as long as all
survivors share an ancestor the edits up to it are decided and leave at once. So memory holds the
undecided rows, not the conversation; they are few unless the choice itself stays open, as in a
conversation of one role alone, where all later edits depend on which row loses its partner. Ties
are settled on the whole undecided letters. Survivors' letters up to the last row never begin one
another, so their order is kept as ranks from row to row and no letters are read twice. A survivor
goes as soon as another is cheaper by more than what the states can be apart from there on
(``APART``); otherwise "nothing kept" would stay to the end and nothing would ever be decided.

Rows of a conversation come in order of turn (nulls first; ties by role, then text) and are sorted
by Spark; a conversation, however long, streams through one task, as the digest of its text can't
be made in parts. Null ids are a conversation of their own; null roles and texts are one space.
Roles of another initial can only be changed or deleted. An empty table gives no rows; other
columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, SYSTEM, USER, ASSISTANT = range(4)
#: What edits cost.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: APART[s][t]: at most so much more does the rest cost from state t than from s, whatever follows.
APART = (
    (0, 4, 5, 3),
    (0, 0, 2, 0),
    (2, 2, 0, 2),
    (0, 4, 2, 0),
)
#: A row's first fault.
SOUND, BLANK, REPEATED, CUT = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: Rows that a task hands on at a time.
OUT_ROWS = 2_000


class Node:
    """An edit in the tree of back pointers; refs counts its children and the survivors at it."""

    __slots__ = ("parent", "letter", "row", "refs", "kids")

    def __init__(self, parent: "Node | None", letter: str, row: tuple | None) -> None:
        self.parent, self.letter, self.row, self.refs, self.kids = parent, letter, row, 0, []
        if parent is not None:
            parent.refs += 1
            parent.kids.append(self)

    def release(self) -> None:
        node = self
        node.refs -= 1
        while node.refs == 0 and node.parent is not None:
            above = node.parent
            above.kids.remove(node)
            above.refs -= 1
            node = above


def _advance(state: int, initial: str) -> int | None:
    """The state after a turn of this role initial, if it may come."""
    if initial == "u":
        return None if state == USER else USER
    if initial == "a":
        return ASSISTANT if state == USER else None
    return SYSTEM if initial == "s" and state == START else None


@dataclass
class Repair:
    """Repairs one conversation: ``row`` for each of its rows in order, then ``close``.

    ``emit(letter, row, role)`` gets each edit as soon as it is decided: row is what was given (None
    for an inserted turn) and role the repaired turn's (None for a deleted one).
    """

    emit: Callable[[str, tuple | None, str | None], None]
    root: Node = field(default_factory=lambda: Node(None, "", None))

    def __post_init__(self) -> None:
        #: By state: cost, node, and what orders the undecided letters: the rank of those up to the last row, and the turns inserted behind it.
        self.survivors: dict[int, tuple[int, Node, tuple[int, str]]] = {START: (0, self.root, (0, ""))}
        self.root.refs = 1
        self.state = START
        self._inserted()
        self._decided()

    def row(self, row: tuple, role: str, fault: int) -> None:
        """A row: its fault is SOUND, BLANK, REPEATED or CUT."""
        best: dict[int, tuple] = {}

        def offer(state: int | None, cost: int, key: tuple[int, str], node: Node, letter: str) -> None:
            new = cost, (key[0], key[1] + letter), node, letter
            if state is not None and (state not in best or new[:2] < best[state][:2]):
                best[state] = new

        more = TRUNCATED if fault == CUT else 0
        for state, (cost, node, key) in self.survivors.items():
            offer(state, cost + DELETE, key, node, "D")
            if fault not in (BLANK, REPEATED):
                offer(_advance(state, role[:1]), cost + more, key, node, "K")
                offer(ASSISTANT if state == USER else USER, cost + more + REROLE, key, node, "R")
        # none of these letters begins another's, so what follows won't change their order: ranks will do
        ranks = {key: n for n, key in enumerate(sorted(x[1] for x in best.values()))}
        fresh = {}
        for state, (cost, key, node, letter) in best.items():
            made = Node(node, letter, row)
            made.refs += 1
            fresh[state] = cost, made, (ranks[key], "")
        for _, node, _ in self.survivors.values():
            node.release()
        self.survivors = fresh
        self._inserted()
        for state in [s for s, (cost, *_) in self.survivors.items() if any(c + APART[s][t] < cost for t, (c, *_) in self.survivors.items())]:
            self.survivors.pop(state)[1].release()
        self._decided()

    def _inserted(self) -> None:
        """Turns inserted behind the row: one for the user, then one for the assistant. More never pay."""
        for into, sources in ((USER, (START, SYSTEM, ASSISTANT)), (ASSISTANT, (USER,))):
            found = [(cost + INSERT, (key[0], key[1] + "I"), node) for cost, node, key in (self.survivors[s] for s in sources if s in self.survivors)]
            if not found:
                continue
            cost, key, node = min(found, key=lambda x: x[:2])
            old = self.survivors.get(into)
            if old is None or (cost, key) < (old[0], old[2]):
                made = Node(node, "I", None)
                made.refs += 1
                self.survivors[into] = cost, made, key
                if old is not None:
                    old[1].release()

    def _decided(self) -> None:
        """Hands on the edits that all survivors share."""
        while self.root.refs == 1 and self.root.kids:
            child = self.root.kids.pop()
            child.parent = None
            self.root = child
            self._hand(child)

    def _hand(self, node: Node) -> None:
        role = None
        if node.letter != "D":
            given = node.row[0] if node.letter == "K" else None
            self.state = _advance(self.state, given[:1]) if given is not None else ASSISTANT if self.state == USER else USER
            role = ROLES[self.state] if given is None else given
        self.emit(node.letter, node.row, role)

    def close(self) -> int:
        """The cost; the last edits are handed on."""
        cost, _, node = min((self.survivors[s][0], self.survivors[s][2], self.survivors[s][1]) for s in (START, ASSISTANT) if s in self.survivors)
        rest = []
        while node is not self.root:
            rest.append(node)
            node = node.parent
        for node in reversed(rest):
            self._hand(node)
        return cost


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone of rows damaged by a checksum of their key.

    Of twenty rows, one is dropped (``gone``, without a text), one loses its text, one its
    sentence ends, one is repeated, and one gets the role user.
    """
    plain = conversations.select("conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = F.col("kind")
    marked = plain.withColumn("kind", (F.crc32(key.cast("binary")) % 20).cast("int"))
    text = F.when(kind <= 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    changed = marked.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (kind == 0).alias("gone"), "kind")
    times = F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))
    return changed.withColumn("again", F.explode(times)).drop("kind", "again")


def _fault(nth: Column) -> Column:
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    ended = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    return F.when(blank, BLANK).when(nth > 1, REPEATED).when(~ended, CUT).otherwise(SOUND)


def _ordered(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone, fault, a conversation's rows together and in order."""
    own = rows.select("conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")), "gone")
    # one shuffle: rows that lie by conv_id lie by conv_id, role and text as well
    nth = F.row_number().over(Window.partitionBy("conv_id", "gone", "role", "text").orderBy(F.col("turn").asc_nulls_first()))
    return own.repartition("conv_id").withColumn("nth", nth).select("conv_id", "turn", "role", "text", "gone", _fault(F.col("nth")).alias("fault")).sortWithinPartitions("conv_id", "gone", F.col("turn").asc_nulls_first(), "role", "text")


@dataclass
class Faults:
    """What a conversation's rows show as they pass in order."""

    counts: list[int] = field(default_factory=lambda: [0, 0, 0, 0])
    illegal: int = 0
    initial: str | None = None
    turns: int = 0
    low: int | None = None
    high: int | None = None

    def add(self, turn: int | None, role: str, fault: int) -> None:
        self.counts[fault] += 1
        if self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = role[:1]
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low, self.high = (turn if self.low is None else self.low), turn

    def gaps(self) -> int:
        return 0 if self.low is None else int(self.high - self.low + 1 - self.turns)


def _groups(batches: Iterator[pa.RecordBatch], kinds: list) -> Iterator[tuple[object, bool, tuple | None]]:
    """conv_id, whether it is new, and (turn, role, text, fault), None if the row is gone, of rows in order.

    ``kinds`` gets the Arrow types of conv_id and turn.
    """
    first, last = True, None
    for batch in batches:
        kinds[:] = [batch.schema.field(0).type, batch.schema.field(1).type]
        for conv, turn, role, text, gone, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield conv, first or conv != last, None if gone else (turn, role, text, fault)
            first, last = False, conv


def repaired(rows: DataFrame) -> DataFrame:
    """Every edit in order: conv_id, place (from 1), turn, edit (D, I, K, R), role, text.

    Deleted rows have the role they had; inserted ones have no turn and an empty text. ``rows`` has
    conv_id, turn, role, text, and may have ``gone`` for rows that aren't there.
    """
    rows = rows if "gone" in rows.columns else rows.withColumn("gone", F.lit(False))
    ordered = _ordered(rows)
    kinds = ordered.schema
    schema = T.StructType([kinds["conv_id"], T.StructField("place", T.LongType()), kinds["turn"], *(T.StructField(c, T.StringType()) for c in ("edit", "role", "text"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now: list = [None, 0]
        repair = None

        def emit(letter: str, row: tuple | None, role: str | None) -> None:
            now[1] += 1
            was, turn, text = row if row else (None, None, "")
            out.append((now[0], now[1], turn, letter, was if role is None else role, text))

        def flushed() -> pa.RecordBatch:
            own = [types[0], pa.int64(), types[1], pa.string(), pa.string(), pa.string()]
            made = [pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), own, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(made, names=schema.names)

        types: list = []
        for conv, new, row in _groups(batches, types):
            if new:
                if repair:
                    repair.close()
                now[:], repair = [conv, 0], Repair(emit)
            if row:
                repair.row((row[1], row[0], row[2]), row[1], row[3])
            if len(out) >= OUT_ROWS:
                yield flushed()
        if repair:
            repair.close()
        if out:
            yield flushed()

    return ordered.mapInArrow(run, schema)


def repair_report(rows: DataFrame) -> DataFrame:
    """Per conversation of ``rows`` (see ``repaired``): its faults, and the cost, letters and digest of its repair.

    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. Conversations of
    which all rows are gone have zeros, no letters and the digest of nothing.
    """
    rows = rows if "gone" in rows.columns else rows.withColumn("gone", F.lit(False))
    ordered = _ordered(rows)
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    schema = T.StructType([ordered.schema["conv_id"], *(T.StructField(c, T.LongType()) for c in names), T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        kinds: list = []
        conv_now, faults, repair = None, Faults(), None
        letters: list[str] = []
        digest = hashlib.sha256()
        turns = 0

        def emit(letter: str, row: tuple | None, role: str | None) -> None:
            nonlocal turns
            letters.append(letter)
            if role is not None:
                digest.update(f"{'\n' if turns else ''}{role}:{row[1] if row else ''}".encode("utf-8", "surrogatepass"))
                turns += 1

        def closed() -> None:
            cost = repair.close()
            out.append((conv_now, faults.gaps(), *faults.counts[1:], faults.illegal, cost, "".join(letters), digest.hexdigest()))

        def flushed() -> pa.RecordBatch:
            types = [kinds[0], *[pa.int64()] * len(names), pa.string(), pa.string()]
            made = [pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(made, names=schema.names)

        for conv, new, row in _groups(batches, kinds):
            if new:
                if repair:
                    closed()
                conv_now, faults, letters, digest, turns = conv, Faults(), [], hashlib.sha256(), 0
                repair = Repair(emit)
            if row:
                faults.add(row[0], row[1], row[3])
                repair.row((row[1], row[2]), row[1], row[3])
            if len(out) >= OUT_ROWS:
                yield flushed()
        if repair:
            closed()
        if out:
            yield flushed()

    return ordered.mapInArrow(run, schema)
