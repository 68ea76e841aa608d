"""The log of changes replayed: confirm, reopen, discard and resolve in one order, conflicts as rows.

A log row (seq, doc_id, action, doc_type, client_id) meets the document as all earlier rows left it.
What decides is always the last row of some kind before it, so the replay is a carry of last values
along the log (``carry.last_before``), which cuts a document with many changes into runs.

Outcomes: "missing" for a document that isn't there or was discarded (404), "conflict" for a reopen of
one that isn't confirmed (409), "bad" for another action (400), "nothing" for a resolve without a flag,
else "done". Rows that aren't done change nothing. ``seq`` is unique and not null.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions import tables as V
from paperloom.operators.carry import bounds_for, last_before, left_spread, running_sum

ACTIONS = ("confirm", "reopen", "discard", "resolve")
#: What the event log calls a change that was made.
EVENTS = {"confirm": "confirmed", "reopen": "unconfirmed", "discard": "deleted", "resolve": "dup_resolved"}


@dataclass(frozen=True)
class Replay:
    """``steps``: each log row with outcome and the document's state before and after it.

    ``gone``: target, the discarded documents. ``bounds``: the log's blocks (``carry``).
    """

    docs: DataFrame
    steps: DataFrame
    gone: DataFrame
    bounds: list

    def results(self) -> DataFrame:
        """seq, doc_id, action, outcome."""
        return self.steps.select("seq", "doc_id", "action", "outcome")

    def events(self) -> DataFrame:
        """seq, type, doc_id, doc_type, manual_type_change of the changes made."""
        kind = F.create_map(*[F.lit(x) for pair in EVENTS.items() for x in pair])[F.col("action")]
        typed = F.when(F.col("action") != "resolve", F.col("type_after"))
        manual = F.when(F.col("action") == "confirm", F.coalesce(F.col("doc_type") != "", F.lit(False)) & ~F.col("doc_type").eqNullSafe(F.col("type_before")))
        return self.steps.where("outcome = 'done'").select("seq", kind.alias("type"), "doc_id", typed.alias("doc_type"), manual.alias("manual_type_change"))

    def accepted(self, confirms: DataFrame) -> DataFrame:
        """The field rows (seq, ...) of confirms that were done."""
        return confirms.join(self.steps.where("action = 'confirm' AND outcome = 'done'").select("seq"), "seq", "left_semi")

    def documents(self) -> DataFrame:
        """The documents that are left, with status, doc_type, client_id and duplicate_of as they are at the end."""
        done = self.steps.where("outcome = 'done'")
        last = done.groupBy(F.col("doc_id").alias("k")).agg(
            F.max_by(F.struct("status_after", "type_after", "client_after"), "seq").alias("s"), F.bool_or(F.col("action") == "discard").alias("gone"), F.bool_or(F.col("action") == "resolve").alias("kept"))
        joined = self.docs.join(last, F.col("id") == F.col("k"), "left").where("NOT coalesce(gone, false)")
        joined = left_spread(joined, self.gone, "duplicate_of", "target", "id")
        met = F.col("s").isNotNull()
        new = {"status": F.when(met, F.col("s.status_after")).otherwise(F.col("status")), "doc_type": F.when(met, F.col("s.type_after")).otherwise(F.col("doc_type")),
               "client_id": F.when(met, F.col("s.client_after")).otherwise(F.col("client_id")), "duplicate_of": F.when(F.col("target").isNull() & ~F.coalesce("kept", F.lit(False)), F.col("duplicate_of"))}
        return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in self.docs.columns])

    def received(self, lists: DataFrame) -> DataFrame:
        """id, received_docs of the clients (id, received_docs) at the end.

        A confirm adds its type behind the others unless it is there. A reopen or discard of a confirmed
        document takes its type off if no other confirmed document of the client has it then: the
        running count of such documents is 0.
        """
        done = self.steps.where("outcome = 'done'")
        was, now = F.col("status_before") == "confirmed", F.col("status_after") == "confirmed"
        pair = lambda when: F.struct(F.col(f"client_{when}").alias("client"), F.col(f"type_{when}").alias("type"))
        moves = done.select("seq", F.explode(F.array(
            F.when(was, F.struct(pair("before").alias("p"), F.lit(-1).alias("n"), F.col("action").isin("reopen", "discard").alias("off"), F.lit(False).alias("on"))),
            F.when(now, F.struct(pair("after").alias("p"), F.lit(1).alias("n"), F.lit(False).alias("off"), (F.col("action") == "confirm").alias("on"))))).alias("m"))
        moves = moves.where("m IS NOT NULL").select("seq", "m.p.*", "m.n", "m.off", "m.on").groupBy("client", "type", "seq").agg(F.sum("n").alias("n"), F.bool_or("off").alias("off"), F.bool_or("on").alias("on"))
        first = self.docs.where("status = 'confirmed'").groupBy(F.col("client_id").alias("client"), F.col("doc_type").alias("type")).agg(F.count("*").alias("n"))
        first = first.select("client", "type", F.lit(None).cast("bigint").alias("seq"), "n", F.lit(False).alias("off"), F.lit(False).alias("on"))
        some = F.col("type").isNotNull() & F.col("client").isNotNull() & ~F.col("type").isin("", V.UNRECOGNIZED)
        counted = running_sum(moves.unionByName(first).where(some), ["client", "type"], "seq", F.col("n"), "left", bounds=self.bounds)
        off = counted.where("off AND left = 0").groupBy("client", "type").agg(F.max("seq").alias("off_at"))
        on = counted.where("on").join(off, ["client", "type"], "left").where("off_at IS NULL OR seq > off_at").groupBy("client", "type").agg(F.min("seq").alias("on_at"))
        told = off.join(on, ["client", "type"], "full").select(F.col("client").alias("id"), "type", "off_at", "on_at")
        had = lists.select("id", F.posexplode("received_docs").alias("pos", "type"))
        both = had.join(told, ["id", "type"], "full").join(lists.select("id"), "id", "left_semi")
        stays = F.col("pos").isNotNull() & F.col("off_at").isNull()
        place = F.when(stays, F.struct(F.lit(0).alias("a"), F.col("pos").cast("bigint").alias("b"))).when(F.col("on_at").isNotNull(), F.struct(F.lit(1).alias("a"), F.col("on_at").alias("b")))
        kept = both.withColumn("place", place).where("place IS NOT NULL").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", "type"))).alias("x"))
        return lists.select("id").join(kept.select("id", F.transform("x", lambda s: s["type"]).alias("received_docs")), "id", "left").select("id", F.coalesce("received_docs", F.array().cast("array<string>")).alias("received_docs"))


def replay(docs: DataFrame, log: DataFrame, blocks: int | None = None) -> Replay:
    """Replays ``log`` over ``docs`` (id, status, doc_type, client_id, duplicate_of)."""
    action, bounds = F.col("action"), bounds_for(log, "seq", blocks)  # of the log itself: nothing is joined or replayed for them
    first = docs.select(F.col("id").alias("doc_id"), F.col("status").alias("status0"), F.col("doc_type").alias("type0"), F.col("client_id").alias("client0"), F.col("duplicate_of").alias("flag0"), F.lit(True).alias("there"))
    # the flags' targets are looked up before the log is met: one row a document, most of them without a flag
    gone = log.where(action == "discard").groupBy(F.col("doc_id").alias("target")).agg(F.min("seq").alias("flag_gone")).join(docs.select(F.col("id").alias("target")), "target", "left_semi")
    first = left_spread(first, gone, "flag0", "target", "doc_id")
    own = log.select("seq", "doc_id", "action", "doc_type", "client_id").join(first, "doc_id", "left")
    typed, filed = (action == "confirm") & F.coalesce(F.col("doc_type") != "", F.lit(False)), (action == "confirm") & F.col("client_id").isNotNull()
    met = last_before(own, ["doc_id"], "seq", {
        "gone": F.when(action == "discard", True), "turn": F.when(action.isin("confirm", "reopen"), action), "ever": F.when(action == "confirm", True),
        "type_last": F.when(typed, F.col("doc_type")), "client_last": F.when(filed, F.col("client_id")), "kept": F.when(action == "resolve", True)}, bounds=bounds)
    confirmed = F.coalesce(F.col("turn") == "confirm", F.col("status0") == "confirmed", F.lit(False))
    reopened = F.coalesce(F.col("turn") == "reopen", F.lit(False)) & (F.coalesce("ever", F.lit(False)) | F.coalesce(F.col("status0") == "confirmed", F.lit(False)))
    flagged = F.col("flag0").isNotNull() & F.col("kept").isNull() & ~F.coalesce(F.col("flag_gone") < F.col("seq"), F.lit(False))
    outcome = (F.when(F.col("there").isNull() | F.col("gone").isNotNull(), "missing").when(~F.coalesce(action.isin(*ACTIONS), F.lit(False)), "bad")
               .when((action == "reopen") & ~confirmed, "conflict").when((action == "resolve") & ~flagged, "nothing").otherwise("done"))
    status = F.when(confirmed, "confirmed").when(reopened, "extracted").otherwise(F.col("status0"))
    kind, client = F.coalesce("type_last", "type0"), F.coalesce("client_last", "client0")
    steps = met.select(
        "seq", "doc_id", "action", "doc_type", outcome.alias("outcome"), status.alias("status_before"), kind.alias("type_before"), client.alias("client_before"),
        F.when(action == "confirm", "confirmed").when(action == "reopen", "extracted").when(action == "discard", F.lit(None)).otherwise(status).alias("status_after"),
        F.when(typed, F.col("doc_type")).otherwise(kind).alias("type_after"), F.when(filed, F.col("client_id")).otherwise(client).alias("client_after"))
    return Replay(docs, steps, gone.select("target"), bounds)  # a first discard of a document that is there is always done
