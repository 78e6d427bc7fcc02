"""Conversation turn reassembly: a stateful stream over hash buckets of conversations with a timing wheel each.

1. ``replayed`` deals a table's turns into batches, some of them twice, and keeps a turn's smallest payload a batch.
2. ``reassembled`` writes one batch after the other into a stream's source and starts the query anew for each, on one
   checkpoint. Its state is keyed by hash bucket. A bucket holds cells and a timing wheel: a slot for each batch, with
   the cells that close in it if nothing more arrives. An arrival files its cell again, under a new generation; what
   the old slot still says of it is found out of date when that slot's tick comes. A tick visits its own slot only,
   the final one all that are left.
3. A cell is a conversation, or ``block`` turns of a longer one, so a conversation that makes up a third of all rows
   lies in many buckets. Each of its blocks hears of arrivals in the others by a notice in the same batch, so all
   close in one batch, and rejects are the same. A block releases its own gapless run; what leads from block to block
   (the runs before it, a role at its edge, unreleased turns) is put together from one row a block behind the stream.

A batch's output is written by Spark's file sink, so a batch that is run again after a lost executor or driver counts
once. Every call has a folder of its own under spark.checkpoint.dir.

Defined results: turns without number or conversation are dropped; null role and text are empty; rows that repeat a
turn of a conversation arrive in one batch, as the smallest payload; an empty table gives no events; other columns are
not looked at.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .common import chunk_count, cut, shared_folder, stored
from .components import joined_by

#: Turns of one conversation in a cell.
BLOCK = 512
ARRIVAL, NOTICE, TICK = 0, 1, 2
RELEASE, REJECT, CLOSE = 0, 1, 2
SOURCE = "bucket long, kind int, conv_id long, block long, turn long, first long, role string, payload string"
EVENTS = "kind int, conv_id long, block long, turn long, batch long, payload string, first long, kept long, top long, breaks long, full long, stop long, head string, tail string, waiting array<long>"
NAMES = [x.split()[0] for x in EVENTS.split(", ")]
#: Behind every batch: of a block that isn't full.
NEVER = 1 << 40


def replayed(conversations: DataFrame, batches: int = 12) -> DataFrame:
    """(batch, conv_id, turn, role, payload): the contract's feed. h, the first 32 bits of a turn's SHA-256, gives the
    batch; where h % 7 < 2 the turn comes as the user's too, three batches on."""
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))).where("conv_id IS NOT NULL AND turn IS NOT NULL")
    name = F.concat_ws(":", "conv_id", "turn").cast("binary")
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    turns = turns.withColumn("h", h)
    own = F.struct((F.col("h") % batches).alias("batch"), F.col("role"))
    again = F.struct(((F.col("h") + 3) % batches).alias("batch"), F.lit("user").alias("role"))
    sent = turns.select("conv_id", "turn", "text", F.explode(F.when(F.col("h") % 7 < 2, F.array(own, again)).otherwise(F.array(own))).alias("s"))
    return smallest(sent.select("s.batch", "conv_id", "turn", "s.role", F.concat_ws("|", "s.role", "text").alias("payload")))


def smallest(arrivals: DataFrame) -> DataFrame:
    """Per batch one row a turn: the smallest payload by UTF-8 bytes, and of equal ones that of the smallest role."""
    least = arrivals.groupBy("batch", "conv_id", "turn").agg(F.min(F.struct("payload", "role")).alias("m"))
    return least.select("batch", "conv_id", "turn", "m.role", "m.payload")


class Bucket:
    """The cells of a hash bucket and its wheel, as one batch finds and leaves them."""

    def __init__(self, blob: bytes | None, idle: int, last: int, block: int):
        self.cells, self.wheel = pickle.loads(blob) if blob else ({}, {})
        self.idle, self.last, self.block = idle, last, block
        self.out: list[tuple] = []

    def blob(self) -> bytes:
        return pickle.dumps((self.cells, self.wheel), protocol=5)

    def file(self, key: tuple, first: int, batch: int) -> dict | None:
        """Opens a cell if there is none, and files it under the batch that closes it; None if it is closed."""
        cell = self.cells.get(key, 0)
        if cell is None:
            return None
        if cell == 0:
            start = first + key[1] * self.block
            cell = self.cells[key] = {"age": 0, "first": first, "start": start, "next": start, "kept": 0, "top": first, "breaks": 0, "full": NEVER, "head": None, "role": None, "waiting": {}}
        cell["age"] += 1
        self.wheel.setdefault(min(batch + self.idle, self.last), []).append((key, cell["age"]))
        return cell

    def arrive(self, key: tuple, cell: dict, turn: int, role: str, payload: str) -> None:
        if turn < cell["next"] or turn in cell["waiting"]:  # the earliest is kept
            return
        cell["waiting"][turn] = (role, payload)
        cell["kept"] += 1
        cell["top"] = max(cell["top"], turn)
        if turn == cell["start"]:
            cell["head"] = role

    def release(self, key: tuple, cell: dict, batch: int) -> None:
        """The gapless run of kept turns from the first."""
        before = cell["next"]
        while (found := cell["waiting"].pop(cell["next"], None)) is not None:
            role, payload = found
            cell["breaks"] += cell["next"] > cell["start"] and role == cell["role"]
            cell["role"] = role
            self.say(RELEASE, key, batch, turn=cell["next"], payload=payload)
            cell["next"] += 1
        if before < cell["next"] == cell["start"] + self.block:
            cell["full"] = batch

    def close(self, key: tuple, cell: dict, batch: int) -> None:
        waiting = cell["waiting"]
        breaks = cell["breaks"] + sum(t - 1 in waiting and waiting[t - 1][0] == role for t, (role, _) in waiting.items())
        end = cell["start"] + self.block - 1
        tail = cell["role"] if cell["next"] > end else waiting[end][0] if end in waiting else None
        self.say(CLOSE, key, batch, turn=cell["start"], first=cell["first"], kept=cell["kept"], top=cell["top"], breaks=breaks, full=cell["full"], stop=cell["next"], head=cell["head"], tail=tail, waiting=sorted(waiting))
        self.cells[key] = None

    def tick(self, batch: int) -> None:
        """Closes what is due in this batch's slot; the final tick empties every slot."""
        for slot in sorted(self.wheel) if batch == self.last else [batch]:
            for key, age in self.wheel.pop(slot, []):
                cell = self.cells[key]
                if cell is not None and cell["age"] == age:
                    self.close(key, cell, batch)

    def say(self, kind: int, key: tuple, batch: int, turn: int, payload: str = "", **cell) -> None:
        row = {"kind": kind, "conv_id": key[0], "block": key[1], "turn": turn, "batch": batch, "payload": payload, "first": 0, "kept": 0, "top": 0, "breaks": 0, "full": 0, "stop": 0, "head": None, "tail": None, "waiting": None} | cell
        self.out.append(tuple(row[c] for c in NAMES))


def stepper(idle: int, last: int, block: int):
    def step(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames))
        bucket = Bucket(state.get[0] if state.exists else None, idle, last, block)
        batch = int(rows.turn[rows.kind == TICK].iloc[0])
        touched: dict[tuple, dict | None] = {}
        for kind, conv, number, turn, first, role, payload in rows[["kind", "conv_id", "block", "turn", "first", "role", "payload"]].sort_values(["conv_id", "block", "turn"]).itertuples(index=False, name=None):
            if kind == TICK:
                continue
            key = (conv, number)
            if key not in touched:
                touched[key] = bucket.file(key, first, batch)
            if kind == ARRIVAL and touched[key] is None:
                bucket.say(REJECT, key, batch, turn=turn, payload=payload)
            elif kind == ARRIVAL:
                bucket.arrive(key, touched[key], turn, role, payload)
        for key, cell in touched.items():
            if cell is not None:
                bucket.release(key, cell, batch)
        bucket.tick(batch)
        state.update((bucket.blob(),))
        yield pd.DataFrame(bucket.out, columns=NAMES)

    return step


def _offset(block: int) -> Column:
    return F.call_function("div", F.col("turn").cast("decimal(20,0)") - F.col("first").cast("decimal(20,0)"), F.lit(block).cast("decimal(20,0)"))


def addressed(arrivals: DataFrame, batches: int, block: int, buckets: int) -> DataFrame:
    """All rows that the stream is fed with, by batch: arrivals, notices to the other blocks of a long conversation,
    and a tick for each bucket and batch, the end included."""
    firsts = cut(arrivals.groupBy("conv_id").agg(F.min("turn").alias("first"), F.count("*").alias("n")))
    rows = joined_by(arrivals, firsts.select("conv_id", "first"), "conv_id", firsts.select("conv_id", "n"))
    rows = rows.withColumn("block", _offset(block))
    blocks = rows.select("conv_id", "first", "block").distinct()
    others = blocks.join(rows.where("block > 0").select("conv_id").distinct(), "conv_id", "left_semi")
    heard = arrivals.select("batch", "conv_id").distinct().join(others, "conv_id")
    bucket = F.pmod(F.xxhash64("conv_id", "block"), F.lit(buckets)).alias("bucket")
    no = F.lit(None).cast("string")
    fed = rows.select("batch", bucket, F.lit(ARRIVAL).alias("kind"), "conv_id", "block", "turn", "first", "role", "payload")
    fed = fed.unionByName(heard.select("batch", bucket, F.lit(NOTICE).alias("kind"), "conv_id", "block", F.col("first").alias("turn"), "first", no.alias("role"), no.alias("payload")))
    zero = F.lit(0).cast("long")
    ticks = arrivals.sparkSession.range(buckets).select(F.explode(F.sequence(zero, F.lit(batches).cast("long"))).alias("batch"), F.col("id").alias("bucket"), F.lit(TICK).alias("kind"), zero.alias("conv_id"), zero.alias("block"), zero.alias("turn"), zero.alias("first"), no.alias("role"), no.alias("payload"))
    return fed.unionByName(ticks.withColumn("turn", F.col("batch")))


def reassembled(arrivals: DataFrame, batches: int = 12, idle: int = 3, block: int = BLOCK) -> DataFrame:
    """What becomes of arrivals(batch, conv_id, turn, role, payload; one row a turn and batch, batches from 0):
    event, conv_id, turn, batch, payload, unreleased, n_missing, n_breaks.

    release: a kept turn, in the batch that completes the run from the first turn to it; reject: an arrival after its
    conversation has closed; close: ``idle`` batches without arrivals, or the end, as batch ``batches``, with
    the numbers of the kept turns that weren't released."""
    spark = arrivals.sparkSession
    home = f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    arrivals = stored(arrivals, "arrivals")
    buckets = chunk_count(arrivals, 4 << 20)
    fed = addressed(arrivals, batches, block, buckets)
    fed.repartition("batch", F.pmod("bucket", F.lit(-(-buckets // batches)))).write.partitionBy("batch").parquet(f"{home}/fed")
    names = [x.split()[0] for x in SOURCE.split(", ")]
    step = stepper(idle, batches, block)
    for batch in range(batches + 1):
        spark.read.parquet(f"{home}/fed").where(F.col("batch") == batch).select(*names).write.mode("append").parquet(f"{home}/source")
        stream = spark.readStream.schema(SOURCE).parquet(f"{home}/source")
        events = stream.groupBy("bucket").applyInPandasWithState(step, EVENTS, "cells binary", "append", GroupStateTimeout.NoTimeout)
        run = events.writeStream.outputMode("append").option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).format("parquet").start(f"{home}/events")
        run.awaitTermination()
    return joined_blocks(spark.read.schema(EVENTS).parquet(f"{home}/events"), block)


def joined_blocks(events: DataFrame, block: int) -> DataFrame:
    """Events of whole conversations from those of their blocks."""
    by = Window.partitionBy("conv_id").orderBy("block")
    before = F.max("full").over(by.rowsBetween(Window.unboundedPreceding, -1))
    cells = events.where(F.col("kind") == CLOSE)
    # batch by which all blocks before this one were full
    ready = F.when(F.col("block") == 0, F.lit(-1)).when(F.row_number().over(by) - 1 == F.col("block"), before).otherwise(F.lit(NEVER))
    edge = (F.lag("block").over(by) == F.col("block") - 1) & (F.lag("tail").over(by) == F.col("head"))
    cells = cells.withColumn("ready", ready.cast("long")).withColumn("breaks", F.col("breaks") + F.coalesce(edge, F.lit(False)).cast("long"))
    none = F.lit(None).cast("long")
    nothing = F.lit(None).cast("array<long>")
    release = events.where(F.col("kind") == RELEASE)
    first = release.where("block = 0")
    later = release.where("block > 0").join(cells.where("block > 0").select("conv_id", "block", "ready"), ["conv_id", "block"]).where(F.col("ready") < NEVER)
    later = later.withColumn("batch", F.greatest("batch", "ready"))
    out = first.select("conv_id", "turn", "batch", "payload", F.lit("release").alias("event"))
    out = out.unionByName(later.select("conv_id", "turn", "batch", "payload", F.lit("release").alias("event")))
    out = out.unionByName(events.where(F.col("kind") == REJECT).select("conv_id", "turn", "batch", "payload", F.lit("reject").alias("event")))
    out = out.select("event", "conv_id", "turn", "batch", "payload", nothing.alias("unreleased"), none.alias("n_missing"), none.alias("n_breaks"))
    held = F.when((F.col("ready") == NEVER) & (F.col("stop") > F.col("turn")), F.concat(F.sequence("turn", F.col("stop") - 1), "waiting")).otherwise(F.col("waiting"))
    closed = cells.groupBy("conv_id").agg(
        F.max("batch").alias("batch"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block", held.alias("held")))), lambda x: x["held"])).alias("unreleased"),
        (F.max(F.when(F.col("kept") > 0, F.col("top"))) - F.max("first") + 1 - F.sum("kept")).alias("n_missing"), F.sum("breaks").alias("n_breaks"),
    )
    closed = closed.select(F.lit("close").alias("event"), "conv_id", F.lit(-1).cast("long").alias("turn"), "batch", F.lit(None).cast("string").alias("payload"), "unreleased", "n_missing", "n_breaks")
    return out.unionByName(closed)


#: The same in DuckDB, with the query's parameters.
SQL = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
    ('0x' || substr(sha256(conv_id || ':' || turn), 1, 8))::BIGINT AS h
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL
), firsts AS (SELECT conv_id, min(turn) AS first FROM turns GROUP BY conv_id),
sent AS (
  SELECT h % 12 AS batch, conv_id, turn, role, role || '|' || text AS payload FROM turns
  UNION ALL SELECT (h + 3) % 12, conv_id, turn, 'user', 'user|' || text FROM turns WHERE h % 7 < 2
), arrivals AS (
  SELECT * FROM sent QUALIFY row_number() OVER (PARTITION BY batch, conv_id, turn ORDER BY payload, role) = 1
), closing AS (
  SELECT conv_id, min(least(batch + 3, 12)) AS closed
  FROM (SELECT conv_id, batch, lead(batch) OVER (PARTITION BY conv_id ORDER BY batch) AS next FROM (SELECT DISTINCT conv_id, batch FROM arrivals))
  WHERE next IS NULL OR next > batch + 3 GROUP BY conv_id
), kept AS (
  SELECT a.conv_id, a.turn, a.batch, a.role, a.payload, first, closed
  FROM arrivals AS a JOIN closing USING (conv_id) JOIN firsts USING (conv_id) WHERE a.batch <= closed
  QUALIFY row_number() OVER (PARTITION BY a.conv_id, a.turn ORDER BY a.batch) = 1
), runs AS (
  SELECT *, count(*) OVER w = turn - first + 1 AS released, max(batch) OVER w AS done,
    coalesce(lag(turn) OVER w = turn - 1 AND lag(role) OVER w = role, false) AS again
  FROM kept WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
)
SELECT 'release' AS event, sha256(payload) AS sha256, conv_id, turn, done AS batch, NULL::BIGINT AS n_missing, NULL::BIGINT AS n_breaks FROM runs WHERE released
UNION ALL
SELECT 'reject', sha256(payload), conv_id, turn, batch, NULL, NULL FROM arrivals JOIN closing USING (conv_id) WHERE batch > closed
UNION ALL
SELECT 'close', sha256(coalesce(string_agg(turn::VARCHAR, ',' ORDER BY turn) FILTER (WHERE NOT released), '')), conv_id, -1, any_value(closed),
  max(turn) - any_value(first) + 1 - count(*), count(*) FILTER (WHERE again)
FROM runs GROUP BY conv_id
"""
