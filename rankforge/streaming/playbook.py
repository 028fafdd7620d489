"""The rule store and event windows as Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def event_windows(events: DataFrame, ts: str = "ts", width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums by event-time window and type; rows later than ``late`` are dropped by the watermark."""
    x = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return x.groupBy(F.window(ts, width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Drains the stream into Parquet (exactly once, by the checkpoint) and reads what was written."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def fold_stream(ops: DataFrame, key: str, seq: str, op: str, amount: str) -> DataFrame:
    """The rule store as arbitrary state: a row (key, counter, tags, live, seq) for each key that a micro-batch touches.

    ADD opens a key with its amount, UPDATE sets and TAG adds to the counter of a live one, REMOVE ends it; other
    operations on a key that does not live are ignored. A micro-batch's operations on a key are ordered by ``seq``;
    later batches must hold later ones. State is three numbers a key; null keys are left out. A hot key's operations
    in one batch are read by one task, so the batch's size (the source's rate options) is their bound.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    kind = dict(ops.dtypes)[key]

    def step(k, frames, state):
        live, counter, tags = state.get if state.exists else (False, 0, 0)
        rows = pd.concat(list(frames)).sort_values(seq)
        for what, n in zip(rows[op], rows[amount], strict=True):
            if what == "ADD":
                live, counter, tags = True, int(n), 0
            elif what == "REMOVE":
                live, counter, tags = False, 0, 0
            elif live and what == "UPDATE":
                counter = int(n)
            elif live and what == "TAG":
                counter, tags = counter + int(n), tags + 1
        state.update((bool(live), int(counter), int(tags)))
        yield pd.DataFrame({key: [k[0]], "counter": [counter], "tags": [tags], "live": [live], "seq": [int(rows[seq].max())]})

    x = ops.select(key, F.col(seq).cast("long").alias(seq), op, F.coalesce(F.col(amount).cast("long"), F.lit(0)).alias(amount)).where(F.col(key).isNotNull())
    return x.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, counter long, tags long, live boolean, seq long", "live boolean, counter long, tags long", "update", GroupStateTimeout.NoTimeout)


def upsert_to_end(stream: DataFrame, path: str, checkpoint: str, key: str, seq: str = "seq") -> DataFrame:
    """Drains an update-mode stream into a Parquet folder a batch (a repeated batch overwrites its own) and reads each key's last row."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    q = stream.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = stream.sparkSession.read.schema(stream.schema).parquet(path)
    names = [c for c in stream.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*names), seq).alias("__x")).select(key, "__x.*")


LOG = "book {kind}, kind string, step long, seq long, op string, id string, section string, content string, helpful long, harmful long, neutral long, at long, done boolean, bullets long"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def book_stream(ops: DataFrame) -> DataFrame:
    """Rule books as state: what the batch ``books`` gives, and logs of how it came about, as one stream of rows by kind.

    ``snapshot``: a book's number of bullets before a step's operations; ``change``: every operation, the id that it
    got and whether it did anything; ``bullet``: each touched bullet after the batch (done: it lives). State is a map of
    a book's bullets and its running number, in RocksDB, so a book may outgrow memory. Operations (book, seq, step, op,
    section, content, id, metadata) of a batch are applied by seq; later batches must hold later ones; null books are
    left out.
    """
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    from rankforge.operators.playbook import TAGS

    schema = LOG.format(kind=dict(ops.dtypes)["book"])
    names = [c.split()[0] for c in schema.split(", ")]

    class Book(StatefulProcessor):
        def init(self, handle) -> None:
            self.bullets = handle.getMapState("bullets", "id string", "section string, content string, helpful long, harmful long, neutral long, at long")
            self.counts = handle.getValueState("counts", "made long, bullets long")

        def handleInputRows(self, key, rows, timers):
            made, size = self.counts.get() if self.counts.exists() else (0, 0)
            frame = pd.concat(list(rows)).sort_values("seq")
            out, touched, step = [], {}, None
            for r in frame.itertuples(index=False):
                op, name, told = (r.op or "").upper(), r.id, {} if r.metadata is None else dict(r.metadata)
                told = {t: int(told[t]) for t in TAGS if told.get(t) is not None}
                if r.step != step:
                    step = r.step
                    out.append({"kind": "snapshot", "step": step, "bullets": size})
                if op == "ADD" and name is None:
                    made += 1
                    name = f"{((r.section or '').split() or [''])[0].lower()}-{made:05d}"
                have = self.bullets.getValue((name,)) if name is not None and self.bullets.containsKey((name,)) else None
                done = True
                if op == "ADD":
                    size += have is None
                    now = (r.section, r.content or "", *(told.get(t, 0) for t in TAGS), int(r.seq))
                elif have is None or op not in ("UPDATE", "TAG", "REMOVE"):
                    done, now = False, None
                elif op == "REMOVE":
                    size, now = size - 1, None
                    self.bullets.removeKey((name,))
                else:
                    counters = [told.get(t, have[i + 2]) if op == "UPDATE" else have[i + 2] + told.get(t, 0) for i, t in enumerate(TAGS)]
                    now = (have[0], have[1] if op == "TAG" or r.content is None else r.content, *counters, have[5])
                if now is not None:
                    self.bullets.updateValue((name,), now)
                if done:
                    touched[name] = (now, int(r.seq))
                out.append({"kind": "change", "step": step, "seq": r.seq, "op": op, "id": name, "done": done})
            for name, (now, seq) in touched.items():
                out.append({"kind": "bullet", "id": name, "seq": seq, "done": now is not None} | dict(zip(("section", "content", *TAGS, "at"), now or (), strict=False)))
            self.counts.update((int(made), int(size)))
            yield pd.DataFrame({c: pd.Series([key[0] if c == "book" else x.get(c) for x in out], dtype=object) for c in names})  # objects: nulls stay nulls, whole numbers whole

        def close(self) -> None:
            pass

    rows = ops.where("book is not null").select("book", F.col("seq").cast("long"), F.col("step").cast("long"), "op", "section", "content", "id", "metadata")
    return rows.groupBy("book").transformWithStateInPandas(Book(), schema, "Update", "None")


def drain_by_kind(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Drains a stream into a Parquet folder a batch with a part for each kind, one write a batch; a repeated batch overwrites its own."""
    spark = stream.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        save = lambda batch, number: batch.write.mode("overwrite").partitionBy("kind").parquet(f"{path}/batch={number}")
        stream.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(stream.schema).parquet(path)


def latest_bullets(log: DataFrame) -> DataFrame:
    """The bullets that live, from a log: of each one the row of its last operation."""
    columns = ["section", "content", "helpful", "harmful", "neutral", "at", "done"]
    last = log.where("kind = 'bullet'").groupBy("book", "id").agg(F.max_by(F.struct(*columns), "seq").alias("x"))
    return last.select("book", "id", "x.*").where("done").drop("done")
