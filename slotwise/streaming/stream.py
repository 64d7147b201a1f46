"""Streaming forms of the slot operators (extensions: batch has the same results)."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def audit_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An append log of JSON lines as a stream."""
    return spark.readStream.schema(schema).json(path)


def slot_state(claims: DataFrame) -> DataFrame:
    """Newest claim of each slot with the number of claims and a conflict flag; run in update or complete mode."""
    g = claims.groupBy("slot").agg(F.max_by("id", F.struct("recorded_at", "id")).alias("newest"), F.count("*").alias("claims"), F.approx_count_distinct("value").alias("values"))
    return g.withColumn("conflict", F.col("claims") > 1)


def windowed(claims: DataFrame, length: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Claims by type in tumbling windows; what comes later than `late` is left out."""
    return claims.withWatermark("recorded_at", late).groupBy(F.window("recorded_at", length), "type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "type", "n")


def upsert(path: str):
    """A foreachBatch sink that keeps news by id; `upserted` reads the newest row of each.

    A batch is written once below its own number, whatever the table's size, and
    written again if it is repeated; older batches are never read or rewritten.
    Of rows of one time in a batch the one with the largest hash is kept.
    """

    def write(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy("id").agg(F.max_by(F.struct(*batch.columns), F.struct("recorded_at", F.xxhash64(*batch.columns))).alias("r")).select("r.*")
        newest.withColumn("_batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/b{number:012d}")

    return write


def upserted(spark: SparkSession, path: str) -> DataFrame:
    """The newest row of each id of an upsert sink; of equal times the later batch's."""
    rows = spark.read.parquet(f"{path}/b*")
    kept = [c for c in rows.columns if c != "_batch"]
    return rows.groupBy("id").agg(F.max_by(F.struct(*kept), F.struct("recorded_at", "_batch")).alias("r")).select("r.*")


def compacted(spark: SparkSession, path: str) -> None:
    """Fold all batches of an upsert sink, while none is written, into the last one's folder.

    The fold stands complete beside the batches before these go, so a crash at
    any point leaves every row to be read.
    """
    rows = spark.read.parquet(f"{path}/b*")
    last = rows.agg(F.max("_batch")).first()[0]
    if last is None:
        return
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(conf)
    old = [x.getPath() for x in fs.listStatus(at) if x.getPath().getName().startswith("b")]
    upserted(spark, path).withColumn("_batch", F.lit(last).cast("long")).write.mode("overwrite").parquet(f"{path}/_next")
    fs.rename(jvm.org.apache.hadoop.fs.Path(f"{path}/_next"), jvm.org.apache.hadoop.fs.Path(f"{path}/b{last:012d}-folded"))
    for p in old:
        fs.delete(p, True)


def expiring(claims: DataFrame, ttl: str = "30 days", late: str = "0 seconds") -> DataFrame:
    """(id, recorded_at, event) in append mode: "seen" for each card's news, "expired" once event time is past its time to live.

    State is one timestamp a card, and a timer removes it.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    life = pd.Timedelta(ttl)

    def step(key, batches, state):
        if state.hasTimedOut:
            (at,) = state.get
            state.remove()
            yield pd.DataFrame({"id": [key[0]], "recorded_at": [pd.Timestamp(at, unit="us")], "event": ["expired"]})
            return
        newest = max(b["recorded_at"].max() for b in batches)
        if state.exists:
            newest = max(newest, pd.Timestamp(state.get[0], unit="us"))
        state.update((newest.value // 1000,))
        state.setTimeoutTimestamp(max(int((newest + life).value // 1_000_000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"id": [key[0]], "recorded_at": [newest], "event": ["seen"]})

    own = claims.withWatermark("recorded_at", late).select("id", "recorded_at")
    return own.groupBy("id").applyInPandasWithState(step, "id string, recorded_at timestamp, event string", "at long", "append", GroupStateTimeout.EventTimeTimeout)


def progress_stream(results: DataFrame) -> DataFrame:
    """Cards and errors of each chunk so far, of a stream of extractor results (chunk, error); run in update mode."""
    return results.groupBy("chunk").agg(F.count_if(F.col("error").isNull()).alias("cards"), F.count_if(F.col("error").isNotNull()).alias("errors"))


@contextmanager
def timed_state(spark: SparkSession):
    """Within it streams may be started whose state has timers and maps of its own, which takes the RocksDB state store."""
    key, rocks = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(key, None)
    spark.conf.set(key, rocks)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


#: Keys whose state is one value: a read and a write of it serve all that a batch has for them.
BUCKETS = 1 << 10


def _packed(df) -> bytes:
    import pyarrow as pa

    out = pa.BufferOutputStream()
    table = pa.Table.from_pandas(df, preserve_index=False)
    with pa.ipc.new_stream(out, table.schema) as w:
        w.write_table(table)
    return out.getvalue().to_pybytes()


def _unpacked(state):
    """The rows of a bucket's state, None if there are none."""
    import pyarrow as pa

    return pa.ipc.open_stream(bytes(state.get()[0])).read_all().to_pandas() if state.exists() else None


def _ticks(times, unit: str):
    """Whole units since 1970 of a column of times; missing ones are -2**62."""
    import numpy as np

    at = times.astype("datetime64[ns]")
    return np.where(at.isna(), -(2**62), at.to_numpy().astype(f"datetime64[{unit}]").astype("int64"))


def expirations(cards: DataFrame, late: str = "0 seconds", buckets: int = BUCKETS) -> DataFrame:
    """(id, expires_at) of a stream of cards (id, recorded_at, expires_at), each once event time has passed it; append mode, within timed_state.

    State is the latest time of a card.  News of a card replace it, news with no
    time to live take it away, and when it has passed the state goes too.  Cards
    of a bucket, by a hash of their ids, have one value and one timer, that of
    the first to end; the number of buckets is fixed for a checkpoint.
    """
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    class Expiry(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.until = handle.getValueState("until", "cards binary")

        def keep(self, held, timerValues):
            """Hold cards (id, seen, at), with a timer for the first to end."""
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            if len(held):
                self.until.update((_packed(held),))
                self.handle.registerTimer(max(int(held["at"].min()), timerValues.getCurrentWatermarkInMs() + 1))
            else:
                self.until.clear()

        def handleInputRows(self, key, rows, timerValues):
            news = pd.concat([pd.DataFrame({"id": b["id"], "seen": _ticks(b["recorded_at"], "us"), "at": _ticks(b["expires_at"], "ms")}) for b in rows], ignore_index=True)
            # of a batch the first of the newest; then the batch's unless what is held is newer
            news = news.sort_values("seen", ascending=False, kind="stable").drop_duplicates("id")
            news["seen"] //= 1000
            held = _unpacked(self.until)
            if held is not None:
                news = pd.concat([news, held], ignore_index=True).sort_values("seen", ascending=False, kind="stable").drop_duplicates("id")
            self.keep(news[news["at"] > -(2**62)], timerValues)
            yield from ()

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            held = _unpacked(self.until)
            gone = held["at"] <= timerValues.getCurrentWatermarkInMs()
            self.keep(held[~gone], timerValues)
            yield pd.DataFrame({"id": held["id"][gone], "expires_at": pd.to_datetime(held["at"][gone], unit="ms")})

        def close(self):
            pass

    own = cards.withWatermark("recorded_at", late).select(F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int").alias("_bucket"), "id", "recorded_at", "expires_at")
    return own.groupBy("_bucket").transformWithStateInPandas(statefulProcessor=Expiry(), outputStructType="id string, expires_at timestamp", outputMode="Append", timeMode="EventTime")


def truth_changes(cards: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(slot, version, current, members, needs_human) whenever cards of a slot change; update mode, within timed_state.

    cards: a stream of (id, num, slot, status, since, version): a card's state
    from a version on, the largest of which holds.  Slots of a bucket, by their
    hash, have one value as state, the cards of all of them; the number of
    buckets is fixed for a checkpoint.  A change that leaves a slot with fewer
    than two active or disputed cards says so by null members.
    """
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    class Truth(StatefulProcessor):
        def init(self, handle):
            self.cards = handle.getValueState("cards", "cards binary")

        def handleInputRows(self, key, rows, timerValues):
            read = lambda b: pd.DataFrame({
                "slot": b["slot"], "id": b["id"], "num": b["num"].astype("int64"), "since": _ticks(b["since"], "us"), "disputed": b["status"] == "disputed", "live": b["status"].isin(["active", "disputed"]), "version": b["version"].astype("int64")})
            news = pd.concat([read(b) for b in rows], ignore_index=True)
            held = _unpacked(self.cards)
            every = news if held is None else pd.concat([held, news], ignore_index=True)
            # of equal versions the later one
            every = every.sort_values("version", kind="stable").drop_duplicates(["slot", "id"], keep="last")
            self.cards.update((_packed(every),))
            # groups by a hash would leave out cards without a slot
            own = every[every["slot"].isin(news["slot"])]
            top = own.groupby("slot", dropna=False)["version"].max()
            live = own[own["live"]].sort_values(["since", "num", "id"], ascending=False).groupby("slot", dropna=False)
            some = pd.DataFrame({"n": live.size(), "current": live["id"].first(), "members": live["id"].agg(",".join), "needs_human": live["disputed"].any()})
            some = some[some["n"] > 1].drop(columns="n")
            out = top.to_frame("version").join(some).reset_index()
            yield out.astype(object).where(out.notna(), None)[["slot", "version", "current", "members", "needs_human"]]

        def close(self):
            pass

    own = cards.select(F.pmod(F.xxhash64("slot"), F.lit(buckets)).cast("int").alias("_bucket"), "id", "num", "slot", "status", "since", "version")
    return own.groupBy("_bucket").transformWithStateInPandas(statefulProcessor=Truth(), outputStructType="slot string, version long, current string, members string, needs_human boolean", outputMode="Update", timeMode="None")


def folded_changes(changes: DataFrame) -> DataFrame:
    """The truth table that changes add up to, (slot, current, members, needs_human)."""
    last = changes.groupBy("slot").agg(F.max_by(F.struct("current", "members", "needs_human"), F.struct("version", "_batch")).alias("r"))
    return last.select("slot", "r.*").where("members is not null")


def result_files(spark: SparkSession, path: str, chunk: str = r"([^/]+)\.result\.json$") -> DataFrame:
    """A stream of (chunk, text) of the result files below a folder, as they appear; `chunk` finds a file's chunk in its path."""
    files = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(path)
    return files.select(F.regexp_extract(F.url_decode("_metadata.file_path"), chunk, 1).alias("chunk"), F.col("value").alias("text")).where("chunk <> ''")


def task_progress(results: DataFrame, manifest: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep the state of each chunk of a manifest (chunk) under a path, from a stream of result files (chunk, text): missing, error or ok, and its cards.

    The counts of chunks with results are the stream's state; each batch joins
    the manifest to them, so chunks without results are seen.
    """
    from slotwise.operators.agent import extracted

    counts = progress_stream(extracted(results).select("chunk", "error"))

    def keep(batch: DataFrame, _: int) -> None:
        state = F.when(F.col("cards").isNull(), "missing").when(F.col("cards") == 0, "error").otherwise("ok")
        manifest.select("chunk").join(batch, "chunk", "left").select("chunk", state.alias("state"), F.coalesce("cards", F.lit(0)).alias("cards")).write.mode("overwrite").parquet(path)

    return counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
