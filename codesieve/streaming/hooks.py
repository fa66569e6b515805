"""Edits as they come: decode events, keep the files of each session, scan them and hold them to a baseline.

Works on streams and on tables alike. State is the set of a session's files, dropped by watermark, or when the session
stops with a score that holds. Every batch replaces its own part of what a stream writes, so a batch that runs again
after a failure writes nothing twice; a stored baseline is a version in a folder of its own, and a pointer to it moved by
one rename, so that a reader sees the old one or the new one, whole.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from codesieve.plans import report, scan, score
from codesieve.sources.corpus import stored

# Where events name their files.
EVENT = "file_path string, edits array<struct<file_path:string>>, tool_input struct<file_path:string,path:string,edits:array<struct<file_path:string>>>"


def decode_events(events: DataFrame, payload: str = "payload") -> DataFrame:
    """Add ``files``: the distinct files that an event's JSON names, in order; a broken event names none."""
    j = F.from_json(payload, EVENT)
    none = F.array().cast("array<string>")
    edits = lambda x: F.coalesce(F.transform(x, lambda e: e["file_path"]), none)
    named = F.concat(F.array(j["file_path"]), edits(j["edits"]), F.array(j["tool_input"]["file_path"], j["tool_input"]["path"]), edits(j["tool_input"]["edits"]))
    return events.withColumn("files", F.array_distinct(F.filter(named, lambda x: x.isNotNull() & (x != ""))))


def session_files(events: DataFrame, session: str = "session", time: str = "ts", late: str = "1 day") -> DataFrame:
    """(session, ts, path): each file of a session once."""
    rows = events.select(session, time, F.explode("files").alias("path"))
    if events.isStreaming:
        return rows.withWatermark(time, late).dropDuplicatesWithinWatermark([session, "path"])
    return rows.groupBy(session, "path").agg(F.min(time).alias(time))


def edits_per_window(events: DataFrame, time: str = "ts", size: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """(window start, edits, files): how much was edited in each window of time."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, size).alias("w")).agg(F.count("*").alias("edits"), F.sum(F.size("files")).alias("files")).select(F.col("w.start").alias("start"), "edits", "files")


def scoped_feedback(files: DataFrame, edited: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """Feedback on edited files (project, path) only. Security stays off, as at every edit."""
    chosen = files.join(edited.distinct(), ["project", "path"], "left_semi")
    found = stored(scan.scan(chosen, ["code-quality", "ai-slop"]))
    scores = score.score(found, scan.file_counts(chosen), smoothing=score.SMOOTHING)
    return report.feedback(found, scores, baseline)


def stop_gate(feedback: DataFrame, active: DataFrame | None = None) -> DataFrame:
    """(project, reason) of sessions that must go on: the score fell below the baseline. Projects that were held back just before (``active``) pass."""
    held = feedback.where("regressed")
    if active is not None:
        held = held.join(active.select("project").distinct(), "project", "left_anti")
    text = F.concat(F.lit("Score dropped from "), "baseline", F.lit(" to "), "score", F.lit(". Fix the "), "total", F.when(F.col("total") == 1, " finding").otherwise(" findings"), F.lit(" before finishing."))
    return held.select("project", text.alias("reason"))


def capture_baseline(files: DataFrame) -> DataFrame:
    """(project, engine, score, files): scores of a full scan; engine ``all`` is the project's own."""
    found, counts = stored(scan.scan(files)), scan.file_counts(files)
    whole = score.score(found, counts, smoothing=score.SMOOTHING).select("project", F.lit("all").alias("engine"), "score")
    parts = score.score(found, counts, ("project", "engine"), smoothing=score.SMOOTHING).select("project", "engine", "score")
    return whole.unionByName(parts).join(counts, "project")


#: Versions of a baseline that stay, for readers that still hold an older one.
VERSIONS = 3


def _files(spark: SparkSession, place: str):
    """Hadoop's view of the file system of a place, whose renames replace their target in one step, and its paths."""
    jvm = spark._jvm
    path = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join((place, *parts)))
    return jvm.org.apache.hadoop.fs.FileContext.getFileContext(path().toUri(), spark._jsc.hadoopConfiguration()), path


def _pointer(spark: SparkSession, place: str) -> str | None:
    """The name of the version that counts; None if there is none yet."""
    context, path = _files(spark, place)
    if not context.util().exists(path("CURRENT")):
        return None
    stream = context.open(path("CURRENT"))
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_baseline(baseline: DataFrame, place: str, schema: str = "codesieve.baseline.v1") -> None:
    """Put a baseline in the place of an earlier one: a row for each project and engine, with its schema and time.

    The rows may be read from the same place. A writer that fails leaves the earlier baseline; of two at a time the
    one that moves the pointer last counts.
    """
    spark = baseline.sparkSession
    context, path = _files(spark, place)
    name = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    baseline.withColumn("schema", F.lit(schema)).withColumn("updated_at", F.current_timestamp()).write.parquet(f"{place}/versions/{name}")
    jvm, flags = spark._jvm, spark._jvm.org.apache.hadoop.fs.CreateFlag
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.CreateOpts, 0)
    stream = context.create(path(f"{name}.new"), jvm.java.util.EnumSet.of(flags.CREATE, flags.OVERWRITE), options)
    stream.write(bytearray(name.encode()))
    stream.close()
    replacing = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    replacing[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(path(f"{name}.new"), path("CURRENT"), replacing)
    found = sorted(x.getPath().getName() for x in context.util().listStatus(path("versions")))
    for old in found[:-VERSIONS]:
        if old != _pointer(spark, place):
            context.delete(path("versions", old), True)


def read_baseline(spark: SparkSession, place: str, schema: str = "codesieve.baseline.v1") -> DataFrame:
    """(project, engine, score, files) of a stored baseline; none of another schema counts, and a place without one has no rows."""
    name = _pointer(spark, place)
    if name is None:
        return spark.createDataFrame([], "project string, engine string, score bigint, files bigint")
    return spark.read.parquet(f"{place}/versions/{name}").where(F.col("schema") == schema).select("project", "engine", "score", "files")


def read_sessions(spark: SparkSession, place: str) -> DataFrame:
    """(session, ts, path) of session logs: a JSON object with session, ts and files in each line. Broken lines are left out, a path counts once for each session."""
    rows = spark.read.schema("session string, ts long, files array<string>, _broken string").option("columnNameOfCorruptRecord", "_broken").json(place)
    rows = rows.where("_broken IS NULL AND files IS NOT NULL").select(F.coalesce("session", F.lit("")).alias("session"), "ts", F.explode("files").alias("path"))
    return rows.groupBy("session", "path").agg(F.min("ts").alias("ts")).select("session", "ts", "path")


def _replaced(rows: DataFrame, out: str, number: int) -> None:
    """Write a batch's rows in the place of what an earlier run of the same batch has written."""
    rows.write.mode("overwrite").parquet(f"{out}/batch={number}")


def run_hook(events: DataFrame, files: DataFrame, baseline: DataFrame | None, out: str, checkpoint: str, project: str = "project") -> StreamingQuery:
    """Feedback on every micro-batch of decoded events, in a Parquet table with the batch's number as a partition."""

    def each(batch: DataFrame, number: int) -> None:
        edited = batch.select(F.col(project).alias("project"), F.explode("files").alias("path"))
        _replaced(scoped_feedback(files, edited, baseline), out, number)

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


GATE = "session string, ts timestamp, kind string, active boolean, files array<string>"


def gate_events(events: DataFrame, payload: str = "payload") -> DataFrame:
    """(session, ts, kind, active, files) of events: what was edited, and stops with whether they follow a stop that was held back."""
    j = F.from_json(payload, "hook_event_name string, stop_hook_active boolean")
    return decode_events(events, payload).select("session", "ts", F.when(j["hook_event_name"] == "Stop", "stop").otherwise("edit").alias("kind"), F.coalesce(j["stop_hook_active"], F.lit(False)).alias("active"), "files")


def _session(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A session's step: its state is each file's first and last edit since the session was cleared; a stop asks for the files edited by then."""
    if state.hasTimedOut:
        state.remove()
        return
    held: dict[str, list[int]] = {p: [a, b] for p, a, b in zip(*state.get, strict=True)} if state.exists else {}
    stops, clears = set(), set()
    for batch in rows:
        for ts, kind, active, files in zip(batch["ts"].astype("datetime64[us]").astype("int64"), batch["kind"], batch["active"], batch["files"], strict=True):
            if kind == "edit":
                for path in files if files is not None else ():
                    first, last = held.get(path, (ts, ts))
                    held[path] = [min(first, ts), max(last, ts)]
            elif kind == "clear":
                clears.add(ts)
            elif not active:
                stops.add(ts)
    for until in sorted(clears):
        held = {p: [a if a > until else b, b] for p, (a, b) in held.items() if b > until}
    asked = [(key[0], pd.Timestamp(ts, unit="us"), p) for ts in sorted(stops) for p, (a, _) in sorted(held.items()) if a <= ts]
    if held:
        state.update(([*held], [a for a, _ in held.values()], [b for _, b in held.values()]))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, max(b for _, b in held.values()) // 1000 + _IDLE_MS))
    elif state.exists:
        state.remove()
    yield pd.DataFrame(asked, columns=["session", "ts", "path"])


#: A session without edits for so long is forgotten.
_IDLE_MS = 24 * 3600 * 1000


def stops_of(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(session, ts, path): for each stop in a stream of ``gate_events``, the files that its session edited since it was cleared."""
    rows = events.select("session", "ts", "kind", "active", "files").withWatermark("ts", late)
    return rows.groupBy("session").applyInPandasWithState(_session, "session string, ts timestamp, path string", "paths array<string>, first array<bigint>, last array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)


def run_stop_gate(events: DataFrame, files: DataFrame, baseline: DataFrame, out: str, cleared: str, checkpoint: str) -> StreamingQuery:
    """Hold back the stops in a stream of ``gate_events`` whose sessions' files score below the baseline.

    ``out`` gets (session, ts, reason) of what is held back. Sessions whose score holds are cleared: ``cleared`` gets an
    event for each, which the stream reads back as one of its sources, so the state of a session forgets the files
    edited up to that stop. A session is a project of ``files`` and ``baseline``; one without a baseline passes.
    """
    spark = events.sparkSession
    context, path = _files(spark, cleared)
    context.mkdir(path(), spark._jvm.org.apache.hadoop.fs.permission.FsPermission.getDirDefault(), True)
    back = spark.readStream.schema(GATE).option("recursiveFileLookup", "true").parquet(cleared)

    def each(batch: DataFrame, number: int) -> None:
        asked = stored(batch)
        stops = asked.groupBy("session").agg(F.max("ts").alias("ts"))
        feedback = stored(scoped_feedback(files, asked.select(F.col("session").alias("project"), "path"), baseline))
        held = stop_gate(feedback).withColumnRenamed("project", "session")
        _replaced(stops.join(held, "session"), out, number)
        fine = feedback.where("baseline IS NOT NULL AND NOT regressed").select(F.col("project").alias("session"))
        clear = stops.join(fine, "session").select("session", "ts", F.lit("clear").alias("kind"), F.lit(False).alias("active"), F.array().cast("array<string>").alias("files"))
        _replaced(clear, cleared, number)

    return stops_of(events.unionByName(back)).writeStream.foreachBatch(each).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_sessions(events: DataFrame, out: str, checkpoint: str, session: str = "session", time: str = "ts") -> StreamingQuery:
    """Append each session's new files to a Parquet table, once each, until the source is read."""
    rows = session_files(events, session, time)
    return rows.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
