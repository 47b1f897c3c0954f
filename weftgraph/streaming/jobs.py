"""Event streams of jobs: everything up to the first terminal event, progress, frames."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.runtime import own_table

TERMINAL = ("error", "purchase")
SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def until_terminal(events: DataFrame, job: str, order: list[str], kind: str, terminal: tuple[str, ...] = TERMINAL) -> DataFrame:
    """Events of each job up to its first terminal one, that included; jobs without one keep all.

    The first terminal event is a minimum, so it is pre-aggregated and joined back: no job is sorted in one task. Events of
    null jobs are dropped.
    """
    first = events.where(F.col(kind).isin(*terminal) & F.col(job).isNotNull()).groupBy(job).agg(F.min(F.struct(*order)).alias("__end"))
    j = events.where(F.col(job).isNotNull()).join(first, job, "left")
    return j.where(F.col("__end").isNull() | (F.struct(*order) <= F.col("__end"))).drop("__end")


def progress(events: DataFrame, job: str, ts: str, tie: str) -> DataFrame:
    """Events numbered within their job in time order (``processed`` from 1).

    Numbers are counted per day first, so a job with very many events is spread over its days.
    """
    day = events.where(F.col(job).isNotNull()).withColumn("__day", F.to_date(ts))
    counts = day.groupBy(job, "__day").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(job).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    own = F.row_number().over(Window.partitionBy(job, "__day").orderBy(ts, tie))
    ranked = day.withColumn("__i", own)
    cond = [ranked[job] == counts[job], ranked["__day"].eqNullSafe(counts["__day"])]
    return ranked.join(counts, cond).select(*[ranked[c] for c in events.columns], (F.col("__before") + F.col("__i")).alias("processed"))


def stream_until_terminal(spark: SparkSession, folder: str, terminal: tuple[str, ...] = TERMINAL) -> DataFrame:
    """The same as ``until_terminal`` as a stream with state: a job that has ended emits nothing more.

    Within a micro-batch a job's events are put in order; across batches they must arrive in order. The available data are
    read to the end and the rows written to a table in the shared folder.
    """
    source = spark.readStream.schema(SCHEMA).option("pathGlobFilter", "*.parquet")
    path = f"{folder}/events.parquet"
    single = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(spark._jvm.org.apache.hadoop.fs.Path(path)).isFile()
    events = (source.option("pathGlobFilter", "events.parquet").parquet(folder) if single else source.parquet(path)).where("user_id is not null")

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.exists and state.get[0]:
            return
        pdf = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        ends = pdf["event_type"].isin(terminal).to_numpy().nonzero()[0]
        if len(ends):
            pdf = pdf.iloc[: ends[0] + 1]
        state.update((bool(len(ends)),))
        yield pdf[["event_id", "user_id", "event_type"]]

    out = events.groupBy("user_id").applyInPandasWithState(run, "event_id bigint, user_id bigint, event_type string", "ended boolean", "append", "NoTimeout")
    at = own_table(spark, "stream")
    q = out.writeStream.format("parquet").outputMode("append").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("event_id bigint, user_id bigint, event_type string").parquet(f"{at}/rows")


def frames(df: DataFrame, *columns: str) -> DataFrame:
    """``frame``: each row as a server-sent event, ``data: {json}`` and a blank line."""
    return df.select(F.concat(F.lit("data: "), F.to_json(F.struct(*columns)), F.lit("\n\n")).alias("frame"))


def read_frames(df: DataFrame, frame: str, schema: str) -> DataFrame:
    """Rows of well-formed frames; malformed ones are skipped."""
    body = F.regexp_extract(frame, r"(?s)^data: (.*?)\s*$", 1)
    ok = df.where(F.try_parse_json(body).isNotNull() & body.startswith("{"))
    return ok.select(F.from_json(body, schema).alias("r")).select("r.*")
