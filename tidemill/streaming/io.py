"""Streams in and out: growing logs and url lists, the progress display, log files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..functions import text, urls
from ..functions.status import correlation_id
from ..operators.progress import progress_texts
from .state import latest, numbered

#: A file's name ends in the number of the piece that it is of its source.
PIECE = r"\.(\d+)$"


def log_pieces(spark: SparkSession, path: str, files_at_once: int | None = None) -> DataFrame:
    """A stream of source, piece, place and line of log files that come in pieces, `a.log.0`, `a.log.1` and so on.

    A piece appears whole and is read whole, so it should have some MB at most; a name without a number is the first
    piece of its source. Pieces of a source must appear in order, several may come at once. Lines end as for log_lines.
    """
    reader = spark.readStream.option("wholetext", "true")
    if files_at_once:
        reader = reader.option("maxFilesPerTrigger", files_at_once)
    file = F.col("_metadata.file_path")
    number = F.coalesce(F.regexp_extract(file, PIECE, 1).try_cast("long"), F.lit(-1).cast("long"))
    lines = F.split(F.regexp_replace("value", r"(\r\n|[\r\n])\z", ""), r"\r\n|[\r\n]", -1)
    return reader.text(path).where("value <> ''").select(F.regexp_replace(file, PIECE, "").alias("source"), number.alias("piece"), F.posexplode(lines).alias("place", "line"))


def log_lines(spark: SparkSession, path: str, files_at_once: int | None = None) -> DataFrame:
    """A stream of source, line_no and line; numbers go on over a source's pieces and over restarts."""
    return numbered(log_pieces(spark, path, files_at_once))


def url_list(lines: DataFrame) -> DataFrame:
    """source, pos, line and valid of the entries of a stream of url lists, as sources.files.url_list gives them."""
    rows = lines.select("source", F.col("line_no").alias("pos"), text.strip(F.col("line")).alias("line"))
    return rows.where(text.is_entry(F.col("line"))).withColumn("valid", urls.has_video_id(F.col("line")))


def _done(spark: SparkSession, ledger: str, batch: int) -> bool:
    try:
        return not spark.read.schema("batch long").parquet(ledger).where(F.col("batch") == batch).isEmpty()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise


def once(each: Callable[[DataFrame, int], None], ledger: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: calls `each` unless the ledger, a folder on shared storage, has the batch already.

    A batch that is replayed after a restart is passed over. If a run dies between the call and the ledger's entry, the
    call comes a second time.
    """

    def run(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        if not _done(spark, ledger, batch):
            each(rows, batch)
            spark.createDataFrame([(batch,)], "batch long").coalesce(1).write.mode("append").parquet(ledger)

    return run


def display(updates: DataFrame, show: Callable[[str], None], checkpoint: str, batch_size: int = 60, interval: str = "1 second") -> StreamingQuery:
    """Shows the progress line of each batch of videos, anew at each interval with updates.

    updates: a stream of url_index, downloaded, total, ts and seq.
    """

    def render(rows: DataFrame, _: int) -> None:
        for r in progress_texts(rows, batch_size).orderBy("batch").toLocalIterator():
            show(r.progress)

    out = latest(updates).writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
    return out.trigger(processingTime=interval).foreachBatch(once(render, f"{checkpoint}/shown")).start()


def call_back(updates: DataFrame, callback: Callable[[str, int, int], None], checkpoint: str, interval: str = "1 second") -> StreamingQuery:
    """Calls back with video_id, downloaded and total for each video's last update of an interval."""

    def call(rows: DataFrame, _: int) -> None:
        last = rows.groupBy("video_id").agg(F.max_by(F.struct("downloaded", "total"), F.struct("ts", "seq")).alias("s"))
        for r in last.select("video_id", "s.*").orderBy("video_id").toLocalIterator():
            callback(r.video_id, r.downloaded, r.total)

    return updates.writeStream.option("checkpointLocation", checkpoint).trigger(processingTime=interval).foreachBatch(once(call, f"{checkpoint}/called")).start()


class Listener(StreamingQueryListener):
    """Tells of each micro-batch of the streams of a session: name, batch, rows and rows a second."""

    def __init__(self, tell: Callable[[Row], None]):
        self.tell = tell

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        p = event.progress
        self.tell(Row(name=p.name, batch=p.batchId, rows=p.numInputRows, rate=p.processedRowsPerSecond))

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        pass


def bound(rows: DataFrame, context: dict[str, Column], level: str = "info") -> DataFrame:
    """rows as log records: level, timestamp, correlation_id and the context's columns beside their own."""
    return rows.withColumns({"level": F.lit(level), "timestamp": F.current_timestamp(), "correlation_id": correlation_id(), **context})


def write_log(records: DataFrame, path: str, checkpoint: str, day: str = "timestamp") -> StreamingQuery:
    """Appends a stream of records to JSON files by day, each record once, also over restarts; ends when all is written."""
    by_day = records.withColumn("day", F.to_date(day))
    return by_day.writeStream.format("json").partitionBy("day").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
