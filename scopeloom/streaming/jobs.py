"""Structured Streaming jobs: a live index and a live activity feed.

The live index is a log of segments. A batch of page rows writes the chunks and postings of its documents, and last the
list of these documents, as folders of its own number: it costs what the batch holds, and a batch that is repeated after
a failure writes the same folders again. The newest batch that lists a document holds its live rows; all earlier
ones are dead. Compaction writes the live rows to a new generation, which readers and the next batch take up once its
list of documents is there.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scopeloom.operators.retrieval import term_counts, tokenize
from scopeloom.operators.text import contextualize, section_carry_forward, window_text

PAGES = "project_id bigint, document_id bigint, filename string, version bigint, page_number bigint, text string"
#: Tables of a segment; the list of documents comes last and makes the segment count.
CHUNKS, POSTINGS, DOCUMENTS = "chunks", "postings", "documents"
SCHEMAS = {
    CHUNKS: "project_id bigint, document_id bigint, page_number bigint, chunk_index int, chunk_id string, csi_section string, contextualized_text string, length int, batch bigint",
    POSTINGS: "project_id bigint, document_id bigint, chunk_id string, term string, tf bigint, batch bigint",
    DOCUMENTS: "document_id bigint, batch bigint",
}


def newest_pages(pages: DataFrame) -> DataFrame:
    """Pages of the highest version of each document; of rows that repeat a page the last in text order, so repeats agree."""
    top = pages.groupBy("document_id").agg(F.max(F.coalesce("version", F.lit(0))).alias("top"))
    kept = pages.join(top, "document_id").where(F.coalesce("version", F.lit(0)) == F.col("top"))
    row = F.struct(F.coalesce("text", F.lit("")).alias("text"), "project_id", "filename")
    return kept.groupBy("document_id", "page_number").agg(F.max(row).alias("r")).select("document_id", "page_number", "r.*")


def index_tables(pages: DataFrame) -> dict[str, DataFrame]:
    """Chunks with section and context, their postings, and the documents, of whole documents; the batch build."""
    own = newest_pages(pages)
    none = own.sparkSession.createDataFrame([], "document_id bigint, page bigint, ord bigint, sheet_id string, title string, discipline string")
    cut = window_text(section_carry_forward(own)).withColumn("text", F.col("chunk")).drop("chunk", "chunk_total", "filename")
    id_ = F.concat_ws("-", F.col("document_id").cast("string"), F.col("page_number").cast("string"), F.col("chunk_index").cast("string"))
    kind = F.when(F.col("csi_section").isNotNull(), "spec_section").otherwise("note")
    named = contextualize(cut.withColumns({"chunk_id": id_, "chunk_type": kind}), own.select("document_id", "filename").distinct(), none)
    tokens = named.withColumn("tokens", tokenize(F.col("contextualized_text")))
    chunks = tokens.select("project_id", "document_id", "page_number", "chunk_index", "chunk_id", "csi_section", "contextualized_text", F.size("tokens").alias("length"))
    postings = tokens.select("project_id", "document_id", "chunk_id", F.inline(term_counts(F.col("tokens"))))
    return {CHUNKS: chunks, POSTINGS: postings, DOCUMENTS: own.select("document_id").distinct()}


def _written(spark: SparkSession, path: str) -> bool:
    """Whether a table has been written there, also an empty one."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def generation(spark: SparkSession, index: str) -> int:
    """The newest complete generation; 0 before any compaction."""
    k = 0
    while _written(spark, f"{index}/v{k + 1}/{DOCUMENTS}/batch=0"):
        k += 1
    return k


def write_segment(tables: dict[str, DataFrame], index: str, gen: int, batch_id: int) -> None:
    for name in (CHUNKS, POSTINGS, DOCUMENTS):
        tables[name].write.mode("overwrite").parquet(f"{index}/v{gen}/{name}/batch={batch_id}")


def _table(spark: SparkSession, index: str, gen: int, name: str) -> DataFrame:
    try:
        return spark.read.schema(SCHEMAS[name]).option("basePath", f"{index}/v{gen}/{name}").parquet(f"{index}/v{gen}/{name}/batch=*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMAS[name])


def live(spark: SparkSession, index: str, name: str = POSTINGS) -> DataFrame:
    """Rows of the newest segment of each document; an index without segments has none."""
    gen = generation(spark, index)
    newest = _table(spark, index, gen, DOCUMENTS).groupBy("document_id").agg(F.max("batch").alias("batch"))
    return _table(spark, index, gen, name).join(newest, ["document_id", "batch"]).drop("batch")


def compact(spark: SparkSession, index: str) -> int:
    """Write the live rows as segment 0 of a new generation, between two runs of the stream; returns its number.

    Later batches are numbered from 1 and win over it. The files of the older generation may be removed afterwards.
    """
    gen = generation(spark, index)
    write_segment({name: live(spark, index, name) for name in (CHUNKS, POSTINGS, DOCUMENTS)}, index, gen + 1, 0)
    return gen + 1


def stream_index(spark: SparkSession, source: str, index: str, checkpoint: str, schema: str = PAGES) -> StreamingQuery:
    """Index new files of page rows: each batch replaces the documents that it holds and leaves all others alone."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        session, batch = batch.sparkSession, batch.persist()
        try:
            write_segment(index_tables(batch), index, generation(session, index), batch_id + 1)
        finally:
            batch.unpersist()

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity_windows(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events (ts, project_id, status, cost) by tumbling window and project; later ones than ``late`` are dropped in a stream."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width).alias("w"), "project_id").agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("status") == "error").alias("errors"), F.round(F.sum("cost"), 6).alias("cost")).select(F.col("w.start").alias("start"), "project_id", "events", "errors", "cost")


def stream_activity(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append each window's figures once the watermark has passed it."""
    return activity_windows(events).writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
