"""Sources: documents, spreadsheets and JSON payloads; and sinks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain, groupby, islice
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MAX_BYTES = 200 << 20
# Leading bytes and the type that they mean.
MAGIC = (("25504446", "application/pdf"), ("89504E47", "image/png"), ("FFD8FF", "image/jpeg"), ("504B0304", "application/zip"), ("D0CF11E0", "application/msword"))
PAGE_PAYLOAD = "sheet_metadata struct<sheet_number:string,sheet_title:string,discipline:string>, schedules array<struct<name:string,columns:array<string>,rows:array<map<string,string>>>>, notes array<struct<text:string>>, cross_references array<struct<target_sheet:string,detail_id:string>>, entities array<struct<entity_type:string,value:string>>"
BID_PAYLOAD = "vendor_name string, bid_total_usd double, line_items array<struct<description:string,total_price_usd:double,page_number:int>>, inclusions array<struct<text:string>>, exclusions array<struct<text:string>>"


def magic_type(content: Column, declared: Column) -> Column:
    head = F.hex(F.substring(content, 1, 4))
    out = declared
    for prefix, kind in reversed(MAGIC):
        out = F.when(head.startswith(prefix), kind).otherwise(out)
    return out


def ingest_documents(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Size, digest, type by leading bytes and why a file is refused (null: taken). ``files``: id, content, declared."""
    size = F.octet_length("content").cast("long")
    why = F.when(F.coalesce(size, F.lit(0)) == 0, "empty").when(size > max_bytes, "too_large")
    return files.select("id", F.coalesce(size, F.lit(0)).alias("size"), F.sha2("content", 256).alias("sha256"), magic_type(F.col("content"), F.col("declared")).alias("mime"), why.alias("refused"))


def _lines_digest(lines: Iterator[str | None]) -> str:
    digest, empty = hashlib.sha256(), True
    for line in lines:
        if line is not None:
            digest.update(line.encode() + b"\n")
            empty = False
    if empty:
        digest.update(b"\n")
    return digest.hexdigest()


def input_fingerprint(documents: DataFrame) -> DataFrame:
    """Per project the digest of its own documents' sorted digests, each ended by a line feed; bids and null texts are left out.

    The digests of a project are sorted by Spark and pass its hash one after the other, so no project is ever held as one
    value. A project without any text has the digest of a line feed.
    """
    own = documents.where(F.col("source_kind") != "bid_submission").select("project_id", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    kind = own.schema["project_id"].dataType.simpleString()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        rows = ((key, h) for batch in chain([first], batches) for key, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        found = ((key, _lines_digest(h for _, h in own_rows)) for key, own_rows in groupby(rows, itemgetter(0)))
        while part := list(islice(found, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in part], first.column(0).type), pa.array([d for _, d in part], pa.string())], ["project_id", "fingerprint"])

    ordered = own.repartition("project_id").sortWithinPartitions("project_id", "h")
    return ordered.mapInArrow(apply, f"project_id {kind}, fingerprint string")


def load_taxonomy(rows: DataFrame) -> DataFrame:
    """Spreadsheet rows (row_idx, cell) → code, division, title, ord. ``N - Title`` opens a division, ``NN NN NN Title`` is a section.

    A section whose division has no row of its own gets a placeholder division.
    """
    division = F.regexp_extract("cell", r"^\s*(\d{1,2})\s*-\s*(.+)$", 1)
    section = F.regexp_extract("cell", r"^\s*(\d{2} \d{2} \d{2})\s*(.*)$", 1)
    parsed = rows.select("row_idx", division.alias("d"), section.alias("s"), F.trim(F.regexp_extract("cell", r"^\s*\d{1,2}\s*-\s*(.+)$", 1)).alias("dt"), F.trim(F.regexp_extract("cell", r"^\s*\d{2} \d{2} \d{2}\s*(.*)$", 1)).alias("st"))
    heads = parsed.where("d != ''").groupBy(F.lpad("d", 2, "0").alias("division")).agg(F.min_by("dt", "row_idx").alias("division_title"))
    sections = parsed.where("s != ''").groupBy(F.col("s").alias("code")).agg(F.min("row_idx").alias("ord"), F.min_by("st", "row_idx").alias("title")).withColumn("division", F.substring("code", 1, 2))
    return sections.join(heads, "division", "left").select("code", "division", "title", "ord", F.coalesce("division_title", F.concat(F.lit("Division "), "division")).alias("division_title"))


def profile_is_taxonomy(rows: DataFrame, first: int = 50, least: int = 5) -> DataFrame:
    """Documents (document_id, row_idx, cell) whose first rows hold enough codes are trade lists."""
    hits = rows.where(F.col("row_idx") <= first).groupBy("document_id").agg(F.count_if(F.col("cell").rlike(r"^\s*\d{2} \d{2} \d{2}\b")).alias("codes"))
    return hits.select("document_id", (F.col("codes") >= least).alias("is_trade_list"), F.when(F.col("codes") >= least, F.lit(0.99)).otherwise(F.lit(0.0)).alias("confidence"))


def parse_page_payload(payloads: DataFrame) -> dict[str, DataFrame]:
    """Page payloads (page_id, json) as tables of sheets, schedules, notes, cross-references and entities; bad JSON gives no rows."""
    parsed = payloads.select("page_id", F.from_json("json", PAGE_PAYLOAD, {"mode": "PERMISSIVE"}).alias("p"))
    each = lambda field, *cols: parsed.select("page_id", F.posexplode(f"p.{field}").alias("pos", "e")).select("page_id", "pos", *[F.col(f"e.{c}").alias(c) for c in cols])
    return {
        "sheets": parsed.where(F.col("p.sheet_metadata.sheet_number").isNotNull()).select("page_id", "p.sheet_metadata.*"),
        "schedules": each("schedules", "name", "columns", "rows"),
        "notes": each("notes", "text"),
        "cross_references": each("cross_references", "target_sheet", "detail_id"),
        "entities": each("entities", "entity_type", "value"),
    }


def clamp_box(x: Column, y: Column, width: Column, height: Column) -> Column:
    """A box within the unit square; null where nothing of it is left."""
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    left, top = clip(x), clip(y)
    w, h = F.least(clip(width), 1 - left), F.least(clip(height), 1 - top)
    return F.when((w > 0) & (h > 0), F.struct(left.alias("x"), top.alias("y"), w.alias("width"), h.alias("height")))


def parse_bid_payload(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bid payloads (bid_id, vendor, json) as lines and a summary; the vendor falls back to the document's."""
    parsed = payloads.select("bid_id", "vendor", F.from_json("json", BID_PAYLOAD, {"mode": "PERMISSIVE"}).alias("p"))
    lines = parsed.select("bid_id", F.posexplode("p.line_items").alias("pos", "l")).select("bid_id", "pos", "l.description", "l.total_price_usd", "l.page_number")
    count = lambda f: F.greatest(F.coalesce(F.size(f"p.{f}"), F.lit(0)), F.lit(0)).cast("long")
    summary = parsed.select("bid_id", F.coalesce("p.vendor_name", "vendor").alias("vendor"), "p.bid_total_usd", count("line_items").alias("lines"), count("inclusions").alias("inclusions"), count("exclusions").alias("exclusions"))
    return lines, summary


def parse_revision_payload(payloads: DataFrame) -> DataFrame:
    """Revision lists (sheet_id, json) in order; entries without a number are dropped before they are numbered."""
    parsed = payloads.select("sheet_id", F.from_json("json", "array<struct<rev_number:string,date:string>>").alias("r"))
    good = F.filter("r", lambda e: F.length(F.trim(e["rev_number"])) > 0)
    return parsed.select("sheet_id", F.posexplode(good).alias("pos", "e")).select("sheet_id", (F.col("pos") + 1).cast("long").alias("rev_order"), F.trim("e.rev_number").alias("rev_number"))


def replace_partitions(df: DataFrame, path: str, keys: list[str]) -> None:
    """Write rows, replacing just the partitions of ``keys`` that they have."""
    df.write.mode("overwrite").partitionBy(*keys).option("partitionOverwriteMode", "dynamic").parquet(path)


def copy_live_rows(tables: dict[str, tuple[DataFrame, list[tuple[str, str, str]]]]) -> dict[str, DataFrame]:
    """Copy tables in order, dropping rows whose parents are gone: name → (rows, [(column, parent, parent column)])."""
    out: dict[str, DataFrame] = {}
    for name, (df, parents) in tables.items():
        for column, parent, key in parents:
            df = df.join(out[parent].select(F.col(key).alias(column)).distinct(), column, "left_semi")
        out[name] = df
    return out


def export_supervised_jsonl(examples: DataFrame, path: str) -> DataFrame:
    """Write message pairs (project_id, prompt, answer) as JSON lines by project; returns total and written counts."""
    whole = F.col("prompt").isNotNull() & F.col("answer").isNotNull()
    lines = examples.where(whole).select("project_id", F.to_json(F.struct(F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content")), F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("content"))).alias("messages"))).alias("value"))
    lines.write.mode("overwrite").partitionBy("project_id").text(path)
    return examples.groupBy("project_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(whole).alias("written"))


def conversation_pairs(conversations: DataFrame) -> DataFrame:
    """Each user turn with the assistant turn that follows it."""
    w = W.partitionBy("conv_id").orderBy("turn")
    paired = conversations.withColumn("answer", F.lead("text").over(w)).withColumn("next", F.lead("role").over(w))
    return paired.where("role = 'user'").select((F.col("conv_id") % 4).alias("project_id"), "conv_id", "turn", F.col("text").alias("prompt"), F.when(F.col("next") == "assistant", F.col("answer")).alias("answer"))


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files of a folder as id, content and an unknown declared type."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select(F.col("path").alias("id"), "content", F.lit("application/octet-stream").alias("declared"))


def parse_sheet_index_payload(payloads: DataFrame) -> DataFrame:
    """Sheet lists (document_id, json): entries without an id are dropped; the discipline defaults by the sheet's prefix."""
    from scopeloom.operators.grounding import discipline_of_sheet

    parsed = payloads.select("document_id", F.posexplode(F.from_json("json", "array<struct<sheet_id:string,title:string,discipline:string>>")).alias("pos", "e"))
    sheet = F.trim("e.sheet_id")
    own = F.nullif(F.trim("e.discipline"), F.lit(""))
    return parsed.where(F.length(sheet) > 0).select("document_id", F.col("pos").cast("long").alias("pos"), sheet.alias("sheet_id"), F.trim("e.title").alias("title"), F.coalesce(own, discipline_of_sheet(sheet)).alias("discipline"))


def parse_legend_payload(payloads: DataFrame) -> DataFrame:
    """Legend lists (document_id, json): entries need a glyph and a meaning."""
    parsed = payloads.select("document_id", F.explode(F.from_json("json", "array<struct<glyph:string,meaning:string,code:string>>")).alias("e"))
    return parsed.where((F.length(F.trim("e.glyph")) > 0) & (F.length(F.trim("e.meaning")) > 0)).select("document_id", F.trim("e.glyph").alias("glyph"), F.trim("e.meaning").alias("meaning"), "e.code")


def parse_typed_schedule_payload(payloads: DataFrame) -> DataFrame:
    """Typed schedules (page_id, type, json of rows and a printed name) → name ``[typed:x] …``, columns, row count.

    Columns are the rows' keys in order of first appearance, without ``extra_fields``.
    """
    schema = "struct<schedule_name_as_printed:string,rows:array<map<string,string>>>"
    parsed = payloads.select("page_id", "type", F.from_json("json", schema).alias("p"))
    keys = F.array_distinct(F.flatten(F.transform("p.rows", lambda r: F.map_keys(r))))
    name = F.concat(F.lit("[typed:"), "type", F.lit("] "), F.coalesce("p.schedule_name_as_printed", F.lit("")))
    return parsed.select("page_id", F.trim(name).alias("name"), F.filter(F.coalesce(keys, F.array().cast("array<string>")), lambda k: k != "extra_fields").alias("columns"), F.greatest(F.coalesce(F.size("p.rows"), F.lit(0)), F.lit(0)).cast("long").alias("n_rows"))


def drawing_chunks(tables: dict[str, DataFrame]) -> DataFrame:
    """Chunks of five kinds from the tables of ``parse_page_payload``: page_id, chunk_type, pos, text."""
    shape = lambda df, kind, pos, text: df.select("page_id", F.lit(kind).alias("chunk_type"), pos.cast("long").alias("pos"), text.alias("text"))
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    zero = F.lit(0)
    parts = [
        shape(tables["sheets"], "page_summary", zero, F.concat(F.lit("Sheet "), "sheet_number", F.lit(": "), blank("sheet_title"))),
        shape(tables["schedules"], "schedule", F.col("pos"), F.concat(F.lit("Schedule "), blank("name"), F.lit(" ("), F.array_join("columns", ", "), F.lit(")"))),
        shape(tables["notes"].where(F.length("text") > 0), "note", F.col("pos"), F.concat(F.lit("Note: "), "text")),
        shape(tables["cross_references"], "cross_reference", F.col("pos"), F.concat(F.lit("See "), blank("detail_id"), F.lit("/"), blank("target_sheet"))),
        shape(tables["entities"], "entity", F.col("pos"), F.concat(blank("entity_type"), F.lit(": "), blank("value"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
