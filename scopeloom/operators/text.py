"""Page text, chunks and sections."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SECTION = r"SECTION (\d{2}) (\d{2}) (\d{2})"


def pages_needing_text(pages: DataFrame) -> DataFrame:
    """Pages whose text is null or empty, the work list of text recovery."""
    return pages.where(F.col("text").isNull() | (F.length("text") == 0)).select("document_id", "page_number")


def fuse_ocr(candidates: DataFrame, flag_at: float = 0.20) -> DataFrame:
    """Per page the longest non-blank text (else the longest); disagreement with the other provider.

    ``candidates``: page_id, provider, text. Ties take the first provider in order. The disagreement is the
    edit distance over the longer length, rounded to four places; null with one provider only.
    """
    size = F.length(F.coalesce("text", F.lit("")))
    blank = (F.length(F.trim(F.coalesce("text", F.lit("")))) == 0).cast("int")
    best = W.partitionBy("page_id").orderBy(blank, F.desc(size), "provider")
    ranked = candidates.withColumn("rank", F.row_number().over(best))
    pair = ranked.groupBy("page_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("provider"))).alias("provider"),
        F.max(F.when(F.col("rank") == 1, F.coalesce("text", F.lit("")))).alias("text"),
        F.max(F.when(F.col("rank") == 2, F.coalesce("text", F.lit("")))).alias("other"),
    )
    longer = F.greatest(F.length("text"), F.length("other"))
    gap = F.when(F.col("other").isNotNull(), F.when(longer == 0, F.lit(0.0)).otherwise(F.round(F.col("edits") / longer, 4)))
    return with_edit_distance(pair, "text", "other", "edits").select("page_id", "provider", "text", gap.alias("disagreement"), F.coalesce(gap >= flag_at, F.lit(False)).alias("flagged"))


def _common_prefix(a: Column, b: Column, steps: int = 28) -> Column:
    """Length of the common prefix of two texts, found bit by bit."""
    powers = F.array(*[F.lit(1 << k) for k in range(steps, -1, -1)])
    found = F.aggregate(powers, F.lit(0), lambda at, n: at + F.when(F.substring(a, at + 1, n) == F.substring(b, at + 1, n), n).otherwise(0))
    return F.least(found, F.length(a), F.length(b))


#: Bands that the engine's own alignment tries, and from which length of both texts on that is less work than aligning them whole.
BANDS = ((64, 4096), (1024, 65536))


def bit_distance(a: str, b: str) -> int:
    """Levenshtein distance with one bit per character of the shorter text: rows of the alignment table as two integers.

    Memory is a few integers of that many bits and one for each distinct character, time the product of the lengths over 64.
    """
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    held: dict[str, int] = {}
    for i, c in enumerate(b):
        held.setdefault(c, []).append(i)
    masks = {}
    for c, at in held.items():
        bits = bytearray(len(b) // 8 + 1)
        for i in at:
            bits[i >> 3] |= 1 << (i & 7)
        masks[c] = int.from_bytes(bits, "little")
    every, same_as = (1 << len(b)) - 1, masks.get
    up, down = every, 0
    for c in a:
        same = same_as(c, 0)
        flat = (((same & up) + up) ^ up | same | down) & every
        plus = (down | (every ^ (flat | up))) << 1 | 1
        up, down = ((up & flat) << 1 | (every ^ ((flat | plus) & every))) & every, plus & flat
    # the last column of the table, from its top down
    return len(a) + up.bit_count() - down.bit_count()


def _whole_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else bit_distance(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


def with_edit_distance(pairs: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Adds the Levenshtein distance of two columns, null where one is.

    What both begin and end with is taken off, which changes nothing. What is left of long texts is aligned in a band of 64, then
    of 1,024 edits, whose memory and time follow the band; shorter ones and pairs farther apart are aligned whole, bit-parallel.
    """
    front = _common_prefix(F.col(a), F.col(b))
    rest = pairs.withColumns({"_a": F.substring(F.col(a), front + 1, F.length(a)), "_b": F.substring(F.col(b), front + 1, F.length(b))})
    back = _common_prefix(F.reverse("_a"), F.reverse("_b"))
    cut = lambda c: F.substring(F.col(c), F.lit(1), F.length(c) - F.col("_n"))
    inner = rest.withColumn("_n", back).withColumns({"_a": cut("_a"), "_b": cut("_b")})
    inner = inner.withColumn("_d", F.lit(None).cast("int"))
    for band, least in BANDS:
        long = F.col("_d").isNull() & (F.least(F.length("_a"), F.length("_b")) >= least)
        # a column of its own, so that no pair is aligned twice
        inner = inner.withColumn("_e", F.when(long, F.levenshtein("_a", "_b", band))).withColumn("_d", F.coalesce("_d", F.when(F.col("_e") >= 0, F.col("_e")))).drop("_e")
    far = lambda c: F.when(F.col("_d").isNull(), F.col(c))
    return inner.withColumn(name, F.coalesce("_d", F.pandas_udf(_whole_distance, "int")(far("_a"), far("_b")))).drop("_a", "_b", "_n", "_d")


def window_text(pages: DataFrame, size: int = 6000, overlap: int = 400) -> DataFrame:
    """Trimmed page text as one chunk of at most ``size`` characters, or as overlapping windows.

    Adds chunk_index (from 0), chunk_total and chunk. Pages without text give no chunk.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than size")
    step = size - overlap
    text = F.trim("text")
    total = F.when(F.length(text) <= size, F.lit(1)).otherwise(F.ceil((F.length(text) - size) / step) + 1).cast("int")
    held = pages.where(F.length(F.trim("text")) > 0).withColumn("chunk_total", total)
    exploded = held.withColumn("chunk_index", F.explode(F.sequence(F.lit(0), F.col("chunk_total") - 1)))
    return exploded.withColumn("chunk", F.substring(text, F.col("chunk_index") * step + 1, F.lit(size)))


def blank_page_chunks(pages: DataFrame) -> DataFrame:
    """One placeholder chunk for each page without text."""
    blank = F.coalesce(F.length(F.trim("text")), F.lit(0)) == 0
    return pages.where(blank).select("document_id", "page_number", F.lit("page_summary").alias("chunk_type"), F.concat(F.lit("Page "), F.col("page_number").cast("string"), F.lit(" (no text)")).alias("chunk"))


def last_section(text: Column) -> Column:
    """The last ``SECTION NN NN NN`` of a text as ``NN NN NN``, else null."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(r"SECTION (\d{2} \d{2} \d{2})"), F.lit(1)), F.lit(-1))


def section_carry_forward(pages: DataFrame) -> DataFrame:
    """Tag each page with the last section heading on it or before it in its document."""
    order = W.partitionBy("document_id").orderBy("page_number").rowsBetween(W.unboundedPreceding, 0)
    return pages.withColumn("csi_section", F.last(last_section(F.col("text")), ignorenulls=True).over(order))


def detect_sections(pages: DataFrame) -> DataFrame:
    """All section headings by document: code, how often, the first non-empty title in page order."""
    heads = F.regexp_extract_all("text", F.lit(r"SECTION (\d{2} \d{2} \d{2})[ \t]*[-:]?[ \t]*([^\n]*)"), F.lit(0))
    rows = pages.select("document_id", "page_number", F.posexplode(heads).alias("pos", "head"))
    code = F.regexp_extract("head", SECTION.replace("(", "").replace(")", ""), 0)
    title = F.nullif(F.trim(F.regexp_replace("head", r"^SECTION \d{2} \d{2} \d{2}[ \t]*[-:]?[ \t]*", "")), F.lit(""))
    rows = rows.select("document_id", F.substring(code, 9, 8).alias("code"), title.alias("title"), F.struct("page_number", "pos").alias("place"))
    return rows.groupBy("document_id", "code").agg(F.count(F.lit(1)).alias("hits"), F.min_by("title", F.when(F.col("title").isNotNull(), F.col("place"))).alias("title"))


def reconcile_sections(detected: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Adds status: confirmed where the taxonomy has the code, else rejected; uncertain without a taxonomy."""
    known = taxonomy.select("code").distinct().withColumn("known", F.lit(True))
    size = taxonomy.agg(F.count(F.lit(1)).alias("size"))
    joined = detected.join(known, "code", "left").crossJoin(F.broadcast(size))
    status = F.when(F.col("size") == 0, F.lit("uncertain")).when(F.col("known"), F.lit("confirmed")).otherwise(F.lit("rejected"))
    return joined.withColumn("status", status).drop("known", "size")


def section_page_ranges(pages: DataFrame) -> DataFrame:
    """First and last page of each section: it ends before the next one starts, the last with the document."""
    starts = pages.withColumn("code", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"SECTION (\d{2} \d{2} \d{2})"), F.lit(1)))))
    first = starts.groupBy("document_id", "code").agg(F.min("page_number").alias("first_page"))
    ends = pages.groupBy("document_id").agg(F.max("page_number").alias("pages"))
    order = W.partitionBy("document_id").orderBy("first_page", "code")
    following = F.lead("first_page").over(order)
    ranged = first.withColumn("next", following).join(ends, "document_id")
    return ranged.select("document_id", "code", "first_page", F.greatest("first_page", F.coalesce(F.col("next") - 1, "pages")).alias("last_page"))


def observed_sections(tagged: DataFrame, taxonomy: DataFrame, active: DataFrame) -> DataFrame:
    """Distinct tagged codes in the active divisions, with the taxonomy's title or ``Section <code>``."""
    codes = tagged.where(F.col("csi_section").isNotNull()).select(F.col("csi_section").alias("code")).distinct()
    codes = codes.withColumn("division", F.substring("code", 1, 2)).join(active.select("division").distinct(), "division", "left_semi")
    return codes.join(taxonomy.select("code", "title"), "code", "left").select("code", "division", F.coalesce("title", F.concat(F.lit("Section "), "code")).alias("title"))


def contextualize(chunks: DataFrame, documents: DataFrame, sheets: DataFrame) -> DataFrame:
    """Adds the sheet's sheet_id, sheet_title and discipline, and contextualized_text: a header, a line feed and the text.

    ``sheets`` (document_id, page, ord, sheet_id, title, discipline) may name a page more than once; the first by ord counts.
    The header names file, page, sheet, its title where that is another, the discipline, and the chunk type unless it is page_summary.
    """
    first = sheets.groupBy("document_id", F.col("page").alias("page_number")).agg(F.min_by(F.struct(F.nullif("sheet_id", F.lit("")).alias("sheet_id"), F.nullif("title", F.lit("")).alias("sheet_title"), "discipline"), "ord").alias("sheet"))
    named = chunks.join(documents.select("document_id", "filename"), "document_id").join(first, ["document_id", "page_number"], "left").select(*[chunks[c] for c in chunks.columns], "filename", "sheet.*")
    said = lambda before, c, after="": F.concat(F.lit(before), F.col(c).cast("string"), F.lit(after))
    title = F.when(F.col("sheet_id").isNull() | (F.col("sheet_title") != F.col("sheet_id")), said("(", "sheet_title", ")"))
    kind = F.when(F.col("chunk_type") != "page_summary", said("-> ", "chunk_type"))
    header = F.concat_ws(" ", said("Document: ", "filename"), said("page ", "page_number"), said("sheet ", "sheet_id"), title, said("[", "discipline", "]"), kind)
    return named.withColumn("contextualized_text", F.concat(header, F.lit("\n"), F.coalesce("text", F.lit("")))).drop("filename")


def assemble_doc_text(pages: DataFrame, cap: int = 60_000) -> DataFrame:
    """One text per document: its pages in order with page markers, cut at ``cap`` characters with a note.

    Only pages that begin below the cap travel to the document's group, so a group is bounded by it.
    """
    piece = F.concat(F.lit("[page "), F.col("page_number").cast("string"), F.lit("]\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    pieces = pages.select("document_id", "page_number", piece.alias("piece"))
    order = W.partitionBy("document_id").orderBy("page_number")
    placed = pieces.withColumn("before", F.sum(F.length("piece")).over(order) - F.length("piece")).where(F.col("before") <= cap)
    whole = placed.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "piece"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda x: x["piece"]), "")
    cut = F.concat(F.substring(text, 1, cap), F.lit("\n[truncated]"))
    return whole.select("document_id", F.when(F.length(text) > cap, cut).otherwise(text).alias("text"), (F.length(text) > cap).alias("truncated"))


def truncate_to_width(df: DataFrame, caps: dict[str, int]) -> DataFrame:
    """Cut each named field to its width, the last character being an ellipsis."""
    return df.withColumns({c: F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 1), F.lit("…"))).otherwise(F.col(c)) for c, n in caps.items()})


def item_chunk_stats(tagged: DataFrame, cap: int = 50) -> DataFrame:
    """Per project and section the chunks kept (the first ``cap`` in page order) and dropped.

    Which they are does not matter here, so they are counted and no section is ranked.
    """
    n = tagged.where(F.col("csi_section").isNotNull()).groupBy("project_id", "csi_section").agg(F.count(F.lit(1)).alias("n"))
    return n.select("project_id", "csi_section", F.least("n", F.lit(cap)).alias("kept"), F.greatest(F.col("n") - cap, F.lit(0)).alias("dropped"))


def split_sentences(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds sentences: split at line feeds, bullets and sentence ends before a capital; blank ones dropped."""
    parts = F.split(F.col(text_col), r"\n+|•|(?<=[.!?]) +(?=[A-Z])")
    return df.withColumn("sentences", F.filter(F.transform(parts, lambda x: F.trim(x)), lambda s: F.length(s) > 0))
