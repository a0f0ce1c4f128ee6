"""Readers for log files. Whatever Spark reads by line is split across tasks; only file lists reach the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailhound import fixed_values as V

FALLBACK_ENCODING = "ISO-8859-1"


def _lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.text(paths).select(
        "value", F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block_start"), F.monotonically_increasing_id().alias("_id"))


def sniff_delimiter(head: str) -> str:
    """Most frequent delimiter of a header line; ties keep the earlier one."""
    return max(V.CSV_DELIMITERS, key=head.count)


def headless(head: Column, delimiter: Column) -> Column:
    """Whether a file's first line is data: a line with a number, an address, a time or nothing in a field names no columns."""
    fields = F.transform(F.split(head, F.concat(F.lit("\\Q"), delimiter, F.lit("\\E"))), lambda x: F.trim(F.trim(x), F.lit('"')))
    value = r"^$|^[-+]?[0-9][0-9.,:eE+-]*$|^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ].*$|^[0-9]{1,3}(\.[0-9]{1,3}){3}(:[0-9]+)?$"
    return (F.size(fields) < 2) | F.exists(fields, lambda x: x.rlike(value))


def file_layouts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row per file from one split pass: encoding, delimiter, column count, whether its first line is data, a digest of
    that line, and whether that line is a whole JSON value. Lines themselves stay on the executors.

    A file that is not valid UTF-8 is read in the fallback encoding. Delimiters are counted in the first line that is not
    blank; of equally frequent ones the earlier in the list counts.
    """
    place = F.when(F.trim("value") != "", F.struct("block_start", "_id"))
    seen = _lines(spark, paths).groupBy("file_path").agg(
        F.min(F.is_valid_utf8("value")).alias("_ok"), F.coalesce(F.min_by("value", place), F.lit("")).alias("_head"))
    count = lambda d: F.length("_head") - F.length(F.replace("_head", F.lit(d), F.lit("")))
    best = F.array_max(F.array(*[F.struct(count(d).alias("n"), F.lit(-i).alias("i"), F.lit(d).alias("d"))
                                 for i, d in enumerate(V.CSV_DELIMITERS)]))
    start = F.trim("_head")
    return seen.withColumn("_best", best).select(
        "file_path", F.when(F.col("_ok"), "UTF-8").otherwise(FALLBACK_ENCODING).alias("encoding"),
        F.col("_best.d").alias("delimiter"), (F.col("_best.n") + 1).alias("n_columns"),
        headless(F.col("_head"), F.col("_best.d")).alias("headless"), F.md5("_head").alias("digest"),
        (F.get_json_object("_head", "$").isNotNull() & F.substring(start, 1, 1).isin("{", "[")).alias("json_line"),
        start.startswith("[").alias("json_array"), start.startswith("ElfFile").alias("binary"))


def read_csv(
    spark: SparkSession, paths: str | list[str], encoding: str | None = None, delimiter: str | None = None,
    header: bool | None = True, schema: T.StructType | str | None = None,
) -> DataFrame:
    """CSV files, each with its own encoding, delimiter and header; files that agree are read together.

    Finding these out costs one pass over the text, of which a few words per file reach the driver. With ``encoding``,
    ``delimiter`` and ``header`` given there is none, and all files must then share a header. ``header=None`` decides for
    each file by its first line, so that files without a header keep their first record. Files with a header are read
    together if they have the same first line, files without one if they have as many columns. Without a schema all
    columns are text, so no inference pass is made.
    """
    if encoding and delimiter and header is not None:
        groups = {(encoding, delimiter, header, ""): paths}
    else:
        groups: dict[tuple, list[str]] = {}
        for row in file_layouts(spark, paths).collect():
            named = header if header is not None else not row["headless"]
            key = (encoding or row["encoding"], delimiter or row["delimiter"], named, row["digest"] if named else row["n_columns"])
            groups.setdefault(key, []).append(row["file_path"])
    frames = []
    for (found_encoding, found_delimiter, named, _), files in sorted(groups.items(), key=str):
        reader = spark.read.option("sep", found_delimiter).option("header", named).option("encoding", found_encoding)
        frames.append((reader.schema(schema) if schema is not None else reader).csv(files))
    return union_all(spark, frames, schema)


def union_all(spark: SparkSession, frames: list[DataFrame], schema: T.StructType | str | None = None) -> DataFrame:
    """All frames by column name, absent columns null; without any frame an empty one."""
    if not frames:
        return spark.createDataFrame([], schema or "raw_log string, source_format string")
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def read_csv_any(spark: SparkSession, paths: str | list[str], **options) -> DataFrame:
    """Each file with a header if its first line reads like one, else without."""
    return read_csv(spark, paths, header=None, **options)


def flatten(df: DataFrame) -> DataFrame:
    """Nested objects become columns named by their path, joined by underscores. Looks at the schema only."""
    def leaves(field: T.StructField, path: list[str]) -> list[Column]:
        if isinstance(field.dataType, T.StructType):
            return [c for f in field.dataType.fields for c in leaves(f, [*path, f.name])]
        return [F.col(".".join(f"`{p}`" for p in path)).alias("_".join(path))]

    return df.select(*[c for f in df.schema.fields for c in leaves(f, [f.name])])


def read_json(spark: SparkSession, paths: str | list[str], schema: T.StructType | str | None = None) -> DataFrame:
    """JSON files, whole: each holds one array or object, or one value per line.

    A file whose first line is a JSON value by itself is read by line and can be split; any other is one document.
    """
    by_line, whole = [], []
    for row in file_layouts(spark, paths).collect():
        (by_line if row["json_line"] else whole).append(row["file_path"])
    frames = []
    for files, lines in ((by_line, True), (whole, False)):
        if files:
            reader = spark.read.option("multiLine", not lines)
            frames.append(flatten((reader.schema(schema) if schema is not None else reader).json(files)))
    return union_all(spark, frames, schema)


def read_json_lines(spark: SparkSession, paths: str | list[str], schema: T.StructType | str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return flatten(reader.json(paths))


def parse_json_column(df: DataFrame, column: str, schema: str) -> DataFrame:
    """JSON text in a column, flattened next to the other columns."""
    return flatten(df.withColumn(column, F.from_json(column, schema)))


def number_lines(lines: DataFrame, base: int = 0) -> DataFrame:
    """Add ``line_number``, counted within each file.

    Rows of a file block are consecutive in one task, so a row's place in its block is known without moving it;
    blocks are then offset by the sizes of the earlier blocks of their file (one row per block).
    """
    blocks = lines.groupBy("file_path", "block_start").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    earlier = W.partitionBy("file_path").orderBy("block_start").rowsBetween(W.unboundedPreceding, -1)
    offsets = blocks.select(
        "file_path", "block_start", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    number = F.col("_id") - F.col("_first") + F.col("_before") + F.lit(base)
    return lines.join(offsets, ["file_path", "block_start"]).withColumn("line_number", number.cast("bigint"))


def read_text(spark: SparkSession, paths: str | list[str], numbered: bool = True, base: int = 0, max_rows: int | None = None) -> DataFrame:
    """Non-blank lines. Blank ones still count in ``line_number``. ``max_rows`` keeps the first lines of each file
    and is off by default."""
    lines = _lines(spark, paths)
    if numbered or max_rows is not None:
        lines = number_lines(lines, base)
    if max_rows is not None:
        lines = lines.filter(F.col("line_number") < base + max_rows)
    kept = ["line_number"] if numbered else []
    return lines.filter(F.trim("value") != "").select(
        *kept, F.col("value").alias("raw_log"), F.element_at(F.split("file_path", "/"), -1).alias("file_name"), "file_path")


WINEVENT_SCHEMA = (
    "Event struct<System: struct<EventID: struct<`#text`: string>, TimeCreated: struct<`@SystemTime`: string>, "
    "Provider: struct<`@Name`: string>, Level: string, Task: string, Computer: string, "
    "Security: struct<`@UserID`: string>>, RenderingInfo: struct<Message: string>, EventData: map<string,string>>")


def winevent_columns(df: DataFrame, json: str = "value") -> DataFrame:
    """Windows event records exported as JSON, one per row, as flat columns; absent parts are empty text.

    Rows that hold no event record are left out; :func:`winevent_rejects` returns them.
    """
    event = F.col("_event")
    system = event["System"]
    fields = {
        "event_id": system["EventID"]["#text"], "timestamp": system["TimeCreated"]["@SystemTime"],
        "provider": system["Provider"]["@Name"], "level": system["Level"], "task": system["Task"],
        "computer": system["Computer"], "user_id": system["Security"]["@UserID"],
        "description": event["RenderingInfo"]["Message"],
    }
    return df.select(F.from_json(json, WINEVENT_SCHEMA)["Event"].alias("_event")).filter("_event is not null").select(
        *[F.coalesce(c, F.lit("")).alias(n) for n, c in fields.items()],
        F.coalesce(F.to_json(event["EventData"]), F.lit("{}")).alias("event_data"))


def winevent_rejects(df: DataFrame, json: str = "value") -> DataFrame:
    """The rows that :func:`winevent_columns` leaves out, unchanged."""
    return df.filter(F.from_json(json, WINEVENT_SCHEMA)["Event"].isNull())


def winevent_records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Records as text, one per row in ``value``: from lines, or from files that hold one array of records.

    An array that cannot be read is one row with the whole text of its file, which :func:`winevent_rejects` returns.
    """
    by_line, arrays = [], []
    for row in file_layouts(spark, paths).collect():
        if row["binary"]:
            raise ValueError(f"{row['file_path']} is a binary event log; export it as JSON first")
        (arrays if row["json_array"] else by_line).append(row["file_path"])
    frames = []
    if by_line:
        frames.append(spark.read.text(by_line).filter(F.trim("value") != ""))
    if arrays:
        parts = F.from_json("value", "array<variant>")
        records = F.when(parts.isNotNull(), F.transform(parts, lambda v: F.to_json(v))).otherwise(F.array("value"))
        frames.append(spark.read.text(arrays, wholetext=True).select(F.explode(records).alias("value")))
    return union_all(spark, frames, "value string")


def read_winevents(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return winevent_columns(winevent_records(spark, paths))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def file_list(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Path, size and extension of files; contents are not read."""
    return spark.read.format("binaryFile").load(paths).select(
        "path", "length", extension(F.col("path")).alias("extension"))


def allowed_files(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Files with a known extension; a size limit only where it is asked for."""
    known = files.filter(F.col("extension").isin(V.LOG_EXTENSIONS + V.CAPTURE_EXTENSIONS))
    return known if max_bytes is None else known.filter(F.col("length") <= max_bytes)


def manifest(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Name, path, size, line count, column count and checksum of each file, of any size.

    The checksum covers every line with its number, as two sums of 64-bit hashes, so it comes from the split scan and does
    not depend on how the file was split; it is not the MD5 of the file's bytes. The column count is that of the first line
    under its most frequent delimiter.
    """
    files = file_list(spark, paths).select("path", "length")
    numbered = number_lines(_lines(spark, paths))
    wide = lambda seed: F.sum(F.xxhash64(F.lit(seed), "line_number", "value").cast("decimal(38,0)")).cast("string")
    rows = numbered.groupBy("file_path").agg(
        F.count(F.lit(1)).alias("rows"), F.md5(F.concat_ws("/", wide(1), wide(2))).alias("file_hash"))
    rows = rows.join(file_layouts(spark, paths).select("file_path", "n_columns"), "file_path")
    key = lambda c: F.regexp_replace(c, "^file:/+", "/")
    return files.withColumn("_key", key("path")).join(rows.withColumn("_key", key("file_path")), "_key", "left").select(
        F.element_at(F.split("path", "/"), -1).alias("file_name"), "path",
        (F.col("length") / F.lit(1024.0 * 1024.0)).alias("file_size_mb"),
        F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("n_columns", F.lit(0)).alias("columns"),
        F.coalesce("file_hash", F.md5(F.lit(""))).alias("file_hash"))


def head_format(head: Column) -> Column:
    """Format by the first characters of a file."""
    start = F.trim(head)
    return (
        F.when(start.startswith("{") | start.startswith("["), "json")
        .when(head.contains(",") | head.contains(";") | head.contains("\t"), "csv").otherwise("text"))


def sniff_formats(spark: SparkSession, paths: str | list[str], head_chars: int = 1000) -> DataFrame:
    """Format of each file by content. At most ``head_chars`` lines of ``head_chars`` characters per file are
    gathered, so a file's size does not matter."""
    lines = _lines(spark, paths).filter("block_start = 0")
    first = lines.groupBy("file_path").agg(F.min("_id").alias("_first"))
    top = lines.join(first, "file_path").filter(F.col("_id") - F.col("_first") < head_chars)
    parts = F.array_sort(F.collect_list(F.struct("_id", F.substring("value", 1, head_chars).alias("v"))))
    heads = top.groupBy("file_path").agg(parts.alias("_parts"))
    head = F.substring(F.array_join(F.transform("_parts", lambda p: p["v"]), "\n"), 1, head_chars)
    return heads.select("file_path", head_format(head).alias("fmt"))


def route_files(spark: SparkSession, paths: str | list[str]) -> dict[str, list[str]]:
    """File paths by format: by extension where it is a known one, else by content."""
    by_extension = {".csv": "csv", ".json": "json", ".evtx": "winevent", ".txt": "text", ".log": "text"}
    listed = file_list(spark, paths).collect()
    routed: dict[str, list[str]] = {}
    unknown = []
    for row in listed:
        fmt = by_extension.get(row["extension"])
        if fmt:
            routed.setdefault(fmt, []).append(row["path"])
        else:
            unknown.append(row["path"])
    if unknown:
        for row in sniff_formats(spark, unknown).collect():
            routed.setdefault(row["fmt"], []).append(row["file_path"])
    return routed


def read_any(spark: SparkSession, paths: str | list[str], header: bool | None = None) -> DataFrame:
    """Read a mix of formats into one frame of text columns; columns a format lacks are null. An empty folder gives an empty frame.

    JSON files may hold a document or lines. A first line of a CSV file with a number, an address or a time in it is always a
    record. One of words alone may be either and is taken for a header; ``header=False`` says that these files have
    none, so that it stays a record as well.
    """
    csv = lambda session, files: read_csv(session, files, header=header)
    readers = {"csv": csv, "json": read_json, "winevent": read_winevents, "text": read_text}
    frames = []
    for fmt, files in sorted(route_files(spark, paths).items()):
        df = readers[fmt](spark, files)
        simple = [
            F.to_json(c).alias(c) if isinstance(df.schema[c].dataType, (T.ArrayType, T.MapType))
            else F.col(f"`{c}`").cast("string").alias(c) for c in df.columns]
        frames.append(df.select(*simple, F.lit(fmt).alias("source_format")))
    return union_all(spark, frames)


def read_many(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Several text logs at once, told apart by ``file_path`` (``file_name`` may repeat across folders)."""
    return read_text(spark, paths, numbered=False)


def split_incident(df: DataFrame, line: str = "value") -> DataFrame:
    """``timestamp severity source text`` lines; lines with fewer parts are left out."""
    parts = F.split(F.trim(F.col(line)), r"\s+", 4)
    return df.filter(F.size(parts) >= 4).select(
        parts[0].alias("timestamp"), parts[1].alias("severity"), parts[2].alias("source"), parts[3].alias("raw_log"))
