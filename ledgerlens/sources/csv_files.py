"""CSV extracts: text-typed reading with quarantine, numbering in file order, and merging of layouts."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher
from hashlib import sha256

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.values import ref
from ledgerlens.session import materialize
from ledgerlens.sources.mapping import DEFAULT_THRESHOLD, normalize

CORRUPT = "_corrupt_record"
SOURCE = "_source_file"
SOURCE_PATH = "_source_path"
BLOCK = "_source_block"
SEQ = "_source_seq"
DELIMITERS = ",;|\t"
SAMPLE_BYTES = 1 << 16
#: Schemes that Spark and pyarrow name differently.
ARROW_SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs"}


@dataclass(frozen=True)
class Layout:
    """The ordered headers and the delimiter that some files share."""

    headers: tuple[str, ...]
    delimiter: str


@dataclass
class CsvData:
    accepted: DataFrame
    rejected: DataFrame  # _reject_reason, _raw, _parsed (the fields as read, JSON), _source_file, _source_path


def list_files(spark: SparkSession, paths: list[str]) -> list[tuple[str, str]]:
    """(path, the same as _metadata.file_path has it) of all files, folders listed by name, in the given order."""
    found: dict[str, str] = {}
    for path in paths:
        files = spark.read.format("binaryFile").load(path).select("path", "_metadata.file_path")  # contents are not read
        found |= dict(sorted((r[0], r[1]) for r in files.collect()))
    return list(found.items())


def sniff(sample: str, delimiter: str | None = None) -> Layout:
    """Headers and delimiter from the beginning of a file.

    The delimiter under which most lines have as many fields as the header wins, then the one with more fields; quoted
    delimiters and line breaks do not count. A sample of one column is comma-separated.
    """
    best, layout = (-1.0, 0), Layout((), delimiter or DELIMITERS[0])
    for mark in [delimiter] if delimiter else DELIMITERS:
        rows = [r for r in csv.reader(io.StringIO(sample, newline=""), delimiter=mark) if r]
        if not rows:
            continue
        width = len(rows[0])
        score = (sum(len(r) == width for r in rows) / len(rows) if width > 1 else 0.0, width)
        if score > best:
            best, layout = score, Layout(tuple(rows[0]), mark)
    return layout


def _beginning(path: str) -> str:
    """The first lines of a file, decompressed by its extension."""
    scheme, rest = path.split(":", 1) if re.match("[a-z][a-z0-9+.-]+:", path) else ("file", path)
    if scheme == "file":
        source, place = fs.LocalFileSystem(), "/" + rest.lstrip("/")
    else:
        source, place = fs.FileSystem.from_uri(ARROW_SCHEMES.get(scheme, scheme) + ":" + rest)
    with source.open_input_stream(place, compression="detect") as stream:
        data = stream.read(SAMPLE_BYTES)
        cut = len(stream.read(1)) > 0
    text = data.decode("utf-8", errors="ignore").lstrip("\ufeff")
    whole = max(text.rfind("\n"), text.rfind("\r"))
    return text[:whole + 1] if cut and whole > 0 else text


def layouts_of(spark: SparkSession, files: list[tuple[str, str]], delimiter: str | None = None) -> dict[Layout, list[str]]:
    """{layout: files} in first-seen order; files without a header line have no rows and are left out.

    One job reads the beginnings of the files; only headers come back.
    """

    def run(batches):
        for batch in batches:
            found = [sniff(_beginning(p), delimiter) for p in batch.column("path").to_pylist()]
            headers = pa.array([list(f.headers) for f in found], pa.list_(pa.string()))
            yield pa.record_batch([batch.column("at"), headers, pa.array([f.delimiter for f in found])], ["at", "headers", "delimiter"])

    if not files:
        return {}
    listed = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(files)], "at int, path string")
    tasks = min(len(files), 4 * spark.sparkContext.defaultParallelism)
    heads = listed.repartition(tasks, "at").mapInArrow(run, "at int, headers array<string>, delimiter string")
    groups: dict[Layout, list[str]] = {}
    for row in sorted(heads.collect()):
        if row["headers"]:
            groups.setdefault(Layout(tuple(row["headers"]), row["delimiter"]), []).append(files[row["at"]][0])
    return groups


HEAD, WHOLE, TAIL = range(3)


def _records(spark: SparkSession, files: list[str]) -> DataFrame:
    """(SOURCE, SOURCE_PATH, BLOCK, SEQ, value): the records of CSV files whose quoted fields may hold line breaks.

    Files are split like any text. A split begins inside quotes when the quotes of the splits before it in the file
    are odd in number, which one count per split and a running sum tell. Each split then joins its own lines to records; only the
    record that crosses a border travels, its parts being put together in order. A record is held whole, so a quote that is never
    closed makes one record of the rest of its file.
    """
    lines = spark.read.text(files).select(
        F.col("_metadata.file_name").alias(SOURCE), F.col("_metadata.file_path").alias(SOURCE_PATH), F.col("_metadata.file_block_start").alias(BLOCK),
        F.monotonically_increasing_id().alias("at"), "value",
        ((F.length("value") - F.length(F.translate("value", '"', ""))) % 2).alias("odd"))
    before = Window.partitionBy(SOURCE_PATH).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)  # one line per split
    splits = lines.groupBy(SOURCE_PATH, BLOCK).agg(F.sum("odd").alias("odd"))
    inside = splits.withColumn("open", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2).filter("open = 1").select(SOURCE_PATH, BLOCK, "open")
    placed = lines.join(inside, [SOURCE_PATH, BLOCK], "left").withColumn("open", F.coalesce("open", F.lit(0)).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, pending, kind, open_, seq, out = None, [], HEAD, 0, 0, []

        def close(kind):
            nonlocal pending, seq
            if pending:
                out.append((*split, seq, kind, "\n".join(pending)))
                seq += kind != HEAD
                pending = []

        for batch in batches:
            for name, path, block, value, odd, start in zip(*[batch.column(c).to_pylist() for c in (SOURCE, SOURCE_PATH, BLOCK, "value", "odd", "open")]):
                if (name, path, block) != split:
                    close(TAIL if kind != HEAD and open_ else kind)
                    split, open_, seq, kind = (name, path, block), start, 0, HEAD
                if not open_:  # a record begins
                    close(kind)
                    kind = WHOLE
                pending.append(value)
                open_ = (open_ + odd) % 2
            if out:
                yield rows(out)
                out = []
        if split is not None:
            close(TAIL if kind != HEAD and open_ else kind)
        if out:
            yield rows(out)

    def rows(out) -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int8(), pa.string()]
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [SOURCE, SOURCE_PATH, BLOCK, SEQ, "kind", "value"])

    schema = f"{SOURCE} string, {SOURCE_PATH} string, {BLOCK} long, {SEQ} long, kind byte, value string"
    ordered = placed.sortWithinPartitions(SOURCE_PATH, BLOCK, "at")  # a join may have dealt the lines anew
    parts = materialize(ordered.mapInArrow(run, schema), "csv-records")
    along = Window.partitionBy(SOURCE_PATH).orderBy(BLOCK, "kind")  # at most two parts per split
    crossing = parts.filter(F.col("kind") != WHOLE).withColumn("chain", F.sum((F.col("kind") == TAIL).cast("int")).over(along))
    first = F.min_by(F.struct(SOURCE, BLOCK, SEQ), F.struct(BLOCK, "kind")).alias("first")
    texts = F.array_sort(F.collect_list(F.struct(BLOCK, "kind", "value")))
    joined = crossing.groupBy(SOURCE_PATH, "chain").agg(first, F.array_join(F.transform(texts, lambda t: t["value"]), "\n").alias("value"))
    columns = (SOURCE, SOURCE_PATH, BLOCK, SEQ, "value")
    joined = joined.select(f"first.{SOURCE}", SOURCE_PATH, f"first.{BLOCK}", f"first.{SEQ}", "value")
    return parts.filter(F.col("kind") == WHOLE).select(*columns).unionByName(joined.select(*columns))


def _read_multi_line(spark: SparkSession, layout: Layout, files: list[str]) -> CsvData:
    """Files of one layout whose quoted fields may hold line breaks, read by as many tasks as other files."""
    fields = [T.StructField(h, T.StringType()) for h in (*layout.headers, CORRUPT)]
    options = {"sep": layout.delimiter, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "multiLine": "true"}
    body = _records(spark, files).filter(~((F.col(BLOCK) == 0) & (F.col(SEQ) == 0)) & (F.trim("value") != ""))
    parsed = body.withColumn("row", F.from_csv("value", T.StructType(fields).toDDL(), options))
    corrupt = F.col("row")[CORRUPT]
    accepted = parsed.filter(corrupt.isNull()).select(*[F.col("row")[h].alias(h) for h in layout.headers], SOURCE, SOURCE_PATH, BLOCK, SEQ)
    rejected = parsed.filter(corrupt.isNotNull()).select(
        F.lit("row does not fit the header").alias("_reject_reason"), corrupt.alias("_raw"),
        F.to_json(F.struct(*[F.col("row")[h].alias(h) for h in layout.headers])).alias("_parsed"), SOURCE, SOURCE_PATH)
    return CsvData(accepted, rejected)


def _read_layout(spark: SparkSession, layout: Layout, files: list[str], multi_line: bool) -> CsvData:
    """Files of one layout: rows that fit the header, with their place, and the others."""
    if multi_line:
        return _read_multi_line(spark, layout, files)
    fields = [T.StructField(h, T.StringType()) for h in (*layout.headers, CORRUPT)]
    raw = (
        spark.read.schema(T.StructType(fields))
        .option("header", True).option("sep", layout.delimiter).option("quote", '"').option("escape", '"')
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
        .option("columnPruning", False)
        .csv(files)
        .withColumns({SOURCE: F.col("_metadata.file_name"), SOURCE_PATH: F.col("_metadata.file_path"), BLOCK: F.col("_metadata.file_block_start")})
    )
    # Spark refuses to read the marker alone, as a mere count would
    parsed = F.coalesce(F.length(ref(layout.headers[0])), F.lit(0)) >= 0
    accepted = raw.filter(ref(CORRUPT).isNull() & parsed).drop(CORRUPT)
    rejected = raw.filter(ref(CORRUPT).isNotNull() & parsed).select(
        F.lit("row does not fit the header").alias("_reject_reason"), ref(CORRUPT).alias("_raw"),
        F.to_json(F.struct(*[ref(h) for h in layout.headers])).alias("_parsed"), SOURCE, SOURCE_PATH,
    )
    return CsvData(accepted, rejected)


def _union(frames: list[DataFrame]) -> DataFrame:
    merged = frames[0]
    for frame in frames[1:]:
        merged = merged.unionByName(frame, allowMissingColumns=True)
    return merged


def _read(spark, files, multi_line, delimiter) -> CsvData:
    groups = layouts_of(spark, files, delimiter)
    if not groups:
        raise ValueError("none of the files has a header line")
    parts = [_read_layout(spark, layout, held, multi_line) for layout, held in groups.items()]
    return CsvData(_union([p.accepted for p in parts]), _union([p.rejected for p in parts]))


def read_csv(
    spark: SparkSession, paths: str | list[str], multi_line: bool = False, delimiter: str | None = None
) -> CsvData:
    """All columns as text, rows that do not fit the header of their file kept apart.

    Every file is read by its own header and delimiter, files of one layout together; columns meet
    by name, and a column that a file lacks is NULL there. Nothing is inferred, so long account numbers keep
    every digit. Files stay splittable; multi_line reads quoted line breaks as well, for one more pass over the files.
    """
    files = list_files(spark, [paths] if isinstance(paths, str) else list(paths))
    data = _read(spark, files, multi_line, delimiter)
    return CsvData(data.accepted.drop(BLOCK, SEQ), data.rejected)


def number_in_file_order(rows: DataFrame, files: list[tuple[str, str]], name: str = "_row_num") -> DataFrame:
    """Consecutive numbers over the files in their order and the lines in theirs, however Spark packs the splits.

    Rows have SOURCE_PATH and BLOCK (the start of their split). They are written once; a split's rows are read in
    order by one task, so counting the splits before turns the place in a split into a number, without a sort. Rows that
    have their place in the split in SEQ are numbered by it, in windows of one split.
    """
    if SEQ in rows.columns:
        inside = Window.partitionBy(SOURCE_PATH, BLOCK).orderBy(SEQ)
        rows = rows.withColumn("__at", F.row_number().over(inside).cast("long")).drop(SEQ)
        return _numbered(materialize(rows, "parsed"), rows.columns, files, name)
    stored = materialize(rows.withColumn("__at", F.monotonically_increasing_id()), "parsed")
    return _numbered(stored, rows.columns, files, name)


def _numbered(stored: DataFrame, columns: list[str], files: list[tuple[str, str]], name: str) -> DataFrame:
    """Rows with their place __at within a split, numbered over all splits of all files."""
    splits = stored.groupBy(SOURCE_PATH, BLOCK).agg(F.count("*").alias("size"), F.min("__at").alias("__first"))
    order = stored.sparkSession.createDataFrame([(p, i) for i, (_, p) in enumerate(files)], f"{SOURCE_PATH} string, __file int")
    before = Window.orderBy("__file", BLOCK).rowsBetween(Window.unboundedPreceding, -1)  # one line per split
    starts = splits.join(order, SOURCE_PATH).select(
        SOURCE_PATH, BLOCK, "__first", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("__before"))
    numbered = stored.join(starts, [SOURCE_PATH, BLOCK])
    position = (F.col("__before") + F.col("__at") - F.col("__first") + 1).cast("long")
    return numbered.select(position.alias(name), *[ref(c) for c in columns if c not in (BLOCK, "__at")])


def ingest_csv(
    spark: SparkSession,
    paths: str | list[str],
    report_type: str,
    mapping: dict[str, str] | None = None,
    multi_line: bool = False,
) -> CsvData:
    """Read, map to canonical columns and number the rows in file order; write with sinks.write_parquet."""
    files = list_files(spark, [paths] if isinstance(paths, str) else list(paths))
    data = _read(spark, files, multi_line, None)
    canonical = normalize(data.accepted.drop(SOURCE), report_type, mapping)
    return CsvData(number_in_file_order(canonical, files).drop(SOURCE_PATH), data.rejected)


# --- Merging files of different layouts ----------------------------------------------------------


def header_signature(headers: list[str]) -> str:
    return sha256("\x1f".join(sorted(headers)).encode()).hexdigest()


def unified_columns(layouts: list[list[str]]) -> list[str]:
    """Union of all headers in first-seen order, names differing only in case being one."""
    seen: dict[str, str] = {}
    for headers in layouts:
        for h in headers:
            seen.setdefault(h.lower(), h)
    return list(seen.values())


def align(headers: list[str], unified: list[str], threshold: float = DEFAULT_THRESHOLD) -> dict[str, str | None]:
    """{unified column: header that feeds it or None}; each header is used once.

    Columns are served in order: the same name first, else the most similar unused one.
    """
    by_name = {h.lower(): h for h in headers}
    free = dict.fromkeys(headers)
    result: dict[str, str | None] = {}
    for column in unified:
        pick = by_name.get(column.lower())
        if pick not in free:
            scores = [(SequenceMatcher(None, column.lower(), h.lower()).ratio(), h) for h in free]
            score, pick = max(scores, key=lambda s: s[0], default=(0.0, None))
            if score < threshold:
                pick = None
        result[column] = pick
        free.pop(pick, None)
    return result


def consolidate(
    spark: SparkSession,
    paths: list[str],
    alignment: dict[str, dict[str, str | None]] | None = None,
    threshold: float = DEFAULT_THRESHOLD,
    multi_line: bool = False,
) -> CsvData:
    """Files and folders of several layouts as one table, their origin in _source_file and _source_path.

    Every file is read by its own ordered header and delimiter, files that share both by one reader. `alignment`
    maps a header signature (the same for any order of the headers) to {unified column: header}. Columns that no layout feeds are left
    out, and rows that do not fit their header are in `rejected`.
    """
    layouts = layouts_of(spark, list_files(spark, list(paths)))
    if not layouts:
        raise ValueError("none of the files has a header line")
    unified = unified_columns([list(layout.headers) for layout in layouts])
    chosen = {
        layout: (alignment or {}).get(header_signature(list(layout.headers))) or align(list(layout.headers), unified, threshold)
        for layout in layouts
    }
    fed = [c for c in unified if any(chosen[layout].get(c) for layout in layouts)]
    accepted, rejected = [], []
    for layout, files in layouts.items():
        data = _read_layout(spark, layout, files, multi_line)
        own = chosen[layout]
        accepted.append(data.accepted.select(*[ref(own[c]).alias(c) for c in fed if own.get(c)], SOURCE, SOURCE_PATH))
        rejected.append(data.rejected)
    return CsvData(_union(accepted).select(*[ref(c) for c in fed], SOURCE, SOURCE_PATH), _union(rejected))
