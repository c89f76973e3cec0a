"""Reading raw CSV: encodings, structure, numbered rows, inferred types."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from tidyledger.functions import vocabulary as words
from tidyledger.functions.cleaning import strip_ws
from tidyledger.operators.clean import CORRUPT, DATASET, FILE, ROW, ROW_ID
from tidyledger.sources.scratch import stored

_BLOCK = "_block"
BLOCK_LINES = 100_000  # of a file with line breaks in quotes that one task looks at


def number_rows(df: DataFrame, name: str = ROW, start: int = 0) -> DataFrame:
    """Number the records of every file in file order; add ``_file`` and ``_row_id``.

    Spark deals file splits to tasks by size, so task order is not file order.
    The records are read once and stored with their split and running id, which is
    in order within a split. Each split's offset, the number of records before
    it in its file, is counted on the stored rows, so a later change of the session's
    settings cannot change the splits in between; a row without an offset is an error.
    ``_row_id`` is unique over all files and stays what it is in the stored rows.
    """
    keyed = stored(df.withColumns({
        FILE: F.col("_metadata.file_path"), _BLOCK: F.col("_metadata.file_block_start"),
        ROW_ID: F.monotonically_increasing_id()}), "numbered")
    splits = keyed.groupBy(FILE, _BLOCK).agg(F.min(ROW_ID).alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy(FILE).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select(
        FILE, _BLOCK, (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("_shift"))
    number = F.coalesce(F.col(ROW_ID) + F.col("_shift"), F.raise_error(F.concat(
        F.lit("no offset for a split of "), F.col(FILE))).cast("long"))
    # One row per split; without the hint both sides are shuffled before their sizes are known.
    return keyed.join(F.broadcast(offsets), [FILE, _BLOCK], "left").withColumn(name, number + start).drop(_BLOCK, "_shift")


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """Numbered lines of every file as they are read, stored once: _file, row_number (from 1), value."""
    return number_rows(spark.read.text(path), "row_number", 1)


def _odd_quotes(value: Column) -> Column:
    """1 for a line with an odd number of quotes; counted on bytes, as the encoding may not be known yet."""
    latin = F.decode(value.cast("binary"), "ISO-8859-1")
    return ((F.length(latin) - F.length(F.replace(latin, F.lit('"'), F.lit("")))) % 2).cast("int")


def _file_facts(lines: DataFrame) -> DataFrame:
    """(path, encoding, breaks) per file, in one pass: UTF-16 by its mark, else strict UTF-8, else windows-1252 or latin-1;
    and whether a line ends inside quotes."""
    binary, valid = F.col("value").cast("binary"), F.is_valid_utf8("value")
    start = F.hex(F.substring(binary, 1, 2))
    # Flags only, so the aggregate hashes and never sorts.
    facts = lines.groupBy(F.col(FILE).alias("path")).agg(
        F.bool_and(valid).alias("utf8"), F.bool_or(~valid & F.decode(binary, "ISO-8859-1").rlike("[\\x80-\\x9f]")).alias("c1"),
        F.bool_or((F.col("row_number") == 1) & start.isin("FFFE", "FEFF")).alias("marked"),
        F.bool_or(_odd_quotes(F.col("value")) == 1).alias("breaks"))
    return facts.select("path", (
        F.when(F.col("marked"), "utf-16").when(F.col("utf8"), "utf-8")
        .when(F.col("c1"), "windows-1252").otherwise("latin-1")).alias("encoding"), "breaks")


def detect_encoding(spark: SparkSession, path: str, lines: DataFrame | None = None) -> DataFrame:
    """(path, encoding) per file: UTF-16 by its mark, else strict UTF-8, else windows-1252 or latin-1.

    Lines are checked where they are read, so a large file is checked by many
    tasks. A UTF-8 mark is dropped by the line reader, here as when the file is read.
    """
    return _file_facts(raw_lines(spark, path) if lines is None else lines).select("path", "encoding")


def _java_charset(encoding: str | None) -> str:
    """Charset the CSV source reads; windows-1252 is read as latin-1 and repaired by :func:`_repaired`."""
    return {None: "UTF-8", "latin-1": "ISO-8859-1", "utf-8-sig": "UTF-8", "windows-1252": "ISO-8859-1"}.get(
        encoding, encoding)


# Where windows-1252 has letters and latin-1 has control characters.
_C1 = {chr(b): bytes([b]).decode("cp1252") for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


def _repaired(c: Column, encoding: str | None) -> Column:
    return F.translate(c, "".join(_C1), "".join(_C1.values())) if encoding == "windows-1252" else c


def count_cells(line: Column) -> Column:
    """Number of cells of a CSV record; delimiters inside quotes do not count."""
    # A doubled quote inside quotes ends one quoted part and begins the next.
    bare = F.regexp_replace(line, '"[^"]*"', "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1


def _joined_records(lines: DataFrame, block_lines: int) -> DataFrame:
    """Records of files in which lines end inside quotes: their lines joined, numbered per file.

    Whether a line begins a record depends on all quotes before it. A block of lines is summed up by its parity and by how
    many records begin in it if it starts outside and if it starts inside quotes. A scan over the blocks of a file, one row each,
    then says how each block starts, so any number of tasks work on one file. A quote that is never closed would
    make one record of the rest of the file: its lines stay apart and are marked ``unclosed``.
    """
    local = Window.partitionBy("path", "block").orderBy("row_number")
    inside = F.coalesce(F.sum("odd").over(local.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2
    blocks_of = stored(lines.withColumn("block", F.floor(F.col("row_number") / block_lines)).withColumn("inside", inside),
                       "quoted-lines")
    out, within = F.col("inside") == 0, F.col("inside") == 1
    sums = blocks_of.groupBy("path", "block").agg(
        (F.sum("odd") % 2).alias("parity"), F.count_if(out).alias("begins_out"), F.count_if(within).alias("begins_in"),
        F.max(F.when(out, F.col("row_number"))).alias("last_out"), F.max(F.when(within, F.col("row_number"))).alias("last_in"))
    earlier, whole = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("path")
    opened = sums.withColumn("opened", F.coalesce(F.sum("parity").over(earlier), F.lit(0)) % 2)
    opened = opened.withColumns({
        "begins": F.when(F.col("opened") == 0, F.col("begins_out")).otherwise(F.col("begins_in")),
        "last": F.when(F.col("opened") == 0, F.col("last_out")).otherwise(F.col("last_in"))})
    states = opened.select("path", "block", "opened", F.coalesce(F.sum("begins").over(earlier), F.lit(0)).alias("base"),
                           F.sum("begins").over(whole).alias("records"), (F.sum("parity").over(whole) % 2 == 1).alias("open"),
                           F.max("last").over(whole).alias("open_line"))
    begun = F.sum((F.col("inside") == F.col("opened")).cast("long")).over(local)
    placed = blocks_of.join(states, ["path", "block"]).withColumn("record", F.col("base") + begun)
    unclosed = F.col("open") & (F.col("record") == F.col("records"))
    apart = F.col("record") + F.col("row_number") - F.col("open_line")
    return placed.withColumn("unclosed", unclosed).withColumn("record", F.when(F.col("unclosed"), apart).otherwise(F.col("record"))).groupBy(
        "path", "encoding", "record", "unclosed").agg(F.array_sort(F.collect_list(F.struct("row_number", "line"))).alias("parts")).select(
        "path", "encoding", F.col("record").alias("row_number"),
        F.array_join(F.transform("parts", lambda x: x["line"]), "\n").alias("line"), F.lit(True).alias("breaks"), "unclosed")


def csv_lines(spark: SparkSession, path: str, lines: DataFrame | None = None, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Numbered records of every file in its own encoding with their cell count; the header is record 1.

    A blank line has 0 cells. A line that ends inside quotes goes on in the next
    one; only files that have such lines are put together record by record. Lines behind a quote that is never
    closed are records of their own, marked ``unclosed``.
    """
    lines = raw_lines(spark, path) if lines is None else lines
    facts = stored(_file_facts(lines), "file-facts")
    known = lines.join(facts, F.col(FILE) == F.col("path"))
    latin = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
    text = (F.when(F.col("encoding") == "utf-8", F.col("value"))
            .when(F.col("encoding") == "windows-1252", _repaired(latin, "windows-1252")).otherwise(latin))
    plain = known.select("path", "encoding", "row_number", F.regexp_replace(text, "\r$", "").alias("line"), "breaks",
                         _odd_quotes(F.col("value")).alias("odd"))
    records = plain.filter("NOT breaks").select("path", "encoding", "row_number", "line", "breaks", F.lit(False).alias("unclosed"))
    if not facts.filter("breaks").isEmpty():
        records = records.unionByName(_joined_records(plain.filter("breaks"), block_lines))
    return records.withColumn("found", F.when(F.col("line") == "", 0).otherwise(count_cells(F.col("line"))))


def ragged_rows(lines: DataFrame) -> DataFrame:
    """(path, row_number, expected, found) of every row whose cell count is not that of its header."""
    headers = lines.filter("row_number = 1").select("path", F.col("found").alias("expected"))
    return lines.filter("row_number > 1").join(headers, "path").filter("found <> expected").select(
        "path", "row_number", "expected", "found")


def check_csv_structure(spark: SparkSession, path: str, lines: DataFrame | None = None) -> DataFrame:
    """One row per file: validity, encoding, line breaks in quotes, counts, header names, duplicate names, ragged
    rows, errors.

    The ragged rows themselves, of which there is no bound, come from :func:`ragged_rows`.
    """
    lines = csv_lines(spark, path) if lines is None else lines
    # Records are counted by their number of cells; everything else works on these few rows.
    widths = lines.groupBy("path", "found").agg(
        F.count("*").alias("n"), F.min(F.when(F.col("unclosed"), F.col("row_number"))).alias("open_row"))
    headers = lines.filter("row_number = 1").select(
        "path", "encoding", "breaks", F.col("line").alias("header"), F.col("found").alias("column_count"))
    fits = F.col("found") == F.col("column_count")
    per_file = headers.join(widths, "path").groupBy("path", "encoding", "breaks", "header", "column_count").agg(
        (F.sum("n") - 1).alias("row_count"), F.coalesce(F.sum(F.when(~fits, F.col("n"))), F.lit(0)).alias("ragged_rows"),
        F.min("open_row").alias("open_row"))
    names = F.transform(F.split("header", ","), lambda n: strip_ws(F.regexp_replace(n, '^"|"$', "")))
    twice = F.array_distinct(F.filter("column_names", lambda n: F.size(
        F.filter("column_names", lambda m: m == n)) > 1))
    empty = F.forall("column_names", lambda n: n == "")
    return (
        per_file.withColumn("column_names", names)
        .withColumns({
            "duplicate_names": twice,
            "errors": F.array_compact(F.array(F.when(
                empty, "CSV header is empty or contains only empty values"), F.when(F.col("open_row").isNotNull(), F.concat(
                    F.lit("a quote opened in record "), F.col("open_row"), F.lit(" is never closed")))))})
        .withColumn("is_valid", F.size("errors") == 0)
        .select("path", "is_valid", "encoding", "breaks", "row_count", "column_count", "column_names", "duplicate_names",
                "ragged_rows", "errors"))


def header_names(spark: SparkSession, path: str | list[str], encoding: str | None = None,
                 multi_line: bool = False) -> list[str]:
    """Stripped column names; a column without a name becomes ``column_<i>``."""
    given = spark.read.csv(path, header=True, encoding=_java_charset(encoding), enforceSchema=True, quote='"', escape='"',
                           multiLine=multi_line).columns
    if encoding == "windows-1252":
        given = [n.translate(str.maketrans(_C1)) for n in given]
    return [f"column_{i}" if n.strip() in ("", f"_c{i}") else n.strip() for i, n in enumerate(given)]


def read_bronze(
    spark: SparkSession, path: str | list[str], encoding: str | None = None, dataset_id: str = "", multi_line: bool = False
) -> DataFrame:
    """Raw CSV files of one header and one encoding as text columns.

    Adds ``_row_number`` within the file (the first record is 2), ``_file``,
    ``_row_id`` over all files, and ``_corrupt_record``. Surplus cells are dropped and
    the record text kept in ``_corrupt_record``; ``_missing_cells`` marks short rows, which
    validation rejects. Blank lines are skipped. Quoted line breaks and UTF-16 need
    ``multi_line``, which reads a file as one split. :func:`read_files` reads any mixture of files.
    """
    if encoding == "utf-16" and not multi_line:
        raise ValueError("UTF-16 is read with multi_line=True only")
    names = header_names(spark, path, encoding, multi_line)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, CORRUPT]])
    raw = spark.read.schema(schema).csv(
        path, header=True, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, quote='"', escape='"',
        encoding=_java_charset(encoding), multiLine=multi_line, enforceSchema=True,
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    short = F.coalesce(count_cells(F.col(CORRUPT)) < len(names), F.lit(False))
    numbered = number_rows(raw, ROW, 2).withColumn("_missing_cells", short)
    # An empty cell is empty text; only a cell that is not there is null.
    return numbered.select(
        ROW, FILE, ROW_ID, F.lit(dataset_id).alias(DATASET),
        *[_repaired(F.when(F.col("_missing_cells"), F.col(f"`{n}`")).otherwise(F.coalesce(F.col(f"`{n}`"), F.lit(""))),
                    encoding).alias(n) for n in names],
        _repaired(F.col(CORRUPT), encoding).alias(CORRUPT), "_missing_cells")


def read_files(spark: SparkSession, path: str, dataset_id: str = "", structure: DataFrame | None = None,
               encoding: str | None = None) -> DataFrame:
    """CSV files of any encodings and headers as one table, columns matched by name.

    Files are read in groups of equal header, encoding and kind; ``structure`` is the result of
    :func:`check_csv_structure` if it is at hand. Only its facts per file come to the driver.
    """
    structure = check_csv_structure(spark, path) if structure is None else structure
    kinds: dict[tuple, list[str]] = {}
    for r in structure.select("path", "encoding", "breaks", "column_names").collect():
        found = encoding or r["encoding"]
        header = r["path"] if found == "utf-16" else tuple(r["column_names"])
        kinds.setdefault((found, r["breaks"] or found == "utf-16", header), []).append(r["path"])
    tables = [read_bronze(spark, sorted(files), found, dataset_id, breaks) for (found, breaks, _), files in kinds.items()]
    if len(tables) == 1:
        return tables[0]
    # Every group has counted its own rows; the group's place makes the ids unique over all of them.
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [
        t.withColumn(ROW_ID, F.col(ROW_ID) * len(tables) + i) for i, t in enumerate(tables)])


def infer_schema(df: DataFrame, sample_rows: int | None = 20, order: str = ROW) -> DataFrame:
    """(position, column, type): int, float, date, bool, else str; from the first rows, or with None from all."""
    columns = [c for c in df.columns if not c.startswith("_")]
    cells = df.select(order, *[F.col(f"`{c}`").cast("string").alias(c) for c in columns])
    if sample_rows is not None:
        # A distributed top-k; only the few sample rows come back.
        cells = df.sparkSession.createDataFrame(cells.orderBy(order).limit(sample_rows).collect(), cells.schema)
    sample = cells.select(*[strip_ws(F.col(f"`{c}`")).alias(c) for c in columns])

    def all_fit(c: str, *patterns: str) -> Column:
        fits = F.lit(False)
        for p in patterns:
            fits = fits | F.col(f"`{c}`").rlike(p)
        return F.bool_and(F.when(F.col(f"`{c}`") != "", fits))

    def kind(c: str) -> Column:
        dates = F.lit(False)
        for p in words.DATE_PATTERNS:
            dates = dates | all_fit(c, "(?iU)" + p)
        flags = F.bool_and(F.when(F.col(f"`{c}`") != "", F.lower(F.col(f"`{c}`")).isin(*words.BOOLEAN_WORDS)))
        return (
            F.when(F.count_if(F.col(f"`{c}`") != "") == 0, "str")
            .when(all_fit(c, words.INTEGER_PATTERN), "int")
            .when(all_fit(c, words.FLOAT_PATTERN, "(?i)" + words.CURRENCY_PATTERN), "float")
            .when(dates, "date").when(flags, "bool").otherwise("str"))

    found = sample.agg(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), kind(c).alias("type"))
        for i, c in enumerate(columns)]).alias("found"))
    return found.select(F.inline("found"))


def preview(df: DataFrame, rows: int = 10, order: str | None = ROW) -> DataFrame:
    """First rows with empty text for missing cells."""
    first = df.orderBy(order) if order and order in df.columns else df
    return first.limit(rows).select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c)
                                      for c in df.columns if not c.startswith("_")])
