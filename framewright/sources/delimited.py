"""CSV scan and sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.functions.columns import col
from framewright.functions.fixed_values import NULL_TOKENS
from framewright.sources.pieces import BLOCK, FILE, KEYS, NAME, ROW, TEXT, count_of, joined_text, read_pieces, running, tasks_for

ROW_ORDER = "_row_order"

_QUOTING = {"quote": '"', "escape": '"'}
_RECORD = "_surplus_record"


def _header(spark: SparkSession, path, delimiter: str) -> list[str]:
    # A header cell may span lines; only the beginning of one file is parsed.
    first = (
        spark.read.options(header=False, sep=delimiter, multiLine=True, **_QUOTING).csv(path).head(1)
    )
    if not first:
        raise ValueError(f"no header row in {path}")
    return [text if text is not None else "" for text in first[0]]


def header_names(raw: list[str]) -> list[str]:
    """Blank names become ``Unnamed: i``; repeated names get ``.1``, ``.2`` ...

    Names that differ only in case count as repeated, since Spark resolves
    columns without regard to case.
    """
    filled = [name or f"Unnamed: {i}" for i, name in enumerate(raw)]
    reserved = {name.lower() for name in filled}
    out: list[str] = []
    taken: set[str] = set()
    repeats: dict[str, int] = {}
    for name in filled:
        fresh = name
        while fresh.lower() in taken or (fresh != name and fresh.lower() in reserved):
            repeats[name.lower()] = repeats.get(name.lower(), 0) + 1
            fresh = f"{name}.{repeats[name.lower()]}"
        out.append(fresh)
        taken.add(fresh.lower())
    return out


def _files_with_open_quotes(spark: SparkSession, path) -> list[str]:
    """Files in which a quoted cell may span lines: some line holds an odd number of quotes.

    One name per file at most, of the files that Spark's driver lists anyway.
    """
    odd = spark.read.text(path).filter(count_of(F.col("value"), '"') % 2 == 1)
    return [r[0] for r in odd.select(F.col("_metadata.file_path")).distinct().collect()]


def cut_records(spark: SparkSession, path, chosen: Column | None = None) -> DataFrame:
    """Every record of the files as ``KEYS`` without the run, and its number, the header among them.

    Files are cut at line feeds. A line starts inside a quoted cell if the
    quotes before it in its file are odd, which is a running sum over lines and
    runs of lines; lines inside belong to the record of the line before. Only records of
    several lines are brought together, at the place of their first line. Blank
    lines between records are left out; a record's number counts those before it
    in its file. Carriage returns that end records without a line feed raise.
    """
    lines = read_pieces(spark, path, "\n", chosen, _quotes=count_of(F.col(TEXT), '"'))
    tasks = tasks_for(lines)
    lines = running(lines.select(*KEYS, "_quotes"), F.col("_quotes"), "_before", tasks)
    inside, odd = F.col("_before") % 2 == 1, F.col("_quotes") % 2 == 1
    starts = ~inside & ~(F.col(TEXT).rlike(r"^\s*$"))
    lines = lines.withColumns({"_starts": starts.cast("int"), "_alone": ~inside & ~odd})
    lines = running(lines, F.col("_starts"), "_number")
    alone = lines.filter(F.col("_alone") & (F.col("_starts") == 1)).select(FILE, NAME, BLOCK, ROW, TEXT, "_number")
    # Behind its first line, a record's lines count that line too.
    own = F.when(F.col("_starts") == 1, F.col("_number")).otherwise(F.col("_number") - 1)
    place = F.struct(BLOCK, ROW)
    several = (
        lines.filter(~F.col("_alone"))
        .withColumn("_number", own)
        .repartition(tasks, FILE, NAME, "_number")
        .groupBy(FILE, NAME, "_number")
        .agg(F.min(place).alias("_place"), joined_text("\n").alias(TEXT))
        .select(FILE, NAME, f"_place.{BLOCK}", f"_place.{ROW}", TEXT, "_number")
    )
    records = alone.unionByName(several)
    ended = F.regexp_replace(TEXT, "\r\\z", "")
    bare = F.regexp_replace(ended, '"[^"]*("|$)', "")
    message = F.concat(F.lit("a carriage return alone ends a record in "), F.col(FILE))
    whole = F.when(bare.contains("\r"), F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
    return records.filter(whole).withColumn(TEXT, ended)


def _same_header(names: list[str], delimiter: str) -> Column:
    """True for a header of the same names but for case; any other first record of a file raises."""
    wide = ", ".join(f"c{i} string" for i in range(len(names) + 1))
    found = F.from_csv(TEXT, wide, {"sep": delimiter, **_QUOTING})
    texts = F.array(*[F.lower(found[f"c{i}"]) for i in range(len(names) + 1)])
    wanted = F.array(*[F.lit(n.lower()) for n in names], F.lit(None).cast("string"))
    same = F.forall(F.zip_with(texts, wanted, lambda a, b: a.eqNullSafe(b)), lambda x: x)
    message = F.concat(F.lit("the CSV header does not conform to that of other files: "), F.col(FILE))
    return F.when((F.col("_number") > 0) | same, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))


def _fits(cells: int, delimiter: str, first: str) -> Column:
    """True for rows of at most so many cells; a longer one raises.

    The reader hands over the text of rows whose length differs from the
    header's. A mark put behind the last cell falls within one cell more than
    the header has, unless the row is longer than that.
    """
    mark = "\u0001end"
    wide = ", ".join(f"c{i} string" for i in range(cells + 1))
    found = F.from_csv(F.concat(F.col(_RECORD), F.lit(delimiter + mark)), wide, {"sep": delimiter, **_QUOTING})
    here = F.array(*[found[f"c{i}"].eqNullSafe(F.lit(mark)) for i in range(cells + 1)])
    surplus = F.col(_RECORD).isNotNull() & ~F.array_contains(here, True)
    message = F.concat(
        F.lit(f"more than {cells} cells in a row that begins with "), F.coalesce(col(first), F.lit(""))
    )
    return F.when(surplus, F.raise_error(message).cast("boolean")).otherwise(F.lit(True))


def _file_key(path: Column, name: Column) -> Column:
    """Sorts files by folder, by the first number in the name, then by name: part 100000 after 99999."""
    return F.struct(
        F.regexp_extract(path, "^(.*)/", 1).alias("folder"),
        F.regexp_extract(name, r"(\d+)", 1).try_cast("decimal(38,0)").alias("number"),
        name.alias("name"),
    )


def read_csv(
    spark: SparkSession,
    path,
    delimiter: str = ",",
    multiline: bool | None = None,
    row_order: bool = False,
) -> DataFrame:
    """Every column as text, null tokens as NULL; types are inferred afterwards.

    ``multiline=None`` looks for cells that span lines first; ``True`` takes
    every file for one that may hold them, ``False`` none. All files are split
    among tasks. Files that may hold such cells are cut into records first,
    which shuffles their text once; the others are parsed where they are read.
    ``row_order`` adds a key that sorts rows in file order. Short rows are
    filled with nulls; a row with more cells than the header raises.
    """
    raw = _header(spark, path, delimiter)
    names = header_names(raw)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, _RECORD]])
    options = dict(columnNameOfCorruptRecord=_RECORD, sep=delimiter, **_QUOTING)

    def cells(rows: DataFrame, order: Column) -> DataFrame:
        texts = [F.when(~col(n).isin(NULL_TOKENS), col(n)).alias(n) for n in names]
        extra = [order.alias(ROW_ORDER)] if row_order else []
        return rows.filter(_fits(len(names), delimiter, names[0])).select(*texts, *extra)

    def by_line(chosen: Column | None = None) -> DataFrame:
        # Long rows are noticed only if all cells are parsed. Files of one folder
        # must agree on their header, unless it was repaired.
        reader = spark.read.schema(schema).options(
            header=True, columnPruning=False, enforceSchema=names != raw, **options
        )
        rows = reader.csv(path)
        place = F.struct(
            _file_key(F.col("_metadata.file_path"), F.col("_metadata.file_name")).alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        )
        return cells(rows if chosen is None else rows.filter(chosen), place)

    def by_record(chosen: Column | None = None) -> DataFrame:
        records = cut_records(spark, path, chosen)
        is_header = F.col("_number") == 0
        if names == raw:
            is_header = is_header & _same_header(raw, delimiter)
        # Fields by place, since names may hold anything.
        wide = ", ".join(f"c{i} string" for i in range(len(names)))
        parsed = records.filter(~is_header).select(
            F.from_csv(TEXT, f"{wide}, {_RECORD} string", options).alias("_cells"),
            F.struct(
                _file_key(F.col(FILE), F.col(NAME)).alias("file"), F.col(BLOCK).alias("block"), F.col(ROW).alias("row")
            ).alias("_place"),
        )
        rows = parsed.select(
            *[F.col(f"_cells.c{i}").alias(n) for i, n in enumerate(names)], f"_cells.{_RECORD}", "_place"
        )
        return cells(rows, F.col("_place"))

    if multiline is not None:
        return by_record() if multiline else by_line()
    odd = _files_with_open_quotes(spark, path)
    if not odd:
        return by_line()
    # The file filter is applied to the list of files, before anything is read.
    chosen = F.col("_metadata.file_path").isin(odd)
    return by_record(chosen).unionAll(by_line(~chosen))


def write_csv(df: DataFrame, path: str) -> None:
    """Header, no row numbers, missing cells empty; one file per partition.

    Blanks around a cell stay, and times keep their fractions of a second.
    """
    times = (T.TimestampType, T.TimestampNTZType)
    shown = [
        (col(f.name).cast("string") if isinstance(f.dataType, times) else col(f.name)).alias(f.name)
        for f in df.schema.fields
    ]
    df.select(*shown).write.mode("overwrite").options(
        header=True,
        nullValue="",
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
        **_QUOTING,
    ).csv(path)
