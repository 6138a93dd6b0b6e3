"""JSON scan: arrays of records, JSON Lines and column-oriented objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewright.functions.columns import col
from framewright.session import reliable, shared_path, split_bytes
from framewright.sources.pieces import BLOCK, FILE, ROW, TEXT, count_of, joined_text, read_pieces, running, tasks_for

# Ends a cut record. JSON text holds no such character, so none is inside one.
_RECORD_END = "\u001e"
_PACKED = r"\.(gz|gzip|bz2|zst|zstd|lz4|snappy|deflate|xz)$"


def _first_text(spark: SparkSession, path) -> tuple[str, bool]:
    """The first line that is not blank, and whether its file has another."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    rows = lines.filter(F.trim("value") != "").head(2)
    if not rows:
        raise ValueError(f"no JSON in {path}")
    return rows[0][0].strip(), len(rows) > 1 and rows[0][1] == rows[1][1]


def _key_order(record: DataFrame) -> list[str]:
    """Keys of the first record, in file order (schema inference sorts them)."""
    rows = record.select(F.json_object_keys("value")).head(1)
    return list(rows[0][0] or []) if rows else []


def _flat_text(df: DataFrame) -> DataFrame:
    """Nested values as JSON text, so that every column is tabular."""
    nested = (T.StructType, T.ArrayType, T.MapType, T.VariantType)
    return df.select(
        *[
            (F.to_json(col(f.name)) if isinstance(f.dataType, nested) else col(f.name)).alias(
                f.name
            )
            for f in df.schema.fields
        ]
    )


def read_json(
    spark: SparkSession, path, orient: str | None = None, cut_above: int | None = None
) -> DataFrame:
    """``orient`` is ``lines``, ``records`` or ``columns``; None looks at the text.

    Lines are splittable and the format for big data. Arrays of objects are cut
    into records by many tasks if a file is longer than ``cut_above`` bytes (None:
    than one split of the session) and none is packed; short files are read
    whole, each by one task. So is a column-oriented object. Malformed text
    raises, and so does a cut array that holds anything but objects.
    """
    orient = orient or _orientation(spark, path)
    if orient == "columns":
        return _read_columns(spark, path)
    if orient not in ("lines", "records"):
        raise ValueError(f"unknown JSON orientation: {orient}")
    if orient == "lines":
        df = spark.read.option("mode", "FAILFAST").json(path)
        first = spark.read.text(path).filter(F.trim("value") != "").select("value")
    elif _is_long(spark, path, split_bytes(spark) if cut_above is None else cut_above):
        df, first = _read_cut(spark, path)
    else:
        df = spark.read.options(multiLine=True, mode="FAILFAST").json(path)
        first = spark.read.text(path, wholetext=True).select(
            F.get_json_object("value", "$[0]").alias("value")
        )
    order = [k for k in _key_order(first) if k in df.columns]
    rest = [c for c in df.columns if c not in order]
    return _flat_text(df.select(*[col(n) for n in order + rest]))


def _is_long(spark: SparkSession, path, limit: int) -> bool:
    """Whether a file is longer than the limit and none is packed; only the list of files is read."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    longest, packed = files.agg(
        F.max("length"), F.bool_or(F.lower("path").rlike(_PACKED))
    ).first()
    return longest is not None and longest > limit and not packed


def _depth_gained(text: Column) -> Column:
    """Brackets opened less brackets closed, of text that starts outside strings and holds no escapes."""
    bare = F.regexp_replace(F.regexp_replace(text, '"[^"]*"', ""), '"[^"]*$', "")
    return count_of(bare, "{") + count_of(bare, "[") - count_of(bare, "}") - count_of(bare, "]")


def cut_records(spark: SparkSession, path) -> DataFrame:
    """(text, file, record) of every object of the arrays or object sequences in the files.

    Files are cut behind every closing brace. A piece changes the state by its
    quotes and, given whether it starts inside a string, by its brackets; a
    record ends where the depth is back at that of the array. Partition columns
    of the path come first. A file that doesn't begin, go on and end as an array
    of objects, or as objects alone, raises when its rows are read.
    """
    # Escapes stand in strings only; without them every quote begins or ends one.
    plain = F.regexp_replace(F.col(TEXT), r"(?s)\\.", "")
    pieces = read_pieces(
        spark,
        path,
        "}",
        _quotes=count_of(plain, '"'),
        _outside=_depth_gained(plain),
        _inside=_depth_gained(F.regexp_replace(plain, '^[^"]*"?', "")),
    )
    parts = pieces.columns[: pieces.columns.index(FILE)]
    tasks = tasks_for(pieces)
    # A brace follows every piece but the last, and that one too if the sizes say so
    # (three bytes more or less: the mark of the byte order, which the scan leaves out).
    place = F.struct(BLOCK, ROW)
    splits = pieces.groupBy(FILE, BLOCK).agg(
        F.min(ROW).alias("_from"),
        F.max(ROW).alias("_to"),
        F.sum(F.octet_length(TEXT) + 1).alias("_size"),
        F.max("_file_size").alias("_file_size"),
    )
    files = splits.groupBy(F.col(FILE).alias("_of")).agg(
        F.min(F.struct(BLOCK, F.col("_from").alias(ROW))).alias("_head"),
        F.max(F.struct(BLOCK, F.col("_to").alias(ROW))).alias("_last"),
        (F.sum("_size") - F.max("_file_size")).isin(0, -3).alias("_closed"),
    )
    # One row per file, of the files that Spark's driver lists anyway.
    heads = pieces.join(F.broadcast(files), (F.col(FILE) == F.col("_of")) & (place == F.col("_head")))
    letter = F.substring(F.regexp_replace(TEXT, r"^\s+", ""), 1, 1)
    files = heads.select("_of", "_last", "_closed", letter.alias("_first"))
    known = pieces.join(F.broadcast(files), F.col(FILE) == F.col("_of")).drop("_of", "_file_size")
    known = running(known, F.col("_quotes"), "_before", tasks)
    starts_inside = F.col("_before") % 2 == 1
    last = place == F.col("_last")
    braced = ~last | F.col("_closed")
    closes = braced & ((F.col("_before") + F.col("_quotes")) % 2 == 0)
    known = known.withColumns(
        {
            "_is_last": last,
            "_braced": braced,
            "_closes": closes,
            "_base": F.when(F.col("_first") == "[", 1).otherwise(0),
            "_gain": F.when(starts_inside, F.col("_inside")).otherwise(F.col("_outside"))
            - closes.cast("int"),
        }
    )
    known = running(known, F.col("_gain"), "_depth")
    ends = F.col("_closes") & (F.col("_depth") + F.col("_gain") == F.col("_base"))
    known = running(known.withColumn("_ends", ends.cast("int")), F.col("_ends"), "_record")
    whole = known.withColumn(TEXT, F.concat(TEXT, F.when(F.col("_braced"), "}").otherwise("")))
    record = [FILE, "_record", *[col(n) for n in parts]]
    grouped = whole.repartition(tasks, *record).groupBy(*record).agg(
        joined_text("").alias(TEXT),
        F.max("_ends").alias("_ends"),
        F.max("_base").alias("_base"),
        F.bool_or("_is_last").alias("_is_last"),
    )
    in_array, done, later = F.col("_base") == 1, F.col("_ends") == 1, F.col("_record") > 0
    text = F.col(TEXT)
    begins = (
        F.when(in_array & later, text.rlike(r"^\s*,\s*\{"))
        .when(in_array, text.rlike(r"^\s*\[\s*\{"))
        .otherwise(text.rlike(r"^\s*\{"))
    )
    rest = (
        F.when(in_array & later, text.rlike(r"^\s*\]\s*$"))
        .when(in_array, text.rlike(r"^\s*\[\s*\]\s*$"))
        .otherwise(text.rlike(r"^\s*$"))
    )
    # The closing bracket of an array is a piece of its own, behind its last record.
    fits = F.when(done, begins & ~(in_array & F.col("_is_last"))).otherwise(rest)
    message = F.concat(F.lit("malformed JSON, not an array of objects: "), F.col(FILE))
    checked = F.when(fits, done).otherwise(F.raise_error(message).cast("boolean"))
    return grouped.filter(checked).select(
        *[col(n) for n in parts],
        F.regexp_replace(TEXT, r"^[\s,\[]+", "").alias("value"),
        F.col(FILE),
        F.col("_record"),
    )


def _read_cut(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    """The cut records, parsed, and the first of them as text."""
    records = reliable(cut_records(spark, path))
    parts = [n for n in records.columns if n not in ("value", FILE, "_record")]
    out = shared_path(spark, "records")
    lines = records.select("value", *[col(n) for n in parts]).write.option("lineSep", _RECORD_END)
    (lines.partitionBy(*parts) if parts else lines).text(out)
    df = spark.read.options(lineSep=_RECORD_END, mode="FAILFAST").json(out)
    first = records.orderBy(FILE, "_record").select("value")
    return df, first


def _orientation(spark: SparkSession, path) -> str:
    start, more = _first_text(spark, path)
    if start.startswith("["):
        return "records"
    line = F.lit(start)
    inner = F.map_values(F.from_json(line, "map<string,string>"))
    row_keyed = F.forall(
        inner, lambda v: F.forall(F.json_object_keys(v), lambda k: k.rlike(r"^\d+$"))
    )
    listed = F.forall(inner, lambda v: v.startswith("["))
    whole, keyed, lists = (
        spark.range(1)
        .select(F.try_parse_json(line).isNotNull(), row_keyed, listed)
        .first()
    )
    # A whole document before another line of its file is a record of JSON Lines.
    return "lines" if whole and (more or not keyed and not lists) else "columns"


def _read_columns(spark: SparkSession, path) -> DataFrame:
    """``{column: {row: value}}`` or ``{column: [value, ...]}``, one document per file.

    A document is taken apart by one task; its cells are brought together
    again by a shuffle on (file, row), so no lookup repeats per cell.
    """
    documents = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), "value"
    )
    columns = documents.select(
        "file", F.posexplode(F.json_object_keys("value")).alias("place", "column"), "value"
    )
    names = [
        r["column"]
        for r in columns.groupBy("column")
        .agg(F.min("place").alias("place"))
        .orderBy("place", "column")
        .collect()
    ]
    entries = documents.select(
        "file", F.explode(F.from_json("value", "map<string,string>")).alias("column", "body")
    )
    keyed = entries.filter(~F.col("body").startswith("[")).select(
        "file", "column", F.explode(F.from_json("body", "map<string,string>")).alias("row", "cell")
    )
    listed = entries.filter(F.col("body").startswith("[")).select(
        "file", "column", F.posexplode(F.from_json("body", "array<string>")).alias("row", "cell")
    )
    cells = keyed.unionByName(listed.withColumn("row", F.col("row").cast("string")))
    wide = cells.groupBy("file", "row").pivot("column", names).agg(F.max("cell"))
    return wide.select(*[col(n) for n in names])
