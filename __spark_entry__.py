"""

Every query runs an operator of the library over whole tables. Money columns
are read as decimals where sums are compared, so that results do not depend on
the order of addition.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions import text as tx
from framewright.functions.columns import col
from framewright.operators import charting as ch
from framewright.operators import cleaning as cl
from framewright.operators import encoding as en
from framewright.operators import inference as inf
from framewright.operators import profile_store as ps
from framewright.operators import profiling as pr
from framewright.operators import querying as qu
from framewright.operators import recommending as rc
from framewright.operators import sales as sa
from framewright.operators import sampling as sm
from framewright.operators import text_index as ti
from framewright.operators.medians import grouped_median
from framewright.operators.querying import Intent
from framewright.plans.explore import answer_with_chart
from framewright.plans.load import clean_and_encode, first_rows
from framewright.session import shared_path
from framewright.sources.delimited import read_csv, write_csv
from framewright.sources.records import read_json
from framewright.sources.workbook import parse_workbooks

SMOKE_DIR = "/root/testdata/sf0.001"

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(build):
        _QUERIES[name] = build
        if oracle is not None:
            _ORACLES[name] = oracle
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: col(n).cast("decimal(18,2)") for n in names})


# --- dirty input -----------------------------------------------------------

_DIRTY = """
SELECT o_orderkey,
       concat('$', cast(cast(o_totalprice AS decimal(18,2)) AS {text})) AS sales_text,
       {iso} AS iso_date,
       {dmy} AS dmy_date,
       CASE WHEN o_orderkey % 10 < 5 THEN NULL ELSE o_orderpriority END AS null_half,
       CASE WHEN o_orderkey % 10 < 6 THEN NULL ELSE o_orderpriority END AS null_most,
       CASE WHEN o_orderkey % 10 < 2 THEN 'n/a' ELSE cast(o_orderkey % 50 AS {text}) END AS num_80,
       CASE WHEN o_orderkey % 10 < 1 THEN 'n/a' ELSE cast(o_orderkey % 50 AS {text}) END AS num_90,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price_gaps,
       o_orderpriority AS category
FROM {orders}
"""

_DIRTY_DUCK = _DIRTY.format(
    text="varchar",
    iso="strftime(o_orderdate, '%Y-%m-%d')",
    dmy="strftime(o_orderdate, '%d/%m/%Y')",
    orders="orders",
)
WITH_DIRTY = f"WITH b AS ({_DIRTY_DUCK})"
WITH_COPIES = f"{WITH_DIRTY}, u AS (SELECT * FROM b UNION ALL SELECT * FROM b WHERE o_orderkey % 20 = 0)"


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = _DIRTY.format(
        text="string",
        iso="date_format(o_orderdate, 'yyyy-MM-dd')",
        dmy="date_format(o_orderdate, 'dd/MM/yyyy')",
        orders="{orders}",
    )
    return spark.sql(sql, orders=table(spark, sf_dir, "orders"))


def dirty_with_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = dirty(spark, sf_dir)
    return b.unionAll(b.filter("o_orderkey % 20 = 0"))


# --- sources and sinks -----------------------------------------------------


@query("csv_roundtrip", "SELECT * FROM orders")
def _(spark, d):
    path = shared_path(spark, "orders-csv")
    write_csv(table(spark, d, "orders"), path)
    return inf.infer_types(read_csv(spark, path), raw_text=True)[0]


@query(
    "csv_row_order",
    "SELECT * FROM orders ORDER BY o_orderkey LIMIT 5",
)
def _(spark, d):
    path = shared_path(spark, "orders-csv")
    write_csv(table(spark, d, "orders").orderBy("o_orderkey"), path)
    scan = read_csv(spark, path, multiline=False, row_order=True)
    typed, _ = inf.infer_types(scan, raw_text=True)
    return first_rows(typed, 5)


@query(
    "csv_padded_text_and_times",
    """SELECT event_id, '  ' || event_type || ' ' AS event_type, ts, props FROM events""",
)
def _(spark, d):
    path = shared_path(spark, "events-csv")
    padded = F.concat(F.lit("  "), F.col("event_type"), F.lit(" ")).alias("event_type")
    write_csv(table(spark, d, "events").select("event_id", padded, "ts", "props"), path)
    return read_csv(spark, path).select(
        F.col("event_id").cast("bigint").alias("event_id"),
        "event_type",
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        "props",
    )


@query(
    "csv_cells_over_lines",
    "SELECT doc_id, nullif(text, '') AS text, lang FROM documents",
)
def _(spark, d):
    path = shared_path(spark, "documents-csv")
    write_csv(table(spark, d, "documents").select("doc_id", "text", "lang"), path)
    return read_csv(spark, path).withColumn("doc_id", F.col("doc_id").cast("bigint"))


_PART_TEXT = """SELECT p_partkey, p_name, CAST(p_size AS BIGINT) AS p_size FROM part"""


@query("json_array", _PART_TEXT)
def _(spark, d):
    # One array of at most 10,000 records per file, as exports write them.
    path = shared_path(spark, "part-array")
    record = F.to_json(F.struct("p_partkey", "p_name", "p_size"))
    arrays = table(spark, d, "part").groupBy(F.floor(F.col("p_partkey") / 10_000).alias("file")).agg(
        F.concat(F.lit("["), F.array_join(F.collect_list(record), ","), F.lit("]")).alias("value")
    )
    arrays.write.partitionBy("file").text(path)
    return inf.json_types(read_json(spark, path, "records").drop("file"))


@query(
    "json_array_cut",
    """SELECT o_orderkey, o_orderstatus, '{"key":' || o_custkey || ',"tags":["a}","[b\\""]}' AS customer FROM orders""",
)
def _(spark, d):
    # The whole table as one array in one file, with nested values and braces in texts.
    path = shared_path(spark, "orders-array")
    customer = F.struct(
        F.col("o_custkey").alias("key"), F.array(F.lit("a}"), F.lit('[b"')).alias("tags")
    ).alias("customer")
    record = F.to_json(F.struct("o_orderkey", "o_orderstatus", customer))
    orders = table(spark, d, "orders")
    # One task writes the one file. It takes rows as they come and numbers them, and holds none.
    number, last = F.monotonically_increasing_id(), orders.count() - 1
    begin, end = F.when(number == 0, "[").otherwise(","), F.when(number == last, "]").otherwise("")
    lines = orders.select(record.alias("value")).coalesce(1).select(F.concat(begin, "value", end).alias("value"))
    lines.write.text(path)
    return read_json(spark, path, "records", cut_above=0)


@query("json_columns", _PART_TEXT)
def _(spark, d):
    path = shared_path(spark, "part-columns")
    part = table(spark, d, "part").groupBy(F.floor(F.col("p_partkey") / 10_000).alias("file"))
    cells = F.sort_array(F.collect_list(F.struct("p_partkey", "p_name", "p_size")))
    columns = part.agg(cells.alias("r")).select(
        "file",
        F.to_json(
            F.struct(*[F.col(f"r.{n}").alias(n) for n in ("p_partkey", "p_name", "p_size")])
        ).alias("value"),
    )
    columns.write.partitionBy("file").text(path)
    return inf.json_types(read_json(spark, path, "columns"))


@query(
    "json_roundtrip",
    "SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part",
)
def _(spark, d):
    path = shared_path(spark, "part-json")
    table(spark, d, "part").write.mode("overwrite").json(path)
    return inf.json_types(read_json(spark, path))


@query(
    "json_digit_text",
    """SELECT event_id, user_id, event_type, epoch_ms(CAST(floor(epoch(ts)) AS BIGINT) * 1000) AS created_at
       FROM events""",
)
def _(spark, d):
    path = shared_path(spark, "events-json")
    table(spark, d, "events").select(
        "event_id",
        F.col("user_id").cast("string").alias("user_id"),
        "event_type",
        F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), "ts").alias("created_at"),
    ).write.mode("overwrite").json(path)
    return inf.json_types(read_json(spark, path))


def _workbook(batch: pd.DataFrame) -> bytes:
    """A minimal workbook of one Arrow batch: a header row, then inline cells."""

    def cell(value) -> str:
        if isinstance(value, str):
            return f'<c t="inlineStr"><is><t>{escape(value)}</t></is></c>'
        return f"<c><v>{value}</v></c>"

    rows = ["<row>" + "".join(cell(str(n)) for n in batch.columns) + "</row>"]
    rows += [
        "<row>" + "".join(cell(v) for v in r) + "</row>" for r in batch.itertuples(index=False)
    ]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(
            "xl/workbook.xml",
            '<workbook xmlns:r="urn:r"><sheets><sheet name="a" sheetId="1" r:id="r1"/></sheets></workbook>',
        )
        z.writestr(
            "xl/_rels/workbook.xml.rels",
            '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        )
        z.writestr(
            "xl/worksheets/sheet1.xml",
            "<worksheet><sheetData>" + "".join(rows) + "</sheetData></worksheet>",
        )
    return out.getvalue()


def _to_workbooks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        if len(batch):
            yield pd.DataFrame(
                {"path": [f"{batch.iloc[0, 0]}.xlsx"], "content": [_workbook(batch)]}
            )


@query(
    "xlsx_folder",
    "SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer",
)
def _(spark, d):
    books = table(spark, d, "customer").mapInPandas(_to_workbooks, "path string, content binary")
    return inf.infer_types(parse_workbooks(books), raw_text=True)[0]


@query("preview_head", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 5")
def _(spark, d):
    return sm.head(table(spark, d, "orders"), ["o_orderkey"])


@query(
    "preview_records",
    """SELECT '{"o_orderkey":' || o_orderkey || ',"o_orderpriority":"' || o_orderpriority || '"}' AS record
       FROM orders ORDER BY o_orderkey LIMIT 5""",
)
def _(spark, d):
    return sm.sample_records(
        table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderkey"]
    )


@query(
    "sample_1000",
    """SELECT * FROM lineitem
       ORDER BY md5(concat_ws('#', l_orderkey::varchar, l_linenumber::varchar, l_partkey::varchar,
                              l_suppkey::varchar, '42')) LIMIT 1000""",
)
def _(spark, d):
    return sm.sample_rows(
        table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    )


# --- cleaning --------------------------------------------------------------

_DIRTY_COLUMNS = [
    "o_orderkey", "sales_text", "iso_date", "dmy_date", "null_half", "null_most",
    "num_80", "num_90", "price_gaps", "category",
]


@query(
    "null_fractions",
    f"{WITH_DIRTY} "
    + " UNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS \"column\", count(*) AS row_count, "
        f"count(*) - count({c}) AS missing_count, (count(*) - count({c})) / count(*) AS missing_fraction FROM b"
        for i, c in enumerate(_DIRTY_COLUMNS)
    ),
)
def _(spark, d):
    return inf.null_fractions(dirty(spark, d))


@query(
    "drop_sparse",
    f"{WITH_DIRTY} SELECT * EXCLUDE (null_most) FROM b",
)
def _(spark, d):
    return cl.drop_sparse(dirty(spark, d))


@query(
    "cleaning_report",
    f"""{WITH_COPIES}, k AS (SELECT * EXCLUDE (null_half, null_most) FROM u)
    SELECT 'drop_sparse' AS step, 'null_half' AS "column", 'missing_pct' AS metric,
           format('{{:.1f}}', 100.0 * (count(*) - count(null_half)) / count(*)) AS value FROM u
    UNION ALL
    SELECT 'drop_sparse', 'null_most', 'missing_pct',
           format('{{:.1f}}', 100.0 * (count(*) - count(null_most)) / count(*)) FROM u
    UNION ALL
    SELECT 'drop_duplicates', NULL, 'rows_removed',
           CAST((SELECT count(*) FROM k) - (SELECT count(*) FROM (SELECT DISTINCT * FROM k)) AS varchar)""",
)
def _(spark, d):
    return cl.cleaning_report(dirty_with_copies(spark, d))


@query(
    "infer_numeric",
    f"{WITH_DIRTY} SELECT o_orderkey, num_80, try_cast(num_90 AS double) AS num_90 FROM b",
)
def _(spark, d):
    return inf.infer_types(dirty(spark, d).select("o_orderkey", "num_80", "num_90"))[0]


@query(
    "infer_dates",
    f"""{WITH_DIRTY} SELECT o_orderkey, CAST(try_strptime(iso_date, '%Y-%m-%d') AS timestamp) AS iso_date,
        CAST(try_strptime(dmy_date, '%d/%m/%Y') AS timestamp) AS dmy_date FROM b""",
)
def _(spark, d):
    return inf.infer_types(dirty(spark, d).select("o_orderkey", "iso_date", "dmy_date"))[0]


@query(
    "parse_free_dates",
    f"{WITH_DIRTY} SELECT o_orderkey, CAST(strptime(dmy_date, '%d/%m/%Y') AS timestamp) AS dmy_date FROM b",
)
def _(spark, d):
    return inf.parse_dates(dirty(spark, d).select("o_orderkey", "dmy_date"), "dmy_date")


@query(
    "parse_free_date_forms",
    """SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) AS iso_t, CAST(o_orderdate AS TIMESTAMP) AS zoned,
              CAST(o_orderdate AS TIMESTAMP) AS minutes, CAST(o_orderdate AS TIMESTAMP) AS named FROM orders""",
)
def _(spark, d):
    forms = {
        "iso_t": "yyyy-MM-dd'T'HH:mm:ss",
        "zoned": "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'",
        "minutes": "yyyy-MM-dd HH:mm",
        "named": "MMM d, yyyy",
    }
    df = table(spark, d, "orders").select(
        "o_orderkey", *[F.date_format("o_orderdate", f).alias(n) for n, f in forms.items()]
    )
    return inf.parse_dates(df, list(forms))


@query("drop_duplicates", f"{WITH_COPIES} SELECT DISTINCT * FROM u")
def _(spark, d):
    return cl.drop_duplicates(dirty_with_copies(spark, d))


@query(
    "duplicate_count",
    f"{WITH_COPIES} SELECT (SELECT count(*) FROM u) - (SELECT count(*) FROM (SELECT DISTINCT * FROM u)) AS duplicate_rows",
)
def _(spark, d):
    return cl.duplicate_count(dirty_with_copies(spark, d))


@query(
    "normalise_names",
    """SELECT o_orderkey AS order_key, o_custkey AS "cust-key", o_orderstatus AS status_1x,
              o_totalprice AS status, o_orderdate AS order_date, o_orderpriority AS status_1 FROM orders""",
)
def _(spark, d):
    renamed = table(spark, d, "orders").toDF(
        " Order Key ", "Cust-Key", "status_1x", "Status", "order date", "status"
    )
    return cl.normalise_names(renamed)


@query(
    "currency_all",
    f"""{WITH_DIRTY} SELECT o_orderkey, try_cast(regexp_replace(sales_text, '[$,]', '', 'g') AS double) AS sales_text,
        try_cast(regexp_replace(iso_date, '[$,]', '', 'g') AS double) AS iso_date,
        try_cast(num_90 AS double) AS num_90, price_gaps FROM b""",
)
def _(spark, d):
    return cl.strip_currency(
        dirty(spark, d).select("o_orderkey", "sales_text", "iso_date", "num_90", "price_gaps")
    )


@query(
    "currency_by_name",
    f"""{WITH_DIRTY} SELECT o_orderkey, try_cast(regexp_replace(sales_text, '[$,]', '', 'g') AS double) AS sales_text,
        iso_date, num_90 FROM b""",
)
def _(spark, d):
    return cl.strip_currency_by_name(
        dirty(spark, d).select("o_orderkey", "sales_text", "iso_date", "num_90")
    )


@query(
    "mean_impute",
    f"""{WITH_DIRTY}, m AS (SELECT CAST(sum(CAST(price_gaps AS decimal(18,2))) AS double) / count(price_gaps) AS mean FROM b)
    SELECT o_orderkey, null_half, coalesce(price_gaps, m.mean) AS price_gaps FROM b, m""",
)
def _(spark, d):
    return cl.impute_means(money(dirty(spark, d).select("o_orderkey", "null_half", "price_gaps"), "price_gaps"))


@query(
    "dropna_subset",
    f"{WITH_DIRTY} SELECT * FROM b WHERE null_half IS NOT NULL AND price_gaps IS NOT NULL",
)
def _(spark, d):
    return cl.drop_missing(dirty(spark, d), ["null_half", "price_gaps"])


@query(
    "display_strings",
    f"""{WITH_DIRTY} SELECT o.o_orderkey, strftime(o.o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate,
        coalesce(b.null_half, 'nan') AS null_half, b.price_gaps
        FROM b JOIN orders o USING (o_orderkey)""",
)
def _(spark, d):
    orders = table(spark, d, "orders")
    gaps = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice"))
    half = F.when(F.col("o_orderkey") % 10 >= 5, F.col("o_orderpriority"))
    return cl.display_text(
        orders.select("o_orderkey", "o_orderdate", half.alias("null_half"), gaps.alias("price_gaps"))
    )


@query(
    "text_functions",
    r"""SELECT p_partkey, replace(lower(trim(p_name)), ' ', '_') AS name_form, split_part(p_type, '_', 1) AS stem,
               nullif(regexp_extract(p_brand, '\d+'), '') AS digits,
               (contains(lower(p_name), 'red') OR contains(lower(p_name), 'ring')) AS wanted,
               format('{:.2f}', p_retailprice) AS price_text,
               '$' || format('{:,.2f}', p_retailprice) AS price_money
        FROM part""",
)
def _(spark, d):
    return table(spark, d, "part").select(
        "p_partkey",
        tx.normalised_text(F.col("p_name")).alias("name_form"),
        tx.name_stem(F.col("p_type")).alias("stem"),
        tx.first_digits(F.col("p_brand")).alias("digits"),
        tx.contains_any(F.col("p_name"), ["red", "ring"]).alias("wanted"),
        tx.two_decimals(F.col("p_retailprice")).alias("price_text"),
        tx.money(F.col("p_retailprice")).alias("price_money"),
    )


_REPLY = r"text || CASE WHEN turn % 2 = 0 THEN E'\n```python\n' || role || E' = 1\nprint(1)\n```\n' ELSE '' END"


@query(
    "extract_code_blocks",
    rf"""WITH r AS (SELECT conv_id, turn, {_REPLY} AS reply FROM conversations)
    SELECT conv_id, turn,
           CASE WHEN regexp_matches(reply, '(?s)```python(.*?)```')
                THEN regexp_replace(regexp_extract(reply, '(?s)```python(.*?)```', 1), '^\s+|\s+$', '', 'g') END AS code,
           regexp_replace(regexp_replace(reply, '(?s)```python(.*?)```', '', 'g'), '^\s+|\s+$', '', 'g') AS answer
    FROM r""",
)
def _(spark, d):
    block = F.concat(F.lit("\n```python\n"), F.col("role"), F.lit(" = 1\nprint(1)\n```\n"))
    reply = F.concat("text", F.when(F.col("turn") % 2 == 0, block).otherwise(F.lit("")))
    return table(spark, d, "conversations").select(
        "conv_id", "turn", tx.code_block(reply).alias("code"), tx.without_code(reply).alias("answer")
    )


# --- encoding --------------------------------------------------------------


def _rank_sql(expression: str) -> str:
    return f"CAST(dense_rank() OVER (ORDER BY {expression}) - 1 AS bigint)"


@query(
    "label_encode_binary",
    f"SELECT *, {_rank_sql('l_linestatus')} AS l_linestatus_encoded FROM lineitem",
)
def _(spark, d):
    return en.label_encode(table(spark, d, "lineitem"), "l_linestatus")


@query("label_encode_many", f"SELECT *, {_rank_sql('p_brand')} AS p_brand_encoded FROM part")
def _(spark, d):
    return en.label_encode(table(spark, d, "part"), "p_brand")


@query(
    "label_encode_missing",
    f"""{WITH_DIRTY} SELECT o_orderkey, null_half, {_rank_sql("coalesce(null_half, 'nan')")} AS null_half_encoded FROM b""",
)
def _(spark, d):
    return en.label_encode(dirty(spark, d).select("o_orderkey", "null_half"), "null_half")


_SKEWED_DUCK = "CASE WHEN l_linenumber <= 2 THEN 'hot' ELSE 'k' || l_orderkey END"


@query(
    "label_encode_large_skewed",
    f"""WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_SKEWED_DUCK} AS tag FROM lineitem)
    SELECT *, {_rank_sql('tag')} AS tag_encoded FROM t""",
)
def _(spark, d):
    tag = F.when(F.col("l_linenumber") <= 2, "hot").otherwise(F.concat(F.lit("k"), "l_orderkey"))
    tagged = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", tag.alias("tag")
    )
    return en.label_encode(tagged, "tag", dictionary_rows=100)


_PRIORITY_FLAGS = ", ".join(
    f"coalesce(o_orderpriority = '{v}', false) AS \"o_orderpriority_{v}\""
    for v in ["2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
)
_STATUS_FLAGS = ", ".join(
    f"coalesce(o_orderstatus = '{v}', false) AS \"o_orderstatus_{v}\"" for v in ["O", "P"]
)


@query("onehot_drop_first", f"SELECT *, {_PRIORITY_FLAGS} FROM orders")
def _(spark, d):
    return en.one_hot(table(spark, d, "orders"), "o_orderpriority")


@query("encode_all", f"SELECT *, {_STATUS_FLAGS}, {_PRIORITY_FLAGS} FROM orders")
def _(spark, d):
    return en.encode(table(spark, d, "orders")).data


@query(
    "encode_mapping",
    """SELECT 'p_brand' AS original, 'p_brand_encoded' AS columns
       UNION ALL SELECT 'p_name', 'p_name_encoded'
       UNION ALL SELECT 'p_type', (SELECT string_agg('p_type_' || p_type, '|' ORDER BY p_type)
                                   FROM (SELECT DISTINCT p_type FROM part WHERE p_type > (SELECT min(p_type) FROM part)))""",
)
def _(spark, d):
    encoded = en.encode(table(spark, d, "part"))
    return en.mapping_table(spark, encoded.mapping).select(
        "original", F.array_join("columns", "|").alias("columns")
    )


@query(
    "encoded_substitution",
    f"""SELECT o_orderkey, o_totalprice, o_orderpriority = '2-HIGH' AS o_orderpriority FROM orders
        ORDER BY md5(concat_ws('#', o_orderkey::varchar, '42')) LIMIT 1000""",
)
def _(spark, d):
    encoded = en.encode(table(spark, d, "orders"))
    return en.substitute_encoded(
        encoded.data, encoded.mapping, ["o_orderpriority"], ["o_orderkey"]
    ).select("o_orderkey", "o_totalprice", "o_orderpriority")


@query(
    "encoded_substitution_large",
    """WITH c AS (SELECT o_orderkey, 'C' || CAST(o_custkey AS varchar) AS customer FROM orders),
            k AS (SELECT customer, row_number() OVER (ORDER BY customer) - 1 AS code FROM (SELECT DISTINCT customer FROM c))
       SELECT o_orderkey, CAST(code AS bigint) AS customer FROM c JOIN k USING (customer)
       ORDER BY md5(concat_ws('#', o_orderkey::varchar, '42')) LIMIT 1000""",
)
def _(spark, d):
    df = table(spark, d, "orders").select(
        "o_orderkey", F.concat(F.lit("C"), F.col("o_custkey")).alias("customer")
    )
    # A label dictionary that is ranked in parallel, not broadcast.
    classes = en.class_table(df, ["customer"])
    plan = en.EncodingPlan([en.EncodingChoice("customer", "label", None)], classes)
    return en.encoded_sample(df, ["customer"], ["o_orderkey"], plan=plan)


@query(
    "clean_and_encode",
    f"""{WITH_COPIES} SELECT DISTINCT o_orderkey, CAST(strptime(dmy_date, '%d/%m/%Y') AS timestamp) AS dmy_date,
        try_cast(num_90 AS double) AS num_90, category,
        category = '2-HIGH' AS "category_2-HIGH", category = '3-MEDIUM' AS "category_3-MEDIUM",
        category = '4-NOT SPECIFIED' AS "category_4-NOT SPECIFIED", category = '5-LOW' AS "category_5-LOW"
        FROM u""",
)
def _(spark, d):
    frame = dirty_with_copies(spark, d).select("o_orderkey", "dmy_date", "null_most", "num_90", "category")
    return clean_and_encode(frame).data


# --- profiling -------------------------------------------------------------

_ORDERS_TYPES = {
    "o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string",
    "o_totalprice": "double", "o_orderdate": "timestamp_ntz", "o_orderpriority": "string",
}
_LINEITEM_NUMBERS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
    "l_quantity", "l_extendedprice", "l_discount", "l_tax",
]


def _mean_sql(c: str) -> str:
    return f"CAST(sum(CAST({c} AS decimal(18,2))) AS double) / count({c})"


def _profile_sql(name: str, types: dict[str, str]) -> str:
    parts = []
    for i, (c, t) in enumerate(types.items()):
        numbers = (
            f"round({_mean_sql(c)}, 4) AS mean, round(median(CAST({c} AS double)), 4) AS median, "
            f"min(CAST({c} AS double)) AS min, max(CAST({c} AS double)) AS max"
            if t in ("int", "bigint", "double")
            else "NULL::double AS mean, NULL::double AS median, NULL::double AS min, NULL::double AS max"
        )
        parts.append(
            f"SELECT {i} AS position, '{c}' AS \"column\", '{t}' AS dtype, count(*) AS row_count, "
            f"{len(types)} AS column_count, count(*) - count({c}) AS missing_count, {numbers} FROM {name}"
        )
    return " UNION ALL ".join(parts)


@query("profile_basic", _profile_sql("orders", _ORDERS_TYPES))
def _(spark, d):
    p = pr.profile(table(spark, d, "orders"))
    return p.withColumns({"mean": F.round("mean", 4), "median": F.round("median", 4)})


@query(
    "profile_dirty",
    f"{WITH_DIRTY} "
    + _profile_sql(
        "b",
        {
            c: {"o_orderkey": "bigint", "price_gaps": "double"}.get(c, "string")
            for c in _DIRTY_COLUMNS
        },
    ),
)
def _(spark, d):
    p = pr.profile(dirty(spark, d))
    return p.withColumns({"mean": F.round("mean", 4), "median": F.round("median", 4)})


@query(
    "column_information",
    " UNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS \"column\", '{t}' AS dtype, count(*) AS row_count, "
        f"6 AS column_count, count(*) - count({c}) AS missing_count FROM orders"
        for i, (c, t) in enumerate(_ORDERS_TYPES.items())
    ),
)
def _(spark, d):
    return pr.column_information(table(spark, d, "orders"))


@query(
    "profile_of_appended_files",
    f"SELECT * EXCLUDE (median) FROM ({_profile_sql('orders', _ORDERS_TYPES)})",
)
def _(spark, d):
    path, store = shared_path(spark, "orders-files"), shared_path(spark, "orders-profile")
    orders = table(spark, d, "orders")
    for part in ("F", "O", "P"):
        # Each append profiles the files it adds.
        orders.filter(F.col("o_orderstatus") == part).write.mode("append").parquet(path)
        ps.update_profiles(spark, path, store)
    merged = ps.table_profile(spark, path, store)
    return merged.drop("median", "distinct_count").withColumn("mean", F.round("mean", 4))


@query("row_and_column_count", "SELECT count(*) AS row_count, CAST(11 AS bigint) AS column_count FROM lineitem")
def _(spark, d):
    return pr.row_and_column_count(table(spark, d, "lineitem"))


@query(
    "numeric_summary",
    " UNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS \"column\", round({_mean_sql(c)}, 4) AS mean, "
        f"round(median(CAST({c} AS double)), 4) AS median, "
        f"min(CAST({c} AS double)) AS min, max(CAST({c} AS double)) AS max FROM lineitem"
        for i, c in enumerate(_LINEITEM_NUMBERS)
    ),
)
def _(spark, d):
    s = pr.numeric_summary(table(spark, d, "lineitem"))
    return s.withColumns({"mean": F.round("mean", 4), "median": F.round("median", 4)})


@query(
    "profile_formatted",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", format('{{:.2f}}', {_mean_sql(c)}) AS mean, "
        f"format('{{:.2f}}', median(CAST({c} AS double))) AS median, "
        f"format('{{:.2f}} to {{:.2f}}', CAST(min({c}) AS double), CAST(max({c}) AS double)) AS range FROM lineitem"
        for c in ["l_linenumber", "l_quantity", "l_discount", "l_tax"]
    ),
)
def _(spark, d):
    return pr.formatted_statistics(
        table(spark, d, "lineitem").select("l_linenumber", "l_quantity", "l_discount", "l_tax")
    )


_LINEITEM_COLUMNS = [*_LINEITEM_NUMBERS, "l_returnflag", "l_linestatus", "l_shipdate"]


@query(
    "distinct_counts",
    " UNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS \"column\", count(DISTINCT {c}) AS distinct_count FROM lineitem"
        for i, c in enumerate(_LINEITEM_COLUMNS)
    ),
)
def _(spark, d):
    return pr.distinct_counts(table(spark, d, "lineitem"))


_TABLE_TYPES = {
    "customer": {
        "c_custkey": "bigint", "c_name": "string", "c_nationkey": "int",
        "c_acctbal": "double", "c_mktsegment": "string",
    },
    "events": {
        "event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint",
        "event_type": "string", "value": "double", "props": "string",
    },
    "lineitem": {
        "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint",
        "l_linenumber": "int", "l_quantity": "double", "l_extendedprice": "double",
        "l_discount": "double", "l_tax": "double", "l_returnflag": "string",
        "l_linestatus": "string", "l_shipdate": "timestamp_ntz",
    },
    "nation": {"n_nationkey": "int", "n_name": "string", "n_regionkey": "int"},
    "orders": _ORDERS_TYPES,
    "part": {
        "p_partkey": "bigint", "p_name": "string", "p_brand": "string",
        "p_type": "string", "p_size": "int", "p_retailprice": "double",
    },
    "supplier": {
        "s_suppkey": "bigint", "s_name": "string", "s_nationkey": "int", "s_acctbal": "double",
    },
    "documents": {
        "doc_id": "bigint", "text": "string", "lang": "string", "source": "string",
        "n_chars": "bigint",
    },
    "region": {"r_regionkey": "int", "r_name": "string"},
    "embeddings": {"vec_id": "bigint", "embedding": "array<float>", "label": "int"},
    "pages": {"page_id": "bigint", "url": "string", "html": "string"},
    "benchmark": {"item_id": "bigint", "text": "string"},
    "labels": {"doc_id": "bigint", "quality": "int", "toxic": "int"},
    "conversations": {"conv_id": "bigint", "turn": "bigint", "role": "string", "text": "string"},
}


def _roles_sql(name: str) -> str:
    parts = []
    for i, (c, t) in enumerate(_TABLE_TYPES[name].items()):
        distinct = f"count(DISTINCT {c})"
        if t in ("int", "bigint", "double"):
            role = "'numeric'"
            subtype = f"CASE WHEN {distinct} < 20 THEN 'discrete' ELSE 'continuous' END"
        elif t == "timestamp_ntz":
            role, subtype = "'datetime'", "NULL"
        elif t.startswith("array"):
            role, subtype = "'other'", "NULL"
        else:
            role = f"CASE WHEN 2 * {distinct} < count(*) THEN 'categorical' ELSE 'other' END"
            subtype = "NULL"
        parts.append(
            f"SELECT '{name}' AS table_name, {i} AS position, '{c}' AS \"column\", '{t}' AS dtype, "
            f"count(*) AS row_count, count(*) - count({c}) AS missing_count, "
            f"{distinct} AS distinct_count, {role} AS role, {subtype} AS subtype FROM {name}"
        )
    return " UNION ALL ".join(parts)


@query("column_roles", _roles_sql("part"))
def _(spark, d):
    return pr.column_roles(table(spark, d, "part"), "part")


@query("catalogue_roles", " UNION ALL ".join(_roles_sql(n) for n in _TABLE_TYPES))
def _(spark, d):
    return pr.catalogue_roles({n: table(spark, d, n) for n in _TABLE_TYPES})


# --- structured queries ----------------------------------------------------


@query("intent_filter_num", "SELECT * FROM part WHERE p_size = 7")
def _(spark, d):
    return qu.run_intent(table(spark, d, "part"), Intent(filters={"p_size": 7})).data


@query("intent_filter_text", "SELECT * FROM part WHERE regexp_matches(p_name, 'RED|ring$', 'i')")
def _(spark, d):
    return qu.run_intent(table(spark, d, "part"), Intent(filters={"p_name": "RED|ring$"})).data


@query(
    "intent_filter_literal",
    "SELECT * FROM part WHERE contains(lower(p_brand), 'brand#1')",
)
def _(spark, d):
    return qu.run_intent(
        table(spark, d, "part"), Intent(filters={"p_brand": "BRAND#1"}), literal=True
    ).data


@query(
    "intent_filter_multi",
    "SELECT * FROM orders WHERE regexp_matches(o_orderpriority, 'high', 'i') AND o_orderstatus ILIKE '%f%'",
)
def _(spark, d):
    filters = {"o_orderpriority": "high", "no_such_column": 3, "o_orderstatus": "f"}
    return qu.run_intent(table(spark, d, "orders"), Intent(filters=filters)).data


@query("intent_filter_mismatch", "SELECT * FROM orders WHERE 1 = 0")
def _(spark, d):
    return qu.run_intent(table(spark, d, "orders"), Intent(filters={"o_orderstatus": 5})).data


@query(
    "intent_filter_indexed",
    "SELECT doc_id, lang FROM documents WHERE regexp_matches(text, 'thrend.*the|[0-9]{3}-[0-9]{4}@?|license', 'i')",
)
def _(spark, d):
    path, store = shared_path(spark, "documents-files"), shared_path(spark, "documents-grams")
    table(spark, d, "documents").write.partitionBy("lang").parquet(path)
    ti.update_text_index(spark, path, "text", store)
    found = ti.search_files(spark, path, "text", "thrend.*the|[0-9]{3}-[0-9]{4}@?|license", store)
    return found.data.select("doc_id", "lang")


def _group_query(function: str, source: str, key: str, value: str, sql: str, digits=None, exact=False, order_by=None):
    @query(
        f"intent_group_{function}",
        f"SELECT {key}, {sql} AS {value} FROM {source} GROUP BY {key}",
    )
    def _(spark, d):
        df = table(spark, d, source)
        if exact:
            df = money(df, value)
        intent = Intent("aggregate", [key, value], {}, function, [key])
        data = qu.run_intent(df, intent, order_by).data
        if exact:
            data = data.withColumn(value, col(value).cast("double"))
        return data.withColumn(value, F.round(value, digits)) if digits is not None else data


_DEC = "CAST({} AS decimal(18,2))"
_group_query("sum", "orders", "o_orderpriority", "o_totalprice",
             "CAST(sum(CAST(o_totalprice AS decimal(18,2))) AS double)", exact=True)
_group_query("mean", "orders", "o_orderpriority", "o_totalprice", _mean_sql("o_totalprice"), exact=True)
_group_query("count", "orders", "o_orderstatus", "o_totalprice", "count(o_totalprice)")
_group_query("min", "orders", "o_orderpriority", "o_orderdate", "min(o_orderdate)")
_group_query("max", "orders", "o_orderpriority", "o_totalprice", "max(o_totalprice)")
_group_query("median", "lineitem", "l_suppkey", "l_extendedprice", "round(median(l_extendedprice), 4)", 4)
_group_query("std", "lineitem", "l_returnflag", "l_quantity", "round(stddev_samp(l_quantity), 6)", 6)
_group_query("var", "lineitem", "l_returnflag", "l_quantity", "round(var_samp(l_quantity), 6)", 6)
_group_query("nunique", "lineitem", "l_returnflag", "l_partkey", "count(DISTINCT l_partkey)")
_group_query("size", "events", "event_type", "user_id", "count(*)")
_group_query("first", "orders", "o_custkey", "o_totalprice", "arg_min(o_totalprice, o_orderkey)", order_by="o_orderkey")
_group_query("last", "orders", "o_custkey", "o_totalprice", "arg_max(o_totalprice, o_orderkey)", order_by="o_orderkey")
_group_query("prod", "lineitem", "l_orderkey", "l_linenumber", "product(l_linenumber)")
_group_query("any", "lineitem", "l_orderkey", "l_tax", "bool_or(l_tax <> 0)")
_group_query("all", "lineitem", "l_orderkey", "l_tax", "bool_and(l_tax <> 0)")
_group_query("sem", "lineitem", "l_returnflag", "l_quantity",
             "round(stddev_samp(l_quantity) / sqrt(count(l_quantity)), 6)", 6)
_group_query("skew", "events", "event_type", "value", "round(skewness(value), 6)", 6)


@query(
    "intent_group_missing_keys",
    f"""{WITH_DIRTY} SELECT null_half, category, count(price_gaps) AS price_gaps FROM b
        WHERE null_half IS NOT NULL GROUP BY null_half, category""",
)
def _(spark, d):
    intent = Intent("aggregate", ["price_gaps"], {}, "count", ["null_half", "category"])
    return qu.run_intent(dirty(spark, d), intent).data


@query(
    "median_hot_groups",
    """SELECT l_returnflag, l_linestatus, round(median(l_extendedprice), 4) AS l_extendedprice,
              median(l_quantity) AS l_quantity
       FROM lineitem GROUP BY l_returnflag, l_linestatus""",
)
def _(spark, d):
    narrowed = grouped_median(
        table(spark, d, "lineitem"),
        ["l_returnflag", "l_linestatus"],
        ["l_extendedprice", "l_quantity"],
        ranked_values=500,
    )
    return narrowed.withColumn("l_extendedprice", F.round("l_extendedprice", 4))


@query("order_lookup", "SELECT * FROM lineitem WHERE CAST(l_orderkey AS varchar) = '42'")
def _(spark, d):
    question = "Which items belong to sales order 42?"
    return qu.order_lookup(table(spark, d, "lineitem"), question).data


@query(
    "order_lookup_layout",
    "SELECT 'SO' || l_orderkey AS sales_order, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey = 42",
)
def _(spark, d):
    path = shared_path(spark, "orders-layout")
    number = F.concat(F.lit("SO"), F.col("l_orderkey")).alias("sales_order")
    lines = table(spark, d, "lineitem").select("l_orderkey", number, "l_linenumber", "l_quantity")
    qu.write_order_layout(lines, path, "l_orderkey")
    found = qu.order_lookup(spark.read.parquet(path), "Which items belong to sales order 42?")
    return found.data.drop("l_orderkey")


@query(
    "order_lookup_double",
    """SELECT CAST(l_orderkey AS DOUBLE) AS order_key, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey = 42""",
)
def _(spark, d):
    lines = table(spark, d, "lineitem").select(
        F.col("l_orderkey").cast("double").alias("order_key"), "l_linenumber", "l_quantity"
    )
    return qu.order_lookup(lines, "Which items belong to sales order 42?").data


@query(
    "order_lookup_batch",
    """WITH q AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'How many parts are there?'
                 ELSE 'Lines related to Sales Order ' || (CASE WHEN o_orderstatus = 'F' THEN 7 ELSE o_orderkey END) END AS question
                 FROM orders),
            i AS (SELECT *, CASE WHEN question LIKE 'Lines%' THEN regexp_extract(question, '[0-9]+') END AS order_id FROM q),
            c AS (SELECT CAST(l_orderkey AS varchar) AS id, count(*) AS n FROM lineitem GROUP BY 1)
       SELECT o_orderkey, question, order_id, CASE WHEN order_id IS NOT NULL THEN coalesce(n, 0) END AS line_count
       FROM i LEFT JOIN c ON order_id = id""",
)
def _(spark, d):
    asked = F.when(F.col("o_orderstatus") == "F", F.lit(7)).otherwise(F.col("o_orderkey"))
    question = F.when(F.col("o_orderstatus") == "P", F.lit("How many parts are there?")).otherwise(
        F.concat(F.lit("Lines related to Sales Order "), asked)
    )
    questions = table(spark, d, "orders").select("o_orderkey", question.alias("question"))
    return qu.order_line_counts(table(spark, d, "lineitem"), questions, "question")


@query(
    "relationship",
    f"SELECT l_quantity, {_mean_sql('l_extendedprice')} AS mean_y, count(*) AS n FROM lineitem GROUP BY l_quantity",
)
def _(spark, d):
    return qu.relationship(money(table(spark, d, "lineitem"), "l_extendedprice"), "l_quantity", "l_extendedprice")[0]


@query(
    "relationship_pearson",
    "SELECT count(*) AS n, round(corr(l_quantity, l_extendedprice), 6) AS pearson FROM lineitem",
)
def _(spark, d):
    row = qu.relationship(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice")[1]
    return row.withColumn("pearson", F.round("pearson", 6))


@query(
    "intent_trend",
    f"SELECT o_orderdate, {_mean_sql('o_totalprice')} AS o_totalprice FROM orders GROUP BY o_orderdate",
)
def _(spark, d):
    intent = Intent("trend", ["o_orderdate", "o_totalprice"], {}, "mean", ["o_orderdate"])
    return answer_with_chart(money(table(spark, d, "orders"), "o_totalprice"), intent)[1]


@query(
    "intent_comparison",
    f"""SELECT o_orderpriority, {_mean_sql('o_totalprice')} AS mean FROM orders
        WHERE o_orderstatus = 'F' GROUP BY o_orderpriority""",
)
def _(spark, d):
    intent = Intent(
        "comparison", ["o_orderpriority", "o_totalprice"], {"o_orderstatus": "f"}, None, []
    )
    return answer_with_chart(money(table(spark, d, "orders"), "o_totalprice"), intent)[1]


@query("intent_correlation", "SELECT l_quantity, l_extendedprice FROM lineitem WHERE l_linenumber = 3")
def _(spark, d):
    intent = Intent("correlation", ["l_quantity", "l_extendedprice"], {"l_linenumber": 3}, None, [])
    return answer_with_chart(table(spark, d, "lineitem"), intent)[1]


_CUSTOM = """
SELECT o_orderpriority, month, orders, rank() OVER (PARTITION BY month ORDER BY orders DESC) AS place
FROM (SELECT o_orderpriority, {month} AS month, count(*) AS orders FROM {source} GROUP BY 1, 2)
"""


@query(
    "custom_sql",
    f"SELECT * REPLACE (CAST(place AS integer) AS place) FROM ({_CUSTOM.format(month='month(o_orderdate)::integer', source='orders')})",
)
def _(spark, d):
    sql = _CUSTOM.format(month="month(o_orderdate)", source="data")
    return qu.custom_query(table(spark, d, "orders"), sql)


@query("project", "SELECT o_orderpriority, o_totalprice FROM orders")
def _(spark, d):
    return qu.project(table(spark, d, "orders"), ["o_orderpriority", "o_totalprice"])


# --- charts ----------------------------------------------------------------


def _histogram_sql(source: str, c: str, bins: int) -> str:
    width = f"((hi - lo) / {bins})"

    def edge(i: str) -> str:
        return f"(CASE WHEN {i} >= {bins} THEN hi ELSE lo + ({i}) * {width} END)"

    return f"""
    WITH e AS (SELECT min({c}) AS lo, max({c}) AS hi FROM {source}),
    g AS (SELECT {c} AS x, lo, hi, CAST(least(floor(({c} - lo) / {width}), {bins - 1}) AS integer) AS g FROM {source}, e),
    p AS (SELECT CASE WHEN x < {edge('g')} THEN g - 1 WHEN g < {bins - 1} AND x >= {edge('g + 1')} THEN g + 1 ELSE g END AS b FROM g),
    n AS (SELECT b, count(*) AS n FROM p GROUP BY b)
    SELECT CAST(i AS integer) AS bin, {edge('i')} AS low, {edge('i + 1')} AS high, coalesce(n, 0) AS count
    FROM range({bins}) r(i) LEFT JOIN n ON i = b, e"""


@query("hist30", _histogram_sql("events", "value", 30))
def _(spark, d):
    return ch.histogram(table(spark, d, "events"), "value")


@query("hist_bins", _histogram_sql("lineitem", "l_extendedprice", 12))
def _(spark, d):
    return ch.histogram(table(spark, d, "lineitem"), "l_extendedprice", 12)


@query(
    "hist_of_text",
    "SELECT p_name, count(*) AS count FROM part GROUP BY p_name ORDER BY count DESC, p_name LIMIT 10",
)
def _(spark, d):
    spec = qu.ChartSpec("Names", "Histogram", ["p_name"], "")
    return ch.chart_data(table(spark, d, "part"), spec)


@query("bar_mean", f"SELECT o_orderpriority, {_mean_sql('o_totalprice')} AS mean FROM orders GROUP BY o_orderpriority")
def _(spark, d):
    return ch.category_means(money(table(spark, d, "orders"), "o_totalprice"), "o_orderpriority", "o_totalprice")


@query(
    "bar_mean_count",
    f"""{WITH_DIRTY} SELECT null_half, {_mean_sql('price_gaps')} AS mean, count(price_gaps) AS count FROM b
        WHERE null_half IS NOT NULL GROUP BY null_half""",
)
def _(spark, d):
    return ch.category_means_and_counts(money(dirty(spark, d), "price_gaps"), "null_half", "price_gaps")


@query("value_counts", "SELECT p_name, count(*) AS count FROM part GROUP BY p_name")
def _(spark, d):
    return ch.value_counts(table(spark, d, "part"), "p_name")


@query(
    "top10_values",
    "SELECT l_partkey, count(*) AS count FROM lineitem GROUP BY l_partkey ORDER BY count DESC, l_partkey LIMIT 10",
)
def _(spark, d):
    return ch.top_values(table(spark, d, "lineitem"), "l_partkey")


@query("line_series", f"{WITH_DIRTY} SELECT iso_date, price_gaps FROM b WHERE price_gaps IS NOT NULL")
def _(spark, d):
    return ch.time_series(dirty(spark, d), "iso_date", "price_gaps")


@query(
    "line_series_monthly",
    f"SELECT date_trunc('month', o_orderdate)::timestamp AS o_orderdate, {_mean_sql('o_totalprice')} AS o_totalprice FROM orders GROUP BY 1",
)
def _(spark, d):
    return ch.time_series(money(table(spark, d, "orders"), "o_totalprice"), "o_orderdate", "o_totalprice", "month")


@query(
    "line_series_pixels",
    """WITH p AS (SELECT ts, value, epoch_us(ts) AS x FROM events WHERE ts IS NOT NULL AND value IS NOT NULL),
            e AS (SELECT min(x) AS lo, max(x) AS hi FROM p),
            c AS (SELECT ts, value, least(floor((x - lo) / ((hi - lo) / 200)), 199) AS c FROM p, e),
            r AS (SELECT ts, value, row_number() OVER (PARTITION BY c ORDER BY ts, value) AS a,
                         row_number() OVER (PARTITION BY c ORDER BY ts DESC, value DESC) AS b,
                         row_number() OVER (PARTITION BY c ORDER BY value, ts) AS lowest,
                         row_number() OVER (PARTITION BY c ORDER BY value DESC, ts DESC) AS highest FROM c)
       SELECT DISTINCT ts, value FROM r WHERE 1 IN (a, b, lowest, highest)""",
)
def _(spark, d):
    return ch.time_series(table(spark, d, "events"), "ts", "value", pixels=200)


@query("scatter_pairs", "SELECT l_quantity, l_extendedprice FROM lineitem")
def _(spark, d):
    return ch.scatter_pairs(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice")


@query(
    "ols_trend",
    """SELECT round(regr_slope(l_discount, l_quantity), 9) AS slope, round(regr_intercept(l_discount, l_quantity), 6) AS intercept,
              round(regr_r2(l_discount, l_quantity), 9) AS r2, count(*) AS n FROM lineitem""",
)
def _(spark, d):
    line = ch.trend_line(table(spark, d, "lineitem"), "l_quantity", "l_discount")
    return line.select(
        F.round("slope", 9).alias("slope"),
        F.round("intercept", 6).alias("intercept"),
        F.round("r2", 9).alias("r2"),
        "n",
    )


@query(
    "pie_shares",
    """WITH s AS (SELECT c_mktsegment, CAST(sum(CAST(c_acctbal AS decimal(18,2))) AS double) AS total FROM customer GROUP BY 1),
            w AS (SELECT CAST(sum(CAST(c_acctbal AS decimal(18,2))) AS double) AS whole FROM customer)
       SELECT c_mktsegment, total, total / whole AS share FROM s, w""",
)
def _(spark, d):
    return ch.shares(money(table(spark, d, "customer"), "c_acctbal"), "c_mktsegment", "c_acctbal")


# --- recommendations -------------------------------------------------------


def _roles(spark: SparkSession, d: str) -> DataFrame:
    return pr.catalogue_roles({n: table(spark, d, n) for n in _TABLE_TYPES}, "rules")


_ALL_ROLES = "WITH roles AS (" + " UNION ALL ".join(_roles_sql(n) for n in _TABLE_TYPES) + "), "
_NUMBERS_SQL = """n AS (SELECT table_name, "column" AS c, row_number() OVER (PARTITION BY table_name ORDER BY position) AS i
                  FROM roles WHERE role = 'numeric'),
   n1 AS (SELECT * FROM n WHERE i = 1), n2 AS (SELECT * FROM n WHERE i = 2),
   d1 AS (SELECT table_name, arg_min("column", position) AS c FROM roles WHERE role = 'datetime' GROUP BY 1),"""


@query(
    "recommend_generic",
    f"""{_ALL_ROLES} {_NUMBERS_SQL}
    t1 AS (SELECT table_name, arg_min("column", position) AS c, arg_min(distinct_count, position) AS u
           FROM roles WHERE dtype = 'string' GROUP BY 1),
    a AS (SELECT table_name, i AS p, 'Distribution of ' || c AS title, 'histogram' AS plot_type, c AS columns,
                 'Shows how ' || c || ' values are distributed' AS explanation FROM n WHERE i <= 3
          UNION ALL
          SELECT table_name, 4, n1.c || ' Over Time', 'line', d1.c || ',' || n1.c, 'Shows ' || n1.c || ' trends over time'
          FROM d1 JOIN n1 USING (table_name)
          UNION ALL
          SELECT table_name, 5, n1.c || ' by ' || t1.c, 'bar', t1.c || ',' || n1.c, 'Compares ' || n1.c || ' across categories'
          FROM t1 JOIN n1 USING (table_name) WHERE u < 15)
    SELECT table_name, CAST(row_number() OVER (PARTITION BY table_name ORDER BY p) AS integer) AS rank,
           title, plot_type, columns, explanation FROM a""",
)
def _(spark, d):
    return rc.recommend_generic(_roles(spark, d)).withColumn("columns", F.array_join("columns", ","))


@query(
    "recommend_roles",
    f"""{_ALL_ROLES} {_NUMBERS_SQL}
    c1 AS (SELECT table_name, arg_min("column", position) AS c FROM roles WHERE role = 'categorical' GROUP BY 1),
    a AS (SELECT table_name, i AS p, 'Distribution of ' || c AS title, 'histogram' AS plot_type, c AS columns,
                 'Shows how ' || c || ' values are distributed' AS explanation FROM n WHERE i IN (1, 3)
          UNION ALL
          SELECT n1.table_name, 2,
                 CASE WHEN d1.c IS NOT NULL THEN n1.c || ' Over Time' WHEN c1.c IS NOT NULL THEN n1.c || ' by ' || c1.c
                      ELSE 'Relationship: ' || n1.c || ' vs ' || n2.c END,
                 CASE WHEN d1.c IS NOT NULL THEN 'line' WHEN c1.c IS NOT NULL THEN 'bar' ELSE 'scatter' END,
                 CASE WHEN d1.c IS NOT NULL THEN d1.c || ',' || n1.c WHEN c1.c IS NOT NULL THEN c1.c || ',' || n1.c
                      ELSE n1.c || ',' || n2.c END,
                 CASE WHEN d1.c IS NOT NULL THEN 'Shows how ' || n1.c || ' changes over time'
                      WHEN c1.c IS NOT NULL THEN 'Compares ' || n1.c || ' across different ' || c1.c || ' categories'
                      ELSE 'Shows relationship between ' || n1.c || ' and ' || n2.c END
          FROM n1 LEFT JOIN n2 USING (table_name) LEFT JOIN d1 USING (table_name) LEFT JOIN c1 USING (table_name)
          WHERE d1.c IS NOT NULL OR c1.c IS NOT NULL OR n2.c IS NOT NULL)
    SELECT table_name, CAST(row_number() OVER (PARTITION BY table_name ORDER BY p) AS integer) AS rank,
           title, plot_type, columns, explanation FROM a""",
)
def _(spark, d):
    return rc.recommend_by_role(_roles(spark, d)).withColumn("columns", F.array_join("columns", ","))


# --- sales report ----------------------------------------------------------

_SALES = "try_cast(replace(sales_text, '$', '') AS decimal(18,2))"


def _sales(spark: SparkSession, d: str) -> DataFrame:
    return dirty(spark, d).select(
        F.col("iso_date").alias("Date"), F.col("category").alias("Category"),
        F.col("sales_text").alias("Sales"), F.col("price_gaps").alias("Other Price"),
    )


@query(
    "sales_total_avg",
    f"""{WITH_DIRTY} SELECT round(CAST(sum({_SALES}) AS double), 2) AS total_sales,
        round(CAST(sum({_SALES}) AS double) / count(*), 4) AS average_sales FROM b""",
)
def _(spark, d):
    totals = sa.sales_report(_sales(spark, d)).totals
    return totals.select(
        F.round("total_sales", 2).alias("total_sales"), F.round("average_sales", 4).alias("average_sales")
    )


@query(
    "sales_top5",
    f"""{WITH_DIRTY} SELECT category, round(CAST(sum({_SALES}) AS double), 2) AS total_sales FROM b
        GROUP BY category ORDER BY total_sales DESC LIMIT 5""",
)
def _(spark, d):
    top = sa.sales_report(_sales(spark, d)).top_categories
    return top.withColumn("total_sales", F.round("total_sales", 2))


@query(
    "sales_monthly",
    f"{WITH_DIRTY} SELECT iso_date[1:7] AS month, round(CAST(sum({_SALES}) AS double), 2) AS total_sales FROM b GROUP BY 1",
)
def _(spark, d):
    months = sa.sales_report(_sales(spark, d)).monthly
    return months.withColumn("total_sales", F.round("total_sales", 2))


@query(
    "sales_currency_text",
    f"""{WITH_DIRTY} SELECT '$' || format('{{:,.2f}}', round(CAST(sum({_SALES}) AS double), 2)) AS total_sales,
        '$' || format('{{:,.2f}}', CAST(sum({_SALES}) AS double) / count(*)) AS average_sales FROM b""",
)
def _(spark, d):
    return sa.totals_text(sa.sales_report(_sales(spark, d)).totals)


# --- driver contract -------------------------------------------------------


def entry(spark: SparkSession) -> DataFrame:
    """Flagship query: mean order price per priority of the urgent and high orders."""
    orders = money(table(spark, SMOKE_DIR, "orders"), "o_totalprice")
    intent = Intent(
        "comparison",
        ["o_orderpriority", "o_totalprice"],
        {"o_orderpriority": "urgent|high"},
        "mean",
        ["o_orderpriority"],
    )
    return qu.run_intent(orders, intent).data


def _corpus() -> tuple[dict, dict]:
    """Queries and SQL of the corpus operators, where that subpackage is installed."""
    try:
        import corpus_pipeline
        from framewright.llm import queries as corpus
    except ModuleNotFoundError as gone:
        if gone.name not in ("corpus_pipeline", "framewright.llm", "framewright.llm.queries"):
            raise
        return {}, {}
    oracles = dict(corpus.ORACLES)
    if corpus_pipeline.ORACLE_SQL is not None:
        oracles["pipeline"] = corpus_pipeline.ORACLE_SQL
    return {**corpus.QUERIES, "pipeline": corpus_pipeline.run}, oracles


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**_QUERIES, **_corpus()[0]}


def oracle_sql() -> dict[str, str]:
    return {**_ORACLES, **_corpus()[1]}
