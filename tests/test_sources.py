"""CSV, JSON and workbook scans; CSV sink."""

import datetime as dt
import zipfile

import pytest
from helpers import rows

from framewright import convert_to_csv, load, read_table
from framewright.operators.inference import infer_types, json_types
from framewright.plans.load import first_rows
from framewright.sources.delimited import header_names, read_csv
from framewright.sources.records import read_json
from framewright.sources.tables import source_format
from framewright.sources.workbook import read_workbooks


def put(folder, name, text):
    path = folder / name
    path.write_text(text)
    return str(path)


def test_header_names():
    assert header_names(["a", "a", "", "a", "b"]) == ["a", "a.1", "Unnamed: 2", "a.2", "b"]
    assert header_names(["a", "a", "a.1"]) == ["a", "a.2", "a.1"]
    assert header_names(["Sales", "sales", "SALES"]) == ["Sales", "sales.1", "SALES.2"]


def test_csv_cells(spark, tmp_path):
    path = put(
        tmp_path, "a.csv",
        'id,text,id\n1,"say ""hi"", you",NA\n2,n/a,x\n3," none ",\n4,"two\nlines",null\n5,,None\n',
    )
    frame = read_csv(spark, path)
    assert frame.columns == ["id", "text", "id.1"]
    assert rows(frame, "id") == [
        ("1", 'say "hi", you', None), ("2", None, "x"), ("3", " none ", None),
        ("4", "two\nlines", None), ("5", None, None),
    ]


def test_csv_types_of_whole_file(spark, tmp_path):
    path = put(tmp_path, "a.csv", "a,b,f,g,h\n1,2,True,true,x\n,3,,False,2024-01-01\n4,4,False,TRUE,\n")
    typed, _ = infer_types(read_csv(spark, path), raw_text=True)
    assert typed.dtypes == [
        ("a", "double"), ("b", "bigint"), ("f", "string"), ("g", "boolean"), ("h", "string")
    ]


def test_csv_folder_checks_headers(spark, tmp_path):
    put(tmp_path, "a.csv", "x,y\n1,2\n")
    put(tmp_path, "b.csv", "x,y\n3,4\n")
    assert rows(read_csv(spark, str(tmp_path)), "x") == [("1", "2"), ("3", "4")]
    put(tmp_path, "c.csv", "y,x\n5,6\n")
    with pytest.raises(Exception, match="header"):
        read_csv(spark, str(tmp_path)).collect()


def test_file_order(spark, tmp_path):
    path = put(tmp_path, "a.csv", "v\n" + "\n".join(str(i * 37 % 100) for i in range(100)) + "\n")
    frame = read_csv(spark, path, row_order=True)
    assert [r[0] for r in rows(first_rows(frame, 4))] == ["0", "37", "74", "11"]
    loaded = load(spark, path, row_order=True)
    assert [r["v"] for r in first_rows(loaded.data, 4).collect()] == [0, 37, 74, 11]


def test_json_shapes(spark, tmp_path):
    records = put(tmp_path, "r.json", '[{"b": 1, "a": "x"},\n {"b": 2, "a": null, "z": true}]')
    lines = put(tmp_path, "l.json", '{"b": 1, "a": "x"}\n{"b": 2, "z": true}\n')
    assert read_json(spark, records).columns == ["b", "a", "z"]
    assert rows(read_json(spark, records), "b") == rows(read_json(spark, lines), "b") == [
        (1, "x", None), (2, None, True)
    ]
    keyed = put(tmp_path, "k.json", '{"b": {"0": 1, "1": 2},\n "a": {"0": "x", "1": null}}')
    listed = put(tmp_path, "v.json", '{"b": [1, 2], "a": ["x", null]}')
    for path in (keyed, listed):
        assert rows(json_types(read_json(spark, path)), "b") == [(1, "x"), (2, None)]


def test_json_reader_types(spark, tmp_path):
    path = put(
        tmp_path, "r.json",
        '[{"z":"1","a":"2024-01-01","date":"2024-01-02","created_at":1700000000,"n":{"q":1},"l":[1,2],'
        '"m":"007","ms_at":1700000000123,"small_at":5},'
        '{"z":null,"a":"x","date":"2024-01-03","created_at":1700000001,"n":null,"l":[],"m":"8",'
        '"ms_at":1700000000456,"small_at":6}]',
    )
    frame = json_types(read_json(spark, path))
    assert frame.dtypes == [
        ("z", "double"), ("a", "string"), ("date", "timestamp_ntz"), ("created_at", "timestamp_ntz"),
        ("n", "string"), ("l", "string"), ("m", "bigint"), ("ms_at", "timestamp_ntz"), ("small_at", "bigint"),
    ]
    row = frame.orderBy("m").first()
    assert row["created_at"] == dt.datetime(2023, 11, 14, 22, 13, 20)
    assert row["ms_at"] == dt.datetime(2023, 11, 14, 22, 13, 20, 123000)
    assert (row["n"], row["l"]) == ('{"q":1}', "[1,2]")
    assert load(spark, path).data.count() == 2


CELLS = {
    "one": [
        '<c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>day</t></is></c><c r="C1" t="s"><v>1</v></c>',
        '<c r="A2"><v>1.5</v></c><c r="B2" s="1"><v>45306.25</v></c><c r="C2" t="b"><v>1</v></c>',
        None,
        '<c r="A4"><v>2</v></c><c r="C4" t="e"><v>#N/A</v></c>',
        "",
    ],
    "two": [
        '<c r="A1" t="s"><v>1</v></c><c r="B1" t="s"><v>0</v></c>',
        '<c r="A2" t="b"><v>0</v></c><c r="B2"><v>7</v></c>',
    ],
}


def workbook(path, cells):
    sheet = "".join(
        f'<row r="{i}">{c}</row>' for i, c in enumerate(cells, 1) if c is not None
    )
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr(
            "xl/workbook.xml",
            f'<workbook {main} xmlns:r="urn:rel"><sheets><sheet name="First" sheetId="9" r:id="rId7"/>'
            '<sheet name="Other" sheetId="1" r:id="rId1"/></sheets></workbook>',
        )
        z.writestr(
            "xl/_rels/workbook.xml.rels",
            '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/>'
            '<Relationship Id="rId7" Target="/xl/worksheets/sheet2.xml"/></Relationships>',
        )
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {main}><sheetData>{sheet}</sheetData></worksheet>")
        z.writestr(
            "xl/sharedStrings.xml",
            f'<sst {main}><si><t>amount</t></si><si><r><t>fl</t></r><r><t>ag</t></r></si></sst>',
        )
        z.writestr(
            "xl/styles.xml",
            f'<styleSheet {main}><cellXfs><xf numFmtId="0"/><xf numFmtId="22"/></cellXfs></styleSheet>',
        )


def test_workbooks(spark, tmp_path):
    for name, cells in CELLS.items():
        workbook(tmp_path / f"{name}.xlsx", cells)
    frame = read_workbooks(spark, str(tmp_path))
    assert sorted(frame.columns) == ["amount", "day", "flag"]
    got = sorted(rows(frame.select("amount", "day", "flag")), key=str)
    assert got == sorted(
        [("1.5", "2024-01-15 06:00:00", "True"), (None, None, None), ("2", None, None), ("7", None, "False")],
        key=str,
    )
    one = read_table(spark, str(tmp_path / "one.xlsx"))
    typed, _ = infer_types(one, raw_text=True)
    assert dict(typed.dtypes) == {"amount": "double", "day": "timestamp_ntz", "flag": "string"}


def test_converted_csv_reads_back(spark, tmp_path):
    frame = spark.sql(
        """SELECT 1 AS a, 'x, "y"' AS b, timestamp_ntz'2024-01-02 00:00:00' AS t
           UNION ALL SELECT NULL, NULL, timestamp_ntz'2024-01-02 03:04:05'"""
    )
    path = convert_to_csv(frame, str(tmp_path / "out"))
    back, _ = infer_types(read_csv(spark, path), raw_text=True)
    assert rows(back, "t") == [
        (1.0, 'x, "y"', dt.datetime(2024, 1, 2)), (None, None, dt.datetime(2024, 1, 2, 3, 4, 5))
    ]


def test_formats(spark, tmp_path):
    assert source_format("/x/Y.CSV") == "csv"
    with pytest.raises(ValueError):
        source_format("a.txt")
    path = str(tmp_path / "p.parquet")
    spark.sql("SELECT double('NaN') AS d").write.parquet(path)
    assert rows(read_table(spark, path)) == [(None,)]


def test_write_keeps_blanks_and_fractions(spark, tmp_path):
    from framewright.sources.delimited import write_csv

    df = spark.sql("SELECT '  a b  ' AS t, timestamp_ntz'2024-01-01 10:00:00.123456' AS n, timestamp'2024-01-01 10:00:00' AS z")
    write_csv(df, str(tmp_path / "out"))
    found = read_csv(spark, str(tmp_path / "out")).first()
    assert tuple(found) == ("  a b  ", "2024-01-01 10:00:00.123456", "2024-01-01 10:00:00")


def test_surplus_cells_raise_and_short_rows_do_not(spark, tmp_path):
    short = put(tmp_path, "short.csv", "a,b,c\n1,2\n3,4,5\n")
    assert rows(read_csv(spark, short), "a") == [("1", "2", None), ("3", "4", "5")]
    assert read_csv(spark, short).count() == 2
    for i, line in enumerate(("3,4,5,6", "3,4,5,")):
        long = put(tmp_path, f"long{i}.csv", f"a,b,c\n1,2,3\n{line}\n")
        with pytest.raises(Exception, match="more than 3 cells"):
            read_csv(spark, long).collect()
        with pytest.raises(Exception, match="more than 3 cells"):
            read_csv(spark, long).select("b").collect()


def test_malformed_json_raises(spark, tmp_path):
    path = put(tmp_path, "bad.json", '{"a": 1}\n{"a": \n')
    with pytest.raises(Exception):
        read_json(spark, path).collect()


def test_json_lines_whose_first_record_holds_lists(spark, tmp_path):
    path = put(tmp_path, "lists.json", '{"tags":["a","b"]}\n{"tags":["c"]}\n')
    assert rows(read_json(spark, path), "tags") == [('["a","b"]',), ('["c"]',)]


def test_parts_are_ordered_by_number(spark, tmp_path):
    put(tmp_path, "part-99999.csv", "v\nfirst\n")
    put(tmp_path, "part-100000.csv", "v\nsecond\n")
    scan = read_csv(spark, str(tmp_path), row_order=True)
    assert [r["v"] for r in first_rows(scan, 2).collect()] == ["first", "second"]


def test_only_files_with_split_cells_are_cut(spark, tmp_path):
    put(tmp_path, "a.csv", "id,Text,text\n1,plain,x\n2,also,y\n")
    put(tmp_path, "b.csv", 'id,Text,text\n3,"two\nlines",z\n')
    frame = read_csv(spark, str(tmp_path))
    assert rows(frame, "id") == [
        ("1", "plain", "x"), ("2", "also", "y"), ("3", "two\nlines", "z"),
    ]
    # The other files are parsed where they are read, chosen by their names.
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan csv") == 1 and "file_path" in plan
    assert read_csv(spark, str(tmp_path), multiline=True).count() == 3


def test_header_over_lines(spark, tmp_path):
    path = put(tmp_path, "a.csv", '"first\nname",b\n1,2\n')
    assert rows(read_csv(spark, path)) == [("1", "2")]
