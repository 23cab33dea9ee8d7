"""Workbooks read in tasks: the sheet that is taken, kinds of cells, blanks, blocks, several files."""

import zipfile
from xml.sax.saxutils import escape

import pytest

from stacksight.operators import ingest
from stacksight.sources import sheets

HEAD = '<?xml version="1.0" encoding="UTF-8"?>'
NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def cell(ref, value):
    if value is None:
        return ""
    if isinstance(value, tuple):  # a shared string, or a flag
        return f'<c r="{ref}" t="{value[0]}"><v>{value[1]}</v></c>'
    if isinstance(value, str):
        return f'<c r="{ref}" t="inlineStr"><is><r><t>{escape(value[:2])}</t></r><r><t xml:space="preserve">{escape(value[2:])}</t></r></is></c>'
    return f'<c r="{ref}"><v>{value}</v></c>'


def name(k):
    return (chr(64 + k // 26) if k >= 26 else "") + chr(65 + k % 26)


def workbook(path, tables, shared=()):
    """tables: sheet name to rows; a row is a list of cells, or (row number, list)."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'{HEAD}<workbook {NS} xmlns:r="r"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(tables)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f"{HEAD}<Relationships>" + "".join(f'<Relationship Id="rId{k}" Target="worksheets/sheet{k}.xml"/>' for k in range(len(tables))) + "</Relationships>")
        if shared:
            z.writestr("xl/sharedStrings.xml", f"{HEAD}<sst {NS}>" + "".join(f"<si><t>{escape(x)}</t></si>" for x in shared) + "</sst>")
        for k, rows in enumerate(tables.values()):
            lines = []
            for at, row in enumerate(rows, 1):
                at, row = row if isinstance(row, tuple) else (at, row)
                lines.append(f'<row r="{at}">' + "".join(cell(f"{name(c)}{at}", v) for c, v in enumerate(row)) + "</row>")
            z.writestr(f"xl/worksheets/sheet{k}.xml", f"{HEAD}<worksheet {NS}><sheetData>{''.join(lines)}</sheetData></worksheet>")


def test_master_before_the_first_sheet(spark, tmp_path):
    rows = [["Title", ("s", 0), "Book #", None, "Done"], ["Stone & Sons", ("s", 1), 2, "no header", ("b", 1)], (5, [None, "  ", None]), (9, ["Fall", None, 45292, None, ("b", 0)])]
    workbook(tmp_path / "a.xlsx", {"Notes": [["x"], ["y"]], "Master": rows}, ["Author", "Ann <Bee>"])
    got = sheets.read_xlsx(spark, str(tmp_path / "a.xlsx"), "row")
    assert got.columns == ["row", "Title", "Author", "Book #", "Done"]
    assert sorted(tuple(r) for r in got.collect()) == [(2, "Stone & Sons", "Ann <Bee>", "2", "TRUE"), (9, "Fall", "", "45292", "FALSE")]
    workbook(tmp_path / "b.xlsx", {"Mine": [["Title"], ["One"]], "Other": [["No"], ["No"]]})
    assert [r.Title for r in ingest.load(spark, str(tmp_path / "b.xlsx")).collect()] == ["One"]


def test_a_sheet_comes_in_blocks(spark, tmp_path, monkeypatch):
    workbook(tmp_path / "long.xlsx", {"Master": [["Title", "Author", "Series", "Book #", "Published"]] + [[f"T{k}", "Ann Bee", "Saga", k, 36526 + k] for k in range(3500)]})
    got = ingest.load(spark, str(tmp_path / "long.xlsx"))
    rows, unknown = ingest.mapped(got)
    typed = {r.title: (r.book_number, str(r.publication_date)) for r in ingest.typed(rows).select("title", "book_number", "publication_date").collect()}
    assert unknown == [] and len(typed) == 3500 and typed["T0"] == (0.0, "2000-01-01") and typed["T3499"] == (3499.0, "2009-07-31")
    whole = [n for batch in sheets._blocks(False)(iter([_files(tmp_path / "long.xlsx")])) for n in [batch.num_rows]]
    assert whole == [1000, 1000, 1000, 500]


def _files(path):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([str(path)]), pa.array([path.read_bytes()])], ["path", "content"])


def test_several_files_and_what_is_no_sheet(spark, tmp_path):
    for k in range(3):
        workbook(tmp_path / f"f{k}.xlsx", {"S": [["Title", "Author"], [f"T{k}", "A"]]})
    assert sorted(r.Title for r in sheets.read_xlsx(spark, str(tmp_path / "*.xlsx")).collect()) == ["T0", "T1", "T2"]
    workbook(tmp_path / "g.xlsx", {"S": [["Other"], ["x"]]})
    with pytest.raises(ValueError, match="differ"):
        sheets.read_xlsx(spark, str(tmp_path / "*.xlsx"))
    workbook(tmp_path / "empty.xlsx", {"S": []})
    with pytest.raises(ValueError, match="no header"):
        sheets.read_xlsx(spark, str(tmp_path / "empty.xlsx"))
    for bad in ("x.xls", "x.txt"):
        with pytest.raises(ValueError):
            ingest.load(spark, bad)
