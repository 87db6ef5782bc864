"""Archives, workbooks and the domain loader on files written for the test."""

from __future__ import annotations

import zipfile

import pytest

from scholarium.sources import archives, domains


def pack(path, members: dict[str, bytes], method=zipfile.ZIP_DEFLATED):
    with zipfile.ZipFile(path, "w", method) as z:
        for name, data in members.items():
            z.writestr(name, data)


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def test_archives_prefer_a_member_and_unite_headers(spark, tmp_path):
    big = b"\xef\xbb\xbfA^B^C\r\n" + b"".join(b"%d^x %d^*\r\n" % (k, k) for k in range(5000))
    pack(tmp_path / "sb_ca2023_all_csv_v1.zip", {"readme.txt": b"A^B\nno^no\n", "sb_ca2023_all_csv_v1.txt": big, "other.csv": b"q"})
    pack(tmp_path / "sb_ca2024_all_csv_v1.zip", {"only.TXT": b'C^A^D\n"c^1\nline"^  ^\xe9\nshort\n\n1^2^3^4^5\n'}, zipfile.ZIP_STORED)
    pack(tmp_path / "sb_ca2025_all_csv_v1.zip", {"none.csv": b"A\n1\n"})
    (tmp_path / "sb_ca2026_all_csv_v1.zip").write_bytes(b"not a zip")
    listed = archives.zip_members(spark, str(tmp_path), prefer="all_csv_v1")
    status = {r["file"][5:9]: (r["member"], r["status"]) for r in listed.collect()}
    assert status["2023"] == ("sb_ca2023_all_csv_v1.txt", "ok") and status["2024"] == ("only.TXT", "ok")
    assert status["2025"] == (None, "no .txt member") and status["2026"][1].startswith("not an archive")
    got = archives.read_zip(spark, str(tmp_path))
    assert got.columns == ["A", "B", "C", "D", "_source_file"] and got.count() == 5003
    new = rows(got.where("_source_file like '%2024%'"), "A", "B", "C", "D")
    assert new == rows_of((None, None, "c^1\nline", "é"), (None, None, "short", None), ("2", None, "1", "3"))
    assert rows(got.where("A in ('0', '4999')"), "A", "B", "C") == [("0", "x 0", None), ("4999", "x 4999", None)]


def rows_of(*x):
    return sorted(x, key=repr)


def test_many_members_spread_over_tasks(spark, tmp_path):
    pack(tmp_path / "all.zip", {f"m{k}.txt": b"A\n" + b"%d\n" % k * 50 for k in range(20)})
    assert archives.zip_members(spark, str(tmp_path / "all.zip")).count() == 20
    members = archives._archives(spark, str(tmp_path / "all.zip")).mapInArrow(archives._directory(None, ".txt", True), archives._MEMBER)
    dealt = members.repartition(8, "file", "member").mapInArrow(archives._cells("^", "utf-8", False), archives._ROW)
    assert dealt.count() == 1000


def workbook(path, sheets: dict[str, list[list]]):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    shared: list[str] = []

    def cell(ref, v):
        if v is None:
            return ""
        if isinstance(v, str):
            shared.append(v)
            return f'<c r="{ref}" t="s"><v>{len(shared) - 1}</v></c>'
        return f'<c r="{ref}"><v>{v}</v></c>'

    parts = {}
    for i, grid in enumerate(sheets.values(), 1):
        body = "".join(f'<row r="{r}">' + "".join(cell(f"{chr(65 + c)}{r}", v) for c, v in enumerate(line)) + "</row>" for r, line in enumerate(grid, 1))
        parts[f"xl/worksheets/sheet{i}.xml"] = f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>"
    listed = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1))
    parts["xl/workbook.xml"] = f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{listed}</sheets></workbook>'
    parts["xl/_rels/workbook.xml.rels"] = "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>"
    parts["xl/sharedStrings.xml"] = f"<sst {ns}>" + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>"
    pack(path, {k: v.encode() for k, v in parts.items()})


def test_workbooks(spark, tmp_path):
    workbook(tmp_path / "frpm2324.xlsx", {"Notes": [["x", "y", "z"]], "FRPM School-Level data": [["Title"], [None, "County", "School", None, "Rate"], ["1", "Alameda", "A", None, 12.5], [], ["2", "Alpine", "*", "p"]], "Last": [["q"]]})
    workbook(tmp_path / "frpm2425.xlsx", {"School-Level": [["County", "School", "New"], ["Butte", "B", 7]]})
    workbook(tmp_path / "frpm2526.xlsx", {"School-Level": [["no"], ["header"]]})
    (tmp_path / "frpm2627.xlsx").write_bytes(b"no")
    got = domains.load_domain(spark, str(tmp_path), "frpm")
    assert got.columns == ["col_0", "County", "School", "col_3", "Rate", "New", "_source_file", "_domain", "_loaded_at"]
    assert rows(got, "col_0", "County", "School", "col_3", "Rate", "New") == rows_of(("1", "Alameda", "A", None, "12.5", None), ("2", "Alpine", None, "p", None, None), (None, "Butte", "B", None, None, "7"))
    assert domains.load_domain(spark, str(tmp_path), "frpm", "24").count() == 1


def test_domain_loader_unites_years(spark, tmp_path):
    write = lambda name, text: (tmp_path / name).write_bytes(text.encode("latin1"))
    write("chronicabsenteeism23.txt", "ï»¿Year\tName\tRate\r\n22-23\tJosé\t*\r\n22-23\t\t5\r\n")
    write("chronicabsenteeism24.txt", "Year\tName\tNew\n23-24\tB\tn\n")
    write("chronicabsenteeism24b.txt", "Year\tName\tNew\n23-24\tC\t\n")
    write("chronicabsenteeism24 (1).txt", "Year\tName\tNew\n23-24\tcopy\t\n")
    write("chronicabsenteeism25.txt", "")
    write("chronicdownload24.txt", "Year\tOther\n1\t2\n")
    got = domains.load_domain(spark, str(tmp_path), "chronic_absenteeism")
    assert got.columns == ["Year", "Name", "Rate", "New", "_source_file", "_domain", "_loaded_at"]
    assert rows(got, "Year", "Name", "Rate", "New") == rows_of(("22-23", "José", None, None), ("22-23", None, "5", None), ("23-24", "B", None, "n"), ("23-24", "C", None, None))
    assert rows(domains.row_counts(got), "_source_file", "rows") == [("chronicabsenteeism23.txt", 2), ("chronicabsenteeism24.txt", 1), ("chronicabsenteeism24b.txt", 1)]
    # one scan a shape of header
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 2
    one = domains.load_domain(spark, str(tmp_path), "chronic_absenteeism", "24")
    assert {r["Name"] for r in one.collect()} == {"B", "C"} and one.where("_loaded_at is null").count() == 0
    assert domains.load_domain(spark, str(tmp_path), "expulsion").count() == 0
    assert len(domains.CATALOG) == 23
    with pytest.raises(KeyError):
        domains.load_domain(spark, str(tmp_path), "nothing")
    with pytest.raises(ValueError, match="two digits"):
        domains.load_domain(spark, str(tmp_path), "frpm", "*")
