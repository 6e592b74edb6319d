"""Typed elements of mixed files."""

import io
import zipfile
from pathlib import Path

import pytest

from digestry.catalog import QUERIES, files
from digestry.sources import elements

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx(body: str) -> bytes:
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as archive:
        archive.writestr(
            "word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>'
        )
    return held.getvalue()


def paragraph(words: str, inner: str = "") -> str:
    return f"<w:p><w:pPr>{inner}</w:pPr><w:r><w:t>{words}</w:t></w:r></w:p>"


def by_file(frame, *columns):
    out = {}
    for row in sorted(frame.collect(), key=lambda r: (r["path"], r["pos"])):
        out.setdefault(row["path"].rsplit("/", 1)[1], []).append(tuple(row[c] for c in columns))
    return out


def test_types_come_from_the_content(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "notes").write_text(
        "# Head\nmore\r\n\r\nOne  line\nsame paragraph\n- first\n  second line\n2. last\n\n \n\nEnd"
    )
    (tmp_path / "page.bin").write_text(
        "  <!DOCTYPE html><html><head><title>A &amp; B</title><style>p{}</style></head><body>"
        "<script>var t='</p>'</script><h2 class='x'>Part</h2><!-- no --><p>wo<b>rd</b> one<br>two"
        "<ul><li>item &lt;1&gt;</li><li></li></ul><table><tr><td>c1</td><td>c2</td></tr></table>"
        "tail &unknown; \x01\x02 end</body></html>"
    )
    (tmp_path / "a.docx").write_bytes(
        docx(
            paragraph("Name", '<w:pStyle w:val="Title"/>')
            + paragraph("Part", '<w:pStyle w:val="Heading1"/>')
            + paragraph(" ")
            + paragraph("entry", "<w:numPr/>")
            + f"<w:tbl><w:tr><w:tc>{paragraph('cell')}</w:tc></w:tr></w:tbl>"
            + paragraph("Body  text")
        )
    )
    (tmp_path / "blank.txt").write_text(" \n\n ")
    (tmp_path / "wide.txt").write_bytes("Größe\n\nzwei".encode("utf-16"))
    (tmp_path / "marked.txt").write_bytes(b"\xef\xbb\xbfplain")
    got = by_file(elements.read_elements(spark, str(tmp_path)), "kind", "text")
    assert got == {
        "notes": [
            ("heading", "# Head more"), ("paragraph", "One line same paragraph"),
            ("list_item", "- first second line"), ("list_item", "2. last"), ("paragraph", "End"),
        ],
        "page.bin": [
            ("title", "A & B"), ("heading", "Part"), ("paragraph", "word one two"),
            ("list_item", "item <1>"), ("cell", "c1"), ("cell", "c2"),
            ("paragraph", "tail &unknown; end"),
        ],
        "a.docx": [
            ("title", "Name"), ("heading", "Part"), ("list_item", "entry"), ("cell", "cell"),
            ("paragraph", "Body text"),
        ],
        "wide.txt": [("paragraph", "Größe"), ("paragraph", "zwei")],
        "marked.txt": [("paragraph", "plain")],
    }
    joined = elements.read_documents(spark, str(tmp_path), leave_out=("cell", "title"))
    documents = {r["path"].rsplit("/", 1)[1]: r["document"] for r in joined.collect()}
    assert documents["a.docx"] == "Part\n\nentry\n\nBody text" and documents["blank.txt"] == ""
    assert len(documents) == 6


def test_files_are_read_without_a_shuffle(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    for frame in (elements.read_elements, elements.read_documents):
        plan = frame(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("ArrowEvalPython") <= 1


def test_binary_files_need_a_parser(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF\x00one|two")
    with pytest.raises(Exception, match="no parser for binary file"):
        elements.read_elements(spark, str(tmp_path)).collect()

    def parse(content: bytes):
        return [("paragraph", part) for part in content[5:].decode().split("|")]

    rows = elements.read_elements(spark, str(tmp_path), {**elements.PARSERS, b"%PDF": parse})
    assert by_file(rows, "pos", "text") == {"a.pdf": [(0, "one"), (1, "two")]}


def test_small_files_share_tasks(spark, tmp_path):
    for i in range(300):
        (tmp_path / f"{i}.txt").write_text(f"number {i}")
    split = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        rows = elements.read_documents(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() < 40  # a file a task, if opening one counts for 4 MB
        assert {r["document"] for r in rows.collect()} == {f"number {i}" for i in range(300)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)


@pytest.fixture
def bundled(spark, tmp_path):
    """Documents with a repeated id and a null text, and one page."""
    texts = [(i, f"text {i}") for i in range(40)] + [(39, "text 39"), (16 * files.FOLDER, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    pages = spark.createDataFrame([(5, "<html><p>one<li>two</html>")], "page_id long, html string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    return str(tmp_path)


def test_bundles_are_files_of_few_folders(spark, bundled):
    out = Path(files.mixed_files(spark, bundled))
    held = {str(p.relative_to(out)): p.read_text() for p in out.rglob("*") if p.is_file()}
    assert {k: v.count("\n\n") for k, v in held.items() if k.startswith("txt")} == {
        "txt/0/file_no=0": 16, "txt/0/file_no=1": 16, "txt/0/file_no=2": 9, f"txt/1/file_no={files.FOLDER}": 1,
    }
    assert held["txt/0/file_no=1"] == "".join(f"text {i}\n\n" for i in range(16, 32))
    assert held["html/0/file_no=0"] == "<html><p>one<li>two</html>\n"


def test_bundles_of_both_layouts_have_one_place(spark):
    paths = ["file:/a/txt/0/file_no=7", "file:/a/txt/file_no=7/part-0.txt"]
    got = files._placed(spark.createDataFrame([(p,) for p in paths], "path string")).collect()
    assert [tuple(r) for r in got] == [("txt", 7), ("txt", 7)]


def test_ingest_files_gives_every_bundle(spark, bundled):
    got = {(r["folder"], r["file_no"]): r["document"] for r in QUERIES["ingest_files"](spark, bundled).collect()}
    assert set(got) == {("txt", 0), ("txt", 1), ("txt", 2), ("txt", files.FOLDER), ("html", 0)}
    assert got["txt", files.FOLDER] == "" and got["html", 0] == "one"
    assert got["txt", 2].split("\n\n") == [f"text {i}" for i in range(32, 40)] + ["text 39"]
