"""Files that were written from stored texts come back whole; broken ones are rows with their error."""

import io
import re
import zipfile

import pytest
from sedge.plans.queries import QUERIES
from sedge.sources import containers


def squeezed(text):
    return re.sub(r"\s+", " ", text or "").strip()


def test_files_of_a_folder(spark, tmp_path):
    docs = [r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect() if (r.text or "").strip()][:40]
    for r in docs:
        parts = [p for p in re.split(r"\n\s*\n", r.text) if p.strip()]
        (tmp_path / f"{r.doc_id}.docx").write_bytes(containers.write_word(parts))
        (tmp_path / f"{r.doc_id}.pptx").write_bytes(containers.write_slides([p.split("\n") for p in parts] * 12))
        (tmp_path / f"{r.doc_id} a%.txt").write_text(r.text)
    got = {}
    for r in containers.read_files(containers.binary_files(spark, str(tmp_path))).collect():
        got.setdefault(r.path.rsplit("/", 1)[1], []).append(r)
    assert len(got) == 3 * len(docs)
    for r in docs:
        word, slides = got[f"{r.doc_id}.docx"], sorted(got[f"{r.doc_id}.pptx"], key=lambda x: x.part)
        parts = [p for p in re.split(r"\n\s*\n", r.text) if p.strip()]
        assert len(word) == 1 and word[0].success and squeezed(word[0].text) == squeezed(r.text)
        assert len(slides) == 12 * len(parts) == slides[0].parts and [squeezed(s.text) for s in slides] == [squeezed(p) for p in parts * 12]
        assert got[f"{r.doc_id} a%.txt"][0].text == r.text.strip()


def zipped(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for k, v in parts.items():
            z.writestr(k.replace("__", "/"), v)
    return out.getvalue()


def test_broken_files_stop_nothing(spark):
    good = containers.write_word(["fine"])
    outside = io.BytesIO()
    with zipfile.ZipFile(outside, "w") as z:
        z.writestr("../word/document.xml", "x")
    rows = {
        "a.docx": good, "b.docx": good[: len(good) // 2], "c.docx": b"no zip", "d.docx": zipped(other="x"), "e.docx": zipped(word__document="<a"), "f.pptx": good, "g.docx": outside.getvalue(), "h.json": b'{"a": [1,', "i.json": b'{"b": "\xc3\xa9"}',
        "j.csv": b'x,"y,z"\n\n1,2\n', "k.bin": b"?", "l": b"?", "m.txt": b"\xff\xfe", "n.txt": b"  ", "o.md": b"# t\n", "p.docx": zipped(**{"word__document.xml": "<!DOCTYPE x><a/>"}), "q.docx": None,
        "r.docx": zipped(**{"word__document.xml": b"0" * (32 << 20)}),
    }
    df = spark.createDataFrame([(k, bytearray(v) if v is not None else None) for k, v in rows.items()], "path string, content binary").repartition(3)
    got = {r.path: r for r in containers.read_files(df).collect()}
    assert {k for k, r in got.items() if r.success} == {"a.docx", "i.json", "j.csv", "o.md"} and len(got) == len(rows)
    assert got["a.docx"].text == "fine" and got["i.json"].text == '{\n  "b": "é"\n}' and got["j.csv"].text == "x\ty,z\n1\t2" and got["o.md"].text == "# t"
    assert all(r.error and r.text is None and r.parts == 0 for r in got.values() if not r.success) and "large" in got["r.docx"].error and "out of" in got["g.docx"].error
    assert containers.read_files(df.limit(0)).count() == 0


@pytest.mark.parametrize("sf", ["0.001"])
def test_query_gives_all_documents_back(spark, sf):
    path = f"/root/testdata/sf{sf}"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in QUERIES["s3_s11_s12_containers"](spark, path).collect()}
    assert set(got) == set(docs)
    for i, t in docs.items():
        words = len((t or "").split())
        assert got[i].success == (words > 0) and got[i].words == words, i


def test_text_is_cleaned_for_markup():
    assert containers.word_text(containers.write_word(["a\x00b\x0bc <&> \t d\ne"])) == "abc <&> \t d\ne"
    assert containers.slide_texts(containers.write_slides([[], ["x", "", "y"]])) == ["第 1 页", "x\ny"]


def test_results_are_handed_on_before_the_batch_ends(monkeypatch):
    """Large rows leave a task in pieces while the rest is still to be read, and nothing of them is lost."""
    monkeypatch.setattr(containers, "HELD", 1000)
    rows, read = [(f"{k}.txt", b"x" * 400) for k in range(20)] + [("a.txt", None), ("b.txt", b"y" * 5000)], []
    got = containers._handed_on((read.append(r) or r for r in rows), containers._FILES)
    first = next(got)
    assert first.num_rows == len(read) == 3
    rest = list(got)
    assert max(b.num_rows for b in rest) == 4 and [tuple(r.values()) for b in [first, *rest] for r in b.to_pylist()] == rows
