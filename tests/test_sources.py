"""Files read as documents."""

from sedge.sources.files import text_files


def test_text_and_markdown_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("  one\ntwo \n")
    (tmp_path / "b.md").write_text("intro\n# The title\nbody")
    (tmp_path / "c.md").write_text("no heading")
    (tmp_path / "blank.txt").write_text(" \n")
    (tmp_path / "other.bin").write_text("x")
    got = {r.source: (r.type, r.title, r.text) for r in text_files(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": ("txt", "a.txt", "one\ntwo"), "b.md": ("md", "The title", "intro\n# The title\nbody"), "c.md": ("md", "c.md", "no heading")}


def test_no_files(spark, tmp_path):
    assert text_files(spark, str(tmp_path)).count() == 0
