"""Sources, line layout and spelling on small fixtures."""

import json

from marlstone.operators import spelling
from marlstone.sources import lines as S


def letter(value, x, y):
    return {"Value": value, "GlyphRectangle": {"BottomLeft": {"X": x, "Y": y - 8.0}, "TopRight": {"X": x + 5.0, "Y": y}}}


def test_page_cache_to_lines(spark, tmp_path):
    word = lambda t, x, y: {"Letters": [letter(c, x + 5.0 * i, y) for i, c in enumerate(t)]}
    page = [{"TextLines": [{"Words": [word("Serial", 10.0, 700.0), word("No", 60.0, 701.0)]}, {"Words": [word("below", 10.0, 650.0)]}]}]
    (tmp_path / "page-1.json").write_text(json.dumps(page))
    (tmp_path / "page-2.json").write_text("[]")
    words = S.read_page_cache(spark, str(tmp_path))
    rows = words.selectExpr("'d' AS doc_id", "page_no", "CAST(block * 10000 + line * 100 + word_no AS BIGINT) AS word_no", "text", "top", "left")
    got = [(r.page_no, r.line_no, r.text) for r in S.reading_order(rows).orderBy("line_no").collect()]
    assert got == [(1, 0, "Serial No"), (1, 1, ""), (1, 2, "below")]


def test_licence_map_last_row_wins(spark, tmp_path):
    path = tmp_path / "map.csv"
    path.write_text("Filename,LicenceNumber\na/b/one.pdf,1/2/3\ntwo.pdf,4/5/6\nx/three.pdf,1/2/3\n\n")
    got = {r.licence_number: r.filename for r in S.read_licence_map(spark, str(path)).collect()}
    assert got == {"1/2/3": "three.pdf", "4/5/6": "two.pdf"}


def test_name_and_word_lists(spark, tmp_path):
    (tmp_path / "names.csv").write_text("FirstForename\nAnna\nanna\nThe\nJo\nMark\n")
    (tmp_path / "words.txt").write_text("Water\n\nwater\nMill\n")
    assert sorted(r.name for r in S.read_first_names(spark, str(tmp_path / "names.csv")).collect()) == ["anna", "mark"]
    assert sorted(r.word for r in S.read_lexicon(spark, str(tmp_path / "words.txt")).collect()) == ["mill", "water"]


def test_ocr_lines_and_cost_order(spark):
    rows = [(1, 1, 1, 0, "a ’b’", 90.0, 5.0), (1, 1, 1, 1, " . ", 95.0, 6.0), (1, 1, 1, 2, "c", 10.0, 7.0)]
    lines = spark.createDataFrame(rows, "doc_id int, page_no int, image_no int, ord int, text string, y double, x double")
    assert [(r.line_no, r.text) for r in S.ocr_lines(lines).orderBy("line_no").collect()] == [(0, 'a "b"'), (1, "c")]
    assert [r.text for r in S.cloud_order(lines).orderBy("ord").collect()] == ["c", "a ’b’", " . "]
    found = spark.createDataFrame([(1, "A"), (1, "B"), (2, "A")], "doc_id int, group string")
    docs = spark.createDataFrame([(1, "x"), (2, "y")], "doc_id int, text string")
    assert [r.doc_id for r in S.staged_sources(docs, found, ["A", "B"], docs).collect()] == [2]


def test_spelling(spark):
    lexicon = spark.createDataFrame([(w,) for w in "abstraction of water from the river licence point mid farm".split()], "word string")
    texts = ["Abstr action of watre", "Mr Watre Licnce", "the rivers J.B.C AB x", "from teh mdi river", "unheardofword of", "", "lic ence"]
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc_id int, line_no int, text string")
    got = [r.text for r in spelling.corrected(lines, lexicon).orderBy("line_no").collect()]
    assert got == ["Abstraction of water", "Mr Watre Licnce", "the rivers J.B.C AB x", "from the mid river", "unheardofword of", "", "licence"]
    assert spelling.corrected(lines.limit(0), lexicon).collect() == []
