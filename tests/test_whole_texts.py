"""Queries over whole texts, longer than those of the driver's tables."""

from collections import defaultdict

from marlstone.plans import registry


def read_in_order(text):
    """Lines, blanks and characters of the boxes of ``reading_order``, word by word."""
    boxes = [
        (1000 - n * 12.5 - w % 2, w * 12.5, n, w, word) for n, line in enumerate(text.split("\n")) for w, word in enumerate(line.split(" "))
    ]
    boxes.sort(key=lambda b: (-round(b[0] / 5), *b[1:4]))
    lines = defaultdict(list)
    for b in boxes:
        lines[round(b[0] / 5), round(b[1] / 500)].append(b)
    tops = [v[0][0] for v in lines.values()]
    gaps = sum(a - b >= 25 for a, b in zip(tops, tops[1:]))
    texts = [" ".join(b[4] for b in v) for v in lines.values()]
    return len(texts) + gaps, texts.count("") + gaps, sum(map(len, texts))


def test_reading_order_keeps_every_word(spark, tmp_path):
    texts = [
        "short text", " ".join(f"w{i}" for i in range(250)), "\n".join(f"line {i} of many" for i in range(70)),
        "\n".join(" ".join(f"{n}.{w}" for w in range(130)) for n in range(45)), "a\n\n\n\n\nb",
    ]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.lines, r.blanks, r.chars) for r in registry.queries()["reading_order"](spark, str(tmp_path)).collect()}
    assert got == {i: read_in_order(t) for i, t in enumerate(texts)}


def test_between_block_takes_long_articles(spark, tmp_path):
    pages = [(n, "<html><article>" + "<p>x" * n + "</article><footer>") for n in (3, 500)]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.start_line, r.lines, r.end_line) for r in registry.queries()["between_block"](spark, str(tmp_path)).collect()}
    assert got == {n: (2, n, n + 3) for n, _ in pages}
