"""Files, pages that are hard to read, task messages and sparse vectors against values made by hand."""

from __future__ import annotations

import io
import json
import zipfile

from pyspark.sql import functions as F

from tessera.operators import html, markdown, retrieval
from tessera.session import written
from tessera.sources import files
from tessera.streaming import messages

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(body: str, styles: str = "") -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f"<w:styles {W}>{styles}</w:styles>")
    return out.getvalue()


def paragraph(text: str, style: str = "", bold: bool = False) -> str:
    return f"<w:p><w:pPr><w:pStyle w:val='{style}'/></w:pPr><w:r>{'<w:rPr><w:b/></w:rPr>' if bold else ''}<w:t>{text}</w:t></w:r></w:p>"


def test_files_to_markdown(spark, tmp_path):
    styles = "".join(f"<w:style w:styleId='{i}'><w:name w:val='{n}'/></w:style>" for i, n in (("H1", "heading 1"), ("LB", "List Bullet"), ("LB2", "List Bullet 2")))
    body = paragraph("Top", "H1") + paragraph("bold", bold=True) + paragraph("one", "LB") + paragraph("deep", "LB2") + paragraph("two", "LB")
    body += "<w:tbl>" + "".join(f"<w:tr>{''.join(f'<w:tc>{paragraph(c)}</w:tc>' for c in r)}</w:tr>" for r in ("ab", "12")) + "</w:tbl>"
    made = {
        "a.md": b"# hi\n\xff there", "b.MARKDOWN": b"x", "c.htm": f"<main><h1>T</h1><p>{'prose ' * 40}</p></main>".encode(), "d.docx": docx(body, styles), "e.docx": b"PK no zip",
        "f.docx": docx(""), "g.xyz": b"?", "h.html": b"", "i.html": b"<p>short</p>", "plain": b"no extension",
    }
    for name, content in made.items():
        (tmp_path / name).write_bytes(content)
    read = files.read_files(spark, str(tmp_path))
    empty = spark.createDataFrame([("h.html", "h.html", "html", b"", 0)], read.schema)  # Spark's source passes over empty files
    got = {r.name: r for r in files.to_markdown(read.unionByName(empty)).collect()}
    assert {k: got[k].error for k in made} == {
        "a.md": None, "b.MARKDOWN": None, "c.htm": None, "d.docx": None, "e.docx": "not_docx", "f.docx": "no_content", "g.xyz": "unsupported_format", "h.html": "empty_file",
        "i.html": "too_little_content", "plain": "unsupported_format",
    }
    assert got["a.md"].markdown == "# hi\n there" and got["a.md"].pages_or_length == 11 and got["c.htm"].markdown.startswith("# T\n\nprose")
    assert got["d.docx"].markdown == "# Top\n\n**bold**\n\n- one\n  - deep\n- two\n\n| a | b |\n| --- | --- |\n| 1 | 2 |"


def test_pages_that_are_hard_to_read():
    prose = "prose " * 40
    made, _, error = html.render("<div>" * 3000 + prose + "</div>" * 3000 + "<p>after</p>", "http://h/")
    assert error is None and "prose prose" in made and "after" in made
    assert "[x](http://[y)" in html.render(f"<p>{prose}<a href='http://[y'>x</a></p>", "http://h/")[0]
    cells = html.render(f"<p>{prose}</p><table><tr><td colspan='²'>a</td><td colspan='3000000' rowspan='-1'>b</td></tr></table>", "http://h/")[0]
    assert cells.count("b") < 2100
    assert html.render("<![if foo]>" + prose, "http://h/")[2] in (None, "unreadable")


def test_rules_are_three_equal_marks():
    kinds = {line: next(markdown.elements(f"x\n\n{line}"), None) and [e[0] for e in markdown.elements(f"x\n\n{line}")][-1] for line in ("---", "- - -", " * * * ", "___", "--*", "----", "--")}
    assert [k for k, v in kinds.items() if v == "hr"] == ["---", "- - -", " * * * ", "___"]


def task(**more) -> dict:
    return dict.fromkeys(list(messages.FIELDS)[: messages.REQUIRED], "x") | {"user_id": 1, "dataset_id": "2"} | more


VALUES = {
    "plain": json.dumps(task(parser_backend="naive")), "wrapped": json.dumps({"payload": task(document_parse_file_id="f")}), "list": "[1]", "broken": "{", "none": None,
    "missing": json.dumps(task(file_type=" ", source_bucket=None)), "letters": json.dumps(task(user_id="one")), "payload": json.dumps({"payload": 3}),
}
SCHEMA = "topic string, key string, value string, headers map<string,string>"


def test_envelopes(spark):
    rows = spark.createDataFrame([("t", k, v, None) for k, v in VALUES.items()], SCHEMA)
    got = {r.key: r for r in messages.parsed(rows).collect()}
    assert {k: r.error for k, r in got.items()} == {
        "plain": None, "wrapped": None, "list": "invalid_json", "broken": "invalid_json", "none": "invalid_json", "missing": "missing: file_type, source_bucket", "letters": "not a number: user_id", "payload": "invalid_payload",
    }
    assert got["plain"].task.pdf_parser_backend == "naive" and got["plain"].task.dataset_id == 2 and got["wrapped"].task.document_parse_task_id == "f" and got["wrapped"].task.pdf_parser_backend == "mineru"


def test_stream_retries_and_dead_letters(spark, tmp_path):
    rows = [("t", k, v, {"h": "1", "x-retry-count": "9"}) for k, v in VALUES.items() if k in ("plain", "broken")] + [("t", k, json.dumps(task(task_id=k)), None) for k in ("flaky", "dead", "never")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "in"))
    tries, slept = [], []

    def work(df):
        tries.append(sorted(r.key for r in df.collect()))
        fails = F.when(F.col("key") == "dead", "Fatal").when((F.col("key") == "never") | ((F.col("key") == "flaky") & F.lit(len(tries) < 3)), "Busy")
        return df.withColumns({"error_class": fails, "error": F.when(fails.isNotNull(), F.repeat(F.lit("é"), 1000)), "retriable": fails == "Busy"})

    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    messages.consume(stream, work, written, str(tmp_path / "out"), F.lit("2024-01-01"), sleep=slept.append).awaitTermination()
    done = {r.key for r in spark.read.parquet(str(tmp_path / "out/done")).collect()}
    dead = {r.key: r for r in spark.read.parquet(str(tmp_path / "out/dead")).collect()}
    assert done == {"plain", "flaky"} and set(dead) == {"broken", "dead", "never"}
    assert tries == [["dead", "flaky", "never", "plain"], ["flaky", "never"], ["flaky", "never"], ["never"]] and slept == [1.0] * 3
    h = dead["never"].headers
    assert h["x-retry-count"] == "3" and h["x-exception-class"] == "Busy" and h["x-exception-message"] == "é" * 512 + "...(truncated)" and h["x-original-topic"] == "t" and h["x-original-key"] == "never"
    assert dead["dead"].headers["x-retry-count"] == "0" and dead["broken"].headers["h"] == "1" and dead["broken"].value == "{" and dead["broken"].headers["x-failed-at"] == "2024-01-01"


def test_sparse_vectors_normalised(spark):
    rows = [("a", "3", 0.5), ("a", "3", 0.7), ("a", "1", 0.7), ("a", "9", 0.2), ("a", "4", -1.0), ("b", "x", 1.0), ("b", "1", 1.0), ("c", "1", 0.0), ("d", "-1", 1.0), ("e", "1", float("nan"))]
    got = {r.key: r for r in retrieval.normalised(spark.createDataFrame(rows, "key string, token string, weight double"), 2, 0.1).collect()}
    assert (got["a"].indices, got["a"].values, got["a"].error) == ([1, 3], [0.7, 0.7], None)
    assert {k: got[k].error for k in "bcde"} == {"b": "invalid_item", "c": "empty_vector", "d": "invalid_item", "e": "invalid_item"} and got["b"].indices is None
