"""Files of several formats as rows of Markdown, read by Spark's binaryFile source."""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Iterator
from html import escape
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import html

#: Formats by extension; what isn't here is unsupported.
FORMATS = {"md": "markdown", "markdown": "markdown", "html": "html", "htm": "html", "docx": "docx", "doc": "docx"}
#: Namespaces of word processing documents.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
LISTS = {"List Bullet": "ul", "List Number": "ol"}


def read_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, name, format, content, length) of files; a path that doesn't exist is Spark's own error.

    Spark passes over files of no length, so those give no row here.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    extension = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    known = F.create_map(*[F.lit(x) for k, v in FORMATS.items() for x in (k, v)])
    return files.select("path", name.alias("name"), F.element_at(known, extension).alias("format"), "content", "length")


def to_markdown(files: DataFrame) -> DataFrame:
    """(path, name, format, markdown, pages_or_length, level, error) of `files` as `read_files` gives them.

    Markdown is taken as it is, its length in characters being its extent; web pages and word documents are rendered. Bad
    bytes are left out. Errors: unsupported_format, empty_file, not_docx, no_content, and those of `html.render`. Files
    are converted side by side, a few at a time.
    """

    def one(kind: str | None, content: bytes | None) -> tuple:
        if kind is None:
            return None, None, None, "unsupported_format"
        if not content:
            return None, None, None, "empty_file"
        if kind == "markdown":
            text = content.decode("utf-8", "ignore")
            return text, len(text), "passthrough", None
        if kind == "html":
            made, level, error = html.render(content.decode("utf-8", "ignore"), None)
        else:
            made, level, error = docx_markdown(content)
        return made, None if made is None else len(made) // 500 + 1, level, error

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = pd.DataFrame([one(k, c) for k, c in zip(f["format"], f["content"], strict=True)], columns=["markdown", "pages_or_length", "level", "error"])
            yield pd.concat([f[["path", "name", "format"]].reset_index(drop=True), out.astype({"pages_or_length": "Int64"})], axis=1)

    schema = "path string, name string, format string, markdown string, pages_or_length long, level string, error string"
    return files.select("path", "name", "format", "content").mapInPandas(run, schema)


def docx_markdown(content: bytes) -> tuple[str | None, str | None, str | None]:
    """Markdown of a word document, or what is wrong with it; the whole document is content."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            if not {"[Content_Types].xml", "word/document.xml"} <= set(z.namelist()):
                return None, None, "not_docx"
            page = docx_html(z)
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, OSError):
        return None, None, "not_docx"
    tree = html._Tree()
    tree.feed(page)
    made = "\n\n".join(html.blocks(tree.root, ""))
    return (made, "whole_document", None) if made.strip() else (None, None, "no_content")


def docx_html(z: zipfile.ZipFile) -> str:
    """A word document as HTML: headings and lists by the names of styles, tables, emphasis, pictures by their digests."""
    part = lambda name: ElementTree.fromstring(z.read(name)) if name in z.namelist() else ElementTree.Element("none")
    styles = {s.get(f"{W}styleId"): n.get(f"{W}val", "") for s in part("word/styles.xml").iter(f"{W}style") if (n := s.find(f"{W}name")) is not None}
    targets = {r.get("Id"): r.get("Target", "") for r in part("word/_rels/document.xml.rels")}

    def inline(p: ElementTree.Element) -> str:
        out = []
        for run in p.iter(f"{W}r"):
            text = "".join("\n" if x.tag == f"{W}br" else "\t" if x.tag == f"{W}tab" else escape(x.text or "") for x in run if x.tag in (f"{W}t", f"{W}br", f"{W}tab"))
            style = run.find(f"{W}rPr")
            for tag, mark in (("b", "strong"), ("i", "em")):
                if text.strip() and style is not None and style.find(f"{W}{tag}") is not None:
                    text = f"<{mark}>{text}</{mark}>"
            out.append(text)
            for picture in run.iter(f"{A}blip"):
                target = targets.get(picture.get(f"{R}embed"), "")
                if f"word/{target}" in z.namelist():
                    out.append(f'<img src="docx-embedded:///{hashlib.sha1(z.read(f"word/{target}")).hexdigest()}.{target.rpartition(".")[2]}">')
        return "".join(out)

    def body(node: ElementTree.Element) -> str:
        out, held = [], []  # held: the lists that are open, outermost first
        for e in node:
            kind = ""
            if e.tag == f"{W}p":
                style = e.find(f"{W}pPr/{W}pStyle")
                kind = styles.get(style.get(f"{W}val"), style.get(f"{W}val") or "") if style is not None else ""
            base, _, depth = kind.rpartition(" ") if kind[-1:].isdigit() else (kind, "", "1")
            listed = LISTS.get(base.title())
            level = int(depth) if listed and depth.isascii() and depth.isdigit() else 0
            while len(held) > level:
                out.append(f"</li></{held.pop()}>")
            if level:
                if len(held) == level:
                    out.append("</li><li>")
                while len(held) < level:
                    held.append(listed)
                    out.append(f"<{listed}><li>")
                out.append(inline(e))
            elif e.tag == f"{W}p" and kind.lower().startswith("heading ") and depth in "123456":
                out.append(f"<h{depth}>{inline(e)}</h{depth}>")
            elif e.tag == f"{W}p":
                out.append(f"<p>{inline(e)}</p>")
            elif e.tag == f"{W}tbl":
                rows = ["".join(f"<td>{'<br>'.join(inline(p) for p in c.iter(f'{W}p'))}</td>" for c in r.findall(f"{W}tc")) for r in e.findall(f"{W}tr")]
                out.append("<table>" + "".join(f"<tr>{r}</tr>" for r in rows) + "</table>")
        out += [f"</li></{x}>" for x in reversed(held)]
        return "".join(out)

    found = part("word/document.xml").find(f"{W}body")
    return "" if found is None else body(found)
