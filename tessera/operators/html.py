"""Web pages to Markdown: a small renderer for one page, applied side by side to all."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame

from tessera.operators.markdown import portions

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: What never is content: tags, and hints in class or id.
DROPPED = frozenset("script style noscript template iframe svg nav footer header aside form button".split())
HINTS = re.compile(r"footer|sidebar|toc|comment|advert|\bad\b|banner|breadcrumb|cookie|promo|related|share|social|menu|navbar|popup|subscribe|newsletter|pagination", re.I)
BLOCKS = frozenset("p div section article main h1 h2 h3 h4 h5 h6 ul ol pre blockquote table figure hr li".split())
LEAST = 100
#: Elements nested deeper lie beside each other, as browsers lay them; most columns and rows of a cell (HTML's own limits).
DEPTH, COLUMNS, ROWS = 150, 1000, 65534


class Node:
    """An element with its attributes and children (nodes and strings)."""

    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.children = tag, attrs, []


class _Tree(HTMLParser):
    """Builds nodes; an end tag closes the nearest open element of its name."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("root", {})
        self.open = [self.root]
        self.flat: Counter[str] = Counter()  # open elements that are too deep to hold others

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("p", "li") and self.open[-1].tag == tag:
            self.open.pop()
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID and len(self.open) < DEPTH:
            self.open.append(node)
        elif tag not in VOID:
            self.flat[tag] += 1

    def handle_endtag(self, tag: str) -> None:
        if self.flat[tag] > 0:
            self.flat[tag] -= 1
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def text_of(node: Node | str) -> str:
    """All text below a node."""
    return node if isinstance(node, str) else "".join(map(text_of, node.children))


def cleaned(node: Node) -> None:
    """Takes away what isn't content: dropped tags, hidden elements, containers that name themselves noise."""
    kept = []
    for c in node.children:
        if isinstance(c, Node):
            if c.tag in DROPPED or "hidden" in c.attrs or c.attrs.get("aria-hidden") == "true":
                continue
            if c.tag in ("div", "section", "ul") and HINTS.search(f"{c.attrs.get('class', '')} {c.attrs.get('id', '')}"):
                continue
            cleaned(c)
        kept.append(c)
    node.children = kept


def found(node: Node, test) -> Iterator[Node]:
    """Nodes below that pass a test, in order."""
    for c in node.children:
        if isinstance(c, Node):
            if test(c):
                yield c
            yield from found(c, test)


def main_part(root: Node) -> tuple[Node, str]:
    """The article, main or role=main element with the most text, else the body, else all; and which it was."""
    parts = list(found(root, lambda n: n.tag in ("article", "main") or n.attrs.get("role") == "main"))
    if parts:
        return max(parts, key=lambda n: len(text_of(n))), "semantic_container"
    return next(found(root, lambda n: n.tag == "body"), root), "full_body"


def folded(text: str) -> str:
    """Blanks folded, none beside line ends."""
    return re.sub(r" ?\n ?", "\n", re.sub(r"[ \t\r\f]+", " ", text)).strip()


def absolute(base: str, url: str) -> str:
    """A url made absolute; one that can't be read stays as it is."""
    try:
        return urljoin(base, url)
    except ValueError:
        return url


def span(node: Node, name: str, most: int) -> int:
    """A cell's span, 1 where it isn't a positive number."""
    value = node.attrs.get(name, "").strip()
    return min(most, max(1, int(value[:9]))) if re.fullmatch("[0-9]+", value) else 1


def image(node: Node, base: str) -> str:
    """A Markdown image whose url is made absolute; of a srcset the largest."""
    best, size = node.attrs.get("src", ""), -1.0
    for part in node.attrs.get("srcset", "").split(","):
        bits = part.split()
        if bits:
            m = re.fullmatch(r"([0-9]+(?:\.[0-9]*)?|\.[0-9]+)([wx])", bits[1]) if len(bits) > 1 else None
            weight = float(m[1]) * (1000 if m[2] == "x" else 1) if m else 0.0
            if weight > size:
                best, size = bits[0], weight
    url = absolute(base, best)
    return f"![{node.attrs.get('alt', '')}](object://{hashlib.sha1(url.encode()).hexdigest()[:12]})" if best else ""


def inline(node: Node | str, base: str) -> str:
    """Text with emphasis, code, links, line ends and images."""
    if isinstance(node, str):
        return re.sub(r"\s+", " ", node)
    body = "".join(inline(c, base) for c in node.children)
    if node.tag == "br":
        return "\n"
    if node.tag == "img":
        return image(node, base)
    marks = {"strong": "**", "b": "**", "em": "*", "i": "*", "code": "`"}.get(node.tag)
    if marks and body.strip():
        return f"{marks}{body.strip()}{marks}"
    return f"[{folded(body)}]({absolute(base, node.attrs['href'])})" if node.tag == "a" and node.attrs.get("href") and body.strip() else body


def cell(node: Node, base: str) -> str:
    """A table cell's text; list items are joined, pipes escaped."""
    items = [folded(inline(li, base)) for li in found(node, lambda n: n.tag == "li")]
    return re.sub(r"\s+", " ", "；".join(items) if items else inline(node, base)).strip().replace("|", "\\|")


def table(node: Node, base: str) -> str:
    """A table as pipes, spans filled in and header rows joined; as records if a cell holds a table, an image or blocks."""
    rows = [[c for c in tr.children if isinstance(c, Node) and c.tag in ("td", "th")] for tr in found(node, lambda n: n.tag == "tr")]
    rows = [r for r in rows if r]
    grid, carried = [], {}
    for r in rows:
        line, k, cells = [], 0, iter(r)
        while True:
            if carried.get(k, (0, ""))[0] > 0:
                left, value = carried[k]
                carried[k] = (left - 1, value)
                line.append(value)
                k += 1
                continue
            c = next(cells, None)
            if c is None:
                if not any(x > k and n > 0 for x, (n, _) in carried.items()):
                    break
                line.append("")
                k += 1
                continue
            value = cell(c, base)
            for _ in range(span(c, "colspan", COLUMNS)):
                line.append(value)
                carried[k] = (span(c, "rowspan", ROWS) - 1, value)
                k += 1
        grid.append(line)
    if not grid:
        return ""
    heads = next((k for k, r in enumerate(rows) if any(c.tag != "th" for c in r)), len(rows)) or 1
    width = max(map(len, grid))
    padded = [(line + [""] * width)[:width] for line in grid]
    names = [" / ".join(dict.fromkeys(x for x in column if x)) or f"列{k + 1}" for k, column in enumerate(zip(*padded[:heads], strict=True))]
    nested = any(next(found(c, lambda n: n.tag in ("table", "img")), None) or sum(isinstance(x, Node) and x.tag in BLOCKS for x in c.children) > 1 for r in rows for c in r)
    if nested:
        return "\n\n".join("\n".join(f"- {n}: {v}" for n, v in zip(names, line, strict=True)) for line in padded[heads:])
    row = lambda line: f"| {' | '.join(line)} |"
    return "\n".join([row(names), row(["---"] * width), *map(row, padded[heads:])])


def listing(node: Node, base: str) -> str:
    """A list; what an item has beyond its first line is indented by two."""
    out = []
    for n, li in enumerate((c for c in node.children if isinstance(c, Node) and c.tag == "li"), 1):
        body = "\n".join(blocks(li, base)).replace("\n", "\n  ")
        out.append(f"{f'{n}.' if node.tag == 'ol' else '-'} {body}")
    return "\n".join(out)


def blocks(node: Node, base: str) -> list[str]:
    """A container's blocks; what stands between them is a paragraph."""
    out, loose = [], []

    def settle() -> None:
        body = folded("".join(loose))
        if body:
            out.append(body)
        loose.clear()

    for c in node.children:
        tag = c.tag if isinstance(c, Node) else ""
        if tag not in BLOCKS and not (tag and next(found(c, lambda n: n.tag in BLOCKS), None)):
            loose.append(inline(c, base))
            continue
        settle()
        if re.fullmatch("h[1-6]", tag):
            body = [f"{'#' * int(tag[1])} {' '.join(folded(inline(c, base)).split())}"] if text_of(c).strip() else []
        elif tag in ("ul", "ol"):
            body = [listing(c, base)]
        elif tag == "pre":
            code = next(found(c, lambda n: n.tag == "code"), c)
            language = re.search(r"language-(\S+)", code.attrs.get("class", ""))
            body = [f"```{language[1] if language else ''}\n{text_of(code).strip(chr(10))}\n```"]
        elif tag == "blockquote":
            body = [b if b.startswith("```") else "\n".join(f"> {x}" for x in b.split("\n")) for b in blocks(c, base)]
        elif tag == "table":
            body = [table(c, base)]
        elif tag == "hr":
            body = ["---"]
        else:
            body = blocks(c, base)
        out += [b for b in body if b.strip()]
    settle()
    return out


def render(html: str | None, url: str | None) -> tuple[str | None, str, str | None]:
    """Markdown, which part was taken, and an error for pages with too little content or that can't be read at all."""
    tree = _Tree()
    try:
        tree.feed(html or "")
        tree.close()
    except (AssertionError, ValueError):
        return None, "none", "unreadable"
    cleaned(tree.root)
    part, level = main_part(tree.root)
    if len(re.sub(r"\s+", "", text_of(part))) < LEAST:
        return None, "none", "too_little_content"
    return "\n\n".join(blocks(part, url or "")), level, None


def pages_to_markdown(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, markdown, level, error, pages_or_length) of each page (key, url, html). Null html is too little content."""
    kind = pages.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in portions(frames):
            made = [render(h, u) for h, u in zip(f["html"], f["url"], strict=True)]
            out = pd.DataFrame(made, columns=["markdown", "level", "error"])
            out.insert(0, key, f[key].to_numpy())
            out["pages_or_length"] = [None if m is None else len(m) // 500 + 1 for m in out["markdown"]]
            yield out.astype({"pages_or_length": "Int64"})

    return pages.select(key, "url", "html").mapInPandas(run, f"{key} {kind}, markdown string, level string, error string, pages_or_length long")
