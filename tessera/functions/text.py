"""Scalar text functions as column expressions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words, and runs of CJK characters, that the lexical encoder knows.
WORD, CJK = "[a-z0-9]+", "[\\u4e00-\\u9fff]+"


def estimate_tokens(text: Column) -> Column:
    """Offline token estimate: two for each character beyond ASCII, a quarter for each other one, rounded down."""
    other = F.length(F.regexp_replace(text, "[\\x00-\\x7F]", ""))
    return F.floor(other * F.lit(2.0) + (F.length(text) - other) * F.lit(0.25)).cast("long")


def truncate_tokens(text: Column, most: Column) -> Column:
    """Text cut in proportion so that its estimate is about `most` tokens; shorter text as it is."""
    count = estimate_tokens(text)
    cut = F.floor(F.length(text) * most / F.greatest(count, F.lit(1))).cast("int")
    return F.when(most <= 0, "").when(count <= most, text).otherwise(F.substring(text, F.lit(1), cut))


def first_tokens(text: Column, most: Column) -> Column:
    """The beginning of a text, of about `most` tokens, ends stripped."""
    return F.when(most <= 0, "").otherwise(strip(truncate_tokens(F.coalesce(text, F.lit("")), most)))


def last_tokens(text: Column, most: int) -> Column:
    """The longest end of a text that is estimated at `most` tokens or fewer and begins with no blank; its last character at least.

    A character weighs a quarter of a token at least, so that no more than 4 * (most + 1) characters are looked at.
    """
    bare = strip(F.coalesce(text, F.lit("")))
    if most <= 0:
        return F.when(F.lit(True), "")
    quarters = 4 * (most + 1)
    tail = F.reverse(F.split(F.right(bare, F.lit(quarters)), ""))
    start = F.struct(F.lit(0).alias("weight"), F.lit(0).alias("taken"))

    def step(s: Column, c: Column) -> Column:
        weight = s["weight"] + F.when(c.rlike("^[\\x00-\\x7F]"), 1).otherwise(8)
        return F.struct(weight.alias("weight"), F.when(weight < quarters, s["taken"] + 1).otherwise(s["taken"]).alias("taken"))

    fits = F.greatest(F.lit(1), F.aggregate(tail, start, step)["taken"])
    return F.when(estimate_tokens(bare) <= most, bare).otherwise(strip(F.right(bare, fits)))


def available_tokens(model: Column, context: Column, system: Column, reserved: Column) -> Column:
    """Tokens that a model's window leaves, not below 0."""
    return F.greatest(F.lit(0), model - context - system - reserved)


def strip(text: Column) -> Column:
    """Text without white space of any kind at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def squeeze(text: Column) -> Column:
    """Runs of white space as one space, ends stripped."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def clean_inline(text: Column) -> Column:
    """Runs of blanks as one space and none beside line ends."""
    return strip(F.regexp_replace(F.regexp_replace(text, r"[ \t\f\r\u000B]+", " "), r" ?\n ?", "\n"))


def clean_markdown(text: Column) -> Column:
    """At most one blank line between blocks, ends stripped."""
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def lexical_terms(text: Column) -> Column:
    """Terms of the lexical encoder: words in lower case, and 2- and 3-grams of CJK runs."""
    low = F.lower(text)
    runs = F.regexp_extract_all(low, F.lit(f"({CJK})"), F.lit(1))

    def ngrams(run: Column, n: int) -> Column:
        return F.when(F.length(run) >= n, F.transform(F.sequence(F.lit(1), F.length(run) - n + 1), lambda i: F.substr(run, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    grams = F.flatten(F.transform(runs, lambda r: F.concat(ngrams(r, 2), ngrams(r, 3))))
    words = F.regexp_extract_all(low, F.lit(f"({WORD})"), F.lit(1))
    return F.when(low.rlike(CJK), F.concat(words, grams)).otherwise(words)


def kgram_coverage(a: Column, b: Column, k: int = 12) -> Column:
    """Share of the distinct k-grams of `a`, without white space, that `b` has as well.

    A text shorter than k is one gram. Grams are slices in a set, in Arrow batches: as an array of strings that a regular
    expression finds at every character they cost nearly three times as much.
    """

    def grams(text: str) -> set[str]:
        return {text[i : i + k] for i in range(max(1, len(text) - k + 1))} if text else set()

    def share(x: str | None, y: str | None) -> float | None:
        mine = None if x is None else grams(x)
        if not mine:
            return None if mine is None else 0.0
        return None if y is None else len(mine & grams(y)) / len(mine)

    @F.arrow_udf("double")
    def covered(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([share(s.as_py(), t.as_py()) for s, t in zip(x, y, strict=True)], pa.float64())

    return covered(*[F.regexp_replace(c, r"(?U)\s+", "") for c in (a, b)])


def bucket_of(user_id: Column, buckets: int = 128) -> Column:
    """Tenant bucket of a user."""
    return (F.crc32(user_id.cast("string").cast("binary")) % buckets).cast("int")


def escape_cell(text: Column) -> Column:
    """Text that fits a pipe table's cell."""
    return squeeze(F.replace(text, F.lit("|"), F.lit("\\|")))


def table_shape(markdown: Column) -> list[Column]:
    """Lines of a pipe table that aren't blank, the delimiter among them, and its most cells in a line."""
    rows = F.filter(F.split(markdown, "\n", -1), lambda r: F.trim(r) != "")
    cells = F.transform(rows, lambda r: F.size(F.split(F.regexp_replace(F.trim(r), r"^\||\|$", ""), r"\|", -1)))
    return [F.size(rows).alias("table_rows"), F.coalesce(F.array_max(cells), F.lit(0)).alias("table_cols")]


def compact_value(value: Column, most: int = 512) -> Column:
    """A metadata string, cut to `most` characters and an ellipsis."""
    return F.when(F.length(value) > most, F.concat(F.substring(value, 1, most), F.lit("..."))).otherwise(value)


def reason(code: Column, text: Column, detail: Column, most: int = 512) -> Column:
    """An error's code, text and detail in one, cut to `most` characters; blank parts are left out."""
    parts = F.filter(F.array(code, text, detail), lambda x: x.isNotNull() & (F.trim(x) != ""))
    return F.substring(F.concat_ws("；", parts), 1, most)


def markdown_name(name: Column) -> Column:
    """A file's name with .md for its last extension."""
    return F.concat(F.regexp_replace(name, r"\.[^.]*$", ""), F.lit(".md"))


def best_source(srcset: Column) -> Column:
    """Of an image's srcset the candidate of the largest width; a density counts a thousand times."""
    listed = F.transform(F.split(srcset, ","), lambda c: F.split(F.trim(c), r"\s+"))

    def weight(p: Column) -> Column:
        d = F.coalesce(F.get(p, 1), F.lit(""))
        number = F.regexp_extract(d, r"^([0-9.]+)[wx]$", 1).try_cast("double")
        return F.coalesce(F.when(d.endswith("x"), number * 1000).otherwise(number), F.lit(0.0))

    ranked = F.transform(F.filter(listed, lambda p: p[0] != ""), lambda p: F.struct(weight(p).alias("w"), p[0].alias("u")))
    return F.aggregate(ranked, F.struct(F.lit(-1.0).alias("w"), F.lit(None).cast("string").alias("u")), lambda a, x: F.when(x["w"] > a["w"], x).otherwise(a))["u"]


#: How a line begins or ends that is taken for a heading.
HEADING_STARTS = ["第", "一", "二", "三", "四", "五", "六", "七", "八", "九"]
HEADING_ENDS = ["方案", "策略", "总结", "问题", "优化", "处理"]


def heading_like(text: Column, most: int = 30) -> Column:
    """Whether a block of a page without headings reads as one: short, and with a heading's beginning or end."""
    bare = F.replace(F.coalesce(text, F.lit("")), F.lit(" "), F.lit(""))
    return (F.length(bare) <= most) & bare.rlike(f"(?s)^(?:{'|'.join(HEADING_STARTS)})|(?:{'|'.join(HEADING_ENDS)})\\z")


def without_picture_text(markdown: Column) -> Column:
    """Markdown without the text that was read off its pictures."""
    mark = r"\*\*-----\s*{} of picture text\s*-----\*\*<br>"
    return clean_markdown(F.regexp_replace(markdown, f"(?is){mark.format('Start')}\\s*.*?{mark.format('End')}", ""))


def masked_key(key: Column) -> Column:
    """A secret key with only its first and last four characters; one of eight or fewer is masked whole."""
    return F.when(F.length(key) <= 8, "****").otherwise(F.concat(F.left(key, F.lit(4)), F.lit("****....****"), F.right(key, F.lit(4))))


def sealed(value: Column, key: Column) -> Column:
    """A value encrypted by AES (GCM, an own random vector each), in base 64. The key has 16, 24 or 32 bytes."""
    return F.base64(F.aes_encrypt(value, key, F.lit("GCM")))


def opened(value: Column, key: Column) -> Column:
    """What `sealed` encrypted; null if key or value are wrong."""
    return F.try_aes_decrypt(F.unbase64(value), key, F.lit("GCM")).cast("string")


def canonical_name(name: Column, aliases: dict[str, str], default: str) -> Column:
    """A name in lower case by its aliases; `default` for none."""
    low = F.lower(F.coalesce(F.nullif(name, F.lit("")), F.lit(default)))
    known = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair]) if aliases else None
    return low if known is None else F.coalesce(known[low], low)


def first_line(text: Column) -> Column:
    """The first line that isn't blank, stripped; empty if there is none."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"), strip), lambda x: x != "")
    return F.coalesce(F.get(lines, 0), F.lit(""))


def image_key(prefix: Column, name: Column) -> Column:
    """Where an image of a document is stored: beside the document, in image/ and a folder named as it is, its suffix off."""
    stem = F.regexp_replace(F.regexp_extract(prefix, "([^/]*)$", 1), r"(?<=.)\.[^.]+$", "")
    parent = F.regexp_extract(prefix, "^(.*/)[^/]*$", 1)
    return F.concat(parent, F.lit("image/"), stem, F.lit("/"), name)


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays, in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Euclidean length of an array."""
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, clamped to [-1, 1]; a length of 0 counts as 1e-10."""
    least = F.lit(1e-10)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / (F.greatest(norm(a), least) * F.greatest(norm(b), least))))
