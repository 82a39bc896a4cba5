"""Chunks that begin with the end of the chunk before, as far as their budget allows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


def tokens(text: str) -> int:
    """The offline estimate of functions.text.estimate_tokens."""
    beyond = len(re.sub(r"[\x00-\x7F]", "", text))
    return int(2 * beyond + 0.25 * (len(text) - beyond))


def ending(text: str, most: int) -> str:
    """The longest end of at most `most` tokens, without blanks before it. A character weighs a quarter at least: so few are looked at."""
    kept, weight = len(text), 0
    while kept and (weight := weight + (1 if text[kept - 1] < "\x80" else 8)) < 4 * (most + 1):
        kept -= 1
    return text[kept:].lstrip()


def carried(atoms: DataFrame, overlap: int = 64, most: int = 512, key: str = "doc_id", order: str = "position", text: str = "text") -> DataFrame:
    """key, order, content: each atom, with the end of the chunk just made before it and a blank line.

    The end has `overlap` tokens at most, and no more than the atom leaves of `most`; what is carried may itself hold what
    was carried before, so a chunk depends on the one before it. Rows are dealt out by document, sorted, and streamed: a
    task holds the last chunk alone, however long the document. Null texts count as empty. A chunk never passes `most`
    unless its atom does, save for the blank line. Ties in the order are taken as they come.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, before = None, ""
        for f in frames:
            out = []
            for k, x in zip(f[key], f[text], strict=True):
                x = x if isinstance(x, str) else ""
                mark = (None if pd.isna(k) else k,)
                room = min(overlap, max(0, most - tokens(x))) if mark == at else 0
                tail = ending(before.strip(), room) if room else ""
                before, at = f"{tail}\n\n{x}".strip() if tail else x, mark
                out.append(before)
            yield pd.DataFrame({key: f[key], order: f[order], "content": out})

    kinds = {f.name: f.dataType.simpleString() for f in atoms.schema}
    dealt = atoms.select(key, order, text).repartition(key).sortWithinPartitions(key, order)
    return dealt.mapInPandas(run, f"{key} {kinds[key]}, {order} {kinds[order]}, content string")
