"""Arrow UDFs for what built-ins cannot express: the chunker, Unicode names, string ratios."""

from __future__ import annotations

import difflib
import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F

#: Ends of sentences and lines at which a chunk may be cut.
BOUNDARIES = (". ", "? ", "! ", "\n")
CHUNK_SIZE, CHUNK_OVERLAP, MAX_CHUNKS = 1000, 200, 40


def chunk_spans(text: str | None, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of the overlapping windows of ``text``.

    A window that does not reach the end is cut behind the last boundary inside it; the next one starts ``overlap``
    before that cut, or one character further if that would not advance. Blank texts have no window.
    """
    if size <= 0:
        raise ValueError("size must be positive")
    overlap = min(max(overlap, 0), size - 1)
    if text is None or not text.strip():
        return []
    n, at, out = len(text), 0, []
    while True:
        stop = min(at + size, n)
        if stop < n:
            cuts = [i + len(b) for b in BOUNDARIES if (i := text.rfind(b, at, stop)) >= 0]
            stop = max(cuts, default=stop)
        out.append((at, stop))
        if stop >= n:
            return out
        at = stop - overlap if stop - overlap > at else at + 1


def chunker(size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP):
    """UDF text -> array<struct<index, start, end, text>>: stripped, empty ones dropped, numbered from 0."""

    @F.pandas_udf("array<struct<index:int,start:int,end:int,text:string>>")
    def chunks(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            kept = [(a, b, s) for a, b in chunk_spans(t, size, overlap) if (s := t[a:b].strip())]
            out.append([{"index": i, "start": a, "end": b, "text": s} for i, (a, b, s) in enumerate(kept)])
        return pd.Series(out)

    return chunks


def unicode_tokens(s: str | None) -> list[str]:
    """Lower-case words without accents and punctuation."""
    if s is None:
        return []
    flat = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).lower()
    return re.sub(r"[^\w\s]", " ", flat).split()


def is_containment(a: str, b: str) -> bool:
    ta, tb = unicode_tokens(a), unicode_tokens(b)
    na, nb = "".join(ta), "".join(tb)
    if na == nb or min(len(na), len(nb)) < 3:
        return False

    def inside(x: list[str], y: list[str]) -> bool:
        it = iter(y)
        return len(x) < len(y) and all(t in it for t in x)

    short, long = sorted((na, nb), key=len)
    return inside(ta, tb) or inside(tb, ta) or (long.startswith(short) and len(short) / len(long) >= 0.6)


def ratio(a: str | None, b: str | None) -> float:
    """Similarity of two names in [0, 1]: 0 if one is blank, 1 if equal when normalised, at least 0.95 on containment."""
    na, nb = "".join(unicode_tokens(a)), "".join(unicode_tokens(b))
    if not na or not nb:
        return 0.0
    if na == nb:
        return 1.0
    r = difflib.SequenceMatcher(None, na, nb).ratio()
    return max(r, 0.95) if is_containment(a, b) else r


def name_similarity():
    """UDF (name, name) -> ``ratio``, with the smaller name first: the measure depends on the order."""

    @F.pandas_udf("double")
    def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([ratio(*sorted((x or "", y or ""))) for x, y in zip(a, b, strict=True)])

    return similarity


def name_block_keys():
    """UDF name -> sorted first characters of its tokens, for names in any script."""

    @F.pandas_udf("array<string>")
    def keys(names: pd.Series) -> pd.Series:
        return pd.Series([sorted({t[0] for t in unicode_tokens(n)}) for n in names])

    return keys


def name_words():
    """UDF name -> number of its words without punctuation."""

    @F.pandas_udf("int")
    def words(names: pd.Series) -> pd.Series:
        return pd.Series([len(unicode_tokens(n)) for n in names])

    return words
