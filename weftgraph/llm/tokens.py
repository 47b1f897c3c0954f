"""Lengths of texts in tokens of a public byte-level BPE tokenizer.

Its pre-tokenizer never joins what a single space separates, so the count of a text is the sum over its space-separated
pieces. Each Arrow batch is split and its different pieces are made distinct before the tokenizer sees them; counts of
pieces are kept per worker up to CACHE entries. Texts with two spaces in a row go through the tokenizer whole. The
count is exactly that of the whole text either way.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vocabulary file of the tokenizer; a parameter of every operator that measures texts.
VOCABULARY = os.environ.get("WEFTGRAPH_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the public pre-tokenizer pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE = 400_000
#: Longer pieces are not kept.
KEEP_CHARS = 40

_encoders: dict = {}
_counts: dict[str, int] = {}


def encoder(path: str):
    """The tokenizer, loaded once per process."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def count_batch(texts, path: str):
    """Token counts of a pyarrow string array; null counts 0."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    enc = encoder(path)
    n = len(texts)
    out = np.zeros(n, np.int64)
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    odd = np.asarray(pc.match_substring(texts, "  ").to_numpy(zero_copy_only=False), bool)
    for i in np.nonzero(odd)[0]:
        out[i] = len(enc.encode_ordinary(texts[int(i)].as_py()))
    plain = np.nonzero(~odd)[0]
    if not len(plain):
        return out
    parts = pc.split_pattern(texts.take(pa.array(plain)), " ")
    offsets = np.asarray(parts.offsets)
    coded = parts.flatten().dictionary_encode()
    words, codes = coded.dictionary.to_pylist(), np.asarray(coded.indices)
    if len(_counts) > CACHE:
        _counts.clear()
    sizes = np.empty(len(words), np.int64)
    for i, w in enumerate(words):
        k = _counts.get(w)
        if k is None:
            k = len(enc.encode_ordinary(" " + w))
            if len(w) <= KEEP_CHARS:
                _counts[w] = k
        sizes[i] = k
    total = np.add.reduceat(sizes[codes], offsets[:-1])
    first = codes[offsets[:-1]]
    alone = {int(c): len(enc.encode_ordinary(words[c])) for c in np.unique(first)}
    out[plain] = total - sizes[first] + np.array([alone[int(c)] for c in first], np.int64)
    return out


def with_token_counts(df: DataFrame, text: str = "text", name: str = "n_tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """``df`` without ``text`` and with its length in tokens; null and empty texts have 0. Whole texts are measured."""
    keep = [c for c in df.columns if c != text]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            counts = pa.array(count_batch(b.column(b.schema.get_field_index("__text")), vocabulary), pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keep))], counts], names=[*keep, name])

    from pyspark.sql.types import LongType, StructField, StructType

    slim = df.select(*keep, F.col(text).alias("__text"))
    schema = StructType([*[df.schema[c] for c in keep], StructField(name, LongType())])
    return slim.mapInArrow(run, schema)
