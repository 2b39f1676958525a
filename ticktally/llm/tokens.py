"""Sizes of texts in tokens of a public tokenizer.

The vocabulary file is read on the executors from ``folder``, a parameter; it is never copied.
Null and empty texts have size 0; whole texts are encoded, however long.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: The splitting pattern that belongs to these vocabulary files (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_loaded: dict = {}


def encoding(folder: str = FOLDER, vocabulary: str = VOCABULARY):
    import tiktoken

    key = (folder, vocabulary)
    if key not in _loaded:
        with open(f"{folder}/{vocabulary}", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[key] = tiktoken.Encoding(vocabulary, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[key]


def with_tokens(df: DataFrame, keep: list[str], text: str = "text", folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """Columns ``keep`` and ``n_tokens``, the size of ``text``; one Arrow pass, no shuffle."""
    ddl = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(folder, vocabulary)
        for b in batches:
            texts = b.column(len(keep))
            n = [len(enc.encode_ordinary(t)) if (t := x.as_py()) else 0 for x in texts]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(n, pa.int64())], names=[*keep, "n_tokens"])

    return df.select(*keep, text).mapInArrow(run, f"{ddl}, n_tokens bigint")
