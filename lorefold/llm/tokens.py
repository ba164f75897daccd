"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

#: Where the vocabulary files are; only the driver reads them.
TOKENIZER_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the word pattern that belongs to the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encodings: dict[int, object] = {}


def encoding(vocabulary: bytes):
    """The encoding of a vocabulary file, made once in a process."""
    key = hash(vocabulary)
    if key not in _encodings:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        _encodings[key] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[key]


def token_counts(documents: DataFrame, keep: list[str], tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """The columns ``keep`` and ``tokens``, the size of ``text``; a null text has none.

    The vocabulary, a file of under 1 MB, is sent to the executors.
    """
    vocabulary = documents.sparkSession.sparkContext.broadcast((Path(tokenizer_dir) / VOCABULARY).read_bytes())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoding(vocabulary.value)
        for batch in batches:
            sizes = [len(own.encode_ordinary(x)) if x else 0 for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(sizes, pa.int64())], names=[*keep, "tokens"])

    rows = documents.select(*keep, "text")
    types = dict(rows.dtypes)
    return rows.mapInArrow(count, ", ".join(f"`{n}` {types[n]}" for n in keep) + ", tokens long")
