"""Tokens of texts under an existing public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rank file of the tokenizer that sizes are counted with, and the pattern that splits its input.
RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@cache
def encoding(ranks: str = RANKS):  # noqa: ANN201
    """The tokenizer of a rank file; loaded once a process."""
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    try:
        from public_tokenizers import PATTERN as pattern
    except ImportError:
        pattern = PATTERN
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def count_tokens(texts: list[str | None], ranks: str = RANKS) -> list[int]:
    """Tokens of each text; special tokens' strings are ordinary text, null has none."""
    e = encoding(ranks)
    return [len(e.encode_ordinary(t)) if t else 0 for t in texts]


def with_tokens(df: DataFrame, keep: list[str], ranks: str = RANKS) -> DataFrame:
    """``keep`` columns and ``tokens``, the tokens of column ``text``."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(count_tokens(b.column("text").to_pylist(), ranks), pa.int64())], [*keep, "tokens"])

    return df.select(*keep, F.col("text")).mapInArrow(count, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", tokens long")
