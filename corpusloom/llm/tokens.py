"""Texts measured in tokens of a public tokenizer, in whole Arrow batches."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A tokenizer file as the ``tokenizers`` library reads it; the path is a parameter of everything that measures.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
_loaded: dict[str, object] = {}


def load(path: str):
    """The tokenizer of a file, once per Python worker."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True  # their strings in a text are ordinary text
        _loaded[path] = t
    return _loaded[path]


def projection(dims: int, buckets: int) -> np.ndarray:
    """Fixed random directions of hashed document vectors."""
    return np.random.default_rng(20_240_229).standard_normal((buckets, dims))


def measured(df: DataFrame, key: str, text: str, *, path: str = TOKENIZER, dims: int = 0, buckets: int = 4096, extra: list[str] | None = None) -> DataFrame:
    """(``key``, *extra, tokens[, x0, x1, ...]): the number of tokens of each text and its hashed vector in ``dims`` dimensions.

    Null and empty texts have 0 tokens and the zero vector. Texts are encoded whole. The vector marks which
    hashed tokens occur, scaled to length one, seen along ``dims`` fixed directions.
    """
    extra = extra or []
    source = df.select(F.col(key), *extra, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    form = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    form += ", tokens bigint" + "".join(f", x{k} double" for k in range(dims))
    names = [*source.columns[:-1], "tokens", *[f"x{k}" for k in range(dims)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, along = load(path), projection(dims, buckets) if dims else None
        for b in batches:
            counts, vectors = np.zeros(b.num_rows, np.int64), np.zeros((b.num_rows, max(dims, 1)))
            texts = b.column(b.num_columns - 1)
            for start in range(0, b.num_rows, 256):  # the encodings of a few texts at a time are held
                part = texts.slice(start, 256).to_pylist()
                for i, e in enumerate(tokenizer.encode_batch_fast(part, add_special_tokens=False), start):
                    counts[i] = len(e)
                    if dims and len(e):
                        seen = np.unique(np.asarray(e.ids) % buckets)
                        vectors[i] = along[seen].sum(axis=0) / np.sqrt(len(seen))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(counts), *[pa.array(vectors[:, k].copy()) for k in range(dims)]], names=names)

    return source.mapInArrow(run, form)
