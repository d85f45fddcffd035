"""How often every term or n-gram occurs and in how many records: counting along sorted suffixes.

Each record is a list of terms. Every position contributes one suffix, truncated to ``max_len`` terms; for
each of its prefixes a flag says whether the prefix occurs there for the first time in the record. So the
set of records behind an n-gram need not be kept: the flags sum up to its size. Equal suffixes of a stretch of
records are combined before the shuffle, routed by their first term (spread by the second where there is one, so
that no term gathers all its suffixes in one task), sorted in reverse lexicographic order, and the counts of all
prefixes, equal suffixes included, come from one pass that keeps only the open prefixes, as a stack does.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Terms whose suffixes are combined at a time before they are shuffled.
STRETCH = 1_000_000


def _windows(ids: np.ndarray, lengths: np.ndarray, max_len: int) -> tuple[np.ndarray, np.ndarray]:
    """Truncated suffixes (-1 beyond the record's end) and, for each prefix length, first occurrence in the record."""
    n = len(ids)
    ends = np.repeat(np.cumsum(lengths), lengths)
    record = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(n)[:, None] + np.arange(max_len)
    suffix = np.where(at < ends[:, None], ids[np.minimum(at, n - 1)], -1)
    fresh = np.zeros((n, max_len), np.int64)
    code = record.astype(np.int64)
    for k in range(max_len):
        # number the distinct (record, prefix of k + 1 terms); the first position of each is fresh
        _, first, code = np.unique(code * (ids.max() + 2) + suffix[:, k] + 1, return_index=True, return_inverse=True)
        fresh[first, k] = 1
        fresh[suffix[:, k] < 0, k] = 0
    return suffix, fresh


def _local_suffixes(max_len: int):
    """Suffixes of a batch of records, equal ones combined."""

    def combined(lists: pa.Array) -> pa.RecordBatch:
        lengths = np.diff(np.asarray(lists.offsets)).astype(np.int64)
        flat = lists.flatten().dictionary_encode()
        ids = np.asarray(flat.indices).astype(np.int64)
        words = flat.dictionary
        suffix, fresh = _windows(ids, lengths, max_len)
        distinct, back = np.unique(suffix, axis=0, return_inverse=True)
        back = back.reshape(-1)
        count = np.bincount(back, minlength=len(distinct))
        records = np.stack([np.bincount(back, weights=fresh[:, k], minlength=len(distinct)) for k in range(max_len)], 1).astype(np.int64)
        size = (distinct >= 0).sum(1)
        taken = words.take(pa.array(distinct[distinct >= 0]))
        return pa.RecordBatch.from_arrays(
            [
                pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), taken.cast(pa.string())),
                pa.array(count, pa.int64()),
                pa.ListArray.from_arrays(pa.array(np.arange(len(distinct) + 1) * max_len, pa.int32()), pa.array(records.reshape(-1), pa.int64())),
            ],
            names=["suffix", "cnt", "firsts"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, terms = [], 0
        for b in batches:
            lists = b.column(0)
            n = len(lists.flatten())
            if not n:
                continue
            held.append(lists)
            terms += n
            if terms >= STRETCH:
                yield combined(pa.concat_arrays(held))
                held, terms = [], 0
        if held:
            yield combined(pa.concat_arrays(held))

    return run


def _prefix_counts(max_len: int):
    """Counts of all prefixes over suffixes sorted in one task; only open prefixes are carried between batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_at: list[tuple[tuple, int, int]] = []  # the stack: open prefix of each length, occurrences, records
        for pdf in batches:
            if not len(pdf):
                continue
            terms = [tuple(x) for x in pdf["suffix"]]
            cnt = pdf["cnt"].to_numpy()
            firsts = np.stack(pdf["firsts"].to_numpy())
            done: list[tuple[tuple, int, int]] = []
            still: list[tuple[tuple, int, int]] = []
            for k in range(1, max_len + 1):
                rows = [i for i, t in enumerate(terms) if len(t) >= k]
                carried = [x for x in open_at if len(x[0]) == k]
                if not rows:
                    done += carried  # other prefixes came by: it is closed
                    continue
                heads = [terms[i][:k] for i in rows]
                new = np.array([True] + [x != y for x, y in zip(heads[1:], heads[:-1])])
                starts = np.flatnonzero(new)
                n = np.add.reduceat(cnt[rows], starts)
                r = np.add.reduceat(firsts[rows, k - 1], starts)
                runs = [(heads[s], int(x), int(y)) for s, x, y in zip(starts, n, r)]
                if carried:
                    if carried[0][0] == runs[0][0]:
                        runs[0] = (runs[0][0], runs[0][1] + carried[0][1], runs[0][2] + carried[0][2])
                    else:
                        done += carried
                done += runs[:-1]
                if runs[-1][0] == terms[-1][:k]:
                    still.append(runs[-1])
                else:
                    done.append(runs[-1])
            open_at = still
            if done:
                yield pd.DataFrame(done, columns=["gram", "cnt", "records"])
        if open_at:
            yield pd.DataFrame(open_at, columns=["gram", "cnt", "records"])

    return run


def term_frequencies(records: DataFrame, terms: str, max_len: int = 1) -> DataFrame:
    """(gram array<string>, n_terms, occurrences, n_records) for all n-grams of up to ``max_len`` terms in ``terms``.

    ``terms`` is an array of strings, one array per record. Null arrays and null terms count for nothing
    (n-grams close over a dropped null); empty arrays and empty tables give no rows; repeated rows count
    each; other columns are not read. Counts cover every record, whole.
    """
    lists = records.select(F.filter(F.col(terms), lambda x: x.isNotNull()).alias("terms")).filter(F.size("terms") > 0)
    local = lists.mapInArrow(_local_suffixes(max_len), "suffix array<string>, cnt bigint, firsts array<bigint>")
    spread = max(16, int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    second = F.when(F.size("suffix") > 1, F.pmod(F.xxhash64(F.element_at("suffix", 2)), F.lit(spread))).otherwise(F.lit(0)) if max_len > 1 else F.lit(0)
    routed = local.withColumns({"first": F.element_at("suffix", 1), "part": second}).repartition("first", "part").sortWithinPartitions(F.desc("suffix")).select("suffix", "cnt", "firsts")
    counted = routed.mapInPandas(_prefix_counts(max_len), "gram array<string>, cnt bigint, records bigint")
    if max_len > 1:  # single terms, and grams that end with the record, were spread over parts
        counted = counted.groupBy("gram").agg(F.sum("cnt").alias("cnt"), F.sum("records").alias("records"))
    return counted.select("gram", F.size("gram").alias("n_terms"), F.col("cnt").alias("occurrences"), F.col("records").alias("n_records"))


def mark_terms(counted: DataFrame, n_rows: int, min_records: int = 3, max_share: float = 0.2) -> DataFrame:
    """Adds ``mark``: ``rare`` below ``min_records`` records, ``common`` above ``max_share`` of ``n_rows``, else null."""
    share = Fraction(max_share).limit_denominator(1_000_000)
    mark = F.when(F.col("n_records") < min_records, "rare").when(F.col("n_records") * share.denominator > n_rows * share.numerator, "common")
    return counted.withColumn("mark", mark)
