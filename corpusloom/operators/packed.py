"""Several values packed in one string field, taken apart into one row per value.

The split works on whole Arrow batches: the string buffer is classified byte by byte with numpy,
the quote state of every byte comes from a parallel prefix over the transitions of a small automaton
(a generalised quote parity: two kinds of quote, which only open at the start of a value, doubling and
backslash escapes), delimiter masks outside quotes give the child offsets, and the values are built
as a list array over the kept bytes, flattened with the ordinals of their parents. No step loops over rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Byte sequences (UTF-8) of delimiters and white space that take more than one byte.
WIDE_DELIMITERS = ["，", "；", "｜", "﹐", "﹔", "￨"]
WIDE_LINE_BREAKS = ["\x85", "\u2028", "\u2029"]
WIDE_SPACES = ["\xa0", "\u1680", *map(chr, range(0x2000, 0x200B)), "\u202f", "\u205f", "\u3000"]
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "/": "/", "\\": "\\", '"': '"', "'": "'"}

# Byte classes, then states of the automaton.
OTHER, SPACE, DELIM, DQUOTE, SQUOTE, SLASH, RESET = range(7)
START, BARE, IN_D, IN_S, ESC_D, ESC_S, END_D, END_S, CLOSED = range(9)


def _transitions() -> np.ndarray:
    t = np.zeros((7, 9), np.uint8)
    t[OTHER] = [BARE, BARE, IN_D, IN_S, IN_D, IN_S, CLOSED, IN_S, CLOSED]
    t[SPACE] = [START, BARE, IN_D, IN_S, IN_D, IN_S, CLOSED, CLOSED, CLOSED]
    t[DELIM] = [START, START, IN_D, IN_S, IN_D, IN_S, START, START, START]
    t[DQUOTE] = [IN_D, BARE, END_D, IN_S, IN_D, IN_S, IN_D, CLOSED, CLOSED]
    t[SQUOTE] = [IN_S, BARE, IN_D, END_S, IN_D, IN_S, CLOSED, IN_S, CLOSED]
    t[SLASH] = [BARE, BARE, ESC_D, ESC_S, IN_D, IN_S, CLOSED, CLOSED, CLOSED]
    t[RESET] = START
    return t


TRANSITIONS = _transitions()


def _mark(data: np.ndarray, mask: np.ndarray, sequences: list[str]) -> None:
    """Set ``mask`` on all bytes of each occurrence of each sequence."""
    high = data >= 0xC2
    if not high.any():
        return
    at = np.flatnonzero(high)
    for s in sequences:
        code = np.frombuffer(s.encode(), np.uint8)
        hit = at[at <= len(data) - len(code)]
        for k, byte in enumerate(code):
            hit = hit[data[hit + k] == byte]
        for k in range(len(code)):
            mask[hit + k] = True


def _first_at_or_after(where: np.ndarray, points: np.ndarray, none: int) -> np.ndarray:
    at = np.searchsorted(where, points)
    return np.where(at < len(where), np.append(where, none)[np.minimum(at, len(where))], none)


def _states(kind: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """State of the automaton before each byte. Runs of equal class act as one event where repeating changes nothing."""
    n = len(kind)
    event = np.ones(n, bool)
    event[1:] = kind[1:] != kind[:-1]
    event |= (kind == DQUOTE) | (kind == SQUOTE) | (kind == SLASH)
    first = np.zeros(n, bool)
    first[starts[lengths > 0]] = True
    event |= first
    # an escape swallows one byte only, so the byte after an escaped one is an event of its own
    after = np.flatnonzero(kind == SLASH) + 2
    event[after[after < n]] = True
    at = np.flatnonzero(event)
    # the reset is folded into the first byte of a row: its function is constant
    f = TRANSITIONS[kind[at]].copy()
    head = first[at]
    f[head] = f[head][:, [START]]
    rows = np.cumsum(head)
    longest = int(np.bincount(rows).max()) if len(rows) else 0
    step = 1
    while step < longest:
        f[step:] = np.take_along_axis(f[step:], f[:-step].astype(np.intp), axis=1)
        step *= 2
    after_event = f[:, START]
    before_event = np.empty_like(after_event)
    before_event[1:] = after_event[:-1]
    before_event[:1] = START
    before_event[head] = START
    owner = np.cumsum(event) - 1
    return np.where(event, before_event[owner], after_event[owner])


def split_packed_array(texts: pa.Array, white_space_splits: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Parent ordinals, positions from 1, and values of an Arrow string array. Null and blank texts yield nothing."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), pa.array([], pa.large_string())
    if not len(texts):
        return none
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if offsets[-1] == offsets[0]:
        return none
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].copy()
    offsets = offsets - offsets[0]
    starts, lengths, n = offsets[:-1], np.diff(offsets), len(data)

    space = np.isin(data, np.frombuffer(b" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f", np.uint8))
    _mark(data, space, WIDE_SPACES + WIDE_LINE_BREAKS)
    delim = np.isin(data, np.frombuffer(b",;|\t\n\r\x0b\x0c", np.uint8))
    _mark(data, delim, WIDE_DELIMITERS + WIDE_LINE_BREAKS)
    if white_space_splits:
        delim |= space

    # list brackets: the first and last byte of a row that are no white space
    solid = np.flatnonzero(~space)
    head = _first_at_or_after(solid, starts, n)
    tail = np.where(np.searchsorted(solid, offsets[1:]) > 0, np.append(solid, 0)[np.searchsorted(solid, offsets[1:]) - 1], -1)
    padded = np.append(data, 0)
    listed = (head < offsets[1:]) & (padded[np.minimum(head, n)] == ord("["))
    closed = listed & (tail > head) & (padded[np.maximum(tail, 0)] == ord("]"))
    bracket = np.zeros(n, bool)
    bracket[head[listed]] = True
    bracket[tail[closed]] = True

    kind = np.zeros(n, np.uint8)
    kind[space | bracket] = SPACE
    kind[data == ord('"')] = DQUOTE
    kind[data == ord("'")] = SQUOTE
    kind[data == ord("\\")] = SLASH
    kind[delim & ~bracket] = DELIM
    state = _states(kind, starts, lengths)
    cut = (kind == DELIM) & np.isin(state, (START, BARE, END_D, END_S, CLOSED))

    quote = (kind == DQUOTE) | (kind == SQUOTE)
    opens = quote & (state == START)
    row_end = np.zeros(n, bool)
    row_end[offsets[1:][lengths > 0] - 1] = True
    doubled = ((kind == DQUOTE) & (state == END_D)) | ((kind == SQUOTE) & (state == END_S))
    ends = ((kind == DQUOTE) & (state == IN_D)) | ((kind == SQUOTE) & (state == IN_S))
    # a quote that turned out to stand inside a single-quoted value (an apostrophe) is content
    nxt = np.append(kind[1:], OTHER)
    apostrophe = ends & (kind == SQUOTE) & ~row_end & (nxt == OTHER)
    escape = ((state == ESC_D) | (state == ESC_S))
    slash = (kind == SLASH) & ((state == IN_D) | (state == IN_S))

    keep = ~(cut | bracket)
    keep &= ~(opens | (ends & ~apostrophe)) | doubled
    _unescape(data, keep, slash & ~row_end, escape)

    # segments between cuts; each row also starts one
    begin = np.union1d(starts[lengths > 0], np.flatnonzero(cut) + 1)
    begin = begin[begin < n]
    end = np.append(begin[1:], n)
    # trim: the kept bytes that are no white space bound a value
    content = np.flatnonzero(keep & ~space)
    low = _first_at_or_after(content, begin, n)
    high_at = np.searchsorted(content, end)
    high = np.where(high_at > 0, np.append(content, 0)[high_at - 1], -1)
    full = (low < end) & (high >= low)
    begin, low, high = begin[full], low[full], high[full]
    if not len(begin):
        return none
    inner = np.zeros(n + 1, np.int8)
    np.add.at(inner, low, 1)
    np.add.at(inner, high + 1, -1)
    keep &= np.cumsum(inner[:-1]) > 0
    kept = np.concatenate([[0], np.cumsum(keep)])
    # bytes of a value: from low to high, so that child offsets follow from the running count of kept bytes
    child = np.concatenate([kept[low], [kept[-1]]]).astype(np.int64)
    values = pa.LargeStringArray.from_buffers(len(low), pa.py_buffer(child), pa.py_buffer(data[keep]))
    parent = np.searchsorted(starts, begin, side="right") - 1
    counts = np.bincount(parent, minlength=len(texts))
    lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int64()), values)
    parents = np.asarray(lists.value_parent_indices() if hasattr(lists, "value_parent_indices") else pa.compute.list_parent_indices(lists))
    position = np.arange(len(parents)) - (np.cumsum(counts) - counts)[parents] + 1
    return parents, position, lists.flatten()


def _unescape(data: np.ndarray, keep: np.ndarray, slash: np.ndarray, escape: np.ndarray) -> None:
    """Write escaped characters in place and drop the bytes that only encode them. Unknown escapes stay as they are."""
    at = np.flatnonzero(slash)
    at = at[at + 1 < len(data)]
    if not len(at):
        return
    code = data[at + 1]
    for c, stands_for in ESCAPES.items():
        hit = at[code == ord(c)]
        data[hit + 1] = ord(stands_for)
        keep[hit] = False
        keep[hit + 1] = True
    hit = at[(code == ord("u")) & (at + 6 <= len(data))]
    if not len(hit):
        return
    digits = data[hit[:, None] + np.arange(2, 6)]
    value = np.full(digits.shape, -1, np.int64)
    for low, high, base in ((ord("0"), ord("9"), 0), (ord("a"), ord("f"), 10), (ord("A"), ord("F"), 10)):
        ok = (digits >= low) & (digits <= high)
        value[ok] = digits[ok].astype(np.int64) - low + base
    good = (value >= 0).all(axis=1)
    hit, point = hit[good], (value[good] * np.array([4096, 256, 16, 1])).sum(axis=1)
    low_half = (point >= 0xDC00) & (point < 0xE000)
    high_half = (point >= 0xD800) & (point < 0xDC00)
    pair = np.zeros(len(hit), bool)
    if len(hit) > 1:
        pair[:-1] = high_half[:-1] & low_half[1:] & (hit[1:] == hit[:-1] + 6)
    second = np.zeros(len(hit), bool)
    second[1:] = pair[:-1]
    full = point.copy()
    full[pair] = 0x10000 + ((point[pair] - 0xD800) << 10) + (point[np.flatnonzero(pair) + 1] - 0xDC00)
    full[(high_half | low_half) & ~pair & ~second] = 0xFFFD
    for k in range(6):
        keep[hit + k] = False
    single = ~second
    hit, full = hit[single], full[single]
    for width, low, high in ((1, 0, 0x80), (2, 0x80, 0x800), (3, 0x800, 0x10000), (4, 0x10000, 0x110000)):
        sel = (full >= low) & (full < high)
        h, p = hit[sel], full[sel]
        if width == 1:
            data[h] = p
        else:
            data[h] = ((0xF00 >> width) & 0xFF) | (p >> (6 * (width - 1)))
            for k in range(1, width):
                data[h + k] = 0x80 | ((p >> (6 * (width - 1 - k))) & 0x3F)
        for k in range(width):
            keep[h + k] = True


def split_packed_to_array(df: DataFrame, key: str, field: str, *, white_space_splits: bool = False, items: str = "items") -> DataFrame:
    """(``key``, ``items``): the values packed in ``field`` as an array, one row per row of ``df`` and without a shuffle.

    Values are those of ``split_packed``; a field without values gives an empty array.
    """
    kind = df.schema[key].dataType
    source = df.select(F.col(key).alias("key"), F.col(field).cast("string").alias("field"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parent, _, values = split_packed_array(b.column(1), white_space_splits)
            counts = np.bincount(parent, minlength=b.num_rows) if len(parent) else np.zeros(b.num_rows, np.int64)
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, values.cast(pa.string()))], names=["key", "items"])

    return source.mapInArrow(split, f"key {kind.simpleString()}, items array<string>").toDF(key, items)


def split_packed(
    df: DataFrame, key: str, field: str, *, white_space_splits: bool = False, pos: str = "pos", item: str = "item"
) -> DataFrame:
    """One row (``key``, ``pos``, ``item``) for each value packed in ``field``.

    Commas, semicolons, vertical bars (of any width), tabs and line breaks outside quotes separate values;
    with ``white_space_splits`` any white space does too. A quote encloses only if it opens the value.
    Null, empty and blank fields yield no rows; empty values are skipped and not counted; repeated values
    and repeated rows are kept; a field of any length is read whole; an unclosed quote runs to the end of
    the field. Only ``key`` and ``field`` are read, so further columns of any name do not matter.
    """
    kind = df.schema[key].dataType
    source = df.select(F.col(key).alias("key"), F.col(field).cast("string").alias("field"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parent, position, values = split_packed_array(b.column(1), white_space_splits)
            if len(parent):
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(parent)), pa.array(position, pa.int32()), values.cast(pa.string())], names=["key", "pos", "item"]
                )

    out = source.mapInArrow(split, f"key {kind.simpleString()}, pos int, item string")
    return out.toDF(key, pos, item)
