"""Posting blocks: terms of contents, and blocks of postings as delta-coded numbers.

A term is a run of ASCII letters and digits within a string (``functions.strings``), in
lower case.  Its position is the number of terms before it in the file plus the number of
strings before its own, ASCII strings first: neighbours in one string are one apart, and
across strings more.

A block holds up to a fixed number of postings of one term in ascending document number:
the gaps between document numbers, the terms' counts, and the gaps between positions, each
as a byte string of variable-length numbers (seven bits a byte, lowest first, the eighth
bit set on all but the last).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from casefile.functions import strings

# ASCII letters in lower case and digits; 0 for all other bytes.
TERM_BYTE = np.zeros(256, np.uint8)
for _low, _high in ((0x30, 0x39), (0x61, 0x7A)):
    TERM_BYTE[_low:_high + 1] = np.arange(_low, _high + 1)
TERM_BYTE[0x41:0x5B] = np.arange(0x61, 0x7B)


def pack_numbers(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Variable-length bytes of non-negative numbers, and where each number ends."""
    size, most = np.ones(len(values), np.int64), int(values.max(initial=0))
    for bits in range(7, most.bit_length(), 7):
        size += values >= 1 << bits
    ends = np.cumsum(size)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    at, rest = ends - size, values
    while len(rest):  # each number's next seven bits, of those that have any left
        more = rest > 0x7F
        out[at] = (rest & 0x7F) | (more.astype(np.int64) << 7)
        at, rest = at[more] + 1, rest[more] >> 7
    return out, ends


def unpack_numbers(data: bytes | np.ndarray) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    last = np.flatnonzero(raw < 0x80)
    first = np.concatenate([[0], last[:-1] + 1])
    out = (raw[first] & 0x7F).astype(np.int64)
    size, nth = last - first, 1
    of = np.flatnonzero(size > 0)
    while len(of):  # the numbers that have an nth byte
        out[of] |= (raw[first[of] + nth] & 0x7F).astype(np.int64) << 7 * nth
        nth += 1
        of = of[size[of] >= nth]
    return out


def gaps(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Differences to the value before; the values at ``begins`` stay."""
    out = np.diff(values, prepend=0)
    out[begins] = values[begins]
    return out


def sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Undo ``gaps`` for groups of the given sizes."""
    total = np.cumsum(values)
    starts = np.cumsum(sizes) - sizes
    before = np.where(starts > 0, total[starts - 1], 0) if len(values) else np.zeros(len(sizes), np.int64)
    return total - np.repeat(before, sizes)


def terms_of(contents: Sequence[bytes], least: int = strings.LEAST):
    """Terms of many contents: (file, term code, position) arrays in order of (file, code, position), the
    terms by code, and each file's number of terms."""
    file, code, position, words, n_terms = coded_terms(contents, least)
    return file, code, position, words.to_pylist(), n_terms


def coded_terms(contents: Sequence[bytes], least: int = strings.LEAST):
    """``terms_of`` with the terms as an Arrow array."""
    joined = b"\n".join(contents)  # a line feed ends any string
    data = np.frombuffer(joined, np.uint8)
    starts = np.cumsum([0] + [len(c) + 1 for c in contents], dtype=np.int64)[:-1]
    at, size, wide = strings.runs(data, least)
    plain_at, plain_size = at[~wide], size[~wide]
    change = np.zeros(len(data) + 1, np.int8)
    change[plain_at] += 1
    change[plain_at + plain_size] -= 1
    letters = TERM_BYTE[data]
    letters[np.cumsum(change[:-1], dtype=np.int8) == 0] = 0
    begin, words = _words(letters)
    first_term, first_run = np.searchsorted(begin, starts), np.searchsorted(plain_at, starts)
    n_terms, n_runs = np.diff(first_term, append=len(begin)), np.diff(first_run, append=len(plain_at))
    file = np.repeat(np.arange(len(contents)), n_terms)
    of_run = np.repeat(np.arange(len(plain_at)), np.diff(np.searchsorted(begin, plain_at), append=len(begin)))
    position = np.arange(len(begin)) + of_run - (first_term + first_run)[file]
    more_words, more_file, more_position = [], [], []
    for a, n in zip(at[wide].tolist(), size[wide].tolist()):  # few files have any
        f = int(np.searchsorted(starts, a, side="right")) - 1
        for word in TERM_BYTE[data[a:a + 2 * n:2]].tobytes().replace(b"\0", b" ").split():
            more_words.append(word)
            more_file.append(f)
            more_position.append(int(n_terms[f] + n_runs[f]))
            n_terms[f] += 1
        n_runs[f] += 1
    if more_words:
        words = pa.concat_arrays([words, pa.array(more_words, pa.binary())])
        file = np.concatenate([file, np.array(more_file, np.int64)])
        position = np.concatenate([position, np.array(more_position, np.int64)])
    coded = words.dictionary_encode()
    code = coded.indices.to_numpy().astype(np.int64)
    order = grouped(file * len(coded.dictionary) + code, len(contents) * len(coded.dictionary))
    return file[order], code[order], position[order], coded.dictionary.cast(pa.string()), n_terms


def _words(letters: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Begins of the stretches of letters (other bytes are 0), and the stretches."""
    inside = letters > 0
    turns = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    begin, end = turns[::2], turns[1::2]
    return begin, slices(letters[inside], np.append(0, np.cumsum(end - begin)))


def grouped(keys: np.ndarray, n_keys: int) -> np.ndarray:
    """The order of ``keys`` (from 0, below ``n_keys``); equal ones stay as they are."""
    if n_keys * len(keys) >= 1 << 62:
        return np.argsort(keys, kind="stable")
    places = np.sort(keys.astype(np.int64) * len(keys) + np.arange(len(keys)))  # faster than a stable sort
    return places % max(len(keys), 1)


def slices(raw: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The byte strings between neighbouring ``cuts`` of ``raw``."""
    if len(raw) >= 1 << 31:
        raise ValueError("postings of one batch exceed 2 GiB")
    cuts = cuts.astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(cuts) - 1,
                                       [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(raw.tobytes())])


def joined(strings_: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings one after the other, and the cuts between them: undoes ``slices``.  Without a copy."""
    _, offsets, data = strings_.buffers()
    cuts = np.frombuffer(offsets, np.int32)[strings_.offset:strings_.offset + len(strings_) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[cuts[0]:cuts[-1]], cuts - cuts[0]


def leads(terms: pa.Array, size: int) -> np.ndarray:
    """The first ``size`` bytes of terms as numbers that order like the terms (a missing byte is 0)."""
    raw, cuts = joined(terms)
    at = cuts[:-1, None] + np.arange(size)
    held = np.where(at < cuts[1:, None], np.append(raw, np.uint8(0))[np.minimum(at, len(raw))], 0).astype(np.int64)
    return held @ (1 << 8 * np.arange(size - 1, -1, -1, dtype=np.int64))


def posting_cuts(raw: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The cuts between postings in packed positions, for postings with ``counts`` positions each."""
    return np.append(0, np.append(0, np.flatnonzero(raw < 0x80) + 1)[np.cumsum(counts)])


def part_chunks(chunks: pa.Array, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document gaps, counts and packed positions of chunks, each the three strings of ``encode`` in one.

    A chunk of n postings begins with n gaps and n counts; what is left are positions.
    """
    raw, cuts = joined(chunks)
    last = np.flatnonzero(raw < 0x80)
    starts = last[np.searchsorted(last, cuts[:-1]) + 2 * sizes - 1] + 1
    change = np.zeros(len(raw) + 1, np.int8)
    change[starts] += 1
    change[cuts[1:]] -= 1
    is_position = np.cumsum(change[:-1], dtype=np.int8) > 0
    numbers = unpack_numbers(raw[~is_position])
    is_gap = np.repeat(np.tile([True, False], len(sizes)), np.repeat(sizes, 2))
    return numbers[is_gap], numbers[~is_gap], raw[is_position]


def encode(docs: np.ndarray, counts: np.ndarray, raw: np.ndarray, cuts: np.ndarray, begins: np.ndarray) -> list[pa.Array]:
    """Groups of postings as three byte strings each: documents, counts, positions.

    ``begins`` are the groups' first postings; ``raw`` holds packed positions, cut by posting.
    """
    relative = gaps(docs, begins)
    relative[begins] = 0  # the first document is a column of its own
    places = np.append(begins, len(docs))
    coded = []
    for values in (relative, counts):
        packed, ends = pack_numbers(values)
        coded.append(slices(packed, np.append(0, ends)[places]))
    return [*coded, slices(raw[:cuts[-1]], cuts[places])]
