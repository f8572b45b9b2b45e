"""Token ids from a ``tokenizers`` file, with a memo of white-space separated chunks.

A tokenizer that drops white space encodes a text as its chunks, one after the other.
Chunks repeat, so a worker keeps the ids of those it has met (at most ``MEMO_CHUNKS``;
the memo is then begun anew).  A batch of texts is cut into chunks and looked up as
arrays.  Among new chunks, plain letters with trailing marks go to the library's BPE
model at once; all others, one by one, through the whole library.  Chunks are told
apart by 128 bits of hash.  A tokenizer of another kind gets whole texts.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

MEMO_CHUNKS = 500_000
#: Slots of the memo's table, a power of two; it doubles where one batch needs more.
MEMO_SLOTS = 1 << 20
#: Bytes of text encoded at once; the tables for hashing chunks are as long.
TOKEN_BYTES = 1 << 19
#: Chunks given to the library in one string.
CALL_WORDS = 256


def _byte_letters() -> np.ndarray:
    """Byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for 256, 257, ..."""
    code = np.arange(256)
    same = ((code >= ord("!")) & (code <= ord("~"))) | ((code >= 0xA1) & (code != 0xAD))
    return np.where(same, code, 255 + np.cumsum(~same))


class Encoder:
    """Encodes batches of texts to unsigned 32-bit ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.words = Tokenizer(self.library.model)  # words are given in the byte-level alphabet
        self.words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.letters = _byte_letters()
        self.kinds = np.full(256, 2, np.int8)
        self.kinds[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = 1
        self.kinds[[c for c in range(128) if chr(c).isalpha()]] = 0
        spaces = np.zeros(256, bool)
        spaces[[9, 10, 11, 12, 13, 32]] = True
        self.spaces = spaces
        random = np.random.default_rng(7)
        self.codes = random.integers(0, 1 << 63, (2, 256), np.int64).astype(np.uint64)
        self.factor = (random.integers(0, 1 << 62, 2).astype(np.uint64) << np.uint64(2)) | np.uint64(1)
        self.powers = np.ones((2, 1), np.uint64)
        self.inverse = np.ones((2, 1), np.uint64)
        self._forget()
        # the memo is only for a lower-casing word BPE that drops white space
        probe = "Hey, ÉTÉ ça\n  va don't x-y."
        whole = self._whole(probe)
        try:
            self.direct = True
            self.direct = np.array_equal(self.encode([probe.encode()])[0], whole) and np.array_equal(
                np.concatenate([self._whole(c) for c in probe.split()]), whole)
        except (IndexError, ValueError):
            self.direct = False

    def _forget(self) -> None:
        self.known = 0
        self.slot_key = np.zeros(MEMO_SLOTS, np.uint64)
        self.slot_entry = np.full(MEMO_SLOTS, -1, np.int32)
        self.check = np.zeros(0, np.uint64)
        self.size = np.zeros(0, np.int64)
        self.place = np.zeros(0, np.int64)
        self.flat = np.zeros(4096, np.uint32)
        self.used = 0

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        bits = len(self.slot_key).bit_length() - 1
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)

    def _entries(self, keys: np.ndarray) -> np.ndarray:
        """Memo entries of chunks, -1 for those not known: whole arrays are looked up at once."""
        out, left, slot = np.full(len(keys), -1, np.int64), np.arange(len(keys)), self._slots(keys)
        while len(left):
            entry = self.slot_entry[slot]
            hit = (self.slot_key[slot] == keys[left]) & (entry >= 0)
            out[left[hit]] = entry[hit]
            more = (entry >= 0) & ~hit
            left, slot = left[more], (slot[more] + 1) % len(self.slot_key)
        return out

    def _remember(self, keys: np.ndarray, entries: np.ndarray) -> None:
        """Give new, different keys a slot; the table stays at most half full."""
        if 2 * (self.known + len(keys)) > len(self.slot_key):
            held = self.slot_entry >= 0
            keys = np.concatenate([self.slot_key[held], keys])
            entries = np.concatenate([self.slot_entry[held], entries])
            size = 1 << int(2 * len(keys)).bit_length()
            self.slot_key, self.slot_entry = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        slot = self._slots(keys)
        while len(keys):
            free = self.slot_entry[slot] < 0
            self.slot_entry[slot[free]] = entries[free]  # of several that want one slot, one gets it
            got = self.slot_entry[slot] == entries
            self.slot_key[slot[got]] = keys[got]
            keys, entries, slot = keys[~got], entries[~got], (slot[~got] + 1) % len(self.slot_key)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def _plain(self, raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which chunks (``raw`` holds them one after the other) are plain, and the class of each byte.

        Plain: Latin-1 letters, then perhaps ASCII marks.  Classes: 0 letter, 1 mark, 2 anything else.
        """
        kind = self.kinds[raw]
        lead = np.flatnonzero(raw[:-1] == 0xC3)
        follow = raw[lead + 1]
        good = (follow >= 0x80) & (follow <= 0xBF) & (follow != 0x97) & (follow != 0xB7)
        kind[lead[good]] = kind[lead[good] + 1] = 0
        begins = np.cumsum(sizes) - sizes
        back = np.zeros(len(raw), np.int8)  # a letter after a mark, in the same chunk
        back[1:] = (kind[1:] == 0) & (kind[:-1] == 1)
        back[begins] = kind[begins] != 0
        bad = np.add.reduceat((kind == 2) | (back == 1), begins) > 0
        return ~bad, kind

    def _plain_ids(self, raw: np.ndarray, kind: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain chunks and where each one's ids end: the letters are one word, the marks another."""
        low = raw.copy()
        low[(raw >= ord("A")) & (raw <= ord("Z"))] += 32
        second = np.flatnonzero(raw[:-1] == 0xC3) + 1
        second = second[raw[second] <= 0x9E]
        low[second] += 32
        begins = np.cumsum(sizes) - sizes
        gap = np.zeros(len(raw), bool)  # a blank goes before the marks and before each chunk
        gap[1:] = (kind[1:] == 1) & (kind[:-1] == 0)
        words = 1 + np.add.reduceat(gap, begins, dtype=np.int64)
        gap[begins] = True
        letters = np.insert(self.letters[low], np.flatnonzero(gap), ord(" "))
        cuts = (begins + np.cumsum(words) - words)[::CALL_WORDS].tolist()
        text = letters.astype("<u4").tobytes().decode("utf-32-le")
        calls = [text[b:e] for b, e in zip(cuts, [*cuts[1:], len(text)])]
        found = self.words.encode_batch_fast(calls, add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in found])
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != int(words.sum()):
            raise ValueError("a word did not end where a token ends it")
        return ids, ends[np.cumsum(words) - 1]

    def _learn(self, keys: np.ndarray, checks: np.ndarray, raw: np.ndarray, sizes: np.ndarray) -> None:
        """Add chunks to the memo, in the order given."""
        plain, kind = self._plain(raw, sizes)
        of_plain = np.repeat(plain, sizes)
        count = np.zeros(len(sizes), np.int64)
        parts = []
        if plain.any():
            ids, stops = self._plain_ids(raw[of_plain], kind[of_plain], sizes[plain])
            count[plain] = np.diff(stops, prepend=0)
            parts.append(ids)
        stop = np.cumsum(sizes)
        for k in np.flatnonzero(~plain).tolist():
            ids = self._whole(raw[stop[k] - sizes[k]:stop[k]].tobytes().decode())
            count[k] = len(ids)
            parts.append(ids)
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        place = np.zeros(len(sizes), np.int64)
        place[order] = self.used + np.cumsum(count[order]) - count[order]
        flat = np.concatenate(parts)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used:self.used + len(flat)] = flat
        self.used += len(flat)
        known = self.known
        self._remember(keys, known + np.arange(len(keys)))
        self.known += len(keys)
        self.check = np.concatenate([self.check[:known], checks])
        self.size = np.concatenate([self.size[:known], count])
        self.place = np.concatenate([self.place[:known], place])

    def _hashes(self, raw: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """Two 64-bit polynomial hashes of each chunk, from running sums."""
        if len(raw) > self.powers.shape[1]:
            size = 1 << len(raw).bit_length()
            steps = np.repeat(self.factor[:, None], size - 1, axis=1)
            self.powers = np.concatenate([np.ones((2, 1), np.uint64), np.cumprod(steps, axis=1)], axis=1)
            back = np.array([[pow(int(f), -1, 1 << 64)] for f in self.factor], np.uint64)
            self.inverse = np.concatenate([np.ones((2, 1), np.uint64),
                                           np.cumprod(np.repeat(back, size - 1, axis=1), axis=1)], axis=1)
        out = []
        for k in range(2):
            sums = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum(self.codes[k][raw] * self.powers[k, :len(raw)], out=sums[1:])
            mixed = (sums[ends] - sums[begins]) * self.inverse[k, begins]
            mixed ^= mixed >> np.uint64(29)
            out.append(mixed + (ends - begins).astype(np.uint64) * self.factor[1 - k])
        return out

    def encode(self, texts: Sequence[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 texts (null: empty) -> all ids, and where each text's ids end."""
        if not self.direct:
            return self._apart(texts)
        joined = b" ".join(t or b"" for t in texts)
        raw = np.frombuffer(joined, np.uint8)
        last = np.cumsum([len(t or b"") + 1 for t in texts], dtype=np.int64) - 1  # where each text ends in ``joined``
        solid = np.zeros(len(raw) + 2, np.int8)
        solid[1:-1] = ~self.spaces[raw]
        turns = np.diff(solid)
        begins, ends = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
        if not len(begins):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        keys, checks = self._hashes(raw, begins, ends)
        if self.known >= MEMO_CHUNKS:
            self._forget()
        entry = self._entries(keys)
        new = np.flatnonzero(entry < 0)
        if len(new):
            known = self.known
            unique, first, back = np.unique(keys[new], return_index=True, return_inverse=True)
            picked = new[first]
            if not np.array_equal(checks[picked][back], checks[new]):
                return self._apart(texts)
            sizes = ends[picked] - begins[picked]
            chosen = np.repeat(begins[picked] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
            self._learn(unique, checks[picked], raw[chosen], sizes)
            entry[new] = known + back
        if not np.array_equal(self.check[entry], checks):
            return self._apart(texts)
        size = self.size[entry]
        stop = np.cumsum(size)
        ids = self.flat[np.repeat(self.place[entry] - (stop - size), size) + np.arange(int(stop[-1]))]
        through = np.searchsorted(begins, last)  # chunks up to each text's end
        return ids, np.concatenate([[0], stop])[through]

    def _apart(self, texts: Sequence[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Encode this batch without the memo (another kind of tokenizer, or chunks that share a hash)."""
        parts = [self._whole((t or b"").decode()) for t in texts]
        return np.concatenate([np.zeros(0, np.uint32), *parts]), np.cumsum([len(p) for p in parts], dtype=np.int64)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file (read once per worker process)."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def with_end(ids: np.ndarray, stops: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Put the end id after each text."""
    out = np.insert(ids, stops, np.uint32(end_id)) if len(stops) else ids
    return out.astype("<u4", copy=False), stops + np.arange(1, len(stops) + 1)


def public_tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))
