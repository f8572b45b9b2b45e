"""Token ids from a byte-level ``tokenizers`` file, with a memo of blank-separated chunks.

The pre-tokenizer of such a file never joins a blank to the word before it.  A text may
therefore be cut before each single blank: chunk by chunk, the ids are those of the whole
text.  The exception is a blank between white space and white space (or the end), since a
run of white space is cut before its last character only; a text with one goes whole to
the library.  Chunks repeat, so a worker keeps the ids of those it has met, at most
``MEMO_CHUNKS``, and gives new ones to the library many at a time.  Only the token at the
beginning of a chunk begins with a blank, which tells where each chunk's ids begin.

A file with another pre-tokenizer, or with a normalizer, gets whole texts.
"""

from __future__ import annotations

import itertools
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MEMO_CHUNKS = 1_000_000
#: Chunks given to the library in one string.
CALL_CHUNKS = 512
#: Fixed value: the byte-level alphabet's letter for a blank.
BLANK = "Ġ"
#: Memo entry of a chunk that sends its text to the library whole.
_WHOLE = -2


def _whole_only(part: str) -> bool:
    """Whether the text after a blank may continue a run of white space (in any regex engine's view)."""
    first = part[:1]
    return not first or first.isspace() or (ord(first) > 127 and not first.isalnum())


class ByteEncoder:
    """Encodes batches of texts to unsigned 32-bit ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        made = json.loads(self.library.to_str())
        cutter = made.get("pre_tokenizer") or {}
        self.direct = (cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True)
                       and not cutter.get("add_prefix_space") and made.get("normalizer") is None
                       and not any(a["lstrip"] or a["rstrip"] or " " in a["content"] for a in made["added_tokens"]))
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.highest = max(vocabulary.values(), default=0)
        self.blank = np.zeros(self.highest + 1, bool)
        self.blank[[i for t, i in vocabulary.items() if t.startswith(BLANK)]] = True
        self._forget()

    def _forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.size = np.zeros(1 << 14, np.int64)
        self.place = np.zeros(1 << 14, np.int64)
        self.known = 0
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def _keep(self, keys: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.known + len(keys) > len(self.size):
            self.size = np.concatenate([self.size, np.zeros_like(self.size)])
            self.place = np.concatenate([self.place, np.zeros_like(self.place)])
        to = self.known + len(keys)
        self.memo.update(zip(keys, range(self.known, to)))
        self.size[self.known:to] = sizes
        self.place[self.known:to] = self.used + np.cumsum(sizes) - sizes
        self.flat[self.used:self.used + len(ids)] = ids
        self.known, self.used = to, self.used + len(ids)

    def _learn(self, keys: list[str]) -> None:
        """Add chunks to the memo.  A key with a blank in front is the beginning of a text, without that blank."""
        plain = [k for k in keys if k[:1].isalnum()]
        if len(plain) < len(keys):
            for key in itertools.filterfalse(lambda k: k[:1].isalnum(), keys):
                if key[:1] == " ":
                    ids = self.whole(key[1:])
                    self._keep([key], ids, np.array([len(ids)]))
                elif _whole_only(key):
                    self.memo[key] = _WHOLE
                else:
                    plain.append(key)
        calls = [plain[n:n + CALL_CHUNKS] for n in range(0, len(plain), CALL_CHUNKS)]
        for call, made in zip(calls, self.library.encode_batch_fast(
                [" " + " ".join(c) for c in calls], add_special_tokens=False)):
            ids = np.array(made.ids, np.uint32)
            begins = np.flatnonzero(self.blank[ids])
            if len(begins) != len(call):  # not seen yet; the chunks are then encoded one by one
                parts = [self.whole(" " + c) for c in call]
                ids = np.concatenate(parts)
                begins = np.cumsum([0] + [len(p) for p in parts[:-1]])
            self._keep(call, ids, np.diff(begins, append=len(ids)))

    def _look_up(self, keys: list[str]) -> np.ndarray:
        """Memo entries of chunks; those not known are learned."""
        look, unknown = self.memo.get, itertools.repeat(-1)
        at = np.fromiter(map(look, keys, unknown), np.int64, len(keys))
        new = np.flatnonzero(at == -1)
        if len(new):
            chosen = [keys[n] for n in new.tolist()]
            self._learn(list(dict.fromkeys(chosen)))
            at[new] = np.fromiter(map(look, chosen, unknown), np.int64, len(chosen))
        return at

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Texts (null: empty) -> all ids, and where each text's ids end."""
        texts = pc.fill_null(texts, "")
        if not self.direct:
            return self._apart(texts.to_pylist())
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        cut = pc.split_pattern(texts, " ")
        ends = np.cumsum(pc.list_value_length(cut).to_numpy(), dtype=np.int64)  # no text has fewer than one chunk
        firsts = np.concatenate([[0], ends[:-1]])
        chunks = cut.flatten()
        coded = chunks.dictionary_encode()
        keys = coded.dictionary.to_pylist()
        openings = [" " + t for t in chunks.take(pa.array(firsts)).to_pylist()]
        if len(self.memo) >= MEMO_CHUNKS:
            self._forget()
        at = self._look_up(keys)[coded.indices.to_numpy()]
        at[firsts] = self._look_up(openings)
        given = {n: self.whole(texts[n].as_py())
                 for n in np.unique(np.searchsorted(ends, np.flatnonzero(at == _WHOLE), side="right")).tolist()}
        if given:
            keep = np.ones(len(at), bool)
            for n in given:
                keep[firsts[n]:ends[n]] = False
            ends = np.concatenate([[0], np.cumsum(keep)])[ends]
            at = at[keep]
        size = self.size[at]
        stop = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(self.place[at] - stop[:-1], size) + np.arange(stop[-1])]
        stops = stop[ends]
        if given:
            parts = np.split(ids, stops[:-1])
            for n, found in given.items():
                parts[n] = found
            return np.concatenate(parts), np.cumsum([len(p) for p in parts], dtype=np.int64)
        return ids, stops

    def _apart(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = [self.whole(t) for t in texts]
        return np.concatenate([np.zeros(0, np.uint32), *parts]), np.cumsum([len(p) for p in parts], dtype=np.int64)


_ENCODERS: dict[str, ByteEncoder] = {}


def byte_encoder(path: str) -> ByteEncoder:
    """The worker's encoder for a tokenizer file (read once per worker process)."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ByteEncoder(path)
    return _ENCODERS[path]
