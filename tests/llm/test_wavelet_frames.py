"""Lookups in a wavelet file decompress a few frames, not the file."""

import numpy as np
import pytest

from casefile.llm import wavelet


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 8 * 64, 16 * 64, 16 * 64 + 1, 5000])
def test_lookups_over_many_frames(n, monkeypatch):
    monkeypatch.setattr(wavelet, "CHUNK", 8)
    tokens = np.random.default_rng(n).integers(0, 37, n).astype("<u4")
    file = wavelet.WaveletFile(wavelet.build(tokens, np.zeros(1, int), [1]))
    assert file.decode().tolist() == tokens.tolist() and file._held == {}
    assert [file.access(k) for k in range(0, n, 7)] == tokens[::7].tolist()
    for token in (0, 5, 36, 63, 64):
        places = np.flatnonzero(tokens == token).tolist()
        assert file.occurrences(token) == places
        for low, high in ((0, n), (n // 3, n // 2), (n // 2, n)):
            assert file.count(token, low, high) == sum(low <= k < high for k in places)


def test_a_lookup_leaves_most_of_the_file_compressed():
    n = 1 << 21
    tokens = np.random.default_rng(3).integers(0, 1 << 10, n).astype("<u4")
    data = wavelet.build(tokens, np.zeros(1, int), [1])

    def read(lookup):
        file, sizes = wavelet.WaveletFile(data), []
        unpack = file._unpack
        file._unpack = lambda frame: sizes.append(len(frame)) or unpack(frame)
        found = lookup(file)
        return found, sum(sizes)

    found, size = read(lambda f: f.access(1_500_000))
    assert found == tokens[1_500_000] and size < len(data) / 2
    found, size = read(lambda f: f.find(7, 100))
    assert found == np.flatnonzero(tokens == 7)[100] and size < len(data)
