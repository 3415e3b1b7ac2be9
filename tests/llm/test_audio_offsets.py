"""Alignment against a plain comparison of all offsets, with bit errors up to the limit."""

import numpy as np

from emberlog.llm.audio import Block


def plain(query, other, max_error, least_overlap):
    best = None
    for offset in range(-len(other) + 1, len(query)):
        a, b = max(0, offset), min(len(query), len(other) + offset)
        if b - a >= min(least_overlap, len(query), len(other)):
            error = sum(int(x).bit_count() for x in query[a:b] ^ other[a - offset : b - offset]) / (32 * (b - a))
            if error <= max_error and (best is None or (error, abs(offset), offset) < best):
                best = (error, abs(offset), offset)
    return best


def test_noisy_alignments_are_all_found():
    rng = np.random.default_rng(4)
    queries = [(f"q{k}", rng.integers(0, 1 << 32, n, dtype=np.uint32)) for k, n in enumerate([84, 60, 30, 8, 84])]
    found = 0
    for rate in (0.0, 0.1, 0.15, 0.18):
        for _, query in queries:
            other = query[len(query) // 5 :].copy()
            other ^= np.packbits(rng.random((len(other), 32)) < rate, axis=1).view(np.uint32).ravel()
            want = [(name, best[2], best[0]) for name, q in queries if (best := plain(q, other, 0.2, 24))]
            for cells in (1 << 18, 150):
                block = Block(queries)
                block.CELLS = cells
                got = block.aligned([other, other[:0], other[::-1].copy(), other], 0.2, 24)
                assert sorted(got[0]) == sorted(want) == sorted(got[3]) and got[1] == []
            found += len(want)
    assert found >= 16


def test_empty_recording_aligns_with_nothing():
    assert Block([("q", np.arange(9, dtype=np.uint32))]).aligned([np.zeros(0, dtype=np.uint32)], 0.2, 24) == [[]]


def test_spectra_hold_the_offsets_of_enough_overlap_and_little_else(monkeypatch):
    rng = np.random.default_rng(6)
    queries = [(f"q{k}", rng.integers(0, 1 << 32, 84, dtype=np.uint32)) for k in range(3)]
    others = [q.copy() for _, q in queries]
    want = Block(queries).aligned(others, 0.2, 24)
    widths, inverse = [], np.fft.irfft

    def counted(spectra, width, axis):
        widths.append(width)
        return inverse(spectra, width, axis=axis)

    monkeypatch.setattr(np.fft, "irfft", counted)
    assert Block(queries).aligned(others, 0.2, 24) == want == [[(name, 0, 0.0)] for name, _ in queries]
    assert widths and max(widths) <= 1.1 * (84 + 84 - 24)  # the next power of two is 256


def test_offsets_at_the_edge_of_wrapped_spectra():
    rng = np.random.default_rng(7)
    queries = [(f"q{k}", rng.integers(0, 1 << 32, n, dtype=np.uint32)) for k, n in enumerate([84, 65, 128, 40, 33, 24, 7, 1, 84])]
    others = [rng.integers(0, 1 << 32, n, dtype=np.uint32) for n in (84, 65, 127, 50, 24, 5, 1)]
    for _, q in queries:  # shared: one end of each, as short as counts, one less, one more
        for n in (23, 24, 25):
            others.append(np.concatenate([q[-n:], rng.integers(0, 1 << 32, 60, dtype=np.uint32)]))
            others.append(np.concatenate([rng.integers(0, 1 << 32, 60, dtype=np.uint32), q[:n]]))
    for max_error, least_overlap in ((0.2, 24), (0.45, 24), (0.2, 1), (0.5, 200)):
        want = [sorted((name, best[2], best[0]) for name, q in queries if (best := plain(q, other, max_error, max(1, least_overlap)))) for other in others]
        for near in (1 << 18, 300):
            block = Block(queries)
            block.NEAR = near
            assert [sorted(x) for x in block.aligned(others, max_error, least_overlap)] == want
        assert sum(map(len, want)) >= 40
