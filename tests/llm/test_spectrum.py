"""The fingerprints' short-time Fourier transforms, peaks and pairs against plain loops."""

from __future__ import annotations

import cmath
import math
import random

import numpy as np

from cairnbook.llm import media


def plain_peaks(samples):
    """Each frame's transform by its sum; magnitudes in the module's units of a sixteenth."""
    n = max(1, 1 + (len(samples) - media.FRAME) // media.HOP)
    window = [0.5 - 0.5 * math.cos(2 * math.pi * k / media.FRAME) for k in range(media.FRAME)]
    bins = media.FRAME // 2 + 1
    turn = [cmath.exp(-2j * math.pi * k / media.FRAME) for k in range(media.FRAME)]
    size = []
    for f in range(n):
        x = [(samples[f * media.HOP + k] - 128) * window[k] for k in range(media.FRAME)]
        size.append([round(abs(sum(x[k] * turn[(k * b) % media.FRAME] for k in range(media.FRAME))) * 16) for b in range(bins)])
    out = []
    for f in range(n):
        loud = sum(size[f][media.BANDS[0][0] :]) / (bins - media.BANDS[0][0]) * media.LOUDNESS
        for a, b in media.BANDS:
            best = max(range(a, b), key=lambda k: (size[f][k], -k))
            v = size[f][best]
            around = [size[max(0, f - 1)][best], size[min(n - 1, f + 1)][best], size[f][best - 1], size[f][best + 1]]
            if v > loud and all(v >= w for w in around):
                out.append((f, best))
    return out


def plain_pairs(peaks):
    out = []
    for i, (t, a) in enumerate(peaks):
        for u, b in peaks[i + 1 : i + 1 + media.FAN_OUT]:
            if u - t <= media.MOST_FRAMES_APART:
                out.append(t << 32 | a << 20 | b << 8 | u - t)
    return sorted(out)


def test_peaks_and_pairs_against_plain_loops():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij ") for _ in range(rng.randint(3, 9))) for _ in range(40)]
    raw = media.padded((" ".join(rng.choice(words) for _ in range(900))).encode()[: media.PAD * 8])
    samples = np.frombuffer(raw, np.uint8)
    when, which = media.spectrum_peaks(samples)
    got = [*zip(when.tolist(), which.tolist(), strict=True)]
    want = plain_peaks(raw)
    assert len(want) > 20
    # magnitudes are rounded from single precision there, so one of hundreds may fall on the other side
    assert len({*got} ^ {*want}) <= 2
    assert media.pair_codes(when, which).tolist() == plain_pairs(got)


def test_blocks_of_frames_change_nothing(monkeypatch):
    samples = np.frombuffer(bytes(random.Random(1).randrange(256) for _ in range(media.PAD * 30)), np.uint8)
    whole = [x.tolist() for x in media.spectrum_peaks(samples)]
    monkeypatch.setattr(media, "BLOCK", 5)
    assert [x.tolist() for x in media.spectrum_peaks(samples)] == whole
