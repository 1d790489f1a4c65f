"""Anchors of windows: every window has one, equal windows the same one, on texts that repeat too."""
import random
import time

import numpy as np
import pytest

from corpusloom.llm import suffixdedup


def check(docs, length=50):
    raw, starts = b"".join(docs), np.cumsum([0] + [len(d) for d in docs]).astype(np.int64)
    at, first, last, _ = suffixdedup.anchors(raw, starts, length)
    windows = {w for s, e in zip(starts, starts[1:]) for w in range(s, e - length + 1)}
    got = {w: p for p, a, b in zip(at.tolist(), first.tolist(), last.tolist()) for w in range(a, b + 1)}
    assert set(got) == windows and sum((last - first + 1).tolist()) == len(windows)
    place = {}
    for w, p in got.items():
        assert w <= p <= w + length - suffixdedup.GRAM
        assert place.setdefault(raw[w : w + length], p - w) == p - w


def test_equal_windows_have_equal_anchors():
    draw = random.Random(3)
    for _ in range(200):
        letters = draw.choice([b"a", b"ab", b"-=", bytes(range(97, 123))])
        docs = [bytes(draw.choice(letters) for _ in range(draw.choice([0, 1, 49, 50, 51, 130, 400]))) for _ in range(draw.randint(1, 8))]
        check(docs)
        check([(d[:7] * 60)[: draw.randint(0, 300)] for d in docs])


@pytest.mark.parametrize("text", [b"a" * 4_000_000, b"-=" * 2_000_000])
def test_repetitive_text_is_no_loop(text):
    t = time.time()
    at, first, last, _ = suffixdedup.anchors(text, np.array([0, len(text)]), 50)
    assert time.time() - t < 20 and int((last - first + 1).sum()) == len(text) - 49
