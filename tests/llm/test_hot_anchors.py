"""Passages that very many texts share never bring more than a batch of bytes to one suffix array."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from duoscope.llm import substring_dedup


def removal(rows, w):
    c = Counter(b[i : i + w] for _, x in rows for b in [x.encode()] for i in range(len(b) - w + 1))
    want = Counter()
    for d, x in rows:
        b = x.encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - w + 1):
            if c[b[i : i + w]] > 1:
                gone[i : i + w] = True
        n = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want[d, len(b), int(gone.sum()), n, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()] += 1
    return want


@pytest.mark.parametrize("common", [512, 10])
def test_shared_passage(spark, monkeypatch, common):
    batch, whole = 20_000, substring_dedup.repeated_starts

    def bounded(chunks, window):
        assert sum(map(len, chunks)) < 2 * batch
        return whole(chunks, window)

    monkeypatch.setattr(substring_dedup, "repeated_starts", bounded)
    r = random.Random(0)
    word = lambda: "".join(r.choice("abcdefgh ") for _ in range(r.randrange(300, 600)))
    passage = "".join(r.choice("ABCDEFGHé ") for _ in range(480))
    rows = [(k, word() + passage + word()) for k in range(150)] + [(k, word() + passage[: r.randrange(380, 440)] + word()) for k in range(150, 200)] + [(200, "x" * 3000), (201, word())]
    got = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), common=common, batch=batch)
    assert Counter(map(tuple, got.collect())) == removal(rows, 400)
