"""Removed passages against brute force: every string of ``length`` bytes is counted over all texts."""

import random
from collections import Counter

import pytest

from quillset.llm import repeats


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        edges = [i for i in range(1, len(d)) if gone[i] != gone[i - 1]]
        bounds = [0, *edges, len(d)]
        spans = [(a, b) for a, b in zip(bounds[:-1], bounds[1:], strict=True) if b > a and gone[a]]
        out.append((len(d), tuple(spans), bytes(c for c, g in zip(d, gone, strict=True) if not g)))
    return Counter(out)


def texts_of(rng, words):
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [prose(rng.randint(8, 60)) for _ in range(6)]
    hot = prose(30)
    texts = [None, "", "short", "a" * 700, "ab" * 400, "abc" * 300 + "x" * 300, "é" * 300, "日本" * 150]
    for k in range(60):
        parts = [prose(rng.randint(0, 40)) for _ in range(3)]
        parts.insert(rng.randint(0, 3), hot if k % 3 == 0 else rng.choice(passages))
        texts.append(" ".join(parts))
    for t in rng.sample(texts[8:], 15):  # near copies: one or two words changed
        w = t.split(" ")
        for _ in range(rng.randint(1, 2)):
            w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    return texts + [texts[20]] * 9 + [hot, hot + "!", "!" + hot]


@pytest.mark.parametrize(("seed", "length", "piece"), [(1, 200, 1 << 20), (2, 64, 1 << 20), (3, 200, 2000), (4, 100, 900)])
def test_removed_passages(spark, monkeypatch, seed, length, piece):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgéß日") for _ in range(rng.randint(1, 9))) for _ in range(400 if seed % 2 else 40)]
    texts = texts_of(rng, words)
    texts += [texts[30] + "".join(rng.choice("xyz") for _ in range(3000)) + texts[31]]
    # Small pieces make long texts of ordinary ones; places then meet only in the shuffle.
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 20_000)
    rows = [(None if i % 7 == 0 else i // 2, t, 1, "x", 2) for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "doc_id long, text string, n long, codes string, k int").repartition(4)
    got = repeats.without_repeats(table, length=length, slice_bytes=piece).collect()
    assert Counter((r.n_bytes, tuple((s.start, s.end) for s in r.spans), bytes(r.kept)) for r in got) == brute(texts, length)
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)


def test_no_rows(spark):
    table = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.without_repeats(table).count() == 0
    with pytest.raises(ValueError):
        repeats.without_repeats(table, length=4)
