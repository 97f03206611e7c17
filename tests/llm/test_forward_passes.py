"""Scores of trained models against plain loops over words and characters."""

import math

import numpy as np
import xxhash

from duoscope.llm import toxicity


def plain_toxicity(model, text):
    """Embedding, filters, max pooling and the logistic layer, word by word and in double precision."""
    edges = "".join(chr(c) for c in [*range(0x21, 0x30), *b":;<=>?@[]^_`{|}~"])
    rows = []
    for word in text.split():
        w = word.lower().strip(edges).encode()
        own = {b"^" + w + b"$"} | {b"^" + w[:n] for n in range(3, 10) if n < len(w)} | {w[-n:] + b"$" for n in (3, 5) if n < len(w)}
        hashed = [xxhash.xxh64_intdigest(x) // 2 ** (64 - toxicity.BITS) for x in own]
        rows.append([sum(float(model.table[h, d]) for h in hashed) / len(hashed) for d in range(toxicity.DIM)])
    total = model.bias
    for k, width in enumerate(toxicity.WIDTHS):
        for f in range(toxicity.FILTERS):
            col = k * toxicity.FILTERS + f
            windows = [sum(rows[i + j][d] * float(model.kernels[k][j, d, f]) for j in range(width) for d in range(toxicity.DIM)) for i in range(len(rows) - width + 1)]
            if windows:
                total += float(model.out[col]) * max(0.0, max(windows) + float(model.shifts[col]))
    return 1 / (1 + math.exp(-(model.slope * total + model.intercept)))


def test_toxicity_score_equals_a_plain_loop():
    g = np.random.default_rng(3)
    n = len(toxicity.WIDTHS) * toxicity.FILTERS
    kernels = [g.normal(0, 0.4, (w, toxicity.DIM, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS]
    model = toxicity.Model(g.normal(0, 0.5, (1 << toxicity.BITS, toxicity.DIM)).astype(np.float32), kernels, g.normal(0, 0.3, n).astype(np.float32), g.normal(0, 0.5, n).astype(np.float32), 0.1, 1.3, -0.2)
    texts = ["", "one", "Two words!", "a b c d e f g", "(Quoted) unquestionably, Wörter und noch mehr Wörter", "x " * 50 + "end"]
    got = toxicity.scores(model, toxicity.Embedder(model.table), [t.encode() for t in texts])
    for t, p in zip(texts, got, strict=True):
        assert abs(p - plain_toxicity(model, t)) < 1e-4
