"""The counterfactual classifier's scores against gradient steps in plain Python, over all that the operator does from texts to scores."""

import math
import random
import zlib

from folioforge.llm import toxicity


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return {w.encode() for w in "".join(c if c.isalnum() or ord(c) > 127 else " " for c in low).split()}


def counts_of(text):
    out = {}
    for w in words_of(text):
        for b in [zlib.crc32(w) % (1 << 20), *(zlib.crc32(b"^" + w[:n]) % (1 << 20) for n in (3, 4, 5, 6, 7, 8) if len(w) >= n)]:
            out[b] = out.get(b, 0) + 1
    return out


def plain_scores(train, texts):
    """train: (id, text, label), all of them to learn from."""
    train = sorted(train, key=lambda r: str(r[0]))
    feats = [counts_of(t) for _, t, _ in train]
    ys = [float(y) for *_, y in train]
    n, pos = len(train), int(sum(ys))
    chosen = {b for w in toxicity.TERMS for b in counts_of(w)}
    ranked = []
    for b in {b for f in feats for b in f}:
        seen = sum(b in f for f in feats)
        bad = sum(b in f for f, y in zip(feats, ys, strict=True) if y)
        share = (seen + 1) / (n + 2)
        z = abs((bad / pos - (seen - bad) / (n - pos)) / math.sqrt(share * (1 - share) * (1 / pos + 1 / (n - pos))))
        if seen >= toxicity.LEAST_TEXTS and z >= toxicity.LEAST_Z:
            ranked.append((-z, b))
    chosen |= {b for _, b in sorted(ranked)[: toxicity.FEATURES]}
    pairs = {}
    for i, t, _ in train:
        for p in toxicity.swaps(t, zlib.crc32(str(i).encode())):
            pairs[p] = pairs.get(p, 0) + 1
    change = {}
    for gone, come in pairs:
        d = {b: c for b, c in counts_of(toxicity.TERMS[come]).items()}
        for b, c in counts_of(toxicity.TERMS[gone]).items():
            d[b] = d.get(b, 0) - c
        change[gone, come] = d
    all_of = sum(pairs.values())
    w, bias = dict.fromkeys(chosen, 0.0), 0.0
    m, v = dict.fromkeys([*chosen, None], 0.0), dict.fromkeys([*chosen, None], 0.0)
    few = [[(b, c) for b, c in f.items() if b in chosen] for f in feats]
    for step in range(1, toxicity.STEPS + 1):
        grad = {b: toxicity.L2 * x for b, x in w.items()}
        grad[None] = 0.0
        for f, y in zip(few, ys, strict=True):
            logit = bias + sum(w[b] * c for b, c in f)
            e = (1 / (1 + math.exp(-logit)) - y) * (0.5 / pos if y else 0.5 / (n - pos))
            grad[None] += e
            for b, c in f:
                grad[b] += e * c
        for p, d in change.items():
            moved = sum(w[b] * c for b, c in d.items())
            for b, c in d.items():
                grad[b] += 2 * toxicity.COUNTERFACTUAL * pairs[p] / all_of * moved * c
        for b, g in grad.items():
            m[b], v[b] = 0.9 * m[b] + 0.1 * g, 0.999 * v[b] + 0.001 * g * g
            move = toxicity.RATE * (m[b] / (1 - 0.9**step)) / (math.sqrt(v[b] / (1 - 0.999**step)) + 1e-8) * (1 - step / (toxicity.STEPS + 1))
            if b is None:
                bias -= move
            else:
                w[b] -= move
    return [1 / (1 + math.exp(-(bias + sum(w.get(b, 0.0) * c for b, c in counts_of(t).items())))) for t in texts]


def test_scores_equal_plain_gradient_steps(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "STEPS", 60)
    rng = random.Random(13)
    mild, foul = ["tree", "river", "music", "garden", "paper", "muslim", "women"], ["rotten", "vile", "scum", "filth"]
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 != 1][:60]
    rows = []
    for k, i in enumerate(ids):
        y = int(k % 3 == 0)
        rows.append((i, " ".join(rng.choice(mild + foul * y) for _ in range(12)) + (" " + rng.choice(foul) if y else ""), y))
    texts = [t for _, t, _ in rows] + ["", "vile garden of women", "women and tree", "gay garden", "Rotten filth!"]
    more = list(range(1000, 1000 + len(texts) - len(rows)))
    docs = spark.createDataFrame([*((i, t) for i, t, _ in rows), *zip(more, texts[len(rows) :], strict=True)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows], "doc_id bigint, toxic int, quality int")
    got = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels).collect()}
    want = dict(zip([*ids, *more], plain_scores(rows, texts), strict=True))
    assert got.keys() == want.keys()
    assert max(abs(got[i] - want[i]) for i in want) < 1e-3
    assert want[more[1]] > want[more[2]]
