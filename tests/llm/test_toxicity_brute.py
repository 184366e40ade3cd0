"""Toxicity against a plain version: numerical slopes of the risk, word sets in dictionaries, one document at a time."""

import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from hunksieve.llm import toxicity


def logistic(z):
    return 1 / (1 + math.exp(-z))


def slope_by_differences(texts, positive, prior, w):
    """Slope of what a step goes down: the risk, or what is below zero of its negative part, turned round."""

    def parts(w):
        p = [logistic(sum(w[f] for f in t) + w[-1]) for t in texts]
        toxic, other = [a for a, b in zip(p, positive, strict=True) if b], [a for a, b in zip(p, positive, strict=True) if not b]
        held = sum(other) / len(other) - prior * sum(toxic) / len(toxic)
        return prior * sum(1 - a for a in toxic) / len(toxic), held

    turned = parts(w)[1] < 0
    goal = lambda w: -parts(w)[1] if turned else sum(parts(w))
    out = []
    for i in range(len(w)):
        up, down = list(w), list(w)
        up[i] += 1e-5
        down[i] -= 1e-5
        out.append((goal(up) - goal(down)) / 2e-5)
    return out, turned


def plain_fit(texts, positive, prior, width, steps, rate=0.1, decay=1e-5):
    w, m, v, turns = [0.0] * width + [-1.0], [0.0] * (width + 1), [0.0] * (width + 1), []
    for step in range(1, steps + 1):
        slopes, turned = slope_by_differences(texts, positive, prior, w)
        turns.append(turned)
        for i, g in enumerate(slopes):
            g += decay * w[i] if i < width else 0
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
        w = [x - rate * (m[i] / (1 - 0.9**step)) / (math.sqrt(v[i] / (1 - 0.999**step)) + 1e-10) for i, x in enumerate(w)]
    return w, turns


@pytest.mark.parametrize("prior", [0.1, 0.5])
def test_fit_against_differences(prior):
    rng = random.Random(8)
    texts = [sorted(rng.sample(range(8), rng.choice([1, 2, 4]))) for _ in range(30)]
    positive = [0 in t for t in texts]
    want, turns = plain_fit(texts, positive, prior, 8, steps=60)
    assert any(turns) and not all(turns)  # both branches
    w, b = toxicity.fit([np.array(t) for t in texts], np.array(positive), prior, 8, steps=60)
    assert np.allclose([*w, b], want, rtol=0, atol=1e-3)


def plain_model(docs, labels):
    """Features by name, their weights and the bias, from everything outside the held-out part."""
    inside = lambda d: d is not None and crc32(str(d).encode()) % 5
    toxic = {}
    for d, t in labels:
        if inside(d):
            toxic[d] = max(toxic.get(d, 0), t)
    prior = sum(toxic.values()) / len(toxic)
    own = [(d, {n for word in re.findall(r"\w+", (t or "").lower()) for n in ("w" + word, "4" + word[:4], "5" + word[:5])}) for d, t in docs if inside(d)]
    toxic_rows, all_rows = [f for d, f in own if toxic.get(d)], [f for _, f in own]
    p, u = Counter(n for f in toxic_rows for n in f), Counter(n for f in all_rows for n in f)
    chosen = []
    for name, count in p.items():
        rate = (u[name] + 1) / (len(all_rows) + 2)
        if count >= max(4, len(toxic_rows) // 50) and (count / len(toxic_rows) - rate) / math.sqrt(rate * (1 - rate) / len(toxic_rows)) >= 5:
            chosen.append(name)
    place = {n: i for i, n in enumerate(sorted(chosen))}
    texts = [[place[n] for n in f if n in place] for f in toxic_rows + all_rows]
    w, _ = plain_fit(texts, [True] * len(toxic_rows) + [False] * len(all_rows), min(max(prior, 0.001), 0.5), len(place), steps=400)
    return place, w


def test_scores_of_a_table(spark):
    rng = random.Random(3)
    bad, good = ["Grobian!", "schurke", "ÄRGER"], [f"wort{i}x" for i in range(60)]
    docs, labels = [], []
    for i in range(110):
        toxic = int(i % 7 == 0)
        docs.append((i, " ".join(rng.choices(good, k=6) + (rng.sample(bad, 2) if toxic else [])), "labels"))
        labels.append((i, toxic, "text"))
    docs += [(110, None, "x"), (111, "", None), (112, "Schurke " * 3000, "x"), (None, "grobian schurke", "x"), docs[0], docs[7]]
    labels += [(None, 1, "x"), (7, 1, "x"), (500, 1, "x"), (501, 0, "x")]
    place, w = plain_model([d[:2] for d in docs], [x[:2] for x in labels])
    assert len(place) >= 5
    frame, marks = spark.createDataFrame(docs, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int, text string")
    model = toxicity.train(frame, marks)
    assert len(model.index) == len(place)
    for r in toxicity.score_toxicity(frame, model).collect():
        names = {n for word in re.findall(r"\w+", (r.text or "").lower()) for n in ("w" + word, "4" + word[:4], "5" + word[:5])}
        assert abs(r.score - logistic(sum(w[place[n]] for n in names if n in place) + w[-1])) < 0.02
