"""Decontamination with items that share most of their text."""

from __future__ import annotations

import random
import time

OPENING = "according to the following passage which of these statements "


def made(n, seed=2):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("aeioubcdfglmnprst") for _ in range(r.randint(3, 8))) for _ in range(2000)]
    say = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    items = [(i, OPENING + say(r.randint(8, 20))) for i in range(n)]
    texts = []
    for j in range(10):
        parts = []
        for k in range(20):
            tail = items[(j * 20 + k) % n][1][len(OPENING) :] if k % 4 == 0 else say(15)
            if k % 8 == 0:
                tail = tail.replace("a", "", 2)
            parts.append(say(20) + " " + OPENING + tail)
        texts.append(" ".join(parts))
    return items, texts


def distance(item, text):
    """Smallest edit distance of the item to any passage, by the full table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        last, row = row, [i] + [0] * len(text)
        for j, x in enumerate(text, 1):
            row[j] = min(last[j - 1] + (c != x), last[j] + 1, row[j - 1] + 1)
    return min(row)


def test_crowds_against_brute_force(monkeypatch):
    from lodestar.llm import decontamination as m

    items, texts = made(12)
    raw = [(i, m.normalised(t)) for i, t in items]
    docs = [m.normalised(t)[:2500] for t in texts[:2]] + [b"", m.normalised(OPENING)]
    want = {}
    for d, t in enumerate(docs):
        for k, (_, item) in enumerate(raw):
            x = distance(item, t)
            if x <= int(0.08 * len(item)) and x <= len(item) // 8 - 1:
                want.setdefault(d, {})[k] = x
    assert want
    for many in (1, 1 << 30):
        monkeypatch.setattr(m, "MANY", many)
        assert m.Items(raw, 0.08, 8, 24).find(docs) == want, many


def test_crowds_of_any_size_agree(monkeypatch):
    from lodestar.llm import decontamination as m

    items, texts = made(150)
    items += [(1000 + i, f"question number {i} asks for the sum of {i} and {i + 1} as a number") for i in range(60)]  # nearly alike
    texts += ["and here question number 7 asks for the sum of 7 and 8 as a number again", "x " * 50]
    raw, docs = [(i, m.normalised(t)) for i, t in items], [m.normalised(t) for t in texts]
    found = []
    for many in (2, 1 << 30):
        monkeypatch.setattr(m, "MANY", many)
        found.append(m.Items(raw, 0.08, 8, 24).find(docs))
    assert found[0] == found[1] and len(found[0]) >= 11


def test_five_thousand_items_with_one_opening():
    from lodestar.llm import decontamination as m

    items, texts = made(5000)
    known = m.Items([(i, m.normalised(t)) for i, t in items], 0.08, 8, 24)
    docs = [m.normalised(t) for t in texts]
    began = time.process_time()
    found = known.find(docs)
    assert time.process_time() - began < 10 and sum(map(len, found.values())) >= 50
