"""Line dedup against a plain version of all three kinds of template."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import pytest


def brute(docs, least, depth=3, similarity=0.7, constant=0.6):
    """What is left of each text, and which kind each template had."""
    mask = lambda token: "<*>" if re.search("[0-9]", token) else token
    lines = {}  # (doc, place): leaf, masked tokens
    for i, text in docs:
        for at, line in enumerate((text or "").split("\n")):
            if line.strip(" "):
                tokens = [mask(t) for t in line.split(" ")]
                lines[i, at] = ((len(tokens), tuple(tokens[:depth])), tuple(tokens))
    reach = lambda of: {k for k, n in Counter(k for k, _ in {(k, d) for k, d in of}).items() if n >= least}
    leaves = reach((leaf, d) for (d, _), (leaf, _) in lines.items())
    left = {k: v for k, v in lines.items() if v[0] in leaves}
    template = {}
    exact = reach((v, d) for (d, _), v in left.items())
    template |= {k: ("line", *v) for k, v in left.items() if v in exact}
    left = {k: v for k, v in left.items() if k not in template}
    by_leaf = defaultdict(list)
    for k, (leaf, tokens) in left.items():
        by_leaf[leaf].append((k, tokens))
    alike = []
    for leaf, own in by_leaf.items():
        common = [Counter(t[p] for _, t in own).most_common(1)[0] for p in range(leaf[0])]
        wanted = [t if 2 * n > len(own) else None for t, n in common]
        alike += [(leaf, k) for k, tokens in own if sum(a == b for a, b in zip(tokens, wanted, strict=True)) >= similarity * leaf[0]]
    main = reach((leaf, k[0]) for leaf, k in alike)
    template |= {k: ("leaf", leaf) for leaf, k in alike if leaf in main}
    left = {k: v for k, v in left.items() if k not in template}
    holders = defaultdict(set)
    for (d, _), (leaf, tokens) in left.items():
        for p, t in enumerate(tokens):
            holders[leaf, p, t].add(d)
    found = defaultdict(set)
    for k, (leaf, tokens) in left.items():
        own = [(p, t, len(holders[leaf, p, t])) for p, t in enumerate(tokens) if len(holders[leaf, p, t]) >= least]
        if len(own) < constant * leaf[0]:
            continue
        for level in range(int(math.floor(math.log2(max(n for *_, n in own) / least))) + 1):
            stay = tuple((p, t) for p, t, n in own if n >= least * 2**level)
            if len(stay) >= constant * leaf[0]:
                found[k].add(("frequent", leaf, stay))
    shared = reach((s, k[0]) for k, own in found.items() for s in own)
    for k, own in found.items():
        if own & shared:
            template[k] = max(own & shared, key=lambda s: len(s[2]))
    first = {}
    for k, t in template.items():
        first[t] = min(first.get(t, k), k)
    gone = {k for k, t in template.items() if first[t] != k}
    kept = {i: None if text is None else "\n".join(x for at, x in enumerate(text.split("\n")) if (i, at) not in gone) for i, text in docs}
    return kept, Counter(t[0] for t in template.values())


@pytest.mark.parametrize("seed", [1, 2])
def test_all_kinds_of_template(spark, seed):
    from lodestar.llm.line_dedup import drop_recurring_lines

    r = random.Random(seed)
    word = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    docs = []
    for i in range(70):
        lines = [
            f"Read more of our news at {r.randrange(100)} today",
            f"Posted here by {word(5)} in the group {r.choice(('red', 'blue', 'green', word(4)))} now",
            f"Posted here by {word(5)} under old rules of {r.choice(('may', 'june', word(3)))}",
            f"Go on now to {r.choice('ABCDE')} or to {r.choice('FGHIJ')} with us and {word(3)}",
            " ".join(word(4) for _ in range(r.randint(2, 9))),
            "",
            "Go on now " + " ".join(word(3) for _ in range(9)),
            "Go on now " + " ".join(word(3) for _ in range(9)),
        ]
        r.shuffle(lines)
        docs.append((i, "\n".join(lines[: r.randint(2, 8)])))
    docs += [(100, None), (101, ""), (102, "Read more of our news at 7 today\n" * 5)]
    want, kinds = brute(docs, 4)
    assert min(kinds[k] for k in ("line", "leaf", "frequent")) >= 10, kinds
    got = {x.doc_id: x.text for x in drop_recurring_lines(spark.createDataFrame(docs, "doc_id bigint, text string"), min_docs=4).collect()}
    assert got == want
