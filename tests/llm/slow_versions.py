"""Slow versions that several tests hold operators against."""

from __future__ import annotations

import itertools


def slow_survivors(texts: dict) -> set:
    sets = {}
    for i, text in texts.items():
        words = (text or "").lower().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
    label = {i: i for i in texts}
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(sorted(texts), 2):
            near = len(sets[a] & sets[b]) * 5 >= len(sets[a] | sets[b]) * 4
            if near and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return set(label.values())
