"""Tests for the findings of the fourth round."""

from __future__ import annotations

import difflib
import math
import random


def test_shared_grams_are_counted_by_zones():
    """edited copies that can be alike leave a task; texts whose halves changed places share their grams elsewhere only."""
    from scholium.operators import alike

    rng, t = random.Random(5), 0.92 - 1e-6
    syllables = ["".join(rng.choices("abcdehinorst日", k=rng.choice([2, 3]))) for _ in range(90)]
    for length in (8, 30, 60, 120, 1050):
        plain = ["".join(rng.choices(syllables, k=2 + length))[: rng.randrange(length - length // 10, length + 1)] for _ in range(20)]
        texts, sources = [*plain, "a" * length, "a" * (length - length // 12)], []
        for share in (0.02, 0.05, 0.07):
            for k, text in enumerate(plain):
                edited = list(text)
                for z in rng.sample(range(len(text)), math.ceil(share * len(text))):
                    edited[z] = rng.choice(["", "x", "yz"])
                sources.append((k, len(texts)))
                texts.append("".join(edited))
        sources.append((20, 21))
        turned = [(k, len(texts) + k) for k in range(20)]
        texts += [x[len(x) // 2 :] + x[: len(x) // 2] for x in plain]
        wanted = {x for x in sources if difflib.SequenceMatcher(None, *(texts[k] for k in x)).ratio() >= 0.92 and texts[x[0]] != texts[x[1]]}
        pairs = lambda found: {(min(x), max(x)) for x in found}
        ids = list(range(len(texts)))
        met = pairs(alike._met((ids, texts), None, t))
        assert wanted <= met and wanted
        cut = [[k for k in ids if k % 3 == 0], [k for k in ids if k % 3]]
        sides = [(x, [texts[k] for k in x]) for x in cut]
        assert pairs(alike._met(*sides, t)) == {x for x in met if (x[0] % 3 == 0) != (x[1] % 3 == 0)}
        assert length < 1000 or not met & set(turned)


def test_memories_of_a_user_are_folded_without_frames(monkeypatch):
    """a batch's candidates of a user are taken in order as they are; frames are neither joined, sorted nor converted."""
    from types import SimpleNamespace

    import pandas as pd

    from scholium.config import DEFAULTS
    from scholium.streaming import memories

    for name in ("sort_values", "to_dict", "astype"):
        monkeypatch.setattr(pd.DataFrame, name, None)
    monkeypatch.setattr(pd.Series, "astype", None)
    kept, numbers = {}, []
    handle = SimpleNamespace(
        getMapState=lambda *_: SimpleNamespace(iterator=lambda: iter(kept.items()), updateValue=kept.__setitem__, removeKey=kept.pop, containsKey=kept.__contains__),
        getValueState=lambda *_: SimpleNamespace(exists=lambda: bool(numbers), get=lambda: numbers[-1], update=numbers.append),
        registerTimer=lambda _: None, deleteTimer=lambda _: None,
    )
    made = memories._Rememberer("at_us", "at_order", 0.92, DEFAULTS)
    made.init(handle)
    row = {"at_us": 5, "memory_type": "semantic", "memory_key": "k", "importance": 0.5, "confidence": 0.5, "embedding": None, "session_id": float("nan")}
    parts = [pd.DataFrame([row | {"at_order": 3, "content": "likes cats"}, row | {"at_order": 1, "content": "lives in Rome"}]), pd.DataFrame([row | {"at_order": 2, "content": "lives in Rome", "session_id": 7.0, "at_us": 9}])]
    (log,) = made.handleInputRows(("u",), iter(parts), SimpleNamespace(getCurrentWatermarkInMs=lambda: 0))
    rows = [tuple(x) for x in zip(*(log[c].tolist() for c in ("seq", "id", "change", "content", "session_id", "updated_at", "superseded_by")), strict=True)]
    assert rows == [(1, 1, "superseded", "lives in Rome", 7, 9, 2), (2, 2, "inserted", "likes cats", None, 9, None)] and list(kept) == [(2,)]
