"""op 1: prefixes at the bounds of range partitions."""

from __future__ import annotations

import random

from test_llm import brute_repeats, docs, words

from schemaloom.llm import suffix


def test_prefixes_at_bounds_of_partitions_are_settled_without_a_row_for_each_run(spark, monkeypatch):
    """A passage in all texts stands in many range partitions; each text has a stretch of its own around it, and every third a copy."""
    rng = random.Random(21)
    core = words(rng, 60, 10**6)
    texts = [" ".join(words(rng, 30, 10**6) + core + words(rng, 30, 10**6)) for _ in range(150)]
    texts += texts[::3]
    frames, written = [], suffix.written
    monkeypatch.setattr(suffix, "written", lambda df, *more: (frames.append(written(df, *more)), frames[-1])[1])
    found = suffix.repeats(docs(spark, texts)).collect()
    lost = {}
    for r in found:
        lost.setdefault(r["doc"], set()).update(range(r["pos"], r["pos"] + r["n"] + suffix.LEAST - 1))
    assert lost == dict(brute_repeats(texts))
    assert next(df for df in frames if "edge" in df.columns).filter("edge").count() > 2
    assert next(df for df in frames if "open" in df.columns).filter("open").count() > 0
    runs = [df for df in frames if df.columns == ["g", "w", "doc", "c", "pos"]]
    assert len(runs) == 1 and runs[0].count() == 0
