"""Decontamination against a benchmark of several blocks."""

from __future__ import annotations

from termscan.llm import tiling


def test_a_task_holds_one_block_at_a_time(spark, monkeypatch):
    items = [(i, " ".join(f"item{i}word{k}" for k in range(12))) for i in range(6)]
    rows = [(i, f"before {t} after") for i, t in items] + [(10 + i, f"clean text number {i} of some words") for i in range(4)]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    held = []
    real = tiling._dropper
    monkeypatch.setattr(tiling, "_dropper", lambda shared, *a: held.append(len(shared) if isinstance(shared, list) else 1) or real(shared, *a))
    kept = tiling.without_leaks(documents, spark.createDataFrame(items, "item_id long, text string"), block_bytes=200)
    assert sorted(r["doc_id"] for r in kept.collect()) == [10, 11, 12, 13]
    assert len(held) > 1 and max(held) == 1, held
