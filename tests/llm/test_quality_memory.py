"""What the driver keeps while it fits the document classifier."""

from __future__ import annotations

import pyarrow as pa

from bazaarflow.llm import quality


def test_only_clear_features_are_kept_for_the_fit(spark, monkeypatch):
    rows = [(n, f"{'fine' if n % 2 else 'spoiled'} text {n} " + " ".join(f"w{n}x{k}" for k in range(200)), n % 2 == 1,
             quality.KINDS[0] if n % 2 else quality.KINDS[1]) for n in range(120)]
    seen, real = [], quality._fit

    def watched(doc, bucket, chosen, dense, good):
        seen.append((len(doc), len(bucket), bool(chosen[bucket].all()), len(good), pa.total_allocated_bytes()))
        return real(doc, bucket, chosen, dense, good)

    monkeypatch.setattr(quality, "_fit", watched)
    before = pa.total_allocated_bytes()
    model = quality.fit_documents(spark.createDataFrame(rows, "id long, text string, good boolean, kind string"))
    (docs, buckets, clear, texts, held), = seen
    assert docs == buckets < 120 * 20 and clear and texts == 120
    assert held - before < 1 << 16  # the sample's table is gone
    assert (model.buckets != 0).sum() > 0
