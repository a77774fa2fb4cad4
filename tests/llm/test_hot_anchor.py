"""An anchor that stands often in one document only."""

from collections import Counter

import numpy as np

from wiretide.llm import suffix_dedup

from .test_operators import brute_repeats


def test_anchor_of_one_long_document_is_hot(spark, monkeypatch):
    rng = np.random.default_rng(3)
    random = lambda n: bytes(rng.integers(97, 123, n, dtype=np.uint8)).decode()
    for _ in range(1000):  # a separator that is the least-hashed anchor of the windows around it
        sep = random(48)
        text = "".join(random(200) + sep for _ in range(30))
        if np.unique(suffix_dedup.anchors(text.encode())[1], return_counts=True)[1].max() > 20:
            break
    text += text[:500]
    hot = []
    real = suffix_dedup._hot_spans
    monkeypatch.setattr(suffix_dedup, "_hot_spans", lambda *a: hot.append(1) or real(*a))
    df = spark.createDataFrame([(1, text), (2, random(300))], "doc_id long, text string")
    out = suffix_dedup.remove_repeats(df, hot=10).select("n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert hot == [1]
    assert Counter(map(tuple, out)) == Counter(brute_repeats([r.text.encode() for r in df.collect()], 200))
