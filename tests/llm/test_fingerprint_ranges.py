"""Fingerprints where ties are common, and ranges of documents with and without ids."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa

from exposia.llm import fingerprints as fp


def test_equal_texts_agree_wherever_they_stand(monkeypatch):
    monkeypatch.setattr(fp, "_TABLE_BITS", 2)  # few draws: most minima are ties
    monkeypatch.setattr(fp, "_TABLES", [])
    rng = random.Random(1)
    text = " ".join(f"w{rng.randrange(90)}" for _ in range(400))
    other = " ".join(f"v{rng.randrange(90)}" for _ in range(333))
    found = []
    for rows in (16_384, 7, 50, 101):
        monkeypatch.setattr(fp, "_ROWS", rows)
        for texts in ([text], [other, text], [other[:50], other, text, text]):
            found.append(fp.signatures(pa.array(texts, pa.large_string()))[0][-1])
    assert all(np.array_equal(found[0], f) for f in found)


def test_next_documents_across_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(fp, "PART_BYTES", 400)
    rng = random.Random(2)
    texts = ["".join(rng.choices("abc é\n", k=rng.randint(0, 60))) for _ in range(300)]
    rows = [(i if i % 3 else None, t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    marked = frame.selectExpr("doc_id", "text", "xxhash64(text) as mark").collect()
    line = sorted(marked, key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.mark))

    def edited(a, b):
        n = len(a) // 3
        return hashlib.sha256((a[: len(a) - n] + b[:n]).encode()).hexdigest()

    want = sorted((a.doc_id or -1, len(a.text), edited(a.text, b.text)) for a, b in zip(line, line[1:] + line[:1]))
    got = fp.fingerprints(frame).collect()
    assert sorted((r.doc_id or -1, r.n_chars, r.edited_sha256) for r in got) == want
