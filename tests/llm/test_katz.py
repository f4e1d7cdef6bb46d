from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import pytest

from dxspark.llm import katz
from dxspark.llm.common import stored, table
from tests.conftest import SF_SMALL
from tests.llm import brute


def plain_katz(rows):
    docs = [(i, brute.WORD.findall(brute.ascii_lower(t or "")) + ["</s>"], zlib.crc32(str("" if i is None else i).encode()) % 7 == 2) for i, t in rows]
    uni, bi, ctx = Counter(), Counter(), Counter()
    for _, w, held in docs:
        if not held:
            uni.update(w)
            pairs = list(zip(["<s>", *w[:-1]], w, strict=True))
            bi.update(pairs)
            ctx.update(p[0] for p in pairs)
    total = sum(uni.values())
    of = lambda c: [0] + [sum(v == r for v in c.values()) for r in range(1, katz.TOP + 2)]
    d2, d1 = katz.discounts(of(bi)), katz.discounts(of(uni))
    disc = lambda d, r: d[r] if r <= katz.TOP else r - katz.BACK
    left = (total - sum(disc(d1, r) for r in uni.values())) / total if total else 1.0
    p1 = lambda w: disc(d1, uni[w]) / total if uni[w] else left
    after: dict = {}
    for (h, w), r in bi.items():
        after.setdefault(h, []).append((w, r))
    alpha = {h: (1 - sum(disc(d2, r) for _, r in x) / ctx[h]) / (1 - sum(p1(w) for w, _ in x)) for h, x in after.items()}
    p2 = lambda h, w: disc(d2, bi[h, w]) / ctx[h] if bi[h, w] else alpha.get(h, 1.0) * p1(w)
    out = []
    for i, w, held in docs:
        base = sum(math.log10((uni[x] + 1) / (total + len(uni) + 1)) for x in w)
        score = sum(math.log10(p2(h, x)) for h, x in zip(["<s>", *w[:-1]], w, strict=True))
        out.append((i, held, len(w), sum(uni[x] > 0 for x in w), total, base, score))
    return out, p2, uni, ctx


def same(got, want):
    got = sorted((tuple(r) for r in got), key=lambda r: repr(r[:5]) + f"{r[5]:.3f}")
    want = sorted(want, key=lambda r: repr(r[:5]) + f"{r[5]:.3f}")
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for a, b in zip(got, want, strict=True):
        assert a[5] == pytest.approx(b[5], abs=1e-6) and a[6] == pytest.approx(b[6], rel=1e-5, abs=1e-3)


@pytest.mark.parametrize(("chunk", "bucket"), [(katz.CHUNK_TOKENS, katz.BUCKET_BYTES), (700, 9000)])
def test_katz(spark, chunk, bucket):
    docs = stored(table(spark, SF_SMALL, "documents").select("doc_id", "text").unionByName(brute.edge_documents(spark).select("doc_id", "text")), "k")
    got = katz.katz_scores(docs, chunk_tokens=chunk, bucket_bytes=bucket * 10 if chunk == 700 else bucket).collect()
    want, p2, uni, ctx = plain_katz([(r.doc_id, r.text) for r in docs.collect()])
    same(got, want)
    for h in random.Random(1).sample(sorted(ctx), 15):  # exactly normalised, with one unknown word
        assert sum(p2(h, w) for w in [*uni, "\0never"]) == pytest.approx(1, abs=1e-9)


def test_no_training_rows(spark):
    held = [k for k in range(50) if zlib.crc32(str(k).encode()) % 7 == 2]
    docs = spark.createDataFrame([(k, "a b a b") for k in held], "doc_id bigint, text string")
    assert all(r.held_out and r.train_tokens == 0 and r.n_known == 0 and r.score == pytest.approx(0) for r in katz.katz_scores(docs).collect())
    assert katz.katz_scores(docs.where("doc_id < 0")).count() == 0
