import re
from collections import defaultdict

import pytest
from messy import ROWS

from loomline.llm import mixing as M


def targets(sizes, share=1.5, weights=(5, 2, 1), most=2):
    """Budgets by handing out excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(w[s] for s in open_)
        full = {s for s in open_ if left * w[s] / total > most * sizes[s]}
        if not full:
            out |= {s: left * w[s] / total for s in open_}
            break
        for s in full:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in full)
        open_ -= full
    return out


def test_budgets_and_whole_documents(docs, no_docs):
    got = M.mix(docs).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, text, _, source in [r[:4] for r in ROWS]:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want = targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert len(got) == len(ROWS) and all(taken[s] == round(want[s]) for s in sizes)
    assert M.mix(no_docs).count() == 0


def test_reruns_and_buckets_agree(docs):
    a, b = (sorted((r.doc_id, r.size, r.taken) for r in M.mix(d, bucket_rows=n).collect()) for d, n in ((docs, 20_000), (docs.repartition(5), 2)))
    assert a == b


def test_rows_of_the_mix(docs, no_docs):
    plan, rows = M.mix(docs).collect(), M.mixed_rows(docs)
    assert rows.columns == docs.columns
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows.collect())
    assert words == sum(r.taken for r in plan)
    assert M.mixed_rows(no_docs).count() == 0
