"""Near copies by shingle overlap against brute force."""

import random

import corpus_pipeline
import pytest
from aerolake.llm import simhash

from . import support


def _shingles(text):
    words = support.WORD.findall(text.translate({c: c + 32 for c in range(65, 91)}))
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _alike(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def kept_rows(rows):
    """The row that stays of each group of (doc_id, text) rows: smallest doc_id, none last."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    sets = [_shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(n):
        while label[n] != n:
            n = label[n]
        return n

    for j in range(len(rows)):
        for i in range(j):
            if _alike(sets[i], sets[j]):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return [r for n, r in enumerate(rows) if root(n) == n]


def _kept(rows):
    return sorted(i for i, _ in kept_rows(rows))


def _edited():
    """Copies of texts with edits that put them on both sides of the bound, and chains of copies."""
    rng = random.Random(3)
    rows = []
    for family in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 400))]
        for _ in range(8):
            rows.append((len(rows), " ".join(words)))
            words = list(words)
            for _ in range(rng.randrange(1, 2 + len(words) // 40)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(5000)}"
    return rows + [(900, "One two."), (901, "one  TWO."), (902, "one two three"), (903, " "), (904, None)]


@pytest.mark.parametrize("which", ["tables", "edited"])
def test_stage_leaves_no_near_copy(spark, sf_dir, which):
    stages = dict(corpus_pipeline.STAGES)
    docs = support.documents(spark, sf_dir) if which == "tables" else support.table(spark, _edited())
    single = stages["exact dedup"](spark, docs, sf_dir)
    given = support.pairs(single)
    found = stages["near dedup"](spark, single, sf_dir)
    assert found.columns == docs.columns
    assert sorted(i for i, _ in support.pairs(found)) == _kept(given)
    assert len(_kept(given)) < len(given)


def test_rows_that_share_or_lack_a_number(spark):
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(3, text + " a"), (4, text + " b"), (4, "another text of its own"), (None, text), (None, "no number, one text")]
    found = corpus_pipeline.near_dedup(spark, support.table(spark, rows), "")
    assert {(i, t) for i, t in support.pairs(found)} == {rows[0], rows[2], rows[4]}
    assert simhash.near_copies(support.empty(spark)).count() == 0


def test_rows_of_one_number_are_judged_each_by_itself(spark):
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(2, text), (4, text + " more"), (4, "quite another text, of six words")]
    found = corpus_pipeline.near_dedup(spark, support.table(spark, rows), "")
    assert sorted(support.pairs(found)) == [rows[0], rows[2]]


def test_crowded_anchors(spark, monkeypatch):
    """Fingerprints that agree on one half, dealt on twice, have the links of a plain comparison."""
    import numpy as np
    from aerolake.llm import graph

    rng = random.Random(4)
    half, other = rng.getrandbits(32), rng.getrandbits(32)
    prints = set()
    while len(prints) < 300:
        p = half << 32 | other ^ rng.getrandbits(8)
        for bit in rng.sample(range(64), rng.randrange(6)):
            p ^= 1 << bit
        prints.add(p)
    given = np.array(sorted(prints), np.uint64)
    keyed = {}
    for side in range(2):
        for i, anchor in zip(*simhash.anchors(simhash._half(given, side))):
            keyed.setdefault(int(anchor) + (side << 32), []).append(int(given[i]))
    monkeypatch.setattr(simhash, "CROWD", 5)
    import pyarrow as pa

    links, level = [], 0
    while keyed:
        level += 1
        rows = sorted((k, p) for k, v in keyed.items() for p in v)
        table = {"key": pa.array([k for k, _ in rows], pa.int64()), "fp": pa.array(np.array([p for _, p in rows], np.uint64).view(np.int64))}
        whole, keyed = pa.RecordBatch.from_pydict(table), {}
        for batch in simhash._link_batches(level)([whole.slice(k, 64) for k in range(0, len(rows), 64)]):
            a, b = (batch.column(c).to_numpy() for c in "ab")
            if batch.num_rows and batch.column("level")[0].as_py():
                for k, p in zip(a.tolist(), b.view(np.uint64).tolist()):
                    keyed.setdefault(k, []).append(p)
            else:
                links += zip(a.tolist(), b.tolist())
    assert level == 3
    roots = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    from .test_brute import _components

    mine = {}
    for p in given.view(np.int64).tolist():
        mine.setdefault(roots.get(p, p), set()).add(p)
    theirs = {}
    signed = given.view(np.int64).tolist()
    for n, _, c in _components(list(enumerate(given.tolist()))):
        theirs.setdefault(c, set()).add(signed[n])
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_large_group_of_half_copies(spark):
    rng = random.Random(6)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for n in range(150):
        words = list(base)
        for _ in range(rng.randrange(3, 6)):
            words[rng.randrange(150)] = f"x{rng.randrange(5)}"
        rows.append((n, " ".join(words)))
    found = corpus_pipeline.near_dedup(spark, support.table(spark, rows), "")
    assert sorted(i for i, _ in support.pairs(found)) == _kept(rows)
