"""Repeats, fingerprints, passages and personal data against brute force."""

import hashlib
import random
import re
from collections import Counter

import pytest
import xxhash

from aerolake.llm import chaining, pii, simhash, suffix
from aerolake.llm import queries as registered

from . import support


def _repeats(texts):
    raw = [t.encode() for t in texts]
    n = suffix.LENGTH
    seen = Counter(r[i : i + n] for r in raw for i in range(len(r) - n + 1))
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - n + 1):
            if seen[r[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        kept = bytes(c for c, g in zip(r, gone) if not g)
        out.append((len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def _repeat_rows():
    rng = random.Random(11)

    def fresh(n):
        return "".join(rng.choices("abcdefgh ", k=n))

    shared, edge = fresh(900), fresh(400)
    rows = support.awkward()
    rows += [(200 + i, fresh(rng.randrange(300)) + shared[rng.randrange(300) :][: rng.randrange(350, 600)] + fresh(rng.randrange(300))) for i in range(40)]
    rows += [(300, edge), (301, "x" + edge), (302, edge[:399] + "é"), (303, fresh(50) + edge + edge + fresh(50)), (304, fresh(800)), (305, "é" * 350)]
    return rows


@pytest.mark.parametrize("which", ["tables", "awkward"])
@pytest.mark.parametrize("small", [False, True])
def test_repeats(spark, sf_dir, which, small, monkeypatch):
    if small and which == "tables":
        pytest.skip("once is enough")
    if small:  # every deeper split of an index
        monkeypatch.setattr(suffix, "GROUP", 3)
        monkeypatch.setattr(suffix, "WIDE_GROUP", 2)
    docs = support.documents(spark, sf_dir) if which == "tables" else support.table(spark, _repeat_rows())
    given = support.pairs(docs)
    expected = sorted(((i, *x) for (i, _), x in zip(given, _repeats([t for _, t in given]))), key=str)
    found = suffix.remove_repeats(docs)
    assert support.rows(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == expected


def test_repeats_of_nothing(spark):
    assert suffix.remove_repeats(support.empty(spark)).count() == 0


def _fingerprint(text):
    words = support.WORD.findall(text.translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(prints):
    """prints: (doc_id, fingerprint); the least doc_id reachable from each."""
    distinct = sorted({p for _, p in prints})
    label = {p: p for p in distinct}

    def root(p):
        while label[p] != p:
            p = label[p]
        return p

    for n, a in enumerate(distinct):
        for b in distinct[n + 1 :]:
            if (a ^ b).bit_count() <= simhash.THRESHOLD:
                label[root(a)] = root(b)
    least = {}
    for doc_id, p in prints:
        if doc_id is not None:
            least[root(p)] = min(least.get(root(p), doc_id), doc_id)
    return sorted(((i, f"{p:016x}", least.get(root(p))) for i, p in prints), key=str)


@pytest.mark.parametrize("which", ["tables", "awkward"])
def test_simhash(spark, sf_dir, which):
    if which == "tables":
        found, docs = registered.op9_simhash(spark, sf_dir), support.documents(spark, sf_dir)
    else:
        from pyspark.sql import functions as F

        docs = support.table(spark, support.awkward())
        found = simhash.near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
    expected = _components([(i, _fingerprint(t)) for i, t in support.pairs(docs)])
    assert support.rows(found, "doc_id", "fingerprint", "component_id") == expected


def test_simhash_links(spark):
    rng = random.Random(2)
    prints = [rng.getrandbits(64) for _ in range(150)]
    for _ in range(450):
        p = rng.choice(prints)
        for bit in rng.sample(range(64), rng.randrange(1, 6)):
            p ^= 1 << bit
        prints.append(p)
    from aerolake.llm import graph
    from aerolake.llm.common import signed

    df = spark.createDataFrame([(signed(p),) for p in sorted(set(prints))], "fp long")
    edges = simhash.links(df)
    roots = {r.node: r.root for r in graph.components(edges).collect()}
    mine = Counter(roots.get(signed(p), signed(p)) for p in set(prints))
    theirs = Counter(c for _, _, c in _components(list(enumerate(sorted(set(prints))))))
    assert sorted(mine.values()) == sorted(theirs.values())
    assert simhash.near_duplicates(support.empty(spark)).count() == 0


_BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(digits):
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _base_spans(text):
    out = []
    for order, (kind, pattern) in enumerate(_BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                "card": 12 <= len(digits) <= 19 and _luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), order, kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(out)]


def test_personal_data(spark, sf_dir):
    rng = random.Random(4)
    parts = ["a.b@c.de", "@", ".", "1.2.3.4", "999.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (30) 123-456 78", "+1", " ", "x", "é", "🎉", "-", "DE89 3704 0044 0532 0130 00", "ssn 123-45-6789", "123", "\n"]
    mixed = [(1000 + i, "".join(rng.choices(parts, k=rng.randrange(1, 30)))) for i in range(300)]
    for docs in (support.documents(spark, sf_dir), support.table(spark, support.awkward() + mixed)):
        expected = sorted(((i, str(_base_spans(t))) for i, t in support.pairs(docs)), key=str)
        got = [(r.doc_id, str([(s.kind, s.start, s.end) for s in r.spans if s.base])) for r in pii.find(docs).collect()]
        assert sorted(got, key=str) == expected
    assert pii.find(support.empty(spark)).count() == 0


def test_checksums_and_context():
    assert [s[0] for s in pii.spans("iban DE89 3704 0044 0532 0130 00")] == ["iban"]
    assert not [s for s in pii.spans("iban DE88 3704 0044 0532 0130 00") if s[0] == "iban"]
    assert [s[0] for s in pii.spans("social security 123-45-6789")] == ["ssn"]
    assert not pii.spans("lot 123-45-6789 of paint")
    assert pii.redacted("mail a@b.cd now") == "mail [EMAIL] now"


def test_passages(spark):
    rng = random.Random(9)
    vocabulary = [f"word{i}" for i in range(4000)]

    def fresh(n):
        return rng.choices(vocabulary, k=n)

    passage = fresh(120)
    altered = [w if k % 17 else "changed" for k, w in enumerate(passage)]
    rows = [
        (1, " ".join(fresh(80) + passage + fresh(70))),
        (2, " ".join(fresh(33) + altered + fresh(41))),
        (3, " ".join(fresh(300))),
        (4, "\t".join(passage[:60]).upper()),
        (5, " ".join(fresh(20) + passage[:20] + fresh(20))),
    ]
    found = {(r.doc_id, r.partner_id): r for r in chaining.passages(support.table(spark, rows + support.awkward()[:3])).collect() if r.doc_id in range(1, 6)}
    assert set(found) == {(2, 1), (4, 1)}
    assert found[2, 1].partner_start <= 82 and found[2, 1].partner_end >= 198
    assert abs(found[2, 1].n_edits - 7) <= 1
    assert (found[4, 1].start_word, found[4, 1].end_word) == (0, 60)
    assert (found[4, 1].partner_start, found[4, 1].partner_end) == (80, 140)
    assert chaining.passages(support.empty(spark)).count() == 0


def test_chains_are_the_best():
    rng = random.Random(1)
    for _ in range(200):
        matches = sorted({(rng.randrange(40), rng.randrange(40)) for _ in range(rng.randrange(1, 12))})
        best = {}
        for p, r in sorted(matches):
            gain = [best[q] - chaining.GAP_COST * (p - q[0] + r - q[1]) for q in best if q[0] < p and q[1] < r]
            best[p, r] = chaining.SEED_SCORE + max([0.0, *gain])
        first = chaining.chains(list(matches))[0]
        gaps = sum(b[0] - a[0] + b[1] - a[1] for a, b in zip(first, first[1:]))
        assert abs(len(first) * chaining.SEED_SCORE - chaining.GAP_COST * gaps - max(best.values())) < 1e-9


@pytest.mark.parametrize("name", sorted(registered.QUERIES))
def test_queries_give_their_rows(spark, sf_dir, name):
    assert registered.QUERIES[name](spark, sf_dir).count() > 0
