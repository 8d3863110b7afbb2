"""Fill-in-middle against a plain version, and every output rebuilt from its markers."""

import hashlib
import re

from aerolake.llm import infill
from pyspark.sql import functions as F

from . import support

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plainly(doc_id, text, rate=infill.RATE):
    text = text or ""
    units = UNIT.findall(text)
    hexed = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(hexed[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return doc_id, n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return doc_id, n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


CASES = [(100 + i, t) for i in range(12) for t in ("one two  three\nfour", "ends in blanks \n\t ", "🎉 x", "<", "a <S> b", "   nb", "<P", "S> <", "x")]


def check(spark, rows, rate=infill.RATE):
    docs = support.table(spark, rows)
    made = infill.transform(docs, rate=rate).withColumn("back", infill.restored(F.col("output"), F.col("form")))
    got = sorted(map(tuple, made.collect()), key=str)
    assert got == sorted(((*plainly(i, t, rate), t or "") for i, t in rows), key=str)


def test_awkward(spark):
    check(spark, [*support.awkward(), *CASES])


def test_every_document_rearranged(spark):
    check(spark, [*support.awkward(), *CASES], rate=100)


def test_repeated_rows_and_shared_numbers(spark):
    check(spark, [(i, t) for i in range(30) for t in ("a b c d e", "a b c d e", "a b c d", "a b c d e")], rate=100)


def test_empty(spark):
    assert infill.digests(support.empty(spark)).collect() == []


def test_table(spark, sf_dir):
    docs = support.documents(spark, sf_dir)
    got = {r.doc_id: r for r in infill.digests(docs).collect()}
    for doc_id, text in support.pairs(docs):
        want = plainly(doc_id, text)
        assert tuple(got[doc_id])[:5] == want[:5]
        assert got[doc_id].output_sha256 == hashlib.sha256(want[5].encode()).hexdigest()
        assert got[doc_id].restored_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_one_dealing_of_the_texts(spark, sf_dir):
    """Units, requests and parts stand on equal dealings of the documents, which Spark then makes once."""
    made = infill.digests(support.documents(spark, sf_dir))
    plan = made._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"Exchange (\S+?)\(", plan)
    assert dealt.count("hashpartitioning") <= 3 and "SinglePartition" not in plan
