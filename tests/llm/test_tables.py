"""Queries that SQL expresses, on the given tables and on awkward rows."""

import random

import duckdb
import pandas as pd
import pytest

from aerolake.llm import chat, exact, queries, quality, urls

from . import support


def _sql(text, **frames):
    connection = duckdb.connect()
    for name, frame in frames.items():
        connection.register(name, frame)
    found = connection.execute(text)
    return [c[0] for c in found.description], found.fetchall()


def _same(df, text, **frames):
    names, expected = _sql(text, **frames)
    assert sorted(names) == sorted(df.columns)
    assert support.rows(df, *names) == sorted(map(tuple, expected), key=str)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_on_the_tables(spark, sf_dir, name):
    frames = {t: pd.read_parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "pages", "conversations")}
    _same(queries.QUERIES[name](spark, sf_dir), queries.ORACLE_SQL[name], **frames)


def _frame(rows):
    return pd.DataFrame({"doc_id": pd.array([i for i, _ in rows], "Int64"), "text": [t for _, t in rows]})


def test_quality_of_awkward_rows(spark):
    rows = support.awkward()
    names, _ = _sql(quality.oracle(), documents=_frame(rows))
    judged = quality.judge(support.table(spark, rows))
    assert {"lang", "bin", "clean_text"} <= set(judged.columns)
    _same(judged.select(*names), quality.oracle(), documents=_frame(rows))
    assert quality.judge(support.empty(spark)).count() == 0


def test_quality_keeps_prose_and_drops_furniture(spark):
    prose = "\n".join(f"The keeper{i} of house{i} walked{i} slowly, and nobody{i} in town{i} minded it{i} then." for i in range(6))
    menu = "\n".join(f"Home | Shop {i} | About {i} | Contact {i} | Basket {i} | Help {i} | Login" for i in range(12))
    found = {r.doc_id: r for r in quality.judge(support.table(spark, [(1, prose), (2, menu), (3, prose + "\nRead more")])).collect()}
    assert found[1].kept and found[1].clean_text == prose
    assert not found[2].kept
    assert found[3].kept and found[3].clean_text == prose


@pytest.mark.parametrize("capacity", [1, 3, 20_000])
def test_exact_groups(spark, capacity):
    rows = support.awkward() + [(100 + i, f"text {i % 7}") for i in range(60)]
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(text or "", []).append(doc_id)
    expected = []
    for doc_id, text in rows:
        group = groups[text or ""]
        keep = max((d for d in group if d is not None), default=None)
        expected.append((doc_id, keep, len(group), doc_id == keep))
    found = exact.duplicates(support.table(spark, rows), capacity)
    assert support.rows(found, "doc_id", "keep_id", "group_size", "kept") == sorted(expected, key=str)
    assert exact.duplicates(support.empty(spark)).count() == 0


def test_directory_splits_overfull_buckets():
    import numpy as np

    index = exact.Directory(np.array([9, 1, 1, 1, 0, 0, 0, 1]), 3)
    assert index.depth == 3 and index.buckets == 5 - 1
    keys = (np.arange(8, dtype=np.uint64) << np.uint64(61)).view(np.int64)
    assert sorted(set(index.bucket(keys).tolist())) == list(range(index.buckets))


def test_urls_of_awkward_rows(spark):
    hosts = ["example.com", "www.example.com", "a.www.example.com", "EXAMPLE.COM", "badexample.com", "x.net", "net", "org"]
    paths = ["", "/", "/en/", "/en", "/es/x", "/fr/?page=2", "?page=3#f", "#a", "/tag/x/page/2", "/wp-login.php", "/cart", "/a/CART/", "/calendar/2024/5"]
    found = [None, "", "no scheme", "://", "a://b://c/d", "http://ads.x.org/", "http://x.org/a?xxx.casino-", "http://x.org/line\nbreak/en/"]
    found += [f"{s}://{h}{p}" for s in ("http", "HTTPS") for h in hosts for p in paths]
    pages = [(i, u, "<p>", 3) for i, u in enumerate(found + found[:5])] + [(None, found[9], None, None)]
    df = urls.judge(spark.createDataFrame(pages, "page_id long, url string, html string, rule int"))
    frame = pd.DataFrame({"page_id": pd.array([p[0] for p in pages], "Int64"), "url": [p[1] for p in pages]})
    _same(df, urls.oracle(), pages=frame)


def test_chat_round_trip(spark):
    rng = random.Random(3)
    pieces = ["</turn>", "<turn>", "### ", "\\", "\\\\", "\n", ":", "#", "user", "é", "🎉", "", "<", "### Assistant:"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "a:b", None]), "".join(rng.choices(pieces, k=rng.randrange(9))) if rng.random() < 0.9 else None) for c in range(20) for t in range(rng.randrange(1, 6))]
    rows += [(None, None, None, None), (1, 0, "user", "twice"), (1, 0, "user", "twice")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat.format_turns(df)
    by_conversation = {}
    for r in sorted(formatted.collect(), key=lambda r: (r.turn is not None, r.turn or 0, r.formatted.encode())):
        by_conversation.setdefault(r.conv_id, []).append(r.formatted)
    for conv_id, parts in by_conversation.items():
        back = sorted((r.decode(), t.decode()) for r, t in chat.read_back("".join(parts).encode()))
        assert back == sorted((r or "", t or "") for c, _, r, t in rows if c == conv_id)
    digests = {r.conv_id: r for r in chat.digests(formatted).collect()}
    for conv_id, parts in by_conversation.items():
        learned = [t or "" for c, _, r, t in rows if c == conv_id and r == "assistant"]
        assert digests[conv_id].n_turns == len(parts)
        assert digests[conv_id].loss_chars == sum(map(len, learned))
        assert digests[conv_id].formatted_chars == sum(map(len, parts))
    assert chat.digests(chat.format_turns(df.limit(0))).count() == 0
