"""Byte-level BPE encoding and decoding by recursive queries over token-position rows.

A task splits its texts into words, and a query engine inside the task encodes the words it has
not met: every adjacent pair of tokens of a word is a row, joined to the merge table; each step of
the recursive query contracts the leftmost pair of least rank of every word and drops the words
that have no pair left to merge. Long words are cut where no token can reach across, and of those
parts a step contracts all pairs of least rank that it may. Tokens are joined back to their bytes and aggregated in position
order, which decodes them.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import heapq
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from . import common
from .cache import Generations

#: Rows that one recursive query may keep over all its steps; what is not done then goes on in another.
_ROWS_AT_ONCE = 2_000_000
_WORDS_AT_ONCE = 20_000
#: Bytes of a word up to which the cheaper query takes fewer steps than it is cheaper.
SHORT_WORD = 64
#: Bytes of a part without a place to cut up to which it is a query's; the steps of a longer one, which
#: grow with its length as its rows do, are taken from a heap, with the same result.
LONG_PART = 4096
_BYTES_AT_ONCE = 200_000
#: A space after white space is where a word's leading space depends on what stands before it.
_RUN = re.compile(r"\s ")

#: A row is a token at a word's place and the token after it; merged is twice the rank that both have
#: together, and one more where the new token could form a pair of a lower rank than its own. Every
#: step contracts a word's pairs of least rank, from the left and none that overlap (adjacent rows are
#: taken alternately), up to the first whose new token could go on with its neighbour, or with its like,
#: at a lower rank. So a step is what taking the leftmost least pair again and again gives.
_CONTRACT = """
with recursive steps(word, place, l, r, merged, n) as (
    select p.word, p.place, p.l, p.r, m.merged, 0 from pairs p left join merges m on m.pair = p.l * 65536 + p.r
    union all
    select u.word, u.place, u.l, u.r, m.merged, u.n + 1 from (
        select word, case when before then earlier else place end as place, case when before then best // 2 else l end as l, case when after then best // 2 else r end as r, n from (
            select word, place, l, r, best, n, chosen, lag(chosen, 1, false) over w as before, lag(place) over w as earlier, lead(chosen, 1, false) over w as after from (
                select *, turn and place <= coalesce(min(place) filter (turn and lower) over (partition by word), place) as chosen from (
                    select t.*, turn and best % 2 = 1 and (coalesce(x.merged, best) < best or coalesce(y.merged, best) < best or coalesce(z.merged, best) < best) as lower from (
                        select *, lag(l) over v as x, lead(r) over v as y, hit and (row_number() over (partition by word, apart order by place) - least(apart, 1)) % 2 = 1 as turn from (
                            select s.*, best, coalesce(merged = best, false) as hit, count(*) filter (merged is distinct from best) over (partition by s.word order by place rows unbounded preceding) as apart
                            from steps s join (select word, min(merged) as best from steps where n < $limit group by word having min(merged) is not null) least_ on s.word = least_.word
                        ) r window v as (partition by word order by place)
                    ) t left join merges x on turn and best % 2 = 1 and x.pair = t.x * 65536 + best // 2
                        left join merges y on turn and best % 2 = 1 and y.pair = best // 2 * 65536 + t.y
                        left join merges z on turn and best % 2 = 1 and z.pair = best // 2 * 65537
                ) c
            ) d window w as (partition by word order by place)
        ) e where not chosen
    ) u left join merges m on m.pair = u.l * 65536 + u.r
)
select word, place, l, r, merged is not null and n = $limit as open from steps qualify n = max(n) over (partition by word)
"""

#: The same for words of few rows, a pair a step: without windows, hence cheaper while steps are few.
_CONTRACT_SHORT = """
with recursive steps(word, a, b, l, r, merged, done) as (
    select p.word, p.place as a, p.place + 1 as b, p.l, p.r, m.merged // 2, false from pairs p left join merges m on m.pair = p.l * 65536 + p.r
    union all
    select u.word, u.a, u.b, u.l, u.r, m.merged // 2, u.done
    from (
        select s.word, s.b,
            case when s.a = best.b then best.a else s.a end as a,
            case when s.a = best.b then best.token else s.l end as l,
            case when s.b = best.a then best.token else s.r end as r,
            best.code is null as done
        from steps s join (
            select word, code, code >> 20 as token, (code >> 10) & 1023 as a, code & 1023 as b
            from (select word, min((merged << 20) | (a << 10) | b) as code from steps where not done group by word)
        ) best on s.word = best.word
        where not s.done and (best.code is null or s.a <> best.a)
    ) u left join merges m on m.pair = u.l * 65536 + u.r
)
select word, a as place, l, r, false as open from steps where done
"""


_DECODE = """
with tokens as (
    select word, place, l as token from done
    union all
    select word, 2147483647, arg_max(r, place) from done group by word
    union all
    select word, 0, token from known
)
select word, string_agg(ids, ',') as ids, string_agg(hex, '') as bytes
from (select t.word, v.ids, v.hex from tokens t join vocabulary v on v.token = t.token order by t.word, t.place)
group by word order by word
"""


class Encoder:
    """Encodes and decodes words with the ranks of one file; remembers words in bounded memory."""

    def __init__(self, path: str, pattern: str) -> None:
        import duckdb

        gc.set_threshold(200_000)  # the memo holds many small tuples, none in a cycle
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        if max(self.ranks.values()) >= 1 << 16:
            raise ValueError("ranks of 16 bits at most")
        self.split = regex.compile(pattern).findall
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        left, right, merged = [], [], []
        low: set[int] = set()  # tokens that form a pair of a lower rank than their own
        self.together = np.zeros(1 << 16, bool)  # pairs of bytes that some token holds
        for token, rank in self.ranks.items():
            raw = np.frombuffer(token, np.uint8).astype(np.int64)
            self.together[raw[:-1] * 256 + raw[1:]] = True
            for k in range(1, len(token)):
                a, b = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(rank)
                    low.update(part for part in (a, b) if rank <= part)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})  # never to a worker's own disk
        pair = np.array(left, np.int64) * 65536 + np.array(right, np.int64)
        merged = np.array(merged, np.int64)
        self._table("merges", pa.table({"pair": pair, "merged": 2 * merged + np.isin(merged, sorted(low))}))
        ids = list(self.tokens)
        vocabulary = {"token": np.array(ids, np.int64), "ids": list(map(str, ids)), "hex": [self.tokens[i].hex() for i in ids]}
        self._table("vocabulary", pa.table(vocabulary))
        self.inner = Generations(lambda keys: self._chunks(keys, b" "), 200_000, batched=True)
        self.first = Generations(lambda keys: self._chunks(keys, b""), 20_000, batched=True)
        self.words = Generations(self._words, 200_000, batched=True)

    def _table(self, name: str, table: pa.Table) -> None:
        self.db.register("incoming", table)
        self.db.execute(f"create table {name} as select * from incoming").fetchall()
        self.db.unregister("incoming")

    def _contracted(self, pairs: pa.Table) -> Iterator[pa.Table]:
        """The last rows of every word, by recursive queries that keep so many rows each."""
        while pairs.num_rows:
            self.db.register("pairs", pairs)
            found = self.db.sql(_CONTRACT, params={"limit": max(1, _ROWS_AT_ONCE // pairs.num_rows)}).to_arrow_table()
            self.db.unregister("pairs")
            going = pc.is_in(found["word"], found.filter(found["open"])["word"].combine_chunks())
            yield found.filter(pc.invert(going))
            pairs = found.filter(going).drop_columns("open")

    def _query(self, words: list[bytes], short: bool) -> list[tuple[str, bytes]]:
        known = [(i, self.ranks[w]) for i, w in enumerate(words) if w in self.ranks]
        rest = [i for i, w in enumerate(words) if w not in self.ranks]
        raw = np.frombuffer(b"".join([words[i] for i in rest]), np.uint8)
        size = np.array([len(words[i]) for i in rest], np.int64)
        owner = np.repeat(np.array(rest, np.int64), size)
        place = np.arange(len(raw)) - np.repeat(np.cumsum(size) - size, size)
        token = self.byte[raw]
        pair = np.flatnonzero(owner[1:] == owner[:-1])
        pairs = pa.table({"word": owner[pair], "place": place[pair], "l": token[pair], "r": token[pair + 1]})
        done = [] if short else list(self._contracted(pairs))
        if short:
            self.db.register("pairs", pairs)
            done = [self.db.sql(_CONTRACT_SHORT).to_arrow_table()]
            self.db.unregister("pairs")
        empty = pa.table({c: np.zeros(0, np.int64) for c in ("word", "place", "l", "r")})
        self.db.register("done", pa.concat_tables(done) if done else empty)
        self.db.register("known", pa.table({"word": np.array([i for i, _ in known], np.int64), "token": np.array([t for _, t in known], np.int64)}))
        found = self.db.execute(_DECODE).fetchall()
        self.db.unregister("done"), self.db.unregister("known")
        out = []
        for i, ids, digits in found:
            text = bytes.fromhex(digits)
            out.append((ids, words[i] if text == words[i] else text))  # one copy of equal bytes
        return out

    def _merge_long(self, word: bytes) -> list[int]:
        """Leftmost least-rank merges of one very long part, from a heap of its pairs."""
        parts: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[int, int, bytes, bytes]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(parts) and (rank := self.ranks.get(parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (rank, i, parts[i], parts[j]))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j >= len(parts) or parts[j] != right:
                continue
            parts[i], parts[j], after[i] = left + right, None, after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [self.ranks[p] for p in parts if p is not None]

    def _whole(self, words: list[bytes]) -> dict[bytes, tuple[str, bytes]]:
        """All words by recursive queries, as many at once as have so many bytes."""
        out: dict[bytes, tuple[str, bytes]] = {}
        for word in words:
            if len(word) > LONG_PART:
                ids = self._merge_long(word)
                out[word] = ",".join(map(str, ids)), b"".join(map(self.tokens.__getitem__, ids))
        for short in (True, False):
            block: list[bytes] = []
            size = 0
            for word in [*(w for w in words if 0 < len(w) <= LONG_PART and (len(w) <= SHORT_WORD) == short), b""]:
                if block and (not word or size + len(word) > _BYTES_AT_ONCE or len(block) == _WORDS_AT_ONCE):
                    out.update(zip(block, self._query(block, short)))
                    block, size = [], 0
                block.append(word)
                size += len(word)
        return out

    def _cut(self, word: bytes) -> list[bytes]:
        """A long word in parts between which no token of the vocabulary can reach."""
        raw = np.frombuffer(word, np.uint8).astype(np.int64)
        at = [0, *(np.flatnonzero(~self.together[raw[:-1] * 256 + raw[1:]]) + 1).tolist(), len(word)]
        return [word[i:j] for i, j in zip(at, at[1:])]

    def _words(self, words: list[bytes]) -> list[tuple[str, bytes]]:
        parts = {w: self._cut(w) for w in words if len(w) > SHORT_WORD and w not in self.ranks}
        known = self._whole(list({p for w in words for p in parts.get(w, (w,))}))
        return [known[w] if w not in parts else (",".join([known[p][0] for p in parts[w]]), b"".join([known[p][1] for p in parts[w]])) for w in words]

    def _chunks(self, chunks: list[bytes], before: bytes) -> list[tuple[str, bytes]]:
        split = [[w.encode() for w in self.split((before + c).decode())] for c in chunks]
        words = list({w for part in split for w in part})
        known: dict[bytes, tuple[str, bytes]] = dict(zip(words, self.words.many(words)))
        out = []
        for chunk, part in zip(chunks, split):
            if len(part) == 1:
                ids, text = known[part[0]]
            else:
                ids, text = ",".join([known[w][0] for w in part]), b"".join([known[w][1] for w in part])
            out.append((ids, text))
        return out

    def _keys(self, text: bytes) -> tuple[list[bytes], list[bytes]]:
        """What `first` and then `inner` have to know for the text."""
        if _RUN.search(text.decode()):
            return [w.encode() for w in self.split(text.decode())], []
        first, *inner = text.split(b" ")
        return [first] if first else [], inner

    def encode(self, texts: list[bytes]) -> Iterator[tuple[list[str], list[bytes]]]:
        """For each text, the ids of its pieces (joined by commas) and the bytes they decode to."""
        for k in range(0, len(texts), 500):
            keys = [self._keys(t) for t in texts[k : k + 500]]
            self.first.learn(x for f, _ in keys for x in f)
            self.inner.learn(x for _, i in keys for x in i)
            first, inner = self.first.young, self.inner.young
            for f, i in keys:
                pieces = [first[x] for x in f] + [inner[x] for x in i]
                yield [p[0] for p in pieces], [p[1] for p in pieces]


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str) -> Encoder:
    if not os.path.isabs(path):
        import public_tokenizers

        path = public_tokenizers.path(path)
    return Encoder(path, pattern)


def _code_batches(path: str, pattern: str):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, pattern)
        for batch in batches:
            texts = [bytes(v) for v in common.rows(batch.column("text"))]
            doc_ids = batch.column("doc_id")
            for k in range(0, len(texts), 1000):
                ids, text = [], []
                for i, t in encoder.encode(texts[k : k + 1000]):
                    ids.append(",".join(i))
                    text.append(b"".join(t))
                yield pa.RecordBatch.from_arrays([doc_ids[k : k + len(ids)], pa.array(ids), pa.array(text, pa.binary())], ["doc_id", "ids", "decoded"])

    return code


def _digest_batches(path: str, pattern: str):
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _code_batches(path, pattern)(batches):
            ids, text = batch.column("ids").to_pylist(), batch.column("decoded").to_pylist()
            columns = {
                "doc_id": batch.column("doc_id"),
                "n_tokens": pa.array([i.count(",") + 1 if i else 0 for i in ids], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(i.encode()).hexdigest() for i in ids]),
                "decoded_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in text]),
            }
            yield pa.RecordBatch.from_pydict(columns)

    return digest


def _pattern(pattern: str | None) -> str:
    if pattern is None:
        import public_tokenizers

        return public_tokenizers.PATTERN
    return pattern


def encode_decode(docs: DataFrame, ranks: str = "byte_bpe_multi_50k.tiktoken", pattern: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded): decimal ids joined by commas, and the bytes that they decode to.

    One row per row of `docs`, whole texts, no special tokens; null counts as empty and gives no
    ids. `ranks` is a path or the name of a public file with ranks below 65536; `pattern` splits
    the text into words, by default as that file's tokenizer does.
    """
    common.ready(docs.sparkSession)
    return common.texts(docs).mapInArrow(_code_batches(ranks, _pattern(pattern)), "doc_id long, ids string, decoded binary")


def digests(docs: DataFrame, ranks: str = "byte_bpe_multi_50k.tiktoken", pattern: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of `encode_decode`, without shipping its texts."""
    common.ready(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return common.texts(docs).mapInArrow(_digest_batches(ranks, _pattern(pattern)), schema)
