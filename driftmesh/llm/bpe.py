"""Byte-level BPE: DuckDB recursive queries encode each partition's distinct words, ordered aggregation decodes."""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator
from itertools import chain, islice

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame

from .common import give_back, small_batches

#: Longer words (bytes) go through a heap, since a recursive query holds a word's length squared in rows.
LONG_WORD = 400
#: Words and rows (squares of lengths) of one recursive query.
WORDS_A_QUERY, ROWS_A_QUERY = 20_000, 4_000_000
CHARS_A_ROUND = 1_000_000
#: Words of a long text, and ids of one decoding query, at once.
WORDS_A_ROUND, IDS_A_QUERY = 200_000, 400_000
#: Places of the cache of words, and how many ids a place holds; 2^19 * (16 + 4 * 7) bytes are 23 MB.
CACHE_PLACES, CACHE_IDS = 1 << 19, 6

#: Rows (w, pos, tok) join the merge table with their right neighbour; each word's leftmost pair of least
#: rank is contracted; words without a pair leave the recursion.  r is rank * 2^20 + position.
_ENCODE = """
WITH RECURSIVE s(w, pos, tok, live) AS (
  SELECT w, pos, tok, true FROM init
  UNION ALL (
    WITH q AS MATERIALIZED (
      SELECT w, pos, tok, nxp, (m.c::BIGINT << 20) | pos AS r
      FROM (SELECT w, pos, tok, lead(tok) OVER z AS nx, lead(pos) OVER z AS nxp, lead(w) OVER z AS nw
            FROM s WHERE live WINDOW z AS (ORDER BY w::BIGINT * 65536 + pos))
      LEFT JOIN merges m ON m.k = CASE WHEN nw = w THEN tok::BIGINT * 65536 + nx END),
    b AS (SELECT w, min(r) AS least, arg_min(nxp, r) AS gone FROM q GROUP BY w HAVING min(r) IS NOT NULL)
    SELECT q.w, pos, CASE WHEN r = least THEN (least >> 20)::INT ELSE tok END, least IS NOT NULL
    FROM q LEFT JOIN b ON q.w = b.w WHERE least IS NULL OR pos <> gone)
)
SELECT w, tok FROM s WHERE NOT live ORDER BY w, pos"""

_DECODE = "SELECT s, string_agg(txt, '' ORDER BY pos) AS txt FROM tokens JOIN vocab USING (id) GROUP BY s"


class _Cache:
    """Ids of words by a 128-bit hash, each word at one place: what comes to a taken place pushes the other out."""

    def __init__(self):
        self.keys = np.zeros((CACHE_PLACES, 2), np.uint64)
        self.count = np.zeros(CACHE_PLACES, np.int32)
        self.ids = np.zeros((CACHE_PLACES, CACHE_IDS), np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's place, -1 where the cache lacks it."""
        at = (keys[:, 0] % np.uint64(CACHE_PLACES)).astype(np.int64)
        return np.where((self.keys[at] == keys).all(axis=1) & (self.count[at] > 0), at, -1)

    def put(self, keys: np.ndarray, flat: np.ndarray, cut: np.ndarray) -> None:
        """Takes words of up to CACHE_IDS ids; word i has the ids flat[cut[i] : cut[i + 1]]."""
        n = np.diff(cut)
        use = np.flatnonzero(n <= CACHE_IDS)
        at = (keys[use, 0] % np.uint64(CACHE_PLACES)).astype(np.int64)
        at, first = np.unique(at, return_index=True)
        use = use[first]
        self.keys[at], self.count[at] = keys[use], n[use]
        for k in range(CACHE_IDS):
            has = n[use] > k
            self.ids[at[has], k] = flat[cut[use[has]] + k]


class Coder:
    """The tables of one vocabulary in a worker's own in-memory DuckDB, and a bounded cache of words."""

    def __init__(self, vocabulary: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in vocabulary.splitlines() if x)}
        self.pattern = regex.compile(pattern)
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "200MB", "temp_directory": ""})
        keys, ids = array("q"), array("i")
        for token, c in self.ranks.items():
            for i in range(1, len(token)):
                left, right = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if left is not None and right is not None:
                    keys.append(left * 65536 + right)
                    ids.append(c)
        self._put("merges", pa.table({"k": np.frombuffer(keys, np.int64), "c": np.frombuffer(ids, np.int32)}))
        self.pairs = (keys, ids)
        self.merged: dict[int, int] = {}  # the same as a dict, once a long word needs it
        # byte b is chr(256 + b), so that no character is special to the database
        self._put("vocab", pa.table({"id": np.fromiter(self.ranks.values(), np.int32), "txt": ["".join(chr(256 + b) for b in k) for k in self.ranks]}))
        self.cache = _Cache()

    def _put(self, name: str, rows: pa.Table) -> None:
        self.con.register("rows_in", rows)
        self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM rows_in")
        self.con.unregister("rows_in")

    def _query(self, name: str, rows: pa.Table, sql: str) -> dict[str, np.ndarray]:
        self.con.register(name, rows)
        out = self.con.execute(sql).fetchnumpy()
        self.con.unregister(name)
        return out

    def _contract(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of words that aren't tokens themselves, one word after another, and how many each has."""
        lens = np.array([len(x) for x in words])
        flat = np.frombuffer(b"".join(words), np.uint8)
        at = np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)
        init = pa.table({"w": np.repeat(np.arange(len(words), dtype=np.int32), lens), "pos": at.astype(np.int32), "tok": self.byte_ids[flat]})
        out = self._query("init", init, _ENCODE)
        return np.asarray(out["tok"], np.int32), np.bincount(out["w"], minlength=len(words))

    def _contract_long(self, word: bytes) -> np.ndarray:
        """The same contraction of one long word by a heap of rank * 2^32 + position; some 60 bytes a byte of the word."""
        if not self.merged:
            self.merged = dict(zip(*self.pairs, strict=True))
        n, merged = len(word), self.merged
        tok = array("i", self.byte_ids[np.frombuffer(word, np.uint8)].tobytes())
        nxt, prev = array("i", range(1, n + 1)), array("i", range(-1, n - 1))
        heap = [r << 32 | i for i in range(n - 1) if (r := merged.get(tok[i] << 16 | tok[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            x = heapq.heappop(heap)
            i, r = x & 0xFFFFFFFF, x >> 32
            if tok[i] < 0 or (j := nxt[i]) >= n or merged.get(tok[i] << 16 | tok[j]) != r:
                continue
            tok[i], tok[j], nxt[i] = r, -1, nxt[j]
            if nxt[i] < n:
                prev[nxt[i]] = i
            for a in (prev[i], i):
                if a >= 0 and nxt[a] < n and (r := merged.get(tok[a] << 16 | tok[nxt[a]])) is not None:
                    heapq.heappush(heap, r << 32 | a)
        out = np.frombuffer(tok, np.int32)
        return out[out >= 0]

    def _new_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, one word after another, and where each word's begin and end."""
        order, ids, n = [], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        todo = []
        for i, w in enumerate(words):
            if (rank := self.ranks.get(w)) is None and len(w) <= LONG_WORD:
                todo.append((len(w), i))
            else:
                order.append(i)
                ids.append(self._contract_long(w) if rank is None else np.array([rank], np.int32))
                n.append([len(ids[-1])])
        todo.sort()
        a = 0
        while a < len(todo):
            most = max(1, min(WORDS_A_QUERY, ROWS_A_QUERY // todo[min(a + WORDS_A_QUERY, len(todo)) - 1][0] ** 2))
            part = [i for _, i in todo[a : a + most]]
            flat, count = self._contract([words[i] for i in part])
            order += part
            ids.append(flat)
            n.append(count)
            a += most
        n = np.concatenate(n).astype(np.int64)
        back = np.empty(len(words), np.int64)
        back[order] = np.arange(len(words))
        return _taken(np.concatenate(ids), np.cumsum(np.append(0, n)), back)

    def _words(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, one word after another, and where each word's begin and end.  Each distinct word is encoded once."""
        words = pa.array(found, pa.string()).dictionary_encode()
        distinct = words.dictionary.cast(pa.binary()).to_pylist()
        keys = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, distinct)), np.uint64).reshape(-1, 2)
        at = self.cache.find(keys)
        new = np.flatnonzero(at < 0)
        ids, cut = self._new_words([distinct[i] for i in new.tolist()])
        # cached words' ids go behind the new ones
        known = at[at >= 0]
        n = self.cache.count[known]
        row = self.cache.ids[known][np.arange(CACHE_IDS) < n[:, None]]
        self.cache.put(keys[new], ids, cut)
        place = np.empty(len(distinct), np.int64)
        place[new], place[at >= 0] = np.arange(len(new)), len(new) + np.arange(len(known))
        ids, cut = np.append(ids, row), np.append(cut, cut[-1] + np.cumsum(n))
        return _taken(ids, cut, place[words.indices.to_numpy()])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and where each text's ids begin and end.  A long text's words are taken some at a time."""
        ids, sizes, short = [np.zeros(0, np.int32)], [], []

        def flush() -> None:
            if short:
                out, ends = self._words(list(chain.from_iterable(short)))
                ids.append(out)
                sizes.extend(np.diff(ends[np.cumsum([0, *map(len, short)])]).tolist())
                short.clear()

        for t in texts:
            if len(t) <= CHARS_A_ROUND:
                short.append(self.pattern.findall(t))
                continue
            flush()
            found, n = (m[0] for m in self.pattern.finditer(t)), 0
            while part := list(islice(found, WORDS_A_ROUND)):
                ids.append(self._words(part)[0])
                n += len(ids[-1])
            sizes.append(n)
        flush()
        return np.concatenate(ids), np.cumsum([0, *sizes])

    def decode(self, flat: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All bytes one after another, and where each sequence's bytes begin and end.  Ids are taken some at a time; a token is never cut."""
        n = np.diff(bounds)
        owner, sizes, parts = np.repeat(np.arange(len(n), dtype=np.int32), n), np.zeros(len(n), np.int64), []
        for a in range(0, len(flat), IDS_A_QUERY):
            ids = flat[a : a + IDS_A_QUERY]
            rows = pa.table({"s": owner[a : a + IDS_A_QUERY], "pos": np.arange(len(ids), dtype=np.int64), "id": ids})
            out = self._query("tokens", rows, _DECODE)
            for i in np.argsort(out["s"]).tolist():
                parts.append(out["txt"][i].encode("utf-16-le")[::2])
                sizes[out["s"][i]] += len(parts[-1])
        return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(np.append(0, sizes))


def _taken(flat: np.ndarray, cut: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces flat[cut[i] : cut[i + 1]] for i in which, one after another, and their bounds."""
    n = np.diff(cut)[which]
    ends = np.cumsum(np.append(0, n))
    return flat[np.arange(ends[-1]) + np.repeat(cut[which] - ends[:-1], n)], ends


_CODERS: dict[tuple, Coder] = {}


def _coder(vocabulary: bytes, pattern: str) -> Coder:
    key = (hash(vocabulary), pattern)
    if key not in _CODERS:
        _CODERS[key] = Coder(vocabulary, pattern)
    return _CODERS[key]


def _rounds(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Slices of bounded text: a round ends with the row that fills it."""
    for b in batches:
        values = b.column(column)
        size = pc.binary_length(values) if pa.types.is_string(values.type) else pc.list_value_length(values)
        up, a = np.cumsum(pc.fill_null(size, 0).to_numpy().astype(np.int64)), 0
        while a < len(values):
            e = min(int(np.searchsorted(up, (up[a - 1] if a else 0) + CHARS_A_ROUND)) + 1, len(values))
            yield b.slice(a, e - a)
            a = e


def _binary(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def bpe_encode(docs: DataFrame, vocabulary_path: str, pattern: str, decode: bool = False) -> DataFrame:
    """One row per document: doc_id, ids (array of int); with ``decode`` also decoded (the bytes that the ids stand for).

    Each match of ``pattern`` is encoded on its own, as by the tiktoken library without special tokens: a
    word that is a token gives its id; any other starts from its bytes and has its leftmost pair of least
    rank contracted until none is left.  Decoding sees only the ids.

    The vocabulary file (fixed, under 1 MB) is read by the driver and broadcast.  A task works in rounds
    of bounded text; its cache of words has a fixed size and takes no long words.  A long text is encoded by some of its words at a
    time and decoded by some of its ids at a time, so it costs a small multiple of its own size.  Nothing shuffles; a lost task is done again alone.
    Words of over LONG_WORD bytes are contracted by a heap instead of the recursive query; one costs about 60 bytes a byte.

    Null text counts as empty and gives no ids.  Repeated rows give repeated results.  An empty table
    gives no rows.  Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    with open(vocabulary_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared.value, pattern)
        for part in _rounds(batches, "text"):
            ids, bounds = coder.encode([t or "" for t in part.column("text").to_pylist()])
            cols = {"doc_id": part.column("doc_id"), "ids": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids))}
            if decode:
                cols["decoded"] = _binary(*coder.decode(ids, bounds))
            yield pa.RecordBatch.from_pydict(cols)
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>" + ", decoded binary" * decode)


def bpe_decode(rows: DataFrame, vocabulary_path: str, pattern: str) -> DataFrame:
    """doc_id, decoded (binary) of rows with doc_id and ids; null ids count as none."""
    small_batches(rows.sparkSession)
    with open(vocabulary_path, "rb") as f:
        shared = rows.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared.value, pattern)
        for part in _rounds(batches, "ids"):
            lists = part.column("ids")
            bounds = np.cumsum(np.append(0, pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)))
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "decoded": _binary(*coder.decode(lists.flatten().to_numpy(), bounds))})

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")
