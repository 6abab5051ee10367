"""Substring dedup by level-wise doubling of repeated word windows.

Windows of one length that occur more than once are extended to twice that length, and so on until no candidates
survive or the length asked for is reached (the last step is shortened to meet it). A window can only repeat if the two
windows of the level before that cover it repeat: earlier levels are tested with hashes of just enough bits for the
corpus, and the last one tells identity by 96 hash bits and compares the smallest document identifier. Each level costs
a few bytes per surviving window: blocks of documents send their sorted, distinct hashes to hash ranges and get back one
bit for each. A window that a third of all documents share is one entry per block, not one per document.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import partitions, stage, text_of
from barloom.llm.hashing import U64, column_bytes, hash_windows, hash_words, pack_sorted, split_words, unpack_sorted

WINDOW = 13
#: Words of the first level's windows: levels of 4, 8 and the contract's 13 words.
FIRST = 4
#: Of the filter level: bits over the logarithm of the corpus's windows, so that 1 in 2 ** SPARE survives by chance.
SPARE = 8
#: Text bytes of a block of documents, and text bytes whose windows meet in one hash range: what a task holds at once.
BLOCK_BYTES, BUCKET_BYTES = 4 << 20, 16 << 20
LAST = np.iinfo(np.int64).max

UP = "level int, bucket int, block int, n int, keys binary, more binary"
BACK = "level int, bucket int, block int, bits binary"
_UP = pa.schema([("level", pa.int32()), ("bucket", pa.int32()), ("block", pa.int32()), ("n", pa.int32()), ("keys", pa.binary()), ("more", pa.binary())])
_BACK = pa.schema([("level", pa.int32()), ("bucket", pa.int32()), ("block", pa.int32()), ("bits", pa.binary())])


class Block:
    """The windows of a block of documents, level by level. Rows are sorted by identifier, nulls last."""

    def __init__(self, docs: pa.Table, bits: int, buckets: int, levels: Sequence[int]) -> None:
        ids = docs.column("id").fill_null(LAST).to_numpy()
        order = np.argsort(ids, kind="stable")
        self.table = docs.take(pa.array(order))
        self.ids = ids[order]
        self.data, self.offsets = column_bytes(self.table.column("text"))
        self.starts, self.ends, self.row = split_words(self.data, self.offsets)
        self.words = hash_words(self.data, self.starts, self.ends)
        self.bits, self.buckets, self.levels = bits, buckets, levels
        self.alive: np.ndarray | None = None

    def inside(self, size: int) -> np.ndarray:
        """Whether the window that starts at each word stays in its document."""
        n = len(self.words) - size + 1
        return self.row[:n] == self.row[size - 1 :] if n > 0 else np.zeros(0, bool)

    def level(self, k: int) -> tuple:
        """Places of the candidate windows, their entry, and the entries: sorted keys, check, first and last row, bucket."""
        size = self.levels[k]
        ok = self.inside(size)
        if self.alive is not None:
            step = size - self.levels[k - 1]
            ok &= self.alive[: len(ok)] & self.alive[step : step + len(ok)]
        at = np.flatnonzero(ok)
        key = hash_windows(self.words, size)[at]
        if k < len(self.levels) - 1:
            key, check = key >> U64(64 - self.bits), np.zeros(len(at), np.uint32)
            order = np.argsort(key, kind="stable")
        else:
            check = (hash_windows(self.words, size, 1)[at] >> U64(32)).astype(np.uint32)
            order = np.lexsort((check, key))
        key, check = key[order], check[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (check[1:] != check[:-1])
        entry = np.empty(len(key), np.int64)
        entry[order] = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(key))[: len(first)] - 1
        rows = self.row[at][order]
        width = U64(self.bits if k < len(self.levels) - 1 else 64)
        bucket = bucket_of(key[first], width, self.buckets)
        return at, entry, key[first], check[first], rows[first], rows[last], bucket

    def mark(self, k: int, level: tuple, back: dict[tuple[int, int], bytes]) -> None:
        """Set alive: the windows of level k whose bit is set."""
        at, entry, keys, *_, bucket = level
        edges = np.searchsorted(bucket, np.arange(self.buckets + 1))
        set_ = np.zeros(len(keys), bool)
        for b in np.flatnonzero(np.diff(edges)):
            n = edges[b + 1] - edges[b]
            set_[edges[b] : edges[b + 1]] = np.unpackbits(np.frombuffer(back[k, b], np.uint8), count=n).astype(bool)
        self.alive = np.zeros(max(0, len(self.words) - self.levels[k] + 1), bool)
        self.alive[at] = set_[entry]


def bucket_of(keys: np.ndarray, width: int, buckets: int) -> np.ndarray:
    """The hash range of each key: ranges rise with the keys."""
    high = keys >> (width - U64(24))
    return ((high * U64(buckets)) >> U64(24)).astype(np.int64)


def _reached(docs: pa.Table, back: pa.Table | None, k: int, bits: int, buckets: int, levels: Sequence[int]) -> Block:
    """The block with the windows of the levels before k marked."""
    block = Block(docs, bits, buckets, levels)
    if k:
        held = {(x, b): v for x, b, v in zip(back["level"].to_pylist(), back["bucket"].to_pylist(), back["bits"].to_pylist(), strict=True)}
        for j in range(k):
            block.mark(j, block.level(j), held)
    return block


def _send(block: Block, k: int, number: int) -> pa.Table:
    at, entry, keys, check, low, high, bucket = block.level(k)
    final = k == len(block.levels) - 1
    rows = []
    edges = np.searchsorted(bucket, np.arange(block.buckets + 1))
    for b in np.flatnonzero(np.diff(edges)):
        part = slice(edges[b], edges[b + 1])
        if final:
            more = check[part].astype("<u4").tobytes() + block.ids[low[part]].astype("<i8").tobytes()
        else:
            more = np.packbits(block.ids[low[part]] != block.ids[high[part]]).tobytes()
        rows.append((k, b, number, part.stop - part.start, pack_sorted(keys[part]), more))
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_UP)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, _UP, strict=True)], schema=_UP)


def _answer(entries: pa.Table, final: bool) -> pa.Table:
    """For a hash range: whether each block's entry is repeated, or held by a document before the block's first."""
    n = entries["n"].to_numpy()
    keys = np.concatenate([unpack_sorted(p, m) for p, m in zip(entries["keys"].to_pylist(), n, strict=True)])
    more = entries["more"].to_pylist()
    if final:
        check = np.concatenate([np.frombuffer(x, "<u4", m) for x, m in zip(more, n, strict=True)])
        ids = np.concatenate([np.frombuffer(x, "<i8", m, 4 * m) for x, m in zip(more, n, strict=True)])
        order = np.lexsort((ids, check, keys))
        s, c = keys[order], check[order]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (c[1:] != c[:-1])
        least = ids[order][np.flatnonzero(new)][np.cumsum(new) - 1]
        flag = np.empty(len(s), bool)
        flag[order] = least < ids[order]
    else:
        many = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=m) for x, m in zip(more, n, strict=True)]).astype(bool)
        order = np.argsort(keys, kind="stable")
        s = keys[order]
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(s)))
        whole = (size > 1) | np.logical_or.reduceat(many[order], first)
        flag = np.empty(len(s), bool)
        flag[order] = whole[np.cumsum(new) - 1]
    ends = np.cumsum(n)
    bits = [np.packbits(flag[e - m : e]).tobytes() for e, m in zip(ends, n, strict=True)]
    return pa.table([entries["level"], entries["bucket"], entries["block"], pa.array(bits, pa.binary())], schema=_BACK)


def _untouched(block: Block, back: pa.Table, schema: pa.Schema) -> pa.Table:
    """Nothing repeats: the words as they are."""
    kept = [b" ".join(t.encode().split()) for t in block.table.column("text").to_pylist()]
    counts = np.bincount(block.row, minlength=len(block.ids))
    none = pa.array([[]] * len(kept), schema.field("spans").type)
    return pa.table([block.table["id"], pa.array(counts.astype(np.int64)), pa.array(np.zeros(len(kept), np.int64)), none, pa.array(kept, pa.binary()).cast(pa.string())], schema=schema)


def _longest(block: Block, back: pa.Table, schema: pa.Schema) -> pa.Table:
    """The longest level at which each document has a repeated window."""
    held = {(x, b): v for x, b, v in zip(back["level"].to_pylist(), back["bucket"].to_pylist(), back["bits"].to_pylist(), strict=True)}
    out = np.zeros(len(block.ids), np.int64)
    block.alive = None
    for k, words in enumerate(block.levels[:-1]):
        block.mark(k, block.level(k), held)
        out[block.row[np.flatnonzero(block.alive)]] = words
    return pa.table([block.table["id"], pa.array(out)], schema=schema)


def _finish(block: Block, back: pa.Table, schema: pa.Schema) -> pa.Table:
    """Remove the words that windows of the last level cover: those seen before the block, or earlier within it."""
    k = len(block.levels) - 1
    level = block.level(k)
    at, entry, _, _, low, _, _ = level
    held = {(x, b): v for x, b, v in zip(back["level"].to_pylist(), back["bucket"].to_pylist(), back["bits"].to_pylist(), strict=True)}
    block.mark(k, level, held)
    gone = block.alive[at] | (block.ids[block.row[at]] > block.ids[low[entry]])
    step = np.zeros(len(block.words) + 1, np.int64)
    starts = at[gone]
    np.add.at(step, starts, 1)
    np.add.at(step, starts + block.levels[k], -1)
    cover = np.cumsum(step)[:-1] > 0
    edge = np.searchsorted(block.row, np.arange(len(block.ids) + 1))
    removed = np.add.reduceat(np.append(cover, 0), edge[:-1]) if len(block.ids) else np.zeros(0, np.int64)
    removed[np.diff(edge) == 0] = 0
    raw = block.data.tobytes()
    spans, kept = [], []
    for i in range(len(block.ids)):
        a, b = edge[i], edge[i + 1]
        words = raw[block.offsets[i] : block.offsets[i + 1]].split()
        found = []
        if removed[i]:
            c = np.diff(np.concatenate([[0], cover[a:b].astype(np.int8), [0]]))
            found = [{"s": s, "e": e} for s, e in zip(np.flatnonzero(c == 1), np.flatnonzero(c == -1), strict=True)]
            words = [w for w, x in zip(words, cover[a:b], strict=True) if not x]
        spans.append(found)
        kept.append(b" ".join(words))
    return pa.table(
        [block.table["id"], pa.array(np.diff(edge)), pa.array(removed), pa.array(spans, schema.field("spans").type), pa.array(kept, pa.binary()).cast(pa.string())],
        schema=schema,
    )


class Corpus:
    """The blocks of a corpus and the levels found so far."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, blocks: int | None, buckets: int | None, by_id: bool = False) -> None:
        """Rows are dealt by identifier and text, so that a hot identifier spreads; `by_id` keeps an identifier's rows in one block."""
        parts = partitions(docs.sparkSession)
        rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
        size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
        self.bits = min(64, max(24, math.ceil(math.log2(size / 2 + 2)) + SPARE))
        blocks = blocks or max(parts, -(-size // BLOCK_BYTES))
        self.buckets = buckets or max(-(-parts // 2), -(-size // BUCKET_BYTES))
        dealt = F.when(F.col("id").isNotNull(), F.xxhash64("id", F.lit(3))).otherwise(F.xxhash64("text")) if by_id else F.xxhash64("id", "text")
        self.rows = rows.withColumn("block", F.pmod(dealt, F.lit(blocks)).cast("int")).repartition(parts, "block")
        self.levels: tuple[int, ...] = ()
        self.back: DataFrame | None = None

    def extend(self, words: int, final: bool) -> bool:
        """Tests the windows of `words` words that the level before leaves; False if none of them repeats.

        The answers are written: later levels and the end read them, and whether any bit is set ends the doubling.
        """
        k, bits, buckets, levels = len(self.levels), self.bits, self.buckets, (*self.levels, words)
        # a level's place tells its hashes' width: only the last one asked for is told apart for good
        shown = levels if final else (*levels, words + 1)

        def first(key: tuple, table: pa.Table) -> pa.Table:
            return _send(Block(table, bits, buckets, shown), 0, key[0].as_py())

        def later(key: tuple, table: pa.Table, got: pa.Table) -> pa.Table:
            return _send(_reached(table, got, k, bits, buckets, shown), k, key[0].as_py())

        def answer(entries: pa.Table) -> pa.Table:
            return _answer(entries, final)

        rows, back = self.rows.groupBy("block"), self.back
        sent = rows.applyInArrow(first, UP) if back is None else rows.cogroup(back.groupBy("block")).applyInArrow(later, UP)
        found = stage(sent.groupBy("bucket").applyInArrow(answer, BACK), f"level-{words}")
        self.levels, self.back = levels, found if back is None else back.unionAll(found)
        # an entry before the last level stays if its window repeats; at the last one a block's first holder isn't marked
        return final or found.where(F.col("bits").isNotNull() & F.hex("bits").rlike("[1-9A-F]")).limit(1).count() > 0

    def finish(self, work: Callable, schema: pa.Schema, kinds: str) -> DataFrame:
        """Each block with its windows marked up to the level before the last, and the answers, through a function."""
        k, bits, buckets, levels = len(self.levels) - 1, self.bits, self.buckets, self.levels

        def finish(key: tuple, table: pa.Table, got: pa.Table) -> pa.Table:
            return work(_reached(table, got, k, bits, buckets, levels), got, schema)

        return self.rows.groupBy("block").cogroup(self.back.groupBy("block")).applyInArrow(finish, kinds)


def doubled(first: int, window: int) -> list[int]:
    """Lengths from `first` on, each twice the one before, and the window's own at the end."""
    out = []
    while first < window:
        out.append(first)
        first *= 2
    return [*out, window]


def remove_repeats(
    docs: DataFrame,
    window: int = WINDOW,
    first: int = FIRST,
    id_col: str = "doc_id",
    text_col: str = "text",
    blocks: int | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """One row per row of docs: id_col, n_words, n_removed, spans (removed words [s, e)), kept_text.

    A word goes if a window of `window` words that covers it also starts in a document with a smaller identifier.
    Levels double from `first` words to `window`; where no window of a level repeats, the doubling ends and nothing
    goes. Identifiers are integers; null counts as larger than any. Rows with the same identifier, repeated rows too,
    don't remove each other's words. Null, empty and short texts have no windows; long ones are read whole. Other
    columns, also of clashing names, are ignored; an empty table gives no rows.
    """
    corpus = Corpus(docs, id_col, text_col, blocks, buckets)
    for words in doubled(first, window):
        if not corpus.extend(words, words == window):
            break
    # levels given up before the window's length leave no window to remove
    last = corpus.levels[-1] == window
    out = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))), ("kept_text", pa.string())])
    done = corpus.finish(_finish if last else _untouched, out, "id long, n_words long, n_removed long, spans array<struct<s:int,e:int>>, kept_text string")
    return done.withColumnRenamed("id", id_col)


def longest_repeats(docs: DataFrame, first: int = FIRST, id_col: str = "doc_id", text_col: str = "text", blocks: int | None = None, buckets: int | None = None) -> DataFrame:
    """One row per row of docs: id_col, words: the longest of `first`, twice it, four times it, ... words for which the
    row has a window that also occurs in a row of another identifier; 0 if none.

    The doubling goes on until no window of a length repeats. Nulls, repeats and other columns as in remove_repeats;
    hashes have as many bits as the corpus needs, so that one window in 2 ** SPARE may count by chance at the first level.
    """
    corpus, words = Corpus(docs, id_col, text_col, blocks, buckets, by_id=True), first
    while corpus.extend(words, False):
        words *= 2
    corpus.levels += (words + 1,)  # the place of a last level, which isn't asked for
    return corpus.finish(_longest, pa.schema([("id", pa.int64()), ("words", pa.int64())]), "id long, words long").withColumnRenamed("id", id_col)


def report(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document: id_col, n_words, n_removed, kept_sha256; odd rows as in remove_repeats."""
    done = remove_repeats(docs, id_col=id_col)
    return done.select(id_col, "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+') AS w FROM documents),
win AS (
    SELECT doc_id, s, array_to_string(w[s:s + {WINDOW - 1}], ' ') AS p
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS s FROM d)),
least_doc AS (SELECT p, min(doc_id) AS first_doc FROM win GROUP BY p HAVING min(doc_id) < max(doc_id)),
gone AS (
    SELECT DISTINCT doc_id, unnest(range(s, s + {WINDOW})) AS i
    FROM win JOIN least_doc USING (p) WHERE doc_id > first_doc),
by_doc AS (SELECT doc_id, list(i) AS spots FROM gone GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(spots), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN spots IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(spots, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN by_doc USING (doc_id)
"""
