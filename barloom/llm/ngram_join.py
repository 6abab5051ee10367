"""N-gram Jaccard join: size-banded tiles, bitmap signatures, exact sorted-array intersection.

1. Exact copies collapse to one node with a number of its own (partial aggregates: a hot text never meets in one task).
2. Blocks of documents send their distinct shingle hashes to hash ranges and get document frequencies back. Shingles
   ordered by frequency give each document a rare prefix: two documents over the threshold must share a shingle there.
3. Documents that share prefix shingles form candidate groups. A group is cut into cells of bounded size by size band
   (only neighbouring bands can link) and hash.
4. A tile holds one cell, or two cells of neighbouring bands that share a prefix shingle. Within it, size and the bit count of XORed parity bitmaps
   bound the overlap from above; pairs that pass are intersected exactly. Documents already connected are skipped, so
   that a group of n near copies takes about n comparisons.

Every pair over the threshold lies in one candidate group, and each pair of a group is compared, excluded by a bound or
already connected: no link that matters to a component is lost.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import partitions, stage, text_of
from barloom.llm.components import connected_components
from barloom.llm.hashing import LOWER, U64, column_bytes, hash_windows, hash_words, pack_sorted, split_words, unpack_sorted
from barloom.llm.substring_dedup import bucket_of

WORDS = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
SPARE = 10
#: Text bytes of a block of documents and of a hash range, at most: what a task holds at once, some ten times over.
BLOCK_BYTES = 32 << 20
#: Shingles of a cell, and what a document weighs beside its own; a tile holds two cells at most (8 bytes a shingle).
CELL, WEIGHT = 1_500_000, 64

_UP = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("n", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
_BACK = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("counts", pa.binary())])
_PREFIX = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("keys", pa.list_(pa.int64())), ("shingles", pa.binary())])


class Shingles:
    """The shingle sets of a block: keys sorted within each document, edge[i]:edge[i + 1] for document i."""

    def __init__(self, docs: pa.Table, wanted: pa.Table, words: int, bits: int, buckets: int) -> None:
        # one row of each text that this block stands for
        at = pc.index_in(docs["copy"], wanted["copy"].combine_chunks()).to_numpy()
        at = np.where(np.isnan(at), -1, at).astype(np.int64)
        number, first = np.unique(at, return_index=True)
        number, first = number[number >= 0], np.sort(first[number >= 0])
        docs = docs.take(pa.array(first))
        self.ids = wanted["node"].to_numpy()[at[first]]
        data, offsets = column_bytes(docs["text"])
        data = LOWER[data]
        starts, ends, row = split_words(data, offsets)
        hashes = hash_words(data, starts, ends)
        n = len(self.ids)
        counts = np.bincount(row, minlength=n)
        first = np.cumsum(counts) - counts
        keys, rows = hash_windows(hashes, words), row[: max(0, len(row) - words + 1)]
        ok = rows == row[words - 1 :] if len(rows) else np.zeros(0, bool)
        keys, rows = [keys[ok]], [rows[ok]]
        for size in range(1, words):  # shorter texts: the whole sequence is the only shingle
            short = np.flatnonzero(counts == size)
            if len(short):
                keys.append(hash_windows(hashes, size)[first[short]])
                rows.append(short)
        keys, rows = np.concatenate(keys), np.concatenate(rows)
        order = np.lexsort((keys, rows))
        keys, rows = keys[order], rows[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])
        self.keys, self.rows = keys[new], rows[new]
        self.sizes = np.bincount(self.rows, minlength=n)
        self.edge = np.concatenate([[0], np.cumsum(self.sizes)])
        short_keys = self.keys >> U64(64 - bits)
        self.short, self.entry, self.held = np.unique(short_keys, return_inverse=True, return_counts=True)
        self.bucket = bucket_of(self.short, U64(bits), buckets)
        self.edges = np.searchsorted(self.bucket, np.arange(buckets + 1))


def _send(s: Shingles, number: int) -> pa.Table:
    rows = []
    for b in np.flatnonzero(np.diff(s.edges)):
        part = slice(s.edges[b], s.edges[b + 1])
        rows.append((b, number, part.stop - part.start, pack_sorted(s.short[part]), zlib.compress(s.held[part].astype("<u4").tobytes(), 1)))
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_UP)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, _UP, strict=True)], schema=_UP)


def _count(entries: pa.Table) -> pa.Table:
    """Corpus-wide document counts of a hash range, given back to each block."""
    n = entries["n"].to_numpy()
    keys = np.concatenate([unpack_sorted(p, m) for p, m in zip(entries["keys"].to_pylist(), n, strict=True)])
    held = np.concatenate([np.frombuffer(zlib.decompress(x), "<u4") for x in entries["counts"].to_pylist()])
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    sums = np.add.reduceat(held[order].astype(np.int64), np.flatnonzero(new))
    total = np.empty(len(s), np.int64)
    total[order] = sums[np.cumsum(new) - 1]
    ends = np.cumsum(n)
    packed = [zlib.compress(np.minimum(total[e - m : e], 2**32 - 1).astype("<u4").tobytes(), 1) for e, m in zip(ends, n, strict=True)]
    return pa.table([entries["bucket"], entries["block"], pa.array(packed, pa.binary())], schema=_BACK)


def _prefixes(s: Shingles, back: pa.Table, percent: int) -> pa.Table:
    """Each document's size, its prefix shingles that other documents have too, and its set if there are any."""
    total = np.ones(len(s.short), np.int64)
    for b, packed in zip(back["bucket"].to_pylist(), back["counts"].to_pylist(), strict=True):
        total[s.edges[b] : s.edges[b + 1]] = np.frombuffer(zlib.decompress(packed), "<u4")
    count = total[s.entry]
    order = np.lexsort((s.keys, count, s.rows))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    place -= s.edge[s.rows]
    n = s.sizes
    prefix = n - (percent * n + 99) // 100 + 1
    chosen = (place < prefix[s.rows]) & (count > 1)
    picked = s.keys[chosen].view(np.int64)
    per = np.bincount(s.rows[chosen], minlength=len(n))
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]).astype(np.int32)), pa.array(picked))
    sets = [s.keys[s.edge[i] : s.edge[i + 1]].tobytes() if per[i] else None for i in range(len(n))]
    return pa.table([pa.array(s.ids), pa.array(n), lists, pa.array(sets, pa.binary())], schema=_PREFIX)


def _bitmaps(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """Parity bitmaps: the bits in which two differ are at most the shingles that only one of them has."""
    flat = np.zeros((len(sets), bits), np.uint8)
    for i, s in enumerate(sets):
        flat[i] = np.bincount((s & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flat, axis=1).view(np.uint64)


def _grouped(labels: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct labels and the places of each."""
    order = np.argsort(labels, kind="stable")
    found, first = np.unique(labels[order], return_index=True)
    return found, np.split(order, first[1:])


def links_in_tile(ids: np.ndarray, labels: np.ndarray, sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links that connect, within the tile, all documents over the threshold; equal labels are connected already."""
    order = sorted(range(len(ids)), key=lambda i: (len(sets[i]), ids[i]))
    ids, labels, sets = ids[order], labels[order], [sets[i] for i in order]
    sizes = np.array([len(s) for s in sets])
    root = np.unique(labels, return_inverse=True)[1].astype(np.int64)
    members = {int(r): m for r, m in zip(*_grouped(root), strict=True)}
    links: list[tuple[int, int]] = []
    at = 0
    while at < len(ids):  # bands: bitmaps as wide as the band's sets
        top = np.searchsorted(sizes, 2 * sizes[at], "right")
        end = np.searchsorted(sizes, 100 * sizes[top - 1] // percent, "right")
        bits = 1 << max(6, int(sizes[end - 1] - 1).bit_length())
        maps = _bitmaps(sets[at:end], bits)
        for i in range(at, top):
            high = np.searchsorted(sizes, 100 * sizes[i] // percent, "right")
            near = np.arange(i + 1, high)
            near = near[root[near] != root[i]]
            if not len(near):
                continue
            differ = np.bitwise_count(maps[near - at] ^ maps[i - at]).sum(axis=1, dtype=np.int64)
            both = sizes[near] + sizes[i]
            most = (both - differ) // 2
            near = near[100 * most >= percent * (both - most)]
            for j in near:
                if root[j] == root[i]:
                    continue
                common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * common >= percent * (sizes[i] + sizes[j] - common):
                    links.append((int(ids[i]), int(ids[j])))
                    few, many = sorted((int(root[i]), int(root[j])), key=lambda r: len(members[r]))
                    root[members[few]] = many  # the smaller class moves: a document moves as often as its class doubles
                    members[many] = np.concatenate([members[many], members.pop(few)])
        at = top
    return links


def _tile_links(tiles: DataFrame, percent: int) -> DataFrame:
    """tiles: tile, id, label, shingles. One row for each link found."""

    def run(table: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x, U64) for x in table["shingles"].to_pylist()]
        found = links_in_tile(table["id"].to_numpy(), table["label"].to_numpy(), sets, percent)
        return pa.table([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["u", "v"])

    return tiles.groupBy("tile").applyInArrow(run, "u long, v long")


def prefixes(rows: DataFrame, wanted: DataFrame, words: int, percent: int) -> DataFrame:
    """(id, n, keys, shingles) of each wanted text (node, copy, id): id is its node, id the identifier of one of its rows."""
    parts = partitions(rows.sparkSession)
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks, buckets = max(4 * parts, -(-size // BLOCK_BYTES)), max(parts, -(-size // BLOCK_BYTES))
    bits = min(64, max(24, math.ceil(math.log2(size / 2 + 2)) + SPARE))
    # a text without any identifier is dealt by its hash
    block = F.pmod(F.when(F.col("id").isNull(), F.xxhash64("copy")).otherwise(F.xxhash64("id", F.lit(5))), F.lit(blocks)).cast("int").alias("block")
    rows = rows.where("id is not null").unionByName(rows.where("id is null").groupBy("copy").agg(F.first("id").alias("id"), F.max("text").alias("text")))
    rows = rows.select("copy", "text", block).repartition(parts, "block")
    wanted = wanted.select("node", "copy", block)

    def send(key: tuple, docs: pa.Table, chosen: pa.Table) -> pa.Table:
        return _send(Shingles(docs, chosen, words, bits, buckets), key[0].as_py())

    def count(entries: pa.Table) -> pa.Table:
        return _count(entries)

    def finish(docs: pa.Table, more: pa.Table) -> pa.Table:
        chosen = more.filter(pc.is_valid(more["node"]))
        back = more.filter(pc.is_valid(more["bucket"]))
        return _prefixes(Shingles(docs, chosen, words, bits, buckets), back, percent)

    sent = rows.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(send, "bucket int, block int, n int, keys binary, counts binary")
    back = sent.groupBy("bucket").applyInArrow(count, "bucket int, block int, counts binary")
    both = wanted.unionByName(back, allowMissingColumns=True)
    done = rows.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(finish, "id long, n long, keys array<bigint>, shingles binary")
    return stage(done, "prefixes")


def _candidate_groups(found: DataFrame) -> DataFrame:
    """(id, root): documents connected through shared prefix shingles."""
    held = found.select("id", F.explode("keys").alias("key"))
    first = held.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("key", "low")
    edges = held.join(first, "key").select(F.col("id").alias("u"), F.col("low").alias("v")).where("u <> v").distinct()
    return connected_components(edges)


def _all_links(found: DataFrame, percent: int, cell: int) -> DataFrame:
    """Links that connect all pairs over the threshold."""
    # texts with equal sets, as variants of a line in case or spacing, are linked at once; only one of them goes on
    held = found.where(F.col("shingles").isNotNull()).select("id", F.md5("shingles").alias("digest"))
    firsts = held.groupBy("digest").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("digest", "low")
    same = stage(held.join(firsts, "digest").where("id <> low").select(F.col("id").alias("u"), F.col("low").alias("v")), "same-sets")
    return same.unionAll(_links_of(found.join(same.select(F.col("u").alias("id")), "id", "left_anti"), percent, cell))


def _links_of(found: DataFrame, percent: int, cell: int) -> DataFrame:
    """Links that connect all pairs over the threshold among texts of different sets."""
    groups = stage(_candidate_groups(found), "groups")
    held = found.where(F.col("shingles").isNotNull()).select("id", "n", "shingles")
    # a band spans the sizes that one factor of 100 / percent covers: only neighbouring bands can link
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(100 / percent))).cast("int")
    # a document weighs its shingles and some more, so that a tile is bounded by documents too
    docs = found.where(F.size("keys") > 0).select("id", (F.col("n") + WEIGHT).alias("n"), band.alias("band")).join(groups, "id")
    totals = docs.groupBy("root").agg(F.sum("n").alias("whole"))
    docs = docs.join(totals, "root")
    small = docs.where(F.col("whole") <= cell)
    tile = F.concat_ws("/", F.lit("g"), "root")
    links = stage(_tile_links(small.select(tile.alias("tile"), "id", F.col("id").alias("label")).join(held, "id"), percent), "tile-links")
    large = docs.where(F.col("whole") > cell)
    if large.limit(1).count() == 0:
        return links
    # a larger group: first each cell alone, then what one document of each label and band connects
    sums = large.groupBy("root", "band").agg(F.ceil(F.sum("n") / cell).cast("int").alias("cells"))
    large = stage(large.join(sums, ["root", "band"]).withColumn("label", F.col("id")), "large")
    cut = F.pmod(F.xxhash64("id", F.lit(11)), F.col("cells"))
    tile = F.concat_ws("/", F.lit("c"), "root", "band", cut)
    own = stage(_tile_links(large.select(tile.alias("tile"), "id", "label").join(held, "id"), percent), "tile-links")
    links = links.unionAll(own)
    large = _labelled(large, own)
    heads = large.groupBy("root", "label", "band").agg(F.min_by("id", "n").alias("id"), F.min("n").alias("n"))
    sums = heads.groupBy("root").agg(F.ceil(F.sum("n") / cell).cast("int").alias("cuts"))
    heads = heads.join(sums, "root")
    tile = F.concat_ws("/", F.lit("h"), "root", F.pmod(F.xxhash64("id", F.lit(13)), F.col("cuts")))
    more = stage(_tile_links(heads.select(tile.alias("tile"), "id", "label").join(held, "id"), percent), "tile-links")
    links = links.unionAll(more)
    large = _labelled(large, more)
    # then all pairs of cells that hold documents of two labels; a large label has cells of its own
    sums = large.groupBy("root", "band", "label").agg(F.sum("n").alias("own"))
    sums = sums.withColumn("alone", F.col("own") * 4 > cell)
    rest = sums.groupBy("root", "band").agg(F.ceil(F.sum(F.when(~F.col("alone"), F.col("own"))) / cell).cast("int").alias("cuts"))
    sums = sums.join(rest, ["root", "band"]).select(
        "root", "band", "label", "alone",
        F.when(F.col("alone"), F.ceil(F.col("own") / cell)).otherwise(F.greatest("cuts", F.lit(1))).cast("int").alias("parts"),
    )
    large = large.drop("cells").join(sums, ["root", "band", "label"])
    name = F.when(F.col("alone"), F.concat_ws("/", "label", F.pmod(F.xxhash64("id", F.lit(17)), F.col("parts")))).otherwise(
        F.concat_ws("/", F.lit("m"), F.pmod(F.xxhash64("label", F.lit(19)), F.col("parts")))
    )
    large = stage(large.withColumn("cell", name), "cells")
    # cells meet where documents of two labels share a prefix shingle: other pairs of cells have no link left to find
    keyed = large.join(found.select("id", F.explode("keys").alias("key")), "id")
    cells = keyed.groupBy("root", "key", "band", "cell").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    cells = stage(cells, "cell-keys")
    several = cells.groupBy("root", "key").agg(F.min("low").alias("l"), F.max("high").alias("h")).where("l < h").select("root", "key")
    cells = cells.join(several, ["root", "key"])
    a, b = cells.alias("a"), cells.alias("b")
    step = F.col("b.band") - F.col("a.band")
    pairs = a.join(b, ["root", "key"]).where(((step == 1) | ((step == 0) & (F.col("a.cell") <= F.col("b.cell")))))
    pairs = pairs.where(F.least("a.low", "b.low") < F.greatest("a.high", "b.high"))
    pairs = pairs.select("root", *[F.col(f"{t}.{c}").alias(f"{t}_{c}") for t in "ab" for c in ("band", "cell")]).distinct()
    pairs = pairs.select("root", F.concat_ws("/", F.lit("p"), "root", "a_band", "a_cell", "b_band", "b_cell").alias("tile"),
                         F.explode(F.array_distinct(F.array(F.struct(F.col("a_band").alias("band"), F.col("a_cell").alias("cell")), F.struct(F.col("b_band").alias("band"), F.col("b_cell").alias("cell"))))).alias("x"))
    tiles = large.join(pairs.select("root", "tile", "x.band", "x.cell"), ["root", "band", "cell"]).select("tile", "id", "label").join(held, "id")
    return links.unionAll(stage(_tile_links(tiles, percent), "tile-links"))


def _labelled(large: DataFrame, links: DataFrame) -> DataFrame:
    """Labels joined by the links; ids stay."""
    ids = large.select(F.col("id").alias("i"), F.col("label").alias("l"))
    a = links.join(ids, F.col("u") == F.col("i")).select("v", F.col("l").alias("x"))
    edges = a.join(ids, F.col("v") == F.col("i")).select(F.col("x").alias("u"), F.col("l").alias("v"))
    roots = connected_components(edges).withColumnRenamed("id", "was").withColumnRenamed("root", "now")
    return stage(large.join(roots, F.col("label") == F.col("was"), "left").withColumn("label", F.coalesce("now", "label")).drop("was", "now"), "labels")


def similar_groups(
    docs: DataFrame, words: int = WORDS, percent: int = PERCENT, cell: int = CELL, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of docs: id_col, n_shingles, component_id (the smallest identifier reachable by links), copy, head.

    A row's set holds the distinct shingles of `words` words (A-Z lower-cased) of its text; with fewer words the whole
    sequence is its one shingle; a row without words, or with a null text, has none and links with nothing.
    Identifiers are integers. A link is one of texts: rows that share an identifier but not a text aren't tied by it,
    and null identifiers tie nothing. A component without any identifier has a null component_id. Repeated rows come
    back as often. Other columns, also of clashing names, are ignored; an empty table gives no rows. copy is the text's
    MD5; head marks the rows of the one text of a component that has its smallest identifier (of several, and without
    any, the smallest MD5); a row without words is its own head.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")).withColumn("copy", F.md5("text"))
    keyed = stage(rows.select("id", "copy"), "copies")
    # numbers are given once, in the written table
    copies = stage(keyed.groupBy("copy").agg(F.min("id").alias("id")).withColumn("node", F.monotonically_increasing_id()), "nodes")
    found = prefixes(rows, copies, words, percent)
    links = _all_links(found, percent, cell)
    roots = connected_components(links).withColumnRenamed("id", "node")
    nodes = copies.join(found.select(F.col("id").alias("node"), "n"), "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    nodes = stage(nodes, "rooted")
    tops = nodes.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "copy")).alias("top"))
    nodes = nodes.join(tops, "root").select("copy", "n", F.col("top.id").alias("top"), (F.col("top.copy") == F.col("copy")).alias("head"))
    own = F.col("n") == 0
    return keyed.join(nodes, "copy").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(own, F.col("id")).otherwise(F.col("top")).alias("component_id"),
        "copy", (own | F.col("head")).alias("head"),
    )
