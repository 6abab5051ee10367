"""Benchmark decontamination by Wu-Manber multi-pattern search over normalised bytes.

The test strings are the benchmark's word windows. A fixed-size table of hashed block shifts tells how far a scan may
jump; where the shift is 0, the bucket of the window's last block names the test strings to compare directly. Documents
are never shuffled: each task scans its own texts against tables built from a broadcast of bounded size. Test strings
are places in the normalised benchmark text, not copies, so that what a worker builds is bounded by the slice's bytes:
about SLICE_BYTES for the text, four to eight times that for the shifts and some 25 bytes for each window. A benchmark
over the bound is searched slice by slice, one step after the other over the same rows.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import text_of

WINDOW = 13
BLOCK = 10
SLICE_BYTES = 16 << 20

#: Words are runs of digits, letters and non-ASCII bytes; A-Z become a-z, all else a space.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


class WuManber:
    """Search for byte strings: places [starts, ends) of a text; owners: the item of each."""

    def __init__(self, blob: bytes, starts: np.ndarray, ends: np.ndarray, owners: np.ndarray) -> None:
        order = np.argsort(starts, kind="stable")
        self.blob, starts, ends, owners = blob, starts[order], ends[order], owners[order]
        self.m = m = int((ends - starts).min())
        self.block = b = min(BLOCK, m)
        self.far = far = min(255, m - b + 1)
        self.mask = mask = (1 << max(12, 2 + len(blob).bit_length())) - 1
        self.shift = shift = bytearray([far]) * (mask + 1)
        for low in range(b, len(blob) + 1, 1 << 18):
            # of the block that ends at e, the smallest shift: to the first string at or after e - m that still holds it
            e = np.arange(low, min(low + (1 << 18), len(blob) + 1))
            held = np.minimum(np.searchsorted(starts, e - m), len(starts) - 1)
            inside = (starts[held] >= e - m) & (starts[held] <= e - b)
            for end, jump in zip(e[inside].tolist(), (starts[held] + m - e)[inside].tolist(), strict=True):
                h = zlib.crc32(blob[end - b : end]) & mask
                if jump < shift[h]:
                    shift[h] = jump
        last = np.fromiter((zlib.crc32(blob[s + m - b : s + m]) for s in starts), np.uint32, len(starts))
        order = np.argsort(last, kind="stable")
        self.last, self.starts, self.ends, self.owners = (
            array(kind, x[order].astype(dtype).tobytes()) for kind, dtype, x in (("I", "u4", last), ("q", "i8", starts), ("q", "i8", ends), ("q", "i8", owners))
        )

    def find(self, text: bytes) -> Iterator[tuple[int, int, int]]:
        """(start, length, item) of every occurrence."""
        m, b, mask, shift, crc, last = self.m, self.block, self.mask, self.shift, zlib.crc32, self.last
        end, size = m, len(text)
        while end <= size:
            h = crc(text[end - b : end])
            jump = shift[h & mask]
            if jump:
                end += jump
                continue
            k = bisect_left(last, h)
            while k < len(last) and last[k] == h:
                p = self.blob[self.starts[k] : self.ends[k]]
                if text.startswith(p, end - m):
                    yield end - m, len(p), self.owners[k]
                k += 1
            end += 1


def engines(items: list[tuple[int, bytes]], size: int) -> list[WuManber]:
    """One engine for whole windows and one for each length of shorter items: short strings would shorten all jumps."""
    texts: dict[int, list[tuple[int, bytes]]] = {}
    for item, text in sorted(set(items)):
        words = text.translate(FOLD).split()
        if words:
            texts.setdefault(min(len(words), size), []).append((item, b" " + b" ".join(words) + b" "))
    out = []
    for words, group in texts.items():
        blob = b"".join(t for _, t in group)
        starts, ends, owners, at = [], [], [], 0
        for item, text in group:
            spaces = at + np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
            starts.append(spaces[: len(spaces) - words])
            ends.append(spaces[words:] + 1)
            owners.append(np.full(len(starts[-1]), item, np.int64))
            at += len(text)
        out.append(WuManber(blob, np.concatenate(starts), np.concatenate(ends), np.concatenate(owners)))
    return out


def scan(text: bytes, found: list[WuManber]) -> tuple[int, list[dict[str, int]], list[int]]:
    """Words of the text, merged word spans [s, e) that test strings cover, and the items that occur."""
    words = text.translate(FOLD).split()
    joined = b" " + b" ".join(words) + b" "
    hits = sorted({hit for engine in found for hit in engine.find(joined)}) if words else []
    spans: list[dict[str, int]] = []
    word, last, upto = 0, 0, {}
    for at, n, _ in hits:
        word += joined.count(b" ", last, at)
        last = at
        if (at, n) not in upto:  # once for each test string, not for each item that has it
            upto = {(at, n): word + joined.count(b" ", at, at + n) - 1}
            spans.append({"s": word, "e": upto[at, n]})
    return len(words), merged(spans), sorted({item for _, _, item in hits})


def merged(spans: list[dict[str, int]]) -> list[dict[str, int]]:
    out: list[dict[str, int]] = []
    for x in sorted(spans, key=lambda x: (x["s"], x["e"])):
        if out and x["s"] <= out[-1]["e"]:
            out[-1]["e"] = max(out[-1]["e"], x["e"])
        else:
            out.append(dict(x))
    return out


#: The engines of the slice that a worker searched last, by the slice's content.
_ENGINES: dict[str, list[WuManber]] = {}

FOUND = "n_words long, spans array<struct<s:int,e:int>>, item_ids array<bigint>"
_ARROW = [
    pa.field("n_words", pa.int64()),
    pa.field("spans", pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))),
    pa.field("item_ids", pa.list_(pa.int64())),
]


def _search(rows: DataFrame, slice_: list[tuple[int, bytes]], size: int, more: bool = False) -> DataFrame:
    """rows: payload (a struct that is passed on), text and, after a search, what that found; the text goes if no more follow."""
    shared = rows.sparkSession.sparkContext.broadcast(slice_)
    digest = hashlib.sha256(str(size).encode())
    for item, text in sorted(slice_):
        digest.update(b"%d %d " % (item, len(text)) + text)
    key = digest.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _ENGINES:
            _ENGINES.clear()
            _ENGINES[key] = engines(shared.value, size)
        found = _ENGINES[key]
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            results = [scan(t.as_py(), found) for t in texts]
            if "spans" in batch.schema.names:
                before = zip(batch.column("spans").to_pylist(), batch.column("item_ids").to_pylist(), strict=True)
                results = [(n, merged(s + old), sorted({*ids, *had})) for (n, s, ids), (old, had) in zip(results, before, strict=True)]
            columns = [pa.array([r[i] for r in results], f.type) for i, f in enumerate(_ARROW)]
            kept = ["payload", "text"] if more else ["payload"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *columns], names=[*kept, *(f.name for f in _ARROW)])

    kind = rows.schema["payload"].dataType.simpleString()
    return rows.mapInArrow(run, f"payload {kind}, {'text string, ' if more else ''}{FOUND}")


def find_passages(
    docs: DataFrame,
    benchmark: DataFrame,
    payload: list[str],
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """One row per document: payload (a struct of the columns named), n_words, spans, item_ids.

    A span [s, e) counts the document's words; spans are merged and sorted. A test string is a window of `window`
    words of an item; an item of fewer words, but not none, is one string. Null and empty texts have no words; long ones
    are scanned whole; items with a null identifier or without words are never found. Repeated documents are scanned
    each for itself; an empty benchmark finds nothing, an empty table gives no rows. Other columns, also of clashing
    names, go into the payload or nowhere.
    """
    rows = docs.select(F.struct(*payload).alias("payload"), text_of(text_col).alias("text"))
    items = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("i"), text_of(item_text).alias("t")).distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("n")).first()["n"]
    slices = max(1, -(-total // slice_bytes))
    for k in range(slices):
        part = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(slices)) == k) if slices > 1 else items
        rows = _search(rows, [(r.i, r.t.encode()) for r in part.collect()], window, k < slices - 1)
    return rows


def judged(found: DataFrame, share: int = 20) -> DataFrame:
    """Adds n_hit and contaminated: hit words are a share of 1 in `share` or more."""
    n_hit = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n")),
        lambda a, x: F.struct(
            F.greatest(a.upto, x.e).alias("upto"), (a.n + F.greatest(F.lit(0), x.e - F.greatest(a.upto, x.s))).alias("n")
        ),
        lambda a: a.n.cast("long"),
    )
    found = found.withColumn("n_hit", n_hit)
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document: id_col, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = judged(find_passages(docs, benchmark, [id_col]))
    names = F.array_sort(F.transform("item_ids", lambda i: i.cast("string")))
    return found.select(
        F.col(f"payload.{id_col}").alias(id_col),
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"),
        "contaminated",
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that aren't contaminated, with their own columns."""
    found = judged(find_passages(docs, benchmark, docs.columns))
    return found.where(~F.col("contaminated")).select("payload.*")


_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
pat AS (
    SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS k, array_to_string(w[s:s + least(len(w), {WINDOW}) - 1], ' ') AS p
    FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - {WINDOW - 1}) + 1)) AS s FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT k FROM pat),
win AS (
    SELECT doc_id, k, s, array_to_string(w[s:s + k - 1], ' ') AS p
    FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, lens WHERE len(w) >= k)),
hit AS (SELECT doc_id, s, win.k, item_id FROM win JOIN pat ON win.k = pat.k AND win.p = pat.p),
pos AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS i FROM hit) GROUP BY doc_id),
its AS (
    SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS names
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
