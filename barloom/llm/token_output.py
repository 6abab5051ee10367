"""Token-ID output: documents are tokenised in identifier order and written as rANS-coded shard files.

A shard file holds its frequency table (shared by its blocks), its document table, and blocks that decode on their own;
the block index gives each block's first id, byte offset and checksum, so that readers can start at any block.
Layout: magic, header length (u32), header (zlib JSON), frequency table (zlib: symbols and frequencies as u32),
document table (zlib: identifiers i64, presence u8, lengths u32), blocks.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm import rans
from barloom.llm.common import fresh_path, partitions, stage, text_of
from barloom.llm.hashing import SPACE, by_bytes, column_bytes, hash_words

MAGIC = b"BLRANS01"
END_ID = 2
BLOCK = 1 << 20
#: Ids of a shard: what a task holds in memory.
SHARD = 1 << 23
#: Text bytes that are tokenised at once.
BATCH_BYTES = 4 << 20
#: Pieces whose ids a worker remembers, and ids of them: some 150 MB at most.
REMEMBERED, POOL = 4_000_000, 1 << 24
#: White space beyond ASCII in UTF-8, by its first byte: U+0085, U+00A0, U+1680, U+2000 to U+200A, U+2028, U+2029, U+202F, U+205F, U+3000.
WIDE_SPACES = {0xC2: [(0x85,), (0xA0,)], 0xE1: [(0x9A, 0x80)], 0xE2: [(0x80, c) for c in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)] + [(0x81, 0x9F)], 0xE3: [(0x80, 0x80)]}
#: Pieces that are tokenised in one string: short strings cost less for each piece.
TOGETHER = 200


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class Encoder:
    """Ids of whole texts by the tokenizers library, which sees each distinct piece of text once per memory.

    The byte-level split never joins a word with the white space after it: white space up to the last one stands alone,
    and the last one goes with the word that follows. So a text is cut before each run of white space, and each piece
    is told by a 64-bit hash of its bytes. Loading checks that the tokenizer splits like that and normalises nothing;
    with any other tokenizer texts are tokenised whole. So is a text that holds an added token's string, which the
    library turns into that token's id, and one with white space or separators that aren't plain ASCII.
    """

    #: Bytes that a piece begins with.
    space = SPACE
    remembered, pooled = REMEMBERED, POOL

    def __init__(self, path: str, special_as_text: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        own = json.loads(self.tokenizer.to_str())
        split, model = own["pre_tokenizer"] or {}, own["model"]
        self.cuts = (
            split.get("type") == "ByteLevel" and split.get("use_regex") is True and split.get("add_prefix_space") is False
            and own["normalizer"] is None and own["truncation"] is None and model["type"] == "BPE" and not model.get("dropout")
            and not any(re.search(r"\s", t) for t in added)  # such a string could also arise where pieces are put together
        )
        self.added = [t.encode() for t in added]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocabulary.values()) + 1
        self.length = np.zeros(self.size, np.int64)  # byte-level tokens have a character for each byte
        for token, i in vocabulary.items():
            self.length[i] = len(token)
        self._forget()

    def _forget(self) -> None:
        """The memory: sorted hashes of pieces, and where their ids are in the pool."""
        self.keys, self.at, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 20, np.uint32), 0

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids_of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces, one after the other, and how many each has. Many pieces are tokenised in one string."""
        # white space at a text's end is told by what isn't there, and a text's first word may have none before it
        alone = np.flatnonzero(self.space[data[ends - 1]] | ~self.space[data[starts]])
        joined = np.ones(len(starts), bool)
        joined[alone] = False
        size = (ends - starts)[joined]
        upto = np.cumsum(size)
        raw = data[np.repeat(starts[joined] - upto + size, size) + np.arange(upto[-1] if len(upto) else 0)].tobytes()
        cuts = [0, *upto[TOGETHER - 1 :: TOGETHER].tolist()]
        cuts += [len(raw)] * (cuts[-1] < len(raw))
        ids = self._whole([raw[x:y].decode() for x, y in zip(cuts, cuts[1:], strict=False)])
        flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        last = np.searchsorted(np.cumsum(self.length[flat]), upto) + 1
        counts = np.zeros(len(starts), np.int64)
        counts[joined] = np.diff(last, prepend=0)
        own = self._whole([data[x:y].tobytes().decode() for x, y in zip(starts[alone].tolist(), ends[alone].tolist(), strict=True)])
        counts[alone] = [len(x) for x in own]
        return spliced(flat, counts, alone, own), counts

    def _known(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the pool and number of ids of each key (sorted, distinct; first: a piece that has it)."""
        if self.used > self.pooled or len(self.keys) > self.remembered:
            self._forget()
        place = np.searchsorted(self.keys, keys)
        there = np.zeros(len(keys), bool)
        inside = place < len(self.keys)
        there[inside] = self.keys[place[inside]] == keys[inside]
        new = np.flatnonzero(~there)
        if len(new):
            ids, counts = self._ids_of(data, starts[first[new]], ends[first[new]])
            while self.used + len(ids) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
            self.pool[self.used : self.used + len(ids)] = ids
            at = self.used + np.cumsum(counts) - counts
            self.used += len(ids)
            where = place[new]
            self.keys, self.at, self.n = np.insert(self.keys, where, keys[new]), np.insert(self.at, where, at), np.insert(self.n, where, counts)
            place = np.searchsorted(self.keys, keys)
        return self.at[place], self.n[place]

    def _odd(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows that are tokenised whole."""
        if not self.cuts:
            return np.ones(len(offsets) - 1, bool)
        hits = [np.flatnonzero((data >= 28) & (data <= 31))]
        for lead, then in WIDE_SPACES.items():
            at = np.flatnonzero(data == lead)
            at = at[at + len(then[0]) < len(data)]
            for rest in then:
                hits.append(at[np.logical_and.reduce([data[at + 1 + k] == c for k, c in enumerate(rest)])] if len(at) else at)
        raw = data.tobytes()
        for t in self.added:
            hits.append(np.array([m.start() for m in re.finditer(re.escape(t), raw)], np.int64))
        out = np.zeros(len(offsets) - 1, bool)
        out[np.searchsorted(offsets, np.concatenate(hits), "right") - 1] = True
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (without nulls), one after the other, and how many each text has."""
        data, offsets = column_bytes(texts)
        rows = len(offsets) - 1
        odd = self._odd(data, offsets)
        blank = self.space[data]
        start = blank.copy()
        start[1:] &= ~blank[:-1]
        start[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(start)
        ends = np.append(starts[1:], len(data))[: len(starts)]
        row = np.searchsorted(offsets, starts, "right") - 1
        if odd.any():
            keep = ~odd[row]
            starts, ends, row = starts[keep], ends[keep], row[keep]
        keys, first, entry = np.unique(hash_words(data, starts, ends), return_index=True, return_inverse=True)
        at, n = self._known(data, starts, ends, keys, first)
        n = n[entry]
        upto = np.cumsum(n)
        flat = self.pool[np.repeat(at[entry] - upto + n, n) + np.arange(upto[-1] if len(upto) else 0)]
        counts = np.bincount(row, weights=n, minlength=rows).astype(np.int64)
        if not odd.any():
            return flat, counts
        places = np.flatnonzero(odd)
        whole = self._whole([texts[int(i)].as_py() for i in places])
        counts[places] = [len(x) for x in whole]
        return spliced(flat, counts, places, whole), counts


def spliced(flat: np.ndarray, counts: np.ndarray, places: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """The rows at `places` put between the others' values; counts are those of all rows."""
    edge = np.concatenate([[0], np.cumsum(counts)])
    out, rest = np.empty(edge[-1], np.uint32), np.ones(edge[-1], bool)
    for i, x in zip(places.tolist(), rows, strict=True):
        out[edge[i] : edge[i + 1]] = x
        rest[edge[i] : edge[i + 1]] = False
    out[rest] = flat
    return out


_ENCODERS: dict[str, Encoder] = {}


#: What Hadoop calls a store, and how pyarrow calls it; dbfs is mounted on each node.
SCHEMES = {"s3a://": "s3://", "s3n://": "s3://", "gcs://": "gs://", "dbfs:/": "file:///dbfs/"}


def known_uri(uri: str) -> str:
    """A Hadoop URI by pyarrow's name of its store."""
    for ours, theirs in SCHEMES.items():
        if uri.startswith(ours):
            return theirs + uri[len(ours) :].lstrip("/")
    return uri


def _filesystem(uri: str):
    """(pyarrow file system, path in it) of a Hadoop URI; what pyarrow doesn't know is asked of fsspec, if that is installed."""
    from pyarrow import fs

    uri = known_uri(uri)
    try:
        return fs.FileSystem.from_uri(uri)
    except pa.ArrowInvalid:
        try:
            from fsspec.core import url_to_fs
        except ImportError:
            raise ValueError(f"no file system is known here for {uri}") from None
        other, path = url_to_fs(uri)
        return fs.PyFileSystem(fs.FSSpecHandler(other)), path


def shard_bytes(ids: np.ndarray, keys: list[int | None], lengths: list[int], size: int) -> bytes:
    """A complete shard file."""
    counts = np.bincount(ids, minlength=size)
    freq = rans.quantised(counts)
    used = np.flatnonzero(freq)
    table = zlib.compress(np.concatenate([used, freq[used]]).astype("<u4").tobytes(), 6)
    docs = np.array([k or 0 for k in keys], "<i8").tobytes() + np.array([k is not None for k in keys], "u1").tobytes()
    docs = zlib.compress(docs + np.array(lengths, "<u4").tobytes(), 1)
    ends = np.cumsum(np.array(lengths, np.int64))
    blocks, index, at, k = [], [], 0, 0
    while k < len(ids):
        # a block ends where a document does; only a document of more than a block is cut
        whole = int(np.searchsorted(ends, k + BLOCK, "right"))
        end = int(ends[whole - 1]) if whole and ends[whole - 1] > k else k + BLOCK
        part = ids[k:end]
        k = end
        body = rans.encode(part, freq)
        index.append([k - len(part), len(part), at, len(body), zlib.crc32(part.astype("<u4").tobytes())])
        at += len(body)
        blocks.append(body)
    header = {"size": size, "docs": len(keys), "ids": len(ids), "table": len(table), "doc_table": len(docs), "blocks": index}
    head = zlib.compress(json.dumps(header).encode(), 6)
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, table, docs, *blocks])


class Shard:
    """A shard file, of which only the parts asked for are read. read(offset, length) gives bytes of the file."""

    def __init__(self, read: Callable[[int, int], bytes]) -> None:
        head = read(0, 12)
        if head[:8] != MAGIC:
            raise ValueError("not a shard file")
        (n,) = struct.unpack_from("<I", head, 8)
        header = json.loads(zlib.decompress(read(12, n)))
        at = 12 + n
        tables = read(at, header["table"] + header["doc_table"])
        table = np.frombuffer(zlib.decompress(tables[: header["table"]]), "<u4").reshape(2, -1)
        freq = np.zeros(header["size"], np.int64)
        freq[table[0]] = table[1]
        docs, m = zlib.decompress(tables[header["table"] :]), header["docs"]
        keys = np.frombuffer(docs, "<i8", m).tolist()
        self.keys = [k if there else None for k, there in zip(keys, np.frombuffer(docs, "u1", m, 8 * m), strict=True)]
        self.lengths = np.frombuffer(docs, "<u4", m, 9 * m)
        self.blocks, self.read, self.base = header["blocks"], read, at + len(tables)
        self.decoder = rans.Decoder(freq)

    def block(self, k: int) -> np.ndarray:
        """The ids of a block; its checksum is verified."""
        _, count, offset, length, crc = self.blocks[k]
        ids = self.decoder.decode(self.read(self.base + offset, length), count)
        if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
            raise ValueError("a block's checksum is wrong")
        return ids

    def documents(self, k: int) -> tuple[list[int | None], np.ndarray, np.ndarray, np.ndarray]:
        """Of the documents that begin in block k: identifiers, starts in the file, lengths, and their ids."""
        first, count, *_ = self.blocks[k]
        ends = np.cumsum(self.lengths.astype(np.int64))
        starts = ends - self.lengths
        a, b = np.searchsorted(starts, [first, first + count])
        ids, last = [self.block(k)], k
        while b > a and self.blocks[last][0] + self.blocks[last][1] < ends[b - 1]:
            last += 1
            ids.append(self.block(last))
        skip = starts[a] - first if b > a else 0
        return self.keys[a:b], starts[a:b], self.lengths[a:b].astype(np.int64), np.concatenate(ids)[skip:]


def read_shard(data: bytes) -> tuple[np.ndarray, list[int | None], np.ndarray]:
    """(ids, document identifiers, document lengths) of a shard file; checksums are verified."""
    shard = Shard(lambda at, n: data[at : at + n])
    ids = [shard.block(k) for k in range(len(shard.blocks))]
    return (np.concatenate(ids) if ids else np.zeros(0, np.uint32)), shard.keys, shard.lengths


_MANIFEST = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64()), ("blocks", pa.int32())])
MANIFEST = "part int, seq int, path string, docs long, ids long, bytes long, blocks int"


def write_tokens(
    docs: DataFrame, folder: str | None = None, tokenizer: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Write shard files into `folder` (a URI all executors reach) and return the manifest, with each shard's first id.

    Documents are in ascending identifier order, null identifiers first, those of one identifier by a hash of their
    text, so that reruns agree and the rows of a hot identifier spread over the files; a null text counts as empty and
    has only the end id. Repeated rows are written each; an empty table has no files. Other columns are ignored. Files: part (range
    partition), seq within it. Each attempt of a task writes files of its own name and nothing is renamed: the manifest,
    which Spark commits, names those of the attempt that counts, on any file system.
    """
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "tokens")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange("id", "h").sortWithinPartitions("id", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = tokenizer or tokenizer_path()
        if path not in _ENCODERS:
            _ENCODERS[path] = Encoder(path)
        encoder = _ENCODERS[path]
        task = TaskContext.get()
        part = task.partitionId()
        size = max(encoder.size, end_id + 1)
        keys, lengths, held, total, seq = [], [], [], 0, 0
        fs, base = _filesystem(folder)

        def flush() -> pa.RecordBatch:
            nonlocal keys, lengths, held, total, seq
            body = shard_bytes(np.concatenate(held), keys, lengths, size)
            name = f"{base}/part-{part:07d}-{seq:05d}-{task.taskAttemptId()}.ids"
            fs.create_dir(base, recursive=True)
            with fs.open_output_stream(name) as out:
                out.write(body)
            uri = folder.rstrip("/") + name[len(base) :]
            blocks = len(Shard(lambda at, n: body[at : at + n]).blocks)
            row = {"part": part, "seq": seq, "path": uri, "docs": len(keys), "ids": total, "bytes": len(body), "blocks": blocks}
            keys, lengths, held, total, seq = [], [], [], 0, seq + 1
            return pa.RecordBatch.from_pylist([row], schema=_MANIFEST)

        for batch in batches:
            for some in by_bytes(batch, "text", BATCH_BYTES):
                ids, counts = encoder.encode(some.column("text"))
                held.append(np.insert(ids, np.cumsum(counts), end_id))
                keys += some.column("id").to_pylist()
                lengths += (counts + 1).tolist()
                total += len(held[-1])
                if total >= SHARD:
                    yield flush()
        if keys:
            yield flush()

    manifest = stage(rows.mapInArrow(run, MANIFEST), "manifest")
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # one narrow row per file
    return manifest.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read_tokens(manifest: DataFrame) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32. Blocks are read on their own."""

    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, shard, file = None, None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["path"] != path:
                    if file is not None:
                        file.close()
                    path = row["path"]
                    fs, place = _filesystem(path)
                    file = fs.open_input_file(place)
                    shard = Shard(lambda at, n, file=file: file.read_at(n, at))
                keys, starts, lengths, ids = shard.documents(row["block"])
                raw, ends = ids.astype("<u4").tobytes(), np.cumsum(lengths)
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts + row["start"]), pa.array(lengths), pa.array(crc, pa.int64())], schema=out)
        if file is not None:
            file.close()

    # a row stands for a whole block: with a stated count the few bytes aren't merged into one task
    blocks = manifest.select("path", "start", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    blocks = blocks.repartitionByRange(partitions(manifest.sparkSession), "path", "block").sortWithinPartitions("path", "block")
    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def report(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text), read back from the files: doc_id, start, n_tokens, ids_crc32.

    Null and empty texts have the end id alone, rows of one identifier follow each other by a hash of their text, null
    identifiers come first, an empty table gives no rows, and other columns are ignored. Long texts are cut into batches
    with others, not within: a task holds a text and some ten times its bytes.
    """
    return read_tokens(write_tokens(docs))
