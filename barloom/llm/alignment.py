"""Cross-tokenizer alignment: shared cuts of two tokenisations by packed bitsets.

Token ends of both tokenisations are bits over the bytes of many texts at once. Their AND has a bit where both end; its
bits are selected, and ranks by popcount map each cut to the number of tokens before it on either side, so that cuts
turn into ranges of tokens. Token pairs of a range are links.

Corpus-wide counts of linked id pairs: a task gathers the pairs of many documents into a block with one dictionary of
distinct pairs, and documents hold places in it. Only dictionaries are joined with the counts, so that a frequent pair
moves once for each block, not for each document. Blocks then meet their documents again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import stage, text_of
from barloom.llm.hashing import by_bytes, column_bytes
from barloom.llm.token_output import Encoder, tokenizer_path

#: Text bytes that are aligned at once, and bytes and distinct pairs at which a block ends.
BATCH_BYTES, BLOCK_BYTES, BLOCK_PAIRS = 1 << 20, 6 << 20, 1 << 16
#: Pieces and their ids that an encoder remembers: some 40 MB, as a worker has two of them.
REMEMBERED, POOL = 1_000_000, 1 << 22
#: Links of a group up to which they are written out; larger groups count their ids first.
FEW = 256
SPACE_PIECE = "▁"


class PieceEncoder(Encoder):
    """Ids of texts that begin with the space which a sentencepiece model adds, by distinct pieces like Encoder.

    No piece of such a model has a space after something else, so merges stay within a run of spaces and the word
    after it; loading checks that, and otherwise texts are encoded whole. So are texts with the space's own sign.
    """

    space = np.arange(256) == 32
    remembered, pooled = REMEMBERED, POOL

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        self.bytes = []
        for i in range(self.size):
            piece = self.model.id_to_piece(i)
            self.bytes.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace(SPACE_PIECE, " ").encode())
        self.length = np.array([len(b) for b in self.bytes], np.int64)
        self.cuts = not any(b" " in b.lstrip(b" ") for b in self.bytes) and self.model.encode("a  b ") == [
            *self.model.encode("a"), *self.model.encode(" b"), *self.model.encode("a ")[len(self.model.encode("a")) :]
        ]
        self._forget()

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        # the library adds no space to an empty text: runs of spaces are encoded behind a letter
        bare = [not t.strip(" ") for t in texts]
        found = self.model.encode([f"a{t}" if b else t[1:] for t, b in zip(texts, bare, strict=True)], num_threads=1) if texts else []
        return [np.array(ids[1:] if b else ids, np.uint32) for ids, b in zip(found, bare, strict=True)]

    def _odd(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.full(len(offsets) - 1, not self.cuts)
        first, second, third = SPACE_PIECE.encode()
        at = np.flatnonzero((data[:-2] == first) & (data[1:-1] == second) & (data[2:] == third))
        out[np.searchsorted(offsets, at, "right") - 1] = True
        return out


class ByteEncoder(Encoder):
    """A byte-level tokenizer's ids; strings of special tokens are text."""

    remembered, pooled = REMEMBERED, POOL

    def __init__(self, path: str) -> None:
        super().__init__(path, special_as_text=True)
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256
        byte = {chr(b): b for b in kept} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in kept)}
        self.bytes = [b""] * self.size
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.bytes[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        self.length = np.array([len(b) for b in self.bytes], np.int64)


class Side:
    """One tokenizer with its tables."""

    def __init__(self, encoder: Encoder) -> None:
        self.encoder = encoder
        self.flat = np.frombuffer(b"".join(encoder.bytes), np.uint8)
        self.first = np.cumsum(encoder.length) - encoder.length
        text = [str(i).encode() for i in range(encoder.size)]
        self.width = np.array([len(t) for t in text])
        self.digits = np.zeros((encoder.size, int(self.width.max()) + 1), np.uint8)
        for i, t in enumerate(text):
            self.digits[i, : len(t)] = list(t)

    def same(self, ids: np.ndarray, counts: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows whose tokens' joined bytes are the row's bytes."""
        size = self.encoder.length[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        edge = ends[np.concatenate([[0], np.cumsum(counts)])]
        long = np.diff(edge)
        ok = long == np.diff(offsets)
        if not ok.all():
            keep = np.repeat(ok, counts)
            ids, size = ids[keep], size[keep]
            data = data[np.repeat(ok, np.diff(offsets))]
        place = np.repeat(self.first[ids] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        wrong = np.flatnonzero(self.flat[place] != data)
        live = np.flatnonzero(ok)
        ok[live[np.searchsorted(np.cumsum(long[ok]), wrong, "right")]] = False
        return ok


_SIDES: dict[tuple[str, str], tuple[Side, Side]] = {}


def sides(a: str, b: str) -> tuple[Side, Side]:
    if (a, b) not in _SIDES:
        _SIDES[a, b] = Side(ByteEncoder(a)), Side(PieceEncoder(b))
    return _SIDES[a, b]


def packed(ends: np.ndarray, n: int) -> np.ndarray:
    """A bitset of n bits, in words of 64, with the bits of `ends` set."""
    bits = np.zeros(-(-n // 64) * 64, np.uint8)
    bits[ends] = 1
    return np.packbits(bits, bitorder="little").view("<u8")


def select(words: np.ndarray) -> np.ndarray:
    """Places of the set bits."""
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))


def rank(words: np.ndarray, places: np.ndarray) -> np.ndarray:
    """How many bits are set up to and with each place."""
    before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
    upto = np.uint64(0xFFFFFFFFFFFFFFFF) >> (63 - (places & 63)).astype(np.uint64)
    return before[places >> 6] + np.bitwise_count(words[places >> 6] & upto)


class Aligned:
    """Groups of a batch of texts. Rows without tokens have none; token ranges of group g are cut[g] to cut[g + 1]."""

    def __init__(self, texts: pa.Array, a: Side, b: Side) -> None:
        rows = len(texts)
        spaced = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts.cast(pa.large_string()), pa.scalar("", pa.large_string()))
        data, offsets = column_bytes(spaced)
        found = [s.encoder.encode(spaced) for s in (a, b)]
        live = np.diff(offsets) > 1
        for side, (ids, counts) in zip((a, b), found, strict=True):
            live &= side.same(ids, counts, data, offsets)
        self.counts = [np.where(live, counts, 0) for _, counts in found]
        self.ids = [ids[np.repeat(live, counts)].astype(np.int64) for ids, counts in found]
        sizes = np.where(live, np.diff(offsets), 0)
        n = int(sizes.sum())
        bits = [packed(np.cumsum(s.encoder.length[ids]) - 1, n) for s, ids in zip((a, b), self.ids, strict=True)]
        shared = bits[0] & bits[1]
        self.ends = select(shared)
        self.cut = [np.concatenate([[0], rank(w, self.ends)]) for w in bits]
        self.size = [np.diff(c) for c in self.cut]
        self.row = np.searchsorted(np.cumsum(sizes), self.ends, "right")
        self.starts = np.cumsum(sizes) - sizes  # each row's first byte among the live ones
        self.n_groups = np.bincount(self.row, minlength=rows)
        upto = np.concatenate([[0], np.cumsum(self.size[0] * self.size[1])])
        edge = np.concatenate([[0], np.cumsum(self.n_groups)])
        self.n_links = np.diff(upto[edge])
        self.edge = edge

    def digests(self, a: Side, b: Side) -> list[str]:
        """The SHA-256 of each row's groups as text: a1,a2|b1;a3|b2,b3 ('' without tokens)."""
        (cut_a, cut_b), (n_a, n_b) = self.cut, self.size
        groups = np.arange(len(n_a))
        total = len(self.ids[0]) + len(self.ids[1])
        width = max(a.digits.shape[1], b.digits.shape[1])
        text, digits = np.zeros((total, width), np.uint8), np.zeros(total, np.int64)
        at_a = np.arange(len(self.ids[0])) + cut_b[np.repeat(groups, n_a)]
        at_b = np.arange(len(self.ids[1])) + cut_a[np.repeat(groups, n_b) + 1]
        for side, ids, at in ((a, self.ids[0], at_a), (b, self.ids[1], at_b)):
            text[at, : side.digits.shape[1]] = side.digits[ids]
            digits[at] = side.width[ids]
        text[np.arange(total), digits] = ord(",")
        last_a, last_b = cut_a[1:] + cut_b[:-1] - 1, cut_a[1:] + cut_b[1:] - 1
        text[last_a, digits[last_a]] = ord("|")
        text[last_b, digits[last_b]] = ord(";")
        digits += 1
        upto = np.concatenate([[0], np.cumsum(digits)])
        raw = text[np.arange(width) < digits[:, None]].tobytes()
        tokens = np.concatenate([[0], cut_a[1:] + cut_b[1:]])[self.edge]  # of all rows before
        return [hashlib.sha256(raw[upto[x] : upto[y] - 1]).hexdigest() if y > x else "" for x, y in zip(tokens[:-1].tolist(), tokens[1:].tolist(), strict=True)]

    def pairs(self, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, a * base + b, occurrences) of each row's distinct linked pairs, sorted by row and pair."""
        (ids_a, ids_b), (n_a, n_b) = self.ids, self.size
        few = n_a * n_b <= FEW
        group = np.repeat(np.arange(len(n_a)), n_a)
        reps = np.where(few, n_b, 0)[group]
        left = np.repeat(np.arange(len(ids_a)), reps)
        upto = np.cumsum(reps)
        right = np.arange(len(left)) + np.repeat(self.cut[1][:-1][group] - (upto - reps), reps)
        row, pair, times = self.row[group[left]], ids_a[left] * base + ids_b[right], np.ones(len(left), np.int64)
        large = [(row, pair, times)]
        for g in np.flatnonzero(~few).tolist():
            ua, ca = np.unique(ids_a[self.cut[0][g] : self.cut[0][g + 1]], return_counts=True)
            ub, cb = np.unique(ids_b[self.cut[1][g] : self.cut[1][g + 1]], return_counts=True)
            found = (ua[:, None] * base + ub).reshape(-1)
            large.append((np.full(len(found), self.row[g]), found, (ca[:, None] * cb).reshape(-1)))
        row, pair, times = (np.concatenate(x) for x in zip(*large, strict=True))
        order = np.lexsort((pair, row)) if len(large) > 1 else np.argsort(row * (1 << 40) + pair, kind="stable")
        row, pair, times = row[order], pair[order], times[order]
        new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (pair[1:] != pair[:-1])])) if len(row) else np.zeros(0, np.int64)
        return row[new], pair[new], np.add.reduceat(times, new) if len(new) else times


COLUMNS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, block long, wide boolean, places binary, times binary, dictionary binary, held binary"
_TYPES = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "int": pa.int32(), "array<long>": pa.list_(pa.int64())}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(n, _TYPES[t]) for n, t in (c.split() for c in ddl.split(", "))])


def _aligned_blocks(a: str, b: str):
    schema = _schema(COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = sides(a, b)
        part, seq = TaskContext.get().partitionId(), 0
        meta: list[list] = [[] for _ in range(6)]
        rows, pairs, times, known, held, size = [], [], [], np.zeros(0, np.int64), 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal meta, rows, pairs, times, known, held, size, seq
            dictionary, place = np.unique(np.concatenate(pairs), return_inverse=True)
            edge = np.searchsorted(np.concatenate(rows), np.arange(held + 1))
            wide = len(dictionary) > 1 << 16
            place, often = place.astype("<u4" if wide else "<u2"), np.concatenate(times).astype("<i8")
            of = [place[x:y].tobytes() for x, y in zip(edge[:-1], edge[1:], strict=True)]
            count = [often[x:y].tobytes() for x, y in zip(edge[:-1], edge[1:], strict=True)]
            docs = np.bincount(place, minlength=len(dictionary)).astype("<i8")
            first = [None] * (held - 1)
            out = [*meta, [(part << 32) + seq] * held, [wide] * held, of, count, [dictionary.astype("<i8").tobytes(), *first], [docs.tobytes(), *first]]
            meta, rows, pairs, times, known, held, size, seq = [[] for _ in range(6)], [], [], [], np.zeros(0, np.int64), 0, 0, seq + 1
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

        for batch in batches:
            for some in by_bytes(batch, "text", BATCH_BYTES):
                found = Aligned(some.column("text"), one, two)
                row, pair, often = found.pairs(two.encoder.size)
                distinct = np.unique(pair)
                grown = np.union1d(known, distinct)
                if held and (len(grown) > BLOCK_PAIRS or size > BLOCK_BYTES):
                    yield flush()
                    grown = distinct
                known = grown
                rows.append((row + held).astype(np.int32)), pairs.append(pair), times.append(often)
                columns = [some.column("id").to_pylist(), *(c.tolist() for c in found.counts), found.n_groups.tolist(), found.n_links.tolist(), found.digests(one, two)]
                for into, values in zip(meta, columns, strict=True):
                    into += values
                held, size = held + len(some), size + some.column("text").nbytes
        if held:
            yield flush()

    return run


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, pair, held) of the dictionaries."""
    for batch in batches:
        for block, dictionary, held in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            pair = np.frombuffer(dictionary, "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), block)), pa.array(pair), pa.array(np.frombuffer(held, "<i8"))], names=["block", "pair", "held"])


_DONE = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _scored(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """The documents of a block with what its dictionary's pairs count."""
    order = np.argsort(pairs.column("pair").to_numpy())
    n, best = pairs.column("n").to_numpy()[order], pairs.column("best").to_numpy()[order].astype(np.int64)
    n_best, count_sum = [], []
    for places, times, wide in zip(*(docs.column(c).to_pylist() for c in ("places", "times", "wide")), strict=True):
        at, often = np.frombuffer(places, "<u4" if wide else "<u2"), np.frombuffer(times, "<i8")
        n_best.append(int((often * best[at]).sum())), count_sum.append(int((often * n[at]).sum()))
    docs = docs.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))
    return docs.select([c.split()[0] for c in _DONE.split(", ")]).cast(_schema(_DONE))


def blocks(docs: DataFrame, a: str | None = None, b: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The aligned documents (staged): their counts and digest, and their linked pairs in blocks."""
    paths = a or tokenizer_path(), b or tokenizer_path("piece_bpe_32k.model")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    return stage(rows.mapInArrow(_aligned_blocks(*paths), COLUMNS), "aligned")


def pair_counts(aligned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((block, pair), and pair, n, best): how many documents hold a pair linked, and whether no pair of its A id has more.

    pair is A id * size of B + B id. The maxima are one row per A id: the vocabulary bounds that table.
    """
    base = sides_size()
    held = aligned.where("dictionary IS NOT NULL").select("block", "dictionary", "held").mapInArrow(_opened, "block long, pair long, held long")
    held = stage(held, "pairs")
    counts = held.groupBy("pair").agg(F.sum("held").alias("n"))
    most = counts.groupBy(F.floor(F.col("pair") / base).alias("a")).agg(F.max("n").alias("most"))
    counts = counts.join(F.broadcast(most), F.floor(F.col("pair") / base) == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    return held.select("block", "pair"), counts


def sides_size(path: str | None = None) -> int:
    """The number of B's ids."""
    import sentencepiece

    return int(sentencepiece.SentencePieceProcessor(model_file=path or tokenizer_path("piece_bpe_32k.model")).get_piece_size())


def report(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Null and empty texts, and those whose tokens don't join to a space and the text (as with the sign U+2581, which B
    reads as a space), have zeros and ''. Repeated rows count each as a document; null identifiers are passed on; an
    empty table gives no rows; other columns are ignored. A long text is aligned whole, in memory of some fifty times
    its bytes.
    """
    aligned = blocks(docs)
    held, counts = pair_counts(aligned)
    known = held.join(counts, "pair")
    wanted = aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "block", "wide", "places", "times")
    return wanted.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_scored, _DONE)


def aligned_groups(docs: DataFrame, a: str | None = None, b: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The groups themselves: id_col, at (from 0), start and end (bytes of the space and the text), a_ids, b_ids."""
    paths = a or tokenizer_path(), b or tokenizer_path("piece_bpe_32k.model")
    ddl = "id long, at long, start long, end long, a_ids array<long>, b_ids array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = sides(*paths)
        for batch in batches:
            for some in by_bytes(batch, "text", BATCH_BYTES):
                g = Aligned(some.column("text"), one, two)
                if not len(g.ends):
                    continue
                ends = g.ends + 1 - g.starts[g.row]
                at = np.arange(len(ends)) - g.edge[:-1][g.row]
                lists = [pa.ListArray.from_arrays(pa.array(c, pa.int32()), pa.array(ids)) for c, ids in zip(g.cut, g.ids, strict=True)]
                yield pa.RecordBatch.from_arrays([some.column("id").take(pa.array(g.row)), pa.array(at), pa.array(np.where(at == 0, 0, np.concatenate([[0], ends[:-1]]))), pa.array(ends), *lists], schema=_schema(ddl))

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, ddl.replace("end", "`end`")).withColumnRenamed("id", id_col)
