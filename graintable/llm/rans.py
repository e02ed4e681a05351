"""Token ids in files: static range asymmetric numeral system over independent interleaved blocks."""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graintable.llm.common import materialize, new_path, table

MAGIC = b"GRNS"
#: magic, version, scale bits, lanes, steps between checkpoints, tokens, documents, words, crc32 of the ids, crc32 of what follows the header
HEADER = struct.Struct("<4sHHIIIIIII")
LOW = np.uint64(1 << 31)


@dataclass
class Frequencies:
    """Shared table: freq of each id, summing to 2**bits; cumulated; and the id of each slot."""

    freq: np.ndarray
    bits: int

    def __post_init__(self):
        self.freq = self.freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(self.freq), dtype=np.uint16), self.freq.astype(np.int64))


def quantise(counts: np.ndarray, bits: int = 20) -> Frequencies:
    """Counts scaled to a sum of 2**bits; every id that occurs keeps at least 1."""
    total, size = int(counts.sum()), 1 << bits
    if not total:
        counts, total = np.concatenate([[1], counts[1:]]), 1
    seen = counts > 0
    exact = counts.astype(np.float64) * size / total
    freq = np.where(seen, np.maximum(np.floor(exact), 1), 0).astype(np.int64)
    gap = size - int(freq.sum())
    order = np.argsort(-(exact - freq), kind="stable")
    if gap > 0:
        order = order[seen[order]]
        freq[order] += gap // len(order)
        freq[order[:gap % len(order)]] += 1
    while gap < 0:  # too many ids were lifted to 1: the most frequent ones pay
        top = np.argsort(-freq, kind="stable")[:max(1, min(-gap, int((freq > 1).sum())))]
        take = np.minimum(freq[top] - 1, max(1, -gap // len(top)))
        take = np.where(np.cumsum(take) <= -gap, take, np.maximum(-gap - (np.cumsum(take) - take), 0))
        freq[top] -= take
        gap = size - int(freq.sum())
    return Frequencies(freq, bits)


def encode_block(ids: np.ndarray, lengths: np.ndarray, table_: Frequencies, lanes: int = 2048, every: int = 128) -> bytes:
    """One self-contained block: header, document lengths, lane states at every checkpoint with their stream positions, words.

    Id i goes to lane i mod lanes; a checkpoint is the decoder's state before each `every`-th step.
    """
    n = len(ids)
    steps = -(-n // lanes) if n else 0
    bits = np.uint64(table_.bits)
    x = np.full(lanes, LOW, dtype=np.uint64)
    freq, start = table_.freq[ids], table_.start[ids]
    # a lane's state must stay under freq * 2**(63 - bits) before it takes a symbol
    limit = freq << np.uint64(63 - table_.bits)
    out: list[np.ndarray] = []
    states: list[np.ndarray] = []
    sizes: list[int] = []
    emitted = 0
    for s in range(steps - 1, -1, -1):
        a, b = s * lanes, min(n, (s + 1) * lanes)
        v, f = x[:b - a], freq[a:b]
        full = v >= limit[a:b]
        if full.any():
            out.append((v[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
            emitted += len(out[-1])
            v = np.where(full, v >> np.uint64(32), v)
        q = v // f
        x[:b - a] = (q << bits) + (v - q * f) + start[a:b]
        if s % every == 0:
            states.append(x.copy())
            sizes.append(emitted)
    words = np.concatenate(out[::-1]) if out else np.zeros(0, dtype="<u4")
    body = b"".join([lengths.astype("<u4").tobytes(), (emitted - np.array(sizes[::-1], dtype="<u4")).astype("<u4").tobytes(),
                     *(s.astype("<u8").tobytes() for s in states[::-1]), words.tobytes()])
    head = HEADER.pack(MAGIC, 1, table_.bits, lanes, every, n, len(lengths), len(words), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(body))
    return head + body


class Block:
    """An encoded block; any run between two checkpoints can be decoded by itself."""

    def __init__(self, data: bytes):
        magic, version, self.bits, self.lanes, self.every, self.n, docs, words, self.crc, body = HEADER.unpack_from(data)
        if magic != MAGIC or version != 1:
            raise ValueError("not a block of this format")
        if zlib.crc32(memoryview(data)[HEADER.size:]) != body:
            raise ValueError("a block's checksum differs")
        self.steps = -(-self.n // self.lanes) if self.n else 0
        marks = -(-self.steps // self.every)
        at = HEADER.size
        self.lengths = np.frombuffer(data, "<u4", docs, at)
        at += 4 * docs
        self.positions = np.frombuffer(data, "<u4", marks, at)
        at += 4 * marks
        self.states = np.frombuffer(data, "<u8", marks * self.lanes, at).reshape(marks, self.lanes)
        at += 8 * marks * self.lanes
        self.words = np.frombuffer(data, "<u4", words, at)

    def run(self, mark: int, table_: Frequencies, last: int | None = None) -> np.ndarray:
        """Ids from checkpoint `mark` up to checkpoint `last` (None: the next one)."""
        stop = min(self.steps, (mark + 1 if last is None else last) * self.every)
        x = self.states[mark].astype(np.uint64)
        at = int(self.positions[mark])
        bits, mask = np.uint64(table_.bits), np.uint64((1 << table_.bits) - 1)
        first = mark * self.every * self.lanes
        out = np.empty(max(min(self.n, stop * self.lanes) - first, 0), dtype=np.uint16)
        for s in range(mark * self.every, stop):
            a, b = s * self.lanes, min(self.n, (s + 1) * self.lanes)
            v = x[:b - a]
            slot = v & mask
            ids = table_.symbol[slot.astype(np.int64)]
            out[a - first:b - first] = ids
            v = table_.freq[ids] * (v >> bits) + slot - table_.start[ids]
            low = np.flatnonzero(v < LOW)
            if len(low):
                v[low] = (v[low] << np.uint64(32)) | self.words[at:at + len(low)].astype(np.uint64)
                at += len(low)
            x[:b - a] = v
        return out

    def decode(self, table_: Frequencies) -> np.ndarray:
        out = self.run(0, table_, len(self.positions)) if self.steps else np.zeros(0, dtype=np.uint16)
        if zlib.crc32(out.astype("<u4").tobytes()) != self.crc:
            raise ValueError("decoded ids differ from the checksum")
        return out


#: White space other than the space and the line end, wherever a pre-tokenizer might see it.
OTHER_SPACE = ("\t", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0", "\u1680", "\u180e", *map(chr, range(0x2000, 0x200C)), "\u2028", "\u2029", "\u202f", "\u205f", "\u3000", "\ufeff")
WHITE, LETTER, MARK, APOSTROPHE = 3, 4, 5, 6


@functools.cache
def kinds() -> np.ndarray:
    """The kind of each code point: 1 space, 2 line end, 3 other white space, letters, ASCII marks and digits, the apostrophe, 0 all others."""
    out = np.zeros(0x110000, dtype=np.uint8)
    out[[i for i in range(0x110000) if chr(i).isalpha()]] = LETTER
    out[[i for i in range(33, 127) if not chr(i).isalpha()]] = MARK
    out[39] = APOSTROPHE
    out[32], out[10] = 1, 2
    out[list(map(ord, OTHER_SPACE))] = WHITE
    return out


def cut_texts(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """Cuts of texts one after another, and the number of cuts of each text. Every border is one between pre-tokens.

    The byte-level pre-tokenizer starts a pre-token at each run of white space, and gives its last character to what follows:
    as the head of a word if it is a space, else by itself. Runs with white space other than spaces and line ends stay inside a cut.
    A run of letters is a pre-token, but for what an apostrophe takes of it.
    """
    whole = "".join(texts)
    if not whole:
        return pa.array([], pa.large_string()), np.zeros(len(texts), dtype=np.int64)
    data = whole.encode()
    if len(data) == len(whole):
        points, width = np.frombuffer(data, dtype=np.uint8), None
    else:
        points = np.frombuffer(whole.encode("utf-32-le"), dtype="<u4")
        width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
    kind = kinds()[points]
    ends = np.cumsum([len(t) for t in texts])
    first = np.zeros(len(points) + 1, dtype=bool)  # of a text
    first[0] = first[-1] = True
    first[ends] = True
    at = np.flatnonzero((kind > 0) & (kind <= WHITE))
    joined = np.zeros(len(at), dtype=bool)  # to the white space before it
    joined[1:] = (at[1:] == at[:-1] + 1) & ~first[at[1:]]
    last = np.append(~joined[1:], True)[:len(at)]
    followed = last & ~first[at + 1]
    plain = np.ones(len(at), dtype=bool)
    if (kind[at] == WHITE).any():
        run = np.cumsum(~joined) - 1
        odd = np.zeros(int(run[-1]) + 1, dtype=bool)
        odd[run[kind[at] == WHITE]] = True
        plain = ~odd[run]
    border = first
    border[at[plain & (~joined | followed)]] = True
    border[at[plain & followed & (kind[at] == 2)] + 1] = True
    letter = kind == LETTER
    border[1:-1] |= (letter[:-1] & (kind[1:] >= MARK)) | ((kind[:-1] == MARK) & letter[1:])
    borders = np.flatnonzero(border)
    counts = np.diff(np.searchsorted(borders, np.concatenate([[0], ends])))
    offsets = borders if width is None else np.concatenate([[0], np.cumsum(width)])[borders]
    return pa.LargeStringArray.from_buffers(len(borders) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)), counts


class CachedTokenizer:
    """The tokenizers library's ids of whole texts, as little-endian 16-bit bytes.

    Texts are cut between pre-tokens (cut_texts), and each distinct cut is encoded once while it is held: a run of
    letters, a space in front or not, by the library's model alone, as it is one pre-token; other cuts by the library's encoder. Texts that hold an added token's string, which ends pre-tokens
    anywhere, go to the library whole.
    """

    def __init__(self, path: str, held: int = 350_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.model = self.library.model
        self.held = held
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        moved = iter(range(256, 512))
        self.bytes = {b: chr(b) if b in kept else chr(next(moved)) for b in range(256)}  # the byte-level alphabet

    def library_ids(self, texts: list[str]) -> list[bytes]:
        encode = getattr(self.library, "encode_batch_fast", self.library.encode_batch)
        return [np.array(e.ids, dtype="<u2").tobytes() for e in encode(texts, add_special_tokens=False)]

    def add(self, cuts: list[str]) -> None:
        """Ids of cuts into the newer half of the cache."""
        rest = [w for w in cuts if not w.removeprefix(" ").isalpha()]
        self.new.update(zip(rest, self.library_ids(rest), strict=True))
        rest = set(rest)
        space, tokenize, byte = self.bytes[32], self.model.tokenize, self.bytes.__getitem__
        for w in cuts:
            if w not in rest:
                ids = [x.id for x in tokenize(w.replace(" ", space) if w.isascii() else "".join(map(byte, w.encode())))]
                self.new[w] = struct.pack(f"<{len(ids)}H", *ids)

    def encode(self, texts: list[str], chars: int = 4_000_000) -> list[bytes]:
        out: list[bytes] = []
        some: list[str] = []
        size = 0
        for t in texts:
            if some and size + len(t) > chars:
                out += self.encode_some(some)
                some, size = [], 0
            some.append(t)
            size += len(t)
        return out + self.encode_some(some)

    def encode_some(self, texts: list[str]) -> list[bytes]:
        odd = [i for i, t in enumerate(texts) if any(map(t.__contains__, self.added))]
        if odd:
            whole = self.library_ids([texts[i] for i in odd])
            texts = list(texts)
            for i in odd:
                texts[i] = ""
        cuts, counts = cut_texts(texts)
        coded = cuts.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.new) > self.held:  # what is used again moves over from the older half
            self.old, self.new = self.new, {}
        missing = []
        for w in distinct:
            if w not in self.new:
                x = self.old.get(w)
                if x is None:
                    missing.append(w)
                else:
                    self.new[w] = x
        self.add(missing)
        found = [self.new[w] for w in distinct]
        values = np.frombuffer(b"".join(found), dtype="<u2")
        length = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 2
        begin = np.cumsum(length) - length
        at = coded.indices.to_numpy()
        each = length[at]
        ends = np.cumsum(each)
        ids = memoryview(values[np.repeat(begin[at] - ends + each, each) + np.arange(int(each.sum()))].tobytes())
        borders = (2 * np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]).tolist()
        out = [bytes(ids[a:b]) for a, b in zip(borders, borders[1:], strict=False)]
        for i, x in zip(odd, whole if odd else (), strict=True):
            out[i] = x
        return out


_TOKENIZERS: dict[str, CachedTokenizer] = {}


def tokenizer(path: str) -> CachedTokenizer:
    """One for each path and process, with its cache."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = CachedTokenizer(path)
    return _TOKENIZERS[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_blocks(docs: DataFrame, path: str, id_col: str, text_col: str, end_id: int, block_tokens: int) -> DataFrame:
    """part, block, doc_ids, lengths, ids (16-bit binary) in ascending id order: parts by id range, blocks by order in them."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
               .repartitionByRange(n, "_id").sortWithinPartitions("_id", "_t").select("_id", "_t", F.spark_partition_id().alias("part")))
    end = np.array([end_id], dtype="<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tk = tokenizer(path)
        ids: list[bytes] = []
        names: list = []
        have, block, part, type_ = 0, 0, 0, None

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([names], pa.list_(type_)),
                 pa.array([[len(x) // 2 for x in ids]], pa.list_(pa.int32())), pa.array([b"".join(ids)], pa.binary())],
                ["part", "block", "doc_ids", "lengths", "ids"])

        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                type_ = b.schema.field(0).type
                if b.num_rows:
                    part = b.column(2)[0].as_py()
                found = tk.encode([t.as_py() or "" for t in b.column(1)])
                for name, x in zip(b.column(0).to_pylist(), found, strict=True):
                    if ids and have + len(x) // 2 + 1 > block_tokens:
                        yield flush()
                        ids, names, have, block = [], [], 0, block + 1
                    ids.append(x + end)
                    names.append(name)
                    have += len(x) // 2 + 1
        if ids:
            yield flush()

    return ordered.mapInArrow(run, f"part int, block int, doc_ids array<{kind}>, lengths array<int>, ids binary")


def count_ids(blocks: DataFrame, size: int = 1 << 16) -> np.ndarray:
    """How often each id occurs in all blocks; at most `size` rows reach the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for b in batches:
            for x in b.column(0):
                total += np.bincount(np.frombuffer(x.as_buffer(), dtype="<u2"), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["id", "n"])

    out = np.zeros(size, dtype=np.int64)
    for r in blocks.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r[0]] = r[1]
    return out


def write_ids(docs: DataFrame, folder: str, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
              end_id: int = 0, block_tokens: int = 1 << 19, bits: int = 20) -> None:
    """Write folder/frequencies and folder/blocks: the ids of every whole text, in ascending id order, as rANS blocks.

    Null texts count as empty, so each has the end id alone; null ids come first; repeated rows are
    written as often as they occur. A block holds whole documents, about block_tokens ids (more for one longer
    document). Ids have to be under 65536.
    """
    spark = docs.sparkSession
    blocks = materialize(token_blocks(docs, tokenizer_path or default_tokenizer(), id_col, text_col, end_id, block_tokens), "token-blocks")
    table_ = quantise(count_ids(blocks), bits)
    spark.createDataFrame([(bits, table_.freq.astype("<u4").tobytes())], "bits int, freq binary").coalesce(1).write.parquet(f"{folder}/frequencies")
    kind = blocks.schema["doc_ids"].dataType.simpleString()
    shared = spark.sparkContext.broadcast((table_.freq, table_.bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Frequencies(*shared.value)
        for b in batches:
            for i in range(b.num_rows):
                lengths = b.column(3)[i].values.to_numpy().astype(np.int64)
                data = encode_block(np.frombuffer(b.column(4)[i].as_buffer(), dtype="<u2"), lengths, t)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), b.column(1).slice(i, 1), pa.array([int(lengths.sum())], pa.int64()), b.column(2).slice(i, 1), pa.array([data], pa.binary())],
                                                 ["part", "block", "n_tokens", "doc_ids", "data"])

    blocks.mapInArrow(run, f"part int, block int, n_tokens long, doc_ids {kind}, data binary").write.option("compression", "none").parquet(f"{folder}/blocks")


def read_ids(spark: SparkSession, folder: str, id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """id_col, start, n_tokens, ids_crc32 and (with_ids) ids (binary, 32-bit little-endian) of each document in folder.

    Blocks are decoded independently and fail on a wrong checksum; start counts all ids before the document.
    """
    bits, freq = spark.read.parquet(f"{folder}/frequencies").first()
    shared = spark.sparkContext.broadcast((np.frombuffer(freq, dtype="<u4"), bits))
    files = spark.read.parquet(f"{folder}/blocks")
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Frequencies(*shared.value)
        for b in batches:
            for i in range(b.num_rows):
                block = Block(b.column(3)[i].as_buffer())
                ids = block.decode(t).astype("<u4")
                ends = np.cumsum(block.lengths.astype(np.int64))
                starts = ends - block.lengths
                parts = [ids[x:y].tobytes() for x, y in zip(starts.tolist(), ends.tolist(), strict=True)]
                cols = [b.column(2)[i].values, pa.array(starts, pa.int64()), pa.array(block.lengths.astype(np.int64)), pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                        b.column(0).take(pa.array([i] * len(parts))), b.column(1).take(pa.array([i] * len(parts)))]
                names = [id_col, "offset", "n_tokens", "ids_crc32", "part", "block"]
                if with_ids:
                    cols.append(pa.array(parts, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = f"`{id_col}` {kind}, offset long, n_tokens long, ids_crc32 long, part int, block int" + ", ids binary" * with_ids
    found = files.select("part", "block", "doc_ids", "data").mapInArrow(run, schema)
    sizes = files.select("part", "block", "n_tokens")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = (sizes.select("part", "block", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("own")).join(parts, "part")
             .select("part", "block", (F.col("own") + F.col("base")).alias("base")))
    out = found.join(bases, ["part", "block"])
    return out.select(id_col, (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of documents written and read back: doc_id, start, n_tokens, ids_crc32 (nulls, ties and repeated rows: see write_ids)."""
    folder = new_path(spark, "token-files")
    write_ids(table(spark, sf_dir, "documents"), folder)
    return read_ids(spark, folder, with_ids=False)
