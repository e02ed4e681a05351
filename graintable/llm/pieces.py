"""SentencePiece encoding and decoding by a relational lattice, folded by Viterbi."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graintable.llm.common import giving_back, materialize, materialize_bucketed, release, table

SPACE = "▁"
#: An edge of the lattice has a weight and a long: end (32 bits), length (7 bits), piece id (24 bits). A step is the long's lower 31 bits.
LEN_BITS, ID_BITS = 7, 24
#: Characters of a unit that are taken at once: few units are longer, and for those neither a row nor an accumulator holds the whole.
WINDOW, SHORT = 256, 64
#: Ids from here on are code points of characters without a piece.
OTHER = 1 << 22
#: Units of a task of the lattice: a unit has tens of edges, which the task sorts in its executor's heap.
TASK_UNITS = 25_000
#: Characters of a batch that is cut at once.
BATCH_CHARS = 500_000


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass
class Cuts:
    """Where texts may be cut: classes of characters, and the pairs of classes that stand next to each other in a piece."""

    classes: np.ndarray
    n_classes: int
    joined: np.ndarray

    def cut(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """The units of texts one after another (spaces still as they are), each text with the dummy space in front, and the number of units of each text."""
        whole = "".join([f" {t}" for t in texts if t])
        if not whole:
            return pa.array([], pa.large_string()), np.zeros(len(texts), dtype=np.int64)
        data = whole.encode()
        if len(data) == len(whole):
            points, width = np.frombuffer(data, dtype=np.uint8), None
        else:
            points = np.frombuffer(whole.encode("utf-32-le"), dtype="<u4")
            width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        c = self.classes[points].astype(np.int32)
        border = np.empty(len(points) + 1, dtype=bool)
        border[0] = border[-1] = True
        np.logical_not(self.joined[c[:-1] * self.n_classes + c[1:]], out=border[1:-1])
        ends = np.cumsum([len(t) + 1 if t else 0 for t in texts])
        border[ends] = True
        at = np.flatnonzero(border)
        counts = np.diff(np.searchsorted(at, np.concatenate([[0], ends])))
        offsets = at if width is None else np.concatenate([[0], np.cumsum(width)])[at]
        return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)), counts


class Decoder:
    """Bytes of each id as they decode, for all ids in one buffer."""

    def __init__(self, pieces: list[bytes]):
        self.back = pa.array(pieces, pa.large_binary())

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts of ids, counts of them each, their leading dummy space removed; broken byte runs become U+FFFD."""
        found = self.back.take(pa.array(ids.astype(np.int64)))
        offsets = np.frombuffer(found.buffers()[1], dtype=np.int64)[:len(ids) + 1]
        data = memoryview(found.buffers()[2] or b"")
        at = offsets[np.concatenate([[0], np.cumsum(counts)])].tolist()
        texts = [bytes(data[a:b]) for a, b in zip(at, at[1:], strict=False)]
        return [(t[1:] if t.startswith(b" ") else t).decode("utf-8", "replace") for t in texts]


class Pieces:
    """The piece table of a model file: text, id and score of each normal piece, the byte pieces, and where texts may be cut.

    Between two characters that no piece holds next to each other every segmentation has a border; texts are cut there
    into units, so units can be folded by themselves without any loss.
    """

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.path = path
        self.text = [sp.id_to_piece(i) for i in range(size)]
        special = [sp.is_byte(i) or sp.is_control(i) or sp.is_unused(i) or sp.is_unknown(i) for i in range(size)]
        self.ids = {p: i for i, p in enumerate(self.text) if not special[i]}
        self.score = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.unknown = sp.unk_id()
        self.bytes = {int(self.text[i][3:5], 16): i for i in range(size) if sp.is_byte(i)}
        self.longest = max(map(len, self.ids), default=1)
        if self.longest >= 1 << LEN_BITS or size >= OTHER:
            raise ValueError("pieces are too long or too many")
        #: A character without a piece weighs ten less than the least piece, as in the library.
        self.without = min(self.score.values(), default=0.0) - 10.0
        pairs = {a + b for p in self.ids for a, b in zip(p, p[1:], strict=False)}
        chars = sorted({c for ab in pairs for c in ab})
        number = {c: i + 1 for i, c in enumerate(chars)}
        classes = np.zeros(0x110000, dtype=np.uint16)
        for c, i in number.items():
            classes[ord(c)] = i
        classes[ord(" ")] = classes[ord(SPACE)]
        joined = np.zeros((len(chars) + 1) ** 2, dtype=bool)
        for a, b in pairs:
            joined[number[a] * (len(chars) + 1) + number[b]] = True
        self.cuts = Cuts(classes, len(chars) + 1, joined)
        self.back = Decoder([bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(self.text)])


_LOADED: dict[str, Pieces] = {}


def loaded(path: str) -> Pieces:
    """The piece table of a path, read once in a process."""
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def unit_key(word: Column) -> Column:
    """What a unit is grouped and joined by: the unit itself up to SHORT characters, else a digest, which is longer than that."""
    return F.when(F.length(word) <= SHORT, word).otherwise(F.concat(F.lit("sha256: "), F.sha2(word.cast("binary"), 256)))


def unit_lattice(words: DataFrame, pieces: Pieces, short: bool) -> DataFrame:
    """places and parts for each row of words (key, group, word, places; no key and group twice).

    Parts hold the edges (sorted structs: end, length and piece id in a long, weight) that end in the first WINDOW characters, the next, and so on.
    Substrings of up to the longest piece's length are exploded and equi-joined to the piece table, which the model
    bounds; a single character without a piece is an edge with its code point above OTHER. Edges are grouped by key;
    rows hold a window of a unit, never the whole of a long one, and only a unit's first row holds its places.
    short: all words fit into a window, so each has one part.
    """
    # a table, not a list of rows, for which the executors would start Python workers of their own
    known = words.sparkSession.createDataFrame(pa.table({"piece": pa.array(list(pieces.ids), pa.string()), "id": pa.array(list(pieces.ids.values()), pa.int32()), "weight": pa.array([pieces.score[p] for p in pieces.ids], pa.float64())}))
    size, longest = F.lit(WINDOW), F.lit(pieces.longest)
    end = (F.col("base") + F.col("s") + F.col("k") - 1).cast("long")
    at = F.shiftleft(end, LEN_BITS + ID_BITS) + F.shiftleft(F.col("k").cast("long"), ID_BITS) + F.coalesce("id", F.lit(OTHER) + F.ascii("piece"))
    edge = F.struct(at.alias("e"), F.coalesce("weight", F.lit(pieces.without)).alias("w"))
    one = (F.col("base") == 0) & (F.col("s") == 1) & (F.col("k") == 1)
    edges = (
        words.select("key", "group", "places", F.translate("word", " ", SPACE).alias("_w"), F.explode(F.sequence(F.lit(0), F.length("word") - 1, size)).alias("base"))
        .select("key", "group", "places", "base", F.col("_w").substr(F.col("base") + 1, size + longest).alias("_w"))
        .select("key", "group", "places", "base", "_w", F.explode(F.sequence(F.lit(1), F.least(size, F.length("_w")))).alias("s"))
        .select("key", "group", "places", "base", "_w", "s", F.explode(F.sequence(F.lit(1), F.least(longest, F.length("_w") - F.col("s") + 1))).alias("k"))
        .select("key", "group", F.when(one, F.col("places")).alias("places"), "base", "s", "k", F.col("_w").substr(F.col("s"), F.col("k")).alias("piece"))
        .join(F.broadcast(known), "piece", "left")
        .where("id is not null or k = 1")
        .select("key", "group", "places", edge.alias("edge"))
    )
    if short:
        return (edges.groupBy("key", "group").agg(F.sort_array(F.collect_list("edge")).alias("edges"), F.collect_list("places").alias("places"))
                .select(F.flatten("places").alias("places"), F.array("edges").alias("parts")))
    return (
        edges.groupBy("key", "group", F.floor((F.shiftright("edge.e", LEN_BITS + ID_BITS) - 1) / WINDOW).alias("part"))
        .agg(F.sort_array(F.collect_list("edge")).alias("edges"), F.collect_list("places").alias("places"))
        .groupBy("key", "group").agg(F.sort_array(F.collect_list(F.struct("part", "edges"))).alias("parts"), F.flatten(F.flatten(F.collect_list("places"))).alias("places"))
        .select("places", F.col("parts.edges").alias("parts"))
    )


def best_steps(parts: Column) -> Column:
    """Viterbi as a fold over edges sorted by end: for each position from 1 the step (length, piece id) of the best path to it, in parts.

    A path's value is the sum of its pieces' weights; of equal ones that with the longer last piece wins, then the larger id.
    An inner fold runs over a part's edges, an outer one over the parts, as Spark copies an accumulator at each step.
    Both hold `done`, value and step of the positions from `first` on, and `last`, those of the position behind them.
    """
    keep = 1 << LEN_BITS

    def step(acc: Column, edge: Column) -> Column:
        e = F.shiftright(edge["e"], LEN_BITS + ID_BITS).cast("int")
        taken = edge["e"].bitwiseAND((1 << (LEN_BITS + ID_BITS)) - 1).cast("int")
        begin = e - F.shiftright(taken, ID_BITS)
        done, last, first = acc["done"], acc["last"], acc["first"]
        here = first + F.size(done)  # the position of last
        before = F.when(begin == here, last["v"]).otherwise(F.get(done, begin - first)["v"])
        found = F.struct((before + edge["w"]).alias("v"), taken.alias("t"))
        same = F.struct(done.alias("done"), F.greatest(last, found).alias("last"), first.alias("first"))
        more = F.struct(F.array_append(done, last).alias("done"), found.alias("last"), first.alias("first"))
        return F.when(e == here, same).otherwise(more)

    def part(acc: Column, edges: Column) -> Column:
        start = F.struct(acc["done"].alias("done"), acc["last"].alias("last"), acc["first"].alias("first"))
        before = acc["first"] + F.size(acc["done"])

        def close(now: Column) -> Column:
            here, size = now["first"] + F.size(now["done"]), F.size(now["done"])
            drop = F.greatest(size - keep, F.lit(0))
            steps = F.transform(F.slice(F.array_append(now["done"], now["last"]), size + 2 - (here - before), here - before), lambda x: x["t"])
            return F.struct(F.slice(now["done"], drop + 1, F.greatest(size, F.lit(1))).alias("done"), now["last"].alias("last"), (now["first"] + drop).alias("first"),
                            F.array_append(acc["chunks"], steps).alias("chunks"))

        return F.aggregate(edges, start, step, close)

    start = F.struct(F.expr("cast(array() as array<struct<v:double,t:int>>)").alias("done"), F.struct(F.lit(0.0).alias("v"), F.lit(0).alias("t")).alias("last"),
                     F.lit(0).alias("first"), F.expr("cast(array() as array<array<int>>)").alias("chunks"))
    return F.aggregate(parts, start, part, lambda acc: acc["chunks"])


def best_ids(steps: Column, pieces: Pieces) -> Column:
    """Ids of the best path, read back from the steps of best_steps; a character without a piece falls back to its bytes' pieces."""
    by_byte = F.expr(f"cast(split('{','.join(str(pieces.bytes.get(b, pieces.unknown)) for b in range(256))}', ',') as array<int>)")
    none = F.expr("cast(array() as array<int>)")

    def fallback(c: Column) -> Column:
        """Ids of the UTF-8 bytes of code point c, the last byte first."""
        if not pieces.bytes:
            return F.array(F.lit(pieces.unknown))
        tail = [F.shiftright(c, 6 * i).bitwiseAND(63) + 0x80 for i in range(3)]
        codes = (F.when(c < 0x80, F.array(c)).when(c < 0x800, F.array(tail[0], F.shiftright(c, 6) + 0xC0))
                 .when(c < 0x10000, F.array(*tail[:2], F.shiftright(c, 12) + 0xE0)).otherwise(F.array(*tail, F.shiftright(c, 18) + 0xF0)))
        return F.transform(codes, lambda b: F.get(by_byte, b))

    def part(acc: Column, j: Column) -> Column:
        here, base = F.get(steps, j), j * WINDOW

        def back(now: Column, p: Column) -> Column:
            t = F.get(here, p - base - 1)
            i = t.bitwiseAND((1 << ID_BITS) - 1)
            ids = F.when(i >= OTHER, F.concat(now["ids"], fallback(i - OTHER))).otherwise(F.array_append(now["ids"], i))
            return F.when(p == now["p"], F.struct((p - F.shiftright(t, ID_BITS)).alias("p"), ids.alias("ids"))).otherwise(now)

        return F.aggregate(F.sequence(acc["p"], base + 1, F.lit(-1)), F.struct(acc["p"].alias("p"), none.alias("ids")), back,
                           lambda now: F.struct(now["p"].alias("p"), F.array_append(acc["chunks"], now["ids"]).alias("chunks")))

    last = F.size(steps) - 1
    start = F.struct((last * WINDOW + F.size(F.get(steps, last))).alias("p"), F.expr("cast(array() as array<array<int>>)").alias("chunks"))
    return F.aggregate(F.sequence(last, F.lit(0), F.lit(-1)), start, part, lambda acc: F.reverse(F.flatten(acc["chunks"])))


def word_ids(words: DataFrame, pieces: Pieces) -> DataFrame:
    """places, ids (array of int): the Viterbi path of each row of words (key, group, word, places), by lattice and fold."""
    def of(some: DataFrame, short: bool) -> DataFrame:
        steps = unit_lattice(some, pieces, short).select("places", best_steps(F.col("parts")).alias("steps"))
        return steps.select("places", best_ids(F.col("steps"), pieces).alias("ids"))

    return of(words.where(F.length("key") <= SHORT), True).unionByName(of(words.where(F.length("key") > SHORT), False))


def frequent_units(docs: DataFrame, pieces: Pieces, text_col: str, limit: int, sample_rows: int, max_chars: int = 50_000) -> tuple[list[str], np.ndarray, np.ndarray]:
    """At most limit frequent units with the lengths of their ids and the ids, for a broadcast that spares work and changes no result.

    They come from about sample_rows texts of max_chars characters at most, and go through the lattice like all others.
    """
    spark = docs.sparkSession
    cuts = spark.sparkContext.broadcast(pieces.cuts)
    texts = docs.select(F.col(f"`{text_col}`").cast("string").alias("_t")).where(F.length("_t") <= max_chars)
    rows = texts.count()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 300):
                found = cuts.value.cut(b.column(0).slice(at, 300).to_pylist())[0].value_counts()
                yield pa.RecordBatch.from_arrays([found.field(0).cast(pa.string()), found.field(1)], ["word", "n"])

    counted = texts.sample(fraction=min(1.0, sample_rows / max(rows, 1)), seed=3).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = materialize(counted.orderBy(F.desc("n"), "word").limit(limit).coalesce(1).select(F.monotonically_increasing_id().alias("i"), "word"), "piece-frequent")
    words = top.select(unit_key(F.col("word")).alias("key"), F.lit(0).cast("long").alias("group"), "word", F.array(F.struct(F.lit(0).cast("long").alias("block"), F.col("i").cast("int").alias("number"))).alias("places"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = word_ids(words.repartition(n, "key", "group"), pieces).select(F.col("places")[0]["number"].alias("i"), "ids").toArrow().sort_by("i")
    ids = found.column("ids").combine_chunks()
    return top.toArrow().sort_by("i").column("word").to_pylist(), np.diff(ids.offsets.to_numpy()).astype(np.int64), ids.values.to_numpy().astype("<u4")


def number_units(docs: DataFrame, pieces: Pieces, known: list[str], id_col: str, text_col: str, block_chars: int) -> DataFrame:
    """Texts as numbers of units: block, names, counts (units of each text), crcs (crc32 of each text), numbers (packed), first, units.

    Known units have the first numbers. A block is a run of about block_chars characters of one partition and numbers its
    other units by first occurrence; a row holds a batch of its texts, and the units new in it, numbered from `first` on.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared, cuts = docs.sparkSession.sparkContext.broadcast(known), docs.sparkSession.sparkContext.broadcast(pieces.cuts)
    source = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_t"), F.spark_partition_id().alias("_part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = {w: i for i, w in enumerate(shared.value)}
        number: defaultdict[str, int] = defaultdict(None, start)
        number.default_factory = number.__len__
        block, have = 0, 0

        def some(names: list, texts: list[str], part: int, kind_: pa.DataType) -> pa.RecordBatch:
            units, counts = cuts.value.cut(texts)
            coded = units.dictionary_encode()
            first = len(number)
            words = coded.dictionary.to_pylist()
            to = np.fromiter(map(number.__getitem__, words), dtype=np.uint32, count=len(words))
            at = to[coded.indices.to_numpy()].view(np.uint8).reshape(-1, 4)
            packed = pa.compress(np.ascontiguousarray(at.T).tobytes(), "zstd", asbytes=True)
            crcs = [zlib.crc32(t.encode()) for t in texts]
            fresh = [w for w, i in zip(words, to.tolist(), strict=True) if i >= first]  # in the order of their numbers
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 24) + block], pa.int64()), pa.array([names], pa.list_(kind_)), pa.array([counts], pa.list_(pa.int64())), pa.array([crcs], pa.list_(pa.int64())),
                 pa.array([packed], pa.binary()), pa.array([first], pa.int32()), pa.array([fresh], pa.list_(pa.string()))],
                ["block", "names", "counts", "crcs", "numbers", "first", "units"])

        for b in batches:
            part, kind_ = b.column(2)[0].as_py() if b.num_rows else 0, b.schema.field(0).type
            names, texts, size = [], [], 0
            for name, value in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = value.as_py() or ""
                names.append(name)
                texts.append(text)
                size += len(text)
                if size >= BATCH_CHARS:
                    yield some(names, texts, part, kind_)
                    have, names, texts, size = have + size, [], [], 0
                if have >= block_chars:
                    number.clear()
                    number.update(start)
                    block, have = block + 1, 0
                    pa.default_memory_pool().release_unused()
            if names:
                yield some(names, texts, part, kind_)
                have += size

    return source.mapInArrow(giving_back(run), f"block long, names array<{kind}>, counts array<long>, crcs array<long>, numbers binary, first int, units array<string>")


def encode(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text", block_chars: int = 16_000_000,
           frequent: int = 100_000, sample_rows: int = 5_000, check: bool = False) -> DataFrame:
    """id_col, n_pieces (long), ids (binary: little-endian unsigned 32-bit), text_crc32 (long) for each row of docs.

    check adds round_trip (boolean): the ids are decoded again where they are made, as decode() does, and give the text.

    A text's pieces are those with the greatest sum of scores (ties: see best_steps), a dummy space in front, bytes for
    characters without a piece: the best path of the library's own unigram lattice. With a BPE model, for which the
    library merges pieces by rank, it is another segmentation into the same pieces, and decodes to the same text.
    Null and empty texts have no ids. Repeated rows and repeated or null ids are rows of their own; an empty table gives
    an empty one; other columns, whatever their names, are not read. Units of any length go through the lattice, each
    once for 1,024 partitions of docs; only a unit that no border splits is held by one row. Texts move as numbers of their
    block's units (see number_units), and meet the ids of these units there; `frequent` units are known beforehand.
    """
    pieces = loaded(model or default_model())
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    top, top_lengths, top_ids = frequent_units(docs, pieces, text_col, frequent, sample_rows)
    numbered = materialize_bucketed(number_units(docs, pieces, top, id_col, text_col, block_chars), "block", "piece-numbers")
    rare = numbered.agg(F.sum(F.size("units"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rare // TASK_UNITS))
    pairs = numbered.select("block", "first", F.posexplode("units").alias("p", "word")).select(
        unit_key(F.col("word")).alias("key"), F.shiftright("block", 34).alias("group"), F.when(F.length("word") > SHORT, F.col("word")).alias("long"),
        "block", (F.col("first") + F.col("p")).alias("number"))
    words = (pairs.repartition(n, "key", "group").groupBy("key", "group").agg(F.first("long").alias("long"), F.collect_list(F.struct("block", "number")).alias("places"))
             .withColumn("word", F.coalesce("long", "key")))
    known = word_ids(words, pieces).select("ids", F.explode("places").alias("place")).select(F.col("place.block").alias("to"), F.col("place.number").alias("number"), "ids")
    shared, back = spark.sparkContext.broadcast((top_lengths, top_ids)), spark.sparkContext.broadcast(pieces.back)
    names = [id_col, "n_pieces", "ids", "text_crc32", *["round_trip"] * check]

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        lengths, values = shared.value
        if right.num_rows:
            ids = right.column("ids").combine_chunks()
            ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
            offsets, number = ids.offsets.to_numpy(), right.column("number").to_numpy()
            size = int(number.max()) + 1
            begin, length = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
            begin[:len(lengths)], length[:len(lengths)] = np.cumsum(lengths) - lengths, lengths
            begin[number], length[number] = offsets[:-1] + len(values), np.diff(offsets)
            values = np.concatenate([values, ids.values.to_numpy().astype("<u4")])
        else:
            begin, length = np.cumsum(lengths) - lengths, lengths
        parts = []
        for row in left.select(["names", "counts", "crcs", "numbers"]).to_batches():
            for i in range(row.num_rows):
                counts = row.column(1)[i].values.to_numpy()
                n = int(counts.sum())
                at = np.frombuffer(pa.decompress(row.column(3)[i].as_buffer(), 4 * n, "zstd") if n else b"", dtype=np.uint8)
                at = np.ascontiguousarray(at.reshape(4, n).T).view("<u4").reshape(-1)
                each = length[at]
                ends = np.cumsum(each)
                total = int(ends[-1]) if n else 0
                ids = values[np.repeat(begin[at] - ends + each, each) + np.arange(total)] if n else values[:0]
                borders = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
                binary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(4 * borders), pa.py_buffer(ids)])
                columns = [row.column(0)[i].values, pa.array(np.diff(borders)), binary.cast(pa.binary()), row.column(2)[i].values]
                if check:
                    columns.append(pa.array([zlib.crc32(t.encode()) == c for t, c in zip(back.value.decode(ids, np.diff(borders)), columns[3].to_pylist(), strict=True)], pa.bool_()))
                parts.append(pa.table(columns, names))
        release()
        kinds = [left.schema.field("names").type.value_type, pa.int64(), pa.binary(), pa.int64(), pa.bool_()]
        return pa.concat_tables(parts) if parts else pa.table([pa.array([], k) for k in kinds[:len(names)]], names)

    rows = numbered.select("block", "names", "counts", "crcs", "numbers")
    return rows.groupBy("block").cogroup(known.groupBy("to")).applyInArrow(finish, f"`{id_col}` {kind}, n_pieces long, ids binary, text_crc32 long{', round_trip boolean' * check}")


def decode(encoded: DataFrame, model: str | None = None, ids_col: str = "ids") -> DataFrame:
    """encoded with text_ (string): the text of ids_col (binary as encode writes it); null ids give null, no ids an empty text.

    A column text_ that encoded has already is replaced; other columns pass through, whatever their names. Repeated rows stay.
    """
    back = encoded.sparkSession.sparkContext.broadcast(loaded(model or default_model()).back)
    encoded = encoded.select(*[F.col(f"`{c}`") for c in encoded.columns if c != "text_"])
    names = encoded.columns
    at = names.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 200):
                b = whole.slice(i, 200)
                found = [x.as_buffer() for x in b.column(at)]
                counts = np.array([0 if x is None else x.size // 4 for x in found], dtype=np.int64)
                texts = back.value.decode(np.frombuffer(b"".join([x for x in found if x is not None]), dtype="<u4"), counts)
                texts = [None if x is None else t for x, t in zip(found, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*names, "text_"])

    return encoded.mapInArrow(run, encoded.withColumn("text_", F.lit(None).cast("string")).schema)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents encoded and decoded: doc_id, n_pieces, ids_crc32 (of the ids' bytes), round_trip (they decode to the text; null counts as empty)."""
    return encode(table(spark, sf_dir, "documents"), check=True).select("doc_id", "n_pieces", F.crc32("ids").alias("ids_crc32"), "round_trip")
