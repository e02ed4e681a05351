"""Dictionaries of substrings of any size, found in the UTF-8 bytes of texts by a trie whose steps are eight bytes long."""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Callable
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType

from graintable.sources.files import materialize

#: Places in texts that are looked at together; hits that are held before their repeats go.
WINDOW, BLOCK = 65_536, 4_194_304
#: Bytes of a step, and bytes of terms and their values in a part, about.
STEP, PART_BYTES = 8, 67_108_864
#: Odd numbers that spread nodes and words over 64 bits.
SPREAD, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def grams(text: Column, size: int) -> Column:
    """The different runs of `size` characters of a text, in one pass over it that steps by whole characters."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))."), F.lit(1)))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (null: none) with two steps of zeros behind them, and the places where texts begin and the last one ends."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    _, places, held = texts.buffers()
    offsets = np.frombuffer(places, dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, dtype=np.int64)
    data = np.zeros(offsets[-1] - offsets[0] + 2 * STEP, dtype=np.uint8)
    if offsets[-1] > offsets[0]:
        data[:-2 * STEP] = np.frombuffer(held, dtype=np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def step_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a number whose low byte is the first."""
    out = np.zeros(len(at), dtype=np.uint64)
    for i in range(STEP):
        out |= data[at + i].astype(np.uint64) << np.uint64(8 * i)
    return out


@cache
def word_points() -> np.ndarray:
    """For each code point whether it is a letter, a digit or the underscore."""
    points = np.fromiter((unicodedata.category(chr(c))[0] in "LN" for c in range(0x110000)), dtype=bool, count=0x110000)
    points[ord("_")] = True
    return points


def in_words(data: np.ndarray) -> np.ndarray:
    """For each byte whether its character is a letter, a digit or the underscore."""
    points = word_points()
    out = np.where(np.arange(256) < 128, points[:256], False)[data]
    for a in range(0, len(data) - STEP, WINDOW):
        lead = a + np.flatnonzero(data[a:min(a + WINDOW, len(data) - STEP)] >= 0xC0)
        first = data[lead].astype(np.int64)
        size = 2 + (first >= 0xE0) + (first >= 0xF0)
        point = first & (0x7F >> size)
        for i in range(1, 4):
            point = np.where(size > i, point << 6 | data[lead + i] & 0x3F, point)
        inside = points[np.minimum(point, 0x10FFFF)]
        for i in range(4):
            out[lead[size > i] + i] = inside[size > i]
    return out


def different(codes: np.ndarray) -> np.ndarray:
    """The different numbers, ascending; codes is sorted in place (faster here than np.unique, which hashes)."""
    codes.sort()
    new = np.ones(len(codes), dtype=bool)
    np.not_equal(codes[1:], codes[:-1], out=new[1:])
    return codes[new]


class Edges:
    """Different pairs of a node and a word of bytes, each with a value, in slots by a hash."""

    def __init__(self, node: np.ndarray, word: np.ndarray, value: np.ndarray):
        bits = max(8, min(len(node).bit_length() + 3, 20), len(node).bit_length())  # wide slots while they fit a core's cache
        self.shift = np.uint64(64 - bits)
        slot = self.slots(node, word)
        order = np.argsort(slot, kind="stable")
        self.node, self.word, self.value = node[order], word[order], value[order]
        self.start = np.searchsorted(slot[order], np.arange((1 << bits) + 1)).astype(np.int32)
        self.used = np.diff(self.start) > 0

    def slots(self, node: np.ndarray, word: np.ndarray) -> np.ndarray:
        slot = word ^ node
        slot *= MIX
        slot >>= self.shift
        return slot.view(np.int64)

    def find(self, node: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the pairs that are known, and their values; node may be one for all words."""
        slot = self.slots(node, word)
        at = np.flatnonzero(self.used[slot])
        slot, word, node = slot[at], word[at], np.broadcast_to(node, word.shape)[at]
        i, end = self.start[slot], self.start[slot + 1]
        places, values = [], []
        while len(at):
            same = (self.word[i] == word) & (self.node[i] == node)
            places.append(at[same])
            values.append(self.value[i[same]])
            more = np.flatnonzero(~same & (i + 1 < end))
            at, word, node, i, end = at[more], word[more], node[more], i[more] + 1, end[more]
        return np.concatenate([at, *places]), np.concatenate([self.value[:0], *values])


class Trie:
    """Terms by steps of eight bytes: what is left of a term at its last step has one to eight bytes, and edges of its own by that length.

    The work for a place hangs on how far terms go along with the text there, not on how many terms there are.
    """

    def __init__(self, terms: pa.Array):
        data, offsets = flat(terms)
        self.size, self.window, self.block = np.diff(offsets), WINDOW, BLOCK
        alive, node, nodes = np.arange(len(terms)), np.zeros(len(terms), dtype=np.uint64), 1
        lasts, inner = {}, []
        depth = 0
        while len(alive):
            word, left = step_at(data, offsets[alive] + depth), self.size[alive] - depth
            for n in range(1, STEP + 1):
                some = left == n
                lasts.setdefault((depth > 0, n), []).append((node[some], word[some] & self.mask(n), alive[some]))
            some = left > STEP
            alive, node, word = alive[some], node[some], word[some]
            order = np.lexsort((word, node))
            new = np.concatenate([[True], (np.diff(node[order]) != 0) | (np.diff(word[order]) != 0)])[:len(order)]
            goes = np.zeros(len(order), dtype=np.uint64)
            goes[order] = (nodes + np.cumsum(new) - 1).astype(np.uint64) * SPREAD
            inner.append((node[order][new], word[order][new], goes[order][new]))
            node, nodes, depth = goes, nodes + int(new.sum()), depth + STEP
        put = lambda edges: Edges(*[np.concatenate(x) for x in zip(*edges, strict=True)]) if sum(len(x[0]) for x in edges) else None
        #: By whether a step has others before it, and by how many bytes of the term are left.
        self.lasts = {k: put(edges) for k, edges in lasts.items()}
        self.inner = put(inner)

    @staticmethod
    def mask(n: int) -> np.uint64:
        return np.uint64((1 << 8 * n) - 1)

    def hits(self, texts: pa.Array, whole_word: bool) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of texts, and numbers of the different terms in each, both ascending."""
        data, offsets = flat(texts)
        n, ends = int(offsets[-1]), offsets[1:]
        if whole_word:
            inside = in_words(data)
            may_begin = ~np.concatenate([[False], inside[:n]])
            may_begin[offsets] = True
        codes, held, limit = [np.zeros(0, dtype=np.int64)], 0, self.block
        for a in range(0, n, self.window):
            size = min(self.window, n - a)
            at, word = np.arange(a, a + size), np.ndarray(size, "<u8", data, a, (1,)).copy()
            if whole_word:
                some = np.flatnonzero(may_begin[a:a + size])
                at, word = at[some], word[some]
            at, term = self.walk(data, n, at, word)
            row, end = np.searchsorted(ends, at, side="right"), at + self.size[term]
            fits = end <= ends[row]
            if whole_word:
                fits &= (end == ends[row]) | ~inside[np.minimum(end, n)]
            codes.append(different(row[fits] * len(self.size) + term[fits]))
            held += len(codes[-1])
            if held > limit:
                codes = [different(np.concatenate(codes))]
                held, limit = len(codes[0]), len(codes[0]) + self.block
        return np.divmod(different(np.concatenate(codes)), len(self.size))

    def walk(self, data: np.ndarray, n: int, at: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and the terms whose bytes follow there, be it beyond a text's end; word: the first eight bytes from each place on."""
        places, terms, node, depth = [], [], np.zeros((), dtype=np.uint64), 0
        while len(at):
            for (later, left), edges in self.lasts.items():
                if edges is None or later != (depth > 0):
                    continue
                i, term = edges.find(node, word & self.mask(left))
                places.append(at[i])
                terms.append(term)
            if self.inner is None:
                break
            i, node = self.inner.find(node, word)
            depth += STEP
            some = at[i] + depth < n
            at, node = at[i][some], node[some]
            word = step_at(data, at + depth)
        return np.concatenate(places or [at]), np.concatenate(terms or [at])


def finders(given: DataFrame, kind: DataType, whole_word: bool, first: bool = False, part_rows: int = 1_000_000) -> list[Callable[[Column], Column]]:
    """Column functions of a text in lower case, one for each part of given(term, value), which has a term once: its terms' values, an array each, in one array; first: the least value, null if there is none.

    Parts have about part_rows terms and PART_BYTES bytes at most; each goes through the driver to the tasks as a trie, and texts stay where they are.
    """
    spark = given.sparkSession
    known = materialize(given.where("term <> ''"), "terms")
    size = F.octet_length("term") + F.coalesce(F.octet_length(F.col("value").cast("string")), F.lit(0))
    sums = known.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    parts = max(math.ceil(sums["n"] / part_rows), math.ceil(sums["bytes"] / PART_BYTES))

    def finder(part: DataFrame) -> Callable[[Column], Column]:
        rows = (part.orderBy("value") if first else part).toArrow()
        shared = spark.sparkContext.broadcast((Trie(rows["term"].combine_chunks()), rows["value"].combine_chunks())) if len(rows) else None

        @F.arrow_udf(kind)
        def run(texts: pa.Array) -> pa.Array:
            trie, values = shared.value
            row, term = trie.hits(texts, whole_word)
            if first:
                place = np.searchsorted(row, np.arange(len(texts) + 1))
                none = place[:-1] == place[1:]
                return values.take(pa.array(np.append(term, 0)[np.minimum(place[:-1], len(term))], mask=none))
            each = values.take(pa.array(term))
            sizes = np.concatenate([[0], np.cumsum(each.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)])
            return pa.ListArray.from_arrays(pa.array(sizes[np.searchsorted(row, np.arange(len(texts) + 1))], pa.int32()), each.flatten())

        return run if shared else lambda text: F.lit(None).cast(kind)

    # a hash deals terms evenly
    return [finder(known if parts == 1 else known.where(F.pmod(F.xxhash64("term"), F.lit(parts)) == i)) for i in range(parts)]


def by_id(df: DataFrame, id_col: str, parts: int, wanted: Column) -> tuple[DataFrame | None, DataFrame | None]:
    """The rows of df whose id has one wanted row at most, and the others, whose hits have to be put together; with several parts of a dictionary, all are others."""
    if parts > 1:
        return None, df
    several = materialize(df.where(wanted & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1").select(id_col), "repeated-ids")
    if several.isEmpty():
        return df, None
    return df.join(several, id_col, "left_anti").select(*df.columns), df.join(several, id_col, "left_semi").select(*df.columns)


def dictionary_hits(df: DataFrame, id_col: str, text_col: str, terms: DataFrame, whole_word: bool = False, part_rows: int = 1_000_000) -> DataFrame:
    """id_col, term: the different terms(term) that stand in a text, both in lower case; whole_word: with no letter, digit or underscore beside them.

    Terms go to the tasks as a trie, in parts of part_rows at most, one part in a pass over the texts; the work for a text doesn't grow with a part's terms,
    and no text is shuffled. Null and empty terms and texts have no hits; an id stands for all its rows' texts.
    """
    known = terms.select(F.lower("term").alias("term")).distinct().withColumn("value", F.array("term"))
    found = finders(known, ArrayType(known.schema["term"].dataType), whole_word, part_rows=part_rows)
    empty = df.sparkSession.createDataFrame([], df.select(id_col, F.lit("").alias("term")).schema)
    return reduce(DataFrame.unionByName, [df.select(id_col, F.explode(part(F.lower(text_col))).alias("term")) for part in found], empty).distinct()


def first_label(df: DataFrame, id_col: str, text_col: str, terms: DataFrame, column: str, whole_word: bool = False, part_rows: int = 1_000_000) -> DataFrame:
    """df with column filled where it is null: the label of the terms(term, label, priority) in the row's text with the least priority (ties: the least label); an id stands for all its rows without a label.

    Where such an id has one row, its label is found beside it and no row moves.
    """
    known = terms.select(F.lower("term").alias("term"), F.struct("priority", "label").alias("value")).groupBy("term").agg(F.min("value").alias("value"))
    found = finders(known, known.schema["value"].dataType, whole_word, True, part_rows)
    wanted = F.col(column).isNull()
    text = F.when(wanted & F.col(id_col).isNotNull(), F.lower(text_col))
    if not found:
        return df
    alone, others = by_id(df, id_col, len(found), wanted)
    out = []
    if alone is not None:
        out.append(alone.withColumn("_x", found[0](text)).withColumn(column, F.coalesce(column, "_x.label")).select(*df.columns))
    if others is not None:
        each = [others.select(id_col, part(text).alias("_x")).where("_x is not null") for part in found]
        best = reduce(DataFrame.unionByName, each).groupBy(id_col).agg(F.min("_x").alias("_x"))
        out.append(others.join(best, id_col, "left").withColumn(column, F.coalesce(column, "_x.label")).select(*df.columns))
    return reduce(DataFrame.unionByName, out)


def all_labels(df: DataFrame, id_col: str, text_col: str, terms: DataFrame, out: str = "tags", whole_word: bool = False, part_rows: int = 1_000_000) -> DataFrame:
    """df with out: the sorted different labels of the terms(term, label) in the texts of the row's id, an empty array for none.

    Where an id has one row, its labels are found beside it and no row moves.
    """
    known = terms.select(F.lower("term").alias("term"), "label").groupBy("term").agg(F.collect_set("label").alias("value"))
    kind = known.schema["value"].dataType
    found = finders(known, kind, whole_word, part_rows=part_rows)
    none = F.array().cast(kind)
    if not found:
        return df.withColumn(out, none)
    text = F.when(F.col(id_col).isNotNull(), F.lower(text_col))
    alone, others = by_id(df, id_col, len(found), F.lit(True))
    made = []
    if alone is not None:
        made.append(alone.withColumn(out, F.sort_array(F.array_distinct(found[0](text)))))
    if others is not None:
        each = [others.select(id_col, F.explode(part(text)).alias("_label")) for part in found]
        tags = reduce(DataFrame.unionByName, each).groupBy(id_col).agg(F.sort_array(F.collect_set("_label")).alias("_tags"))
        made.append(others.join(tags, id_col, "left").withColumn(out, F.coalesce("_tags", none)).drop("_tags").select(*df.withColumn(out, none).columns))
    return reduce(DataFrame.unionByName, made)
