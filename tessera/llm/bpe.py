"""Byte-level BPE encoding and decoding: distinct words are folded by Spark's higher-order functions.

A word (one match of the split pattern) is an array of its bytes, each known by the rank of its piece. The fold
merges the leftmost pair of lowest rank until no pair has a rank; the rank of a pair is the piece it becomes. The rank
map is a constant: a hash table without collisions (groups of keys are shifted until each key has a slot), which enters
queries as a scalar subquery that execution turns into a literal; written into the plan, it would fill the driver's
memory with plan descriptions. Words of over ``LONG`` bytes are texts of pieces instead, one character a piece, and a
round merges all pairs of lowest rank at once, so their cost does not grow with the square of their length.

The words of the corpus are counted, the ``hot`` most frequent ones (a documented bound) are folded once and sent to
all tasks; tasks split texts, look words up, and leave gaps for other words, which are folded once for each text they
stand in (a word that is not frequent stands in few). Nothing but the word counts is shuffled. Decoding concatenates the
binary pieces of the ids. Python's part goes by arrays: characters are classed by a table, classes tell where words
begin, and words are counted and looked up as Arrow arrays, by all their bytes.

Defined results: a null or empty text has no ids; its hash is that of the empty string. Repeated rows are
encoded each. A word of any length is folded exactly. Other columns of the input are ignored.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from tessera.llm.common import in_order, materialize, plus, read, small_batches, trim

#: Words folded once and sent to all tasks, their bytes in all, and the length of each in characters.
HOT, HOT_BYTES, HOT_CHARS = 1 << 20, 1 << 25, 48
#: Bytes of the longest word that is folded pair by pair.
LONG = 256
#: Different words a task holds before it hands its counts on.
HELD = 1 << 19
#: Bytes of texts, or of ids, that a task works on at a time.
BATCH_BYTES = 1 << 22
#: The split pattern that arrays stand for, and the classes of characters it tells apart.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LETTER, NUMBER, BLANK = 1, 2, 3
#: Unicode's White_Space, which \\s means in the split pattern.
SPACE = r"\t-\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
#: Rank of pairs that make no piece, and the bits of a state's parts: place and piece.
_NONE, _PLACE, _PIECE = (1 << 21) - 1, 22, 20
#: First characters that stand for pieces, below and above those that cannot.
_CHAR, _SKIP = 0x100, 0xD800


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(k): int(v) for k, v in (line.split() for line in f if line.strip())}


def _value(spark: SparkSession, **columns: tuple[list, pa.DataType]) -> Column:
    """Lists as a constant, a struct of arrays: a one-row scalar subquery, evaluated once for a query and short in plans."""
    table = pa.table({k: pa.array([v], pa.list_(t)) for k, (v, t) in columns.items()})
    return materialize(spark.createDataFrame(table).select(F.struct(*columns).alias("v")), "bpe-constant").scalar()


def _let(value: Column, f) -> Column:
    return F.get(F.transform(F.array(value), f), F.lit(0))


def displaced(keys: list[int]) -> tuple[list[int], list[int], int]:
    """A hash table without collisions: (shifts, slots, unused key). The slot of a key is
    (key + shifts[key % len(shifts)]) % len(slots); slots hold the place of the key in ``keys``, or -1."""
    m = max(1, len(keys) // 3) | 1
    groups: list[list[int]] = [[] for _ in range(m)]
    for i, k in enumerate(keys):
        groups[k % m].append(i)
    size = 2 * len(keys) + 1
    while any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        size += 1
    slots, shifts, free = [-1] * size, [0] * m, 0
    for g in sorted(range(m), key=lambda g: (-len(groups[g]), g)):
        at = [keys[i] % size for i in groups[g]]
        if len(set(at)) < len(at):
            raise ValueError("keys meet in every slot")
        shift = free if len(at) > 1 else (free - at[0] if at else 0)
        while any(slots[(x + shift) % size] >= 0 for x in at):
            shift += 1
        for x, i in zip(at, groups[g], strict=True):
            slots[(x + shift) % size] = i
        shifts[g] = shift % size
        while free < size - 1 and slots[free] >= 0:
            free += 1
    return shifts, slots, size


class Ranks:
    """The rank map: ``pairs``, from two ranks to that of what they make together, as a constant; ``single``, from a byte to
    its rank; ``words``, pieces that are texts, with their id."""

    def __init__(self, spark: SparkSession, ranks: dict[bytes, int]):
        self.size, self.bits = len(ranks), len(ranks).bit_length()
        if self.size >= 1 << _PIECE:
            raise ValueError("too many ranks")
        made: dict[int, int] = {}
        for piece, rank in ranks.items():
            for cut in range(1, len(piece)):
                if (left := ranks.get(piece[:cut])) is not None and (right := ranks.get(piece[cut:])) is not None:
                    made[left * self.size + right] = rank
        keys = list(made)
        shifts, slots, self.slots = displaced(keys)
        self.groups = len(shifts)
        entries = [keys[i] << self.bits | made[keys[i]] if i >= 0 else -1 for i in slots]
        chars = [chr(_CHAR + i if _CHAR + i < _SKIP else _CHAR + 0x800 + i) for i in range(self.size)]
        self.pairs = _value(spark, d=(shifts, pa.int32()), e=(entries, pa.int64()), c=(chars, pa.string()))
        self.single = [ranks[bytes([i])] for i in range(256)]
        self.words = {}
        for piece, rank in ranks.items():
            try:
                self.words[piece.decode()] = str(rank)
            except UnicodeDecodeError:
                pass

    def pair(self, table: Column, left: Column, right: Column) -> Column:
        """The rank of what two pieces make, or "no rank"."""
        key = left * F.lit(self.size).cast("bigint") + right
        entry = F.get(table["e"], ((key + F.get(table["d"], (key % self.groups).cast("int"))) % self.slots).cast("int"))
        return F.when(F.shiftright(entry, self.bits) == key, entry.bitwiseAND((1 << self.bits) - 1)).otherwise(F.lit(_NONE).cast("bigint"))


def _pieces(word: Column, ranks: Ranks) -> Column:
    single = F.array(*(F.lit(x).cast("bigint") for x in ranks.single))
    # as Latin-1 every byte is a character
    return F.transform(F.split(F.decode(word.cast("binary"), "ISO-8859-1"), ""), lambda c: F.get(single, F.ascii(c)))


def _by_pairs(word: Column, ranks: Ranks, table: Column) -> Column:
    """The ids of a word, one merge a step. An element of the state holds, from high to low bits, the rank of the pair that
    starts there, its place in the word and its piece, so the least element is the leftmost pair of lowest rank."""
    low, mask = _PLACE + _PIECE, (1 << _PIECE) - 1
    piece = lambda x: x.bitwiseAND(F.lit(mask).cast("bigint"))
    entry = lambda rank, place, p: F.shiftleft(rank, low).bitwiseOR(place).bitwiseOR(p)

    def start(p: Column) -> Column:
        q = F.transform(p, lambda x, i: entry(ranks.pair(table, x, F.get(p, i + 1)), F.shiftleft(i.cast("bigint"), _PIECE), x))
        return _let(q, lambda q: F.struct(q.alias("q"), F.array_min(q).alias("m")))

    def step(s: Column) -> Column:
        q, m = s["q"], s["m"]

        def at(i: Column) -> Column:
            new = F.shiftright(m, low)
            left = F.get(q, i - 2)
            place = lambda x: x.bitwiseAND(F.lit(((1 << _PLACE) - 1) << _PIECE))
            beside = entry(ranks.pair(table, piece(left), new), place(left), piece(left))
            here = entry(ranks.pair(table, new, piece(F.get(q, i + 1))), place(m), new)
            some = F.when(i > 1, F.array(beside, here)).otherwise(F.array(here))
            parts = F.concat(F.slice(q, F.lit(1), F.greatest(i - 2, F.lit(0))), some, F.slice(q, i + 2, F.size(q)))
            return _let(parts, lambda q: F.struct(q.alias("q"), F.array_min(q).alias("m")))

        return _let(F.array_position(q, m).cast("int"), at)

    def merged(p: Column) -> Column:
        steps = F.sequence(F.lit(2), F.greatest(F.size(p), F.lit(2)))
        s = F.aggregate(steps, start(p), lambda s, _: F.when(s["m"] >= F.lit(_NONE << low), s).otherwise(step(s)))
        return F.array_join(F.transform(s["q"], lambda x: piece(x).cast("string")), ",")

    return _let(_pieces(word, ranks), merged)


def _by_rounds(word: Column, ranks: Ranks, table: Column) -> Column:
    """The ids of a long word: pieces are characters, and a round replaces every pair of the lowest rank, from the left. Only
    the leftmost is merged if other pairs share that rank, which might overlap, or if what a merge makes could have a
    lower rank with a neighbour and would come first."""
    char = lambda x: F.get(table["c"], x.cast("int"))
    rank = lambda c: _let(F.ascii(c), lambda x: F.when(x < _SKIP, x - _CHAR).otherwise(x - _CHAR - 0x800).cast("bigint"))

    def look(t: Column) -> Column:
        def pairs(p: Column) -> Column:
            r = F.transform(p, lambda x, i: ranks.pair(table, x, F.get(p, i + 1)))
            return _let(r, lambda r: F.struct(p.alias("p"), r.alias("r"), F.array_min(r).alias("m")))

        return _let(F.transform(F.split(t, ""), rank), pairs)

    def step(t: Column, s: Column) -> Column:
        p, r, m = s["p"], s["r"], s["m"]

        def at(i: Column) -> Column:
            a, b = F.get(p, i - 1), F.get(p, i)
            other = lambda x, j: (x != a) | (ranks.pair(table, F.get(p, j - 1), m) < m) | (ranks.pair(table, m, F.get(p, j + 2)) < m)
            first = F.exists(F.transform(p, lambda x, j: (F.get(r, j) == m) & other(x, j)), lambda x: x) | (ranks.pair(table, m, m) < m)
            one = F.concat(F.substr(t, F.lit(1), i - 1), char(m), F.substr(t, i + 2))
            return F.when(first, one).otherwise(F.replace(t, F.concat(char(a), char(b)), char(m)))

        return _let(F.array_position(r, m).cast("int"), at)

    def again(s: Column) -> Column:
        done = s["m"] >= F.lit(_NONE)
        return F.when(done, s).otherwise(_let(look(s["t"]), lambda x: F.struct(F.when(x["m"] >= F.lit(_NONE), s["t"]).otherwise(step(s["t"], x)).alias("t"), x["m"].alias("m"))))

    def merged(p: Column) -> Column:
        start = F.struct(F.array_join(F.transform(p, char), "").alias("t"), F.lit(-1).cast("bigint").alias("m"))
        s = F.aggregate(F.sequence(F.lit(1), F.size(p)), start, lambda s, _: again(s))
        return F.array_join(F.transform(F.split(s["t"], ""), lambda c: rank(c).cast("string")), ",")

    return _let(_pieces(word, ranks), merged)


def fold(word: Column, ranks: Ranks, table: Column) -> Column:
    """The ids of a word, joined by commas."""
    return F.when(F.octet_length(word) <= LONG, _by_pairs(word, ranks, table)).otherwise(_by_rounds(word, ranks, table))


def char_classes() -> np.ndarray:
    """LETTER, NUMBER, BLANK (Unicode's White_Space) or 0 for every code point."""
    import regex

    chars = np.arange(0x110000, dtype="<u4")
    chars = chars[(chars < 0xD800) | (chars >= 0xE000)].tobytes().decode("utf-32-le")
    out = np.zeros(0x110000, np.uint8)
    for kind, those in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, f"[{SPACE}]+")):
        for m in regex.finditer(those, chars):
            out[ord(chars[m.start()]) : ord(chars[m.end() - 1]) + 1] = kind
    return out


def _edges(raw: np.ndarray, ends: np.ndarray, classes: np.ndarray):
    """Where the matches of ``SPLIT`` begin in ``raw``, the UTF-8 of texts that lie between ``ends``, and its size; and how
    many begin before each of ``ends``. A match is a run of one class, with the blank before it; white space before more
    text leaves its last character to what follows; an apostrophe that would be a match takes certain letters with it."""
    c = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), "<u4")
    n, place = len(c), None
    if n < len(raw):
        place = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
        ends = np.searchsorted(place, ends)
    kind = classes.take(c)
    edge = np.zeros(n + 1, bool)  # of texts
    edge[ends] = True
    first = edge.copy()
    first[1:n] |= kind[1:] != kind[:-1]
    gap = np.flatnonzero((kind == BLANK) & first[1:])
    gap = gap[~edge[gap + 1]]
    first[gap] = True
    first[gap[c[gap] == 0x20] + 1] = False
    mark = np.flatnonzero((c == 0x27) & first[:n])
    mark = mark[~edge[mark + 1]]
    mark = mark[kind[mark + 1] == LETTER]
    x, y = c[mark + 1], np.where(edge[mark + 2], 0, c.take(mark + 2, mode="clip"))
    one = (x == ord("s")) | (x == ord("t")) | (x == ord("m")) | (x == ord("d"))
    two = ((x == ord("r")) | (x == ord("v"))) & (y == ord("e")) | (x == ord("l")) & (y == ord("l"))
    first[mark[one | two] + 1] = False
    first[mark[one] + 2] = True
    first[mark[two] + 3] = True
    at = np.flatnonzero(first)
    return at if place is None else place[at], np.searchsorted(at, ends)


def _words(texts: pa.Array, pattern: str, classes: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of texts (null: none) as one array, and how many come before each text and in all."""
    if pattern != SPLIT:
        import regex

        find = regex.compile(pattern).findall
        found = [find(t) if t else [] for t in texts.to_pylist()]
        return pa.array([w for f in found for w in f], pa.string()), np.cumsum([0, *map(len, found)])
    texts = pc.fill_null(texts.cast(pa.string()), "")
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if ends[0] == ends[-1]:
        return pa.array([], pa.string()), np.zeros(len(ends), np.int64)
    data = texts.buffers()[2].slice(int(ends[0]), int(ends[-1] - ends[0]))
    at, n = _edges(np.frombuffer(data, np.uint8), ends - ends[0], classes)
    return pa.Array.from_buffers(pa.string(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), data]), n


def _some(batches, column: str):
    """Batches cut into rows with about ``BATCH_BYTES`` of a column, or with one text longer than that; and that column."""
    for b in batches:
        if not len(b):
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // BATCH_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), len(b)]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            part = b.slice(i, j - i)
            yield part, part.column(column)


def _lists(ends: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)


class Codec:
    """Encoding and decoding by one rank file. ``pattern`` is a regular expression whose \\s is Unicode's; texts are split by
    arrays if it is ``SPLIT``, match by match if it is another."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        ranks = load_ranks(path)
        if sorted(ranks.values()) != list(range(len(ranks))):
            raise ValueError("ranks must be 0..n-1")
        self.pattern = pattern
        if pattern != SPLIT:
            self.pattern = pattern.replace(r"[^\s", "[^" + SPACE).replace(r"\s", "[" + SPACE + "]").replace(r"\S", "[^" + SPACE + "]")
        self.ranks = Ranks(spark, ranks)
        self.pieces = spark.sparkContext.broadcast(pa.array(sorted(ranks, key=ranks.get), pa.binary()))
        self.classes = spark.sparkContext.broadcast(char_classes())
        #: Words with their ids; pieces that are words need no fold.
        self.known = spark.sparkContext.broadcast((pa.array(list(self.ranks.words), pa.string()), pa.array(list(self.ranks.words.values()), pa.string())))

    def learn_hot(self, docs: DataFrame, text_col: str = "text", hot: int = HOT) -> Codec:
        """Count the words of the corpus and fold the most frequent ones once."""
        pattern, known, classes = self.pattern, self.known, self.classes
        small_batches(docs.sparkSession)

        def count(batches):
            held, rows = [], 0

            def summed():
                return pa.concat_tables(held).group_by("w", use_threads=False).aggregate([("n", "sum")]).rename_columns(["w", "n"])

            for _, texts in _some(batches, "text"):
                n = pc.value_counts(_words(texts, pattern, classes.value)[0])
                n = pa.table({"w": n.field("values"), "n": n.field("counts")})
                n = n.filter(pc.and_(pc.less_equal(pc.utf8_length(n["w"]), HOT_CHARS), pc.invert(pc.is_in(n["w"], known.value[0]))))
                held.append(n)
                rows += len(n)
                if rows > 2 * HELD:
                    held = [summed()]
                    if (rows := len(held[0])) > HELD:
                        yield from held[0].to_batches(1 << 16)
                        held, rows = [], 0
            if held:
                yield from summed().to_batches(1 << 16)
            held = []
            trim()

        w = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "w string, n long")
        w = w.groupBy("w").agg(F.sum("n").alias("n")).where("n > 1")
        # frequency classes, 16 to each doubling, so a cut at a number of words needs no sort and no large result
        w = materialize(w.withColumn("c", F.floor(16 * F.log2("n")).cast("int")), "bpe-words")
        left, room, cut = hot, HOT_BYTES, 0
        for c, n, size in sorted(w.groupBy("c").agg(F.count("*"), F.sum(F.octet_length("w"))).collect(), reverse=True):
            left, room = left - n, room - size
            if min(left, room) < 0:
                cut = c + 1
                break
        chosen = materialize(self.fold_words(w.where(F.col("c") >= cut).repartition(w.sparkSession.sparkContext.defaultParallelism).select("w")), "bpe-folded")
        # at most ``hot`` words of at most HOT_CHARS characters
        found = chosen.toArrow().combine_chunks()
        words, ids = (pa.chunked_array([own, *found.column(c).chunks]).combine_chunks() for c, own in zip(("w", "ids"), known.value, strict=True))
        self.known = docs.sparkSession.sparkContext.broadcast((words, ids))
        return self

    def _folded(self, df: DataFrame, name: str, expr) -> DataFrame:
        """``df`` with a column made with the table of pairs. Subqueries may not stand in higher-order functions, so it is
        a column first, and the optimizer moves it to its place without copying rows."""
        return df.withColumn("__pairs", self.ranks.pairs).withColumn(name, _let(F.col("__pairs"), expr)).drop("__pairs")

    def fold_words(self, df: DataFrame, word_col: str = "w", name: str = "ids") -> DataFrame:
        return self._folded(df, name, lambda p: fold(F.col(word_col), self.ranks, p))

    def encode(self, docs: DataFrame, text_col: str = "text", name: str = "ids", keep_text: bool = True) -> DataFrame:
        """``docs`` with the ids of a text, joined by commas, and without the text if it is not to be kept."""
        pattern, known, classes = self.pattern, self.known, self.classes
        kept = [c for c in docs.columns if keep_text or c != text_col]
        schema = docs.select(*(f"`{c}`" for c in kept)).schema
        for own, kind in (("__ids", "string"), ("__rare", ArrayType(StringType())), ("__at", ArrayType(IntegerType()))):
            schema = plus(schema, own, kind)
        small_batches(docs.sparkSession)

        def run(batches):
            for b, texts in _some(batches, text_col):
                words, ends = _words(texts, pattern, classes.value)
                words = words.dictionary_encode()
                codes = words.indices.to_numpy()
                found = pc.index_in(words.dictionary, known.value[0])
                ids = pc.fill_null(known.value[1].take(found), "?")
                joined = pc.binary_join(_lists(ends, ids.take(words.indices)), ",")
                # the different unknown words of each text, and which of them fills each gap
                gaps = np.flatnonzero(found.is_null().to_numpy(zero_copy_only=False).take(codes)) if found.null_count else np.zeros(0, np.int64)
                text = np.searchsorted(ends, gaps, "right") - 1
                rare, which = np.unique(text << 32 | codes[gaps], return_inverse=True)
                rows = np.arange(len(b) + 1)
                starts = np.searchsorted(rare >> 32, rows)
                at = _lists(np.searchsorted(text, rows), pa.array((which - starts[text]).astype(np.int32)))
                more = [joined, _lists(starts, words.dictionary.take(pa.array(rare & 0xFFFFFFFF))), at]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *more], [*kept, "__ids", "__rare", "__at"])
            trim()

        split = docs.mapInArrow(run, schema)

        def filled(p: Column) -> Column:
            made = F.transform("__rare", lambda w: fold(w, self.ranks, p))
            fills = _let(made, lambda m: F.concat(F.transform("__at", lambda i: F.get(m, i)), F.array(F.lit(""))))
            whole = F.array_join(F.zip_with(F.split("__ids", "\\?"), fills, lambda a, b: F.concat(a, b)), "")
            return F.when(F.size("__at") == 0, F.col("__ids")).otherwise(whole)

        return self._folded(split, name, filled).drop("__ids", "__rare", "__at")

    def decode(self, df: DataFrame, ids_col: str = "ids", name: str = "decoded", count: str = "n_tokens") -> DataFrame:
        """``df`` with the number of ids, which are joined by commas, and their bytes."""
        pieces = self.pieces

        def run(batches):
            for b, ids in _some(batches, ids_col):
                parts, void = pc.split_pattern(ids, ","), pc.equal(ids, "")
                n = pc.subtract(pc.list_value_length(parts).cast(pa.int64()), void.cast(pa.int64()))
                parts = pc.list_flatten(parts)
                if pc.any(void).as_py():
                    parts = parts.filter(pc.not_equal(parts, ""))
                made = pieces.value.take(parts.cast(pa.int32()))
                ends = np.frombuffer(made.buffers()[1], np.int32)[np.concatenate(([0], np.cumsum(n.to_numpy())))] if len(made) else np.zeros(len(b) + 1, np.int32)
                whole = pa.Array.from_buffers(pa.binary(), len(b), [None, pa.py_buffer(ends), made.buffers()[2] or pa.py_buffer(b"")])
                yield pa.RecordBatch.from_arrays([*b.columns, n, whole], [*b.schema.names, count, name])
            trim()

        return df.mapInArrow(run, plus(plus(df.schema, count, "long"), name, "binary"))


def default_codec(spark: SparkSession) -> Codec:
    import public_tokenizers

    return Codec(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def encode_documents(docs: DataFrame, codec: Codec | None = None, keep_text: bool = True) -> DataFrame:
    """All columns of ``docs`` but an earlier n_tokens, ids or decoded; n_tokens, ids (joined by commas) and decoded bytes."""
    codec = codec or default_codec(docs.sparkSession).learn_hot(docs)
    return codec.decode(codec.encode(docs.drop("n_tokens", "ids", "decoded"), keep_text=keep_text))


def _digests():
    return "n_tokens", F.sha2(F.col("ids").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False).select("doc_id", *_digests())


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: position (from 0, the order of the files and of rows in them, which is the order of
    training), doc_id, source, text, ids joined by commas, and the round trip of every row as digests."""
    placed = materialize(in_order(docs, "doc_id", "source", "text"), "placed")
    return encode_documents(placed).select("position", "doc_id", "source", "text", "ids", *_digests())
