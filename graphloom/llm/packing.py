"""Packing (operator 13): cutting-stock column generation over a length histogram.

Token ids are written once, in chunks of at most one sequence. The lengths of chunks
fall into some two hundred classes, and how many sequences of what pattern (so many
chunks of each class) are needed is a cutting-stock problem: a linear program over
patterns, whose columns a knapsack dynamic programme prices. The histogram is all that
the program sees, so its size does not depend on the data. Rounded down, patterns take
chunks by seeded rank in their class; what is left is packed first-fit by length.

Classes are rounded up, so sequences keep a little room. As documents may be cut, the
emptiest sequences are given up: of T tokens the T div 4096 fullest sequences stay, and
the chunks of the others fill their room, cut where it ends. What then remains, under
4096 tokens, goes into sequences of a power of two. So nothing is padded, and the better
the patterns, the fewer documents are cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.base import cut, fresh_path, running, table
from graphloom.llm.tokenfiles import Encoder, tokenizer_path

LENGTH = 4096
END = 2
SEED = 42
#: Bytes of text that a task encodes at once.
AT_ONCE = 4 << 20
#: The program stops when a new pattern could save less than this share of sequences.
NEAR = 1e-3


def steps(length: int) -> list[tuple[int, int]]:
    """(up to, step): chunks up to a length are rounded up to multiples of a step, so
    that a class is some hundredths of its length wide."""
    unit = max(1, length // 1024)
    return [(length // 16, unit), (length // 4, 4 * unit), (length, 8 * unit)]


def class_of(n: Column, length: int) -> Column:
    rounded = lambda step: F.ceil(n / step) * step
    (low, a), (middle, b), (_, c) = steps(length)
    return F.when(n <= low, rounded(a)).when(n <= middle, rounded(b)).otherwise(rounded(c)).cast("int")


def best_pattern(value: np.ndarray, size: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The pattern of greatest value: how many of each size (ascending) to take so that
    they fit in room. Knapsack: item by item, the best for every smaller room. Any number
    of an item means the best over rooms that differ by multiples of its size, a running
    maximum down the columns of a table as wide as the item."""
    # an item that is no smaller and worth no more than another is never needed
    worth = np.maximum.accumulate(np.concatenate([[0.0], value]))
    items = np.flatnonzero(worth[1:] > worth[:-1])
    bests = [np.zeros(room + 1)]
    for k in items:
        s, rows = int(size[k]), -(-(room + 1) // int(size[k]))
        table = np.full(rows * s, -np.inf)
        table[: room + 1] = bests[-1]
        gain = value[k] * np.arange(rows)[:, None]
        table = np.maximum.accumulate(table.reshape(rows, s) - gain, axis=0) + gain
        bests.append(np.maximum(table.ravel()[: room + 1], bests[-1]))
    pattern, w = np.zeros(len(size), np.int64), room
    for n in range(len(items) - 1, -1, -1):
        k, s = items[n], int(size[items[n]])
        # how many of the item: the first room of its column that does without
        column = np.arange(w, -1, -s)
        without = bests[n][column] + value[k] * np.arange(len(column))
        pattern[k] = int(without.argmax())
        w -= int(pattern[k]) * s
    return float(bests[-1][room]), pattern


def relaxed(size: np.ndarray, demand: np.ndarray, room: int, near: float = NEAR) -> tuple[np.ndarray, np.ndarray]:
    """(patterns, counts): a solution of the linear program that meets demand exactly
    with as few sequences as possible, up to the share ``near``. Revised simplex; the
    entering column is the best pattern under the current prices."""
    m = len(size)
    basis = np.diag(room // size).astype(float)
    inverse = np.diag(1 / (room // size))
    amount = inverse @ demand
    turn = 0
    while m:
        price = inverse.sum(axis=0)
        value, pattern = best_pattern(price, size, room)
        if value <= 1 + near:  # no solution has under 1/value of the sequences
            break
        column = inverse @ pattern
        ratio = np.where(column > 1e-9, amount / np.where(column > 1e-9, column, 1), np.inf)
        leaves = int(np.lexsort((-column, ratio))[0])
        step = ratio[leaves]
        basis[:, leaves] = pattern
        amount = np.maximum(amount - step * column, 0)
        amount[leaves] = step
        turn += 1
        if turn % 64:
            row = inverse[leaves] / column[leaves]
            inverse = inverse - np.outer(column, row)
            inverse[leaves] = row
        else:  # rounding errors add up
            inverse = np.linalg.inv(basis)
            amount = np.maximum(inverse @ demand, 0)
    return basis.T.round().astype(np.int64), amount


def patterns(size: np.ndarray, demand: np.ndarray, room: int, near: float = NEAR) -> tuple[np.ndarray, np.ndarray]:
    """(patterns, counts) of whole sequences that hold all of demand (sizes ascending,
    all up to room): the linear program's rounded down, and first-fit by decreasing
    size for the rest."""
    found, amount = relaxed(size, demand, room, near)
    counts = np.floor(amount + 1e-6).astype(np.int64)
    rest = demand - found.T @ counts
    for p in np.argsort(counts) if (rest < 0).any() else ():  # by rounding errors only
        back = min(int(counts[p]), max((-(rest[k] // found[p, k]) for k in np.flatnonzero((rest < 0) & (found[p] > 0))), default=0))
        counts[p] -= back
        rest += back * found[p]
    more, times = [], []
    while (rest > 0).any():
        pattern, left = np.zeros(len(size), np.int64), room
        for k in range(len(size) - 1, -1, -1):
            pattern[k] = min(int(rest[k]), left // int(size[k]))
            left -= pattern[k] * int(size[k])
        used = pattern > 0
        times.append(int((rest[used] // pattern[used]).min()))
        more.append(pattern)
        rest = rest - times[-1] * pattern
    return np.array([*found, *more]).reshape(-1, len(size)), np.array([*counts, *times], np.int64)


def placements(histogram: dict[int, int], length: int) -> list[tuple[int, int, int, int, int]]:
    """(size, first, last, sequence, count): the chunks of rank first to last - 1, in the
    order of size and rank, go in turn to the ``count`` sequences from ``sequence`` on."""
    unit = max(1, length // 1024)
    size = np.array(sorted(histogram), np.int64)
    demand = np.array([histogram[s] for s in size], np.int64)
    found, counts = patterns(size // unit, demand, length // unit) if len(size) else (np.zeros((0, 0), np.int64), np.zeros(0, np.int64))
    at, base, rows = demand.cumsum() - demand, 0, []
    for pattern, count in zip(found, counts):
        for k in np.flatnonzero(pattern) if count else ():
            n = int(pattern[k] * count)
            rows.append((int(size[k]), int(at[k]), int(at[k]) + n, base, int(count)))
            at[k] += n
        base += int(count)
    return rows


class Remembering(Encoder):
    """Words that earlier batches of a task had are looked up, ``MOST`` at a time."""

    MOST = 1 << 18

    def __init__(self, path: str):
        super().__init__(path)
        self.seen = self.lists = None

    def words(self, words: pa.Array) -> pa.ListArray:
        if self.seen is None or len(self.seen) > self.MOST:
            self.seen, self.lists = words, super().words(words)
            return self.lists
        at = pc.index_in(words, value_set=self.seen)
        new = words.filter(at.is_null())
        if len(new):
            place = np.cumsum(at.is_null().to_numpy(zero_copy_only=False)) + (len(self.seen) - 1)
            at = pc.if_else(at.is_null(), pa.array(place.astype(np.int32)), at)
            self.seen = pa.concat_arrays([self.seen, new])
            self.lists = pa.concat_arrays([self.lists, super().words(new)])
        return self.lists.take(at)


def chunks(docs: DataFrame, path: str, length: int = LENGTH, end: int = END, vocabulary: str | None = None) -> DataFrame:
    """Write the ids of all documents, each with its end id, in chunks of ``length`` and
    a rest: (doc_id, start, length, doc_tokens, ids, u), u a number of each chunk's own.
    Ids of a vocabulary of up to 65,536 pieces take 16 bits each, read as unsigned."""
    from tokenizers import Tokenizer

    where = vocabulary or tokenizer_path()
    short = max(Tokenizer.from_file(where).get_vocab_size(), end + 1) <= 1 << 16

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Remembering(where)
        for batch in batches:
            rows = max(1, len(batch) * AT_ONCE // max(1, batch.nbytes))
            for k in range(0, len(batch), rows):
                part = batch.slice(k, rows)
                lists = encoder(part.column(1))
                offsets, ids = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy().copy()
                ids[offsets[1:] - 1] = end
                if short:
                    ids = ids.astype(np.uint16).view(np.int16)
                sizes = np.diff(offsets)
                pieces = -(-sizes // length)
                row = np.repeat(np.arange(len(sizes)), pieces)
                start = (np.arange(len(row)) - np.repeat(pieces.cumsum() - pieces, pieces)) * length
                size = np.minimum(sizes[row] - start, length)
                cuts = np.append(offsets[row] + start, offsets[-1]).astype(np.int32)
                columns = [part.column(0).take(pa.array(row)), pa.array(start), pa.array(size), pa.array(sizes[row]), pa.ListArray.from_arrays(pa.array(cuts), pa.array(ids))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "doc_tokens", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, doc_tokens long, ids array<{'smallint' if short else 'int'}>"
    coded = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(encode, schema)
    coded = coded.withColumn("u", F.monotonically_increasing_id())  # fixed by the write
    coded.write.parquet(path)  # ids are packed by their dictionary
    return docs.sparkSession.read.schema(coded.schema).parquet(path)


def placed(slim: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """(u, length, h, sequence, at): every chunk (u, length) in a sequence, at its place
    there, as the patterns say; no chunk is cut yet."""
    spark = slim.sparkSession
    rows = slim.select("u", "length", F.xxhash64("u", F.lit(seed)).alias("h"), class_of(F.col("length"), length).alias("size"))
    rows = running(rows, [F.col("size"), F.col("h"), F.col("u")], {"nth": F.lit(1).cast("long")}, "ranks")
    histogram = {r["size"]: r["count"] for r in rows.groupBy("size").count().collect()}  # a row for each class, some 200
    plan = spark.createDataFrame(placements(histogram, length), "size int, first long, last long, base long, count long")
    # the plan has at most a row for each class and pattern, whatever the data
    rows = rows.join(F.broadcast(plan), "size").filter((F.col("nth") >= F.col("first")) & (F.col("nth") < F.col("last")))
    rows = rows.withColumn("sequence", F.col("base") + (F.col("nth") - F.col("first")) % F.col("count"))
    before = Window.partitionBy("sequence").orderBy(F.desc("size"), "nth").rowsBetween(Window.unboundedPreceding, -1)  # at most ``length`` rows
    return cut(rows.select("u", "length", "h", "sequence", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("at")), "placed")


def overlaps(fillers: DataFrame, rooms: DataFrame, total: int, length: int) -> DataFrame:
    """(u, first, size, sequence, at): two divisions of 0 .. total-1, one into chunks
    (u, start, end), the other into rooms (sequence, at, start, end), cut at both
    their borders. A sweep inside each block of ``length`` positions, at most that
    many rows of either kind."""

    def dealt(rows: DataFrame, own: list[str], name: str) -> DataFrame:
        block = F.explode(F.sequence(F.expr(f"start div {length}"), F.expr(f"(end - 1) div {length}")))
        rows = rows.filter("end > start").select(F.struct("start", *own).alias(name), block.alias("block"))
        return rows.withColumn("from", F.greatest(F.col(f"{name}.start"), F.col("block") * length))

    both = dealt(fillers, ["u"], "filler").unionByName(dealt(rooms, ["sequence", "at"], "room"), allowMissingColumns=True)
    both = both.groupBy("block", "from").agg(F.max("filler").alias("filler"), F.max("room").alias("room"))
    inside = Window.partitionBy("block").orderBy("from")
    both = both.select(
        "from", F.last("filler", True).over(inside).alias("filler"), F.last("room", True).over(inside).alias("room"),
        F.coalesce(F.lead("from").over(inside), F.least(F.lit(total), (F.col("block") + 1) * length)).alias("to"),
    )
    cuts = both.select("filler.u", (F.col("from") - F.col("filler.start")).alias("first"), (F.col("to") - F.col("from")).alias("size"), "room.sequence", (F.col("room.at") + F.col("from") - F.col("room.start")).alias("at"))
    # blocks cut once more
    return cuts.groupBy("u", "sequence").agg(F.min("first").alias("first"), F.sum("size").alias("size"), F.min("at").alias("at"))


def layout(slim: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """(u, first, size, sequence, at): the pieces of all chunks (u, length) and their
    places in sequences without padding, numbered from 0."""
    spark = slim.sparkSession
    rows = placed(slim, length, seed)
    fills = rows.groupBy("sequence").agg(F.sum("length").alias("fill"))
    order = [F.desc("fill"), F.col("sequence")]
    ranked = cut(running(fills, order, {"nth": F.lit(1).cast("long"), "room": length - F.col("fill")}, "fills"), "sequences")
    tokens = ranked.agg(F.coalesce(F.sum("fill"), F.lit(0))).first()[0]
    full, left = divmod(tokens, length)
    kept = ranked.filter(F.col("nth") < full)
    rooms = kept.select(F.col("nth").alias("sequence"), F.col("fill").alias("at"), F.col("room").alias("start"), (F.col("room") + length - F.col("fill")).alias("end"))
    free = full * length - kept.agg(F.coalesce(F.sum("fill"), F.lit(0))).first()[0]
    short, start = [], free
    for k, size in enumerate(1 << b for b in range(length.bit_length(), -1, -1) if left >> b & 1):
        short.append((full + k, 0, start, start + size))
        start += size
    rooms = rooms.unionByName(spark.createDataFrame(short, "sequence long, at long, start long, end long"))  # under 13 rows
    numbered = rows.join(ranked.select("sequence", "nth"), "sequence")
    whole = numbered.filter(F.col("nth") < full).select("u", F.lit(0).cast("long").alias("first"), F.col("length").alias("size"), F.col("nth").alias("sequence"), "at")
    given = numbered.filter(F.col("nth") >= full).select("u", "length", "h")
    given = running(given, [F.col("h"), F.col("u")], {"start": F.col("length")}, "fillers").withColumn("end", F.col("start") + F.col("length"))
    return whole.unionByName(overlaps(given, rooms, free + left, length))


def packed(docs: DataFrame, length: int = LENGTH, end: int = END, vocabulary: str | None = None, seed: int = SEED, with_ids: bool = True) -> DataFrame:
    """One row for each piece: doc_id, start (its document's ids before it), length,
    ids_crc32, doc_tokens, sequence_id, offset and (with_ids) its ids.

    A null or empty text has its end id alone; rows with a null doc_id and repeated rows
    are documents of their own. A document longer than a sequence is cut at its
    multiples. An empty table gives no rows; columns beside doc_id and text are not
    read.
    """
    spark = docs.sparkSession
    stored = chunks(docs, fresh_path(spark, "ids"), length, end, vocabulary)
    pieces = layout(stored.select("u", "length"), length, seed)
    # at most ``length`` pieces a chunk; the join uses the partitioning of the grouping
    pieces = pieces.groupBy("u").agg(F.collect_list(F.struct("first", "size", "sequence", "at")).alias("pieces"))
    rows = stored.select("doc_id", "start", "doc_tokens", "ids", "u").join(pieces, "u").drop("u")

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, found = batch.column(3), batch.column(4)
            at, ids = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy()
            ids = (ids.view(np.uint16) if ids.dtype == np.int16 else ids).astype("<u4")
            cuts = found.offsets.to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(batch)), np.diff(cuts))
            part = found.values.slice(int(cuts[0]), int(cuts[-1] - cuts[0]))
            first, size, sequence, place = (f.to_numpy() for f in part.flatten())
            begin, view = at[row] + first, memoryview(ids).cast("B")
            sums = [crc32(view[4 * int(i) : 4 * int(j)]) for i, j in zip(begin, begin + size)]
            columns = [
                batch.column(0).take(pa.array(row)), pa.array(batch.column(1).to_numpy()[row] + first), pa.array(size), pa.array(sums, pa.int64()),
                pa.array(batch.column(2).to_numpy()[row]), pa.array(sequence), pa.array(place),
            ]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                inside = np.repeat(begin - (size.cumsum() - size), size) + np.arange(size.sum())
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], size.cumsum()]).astype(np.int32)), pa.array(ids[inside].astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return rows.mapInArrow(slices, schema)


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with digests of their ids."""
    return packed(table(spark, sf_dir, "documents"), with_ids=False)
