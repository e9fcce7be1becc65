"""Token-ID output (operator 10): ORC files of token ids.

Documents are dealt by ranges of doc_id and sorted in each range, encoded in
tasks, and written as ORC with integer run-length encoding, row-group indexes
and a Bloom filter on doc_id. Stripes are read in parallel; a lookup by doc_id is
pruned by file, stripe and row-group metadata. Starts of documents come from sums
for each file, of which there are few, and running sums inside a file.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.base import cut, fresh_path, table

END = 1
#: Rows between two entries of the row index, and the stripe size in bytes.
STRIDE = 1000
STRIPE = 16 << 20


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: A letter or digit and the ASCII signs between it and white space.
SIGNS = r"([a-z0-9])([!-/:-@\[-`{-~]+)([\x20\x09-\x0D])"
#: Bytes of text that a task encodes at once.
AT_ONCE = 8 << 20
#: Words that are encoded as one text.
TOGETHER = 400


class Encoder:
    """Ids of whole texts, a batch of Arrow strings at a time.

    The tokenizer drops white space and never joins across it, so the ids of a text
    are those of its words (runs without ASCII white space) one after the other: the
    distinct words of a batch are encoded once and put in place by array operations.
    It also lower-cases, and ends a run of letters or digits at other signs; so A-Z
    are lowered and ASCII signs at the end of a word split off beforehand, which
    leaves fewer distinct words. Texts that may hold a special token are left as
    they are.

    Words are encoded many together. A word of letters alone ends with the one id of
    its that has the tokenizer's word end; between other words stands a separator
    word of one id (words that hold it go alone)."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        pieces = self.tokenizer.get_vocab()
        suffix = self.tokenizer.model.end_of_word_suffix or "</w>"
        self.ends = np.zeros(max(pieces.values()) + 1, bool)
        self.ends[[i for piece, i in pieces.items() if piece.endswith(suffix)]] = True
        ids = {c: self.encode([c])[0] for c in "~^`|@"}
        self.mark = next(c for c, x in ids.items() if len(x) == 1)
        self.mark_id = int(ids[self.mark][0])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def together(self, words: pa.Array, between: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and how many each has."""
        ids, sizes = [], []
        for k in range(0, len(words), TOGETHER * 50):
            part = words.slice(k, TOGETHER * 50)
            cuts = [*range(0, len(part), TOGETHER), len(part)]
            groups = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.concat_arrays([part]))
            for n, found in enumerate(self.encode(pc.binary_join(groups, between).to_pylist())):
                count = cuts[n + 1] - cuts[n]
                if between == " ":
                    size = np.diff(np.flatnonzero(self.ends[found]), prepend=-1)
                else:
                    at = np.flatnonzero(found == self.mark_id)
                    size = np.diff(np.concatenate([[-1], at, [len(found)]])) - 1
                    found = found[found != self.mark_id]
                if len(size) != count:  # not as expected: one by one
                    alone = self.encode(part.slice(cuts[n], count).to_pylist())
                    size, found = np.array([len(x) for x in alone]), np.concatenate(alone)
                ids.append(found)
                sizes.append(size)
        return np.concatenate(ids), np.concatenate(sizes)

    def words(self, words: pa.Array) -> pa.ListArray:
        """The ids of each of the (distinct) words."""
        letters = pc.utf8_is_alpha(words).to_numpy(zero_copy_only=False)
        marked = pc.match_substring(words, self.mark).to_numpy(zero_copy_only=False)
        filled = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
        sizes, found = np.zeros(len(words), np.int64), []
        for some, between in ((letters, " "), (~letters & ~marked & filled, f" {self.mark} ")):
            at = np.flatnonzero(some)
            if len(at):
                ids, sizes[at] = self.together(words.take(pa.array(at)), between)
                found.append((at, ids))
        at = np.flatnonzero(marked)
        if len(at):
            alone = self.encode(words.take(pa.array(at)).to_pylist())
            sizes[at] = [len(x) for x in alone]
            found.append((at, np.concatenate(alone)))
        offsets = np.concatenate([[0], sizes.cumsum()])
        values = np.empty(offsets[-1], np.int32)
        for at, ids in found:
            n = sizes[at]
            values[np.repeat(offsets[at] - (n.cumsum() - n), n) + np.arange(len(ids))] = ids
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))

    def __call__(self, texts: pa.Array) -> pa.ListArray:
        """The ids of each text, with the end id."""
        special = pc.match_substring(texts, "<|")
        # the space at the end lets the last word's signs be seen
        low = pc.replace_substring_regex(pc.binary_join_element_wise(pc.ascii_lower(texts), "", " "), SIGNS, r"\1 \2\3")
        lists = pc.ascii_split_whitespace(pc.if_else(special, texts, low))
        coded = lists.values.dictionary_encode()
        taken = self.words(coded.dictionary).take(coded.indices)
        stops = taken.offsets.to_numpy()[lists.offsets.to_numpy()]
        values = np.insert(taken.values.to_numpy()[stops[0] : stops[-1]], stops[1:] - stops[0], np.int32(END))
        return pa.ListArray.from_arrays(pa.array((stops - stops[0] + np.arange(len(stops))).astype(np.int32)), pa.array(values))


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None) -> None:
    """Write (doc_id, ids) of all rows to ORC files in ascending doc_id order (a
    null doc_id first; rows of equal doc_id by a hash of their texts). Each
    row's ids end with the end id; a null or empty text has this id alone.
    Other columns are not written. An empty table gives files without rows."""
    where = vocabulary or tokenizer_path()
    text = F.coalesce("text", F.lit(""))
    slim = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("h"))
    # as many ranges as the input has splits; the text's hash splits what has one doc_id
    parts = max(docs.rdd.getNumPartitions(), docs.sparkSession.sparkContext.defaultParallelism)
    dealt = slim.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "h")
    dealt = dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(where)
        for batch in batches:
            rows = max(1, len(batch) * AT_ONCE // max(1, batch.nbytes))
            for k in range(0, len(batch), rows):
                part = batch.slice(k, rows)
                yield pa.RecordBatch.from_arrays([part.column(0), encoder(part.column(1))], ["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    encoded = dealt.mapInArrow(encode, f"doc_id {kind}, ids array<int>")
    encoded.write.options(
        **{
            "compression": "zstd",
            "orc.bloom.filter.columns": "doc_id",
            "orc.bloom.filter.fpp": "0.01",
            "orc.create.index": "true",
            "orc.row.index.stride": str(STRIDE),
            "orc.stripe.size": str(STRIPE),
        }
    ).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, ids); a filter on doc_id reaches the stripe and row-group metadata."""
    return spark.read.orc(path)


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """For each row of the files: doc_id, start (ids of all rows before it),
    n_tokens and ids_crc32, all from the ids as read back."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            at, ids = lists.offsets.to_pylist(), memoryview(lists.values.to_numpy().astype("<i4", copy=False)).cast("B")
            sums = [crc32(ids[4 * i : 4 * j]) for i, j in zip(at, at[1:])]
            sizes = np.diff(np.array(at, np.int64))
            nth = np.arange(len(batch)) + check.rows
            check.rows += len(batch)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(nth), pa.array(sizes), pa.array(sums, pa.int64())], ["doc_id", "file", "nth", "n_tokens", "ids_crc32"]
            )

    check.rows = 0
    tokens = read_tokens(spark, path)
    kind = tokens.schema["doc_id"].dataType.simpleString()
    # a file's name holds the number of its range and, behind -c, that of the file in it
    number = lambda mark: F.regexp_extract("_metadata.file_name", mark, 1).cast("long")
    file = F.struct(number(r"part-(\d+)").alias("part"), number(r"-c(\d+)").alias("nth"), F.col("_metadata.file_block_start").alias("block"))
    rows = tokens.select("doc_id", file.alias("file"), "ids")
    rows = rows.mapInArrow(check, f"doc_id {kind}, file struct<part: bigint, nth: bigint, block: bigint>, nth long, n_tokens long, ids_crc32 long")
    rows = cut(rows, "tokenindex")
    sums = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    # one row for each split of a file; numbers, as names would put part-100000 before part-99999
    offsets = cut(sums.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("before")), "offsets")
    inside = Window.partitionBy("file").orderBy("nth")
    start = F.col("before") + F.sum("n_tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")
    return rows.join(offsets, "file").select("doc_id", start.alias("start"), "n_tokens", "ids_crc32")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the ids of all documents to the shared folder and index what is read back."""
    path = fresh_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path)
    return token_index(spark, path)
