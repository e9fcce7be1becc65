"""Benchmark decontamination (operator 1): a prefix-filtered set join.

Each benchmark window is the set of its word shingles. Shingles are ordered by
rarity; a document that contains a window contains all of its shingles, so the
rarest one alone is a sufficient prefix (threshold 1). The join is on hashes of
these prefix shingles:

1. The texts are scanned with the hashes of the prefix shingles only, in blocks of
   at most BLOCK hashes (8 bytes each), one scan a block. What matches leaves the
   scan as a candidate: hash, place and the words around it, no more than the
   longest window needs. No text is exchanged.
2. Candidates of distinct texts are joined with the windows on the hash. A match
   fixes where the window would have to start: bounds on position and length drop
   what would begin or end outside the words, and the words of the item-sized
   window are then compared exactly, so hashes that clash do no harm.
3. Windows name their items by the number of a set of items; texts that meet the
   same sets share one list of items.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.base import as_rows, cut, lower_ascii, table, unpack, utf8

WINDOW = 13
SHINGLE = 5
#: Hashes of prefix shingles that a scan of the texts looks for.
BLOCK = 2_000_000
#: Bytes of texts that a task turns into words at once.
AT_ONCE = 1 << 20
#: Bytes of a text as words and spaces: A-Z lower-cased, digits, a-z and all
#: bytes of non-ASCII characters kept, the rest of ASCII turned into a space.
TO_WORDS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
#: Odd multipliers of the words of a shingle, by place.
PLACES = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(SHINGLE)], np.uint64)


def windows(items: DataFrame, width: int = WINDOW) -> DataFrame:
    """(words, item): the windows of all items, with the ids (as strings, a null id
    as the empty string) of the items that hold them, each pair once."""
    words = F.filter(
        F.split(lower_ascii(F.coalesce("text", F.lit(""))), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), lambda w: w != ""
    )
    spread = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words.alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (width - 1), F.lit(1)))
    return spread.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, width))).alias("words")).distinct()


def prefixes(found: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(words, offset, shingle): of each window the rarest shingle (by the number
    of windows that hold it, then by hash) and where in the window it stands."""
    k = F.least(F.lit(size), F.size("words"))
    starts = F.sequence(F.lit(0), F.size("words") - k)
    each = found.select("words", F.posexplode(F.transform(starts, lambda i: F.concat_ws(" ", F.slice("words", i + 1, k)))).alias("offset", "shingle"))
    rarity = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    rank = F.struct("n", F.xxhash64("shingle").alias("h"), "offset", "shingle")
    best = each.join(rarity, "shingle").groupBy("words").agg(F.min(rank).alias("best"))
    return best.select("words", "best.offset", "best.shingle")


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` neighbouring words, from the words' own hashes."""
    n = max(0, len(words) - size + 1)
    with np.errstate(over="ignore"):
        x = np.full(n, np.uint64(size))
        for i in range(size):
            x += words[i : i + n] * PLACES[i]
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
    return x


def word_hashes(words: pa.Array) -> np.ndarray:
    """Hashes of words; each distinct one is hashed once."""
    coded = words.dictionary_encode()
    distinct = np.array([xxhash.xxh64_intdigest(w) for w in utf8(coded.dictionary).to_pylist()], np.uint64)
    return distinct[coded.indices.to_numpy()] if len(words) else np.empty(0, np.uint64)


def hashed(found: DataFrame) -> DataFrame:
    """Adds h and size, the hash and the word count of ``shingle``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, h = [], []
            for shingle in batch.column(batch.schema.get_field_index("shingle")).to_pylist():
                words = shingle.split(" ")
                sizes.append(len(words))
                h.append(shingle_hashes(word_hashes(pa.array(words)), len(words))[0])
            new = [pa.array(np.array(h, np.uint64).view(np.int64)), pa.array(sizes, pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "h", "size"])

    return found.mapInArrow(run, T.StructType([*found.schema.fields, T.StructField("h", T.LongType()), T.StructField("size", T.IntegerType())]))


class Finder:
    """Finds the shingles of one block in texts."""

    def __init__(self, block: dict[int, np.ndarray], width: int = WINDOW):
        self.block, self.width = block, width
        self.maps: dict[int, np.ndarray] = {}
        for size, hashes in block.items():  # most shingles are ruled out by their first bits
            self.maps[size] = np.zeros(1 << 22, bool)
            self.maps[size][(hashes >> np.uint64(42)).astype(np.int64)] = True

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, list[list[dict]]]:
        """Words of each text, and its candidates in ascending order."""
        plain = pa.array([t.translate(TO_WORDS).strip() for t in texts], pa.binary()).cast(pa.string())
        lists = pc.split_pattern_regex(plain, " +") if len(texts) else pa.array([], pa.list_(pa.string()))
        stops = lists.offsets.to_numpy().astype(np.int64)
        words = lists.values
        filled = pc.binary_length(words).to_numpy() > 0 if len(words) else np.empty(0, bool)  # a text without words is split into one empty word
        counts = np.add.reduceat(filled, stops[:-1], dtype=np.int64) if len(words) else np.zeros(len(texts), np.int64)
        own = word_hashes(words)
        text_of = np.repeat(np.arange(len(texts)), np.diff(stops))
        out: list[list[dict]] = [[] for _ in texts]
        for size, hashes in self.block.items():
            x = shingle_hashes(own, size)
            at = np.flatnonzero(self.maps[size][(x >> np.uint64(42)).astype(np.int64)])
            near = np.searchsorted(hashes, x[at])
            at = at[hashes[np.minimum(near, len(hashes) - 1)] == x[at]]
            at = at[text_of[at] == text_of[at + size - 1]]  # a shingle of one text
            reach = (self.width - size, self.width) if size == SHINGLE else (0, size)
            for i in at.tolist():
                k = text_of[i]
                low, high = max(int(stops[k]), i - reach[0]), min(int(stops[k + 1]), i + reach[1])
                part = " ".join(words.slice(low, high - low).to_pylist())
                out[k].append({"h": int(x[i].view(np.int64)), "size": size, "first": low - int(stops[k]), "at": i - low, "part": part})
        return counts, out


#: Of a candidate: hash and word count of the shingle, number of the first word
#: around it, place of the shingle in these words, the words.
CANDIDATES = T.ArrayType(
    T.StructType([T.StructField("h", T.LongType()), *[T.StructField(c, T.IntegerType()) for c in ("size", "first", "at")], T.StructField("part", T.StringType())])
)


def scan(rows: DataFrame, block: DataFrame, width: int, every: bool) -> DataFrame:
    """rows without ``text``, with n_words and the candidates of one block of
    hashes (at most about BLOCK); rows without candidates only if ``every``."""
    found = block.toArrow()
    sizes, h = found.column("size").to_numpy(), found.column("h").to_numpy().view(np.uint64)
    shared = rows.sparkSession.sparkContext.broadcast({int(s): np.sort(h[sizes == s]) for s in np.unique(sizes)})
    names = [c for c in rows.columns if c != "text"]
    kind = T.StructType([*[rows.schema[c] for c in names], T.StructField("n_words", T.LongType()), T.StructField("found", CANDIDATES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        find, types = Finder(shared.value, width), to_arrow_schema(kind)
        for batch in batches:
            size = max(1, len(batch) * AT_ONCE // max(1, batch.nbytes))
            for start in range(0, len(batch), size):
                part = batch.slice(start, size)
                counts, found = find(utf8(part.column(part.schema.get_field_index("text"))).to_pylist())
                kept = [part.column(part.schema.get_field_index(c)) for c in names]
                out = pa.RecordBatch.from_arrays([*kept, pa.array(counts), pa.array(found, types.field("found").type)], [*names, "n_words", "found"])
                yield out if every else out.filter(pa.array([bool(x) for x in found]))

    return rows.mapInArrow(run, kind)


def overlaps(docs: DataFrame, items: DataFrame, keep: list[str] | None = None, block: int = BLOCK, width: int = WINDOW) -> DataFrame:
    """docs' row (struct ``row``, or only its columns ``keep``) with u, v (a 128-bit
    hash of the text), n_words, n_hit, n_items, items_sha256, contaminated, spans
    (word ranges of the hits, in order) and items.

    A null or empty text has no words and is never contaminated; null or wordless
    items give no windows. Repeated documents are judged one by one, repeated
    items count once. Empty tables on either side are fine.
    """
    text = F.coalesce(F.col("row.text"), F.lit(""))
    kept = F.struct(*[F.col("row").getField(c).alias(c) for c in (docs.columns if keep is None else keep)])
    slim = as_rows(docs).select(kept.alias("row"), F.xxhash64(text).alias("u"), F.xxhash64(F.lit(1), text).alias("v"), text.alias("text"))

    held = cut(windows(items, width), "windows")
    index = cut(hashed(prefixes(held.select("words").distinct())), "prefixes")
    # items of a window as one list, known by number; lists are few, as neighbours share them
    lists = held.groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items"))
    lists = cut(lists.withColumn("set", F.sha2(F.array_join(F.transform("items", lambda i: F.concat(F.length(i).cast("string"), F.lit(":"), i)), ""), 256)), "lists")
    sets = lists.groupBy("set").agg(F.first("items").alias("items"))
    targets = index.join(lists.select("words", "set"), "words").select("h", "size", "offset", F.size("words").alias("width"), F.array_join("words", " ").alias("window"), "set")

    hashes = index.select("h", "size").distinct()
    blocks = max(1, -(-hashes.count() // block))
    own = lambda b: hashes.filter(F.pmod(F.xxhash64("h"), F.lit(blocks)) == b)
    rows = cut(scan(slim, own(0), width, True), "scanned")
    texts = rows.filter(F.size("found") > 0).select("u", "v", "found")
    for b in range(1, blocks):
        more = scan(slim.select("u", "v", "text"), own(b), width, False)
        texts = texts.union(more.select("u", "v", "found"))
    # of equal texts one is looked at
    each = texts.groupBy("u", "v", F.element_at("found", 1).getField("h").alias("b")).agg(F.first("found").alias("found"))
    each = each.select("u", "v", F.explode("found").alias("x")).select("u", "v", "x.*")
    start = F.col("at") - F.col("offset")
    there = F.array_join(F.slice(F.split("part", " "), start + 1, F.col("width")), " ")
    hits = (
        each.join(targets, ["h", "size"]).filter(start >= 0)
        .filter(there == F.col("window"))
        .select("u", "v", F.struct((F.col("first") + start).alias("a"), (F.col("first") + start + F.col("width")).alias("b")).alias("span"), "set")
    )
    judged = cut(hits.groupBy("u", "v").agg(F.array_sort(F.collect_set("span")).alias("spans"), F.sort_array(F.collect_set("set")).alias("sets")), "hits")
    # texts that meet the same sets share their items
    met = judged.select("sets").distinct().select("sets", F.explode("sets").alias("set")).join(sets, "set")
    met = met.groupBy("sets").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    met = cut(met.select("sets", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "items"), "items")

    begin = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to"))
    grow = lambda s, x: F.struct(
        (s.n + F.greatest(F.lit(0), x.b - F.greatest(x.a, s.to))).alias("n"), F.greatest(s.to, x.b).alias("to")
    )
    found = judged.select("u", "v", "spans", F.aggregate("spans", begin, grow, lambda s: s.n).alias("n_hit"), "sets").join(met, "sets").drop("sets")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    return rows.drop("found").join(found, ["u", "v"], "left").select(
        "row", "u", "v", "n_words", n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * 20 >= F.col("n_words"))).alias("contaminated"),
        none("spans", "array<struct<a: int, b: int>>"), none("items", "array<string>"),
    )


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overlap of every document with the whole benchmark."""
    found = overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select("row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the rows that the benchmark does not contaminate. The hashes
    of contaminated texts (16 bytes each) meet the documents in an anti join, which
    Spark broadcasts or exchanges by their measured size. A null text stays; null
    ids, repeated rows and extra columns under any name pass unchanged."""
    found = overlaps(docs, table(spark, sf_dir, "benchmark"), ["text"] if "doc_id" not in docs.columns else ["doc_id"])
    bad = cut(found.filter("contaminated").select("u", "v").distinct(), "contaminated")
    text = F.coalesce(F.col("row.text"), F.lit(""))
    clean = as_rows(docs).join(bad, (F.xxhash64(text) == bad["u"]) & (F.xxhash64(F.lit(1), text) == bad["v"]), "left_anti")
    return unpack(clean, docs.columns)
