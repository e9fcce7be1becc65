"""Fill-in-middle transformation (operator 11): a distinct-text index.

Documents of one text share its token boundaries, so these are found once for each
distinct text: texts are grouped by SHA-256, the group's aggregate keeps the set of
its texts (one text, compared byte by byte, in each group), and a text's boundaries
are kept as an Elias-Fano list: low bits packed, high bits in unary. Documents join
the lists by a slim row (no text travels from their side), and each seeded cut is a
select on the list, so a text is not split into tokens again.

Whole texts are exchanged once, in the grouping, after copies have met in the map
tasks: lists are made from the exchanged rows, cuts are selected from the lists, and
the slim cuts come back to the texts in the partitioning that the grouping left.
Texts that hold more than 1/SHARE of all rows (fewer than SHARE there can be) are
dealt over pieces of their documents, so that no task gets a hot group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.base import cut, table

SEED = 42
#: Percent of documents that are transformed, and of those the percent in form spm.
RATE, SPM = 50, 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: A text is dealt in pieces if it has more than 1/SHARE of all rows.
SHARE = 1000
#: Bytes of a text that are looked at together.
BLOCK = 1 << 20
#: Set bits of each byte.
ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(axis=1).astype(np.int64)


def boundaries(text: bytes) -> tuple[np.ndarray, int]:
    """Where the tokens of a text end, in code points, and its code points. A token is
    a word with the white space before it, or the white space after the last word."""
    data, found, chars = np.frombuffer(text, np.uint8), [], 0
    for start in range(0, len(data), BLOCK):
        part = data[start : start + BLOCK + 1]  # one byte more tells whether the last word goes on
        solid = ~((part == 32) | ((part >= 9) & (part <= 13)))
        points = ((part & 0xC0) != 0x80).cumsum()
        n = min(BLOCK, len(data) - start)
        following = np.append(solid[1:], False)[:n]
        found.append(chars + points[np.flatnonzero(solid[:n] & ~following)])
        chars += int(points[n - 1])
    ends = np.concatenate(found) if found else np.empty(0, np.int64)
    if chars and (not len(ends) or ends[-1] != chars):
        ends = np.append(ends, chars)
    return ends, chars


def elias_fano(ends: np.ndarray, limit: int) -> tuple[int, bytes, bytes]:
    """An ascending list of numbers up to ``limit``: the width of the low parts, the
    low parts, and the high parts as a row of bits with a one for each number."""
    n = len(ends)
    width = max(0, (limit // n).bit_length() - 1) if n else 0
    low = (ends[:, None] >> np.arange(width)) & 1
    high = np.zeros(n + (limit >> width) + 1, bool)
    high[(ends >> width) + np.arange(n)] = True
    return width, np.packbits(low.astype(bool), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes()


def select(k: int, width: int, low: bytes, high: bytes, ones: np.ndarray | None = None) -> int:
    """The k-th number of an Elias-Fano list (from 1; the 0th is 0)."""
    if k == 0:
        return 0
    data = np.frombuffer(high, np.uint8)
    ones = ONES[data].cumsum() if ones is None else ones
    byte = int(ones.searchsorted(k))
    nth = k - (int(ones[byte - 1]) if byte else 0)
    bit = int(np.flatnonzero(np.unpackbits(data[byte : byte + 1], bitorder="little"))[nth - 1])
    first = (k - 1) * width
    some = int.from_bytes(low[first // 8 : (first + width + 7) // 8], "little") >> first % 8
    return (8 * byte + bit - (k - 1)) << width | some & ((1 << width) - 1)


LIST = T.StructType().add("n", "long").add("chars", "long").add("width", "integer").add("low", "binary").add("high", "binary")


@F.pandas_udf(LIST)
def boundary_list(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        ends, chars = boundaries(bytes(text))
        rows.append((len(ends), chars, *elias_fano(ends, chars)))
    return pd.DataFrame(rows, columns=["n", "chars", "width", "low", "high"])


@F.pandas_udf(T.StructType().add("first", "long").add("second", "long"))
def ends_of(a: pd.Series, b: pd.Series, width: pd.Series, low: pd.Series, high: pd.Series) -> pd.DataFrame:
    """The ends of the first a and of the first b tokens."""
    rows = []
    for x, y, w, lo, hi in zip(a, b, width, low, high):
        ones = ONES[np.frombuffer(hi, np.uint8)].cumsum()
        rows.append((select(int(x), w, lo, hi, ones), select(int(y), w, lo, hi, ones)))
    return pd.DataFrame(rows, columns=["first", "second"])


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. Sentinels stand in no transformed text,
    so each is found at its first place."""
    parted = lambda text, by, k: F.split_part(text, F.lit(by), F.lit(k))
    rest = F.substr(output, F.lit(len(PREFIX) + 1))
    psm = F.concat(parted(rest, SUFFIX, 1), parted(rest, MIDDLE, 2), parted(parted(rest, SUFFIX, 2), MIDDLE, 1))
    after = parted(rest, PREFIX, 2)
    spm = F.concat(parted(after, MIDDLE, 1), parted(after, MIDDLE, 2), parted(rest, PREFIX, 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def distinct_texts(rows: DataFrame) -> DataFrame:
    """(key, piece, text): each distinct text of rows (key, piece, text), once for each
    piece where it is hot."""
    texts = rows.groupBy("key", "piece").agg(F.collect_set("text").alias("texts"))
    # equal keys with unequal texts would be a clash of SHA-256: none is known
    one = F.when(F.size("texts") == 1, F.get("texts", F.lit(0))).otherwise(F.raise_error(F.lit("texts of one SHA-256 differ")).cast("string"))
    return texts.select("key", "piece", one.alias("text"))


def infilled(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output, text): every row of docs
    with its transformed text.

    A null text is empty and stays as it is, as does a text that holds a sentinel; a
    null doc_id is seeded as the empty string. Rows of equal doc_id and text get equal
    results, one for each row. An empty table gives no rows; columns beside doc_id and
    text are not read. Texts must be valid UTF-8, as Parquet's strings are.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.unhex(F.sha2(text, 256)).alias("key"))
    counts = cut(rows.groupBy("key").count(), "copies")
    total = counts.agg(F.sum("count").alias("total"))
    hot = counts.join(F.broadcast(total)).filter(F.col("count") * SHARE > F.col("total"))  # one row; fewer than SHARE rows pass
    hot = cut(hot.select("key", F.ceil(F.col("count") * SHARE / F.col("total")).alias("pieces")), "hot")
    piece = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("pieces")), F.lit(0))
    rows = rows.join(F.broadcast(hot), "key", "left").withColumn("piece", piece).drop("pieces")
    texts = distinct_texts(rows.select("key", "piece", "text"))
    held = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        held = held | F.contains("text", F.lit(mark))
    lists = texts.select("key", "piece", held.alias("held"), boundary_list(F.col("text").cast("binary")).alias("list")).select("key", "piece", "held", "list.*")
    slim = rows.groupBy("doc_id", "key", "piece").agg(F.count(F.lit(1)).alias("copies"))

    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = lambda k: F.conv(F.substring("digest", 8 * k - 7, 8), 16, 10).cast("long")
    a, b = h(1) % (F.col("n") + 1), h(2) % (F.col("n") + 1)
    plain = (F.col("chars") == 0) | F.col("held") | (h(3) % 100 >= rate)
    listed = slim.join(lists, ["key", "piece"]).withColumn("digest", digest)
    listed = listed.withColumns({"form": F.when(plain, "plain").when(h(4) % 100 < spm, "spm").otherwise("psm"), "a": F.least(a, b), "b": F.greatest(a, b)})
    chosen = listed.withColumn("ends", ends_of("a", "b", "width", "low", "high")).select("doc_id", "key", "piece", "copies", "n", "chars", "form", "ends")
    joined = chosen.join(texts.hint("merge"), ["key", "piece"])
    cuts = [F.lit(0), F.col("ends.first"), F.col("ends.second"), F.col("chars")]
    prefix, middle, suffix = (F.substr("text", (x + 1).cast("int"), (y - x).cast("int")) for x, y in zip(cuts, cuts[1:]))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    back = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", psm).otherwise(back)
    moved = lambda c: F.when(F.col("form") != "plain", c)
    made = joined.select(
        "doc_id", "n", "form", moved(F.col("ends.first")).alias("prefix_chars"), moved(F.col("ends.second") - F.col("ends.first")).alias("middle_chars"), output.alias("output"), "text", "copies"
    )
    return made.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies", "copy")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transformed texts of all documents, as digests."""
    made = infilled(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    )


#: DuckDB statement of the query.
SQL = r"""
WITH t AS (
    SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w,
           sha256('42:' || coalesce(cast(doc_id AS VARCHAR), '')) AS d
    FROM documents
), h AS (
    SELECT *, list_transform(range(0, 4), lambda k: list_reduce(list_transform(range(1, 9), lambda i: cast(instr('0123456789abcdef', substr(d, cast(8 * k + i AS BIGINT), 1)) - 1 AS BIGINT)), lambda x, y: 16 * x + y)) AS h FROM t
), c AS (
    SELECT *, cast(len(w) AS BIGINT) AS n, least(h[1] % (len(w) + 1), h[2] % (len(w) + 1)) AS a, greatest(h[1] % (len(w) + 1), h[2] % (len(w) + 1)) AS b,
           CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
    FROM h
), s AS (
    SELECT doc_id, t, n, form, array_to_string(w[1:a], '') AS p, array_to_string(w[a + 1:b], '') AS m, array_to_string(w[b + 1:n], '') AS s FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN cast(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN cast(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM s"""
