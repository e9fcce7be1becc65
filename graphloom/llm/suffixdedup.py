"""Suffix-array dedup (operator 3): repeated byte strings, by deep-shallow sorting.

A byte goes if it lies in a string of LENGTH bytes that also starts elsewhere in
the corpus. Sorting every suffix of the corpus is not needed: in each string of
LENGTH bytes the GRAM-byte grams of least hash are anchors, so equal strings hold
equal anchors at equal offsets, and only the suffixes at anchors (about one in a
hundred) take part.

1. Anchors are counted by gram hash; those whose gram occurs once are dropped.
2. Anchors of equal context (all that can matter around them) collapse to one
   row with a count. A context that occurs twice is repeated as a whole.
3. Contexts that share a gram but differ are sorted by what follows the anchor
   and arranged by what precedes it: deep-shallow sorting, that is multikey
   quicksort to SHALLOW bytes and blind tries for groups that are equal so far.
   Neighbours in the order give the longest right match among all contexts that
   agree on so much to the left; both together must reach LENGTH bytes.
4. A gram with over GROUP different contexts is not sorted in one task: contexts
   that share a long cut with none are dropped, the strings of LENGTH bytes of the
   rest are counted by fingerprint, in the whole cluster.
5. The matches go back to all anchors of a context and are united by text.

A document is known by 128 bits of hashes of its text, so equal texts send their
contexts once. ``passages`` tells which documents share a passage of many words.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm import passages as P
from graphloom.llm.base import RunHashes, as_rows, cut, fresh_path, minima, remove, table

LENGTH = 400
GRAM = 160
SHALLOW = 16
#: Contexts of one gram that a task sorts (about 20 MB); grams with more are counted
#: instead.
GROUP = 1 << 15
#: Bytes between the cuts by which contexts of such grams are compared beforehand.
STEP = 40
#: Bytes of a text that are hashed at once.
SEGMENT = 1 << 20
#: Bytes of short texts that are hashed together (they fit the processor's cache).
TOGETHER = 1 << 16
#: Bytes of contexts that a task turns into Python objects at once (a group at least).
AT_ONCE = 16 << 20
#: Bytes of a text from which contexts are cut in one row.
PIECE = 8 << 20
BASE = 0x9E3779B97F4A7C15


class Anchors:
    """Anchor positions of texts: the least gram hashes of every string."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM):
        self.length, self.gram, self.hashes = length, gram, RunHashes(BASE)

    def together(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(piece, position in it, gram hash) of pieces of at least LENGTH bytes."""
        data = np.frombuffer(b"".join(pieces), np.uint8)
        sizes = np.array([len(x) for x in pieces])
        ends = sizes.cumsum()
        m, width = len(data) - self.gram + 1, self.length - self.gram + 1
        x = self.hashes.over(data.astype(np.uint64) + np.uint64(1))(slice(0, m), slice(self.gram, m + self.gram))
        of = np.repeat(np.arange(len(pieces)), sizes)
        valid = np.arange(self.length, m - width + 1 + self.length) <= ends[of[: m - width + 1]]
        at = minima(x, width, valid)
        return of[at], at - (ends - sizes)[of[at]], x[at].view(np.int64)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, position, gram hash) of all anchors, in order; a text under LENGTH
        bytes has none."""
        out, pieces, where, size = [], [], [], 0

        def flush():
            if pieces:
                piece, at, h = self.together(pieces)
                origin = np.array(where)[piece]
                out.append((origin[:, 0], origin[:, 1] + at, h))

        for k, text in enumerate(texts):
            for start in range(0, len(text) - self.length + 1, SEGMENT):
                pieces.append(text[start : start + SEGMENT + self.length - 1])
                where.append((k, start))
                size += len(pieces[-1])
                if size > TOGETHER:
                    flush()
                    pieces, where, size = [], [], 0
        flush()
        if not out:
            return (np.empty(0, np.int64),) * 3
        text, at, h = (np.concatenate(c) for c in zip(*out))
        new = np.ones(len(text), bool)  # segments overlap
        order = np.lexsort((at, text))
        text, at, h = text[order], at[order], h[order]
        new[1:] = (text[1:] != text[:-1]) | (at[1:] != at[:-1])
        return text[new], at[new], h[new]


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, u, v, text): u and v are a 128-bit hash of the text, which stands
    for it in all tables without texts."""
    text = F.coalesce(F.col("row.text"), F.lit(""))
    return as_rows(docs).select("row.doc_id", F.xxhash64(text).alias("u"), F.xxhash64(F.lit(1), text).alias("v"), text.cast("binary").alias("text"))


def anchor_rows(docs: DataFrame, length: int, gram: int, words: int, word_gram: int) -> DataFrame:
    """(u, v, p, h, f, e) for each anchor: p packs its position and the bytes from it
    to the end of its context, h is the hash of its gram, f that of its context.
    Anchors among the words (see ``passages``, also for e) come with a negative p, -1
    minus the number of their first word."""
    before = length - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, spell, digest = Anchors(length, gram), P.Words(words, word_gram), xxhash.xxh64_intdigest
        for batch in batches:
            for k in range(0, len(batch), 200):
                part = batch.slice(k, 200)
                texts = part.column(2).to_pylist()
                of, at, h = find(texts)
                word_of, word_at, word_h, word_f, e = spell.anchors(texts)
                h, e = np.concatenate([h, word_h]), np.concatenate([np.zeros(len(h), np.int64), e])
                sizes = np.array([len(x) for x in texts], np.int64)
                low, high = np.maximum(at - before, 0), np.minimum(at + length, sizes[of])
                p = at << 10 | high - at
                seeds = (at - low) << 10 | high - at
                f = [digest(texts[k][i:j], s) for k, i, j, s in zip(of.tolist(), low.tolist(), high.tolist(), seeds.tolist())]
                of = np.concatenate([of, word_of])
                p = np.concatenate([p, -1 - word_at])
                f = np.concatenate([np.array(f, np.uint64).view(np.int64), word_f])
                yield pa.RecordBatch.from_arrays([*(pa.array(part.column(c).to_numpy()[of]) for c in (0, 1)), *map(pa.array, (p, h, f, e))], ["u", "v", "p", "h", "f", "e"])

    rows = docs.filter(F.octet_length("text") >= min(length, 2 * words - 1)).select("u", "v", "text")
    return rows.mapInArrow(run, "u long, v long, p long, h long, f long, e long")


def common(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the longest common prefix; the first start bytes are known to agree."""
    stop = min(len(a), len(b))
    while start < stop:
        half = (start + stop + 1) // 2
        if a[start:half] == b[start:half]:
            start = half
        else:
            stop = half - 1
    return start


class BlindTrie:
    """A trie of branching bytes only. Inner nodes are pairs (depth, children by byte),
    leaves are lists of the numbers of equal strings; the end of a string is -1."""

    def __init__(self, strings: list[bytes], numbers: list[int], depth: int):
        self.strings, self.root = strings, [numbers[0]]
        for k in numbers[1:]:
            self.insert(k, depth)

    def insert(self, k: int, known: int) -> None:
        text, node, path = self.strings[k], self.root, []
        n = len(text)
        while type(node) is tuple:  # blind descent to some leaf
            path.append(node)
            depth, below = node
            node = below.get(text[depth] if depth < n else -1) or next(iter(below.values()))
        other = self.strings[node[0]]
        m = len(other)
        same = common(text, other, min(known, n, m))
        at, byte = len(path), text[same] if same < n else -1
        while at and path[at - 1][0] >= same:  # up to where the text leaves the path
            at -= 1
        below = path[at] if at < len(path) else node
        if type(below) is tuple and below[0] == same:
            if byte in below[1]:
                below[1][byte].append(k)  # equal to the end
            else:
                below[1][byte] = [k]
        elif type(below) is list and n == m == same:
            below.append(k)
        else:
            inner = (same, {byte: [k], other[same] if same < m else -1: below})
            if at:
                depth, children = path[at - 1]
                children[text[depth] if depth < n else -1] = inner
            else:
                self.root = inner

    def ordered(self, node=None) -> list[int]:
        node = self.root if node is None else node
        if type(node) is list:
            return node
        return [k for c in sorted(node[1]) for k in self.ordered(node[1][c])]


def deep_shallow(strings: list[bytes], depth: int, shallow: int = SHALLOW) -> list[int]:
    """The order of strings that agree on their first ``depth`` bytes: multikey
    quicksort for ``shallow`` bytes, then a blind trie for each group left."""
    order: list[int] = []
    stack = [(list(range(len(strings))), depth)]
    if len({s[depth : depth + shallow] for s in strings}) == 1:  # no pivot would part them
        return BlindTrie(strings, stack[0][0], depth).ordered()
    while stack:
        group, at = stack.pop()
        if len(group) == 1:
            order += group
        elif at >= depth + shallow:
            order += BlindTrie(strings, group, at).ordered()
        else:
            byte = [strings[k][at] if at < len(strings[k]) else -1 for k in group]
            pivot = sorted((byte[0], byte[len(byte) // 2], byte[-1]))[1]
            less = [k for k, b in zip(group, byte) if b < pivot]
            same = [k for k, b in zip(group, byte) if b == pivot]
            more = [k for k, b in zip(group, byte) if b > pivot]
            if more:
                stack.append((more, at))
            if pivot < 0:
                order += same  # at their end: equal strings, nothing sorts before
            else:
                stack.append((same, at + 1))
            if less:
                stack.append((less, at))
    return order


def matches(lefts: list[bytes], rights: list[bytes], length: int, gram: int) -> list[tuple[int, int, int]]:
    """(member, to the left, to the right): how far members of a group of anchors
    match another one, where that makes ``length`` bytes together. lefts are
    reversed; all rights begin with the same gram (checked, as hashes may clash)."""
    order = deep_shallow(rights, 0 if any(r[:gram] != rights[0][:gram] for r in rights) else gram)
    rank = {k: i for i, k in enumerate(order)}
    near = [common(rights[a], rights[b]) for a, b in zip(order, order[1:])]
    out: list[tuple[int, int, int]] = []
    best = [0] * len(lefts)

    def visit(depth: int, ranks: list[int]) -> None:
        """Members whose lefts agree on depth bytes, as sorted ranks."""
        right = [min(near[i:j]) for i, j in zip(ranks, ranks[1:])]
        for n, r in enumerate(ranks):
            reach = max(right[n - 1] if n else 0, right[n] if n < len(right) else 0)
            if depth + reach >= length and reach > best[order[r]]:
                best[order[r]] = reach
                out.append((order[r], depth, reach))

    def visit_many(depth: int, ranks: np.ndarray) -> None:
        right = np.minimum.reduceat(near_array[: ranks[-1]], ranks[:-1])
        reach = np.maximum(np.append(0, right), np.append(right, 0))
        for k in np.flatnonzero((reach >= length - depth) & (reach > best_array[ranks])).tolist():
            best_array[ranks[k]] = reach[k]
            out.append((order[ranks[k]], depth, int(reach[k])))

    def climb(node) -> list[int]:
        inner = type(node) is tuple
        ranks = sorted(r for c in node[1].values() for r in climb(c)) if inner else sorted(rank[k] for k in node)
        if len(ranks) > 1:
            visit(node[0] if inner else len(lefts[node[0]]), ranks)
        return ranks

    def climb_many(node) -> np.ndarray:
        inner = type(node) is tuple
        parts = [climb_many(c) for c in node[1].values()] if inner else [np.array([rank[k] for k in node])]
        ranks = np.sort(np.concatenate(parts), kind="stable")
        if len(ranks) > 1:
            visit_many(node[0] if inner else len(lefts[node[0]]), ranks)
        return ranks

    if len(lefts) > 200:
        near_array, best_array = np.array(near), np.zeros(len(lefts), np.int64)
        climb_many(BlindTrie(lefts, deep_shallow(lefts, 0), 0).root)
        return out
    climb(BlindTrie(lefts, deep_shallow(lefts, 0), 0).root)
    return out


def contexts(docs: DataFrame, wanted: DataFrame, length: int, gram: int, piece: int = PIECE) -> DataFrame:
    """(h, f, hot, left reversed, right) of the wanted anchors (u, v, h, f, p, hot).
    Equal texts are one row before they are exchanged; long ones are cut in pieces,
    each of which goes with its own anchors."""
    before = length - gram
    at = F.shiftright("p", 10)
    lists = wanted.groupBy("u", "v", F.expr(f"shiftright(p, 10) div {piece}").alias("k")).agg(
        F.collect_list(F.struct("h", "f", at.alias("a"), F.col("p").bitwiseAND(F.lit(1023)).alias("r"), "hot")).alias("anchors")
    )
    lists = lists.groupBy("u", "v").agg(F.collect_list(F.struct("k", "anchors")).alias("pieces"))
    once = docs.filter(F.octet_length("text") >= length).groupBy("u", "v").agg(F.first("text").alias("text"))
    each = once.join(lists, ["u", "v"]).select("text", F.explode("pieces").alias("x"))
    first = F.greatest(F.col("x.k") * piece - before, F.lit(0))
    parts = each.select(first.alias("first"), F.substr("text", (first + 1).cast("int"), F.lit(piece + before + length)).alias("text"), "x.anchors")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 200):
                part = batch.slice(k, 200)
                lists = part.column(2)
                fields = lists.flatten()
                h, f, a, r, hot = (fields.field(c) for c in range(5))
                # where each anchor stands in its piece of a text
                of = np.repeat(np.arange(len(part)), pc.list_value_length(lists).to_numpy())
                at = a.to_numpy() - part.column(0).to_numpy()[of]
                texts, low = part.column(1).to_pylist(), np.maximum(at - before, 0)
                left, right = [], []
                for k, i, j, n in zip(of.tolist(), low.tolist(), at.tolist(), r.to_pylist()):
                    text = texts[k]
                    left.append(text[i:j][::-1])
                    right.append(text[j : j + n])
                yield pa.RecordBatch.from_arrays([h, f, hot, pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["h", "f", "hot", "left", "right"])

    return parts.mapInArrow(run, "h long, f long, hot boolean, left binary, right binary")


def sorted_matches(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """(h, f, low, high) around the anchor, for grams of up to GROUP contexts."""
    groups = rows.groupBy("h").agg(F.collect_list(F.struct("f", "left", "right")).alias("members")).filter(F.size("members") > 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = max(1, len(batch) * AT_ONCE // max(1, batch.nbytes))
            for start in range(0, len(batch), size):
                part, out = batch.slice(start, size), ([], [], [], [])
                fields = part.column(1).flatten()
                f, left, right = (fields.field(c).to_pylist() for c in range(3))
                stops = np.cumsum(pc.list_value_length(part.column(1)).to_numpy()).tolist()
                for h, i, j in zip(part.column(0).to_pylist(), [0, *stops], stops):
                    if len(set(f[i:j])) == j - i:
                        own, lefts, rights = f[i:j], left[i:j], right[i:j]
                    else:  # repeated rows
                        own, lefts, rights = map(list, zip(*{x[0]: x for x in zip(f[i:j], left[i:j], right[i:j])}.values()))
                    if len(own) > 1:
                        for k, low, high in matches(lefts, rights, length, gram):
                            for column, v in zip(out, (h, own[k], -low, high)):
                                column.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["h", "f", "low", "high"])

    return groups.mapInArrow(run, "h long, f long, low long, high long")


def shared_cuts(rows: DataFrame, length: int, gram: int, step: int = STEP) -> DataFrame:
    """The rows that may share ``length`` bytes with another one of their gram: if
    two agree on so much, the left part of it being L bytes, they agree on the
    ``length - step`` bytes that begin L / step whole steps to the left. So few and
    short keys tell who is alone; he is dropped before strings are counted."""
    size = max(gram, length - step)
    step = length - size
    keys = []
    for low in range(0, length - gram + 1, max(1, step)):
        left, right = min(low, size), max(0, size - low)
        a, b = F.substring("left", 1, left), F.substring("right", 1, right)
        key = F.struct(F.lit(low).alias("i"), F.xxhash64(a, b).alias("u"), F.crc32(F.concat(b, a)).alias("v"))
        keys.append(F.when((F.octet_length("left") >= left) & (F.octet_length("right") >= right), key))
    cuts = rows.select("h", "f", F.explode(F.filter(F.array(*keys), lambda k: k.isNotNull())).alias("k")).select("h", "f", "k.*")
    often = cuts.groupBy("h", "i", "u", "v").count().filter("count > 1").drop("count")
    near = cuts.join(often, ["h", "i", "u", "v"], "left_semi").select("h", "f").distinct()
    return rows.join(near, ["h", "f"], "left_semi")


def counted_matches(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """The same for grams of more contexts: their strings are counted by 128-bit
    fingerprint, partial counts first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 64):
                out: tuple[list, ...] = ([], [], [])
                marks: list[bytes] = []
                for x in batch.slice(k, 64).to_pylist():
                    text, n = x["left"][::-1] + x["right"], len(marks)
                    marks += [xxhash.xxh3_128_digest(text[i : i + length]) for i in range(len(text) - length + 1)]
                    size = len(marks) - n
                    for column, v in zip(out, (np.full(size, x["h"]), np.full(size, x["f"]), np.arange(size) - len(x["left"]))):
                        column.append(v)
                if marks:
                    halves = np.frombuffer(b"".join(marks), np.int64).reshape(-1, 2)
                    columns = [*(np.concatenate(c) for c in out), halves[:, 0].copy(), halves[:, 1].copy()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["h", "f", "low", "u", "v"])

    once = rows.dropDuplicates(["h", "f"]).select("h", "f", "left", "right")
    each = shared_cuts(once, length, gram).mapInArrow(run, "h long, f long, low long, u long, v long")
    often = each.groupBy("h", "low", "u", "v").count().filter("count > 1").select("h", "low", "u", "v")
    return each.join(often, ["h", "low", "u", "v"]).select("h", "f", "low", (F.col("low") + length).alias("high"))


def repeated_spans(docs: DataFrame, some: DataFrame, length: int, gram: int, group: int, piece: int = PIECE) -> DataFrame:
    """(u, v, spans): byte ranges to remove, of texts that have any, from the anchors
    ``some`` whose gram is not alone."""
    alike = some.groupBy("h", "f").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("u", "v", "p")).alias("one"))
    alike = alike.select("h", "f", "c", "one.*")
    grams = cut(alike.groupBy("h").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("h", (F.col("m") > group).alias("hot")), "grams")
    a, r = F.shiftright("p", 10), F.col("p").bitwiseAND(F.lit(1023))
    left = F.least(a, F.lit(length - gram).cast("long"))
    whole = alike.filter((F.col("c") > 1) & (left + r >= length)).select("h", "f", (-left).alias("low"), r.alias("high"))
    around = contexts(docs, alike.join(grams, "h"), length, gram, piece)
    found = whole.union(sorted_matches(around.filter(~F.col("hot")), length, gram))
    if not grams.filter("hot").isEmpty():
        found = found.union(counted_matches(around.filter("hot"), length, gram))
    found = found.distinct()
    spans = some.join(found, ["h", "f"]).select("u", "v", F.struct((a + F.col("low")).alias("a"), (a + F.col("high")).alias("b")).alias("s"))
    return spans.groupBy("u", "v").agg(F.collect_set("s").alias("spans"))


def deduplicated(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP, words: int = P.WORDS, word_gram: int = P.GRAM,
    piece: int = PIECE, texts: bool = True,
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept, repeats): kept is
    the text without the bytes of repeated strings, as bytes, since a cut may fall
    inside a character (left out if not ``texts``). repeats tells whether the
    document has a passage of ``words`` or more words that another one holds.

    A null text is empty; texts under ``length`` bytes have nothing to remove.
    Repeated rows repeat each other, so all of their long strings go. A doc_id may
    be null or of any type. An empty table gives no rows.
    """
    if not 0 < gram < length < 1 << 10:
        raise ValueError("0 < gram < length < 1024")
    rows = keyed(docs)
    # written, so that texts are scanned once, and the join deals out both of its sides
    # and can split a common gram
    path = fresh_path(docs.sparkSession, "all-anchors")
    every = cut(anchor_rows(rows, length, gram, words, word_gram), "anchors", path)
    twice = cut(every.groupBy("h").count().filter("count > 1").select("h"), "grams")
    some = cut(P.within(every, twice, ["h"]), "anchors")
    remove(docs.sparkSession, path)
    spans = cut(repeated_spans(rows, some.filter("p >= 0"), length, gram, group, piece), "spans")
    held, known, wanted = P.shared_contexts(some.filter("p < 0").select("u", "v", "h", "f", "e", (-1 - F.col("p")).alias("at")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds, spell = to_arrow_schema(schema), P.Words(words, word_gram)
        for batch in batches:
            for k in range(0, len(batch), 200):
                part = batch.slice(k, 200)
                out: tuple[list, ...] = ([], [], [], [], [], [], [])
                for text, spans, wanted in zip(*(part.column(c).to_pylist() for c in (3, 4, 5))):
                    merged: list[list[int]] = []
                    for low, high in sorted((s["a"], s["b"]) for s in spans or ()):
                        if merged and low <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], high)
                        else:
                            merged.append([low, high])
                    kept, at = [], 0
                    for low, high in merged:
                        kept.append(text[at:low])
                        at = high
                    rest = b"".join([*kept, text[at:]])
                    long = len(text) >= 2 * words - 1 and len(text.split(None, words - 1)) == words
                    near = spell.contexts_of(text, wanted) if wanted else []
                    for column, v in zip(out, (len(text), len(text) - len(rest), len(merged), sha256(rest).hexdigest(), rest if texts else None, long, near)):
                        column.append(v)
                new = [pa.array(c, kinds.field(n + 3).type) for n, c in enumerate(out)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *new], kinds.names)

    added = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, long boolean, near " + P.CONTEXTS
    schema = T.StructType([*rows.select("doc_id", "u", "v").schema.fields, *T.StructType.fromDDL(added).fields])
    joined = rows.join(spans, ["u", "v"], "left").join(wanted, ["u", "v"], "left").select("doc_id", "u", "v", "text", "spans", "wanted")
    found = cut(joined.mapInArrow(run, schema), "kept")
    around = cut(found.filter(F.size("near") > 0).select(F.explode("near").alias("x")).select("x.*"), "around")
    shared = P.sharing(held, known, around, words, word_gram)
    copies = found.filter("long").groupBy("u", "v").count().filter("count > 1").select("u", "v")
    marked = cut(shared.union(copies).distinct().withColumn("repeats", F.lit(True)), "sharing")
    out = found.join(marked, ["u", "v"], "left").withColumn("repeats", F.coalesce("repeats", F.lit(False)))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * texts, "repeats")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is removed from every document, what is left, and whether it shares a
    passage of over 50 words with another document (such a passage may be shorter
    than the strings that are removed)."""
    found = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"), texts=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", (F.col("n_bytes") - F.col("n_removed")).alias("n_kept"), "repeats")
