"""Passages of many words that stand in several documents.

Part of suffix-array dedup (operator 3), whose removal goes by bytes: a passage of
over 50 words may have fewer than 400 bytes and then stays in the text, so it is
reported beside what is removed. Words are runs without white space, compared as
they are.

As there, not every position takes part: in each window of WORDS words the grams
of GRAM words of least hash are anchors, so equal windows hold equal anchors.

1. Anchors whose gram stands in one place only are dropped; those of equal context
   (WORDS - GRAM words before, WORDS from the anchor on) collapse. A context that
   two documents hold is a shared passage.
2. For documents that have none, the contexts of their anchors are compared with the
   others of the gram. Two that share a passage agree on half of what it needs beside
   the gram, before or behind it; hashes of these words tell who is alone. The others
   are compared as strings of MARK bytes a word: first by the windows that
   begin at every STEP-th word before the anchor, which finds all passages of
   WORDS + STEP - 1 words. What is still open is compared by cuts (windows that are
   STEP - 1 words shorter, as two contexts that share any window share a cut), and
   the contexts that share a cut with another text by all of their windows.

The words are read where the removal reads the text anyway, so no text is exchanged
for it, and windows are counted in the cluster, partial counts first, however many
contexts a gram has.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.base import RunHashes, cut, minima

WORDS = 51
GRAM = 16
#: Bytes of a word's hash in a context, and words between two cuts.
MARK, STEP = 3, 4
#: Bytes and words that are hashed at once (they fit the processor's cache), and
#: bytes of a longer text.
TOGETHER = 1 << 16
SEGMENT = 1 << 20
SEEDS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
GAP = re.compile(rb"[\x20\x09-\x0D]")


class Words:
    """Hashes of words and anchors of texts."""

    def __init__(self, words: int = WORDS, gram: int = GRAM):
        self.words, self.gram = words, gram
        self.bytes, self.one, self.two = RunHashes(0xA24BAED4963EE407), *(RunHashes(s) for s in SEEDS)

    def hashes(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of all texts one after the other, and where each text
        ends in them."""
        out, counts, parts, where, size = [], np.zeros(len(texts), np.int64), [], [], 0

        def flush():
            data = np.frombuffer(b" ".join([*parts, b""]), np.uint8)
            gap = np.concatenate([[True], SPACE[data]])
            starts, ends = np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])
            out.append(self.bytes.over(data.astype(np.uint64) + np.uint64(1))(starts, ends))
            stops = np.array([len(x) + 1 for x in parts]).cumsum()
            np.add.at(counts, np.array(where), np.diff(np.searchsorted(starts, stops), prepend=0))

        for k, text in enumerate(texts):
            at = 0
            while at < len(text):
                cut_at = GAP.search(text, at + SEGMENT) if len(text) - at > SEGMENT else None
                stop = cut_at.start() if cut_at else len(text)
                parts.append(text[at:stop])
                where.append(k)
                size, at = size + stop - at, stop
                if size > TOGETHER:
                    flush()
                    parts, where, size = [], [], 0
        if parts:
            flush()
        return np.concatenate(out) if out else np.empty(0, np.uint64), counts.cumsum()

    def anchors(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """(text, place, h, f, e) of all anchors: h is the gram's hash, place the number
        of its first word, f the hash of its context, e half a hash each of the words
        right behind and right before the gram, as many as one side of a shared
        passage must have (0: the text has fewer)."""
        own, ends = self.hashes(texts)
        starts, text_of = np.concatenate([[0], ends[:-1]]), np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        words, gram, reach = self.words, self.gram, self.words - self.gram
        places, h, f, e = [], [], [], []
        half, upper = (reach + 1) // 2, np.uint64(32)
        for a in range(0, len(own), TOGETHER):
            low = max(0, a - reach)
            part = own[low : a + TOGETHER + 2 * words]
            m = len(part) - gram + 1
            if m <= reach:
                continue
            first, second = self.one.over(part), self.two.over(part)
            x = first(slice(0, m), slice(gram, m + gram))
            window = np.arange(m - reach) + low
            valid = (window >= a) & (window < a + TOGETHER) & (window + words <= ends[text_of[window]])
            at = minima(x, reach + 1, valid)
            text = text_of[at + low]
            left, right = np.maximum(at - reach, starts[text] - low), np.minimum(at + words, ends[text] - low)
            with np.errstate(over="ignore"):
                mixed = (first(left, right) ^ (second(left, right) + (at - left).astype(np.uint64))) + (right - left).astype(np.uint64)
                behind, before = at + gram + half, at - half
                sides = [(at + gram, behind, behind <= ends[text] - low), (before, at, before >= starts[text] - low)]
                one, two = (np.where(fits, first(np.where(fits, i, 0), np.where(fits, j, 0)) >> upper | np.uint64(1), np.uint64(0)) for i, j, fits in sides)
                e.append((one << upper | two).view(np.int64))
            places.append(at + low)
            h.append(x[at].view(np.int64))
            f.append(mixed.view(np.int64))
        if not places:
            return (np.empty(0, np.int64),) * 5
        at, one = np.unique(np.concatenate(places), return_index=True)  # neighbouring parts overlap
        return text_of[at], at - starts[text_of[at]], *(np.concatenate(x)[one] for x in (h, f, e))

    def contexts_of(self, text: bytes, wanted: list[dict]) -> list[dict]:
        """The context of each ``wanted`` anchor (h, f, at, lo, hi) of a text: the
        marks of the words before it and from it on."""
        own, _ = self.hashes([text])
        marks = own.view(np.uint8).reshape(-1, 8)[:, :MARK].tobytes()
        out = []
        for w in wanted:
            at = w["at"] * MARK
            left, right = max(0, at - (self.words - self.gram) * MARK), at + self.words * MARK
            out.append({"h": w["h"], "f": w["f"], "lo": w["lo"], "hi": w["hi"], "l": marks[left:at], "r": marks[at:right]})
        return out


CONTEXTS = "array<struct<h: bigint, f: bigint, lo: bigint, hi: bigint, l: binary, r: binary>>"


def within(rows: DataFrame, some: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose key is among some, which are distinct and far fewer: their part
    of an exchange is held as a hash table, and the rows need no sort."""
    return rows.join(some.hint("shuffle_hash"), keys, "left_semi")


def shared_contexts(anchors: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From anchors (u, v, h, f, e, at) whose gram is not alone: held (u, v, h, f, at),
    each anchor of a text once; known (u, v), the texts with a context that another
    text holds; wanted (u, v, wanted), the anchors to look around for the rest.
    Equal texts count as one here."""
    held = cut(anchors.groupBy("h", "f", "u", "v").agg(F.min("at").alias("at"), F.min("e").alias("e")), "wordanchors")
    contexts = held.groupBy("h", "f").agg(F.min("u").alias("lo"), F.max("u").alias("hi"), F.min("e").alias("e"), F.min(F.struct("u", "v", "at")).alias("one"))
    contexts = cut(contexts, "contexts")
    known = cut(within(held, contexts.filter("lo <> hi").select("h", "f"), ["h", "f"]).select("u", "v").distinct(), "known")
    # grams of texts that are not known yet, and there the contexts that agree on one
    # side of the gram with one of another text, by as many words as a passage needs
    open_ = cut(held.join(known.hint("shuffle_hash"), ["u", "v"], "left_anti").select("h").distinct(), "open")
    left = cut(within(contexts, open_, ["h"]), "left")
    side = lambda k, x: F.when(x != 0, F.struct(F.lit(k).alias("side"), x.alias("x")))
    sides = F.filter(F.array(side(0, F.shiftrightunsigned("e", 32)), side(1, F.col("e").bitwiseAND(F.lit((1 << 32) - 1)))), lambda s: s.isNotNull())
    each = left.select("h", "f", "lo", "hi", F.explode(sides).alias("s")).select("h", "f", "lo", "hi", "s.*")
    often = each.groupBy("h", "side", "x").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo <> hi").select("h", "side", "x")
    near = within(each, often, ["h", "side", "x"]).select("h", "f").distinct()
    some = within(left, near, ["h", "f"]).select("one.u", "one.v", F.struct("h", "f", "one.at", "lo", "hi").alias("w"))
    return held, known, cut(some.groupBy("u", "v").agg(F.collect_list("w").alias("wanted")), "wanted")


def alike(contexts: DataFrame, words: int, gram: int, size: int, step: int) -> DataFrame:
    """(h, f) of the contexts (h, f, lo, hi, l, r) that have a window of ``size``
    words, from a word at a multiple of ``step`` before the anchor, in common with
    one of another text."""
    keys = []
    for o in range(0, words - gram + 1, step):
        whole = (F.octet_length("l") >= o * MARK) & (F.octet_length("r") >= (size - o) * MARK)
        left = F.substr("l", F.octet_length("l") - o * MARK + 1, F.lit(o * MARK))
        right = F.substring("r", 1, (size - o) * MARK)
        keys.append(F.when(whole, F.struct(F.lit(o).alias("o"), F.xxhash64(left, right).alias("x"), F.crc32(F.concat(right, left)).alias("y"))))
    each = contexts.select("h", "f", "lo", "hi", F.explode(F.filter(F.array(*keys), lambda k: k.isNotNull())).alias("k")).select("h", "f", "lo", "hi", "k.*")
    same = each.groupBy("h", "o", "x", "y").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo <> hi")
    return within(each, same.drop("lo", "hi"), ["h", "o", "x", "y"]).select("h", "f").distinct()


def sharing(held: DataFrame, known: DataFrame, contexts: DataFrame, words: int, gram: int) -> DataFrame:
    """(u, v) of the texts that share a passage; contexts (h, f, lo, hi, l, r) are
    those of the wanted anchors."""
    step = min(STEP, words - gram)
    texts = lambda found: within(held, found, ["h", "f"]).select("u", "v")
    sure = cut(known.union(texts(alike(contexts, words, gram, words, step))).distinct(), "known")
    left = cut(held.join(sure.hint("shuffle_hash"), ["u", "v"], "left_anti").select("h").distinct(), "open")
    some = within(contexts, left, ["h"])
    near = cut(alike(some, words, gram, words - step + 1, step), "cuts")
    some = within(some, near, ["h", "f"])
    return sure.union(texts(alike(some, words, gram, words, 1))).distinct()
