"""Token counts (operator 7): unigram segmentation with a shared trie.

A pre-token is a word (a run without ASCII white space) behind the word mark. Its
token count is that of its best segmentation into vocabulary pieces, by the sum
of unigram scores (of equal sums, the one of fewer tokens). In each task the
distinct pre-tokens go into one trie; a trie node stands for a prefix and holds
the forward score and token count of that prefix, computed once however many
pre-tokens share it. Terminal counts are stored by pre-token, and a document adds
up the counts of its words. Nothing is exchanged; the trie is emptied when it
reaches NODES, and of a word only the first SHARED characters are put in it (the
rest of a longer one needs no more than the scores of the last few prefixes), so
memory is bounded whatever the corpus holds.
"""

from __future__ import annotations

from math import log

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from graphloom.llm.base import annotate, as_rows, table

NODES = 2_000_000
#: Characters of a pre-token that the trie holds.
SHARED = 64
MARK = "▁"
#: How much below the least likely piece a byte of an unknown character scores.
UNKNOWN = 10.0


def vocabulary(path: str | None = None) -> dict[str, float]:
    """Pieces with unigram scores: the log of a Zipf law over the piece order of a
    public SentencePiece model (which has ranks, not probabilities)."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    real = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))]
    return {model.id_to_piece(i): -log(rank + 2) for rank, i in enumerate(real)}


class UnigramTrie:
    """Forward scores of prefixes, shared between pre-tokens."""

    def __init__(self, scores: dict[str, float], nodes: int = NODES, shared: int = SHARED):
        self.scores, self.limit, self.shared = scores, nodes, shared
        self.longest = max(map(len, scores), default=1)
        self.byte = min(scores.values(), default=0.0) - UNKNOWN
        # all endings of pieces, with the score of those that are pieces: where no
        # piece ends so, none ends in what is longer
        self.endings: dict[str, float | None] = {}
        for piece in scores:
            for k in range(1, len(piece)):
                self.endings.setdefault(piece[k:], None)
        self.endings |= scores
        self.clear()

    def clear(self) -> None:
        self.children: dict[int, int] = {}
        self.best, self.tokens = [0.0], [0]
        self.terminal: dict[bytes, int] = {}
        self.held = 0  # bytes of the terminals, about

    def count(self, word: bytes) -> int:
        """Tokens of a pre-token; inserts it if it is new."""
        known = self.terminal.get(word)
        if known is None:
            if len(self.best) > self.limit or self.held > 48 * self.limit:
                self.clear()
            known = self.insert(MARK + word.decode())
            if len(word) <= 4 * self.shared:
                self.terminal[word] = known
                self.held += len(word) + 64
        return known

    def insert(self, text: str) -> int:
        children, best, tokens, endings, byte = self.children, self.best, self.tokens, self.endings, self.byte
        node, path, shared, longest = 0, [(0.0, 0)], self.shared, self.longest
        for at, char in enumerate(text, 1):
            if at <= shared:
                key = node << 21 | ord(char)
                node = children.get(key)
                if node is not None:
                    path.append((best[node], -tokens[node]))
                    continue
            # a new prefix: its score, and minus its tokens, from the prefixes before
            top = endings.get(char)
            last = path[-1]
            if top is None:  # an unknown character falls back to its bytes
                n_bytes = len(char.encode())
                found = (last[0] + byte * n_bytes, last[1] - n_bytes)
            else:
                found = (last[0] + top, last[1] - 1)
            if char in endings:
                for size in range(2, (at if at < longest else longest) + 1):
                    piece = text[at - size : at]
                    if piece not in endings:
                        break
                    top = endings[piece]
                    if top is not None:
                        before = path[-size]
                        new = (before[0] + top, before[1] - 1)
                        if new > found:
                            found = new
            path.append(found)
            if at <= shared:
                node = children[key] = len(best)
                best.append(found[0])
                tokens.append(-found[1])
            elif len(path) > 4096:
                path = path[-longest:]
        return -path[-1][1]


COUNTS = T.StructType([T.StructField("n_pretokens", T.LongType()), T.StructField("n_tokens", T.LongType())])


def counted(docs: DataFrame, scores: dict[str, float] | None = None) -> DataFrame:
    """docs' row (struct ``row``) with n_pretokens and n_tokens.

    A null or empty text, or one of white space, has none. A word of any length is
    one pre-token. Repeated rows are counted one by one. An empty table gives no
    rows. The vocabulary (its size is that of a model file) is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(scores or vocabulary())

    def make():
        trie = UnigramTrie(shared.value)

        def compute(texts):
            split = [(t or b"").split() for t in texts]
            return [[len(w) for w in split], [sum(map(trie.count, w)) for w in split]]

        return compute

    return annotate(as_rows(docs), COUNTS, make)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pre-tokens and tokens of every document. The public model has ranks, not
    probabilities, so the scores are those of a Zipf law over them."""
    found = counted(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", "n_pretokens", "n_tokens")
