"""Token counts by trie-shared dynamic programming.

The distinct pre-tokens of a task's documents are inserted in a trie. A node stands for a prefix, and its best unigram
segmentation (highest sum of piece scores, on ties the fewest pieces) follows from those of its ancestors, so it is
computed once when the node is made, however many pre-tokens share the prefix; a pre-token's count is what its terminal
node holds. Documents sum the counts of their pre-tokens. Nothing is shuffled; the trie starts anew beyond `max_nodes`, and
pre-tokens of more than `LONG_WORD` bytes, which share no prefix worth a node, are scored by the same recurrence over the
last few places alone: of a word of any length a task holds its text and as many places as the longest piece has characters.

Pre-tokens: the words [^\\x20\\x09-\\x0D]+ of a text, each with the space mark before it.
"""

from __future__ import annotations

import hashlib
import math

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import documents, shared, ship_package, slices, worker_state

SPACE = "▁"
#: Bytes beyond which a pre-token gets no nodes.
LONG_WORD = 4_096


def rank_scores(model_path: str, offset: float = 2.7) -> dict[str, float]:
    """Unigram log probabilities of a piece model's vocabulary by Zipf's law over its ranks: p ~ 1/(rank + offset).

    The model's file has merge ranks, not unigram scores, and tokenizers aren't trained here.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    own = [i for i in range(len(sp)) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    own.sort(key=lambda i: (-sp.get_score(i), i))
    total = math.log(sum(1 / (r + offset) for r in range(len(own))))
    return {sp.id_to_piece(i): -math.log(r + offset) - total for r, i in enumerate(own)}


class SharedTrie:
    """scores: piece to log probability. A character that is no piece costs `unknown` and is one token."""

    def __init__(self, scores: dict[str, float], max_nodes: int = 400_000):
        self.scores, self.max_nodes = scores, max_nodes
        self.longest = max(map(len, scores), default=1)
        # Every end, of two characters or more, of every piece, with its score if it is one: what isn't here ends no longer piece.
        self.ends: dict[str, float | None] = {piece[k:]: None for piece in scores for k in range(len(piece) - 1)}
        self.ends.update((piece, score) for piece, score in scores.items() if len(piece) > 1)
        self.unknown = min(scores.values(), default=0.0) - 10
        self.clear()

    def clear(self) -> None:
        self.children: dict[int, int] = {}
        self.best, self.count = [0.0], [0]
        self.terminal: dict[bytes, tuple[int, float]] = {}

    def insert(self, token: str) -> int:
        """The terminal node of a pre-token, with the nodes on its way."""
        node, path = 0, [0]
        children, best, count, scores, end_of, none = self.children, self.best, self.count, self.scores, self.ends.get, self.unknown
        for depth, char in enumerate(token, 1):
            key = node << 21 | ord(char)
            node = children.get(key)
            if node is None:
                score = best[path[-1]] + scores.get(char, none)
                pieces = count[path[-1]] + 1
                for start in range(depth - 2, -1, -1):
                    own = end_of(token[start:depth], none)
                    if own is none:
                        break
                    if own is not None:
                        total, n = best[path[start]] + own, count[path[start]] + 1
                        if total > score or total == score and n < pieces:
                            score, pieces = total, n
                node = children[key] = len(best)
                best.append(score)
                count.append(pieces)
            path.append(node)
        return node

    def rolled(self, token: str) -> tuple[int, float]:
        """The same recurrence without nodes: (pieces, score), over a ring of the last places."""
        ring = self.longest + 1
        best, count, scores = [0.0] * ring, [0] * ring, self.scores
        for depth, char in enumerate(token, 1):
            before = (depth - 1) % ring
            score, pieces = best[before] + scores.get(char, self.unknown), count[before] + 1
            for size in range(2, min(self.longest, depth) + 1):
                own = scores.get(token[depth - size : depth])
                if own is not None:
                    back = (depth - size) % ring
                    total, n = best[back] + own, count[back] + 1
                    if total > score or total == score and n < pieces:
                        score, pieces = total, n
            best[depth % ring], count[depth % ring] = score, pieces
        return count[len(token) % ring], best[len(token) % ring]

    def counts(self, word: bytes) -> tuple[int, float]:
        if len(word) > LONG_WORD:
            return self.rolled(SPACE + word.decode())
        found = self.terminal.get(word)
        if found is None:
            if len(self.best) > self.max_nodes:
                self.clear()
            node = self.insert(SPACE + word.decode())
            found = self.terminal[word] = (self.count[node], self.best[node])
        return found


def _count(broadcast):
    def run(batches):
        key, scores = broadcast.value
        trie = worker_state(("trie", key), lambda: SharedTrie(scores))
        for batch in slices(batches):
            words = [t.encode().split() if t else [] for t in batch.column("text").to_pylist()]
            # Each different word of the batch is counted once, words of one prefix after each other.
            found = {w: trie.counts(w) for w in sorted(set().union(*words))}
            pieces, scored = {w: f[0] for w, f in found.items()}.__getitem__, {w: f[1] for w, f in found.items()}.__getitem__
            n = list(map(len, words))
            tokens, score = [sum(map(pieces, own)) for own in words], [math.fsum(map(scored, own)) for own in words]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(tokens, pa.int64()), pa.array(score, pa.float64())], ["doc_id", "n_pretokens", "n_tokens", "score"])

    return run


def token_counts(df: DataFrame, scores: dict[str, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: doc_id, n_pretokens, n_tokens, score (sum of the best segmentations' log probabilities).

    A null, empty or all-space text has 0 of each. Repeated rows count each. scores, bounded by a vocabulary, is broadcast.
    """
    spark = df.sparkSession
    ship_package(spark)
    docs = documents(df, id_col, text_col)
    key = hashlib.sha256(repr(sorted(scores.items())).encode()).hexdigest()
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_pretokens long, n_tokens long, score double"
    return docs.mapInArrow(_count(shared(spark, (key, scores))), schema)
