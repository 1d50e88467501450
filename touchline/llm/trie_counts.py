"""Token counts under a unigram vocabulary, by dynamic programming over a trie of distinct pre-tokens.

A pre-token is a word between blanks with the word mark before it. Its best segmentation is the path of the
highest sum of piece scores; the forward score of a prefix depends on the prefix alone, so each trie node
holds it once, for every pre-token that passes, with the number of tokens on the best path. The node where a
pre-token ends holds its count. A character outside the vocabulary falls back to its bytes.

The trie grows with a task's distinct pre-tokens and is emptied beyond a fixed number of nodes, so memory is
bounded while a text may have any length. Nothing is shuffled.

Scores come from the order of the pieces: the logarithm of a Zipf share of a piece's rank, as the vocabulary
file of the merges holds no probabilities.

Defined results: null and empty texts have no words and no tokens; of equal scores the path with fewer tokens
counts; repeated rows count alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.text import byte_texts

#: Trie nodes of a Python worker; beyond this it starts anew.
MOST_NODES = 800_000

_MARK = "\u2581"
_COUNTS = "doc_id long, n_words long, n_tokens long"


def piece_scores(path: str) -> dict[str, float]:
    """Pieces of a sentencepiece file with their scores; control and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    total = math.log(sum(1 / (r + 1) for r in range(len(plain))))
    return {model.id_to_piece(i): -math.log(r + 1) - total for r, i in enumerate(plain)}


class Trie:
    """Forward scores and token counts of all prefixes met so far."""

    def __init__(self, scores: dict[str, float]) -> None:
        self.scores = scores
        # what can still be the end of a piece when read backwards
        self.endings = {piece[i:] for piece in scores for i in range(len(piece))}
        self.worst = min(scores.values(), default=0.0) - 10.0
        self.reset()

    def reset(self) -> None:
        self.child: dict[int, int] = {}  # by parent and character
        self.best, self.count = [0.0], [0]
        self.terminal: dict[bytes, int] = {}

    def tokens(self, word: bytes) -> int:
        """Tokens of a pre-token; nodes are made for the part of it that is new."""
        if (known := self.terminal.get(word)) is not None:
            return known
        text = _MARK + word.decode()
        if len(self.best) + len(text) > MOST_NODES:
            self.reset()
        line, node, child = [0], 0, self.child  # the node at hand and those above it
        for end, letter in enumerate(text, 1):
            step = node << 21 | ord(letter)
            node = child.get(step)
            if node is None:
                node = child[step] = self._extend(text, end, line)
            line.append(node)
        count = self.count[node]
        if len(word) <= 64:
            self.terminal[word] = count
        if len(self.best) > MOST_NODES:
            self.reset()
        return count

    def _extend(self, text: str, end: int, line: list[int]) -> int:
        """A new node: the best last piece, shortest first, of those that end at this character."""
        best, counts, scores, endings = self.best, self.count, self.scores, self.endings
        unknown = len(text[end - 1].encode())
        score, count = best[line[end - 1]] + unknown * self.worst, counts[line[end - 1]] + unknown
        for start in range(end - 1, -1, -1):
            part = text[start:end]
            piece = scores.get(part)
            if piece is not None:
                here, n = best[line[start]] + piece, counts[line[start]] + 1
                if here > score or here == score and n < count:
                    score, count = here, n
            elif part not in endings:
                break
        best.append(score)
        counts.append(count)
        return len(best) - 1


_TRIES: dict[str, Trie] = {}


def count_tokens(documents: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words and n_tokens of every document; ``vocabulary`` is a sentencepiece file."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _TRIES:
            _TRIES[vocabulary] = Trie(piece_scores(vocabulary))
        trie = _TRIES[vocabulary]
        for batch in batches:
            words = [body.split() if body else [] for body in byte_texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, words), pa.int64()), pa.array((sum(map(trie.tokens, own)) for own in words), pa.int64())], names=["doc_id", "n_words", "n_tokens"]
            )

    return documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(count, _COUNTS)
