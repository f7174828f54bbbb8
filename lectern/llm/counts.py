"""Token counts of the most likely unigram segmentation, shared over a trie of pre-tokens.

The forward score at a letter is the best over the pieces that end there, and depends only on
the letters before it.  Distinct pre-tokens are therefore inserted into a trie; a node's
score is computed once for all pre-tokens with that prefix, and the node where a pre-token
ends holds its number of tokens.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, texts

SPACE = "▁"
NODES = 600_000  # nodes above which a task starts a new trie
LONG = 512  # letters above which a pre-token is scored by itself
_WORD = re.compile(r"\S+")
_AT_ONCE = 1 << 18


class Pieces:
    """Pieces of a public vocabulary with unigram scores by rank, ``-log(rank + 1)``; unknown letters fall back to bytes."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [
            model.id_to_piece(i) for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
        ]
        self.score = {p: -math.log(rank + 2) for rank, p in enumerate(names)}
        self.longest = max(map(len, self.score))
        # Lengths of the pieces of three letters and more, by their last three letters.
        self.lengths: dict[str, list[int]] = {}
        for piece in self.score:
            if len(piece) > 2 and len(piece) not in (known := self.lengths.setdefault(piece[-3:], [])):
                known.append(len(piece))
        for known in self.lengths.values():
            known.sort()
        self.byte = 2 * min(self.score.values())

    def forward(self, before: list[tuple[float, int]], letters: str) -> tuple[float, int]:
        """Score and number of tokens of the best segmentation of ``letters``.

        ``before`` has those of all shorter prefixes.  Of equal scores the one with the shorter
        last piece stays.
        """
        n = len(letters)
        get = self.score.get
        last = letters[-1]
        at = before[n - 1]
        score = get(last)
        if score is None:
            width = len(last.encode("utf-8", "surrogatepass"))
            best, tokens = at[0] + width * self.byte, at[1] + width
        else:
            best, tokens = at[0] + score, at[1] + 1
        if n > 1:
            score = get(letters[-2:])
            if score is not None and before[n - 2][0] + score > best:
                best, tokens = before[n - 2][0] + score, before[n - 2][1] + 1
            for size in self.lengths.get(letters[-3:], ()):
                if size > n:
                    break
                score = get(letters[n - size :])
                if score is not None and before[n - size][0] + score > best:
                    best, tokens = before[n - size][0] + score, before[n - size][1] + 1
        return best, tokens


class Trie(dict):
    """Tokens of pre-tokens, with the trie that their scores are computed on.

    ``below`` maps a node and a letter to the next node; ``scores`` has each node's forward score
    and number of tokens.
    """

    def __init__(self, pieces: Pieces):
        super().__init__()
        self.pieces, self.below, self.scores = pieces, {}, [(0.0, 0)]

    def __missing__(self, word: str) -> int:
        """Tokens of a new pre-token, computed along the part of its path that is new."""
        letters = SPACE + word
        if len(letters) > LONG:
            return self._alone(letters)
        below, scores = self.below, self.scores
        if len(scores) > NODES or len(self) > NODES:
            self.clear()
            below.clear()
            del scores[1:]
        node, path, size = 0, [scores[0]], 0
        for letter in letters:
            size += 1
            key = node * 0x110000 + ord(letter)
            node = below.get(key)
            if node is None:
                node = below[key] = len(scores)
                scores.append(self.pieces.forward(path, letters[:size]))
            path.append(scores[node])
        self[word] = path[-1][1]
        return path[-1][1]

    def _alone(self, letters: str) -> int:
        """A very long pre-token: only the scores that a piece can reach are kept."""
        reach = self.pieces.longest
        path, at = [(0.0, 0)], 0
        for i in range(len(letters)):
            start = max(0, i + 1 - reach)
            path.append(self.pieces.forward(path[start - at :], letters[start : i + 1]))
            if len(path) > 4 * reach:
                path, at = path[-reach:], i + 2 - reach
        return path[-1][1]


_loaded: dict[str, Trie] = {}


def trie(path: str) -> Trie:
    """The trie of a Python worker."""
    if path not in _loaded:
        _loaded[path] = Trie(Pieces(path))
    return _loaded[path]


def count_text(known: Trie, text: str) -> tuple[int, int]:
    """Words and tokens of one whole text."""
    n = total = 0
    parts = [_WORD.findall(text)] if len(text) <= _AT_ONCE else chunks((m.group() for m in _WORD.finditer(text)), _AT_ONCE)
    for part in parts:
        n += len(part)
        total += sum(map(known.__getitem__, part))
    return n, total


def token_counts(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Add ``n_words long, n_tokens long``: pre-tokens of every whole text, and tokens of their best segmentations.

    Pre-tokens are runs without white space and are segmented with a leading ``▁``.  Null and
    empty texts have none.  Other columns stay, those of the added names are replaced; equal texts
    have equal counts.
    """

    @F.arrow_udf("n_words long, n_tokens long")
    def of(column: pa.Array) -> pa.Array:
        known = trie(path)
        words, tokens = zip(*(count_text(known, t) for t in texts(column))) if len(column) else ((), ())
        return pa.StructArray.from_arrays([pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["n_words", "n_tokens"])

    own = [c for c in docs.columns if c not in ("n_words", "n_tokens")]
    return docs.select(*own, of(F.col(text)).alias("_counts")).select(*own, "_counts.n_words", "_counts.n_tokens")
