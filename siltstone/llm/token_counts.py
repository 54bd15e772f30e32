"""Token counts of a unigram vocabulary, by dynamic programming over a trie.

A text's pre-tokens are its white-space separated words, each behind a word mark.
The distinct pre-tokens of a batch are the words of a trie, walked depth first in
sorted order: a node's forward score (best sum of piece scores that ends there)
and its token count follow from its ancestors', so a prefix that many pre-tokens
share is scored once. The counts at terminal nodes are stored and looked up.
"""

from __future__ import annotations

import math
import os

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "\u2581"
CACHE_WORDS = 300_000


def unigram(path: str) -> dict[str, float]:
    """Piece -> score of a sentencepiece file: Zipf's law by rank in its list of pieces.

    The file's own scores only order merges; -log(rank + 2.7) makes a unigram of it.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return {p: -math.log(r + 2.7) for r, p in enumerate(found)}


class PrefixTrie:
    """Forward scores of the nodes of a trie, walked word by word in sorted order."""

    def __init__(self, pieces: dict[str, float]):
        self.pieces, self.longest = pieces, max(map(len, pieces), default=1)
        #: A character that no piece holds falls back to its UTF-8 bytes, each a token.
        self.byte = min(pieces.values(), default=0.0) - 10

    def counts(self, words: set[str]) -> dict[str, int]:
        """Tokens of the best segmentation of each word; ties go to fewer tokens."""
        pieces, longest, byte = self.pieces, self.longest, self.byte
        path, score, tokens = "", [0.0], [0]  # the nodes on the path from the root
        out = {}
        for word in sorted(words):
            d = len(os.path.commonprefix((path, word)))
            del score[d + 1 :], tokens[d + 1 :]
            for end in range(d + 1, len(word) + 1):
                best, n = -math.inf, 0
                for start in range(max(0, end - longest), end):
                    s = pieces.get(word[start:end])
                    if s is None:
                        if start < end - 1:
                            continue
                        k = len(word[start].encode("utf-8", "surrogatepass"))
                        s = byte * k
                    else:
                        k = 1
                    s += score[start]
                    k += tokens[start]
                    if s > best or s == best and k < n:
                        best, n = s, k
                score.append(best)
                tokens.append(n)
            path = word
            out[word] = tokens[-1]
        return out


def _count(path: str):
    def run(batches):
        trie, known = PrefixTrie(unigram(path)), {}
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                split = [t.split() if t else [] for t in part.column(part.num_columns - 1).to_pylist()]
                if len(known) > CACHE_WORDS:
                    known = {}
                new = {MARK + w for ws in split for w in ws if w not in known}
                known.update((w[1:], n) for w, n in trie.counts(new).items())
                made = [pa.array([sum(known[w] for w in ws) for ws in split], pa.int64()), pa.array([len(ws) for ws in split], pa.int64())]
                yield pa.record_batch([*part.columns[:-1], *made], names=[*part.schema.names[:-1], "n_tokens", "n_pretokens"])

    return run


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_tokens, n_pretokens.

    A null, empty or blank text has none. Repeated rows keep a row each, other
    columns aren't read, an empty table gives an empty result.
    """
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(_count(vocabulary), f"id {chosen.schema['id'].dataType.simpleString()}, n_tokens long, n_pretokens long")
