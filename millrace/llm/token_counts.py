"""Token counts by heap-and-linked-list byte-pair merging.

The count of a pre-token is its initial symbols minus the merges that
``PairMerger`` does; no identifier is looked up.  Words and pre-tokens are
counted once per worker and remembered in bounded memos.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from millrace.llm.arrow import blocks, id_and_bytes, map_docs, worker_memo
from millrace.llm.vocabulary import MEMO_PIECES, MEMO_WORDS, SYMBOLS, PairMerger, default_vocabulary, pair_merger, shrink, split_word, tokenizer

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


class PieceCounts(dict):
    """pre-token -> tokens."""

    def __init__(self, merger: PairMerger, limit: int):
        super().__init__()
        self.merger, self.limit = merger, limit

    def __missing__(self, piece: str) -> int:
        shrink(self, self.limit)
        symbols = [SYMBOLS[b] for b in piece.encode()]
        n = len(symbols) - self.merger.merge(symbols)[1]
        if len(piece) <= 64:
            self[piece] = n
        return n


class WordCounts(dict):
    """word (bytes, without ASCII white space) -> tokens."""

    def __init__(self, path: str, limit: int = MEMO_WORDS):
        super().__init__()
        self.merger, self.limit = pair_merger(path), limit
        self.pieces = PieceCounts(self.merger, MEMO_PIECES)
        made = tokenizer(path)
        self.normal, self.split = made.normalizer.normalize_str, made.pre_tokenizer.pre_tokenize_str

    def __missing__(self, word: bytes) -> int:
        shrink(self, self.limit)
        split = split_word(word)
        n = self.odd(word.decode("utf-8", "replace")) if split is None else sum(map(self.pieces.__getitem__, split))
        if len(word) <= 256:
            self[word] = n
        return n

    def odd(self, text: str) -> int:
        """Tokens of a word with other than Latin characters or special strings, each of which is one token."""
        total = 0
        while text:
            found = min(((at, -len(s), s) for s in self.merger.special if (at := text.find(s)) >= 0), default=None)
            plain = text if found is None else text[: found[0]]
            for piece, _ in self.split(self.normal(plain)) if plain else []:
                symbols = list(piece)
                total += len(symbols) - self.merger.merge(symbols)[1]
            if found is None:
                break
            total += 1
            text = text[found[0] + len(found[2]) :]
        return total

    def count(self, data: bytes) -> int:
        """Tokens of a text."""
        return sum(sum(map(self.__getitem__, block.split())) for block in blocks(data))


def word_counts(path: str) -> WordCounts:
    """The memo of this Python worker."""
    return worker_memo(("counts", path), lambda: WordCounts(path))


def token_counts(docs: DataFrame, vocabulary: str | None = None, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row.

    One pass without a shuffle.  A null or empty text has 0 bytes and 0 tokens;
    repeated rows give repeated results; a null identifier stays null; an empty
    table gives an empty result.
    """
    path = vocabulary or default_vocabulary()

    def row(doc_id: int | None, body: bytes) -> tuple:
        n = word_counts(path).count(body)
        return doc_id, len(body), n, n > limit

    return map_docs(id_and_bytes(docs, id_col, text_col), row, SCHEMA, ["doc_id", "n_bytes", "n_tokens", "over_limit"])
