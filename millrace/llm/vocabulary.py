"""The word-level BPE vocabulary: how words become pre-tokens, how pairs merge, and memos of whole words.

The tokenizer's normaliser works character by character (NFC, white space to a
blank, lower case) and its pre-tokenizer's pattern never crosses white space.
ASCII white space is neither composed by NFC nor part of a special string, so
the tokens of a text are the tokens of its white-space separated words, one
after the other.  Words repeat far more than texts do; a memo keeps each
worker's words, and drops the long (rare) ones when it reaches its bound.

Words of Latin characters only are split here; any other word, and any that may
hold a special string, is given to the library.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from functools import lru_cache
from struct import pack

import numpy as np

from millrace.llm.arrow import blocks, worker_memo

#: Entries kept by the memo of words and by that of pre-tokens.
MEMO_WORDS, MEMO_PIECES = 600_000, 300_000
#: Words up to so many bytes stay when a memo is full.
SHORT = 7
#: Characters below this are split here, if their lower case is one character below it, too; NFC leaves them as they are.
LATIN_END = 0x250
#: The contractions of the pre-tokenizer's pattern, tried before letters.
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"


def default_vocabulary() -> str:
    """Place of the public word-level vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


def _class_of(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(33, LATIN_END) if unicodedata.category(chr(c))[0] == kind)


def _plain_pattern() -> re.Pattern:
    """Words of Latin characters other than spaces and controls, each with a lower case of one character that PIECES knows."""
    known = [chr(c) for c in range(33, LATIN_END) if unicodedata.category(chr(c))[0] not in "CZ"]
    odd = "".join(re.escape(c) for c in known if len(c.lower()) == 1 and ord(c.lower()) < LATIN_END)
    return re.compile(f"[{odd}]+")


PLAIN = _plain_pattern()
PIECES = re.compile(f"{CONTRACTIONS}|[{_class_of('L')}]+|[{_class_of('N')}]|[^\\s{_class_of('L')}{_class_of('N')}]+")


def _byte_symbols() -> list[str]:
    """One printable character for each byte: itself where it is printable Latin-1, else the next from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


SYMBOLS = _byte_symbols()


def split_word(word: bytes) -> list[str] | None:
    """Pre-tokens of a word without ASCII white space, in plain lower-case characters; None: the library must do it."""
    text = word.decode("utf-8", "replace")
    if PLAIN.fullmatch(text) and "<|" not in text:
        return PIECES.findall(text.lower())
    return None


class PairMerger:
    """Merges the symbols of a pre-token by a heap of pairs over a linked list.

    Symbols start as one per byte, the last with the word-end mark.  Every
    adjacent pair that has a rule lies in a heap under (rank, place).  The
    lowest is popped, checked against the list (an older entry may name a
    symbol that is gone) and merged; the new neighbour pairs are pushed.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        self.end = held["model"]["end_of_word_suffix"] or ""
        pairs = (m if isinstance(m, list) else m.split(" ") for m in held["model"]["merges"])
        self.ranks = {tuple(pair): rank for rank, pair in enumerate(pairs)}
        self.special = [x["content"] for x in held["added_tokens"]]

    def merge(self, symbols: list[str]) -> tuple[list[str], int]:
        """What the symbols (changed in place) merge to, gone ones as "", and the number of merges."""
        n = len(symbols)
        symbols[-1] += self.end
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        rank = self.ranks.get
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if (r := rank((a, b))) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if symbols[i] != a or j < 0 or symbols[j] != b:
                continue
            both = a + b
            symbols[i], symbols[j] = both, ""
            right[i] = k = right[j]
            if k >= 0:
                left[k] = i
                if (r := rank((both, symbols[k]))) is not None:
                    heapq.heappush(heap, (r, i, both, symbols[k]))
            h = left[i]
            if h >= 0 and (r := rank((symbols[h], both))) is not None:
                heapq.heappush(heap, (r, h, symbols[h], both))
            merges += 1
        return symbols, merges


@lru_cache(maxsize=1)
def pair_merger(path: str) -> PairMerger:
    return PairMerger(path)


def shrink(memo: dict, limit: int) -> None:
    """Drop the long entries of a full memo, or all if that isn't half of them."""
    if len(memo) >= limit:
        for key in [k for k in memo if len(k) > SHORT]:
            del memo[key]
        if len(memo) > limit // 2:
            memo.clear()


class PieceIds(dict):
    """pre-token -> its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, limit: int):
        super().__init__()
        self.model, self.limit = tokenizer(path).model, limit

    def __missing__(self, piece: str) -> bytes:
        shrink(self, self.limit)
        coded = self.model.tokenize("".join([SYMBOLS[b] for b in piece.encode()]))
        ids = pack(f"<{len(coded)}I", *[x.id for x in coded])
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class WordIds(dict):
    """word (bytes) -> its ids as little-endian unsigned 32-bit bytes; an unknown word is encoded when it is looked up."""

    def __init__(self, path: str, limit: int = MEMO_WORDS):
        super().__init__()
        self.tokenizer, self.pieces, self.limit = tokenizer(path), PieceIds(path, MEMO_PIECES), limit

    def __missing__(self, word: bytes) -> bytes:
        shrink(self, self.limit)
        split = split_word(word)
        if split is None:
            ids = np.array(self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()
        elif len(split) == 1:
            ids = self.pieces[split[0]]
        else:
            ids = b"".join(map(self.pieces.__getitem__, split))
        if len(word) <= 256:
            self[word] = ids
        return ids

    def encode(self, data: bytes) -> bytes:
        """Token ids of a text as little-endian unsigned 32-bit bytes."""
        return b"".join(b"".join(map(self.__getitem__, block.split())) for block in blocks(data))


def word_memo(path: str) -> WordIds:
    """The memo of this Python worker."""
    return worker_memo(("ids", path), lambda: WordIds(path))
