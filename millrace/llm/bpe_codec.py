"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the last bytes of a text decides where chunks end, so a
passage that several documents share is cut alike in each of them.  A chunk is
encoded once per Python worker and reused (the memo of chunks is bounded); to
share chunks between workers, all text and all ids would have to be shuffled,
which costs more than encoding them.
Chunk ends may fall inside a word, so each join is repaired: the last words
before it and the first words after it are encoded as one string, and the ids
of the word across the join are taken from there once the ids of the words on
both sides agree with what the two chunks say; else the window is doubled.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from millrace.llm.arrow import blocks, id_and_bytes, map_docs, worker_memo
from millrace.llm.vocabulary import WordIds, default_vocabulary, tokenizer

#: Bytes that the rolling hash sees; mean and least bytes of a chunk.
ROLL_BYTES, MEAN_CHUNK, LEAST_CHUNK = 16, 256, 32
#: No chunk ends inside a run without white space that is longer than this: a word's ids depend on the whole of it,
#: so a join inside it could be repaired only by encoding the run again.
LONG_RUN = 1024
#: Bytes of text that the chunk memo of a worker holds before it is emptied.
CHUNK_MEMO_BYTES = 8 << 20
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


@lru_cache(maxsize=1)
def _values() -> np.ndarray:
    """A fixed pseudo-random 64-bit value for each byte."""
    return np.random.default_rng(20).integers(0, 2**64, 256, np.uint64)


def chunk_ends(data: bytes) -> list[int]:
    """Ends of the content-defined chunks of ``data``; the last is len(data).

    The hash at a byte is the sum of the values of the last ROLL_BYTES bytes,
    each shifted by its age; it is built from windows of 1, 2, 4, ... bytes.
    """
    n = len(data)
    if n <= 2 * LEAST_CHUNK:
        return [n]
    raw = np.frombuffer(data, np.uint8)
    h, width = _values()[raw], 1
    while width < ROLL_BYTES:
        h[width:] = h[width:] + (h[:-width] << np.uint64(width))
        width *= 2
    cuts = np.flatnonzero((h[:-1] >> np.uint64(20)) % np.uint64(MEAN_CHUNK) == 0) + 1
    cuts = cuts[(raw[cuts] & 0xC0) != 0x80]
    if len(cuts):
        space = np.flatnonzero((raw == 32) | ((raw >= 9) & (raw <= 13)))
        edges = np.concatenate(([-1], space, [n]))
        right = np.searchsorted(edges, cuts)
        cuts = cuts[edges[right] - edges[right - 1] <= LONG_RUN]
    ends, at = [], 0
    for cut in cuts.tolist():
        if cut - at >= LEAST_CHUNK:
            ends.append(cut)
            at = cut
    return [*ends, n]


class ChunkCodec:
    """Encodes texts chunk by chunk; ``memo`` maps a chunk to its words and the ids of each."""

    def __init__(self, path: str):
        self.tokenizer, self.words = tokenizer(path), WordIds(path)
        self.memo: dict[bytes, tuple[list[bytes], list[bytes]]] = {}
        self.held = self.reused = self.made = self.repaired = self.widened = 0
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.pieces = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            self.pieces[i] = piece.encode()

    def chunk(self, piece: bytes) -> tuple[list[bytes], list[bytes]]:
        """The chunk's words and the ids of each, as if the chunk stood alone."""
        known = self.memo.get(piece)
        if known is not None:
            self.reused += 1
            return known
        words = piece.split()
        ids = list(map(self.words.__getitem__, words))
        self.held += len(piece)
        if self.held > CHUNK_MEMO_BYTES:
            self.memo.clear()
            self.held = len(piece)
        self.memo[piece] = words, ids
        self.made += 1
        return words, ids

    def repair(self, left: list[bytes], left_ids: list[bytes], right: list[bytes], right_ids: list[bytes]) -> bytes:
        """Ids of the word made of left[-1] and right[0], from windows that agree with both sides."""
        self.repaired += 1
        reach = 2
        while True:
            a, b = left[-reach:], right[:reach]
            window = (b" ".join(a) + b" ".join(b)).decode("utf-8", "replace")
            got = np.array(self.tokenizer.encode(window, add_special_tokens=False).ids, "<u4").tobytes()
            before, after = b"".join(left_ids[-len(a) : -1]), b"".join(right_ids[1 : len(b)])
            if len(before) + len(after) <= len(got) and got.startswith(before) and got.endswith(after):
                return got[len(before) : len(got) - len(after)]
            if reach >= len(left) and reach >= len(right):
                raise ValueError("chunk encodings never agree with their joined text")
            self.widened += 1
            reach *= 2

    def encode(self, data: bytes) -> bytes:
        """Token ids of the whole text as little-endian unsigned 32-bit bytes."""
        out: list[bytes] = []
        for block in blocks(data):
            words: list[bytes] = []  # of the block so far
            ids: list[bytes] = []
            at = 0
            for end in chunk_ends(block):
                new, new_ids = self.chunk(block[at:end])
                inside = at and words and new and not block[at - 1 : at].isspace() and not block[at : at + 1].isspace()
                if inside:
                    ids[-1] = self.repair(words, ids, new, new_ids)
                    words[-1] += new[0]
                    words += new[1:]
                    ids += new_ids[1:]
                else:
                    words += new
                    ids += new_ids
                at = end
            out += ids
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """The decoded text in UTF-8: the vocabulary has no decoder, so its pieces joined by blanks."""
        return b" ".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def chunk_codec(path: str) -> ChunkCodec:
    """The codec of this Python worker."""
    return worker_memo(("codec", path), lambda: ChunkCodec(path))


def encode_documents(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded string): the ids of each text and the text decoded from them.

    Null texts count as empty and have no ids; null identifiers stay null; texts
    of any length are encoded whole; repeated rows give repeated results; an
    empty table gives none.  Other columns are never read.
    """
    path = vocabulary or default_vocabulary()

    def row(doc_id: int | None, body: bytes) -> tuple:
        ids = chunk_codec(path).encode(body)
        return doc_id, np.frombuffer(ids, "<u4").tolist(), chunk_codec(path).decode(ids).decode("utf-8", "replace")

    return map_docs(id_and_bytes(docs, id_col, text_col), row, "doc_id long, ids array<long>, decoded string", ["doc_id", "ids", "decoded"])


def codec_digests(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): as encode_documents, digests in place of the ids and texts.

    One pass without a shuffle.  Null or empty texts have 0 tokens and the
    digests of nothing; repeated rows give repeated results; null identifiers
    stay null; an empty table gives no rows.
    """
    path = vocabulary or default_vocabulary()

    def row(doc_id: int | None, body: bytes) -> tuple:
        codec = chunk_codec(path)
        ids = codec.encode(body)
        return doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()

    return map_docs(id_and_bytes(docs, id_col, text_col), row, SCHEMA, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
