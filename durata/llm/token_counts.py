r"""Token counts of whole texts, with overlap resynchronisation for huge documents.

A text is encoded in chunks of ``chunk`` bytes that overlap by ``overlap`` bytes. A chunk's
encoding is a list of pieces with byte offsets and token counts; a piece is a maximal run
without ASCII white space. For tokenizers that drop white space (as the default file's does)
no token and no normalisation crosses such white space, so a piece that starts right after
it is a proven stable boundary: both chunks encode everything after it alike. Two chunks are
spliced at the last boundary that both have in their overlap. Where they have none (no white
space in the overlap, so the second chunk starts inside a word), the first chunk is extended
and the overlap widened, at worst to the whole text. Texts within one chunk are one chunk.

Counts of pieces come from the library, once per distinct piece and worker process (a
bounded cache). Facts of the pre-tokenizer spare encodings: it lower-cases, so ASCII capitals do
not matter outside special strings; a run of ASCII symbols (no apostrophe) that ends a piece after
a letter or digit is a word of its own; and letters alone are one word, which the library's model
counts without normalizer and offsets. Letters there are ASCII and Latin-1, which no normal form
changes. Special strings inside texts are handled as the library's default does.

Null texts count as empty (no tokens). Every row gives one row, also repeated rows and null
ids; other columns are not read; empty tables give empty results.
"""

from __future__ import annotations

import re

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer, pre_tokenizers

from durata.llm.common import texts_map

CHUNK = 1 << 16
OVERLAP = 1 << 9
CACHE = 400_000
_PIECE = re.compile(rb"[^\x20\x09-\x0d]+")
_SPACE = b" \t\n\x0b\x0c\r"
#: ASCII symbols that end a piece; an apostrophe may begin a contraction.
_SYMBOLS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Letters that lower-casing and normal forms leave alone, ASCII capitals besides.
_LETTERS = re.compile(rb"(?:[a-zA-Z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
_ENDS_IN_LETTER = re.compile(rb"(?:[a-zA-Z0-9]|\xc3[\x9f-\xb6\xb8-\xbf])\Z")


def split_symbols(piece: bytes) -> tuple[bytes, bytes]:
    """A piece without the symbols that end it, and these; they are counted apart."""
    core = piece.rstrip(_SYMBOLS)
    if len(core) == len(piece) or b"<|" in piece or not _ENDS_IN_LETTER.search(core[-2:]):
        return piece, b""
    return core, piece[len(core) :]


class PieceCounts(dict):
    """Token counts of pieces by a tokenizer file, counted when first asked for and kept."""

    def __init__(self, file: str):
        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        # the characters that stand for a letter's bytes in the model's words
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        letters = [chr(c) for c in range(0xDF, 0x100) if c != 0xF7]
        self.bytes_of = {ord(c): level.pre_tokenize_str(c)[0][0] for c in letters}

    def __missing__(self, piece: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        core, symbols = split_symbols(piece)
        if symbols:
            found = self[core] + self[symbols]
        elif _LETTERS.fullmatch(piece):
            word = piece.lower().decode("utf-8")
            found = len(self.model.tokenize(word if word.isascii() else word.translate(self.bytes_of)))
        else:
            found = len(self.tokenizer.encode_batch_fast([piece.decode("utf-8")], add_special_tokens=False)[0])
        self[piece] = found
        return found

    def total(self, pieces: list[bytes]) -> int:
        return sum(map(self.__getitem__, pieces))


def canonical(text: bytes) -> bytes:
    """ASCII lower case, unless a special string could be meant."""
    return text if b"<|" in text else text.lower()


def character_start(text: bytes, at: int) -> int:
    """The start of the UTF-8 character that covers byte ``at``."""
    while 0 < at < len(text) and text[at] & 0xC0 == 0x80:
        at -= 1
    return at


def encode_chunk(counter: PieceCounts, text: bytes, start: int, stop: int):
    """Offsets and counts of the pieces of text[start:stop]."""
    spans = [m.span() for m in _PIECE.finditer(text, start, stop)]
    counts = np.array([counter[text[a:b]] for a, b in spans], np.int64)
    return np.array([a for a, _ in spans], np.int64), counts


def count_long(counter: PieceCounts, text: bytes, chunk: int, overlap: int) -> int:
    """Tokens of a text by overlapping chunks, spliced at common stable boundaries."""
    n, total = len(text), 0
    begin, stop, wide = 0, character_start(text, min(len(text), chunk)), overlap
    starts, counts = encode_chunk(counter, text, begin, stop)
    while stop < n:
        from_ = character_start(text, max(begin, stop - wide))
        to = character_start(text, min(n, from_ + max(chunk, 2 * wide)))
        next_starts, next_counts = encode_chunk(counter, text, from_, to)
        # a chunk's first piece may be the rest of a word
        sure = next_starts[(next_starts > 0)]
        sure = np.array([s for s in sure[sure < stop] if text[s - 1] in _SPACE], np.int64)
        common = np.intersect1d(sure, starts)
        common = common[common > begin]
        if len(common):
            at = int(common[-1])
            total += int(counts[starts < at].sum())
            keep = next_starts >= at
            starts, counts = next_starts[keep], next_counts[keep]
            begin, stop, wide = at, to, overlap
        else:
            wide *= 2
            stop = character_start(text, min(n, stop + max(chunk, wide)))
            starts, counts = encode_chunk(counter, text, begin, stop)
    return total + int(counts.sum())


_counters: dict[str, PieceCounts] = {}


def counter_for(file: str) -> PieceCounts:
    if file not in _counters:
        _counters[file] = PieceCounts(file)
    return _counters[file]


def token_counts(
    docs: DataFrame, tokenizer: str | None = None, limit: int = 2048, id_col: str = "doc_id",
    text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP,
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row; ``tokenizer`` is a .json file."""
    name = tokenizer

    def fn(texts: list[bytes]) -> list[pa.Array]:
        # the path is looked up where it is read
        counter = counter_for(name or public_tokenizers.path("word_bpe_49k.json"))
        found = [
            counter.total(canonical(t).split()) if len(t) <= chunk
            else count_long(counter, canonical(t), chunk, overlap)
            for t in texts
        ]
        tokens = np.array(found, np.int64)
        size = np.array([len(t) for t in texts], np.int64)
        return [pa.array(size), pa.array(tokens), pa.array(tokens > limit)]

    return texts_map(docs, fn, text, [id_col], "n_bytes long, n_tokens long, over_limit boolean")


def op10_token_counts(docs: DataFrame) -> DataFrame:
    return token_counts(docs)
