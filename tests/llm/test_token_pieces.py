"""Token counts of pieces: letters and the symbols after them need no full encoding."""

from __future__ import annotations

import random

import public_tokenizers
from tokenizers import Tokenizer

from durata.llm import token_counts
from durata.llm.token_counts import PieceCounts, canonical

FILE = public_tokenizers.path("word_bpe_49k.json")


class NoEncoding:
    def encode_batch_fast(self, *args, **kwargs):
        raise AssertionError("a word of letters went through the whole encoder")


def test_pieces_count_as_the_library_counts_them(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE", 100)
    tokenizer, counts = Tokenizer.from_file(FILE), PieceCounts(FILE)
    rng = random.Random(5)
    signs = [*"abXZ'\".,%&#<>|=-_/\\019", *"éÉßÿ÷×ñºªΩİ日…»̸́­", "<|endoftext|>", "<|", "'s", "'re"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(1, 7))) for _ in range(4000)]
    pieces = {p for t in texts for p in canonical(t.encode()).split()}
    for p in pieces:
        assert counts[p] == len(tokenizer.encode(p.decode(), add_special_tokens=False).ids), p
    assert len(counts) <= 102


def test_words_of_letters_are_not_encoded_whole():
    counts = PieceCounts(FILE)
    for run in (b"%%%", b"&&&", b".", b","):
        counts[run]
    tokenizer, counts.tokenizer = counts.tokenizer, NoEncoding()
    for word in ("rendblean%%%", "écoutée&&&", "größe.", "Word,", "ÿïa"):
        want = len(tokenizer.encode(word, add_special_tokens=False).ids)
        assert counts[word.encode()] == want
