"""Tokenizer of whole texts: ids of the tokenizers library, by way of a bounded cache of words.

The tokenizer drops white space and no token or normal form reaches across it, so that a text's ids are those of its
words put together. A new word of ASCII signs and lower-case Latin-1 letters is parted as the tokenizer parts it, into
runs of letters, digits and runs of signs; new runs of letters, which have no other form and are never parted, go to
the library's merges in one call, and each run's last token tells its end. Words with other characters and texts that may hold a special token's string go
to the library as they are.

The cache is bounded by CACHE_BYTES and belongs to a stage: a worker's next stage, of whatever operator, drops it (see
`stage_caches`). A word too many is encoded again where it comes again. A text of one very long word is one call of
the library.
"""

from __future__ import annotations

import os
import re
from functools import cache

import numpy as np

from noctua.llm.words import stage_caches

CACHE_BYTES = 96 << 20
ENTRY_BYTES = 160  # of the two objects of a word and its place in the table
CALL_WORDS = 1000
MARK = b" 0 "  # a digit is a token of its own
#: Lower-case letters of Latin-1 in UTF-8.
LETTER = rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])"
LETTERS, PLAIN = re.compile(LETTER + rb"+"), re.compile(rb"(?:[\x21-\x7e]|" + LETTER + rb")+")
#: Fixed value: how the tokenizer parts a plain word.
RUNS = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|" + LETTER + rb"+|[0-9]|[^\sa-z0-9\x80-\xff]+")


class WordEncoder:
    def __init__(self, file: str):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.letters = Tokenizer.from_file(file), Tokenizer.from_file(file)
        bytewise = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters.normalizer, self.letters.pre_tokenizer = None, pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), bytewise])
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        (self.mark,) = np.frombuffer(self.raw("0"), "<u4")
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, bytes] = {}
        self.held = 0

    def raw(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def of_letters(self, words: list[bytes]) -> dict[bytes, bytes]:
        """The ids of runs of letters, many in a call."""
        out = {}
        for at in range(0, len(words), CALL_WORDS):
            some = words[at : at + CALL_WORDS]
            text = b" ".join(some).decode().split()
            ids = np.array(self.letters.encode_batch_fast([text], is_pretokenized=True, add_special_tokens=False)[0].ids, "<u4")
            raw, ends = ids.tobytes(), (4 * np.flatnonzero(self.last[ids]) + 4).tolist()
            out.update(zip(some, [raw[b:e] for b, e in zip([0, *ends[:-1]], ends, strict=True)], strict=True))
        return out

    def of_others(self, words: list[bytes]) -> dict[bytes, bytes]:
        """The ids of any words, many in a call, parted at marks; one by one where a word's normal form holds the mark."""
        out = {}
        for at in range(0, len(words), CALL_WORDS):
            some = words[at : at + CALL_WORDS]
            raw = self.raw(MARK.join(some).decode("utf-8", "replace"))
            ends = (4 * np.flatnonzero(np.frombuffer(raw, "<u4") == self.mark)).tolist()
            if len(ends) == len(some) - 1:
                out.update(zip(some, [raw[b:e] for b, e in zip([0, *[e + 4 for e in ends]], [*ends, len(raw)], strict=True)], strict=True))
            else:
                out.update((w, self.raw(w.decode("utf-8", "replace"))) for w in some)
        return out

    def learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        """The ids of words that are not known, and of the runs they are made of."""
        letters = {w for w in words if LETTERS.fullmatch(w)}
        signed = [w for w in words if w not in letters and PLAIN.fullmatch(w)]
        split = [RUNS.findall(w) for w in signed]
        runs = set().union(*split).difference(self.known)
        letters.update(w for w in runs if LETTERS.match(w))
        out = self.of_letters(list(letters))
        out.update((w, self.raw(w.decode())) for w in runs if w not in letters)
        known = self.known
        out.update([(w, b"".join([out[r] if r in out else known[r] for r in rs])) for w, rs in zip(signed, split, strict=True)])
        foreign = words.difference(letters, signed)
        out.update(self.of_others([w for w in foreign if b"0" not in w]))
        out.update((w, self.raw(w.decode("utf-8", "replace"))) for w in foreign if b"0" in w)
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; null: none."""
        known, split, new = self.known, [], set()
        for text in texts:
            raw = (text or "").encode("utf-8", "replace")
            words = None if b"<|" in raw else raw.lower().split()
            split.append(words)
            if words:
                new |= set(words).difference(known)
        learnt = self.learn(new)
        known.update(learnt)
        out = [self.raw(text) if words is None else b"".join(map(known.__getitem__, words)) for text, words in zip(texts, split, strict=True)]
        size = sum(map(len, learnt)) + sum(map(len, learnt.values())) + ENTRY_BYTES * len(learnt)
        if self.held + size > CACHE_BYTES:  # a stage's first words are the common ones: later ones stay for their batch only
            for w in learnt:
                del known[w]
        else:
            self.held += size
        return out


@cache
def vocabulary_encoder(file: str) -> WordEncoder:
    return WordEncoder(file)


def encoder(file: str) -> WordEncoder:
    """One a Python worker. To be called at the beginning of a task: what another stage learnt is dropped."""
    found = vocabulary_encoder(file)
    stage_caches(found)
    return found


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
