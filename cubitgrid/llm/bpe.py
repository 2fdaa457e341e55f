"""BPE by dynamic programming over prefixes.

The last token of the encoding of a prefix is unique: a token t that ends at i is it exactly if t may follow
the last token of the prefix before t. An automaton over all tokens yields the tokens that end at each place;
whether two tokens may stand side by side follows from the merges alone and is remembered per pair. The automaton is
built over the tokens (as Aho and Corasick do): its links lead to the longest token that is a suffix of what was read,
which is what a suffix automaton of the text would be asked for.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import ahocorasick
import numpy as np
import public_tokenizers
import regex
from tokenizers import Tokenizer, pre_tokenizers

from cubitgrid.llm.common import held

#: Fixed values of the vocabulary's pre-tokenizer and special tokens.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
VOCABULARY = "word_bpe_49k.json"
END = "</w>"

#: Characters that str.split() takes for white space and the tokenizer does not; what the tokenizer takes for it.
ODD_SPACE = re.compile("[\x1c-\x1f]")
WHITE = r"[\t-\r\x20\x85\xa0  -     　]+"
FAR = 1 << 62


def byte_letters() -> list[str]:
    """A printable character for each byte: itself where it is printable Latin-1, else the next one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, nxt = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else nxt))
        nxt += b not in plain
    return out


class Remembered(dict):
    """make(key), remembered. Past `most` keys, those not asked for since the last turn are forgotten."""

    def __init__(self, make, most: int = 150_000) -> None:
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str):
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        if len(key) <= 64:
            self[key] = got
        return got


class Letters:
    """Whether the library and the installed Unicode tables fold and cut a text alike.

    Versions of these tables differ in some characters. Each character is asked for once: alone, between letters,
    digits and blanks, and among accents whose order depends on it. `own` gives a text's pieces by the installed tables.
    """

    PROBES = ("{0}", "ab{0}c", "1{0}2 {0} .{0}.", "a\u0315{0}\u0300\u0316{0}\u05b0", "{0}\u0301\u0327x")

    def __init__(self, lib: Tokenizer, own) -> None:
        self.lib, self.own = lib, own
        self.letters = byte_letters()
        self.alike: set[str] = set()
        self.other: set[str] = set()

    def by_library(self, text: str) -> list[str]:
        """Pieces in byte letters."""
        return [p for p, _ in self.lib.pre_tokenizer.pre_tokenize_str(self.lib.normalizer.normalize_str(text))]

    def _same(self, c: str) -> bool:
        texts = [p.format(c) for p in self.PROBES]
        return unicodedata.category(c) != "Cn" and all(self.by_library(t) == ["".join([self.letters[b] for b in p.encode()]) for p in self.own(t)] for t in texts)

    def agree(self, text: str) -> bool:
        chars = set(text)
        for c in chars - self.alike - self.other:
            (self.alike if self._same(c) else self.other).add(c)
        return self.other.isdisjoint(chars)


class Bpe:
    """Encoder and decoder over one vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.letters = byte_letters()
        self.splitter = regex.compile(SPLIT)
        self.specials = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.strings = {i: s for s, i in [*self.vocab.items(), *self.special.items()]}
        self.rank: dict[tuple[str, str], int] = {}
        self.made: dict[str, int] = {}
        self.parts: dict[str, tuple[str, str]] = {}
        for at, (a, b) in enumerate(spec["model"]["merges"]):
            self.rank[a, b] = at
            self.parts[a + b] = a, b
            self.made[a + b] = at
        self.pairs: dict[tuple[str, str], bool] = {}
        self.longest = max(map(len, self.vocab))
        self.pieces = Remembered(self.piece)
        self.tables = Letters(Tokenizer.from_file(path), lambda t: [p for c in self.cut(t) for p in self.splitter.findall(c)])
        self.inner, self.final = self._automaton(False), self._automaton(True)

    def _automaton(self, final: bool) -> ahocorasick.Automaton:
        """final: over the tokens that end a word, without their mark, which must match at a word's end alone."""
        out = ahocorasick.Automaton()
        for t in self.vocab:
            if t.endswith(END) == final and t != END:
                bare = t[: -len(END)] if final else t
                out.add_word(bare, (len(bare), t))
        out.make_automaton()
        return out

    @lru_cache(maxsize=None)  # noqa: B019  one encoder lives as long as its worker
    def spine(self, token: str, side: int) -> tuple[tuple[str, int], ...]:
        """The symbols that stand at one side of the token while it is put together, each with the merge that ends it."""
        out, ends = [], FAR
        while True:
            out.append((token, ends))
            if token not in self.parts:
                return tuple(out)
            ends = self.made[token]
            token = self.parts[token][side]

    def compatible(self, a: str, b: str) -> bool:
        """True if merging a's and b's symbols leaves the border between them as it is."""
        key = a, b
        if (got := self.pairs.get(key)) is None:
            got = True
            for x, x_ends in self.spine(a, 1):
                for y, y_ends in self.spine(b, 0):
                    m = self.rank.get((x, y))
                    if m is not None and m < x_ends and m <= y_ends:
                        got = False
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            self.pairs[key] = got
        return got

    def word(self, letters: str) -> list[str]:
        """Tokens of a word that is written in byte letters."""
        n = len(letters)
        last: list[str | None] = [None] * (n + 1)
        back = [0] * (n + 1)
        known, test = self.pairs.get, self.compatible
        for end, (size, token) in self.inner.iter(letters):
            end += 1
            if last[end] is None and end < n:
                j = end - size
                if j:
                    before = last[j]
                    if before is None:
                        continue
                    ok = known((before, token))
                    if not (test(before, token) if ok is None else ok):
                        continue
                last[end], back[end] = token, j
        tail = letters[-self.longest :]
        for end, (size, token) in self.final.iter(tail):
            if end + 1 == len(tail) and last[n] is None:
                j = n - size
                if j == 0 or (last[j] is not None and self.compatible(last[j], token)):
                    last[n], back[n] = token, j
        out, i = [], n
        while i:
            out.append(last[i])
            i = back[i]
        return out[::-1]

    def piece(self, text: str) -> list[str]:
        return self.word("".join([self.letters[b] for b in text.encode()]))

    def chunk(self, text: str) -> list[str]:
        """Tokens of a folded text without white space and special tokens."""
        found = self.splitter.findall(text)
        return self.pieces[found[0]] if len(found) == 1 else [t for piece in found for t in self.pieces[piece]]

    def cut(self, text: str) -> list[str]:
        """Normalised, in lower case, cut at white space."""
        low = text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return [x for x in re.split(WHITE, low) if x] if ODD_SPACE.search(low) else low.split()

    def chunks(self, text: str) -> list[str]:
        """The text cut at white space, with special tokens on their own, a blank before them; where the tables differ,
        the library's pieces in byte letters, a tab before them."""
        alike = text.isascii() or self.tables.agree(text)
        cut = self.cut if alike else lambda t: ["\t" + p for p in self.tables.by_library(t)]
        if "<|" not in text or not self.specials:
            return cut(text)
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += [*cut(text[at : m.start()]), " " + m.group()]
            at = m.end()
        return out + cut(text[at:])

    def ids(self, chunk: str) -> list[int]:
        if chunk[0] == " ":
            return [self.special[chunk[1:]]]
        if chunk[0] == "\t":
            return [self.vocab[t] for t in self.word(chunk[1:])]
        return [self.vocab[t] for t in self.chunk(chunk)]

    def decode(self, ids: list[int]) -> str:
        """The tokens' strings, joined by spaces, as the library does for a file without a decoder."""
        return " ".join([self.strings[i] for i in ids])


@lru_cache(maxsize=1)
def load(name: str = VOCABULARY) -> Bpe:
    return Bpe(public_tokenizers.path(name))


def encoder(name: str = VOCABULARY) -> Bpe:
    """Once for each Python worker; the file is part of the installed vocabulary package."""
    return held(("encoder", name), lambda: Bpe(public_tokenizers.path(name)))


def entries(name: str = VOCABULARY) -> tuple[Bpe, Remembered]:
    """For each chunk: number of ids, ids as decimal text, decoded text."""

    def new() -> tuple[Bpe, Remembered]:
        b = Bpe(public_tokenizers.path(name))

        def make(chunk: str) -> tuple[int, str, str]:
            ids = b.ids(chunk)
            return len(ids), " ".join(map(str, ids)), b.decode(ids)

        return b, Remembered(make, 250_000)

    return held(("entries", name), new)


#: Pieces of texts whose ids a worker remembers.
REMEMBERED = 500_000


def library_ids(name: str = VOCABULARY, remembered: int = REMEMBERED) -> LibraryIds:
    return held(("library", name, remembered), lambda: LibraryIds(name, remembered))


class LibraryIds:
    """Ids of whole texts by the tokenizers library, as little-endian unsigned 32-bit numbers.

    The library is asked once for each distinct piece: texts are cut as it cuts them, and all new pieces of some
    texts go to it in one call, which the ids of tokens that end a piece part again. Texts with special tokens or
    with characters that its Unicode tables treat otherwise than the installed ones go to it whole.
    """

    ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+").findall

    def __init__(self, name: str, most: int = REMEMBERED) -> None:
        self.lib = Tokenizer.from_file(public_tokenizers.path(name))
        # pieces are normalised, cut and in byte letters already: for them the library's merges are needed alone, which both share
        self.bare = Tokenizer(self.lib.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.letters = "".join([" " if b == 32 else c for b, c in enumerate(byte_letters())])
        self.lib.no_padding()
        self.lib.no_truncation()
        vocab = self.lib.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for s, i in vocab.items() if s.endswith(END)]] = True
        self.any = regex.compile(SPLIT).findall
        self.tables = Letters(self.lib, self.folded)
        self.most, self.known = most, {}

    def whole(self, text: str) -> bytes:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def pieces(self, text: str) -> list[str] | None:
        """The text's pieces; None if the library has to see it whole."""
        if "<|" in text:
            return None
        if text.isascii():
            return self.ASCII(text.lower())
        return self.folded(text) if self.tables.agree(text) else None

    def folded(self, text: str) -> list[str]:
        return self.any(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def learn(self, pieces: set[str]) -> None:
        if len(self.known) + len(pieces) > self.most:
            self.known.clear()
        new = [p for p in pieces if p not in self.known]  # a difference of sets goes through all known ones
        if not new:
            return
        text = " ".join(new).encode().decode("latin-1").translate(self.letters)
        # the one call that doesn't also work out where tokens stand
        ids = np.array(self.bare.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        raw, at, ends = ids.tobytes(), 0, (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        for p, end in zip(new, ends, strict=True):
            self.known[p] = raw[at:end]
            at = end

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [self.pieces(t) for t in texts]
        pieces = set().union(*[c for c in cut if c])
        self.learn(pieces)
        get = self.known.get
        out = [self.whole(t) if c is None else b"".join(map(get, c)) for t, c in zip(texts, cut, strict=True)]
        for p in [p for p in pieces if len(p) > 64]:
            del self.known[p]
        return out
