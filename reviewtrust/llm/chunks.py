"""Exact token ids of long texts from memoised chunks.

The tokenizers' pre-tokens never cross certain places between characters, so a text may be cut
there and each distinct chunk encoded once by the library itself:

* byte-level vocabularies: before a single space or newline that is followed by a character that is not white space
  (the split pattern always starts a new pre-token at the last white space of a run);
* word vocabularies that drop white space: at every space and newline.

A chunk of letters that ends in punctuation marks is cut before the marks as well. Where the tokenizer itself
lower-cases, plain ASCII pieces are remembered in lower case. Anything unusual goes to the library in larger
pieces, and a text that holds an added token of the tokenizer's file (in any case) goes there whole, since the library
takes those out before anything else. The memo is bounded in bytes and starts anew when full.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Callable

import numpy as np

_ODD_SPACE = re.compile(r"[ \n](?:\s|\Z)")
_CUT = re.compile(r"(?=[ \n]\S)")
#: No apostrophe: it starts contractions.
_MARKS = ".,;:!?*#$%&"
#: Bytes that one encoder's memo may take, and what an entry takes besides its characters and ids.
LIMIT = 128 << 20
WORD_LIMIT = 320 << 20
_ENTRY = 220
#: Words encoded as one text where their ends can be told from the ids.
_JOINED = 1_000


def _plain_word(text: str) -> bool:
    """Letters that stay letters when normalised and lower-cased: one pre-token.

    The lower-cased capital I with a dot ends in a combining mark, which would join the punctuation, and so do
    the letters that NFC takes apart.
    """
    return text.isalpha() and (text.isascii() or ("İ" not in text and unicodedata.is_normalized("NFC", text)))


def _pieces(chunk: str) -> list[str]:
    """``chunk`` cut where a pre-token surely ends."""
    lead = chunk[:1] == "\n"
    body = chunk[1:] if lead else chunk
    head = ["\n"] if lead and body else []
    word = body.rstrip(_MARKS)
    if len(word) < len(body) and _plain_word(word[1:] if word[:1] == " " else word):
        return [*head, word, body[len(word) :]]
    return [*head, body] if body else [chunk]


class ChunkEncoder:
    """``encode(text)`` gives the ids of a text as little-endian unsigned 32-bit integers.

    ``library(texts)`` encodes a list of strings to such bytes each; ``spaces`` tells whether
    white space belongs to the tokens, ``lower`` whether the library lower-cases ASCII letters itself, ``added`` which
    strings it takes out of a text first. ``limit`` bounds the memo in bytes.
    """

    def __init__(
        self,
        library: Callable[[list[str]], list[bytes]],
        spaces: bool,
        limit: int = LIMIT,
        lower: bool = False,
        added: tuple[str, ...] = (),
    ):
        self._library, self._spaces, self._lower = library, spaces, lower
        self._added, self._opening = tuple(a.lower() for a in added), os.path.commonprefix([a.lower() for a in added])
        self._by_chunk: dict[str, bytes] = {}
        # Without white space in the tokens a piece is a chunk as well: one memo serves both.
        self._by_piece: dict[str, bytes] = {} if spaces else self._by_chunk
        self._limit, self._held = limit, 0

    def _learn(self, wanted: set[str], whole: Callable[[str], str]) -> None:
        known, cut = self._by_piece, {c: _pieces(whole(c)) for c in wanted}
        fresh = list({p for pieces in cut.values() for p in pieces if p not in known})
        known.update(zip(fresh, self._library(fresh), strict=True))
        joined = [(c, known[p[0]] if len(p) == 1 else b"".join([known[x] for x in p])) for c, p in cut.items()]
        self._by_chunk.update(joined)
        self._held += sum(_ENTRY + len(c) + len(v) for c, v in joined) + sum(_ENTRY + len(p) + len(known[p]) for p in fresh)

    def _known(self, chunks: list[str], whole: Callable[[str], str]) -> bytes:
        if self._held > self._limit:
            self._by_chunk.clear()
            self._by_piece.clear()
            self._held = 0
        found = list(map(self._by_chunk.get, chunks))
        if None in found:
            missing = {c for c, v in zip(chunks, found, strict=True) if v is None}
            if sum(map(len, missing)) + _ENTRY * len(missing) > self._limit:  # one enormous text
                return b"".join(self._library([whole(c) for c in chunks]))
            self._learn(missing, whole)
            found = map(self._by_chunk.__getitem__, chunks)
        return b"".join(found)

    def _as_lower(self, chunk: str) -> str:
        return chunk.lower() if self._lower and chunk.isascii() else chunk

    def _holds_added(self, text: str) -> bool:
        # The opening is looked for first where case can't matter to it: a cheap search that nearly no text passes.
        if not self._added or (self._opening.upper() == self._opening and self._opening not in text):
            return False
        low = text.lower()
        return any(a in low for a in self._added)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self._holds_added(text):
            return self._library([text])[0]
        if not self._spaces:
            return self._known([c for c in text.replace("\n", " ").split(" ") if c], self._as_lower)
        if _ODD_SPACE.search(text):
            return b"".join(self._library(_CUT.split(text)))
        head, *rest = text.replace("\n", " \n").split(" ")
        first = self._library([head])[0] if head else b""
        return first + self._known(rest, lambda c: c if c[0] == "\n" else f" {c}")


#: The split pattern of word vocabularies, without the added tokens, and the same for texts of ASCII and Latin letters.
_WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LATIN = "a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u024f"
_FIND_WORDS = re.compile(rf"[{_LATIN}]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[\x00-\x08\x0e-\x1f!-/:-@\[-`{{-\x7f]+").findall
#: Latin letters end here; beyond, lower case may depend on neighbours.
_LATIN_END = 0x250


def _latin(char: str) -> bool:
    """A letter that is one letter when lower-cased and normalised."""
    low = char.lower()
    return ord(char) < _LATIN_END and char.isalpha() and len(low) == 1 and unicodedata.category(char)[0] == "L" and unicodedata.is_normalized("NFC", char + low)


class _Generation(dict):
    """A memo of strings' ids that makes what it lacks, or takes it from the memo before it."""

    def __init__(self, make: Callable[[str], bytes], old: dict[str, bytes]):
        super().__init__()
        self._make, self._old, self.held = make, old, 0

    def __missing__(self, item: str) -> bytes:
        value = self._old.get(item)
        if value is None:
            value = self._make(item)
        self[item] = value
        self.held += _ENTRY + len(item) + len(value)
        return value

    def next(self) -> _Generation:
        """An empty memo after this one."""
        self._old = {}
        return _Generation(self._make, self)


class WordEncoder(ChunkEncoder):
    """The same for a vocabulary that marks the last token of each word, lower-cases and splits as ``_WORD_SPLIT`` does.

    A text of ASCII and Latin letters is split here, and ``word(string)`` gives the ids of a new pre-token; other texts go
    the way of chunks.
    """

    def __init__(self, library, word: Callable[[str], bytes], memo: int = WORD_LIMIT, **options):
        super().__init__(library, False, **options)
        self._safe, self._memo = set(map(chr, range(128))), memo
        # What is met again stays: each memo is followed by an empty one when it is half full.
        self._chunks, self._words = _Generation(self._of_chunk, {}), _Generation(word, {})

    def encode(self, text: str | None) -> bytes:
        if not text or not self._splits(text) or self._holds_added(text):
            return super().encode(text)
        if self._chunks.held > self._memo // 3:
            self._chunks = self._chunks.next()
        if self._words.held > self._memo // 6:
            self._words = self._words.next()
        return b"".join(map(self._chunks.__getitem__, text.lower().replace("\n", " ").split(" ")))

    def _of_chunk(self, chunk: str) -> bytes:
        words = _FIND_WORDS(chunk)
        return self._words[words[0]] if len(words) == 1 else b"".join(map(self._words.__getitem__, words))

    def _splits(self, text: str) -> bool:
        if text.isascii():
            return True
        others = set(text) - self._safe
        fine = {c for c in others if _latin(c)}
        self._safe |= fine
        return len(fine) == len(others)


def tokenizer_library(content: str) -> Callable[[list[str]], list[bytes]]:
    """The tokenizers library on a tokenizer file's content: no added special tokens, truncation or padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has one task for each core already
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(content)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    def encode(texts: list[str]) -> list[bytes]:
        encoded = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in encoded]

    return encode


def word_library(content: str) -> Callable[[list[str]], list[bytes]]:
    """The same ids for a vocabulary that marks the last token of each word: plain words go to the library many at a
    time, as one text, and its ids are cut after the marked tokens."""
    library, model = tokenizer_library(content), json.loads(content)["model"]
    suffix, vocabulary = model["end_of_word_suffix"], model["vocab"]
    last = np.zeros(max(vocabulary.values()) + 1, bool)
    last[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True

    def encode_words(words: list[str]) -> list[bytes]:
        coded = library([" ".join(words)])[0]
        cuts = ((np.flatnonzero(last[np.frombuffer(coded, "<u4")]) + 1) * 4).tolist()
        # A word gives one end at least, so the numbers agree only if every word gave exactly one.
        return [coded[a:b] for a, b in zip([0, *cuts], cuts, strict=False)] if len(cuts) == len(words) else library(words)

    def encode(texts: list[str]) -> list[bytes]:
        words = [t for t in texts if _plain_word(t)]
        known: dict[str, bytes] = {}
        for at in range(0, len(words), _JOINED):
            part = words[at : at + _JOINED]
            known.update(zip(part, encode_words(part), strict=True))
        others = [t for t in texts if t not in known]
        known.update(zip(others, library(others), strict=True))
        return [known[t] for t in texts]

    return encode


def pretoken_word(content: str) -> Callable[[str], bytes] | None:
    """Ids of a pre-token by the library's model alone; None if the file splits otherwise than ``_WORD_SPLIT``."""
    described = json.loads(content)
    steps = (described["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
    lower = [n.get("type") for n in (described["normalizer"] or {}).get("normalizers", ())]
    if steps[0].get("pattern") != {"Regex": _WORD_SPLIT} or lower != ["NFC", "Replace", "Lowercase"] or len(steps) != 2 or steps[1]["type"] != "ByteLevel":
        return None
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    tokenizer, level = Tokenizer.from_str(content), ByteLevel(add_prefix_space=False, use_regex=False)
    tokenize = tokenizer.model.tokenize
    # The library's character for each byte, by the Latin-1 character of that byte. No UTF-8 text has the bytes above 0xF4.
    ascii_ = {k: level.pre_tokenize_str(chr(k))[0][0] for k in range(128)}
    wide = {}
    for lead in (*range(0x80, 0x800, 0x40), *range(0x80, 0xC0)):
        for k, c in zip(chr(lead).encode(), level.pre_tokenize_str(chr(lead))[0][0], strict=True):
            wide[k] = c
    characters, as_bytes = ascii_ | wide, [k.to_bytes(4, "little") for k in range(tokenizer.get_vocab_size())]

    def encode(word: str) -> bytes:
        # Letters of ASCII stand for their own bytes; the others here are Latin, of two bytes.
        coded = word if word.isalpha() and word.isascii() else word.encode().decode("latin-1").translate(characters)
        return b"".join([as_bytes[t.id] for t in tokenize(coded)])

    return encode


def _word_vocabulary(content: str) -> tuple[bool, bool, tuple[str, ...]]:
    """Whether words' last tokens are marked, whether the tokenizer lower-cases, and its added tokens."""
    described = json.loads(content)
    normalizer = described["normalizer"] or {}
    steps = normalizer.get("normalizers", [normalizer])
    added = tuple(a["content"] for a in described.get("added_tokens") or ())
    return bool(described["model"].get("end_of_word_suffix")), any(n.get("type") == "Lowercase" for n in steps), added


_ENCODERS: dict[tuple[int, int, bool], ChunkEncoder] = {}


def worker_encoder(content: str, spaces: bool) -> ChunkEncoder:
    """One encoder for each Python worker and tokenizer file, kept over its tasks."""
    key = (len(content), hash(content), spaces)
    if key not in _ENCODERS:
        marked, lower, added = _word_vocabulary(content)
        library = word_library(content) if marked and not spaces else tokenizer_library(content)
        word = pretoken_word(content) if marked and lower and not spaces else None
        options = {"lower": lower, "added": added}
        _ENCODERS[key] = WordEncoder(library, word, **options) if word else ChunkEncoder(library, spaces, **options)
    return _ENCODERS[key]
