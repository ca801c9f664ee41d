"""Byte-pair encoding and decoding as streams of constant memory.

Encoding is a transducer with a bounded lookahead. How far a merge decision can
reach to the left follows from the merge list alone (``sufficient_lookahead``):
once that many symbols are known beyond a token, nothing that comes later can
change it, and it is emitted. A word of any length is held only up to
``WINDOW`` symbols plus the lookahead. Decoding is a state machine that takes one
id at a time and gives out text as soon as it is complete.

An encoding keeps two properties that make this exact: the tokens behind a token
boundary are the encoding of the text behind it, and text added on the right
moves the first differing token at most ``lookahead`` symbols to the left.
"""

import codecs
import functools
import hashlib
import re
import unicodedata
from collections.abc import Iterable, Iterator

import regex
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from eventledger.llm.byte_pairs import SHIFT, Merges, byte_letters
from eventledger.llm.common import arrow_map, share, text_or_empty

# Fixed value: the pattern whose matches are the words of a text.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

# Symbols encoded at a time beyond the lookahead.
WINDOW = 1024
# Words remembered per task.
REMEMBERED = 1 << 18
# Characters normalised at a time, and ids joined at a time.
STRETCH = 1 << 18


def sufficient_lookahead(merges: Merges) -> int:
    """Symbols after a token beyond which no text can change it.

    A difference on the right moves left only by a merge whose right part starts
    where the difference starts, and each such step has a later place in the
    merge list than the one before. The longest chain of steps is found over the
    merge list from its end; a step's right part is a token that begins with the
    left part of the step before.
    """
    length = {t: len(s.removesuffix(merges.suffix)) for t, s in merges.tokens.items()}
    reach: dict[str, int] = {}  # by beginning of a right part: most symbols a chain from there covers
    longest = 0
    parts = {place: (key >> SHIFT, key & ((1 << SHIFT) - 1)) for key, place in merges.pairs.items()}
    for place in sorted(parts, reverse=True):
        left, right = parts[place]
        covers = length[left] + reach.get(merges.tokens[left], 0)
        longest = max(longest, covers)
        name = merges.tokens[right]
        for end in range(1, len(name) + 1):
            if reach.get(name[:end], 0) < covers:
                reach[name[:end]] = covers
    return longest + 2 * max(length.values(), default=1)


def stream_word(symbols: Iterable[int], merges: Merges, lookahead: int, window: int = WINDOW) -> Iterator[int]:
    """Tokens of one word whose symbols arrive one by one."""
    held: list[int] = []
    for symbol in symbols:
        held.append(symbol)
        if len(held) >= window + lookahead:
            tokens, settled = merges.merge(held), 0
            for token in tokens:
                width = merges.width(token)
                if settled + width > len(held) - lookahead:
                    break
                yield token
                settled += width
            del held[:settled]
    yield from merges.merge(held)


class Words(dict):
    """Ids of a word as joined decimals, remembered up to REMEMBERED words."""

    def __init__(self, merges: Merges, lookahead: int):
        super().__init__()
        self.merges, self.lookahead = merges, lookahead

    def ids(self, word: str) -> Iterator[int]:
        raw = word.encode("utf-8")
        merges, last = self.merges, len(raw) - 1
        symbols = (merges.final[b] if i == last else merges.plain[b] for i, b in enumerate(raw))
        return stream_word(symbols, merges, self.lookahead)

    def __missing__(self, word: str) -> str:
        ids = " ".join(map(str, self.ids(word)))
        if len(word) < 256:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = ids
        return ids


class Blocks(dict):
    """The same for a stretch between white space, which may hold several words."""

    def __init__(self, words: Words, split):
        super().__init__()
        self.words, self.split = words, split

    def __missing__(self, block: str) -> str:
        ids = " ".join(map(self.words.__getitem__, self.split(block)))
        if len(block) < 256:
            if len(self) >= REMEMBERED:
                self.clear()
            self[block] = ids
        return ids


_RARE = re.compile("[^\0-՗]")


def unsure(text: str) -> bool:
    """Whether the text has characters that are not assigned in this Python's tables."""
    return _RARE.search(text) is not None and any(unicodedata.category(c) == "Cn" for c in set(text))


def normalised(text: str) -> str:
    # character by character: the sigma at a word's end is not treated specially
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


_CUT = regex.compile(r"\S(?=\s)")
# White space to str.split, but not to the pattern of the words.
_SEPARATORS = re.compile("[\x1c-\x1f]")


def stretches(text: str, size: int = STRETCH) -> Iterator[str]:
    """Cuts before white space; words and composed characters do not cross them."""
    start, n = 0, len(text)
    while n - start > size:
        found = _CUT.search(text, start + size)
        if found is None:
            break
        yield text[start : found.start() + 1]
        start = found.start() + 1
    yield text[start:]


def encoder(merges: Merges, lookahead: int):
    """A function text -> iterator over strings of ids joined by spaces."""
    split = regex.compile(WORDS).findall
    blocks = Blocks(Words(merges, lookahead), split)
    specials = regex.compile(
        "(" + "|".join(map(regex.escape, sorted(merges.special, key=len, reverse=True))) + ")"
    )
    library = functools.cache(lambda: Tokenizer.from_str(merges.source))

    def encode(text: str) -> Iterator[str]:
        if unsure(text):
            ids = library().encode(text, add_special_tokens=False).ids
            yield " ".join(map(str, ids))
            return
        for part in specials.split(text) if merges.special else [text]:
            if part in merges.special:
                yield str(merges.special[part])
                continue
            for stretch in stretches(part):
                plain = normalised(stretch)
                if _SEPARATORS.search(plain):
                    yield " ".join(map(blocks.words.__getitem__, split(plain)))
                else:
                    yield " ".join(filter(None, map(blocks.__getitem__, plain.split())))

    return lambda text: filter(None, encode(text))


class Decoder:
    """Turns ids into text, one at a time.

    Without ``byte_level`` the text is the tokens as the vocabulary spells them,
    with a space between two. With it each token stands for bytes, and a
    character comes out once its last byte has come; bytes that make no
    character become U+FFFD.
    """

    def __init__(self, tokens: dict[int, str], byte_level: bool = False, special: Iterable[str] = ()):
        self.tokens, self.byte_level, self.special = tokens, byte_level, set(special)
        self.bytes = {letter: b for b, letter in enumerate(byte_letters())} if byte_level else {}
        self.start()

    def start(self) -> None:
        """Begin another text."""
        self.first = True
        if self.byte_level:
            self.pending = codecs.getincrementaldecoder("utf-8")(errors="replace")

    def feed(self, token_id: int) -> str:
        token = self.tokens.get(token_id)
        if token is None:
            return ""
        if not self.byte_level:
            lead, self.first = "" if self.first else " ", False
            return lead + token
        if token in self.special:
            return self.pending.decode(token.encode("utf-8"))
        return self.pending.decode(bytes(self.bytes[x] for x in token))

    def end(self) -> str:
        return self.pending.decode(b"", final=True) if self.byte_level else ""


def encode_documents(docs: DataFrame, tokenizer: str, with_ids: bool = False) -> DataFrame:
    """Encodes every text and decodes it again.

    One row per row of ``docs``, repeated ones included: doc_id, n_tokens,
    ids_sha256, decoded_sha256, and with ``with_ids`` the ids (decimals joined by
    spaces). The decoded text is what ``Decoder`` says for the ids, one at a time;
    neither side holds more of a text than a stretch of it, ``with_ids`` apart. A
    null text counts as empty and has no tokens; an empty table gives none; other
    columns are not read.
    """
    merges = Merges.load(tokenizer)
    shared = share(docs.sparkSession, (merges, sufficient_lookahead(merges)))

    def rows():
        merges, lookahead = shared()
        encode = encoder(merges, lookahead)
        decoder = Decoder(merges.tokens)

        def handle(ids, texts):
            for doc_id, text in zip(ids, texts):
                ids_hash, text_hash, n = hashlib.sha256(), hashlib.sha256(), 0
                kept: list[str] = []
                decoder.start()
                for joined in encode(text):
                    parts = joined.split(" ")
                    ids_hash.update(b" " + joined.encode() if n else joined.encode())
                    text_hash.update("".join(map(decoder.feed, map(int, parts))).encode("utf-8"))
                    n += len(parts)
                    if with_ids:
                        kept.append(joined)
                text_hash.update(decoder.end().encode("utf-8"))
                row = doc_id, n, ids_hash.hexdigest(), text_hash.hexdigest()
                yield (*row, " ".join(kept)) if with_ids else row

        return handle

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return arrow_map(
        docs.select(F.col("doc_id").cast("bigint"), text_or_empty()),
        schema + (", ids string" if with_ids else ""),
        rows,
    )
