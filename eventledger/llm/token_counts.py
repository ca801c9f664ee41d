"""Token counts by the whole-token shortcut.

Most pieces of a text are strings that the vocabulary holds as one token. Which
of its strings really come out as that one token is proved once, on the driver,
by running the merge list over each of them. In the tasks a piece that is on
the proved list counts 1 without any merging; only the rest is merged.
"""

import functools
import re
import unicodedata
from collections.abc import Iterator

import regex
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from eventledger.llm.byte_pairs import Merges, byte_letters
from eventledger.llm.common import arrow_map, share, text_or_empty

# Fixed value: the pattern that cuts a text into pieces before the merges.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# A text is cut into stretches of about this many characters before it is split.
STRETCH = 1 << 18
# Counts of merged pieces remembered per task.
REMEMBERED = 1 << 18
# Strings of this many characters are counted anew each time.
LONG = 256


def proved_whole(merges: Merges) -> set[str]:
    """Vocabulary strings that the merge list turns into their own single token."""
    byte_of = {letter: b for b, letter in enumerate(byte_letters())}
    proved = set()
    for token_id, letters in merges.tokens.items():
        if letters in merges.special:
            continue
        raw = bytes(byte_of[x] for x in letters)
        try:
            text = raw.decode("utf-8")
        except UnicodeDecodeError:
            continue  # part of a character, never a piece by itself
        if merges.merge(merges.symbols(raw)) == [token_id]:
            proved.add(text)
    return proved


class PieceCounts(dict):
    """Tokens per piece: 1 for proved pieces, merged on first sight for others.

    Starts over when it has grown by REMEMBERED entries, and does not keep pieces of
    LONG characters or more, so its size is bounded.
    """

    def __init__(self, merges: Merges, whole: set[str]):
        super().__init__(dict.fromkeys(whole, 1))
        self.merges, self.room = merges, len(whole) + REMEMBERED
        self.whole = whole

    def __missing__(self, piece: str) -> int:
        count = len(self.merges.merge(self.merges.symbols(piece.encode("utf-8"))))
        if len(piece) < LONG:
            if len(self) >= self.room:
                self.clear()
                self.update(dict.fromkeys(self.whole, 1))
            self[piece] = count
        return count


def stretches(text: str, size: int = STRETCH) -> Iterator[str]:
    """Cut a long text where white space follows something else.

    No piece crosses such a place, and what a piece looks ahead at lies behind it.
    """
    start, n = 0, len(text)
    while n - start > size:
        found = _CUT.search(text, start + size)
        if found is None:
            break
        yield text[start : found.start() + 1]
        start = found.start() + 1
    yield text[start:]


_CUT = regex.compile(r"\S(?=\s)")


class UnitCounts(dict):
    """Tokens per unit, the stretch from one space to the next without the spaces.

    Away from runs of white space a piece never crosses the place before a space,
    so the counts of " unit" add up to the count of the text.
    """

    def __init__(self, pieces: PieceCounts, split):
        super().__init__()
        self.pieces, self.split = pieces, split

    def __missing__(self, unit: str) -> int:
        count = sum(map(self.pieces.__getitem__, self.split(" " + unit)))
        if len(unit) < LONG:
            if len(self) >= REMEMBERED:
                self.clear()
            self[unit] = count
        return count


# White space before a space: pieces may cross the space, the text is split as a whole.
_RUN = re.compile(r"\s ")


# Beyond this character a text is looked at for letters that this Python does not know.
_RARE = re.compile("[^\0-\u0557]")


def newer_letters(text: str) -> bool:
    """Whether the text has characters that are not assigned here.

    Two libraries with different versions of Unicode may class them differently.
    """
    return _RARE.search(text) is not None and any(
        unicodedata.category(c) == "Cn" for c in set(text)
    )


def token_counter(merges: Merges, whole: set[str]):
    """A function text -> number of tokens."""
    counts = PieceCounts(merges, whole)
    split = regex.compile(PIECES).findall
    units = UnitCounts(counts, split)
    library = functools.cache(lambda: Tokenizer.from_str(merges.source))
    specials = regex.compile("|".join(map(regex.escape, sorted(merges.special, key=len, reverse=True))))

    def count(text: str) -> int:
        if newer_letters(text):
            return len(library().encode(text, add_special_tokens=False).ids)
        parts = specials.split(text) if merges.special else [text]
        total = len(parts) - 1
        for part in parts:
            for stretch in stretches(part):
                if _RUN.search(stretch):
                    total += sum(map(counts.__getitem__, split(stretch)))
                else:
                    first, *rest = stretch.split(" ")
                    total += sum(map(counts.__getitem__, split(first)))
                    total += sum(map(units.__getitem__, rest))
        return total

    return count


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """Tokens of each text, as the tokenizer's library counts them.

    One row per row of ``docs``, repeated ones included: doc_id, n_bytes, n_tokens,
    over_limit. A null text counts as empty; an empty table gives none; other
    columns of ``docs`` are not read. A long text is counted by stretches that end
    at white space; without any it is one stretch, and no part of it of LONG
    characters or more is remembered. PIECES is the word pattern of byte-level
    files like ``byte_bpe_50k.json``; give files with another pattern to the
    library. The vocabulary
    (bounded by its file) is sent to the tasks once.
    """
    merges = Merges.load(tokenizer)
    shared = share(docs.sparkSession, (merges, proved_whole(merges)))

    def rows():
        count = token_counter(*shared())

        def handle(ids, texts):
            for doc_id, text in zip(ids, texts):
                n = count(text)
                yield doc_id, len(text.encode("utf-8")), n, n > limit

        return handle

    return arrow_map(
        docs.select(F.col("doc_id").cast("bigint"), text_or_empty()),
        "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
        rows,
    )
