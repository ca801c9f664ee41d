"""Byte-pair vocabularies: loading a tokenizer file and applying its merges."""

import heapq
import json
from dataclasses import dataclass


NO_MERGE = 1 << 60
SHIFT = 24


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies.

    Printable Latin-1 characters stand for themselves, the other bytes in
    ascending order for the characters from U+0100 on.
    """
    own = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


@dataclass
class Merges:
    """Ids of the vocabulary and the merge list over ids.

    ``pairs`` gives for two neighbouring ids, the left one shifted up by SHIFT
    bits, the place in the merge list; ``merged`` gives the token made at that
    place. ``plain`` and ``final`` give the id of a byte inside
    a word and at its end (the same where the vocabulary marks no word ends).
    """

    pairs: dict[int, int]
    merged: list[int]
    plain: list[int]
    final: list[int]
    tokens: dict[int, str]
    special: dict[str, int]
    suffix: str = ""
    source: str = ""

    @classmethod
    def load(cls, path: str) -> "Merges":
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        model = data["model"]
        vocab = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        letters = byte_letters()
        pairs, merged = {}, []
        for place, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            pairs.setdefault(vocab[left] << SHIFT | vocab[right], place)
            merged.append(vocab[left + right])
        special = {t["content"]: t["id"] for t in data["added_tokens"]}
        return cls(
            pairs=pairs,
            merged=merged,
            plain=[vocab[x] for x in letters],
            final=[vocab[x + suffix] for x in letters],
            tokens={i: t for t, i in vocab.items()} | {i: t for t, i in special.items()},
            special=special,
            suffix=suffix,
            source=json.dumps(data),
        )

    def symbols(self, word: bytes, ends: bool = True) -> list[int]:
        ids = [self.plain[b] for b in word]
        if ends and word:
            ids[-1] = self.final[word[-1]]
        return ids

    def width(self, token: int) -> int:
        """Bytes that a token stands for."""
        return len(self.tokens[token].removesuffix(self.suffix)) if self.suffix else len(self.tokens[token])

    def merge(self, ids: list[int]) -> list[int]:
        """Apply the merge list: the earliest merge first, the leftmost of equals."""
        merge = merge_short if len(ids) < 48 else merge_long
        return merge(ids, self.pairs, self.merged)


def merge_short(ids: list[int], pairs: dict[int, int], merged: list[int]) -> list[int]:
    ids = list(ids)
    get = pairs.get
    places = [get(left << SHIFT | right, NO_MERGE) for left, right in zip(ids, ids[1:])]
    while places:
        best = min(places)
        if best == NO_MERGE:
            break
        at = places.index(best)
        token = ids[at] = merged[best]
        del ids[at + 1], places[at]
        if at:
            places[at - 1] = get(ids[at - 1] << SHIFT | token, NO_MERGE)
        if at < len(places):
            places[at] = get(token << SHIFT | ids[at + 1], NO_MERGE)
    return ids


def merge_long(ids: list[int], pairs: dict[int, int], merged: list[int]) -> list[int]:
    """The same over a linked list and a heap: n log n for words of any length."""
    ids = list(ids)
    n = len(ids)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    heap = []

    def offer(i: int, j: int) -> None:
        place = pairs.get(ids[i] << SHIFT | ids[j]) if 0 <= i and j < n else None
        if place is not None:
            heapq.heappush(heap, (place, i, ids[i], ids[j]))

    for i in range(n - 1):
        offer(i, i + 1)
    while heap:
        place, at, left, right = heapq.heappop(heap)
        nxt = after[at]
        if ids[at] != left or nxt >= n or ids[nxt] != right:
            continue  # one of the two was merged meanwhile
        ids[at], ids[nxt] = merged[place], -1
        after[at] = after[nxt]
        if after[at] < n:
            before[after[at]] = at
        offer(before[at], at)
        offer(at, after[at])
    return [x for x in ids if x >= 0]
