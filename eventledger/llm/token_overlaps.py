"""Alignment of two tokenizers over the same texts, by merge-path partitioning.

Both token sequences of a text end at the same byte, so their ends are two sorted
lists. Merging them gives everything: between two neighbouring ends exactly one
token of either side lies, which is a link, and where both sides end a group ends.

1. Texts are encoded by the tokenizers' own libraries; a text whose tokens do not
   spell it out byte for byte has none. Where no token of either side can reach over
   a space, what lies between spaces is encoded once, many parts in a row, and the
   tokens of what repeats are remembered.
2. The merge of the ends is cut along diagonals: a binary search on each diagonal
   says how many ends of A and of B lie before it. The pieces between have the same
   number of ends each, whatever the lengths of texts and tokens, and are merged
   independently. An end that A and B share may lie on both sides of a cut: a piece
   looks one end across its borders, and the numbers of groups before it are added
   afterwards.
3. Per text the different id pairs are kept with their number of links. Documents
   per pair and the highest per A id are aggregations over them. The most frequent
   pairs, a table of bounded size, answer inside the tasks; all others by a join.
"""

import hashlib
import json
import os
import re
import uuid
from collections.abc import Callable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, Window, functions as F
from sentencepiece import sentencepiece_model_pb2
from tokenizers import Tokenizer

from eventledger.llm import byte_words
from eventledger.llm.byte_pairs import byte_letters
from eventledger.llm.common import share
from eventledger.session import run_folder

# Ends per piece of a merge.
PIECE = 1 << 15
# Pairs whose counts are sent to the tasks (17 bytes each).
SENT_PAIRS = 1 << 20
# Characters encoded together.
TOGETHER = 1 << 20
# Parts of texts whose tokens are remembered at most, and the characters of each.
REMEMBERED, LONGEST_PART = 1 << 17, 64
# A part begins at a space that follows and precedes a sign, letter or digit.
PARTS = re.compile(r" (?<=[!-~\w] )(?=[!-~\w])")
JOINABLE = re.compile(r"[!-~\w](.*[!-~\w])?", re.DOTALL)
# Parts encoded in a row.
JOINED = 256

STORED = (
    "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
    "pairs array<bigint>, times array<int>"
)


# --- the two sides


class Side(NamedTuple):
    """``encode`` gives the ids of each of some texts; ``spelling`` the bytes of each id.

    ``in_parts`` says that the ids of a text are those of its PARTS, one after the other.
    """

    encode: Callable[[list[str]], list[list[int]]]
    spelling: list[bytes]
    in_parts: bool


def byte_level(source: str) -> Side:
    """From the JSON of a byte-level tokenizer; a space is put before each text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
    library = Tokenizer.from_str(source)
    library.no_truncation()
    library.no_padding()
    library.encode_special_tokens = True
    byte_of = {letter: b for b, letter in enumerate(byte_letters())}
    spelling = [b""] * library.get_vocab_size(with_added_tokens=True)
    for token, number in library.get_vocab(with_added_tokens=True).items():
        known = all(letter in byte_of for letter in token)
        spelling[number] = bytes(byte_of[x] for x in token) if known else token.encode("utf-8")

    def encode(texts: list[str]) -> list[list[int]]:
        found = library.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        return [e.ids for e in found]

    # the pattern of such a tokenizer has a space at the beginning of a word only
    rules = json.loads(source)
    words = rules.get("pre_tokenizer") or {}
    in_parts = (
        rules.get("normalizer") is None
        and words.get("type") == "ByteLevel"
        and words.get("use_regex", True)
        and not words.get("add_prefix_space")
        and all(token["special"] for token in rules.get("added_tokens", []))
    )
    return Side(encode, spelling, in_parts)


def pieces_with_bytes(model: bytes) -> Side:
    """From a sentencepiece model with byte fallback, which puts the space itself."""
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    spelling = [
        bytes([int(library.id_to_piece(i)[3:-1], 16)])
        if library.is_byte(i)
        else library.id_to_piece(i).replace("▁", " ").encode("utf-8")
        for i in range(library.get_piece_size())
    ]
    rules = sentencepiece_model_pb2.ModelProto.FromString(model)
    plain, form = rules.normalizer_spec, rules.trainer_spec
    in_parts = (
        form.model_type == form.BPE
        and not form.treat_whitespace_as_suffix
        and plain.add_dummy_prefix
        and not plain.remove_extra_whitespaces
        and not plain.precompiled_charsmap
        and not any("▁" in piece.piece.lstrip("▁") or piece.type == piece.USER_DEFINED for piece in rules.pieces)
    )
    return Side(lambda texts: library.encode(texts, num_threads=1), spelling, in_parts)


# --- merging


def split_diagonals(a: np.ndarray, b: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """How many ends of A and of B lie before each cut; A's end comes first where both end.

    A binary search on every diagonal i + j = d at once.
    """
    total = len(a) + len(b)
    diagonals = np.append(np.arange(0, total, size, dtype=np.int64), total)
    low, high = np.maximum(diagonals - len(b), 0), np.minimum(diagonals, len(a))
    while (open_ := low < high).any():
        middle = (low + high) // 2
        taken = np.zeros(len(low), bool)
        at, other = middle[open_], (diagonals - middle)[open_] - 1
        taken[open_] = a[at] <= b[other]
        low = np.where(open_ & taken, middle + 1, low)
        high = np.where(open_ & ~taken, middle, high)
    return low, diagonals - low


class Merged(NamedTuple):
    """Links as (index in A, index in B), and whether a token ends a group."""

    link_a: np.ndarray
    link_b: np.ndarray
    closes_a: np.ndarray
    closes_b: np.ndarray


def merge_piece(a: np.ndarray, b: np.ndarray, i: tuple[int, int], j: tuple[int, int]) -> Merged:
    """The piece a[i0:i1], b[j0:j1]; one end beyond each border is looked at, no more."""
    own_a, own_b = a[i[0] : i[1]], b[j[0] : j[1]]
    other_b = j[0] + np.searchsorted(own_b, own_a, side="left")
    other_a = i[0] + np.searchsorted(own_a, own_b, side="left")
    # an end of A meets the next end of B, which may be the first of the next piece
    closes_a = np.zeros(len(own_a), bool)
    here = other_b < len(b)
    closes_a[here] = b[other_b[here]] == own_a[here]
    # an end of B that A shares was A's, in this piece or as the last of the one before
    closes_b = np.zeros(len(own_b), bool)
    here = other_a < i[1]
    closes_b[here] = a[other_a[here]] == own_b[here]
    if len(own_b) and i[0] > 0:
        closes_b[0] |= a[i[0] - 1] == own_b[0]
    new = ~closes_b
    link_a = np.concatenate([np.arange(i[0], i[1]), other_a[new]])
    link_b = np.concatenate([other_b, np.arange(j[0], j[1])[new]])
    return Merged(link_a, link_b, closes_a, closes_b)


def merge_ends(a: np.ndarray, b: np.ndarray, size: int = PIECE) -> Merged:
    """All pieces, one after the other."""
    i, j = split_diagonals(a, b, size)
    done = [merge_piece(a, b, (i[k], i[k + 1]), (j[k], j[k + 1])) for k in range(len(i) - 1)]
    if not done:
        none = np.zeros(0, np.int64)
        return Merged(none, none, none.astype(bool), none.astype(bool))
    return Merged(*map(np.concatenate, zip(*done)))


# --- documents


class Aligned(NamedTuple):
    """Per text the numbers of tokens, groups and links, the digest, and its pairs."""

    counts: np.ndarray
    digests: list[str]
    pair_ends: np.ndarray
    pairs: np.ndarray
    times: np.ndarray


def _flat(ids: list[list[int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(ids), np.int64, sum(map(len, ids)))


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, np.int32).tobytes()


class _Lists:
    """Packed lists of ids, one after the other; the chosen ones in a row."""

    def __init__(self, ids: list[bytes]):
        self.lengths = np.array([len(x) for x in ids], np.int64) // 4
        self.flat = np.frombuffer(b"".join(ids), np.int32).astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def of(self, which: np.ndarray) -> np.ndarray:
        lengths = self.lengths[which]
        before = np.cumsum(lengths) - lengths
        return self.flat[np.repeat(self.starts[which] - before, lengths) + np.arange(lengths.sum())]


def _written(strings: pa.Array, which: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The chosen strings in a row, and where each begins, and the end."""
    if not len(which):
        return b"", np.zeros(1, np.int64)
    chosen = strings.take(pa.array(which))
    return chosen.buffers()[2].to_pybytes(), np.frombuffer(chosen.buffers()[1], np.int64)[: len(which) + 1]


class Aligner:
    """Aligns some texts at a time; holds the tables of both sides."""

    def __init__(self, a: Side, b: Side):
        self.a, self.b = a, b
        self.in_parts = a.in_parts and b.in_parts
        self.known: dict[str, tuple[bytes, bytes] | None] = {}
        self.lengths = [np.array([len(s) for s in side.spelling], np.int64) for side in (a, b)]
        self.spelling = [pa.array(side.spelling, pa.large_binary()) for side in (a, b)]
        n = max(len(a.spelling), len(b.spelling))
        # each id with each of the signs that may follow it
        self.signs = n
        self.written = pa.array([f"{i}{sign}" for sign in (",", "|", ";", "") for i in range(n)], pa.large_string())

    def _spelled(self, side: int, ids: list[list[int]], raw: list[bytes]) -> list[bool]:
        letters, places = _written(self.spelling[side], _flat(ids))
        ends = places[np.cumsum([0, *map(len, ids)])].tolist()
        return [letters[start:end] == text for start, end, text in zip(ends, ends[1:], raw)]

    def _whole(self, texts: list[str]) -> list[tuple[list[int], list[int]] | None]:
        """The ids of both sides; None for a text that those of a side do not spell."""
        raw = [b" " + t.encode("utf-8") for t in texts]
        sides = [side.encode(texts) for side in (self.a, self.b)]
        right = [x and y for x, y in zip(*(self._spelled(s, ids, raw) for s, ids in enumerate(sides)))]
        return [ids if ok else None for *ids, ok in zip(*sides, right)]

    def _whole_packed(self, texts: list[str]) -> list[tuple[bytes, bytes] | None]:
        return [ids and (_packed(ids[0]), _packed(ids[1])) for ids in self._whole(texts)]

    def _encoded(self, parts: list[str]) -> list[tuple[bytes, bytes] | None]:
        """The same for parts: those that may follow each other are encoded in a row and cut where they end."""
        if not self.in_parts:
            return self._whole_packed(parts)
        out: list[tuple[bytes, bytes] | None] = [None] * len(parts)
        joinable = [bool(JOINABLE.fullmatch(p)) for p in parts]
        left = [i for i, ok in enumerate(joinable) if not ok]
        inside = [i for i, ok in enumerate(joinable) if ok]
        rows = [inside[k : k + JOINED] for k in range(0, len(inside), JOINED)]
        for row, found in zip(rows, self._whole([" ".join([parts[i] for i in row]) for row in rows])):
            ends = np.cumsum([len(parts[i].encode("utf-8")) + 1 for i in row])
            cut = found and [self._cut(side, ids, ends) for side, ids in enumerate(found)]
            if not cut or None in cut:
                left += row
                continue
            for i, ids in zip(row, zip(*cut)):
                out[i] = ids
        for i, ids in zip(left, self._whole_packed([parts[i] for i in left])):
            out[i] = ids
        return out

    def _cut(self, side: int, ids: list[int], ends: np.ndarray) -> list[bytes] | None:
        """The ids up to each of some ends in bytes, or None if one lies inside a token."""
        numbers = np.array(ids, np.int32)
        reached = np.cumsum(self.lengths[side][numbers])
        at = np.searchsorted(reached, ends)
        if (reached[at] != ends).any():
            return None
        packed, cuts = numbers.tobytes(), [0, *(4 * (at + 1)).tolist()]
        return [packed[a:b] for a, b in zip(cuts, cuts[1:])]

    def _tokens(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of both sides how many ids each text has, and the ids of all."""
        cut = PARTS.split if self.in_parts else lambda text: [text]
        parts = [cut(t) if t else [] for t in texts]
        number = {part: i for i, part in enumerate(dict.fromkeys(chain.from_iterable(parts)))}
        new = [part for part in number if part not in self.known]
        found = dict(zip(new, self._encoded(new)))
        ids = [self.known[part] if part in self.known else found[part] for part in number]
        # where a part is not spelled, the whole text decides
        wrong = {i for i, x in enumerate(ids) if x is None}
        which = [[number[part] for part in own] for own in parts]
        again = [i for i, own in enumerate(which) if wrong and not wrong.isdisjoint(own)]
        for i, whole in zip(again, self._whole_packed([texts[i] for i in again])):
            which[i] = [] if whole is None else [len(ids)]
            ids.append(whole)
        chosen = _flat(which)
        times = np.bincount(chosen, minlength=len(ids)).tolist()
        repeated = [p for p in new if times[number[p]] > 1 and len(p) <= LONGEST_PART][:REMEMBERED]
        if len(self.known) + len(repeated) > REMEMBERED:
            self.known.clear()
        self.known.update((p, found[p]) for p in repeated)
        of_text = np.repeat(np.arange(len(texts)), [len(own) for own in which])
        sides = []
        for side in range(2):
            lists = _Lists([x[side] if x is not None else b"" for x in ids])
            counts = np.zeros(len(texts), np.int64)
            np.add.at(counts, of_text, lists.lengths[chosen])
            sides.append((counts, lists.of(chosen)))
        return sides

    def align(self, texts: list[str | None]) -> Aligned:
        (n_a, a), (n_b, b) = self._tokens(texts)
        # a text has the same length on both sides, so the ends of all texts are one merge
        merged = merge_ends(np.cumsum(self.lengths[0][a]), np.cumsum(self.lengths[1][b]))
        doc_a, doc_b = (np.repeat(np.arange(len(texts)), n) for n in (n_a, n_b))
        doc = doc_a[merged.link_a]
        groups = np.bincount(doc_a[merged.closes_a], minlength=len(texts))
        links = np.bincount(doc, minlength=len(texts))
        width = len(self.b.spelling)
        codes = len(self.a.spelling) * width
        held, times = np.unique(doc * codes + a[merged.link_a] * width + b[merged.link_b], return_counts=True)
        pair_ends = np.searchsorted(held, np.arange(len(texts) + 1) * codes)
        return Aligned(
            np.stack([n_a, n_b, groups, links]),
            self._digests(a, b, doc_a, n_a, n_b, merged),
            pair_ends,
            held % codes,
            times.astype(np.int32),
        )

    def _digests(self, a, b, doc_a, n_a, n_b, merged: Merged) -> list[str]:
        """Writes A's ids of each group, then B's, and hashes the writing of each text."""
        group_a = np.cumsum(merged.closes_a) - merged.closes_a
        group_b = np.cumsum(merged.closes_b) - merged.closes_b
        n_groups = int(merged.closes_a.sum())
        b_before = np.concatenate([[0], np.cumsum(np.bincount(group_b, minlength=n_groups))])
        a_upto = np.cumsum(np.bincount(group_a, minlength=n_groups)) if n_groups else np.zeros(0, np.int64)
        written = np.empty(len(a) + len(b), np.int64)
        written[np.arange(len(a)) + b_before[group_a]] = a + np.where(merged.closes_a, self.signs, 0)
        written[np.arange(len(b)) + a_upto[group_b]] = b + np.where(merged.closes_b, 2 * self.signs, 0)
        ends = np.cumsum(n_a + n_b)
        last = ends[(n_a + n_b) > 0] - 1
        written[last] += self.signs  # nothing follows the last group
        letters, places = _written(self.written, written)
        out = []
        for start, end in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist()):
            digest = hashlib.sha256(letters[places[start] : places[end]]).hexdigest() if end > start else ""
            out.append(digest)
        return out


def _aligned_rows(docs: DataFrame, byte_level_json: str, piece_model: str) -> DataFrame:
    """One row per row of ``docs`` in the shape of STORED."""
    with open(byte_level_json, encoding="utf-8") as a, open(piece_model, "rb") as b:
        shared = share(docs.sparkSession, (a.read(), b.read()))

    def run(batches) -> Iterator[pa.RecordBatch]:
        source, model = shared()
        aligner = Aligner(byte_level(source), pieces_with_bytes(model))
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for part in byte_words.chunks(texts, TOGETHER):
                found = aligner.align(texts[part])
                ends = pa.array(found.pair_ends.astype(np.int32))
                columns = [
                    ids.slice(part.start, part.stop - part.start),
                    *map(pa.array, found.counts),
                    pa.array(found.digests, pa.string()),
                    pa.ListArray.from_arrays(ends, pa.array(found.pairs)),
                    pa.ListArray.from_arrays(ends, pa.array(found.times)),
                ]
                names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, STORED)


def pair_counts(aligned: DataFrame, width: int) -> DataFrame:
    """pair, n (documents that hold it), best (whether none of its A id has more).

    An A id has at most as many pairs as B has ids.
    """
    counted = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    of_a = Window.partitionBy(F.call_function("div", F.col("pair"), F.lit(width).cast("bigint")))
    return counted.withColumn("best", F.col("n") == F.max("n").over(of_a))


def _sent_from(counts: DataFrame, most: int) -> int:
    """The least count from which on at most ``most`` pairs have it, by eighths of powers of two."""
    step = lambda n: F.floor(8 * F.log2(n))
    steps = counts.groupBy(step(F.col("n")).alias("step")).agg(F.min("n").alias("low"), F.count("*").alias("pairs"))
    # a few hundred rows
    rows, total, low = sorted(steps.collect(), reverse=True), 0, None
    for row in rows:
        total += row["pairs"]
        if total > most:
            break
        low = row["low"]
    return (1 << 62) if low is None else low


def align(docs: DataFrame, byte_level_json: str, piece_model: str, sent_pairs: int = SENT_PAIRS) -> DataFrame:
    """How the tokens of two tokenizers lie over each other in each text.

    One row per row of ``docs``, repeated rows included: doc_id, n_a, n_b, n_groups,
    n_links, n_best (links whose pair is held by as many documents as any pair of its
    A id), count_sum (documents of the pair, summed over links), groups_sha256.
    Null and empty texts and those that the tokens do not spell out have zeros and
    an empty digest; other columns of ``docs`` are not read. Rows count as documents
    each, also if they are equal.
    """
    spark = docs.sparkSession
    with open(piece_model, "rb") as file:
        width = len(pieces_with_bytes(file.read()).spelling)
    folder = run_folder(spark, f"token-overlaps-{uuid.uuid4().hex}")
    rows = _aligned_rows(docs, byte_level_json, piece_model)
    rows.withColumn("row", F.monotonically_increasing_id()).write.parquet(f"{folder}/rows")
    aligned = spark.read.parquet(f"{folder}/rows")
    pair_counts(aligned, width).write.parquet(f"{folder}/pairs")
    counts = spark.read.parquet(f"{folder}/pairs")

    low = _sent_from(counts, sent_pairs)
    sent = counts.where(F.col("n") >= low).toArrow().sort_by("pair")
    table = [sent[c].to_numpy() for c in ("pair", "n", "best")]
    shared = share(spark, table)

    def answer(batches) -> Iterator[pa.RecordBatch]:
        known, n, best = shared()
        known, n, best = (np.append(x, x.dtype.type(0)) for x in (known, n, best))
        for batch in batches:
            lists, times = batch.column("pairs"), batch.column("times").flatten().to_numpy()
            pairs = lists.flatten().to_numpy()
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            at = np.searchsorted(known[:-1], pairs)
            hit = known[at] == pairs
            hit &= at < len(known) - 1
            links, at = times[hit].astype(np.int64), at[hit]
            sums = np.zeros((2, len(lists)), np.int64)
            np.add.at(sums[0], row[hit], links * best[at])
            np.add.at(sums[1], row[hit], links * n[at])
            left = np.concatenate([[0], np.cumsum(np.bincount(row[~hit], minlength=len(lists)))]).astype(np.int32)
            kept = [batch.column(c) for c in _KEPT]
            rest = [pa.ListArray.from_arrays(pa.array(left), pa.array(x[~hit])) for x in (pairs, times)]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sums[0]), pa.array(sums[1]), *rest], [*_KEPT, "n_best", "count_sum", "pairs", "times"]
            )

    answered = aligned.mapInArrow(
        answer,
        "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
        "n_best bigint, count_sum bigint, pairs array<bigint>, times array<int>",
    )
    rare = counts.where(F.col("n") < low)
    result = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if rare.isEmpty():
        return answered.select(*result)
    rest = (
        answered.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("one"))
        .select("row", "one.pairs", "one.times")
        .withColumnRenamed("pairs", "pair")
        .join(rare, "pair")
        .groupBy("row")
        .agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"),
            F.sum(F.col("times") * F.col("n")).alias("more_sum"),
        )
    )
    joined = answered.drop("pairs", "times").join(rest, "row", "left")
    more = lambda name, other: (F.col(name) + F.coalesce(F.col(other), F.lit(0))).cast("bigint")
    return joined.withColumn("n_best", more("n_best", "more_best")).withColumn(
        "count_sum", more("count_sum", "more_sum")
    ).select(*result)


_KEPT = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
