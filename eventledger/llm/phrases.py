"""Phrase collocations by Toivonen's sampling, per language.

A phrase is two to four words in a row inside a piece of a text. All phrases that
occur often enough are found and counted exactly in a few passes:

1. A sample of the documents proposes phrases, at a lowered threshold.
2. The full pass counts the proposed phrases and their negative border: every
   phrase both of whose halves (without its last, without its first word) were
   proposed, whether or not it was itself. Words are always counted.
3. Frequent phrases that were not proposed are failures of the border. They join
   the proposals, and a further pass counts what they make countable, until there
   are none. A phrase cannot be frequent unless its halves are, so nothing is
   missed then, whatever the sample was. Three further passes are the most.

These passes count hashes of phrases, which may only count too much. A last pass
counts the phrases themselves, of those hashes that came out as frequent.

Proposals and frequent hashes travel as bitmaps of bounded size. They err to one side
only: a phrase let in by chance is counted like any other.
"""

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from eventledger.llm import byte_words
from eventledger.llm.common import share, text_or_empty

LONGEST = 4
# One document in so many proposes.
SAMPLE_ONE_IN = 4
# A bitmap has 32 bits per member, but within these powers of two (16 MB at most).
LEAST_BITS, MOST_BITS = 20, 27
# A hash sets the bits that these shifts of its upper bits name.
PROBES = (0, 10, 19)
NO_LANG = "und"
# Characters looked at together.
TOGETHER = 1 << 19
# Hashes that a task adds up before it hands them on (16 bytes each).
TALLIED = 1 << 20
# Phrases that a task adds up before it hands them on, and characters in them.
NAMED, NAMED_TEXT = 1 << 18, 1 << 25
# Groups in which hashes are added up, for each partition of the documents, and the limits of their number.
GROUPS_EACH, LEAST_GROUP_BITS, MOST_GROUP_BITS = 16, 8, 20
# Bits of a hash that are counted; the two lowest hold the number of words.
KEY_BITS = 48
# Candidates of one language that one task ranks.
RANKED_TOGETHER = 100_000

_STEP = np.uint64(0x9E3779B97F4A7C15)


def lowered(support: int, one_in: int) -> int:
    """The threshold in the sample that a phrase at ``support`` misses about once in twenty times."""
    expected = support / one_in
    return max(1, math.ceil(expected - 1.645 * math.sqrt(expected)))


def _word_bytes() -> np.ndarray:
    inside = np.ones(256, bool)
    inside[list(b" \t.,;:!?\n\x0b\x0c\r")] = False
    return byte_words._table(inside)


def _breaks() -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(b".,;:!?\n\x0b\x0c\r")] = True
    return found


class Filter:
    """Hashes that were proposed; may answer yes for others."""

    def __init__(self, words: np.ndarray):
        self.words, self.bits = words, int(len(words)).bit_length() + 5

    @staticmethod
    def empty(members: int) -> "Filter":
        bits = min(max(LEAST_BITS, (32 * members).bit_length()), MOST_BITS)
        return Filter(np.zeros(1 << (bits - 6), np.uint64))

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        held, mask = np.ones(len(hashes), bool), np.uint64((1 << self.bits) - 1)
        for shift in PROBES:
            place = (hashes >> np.uint64(64 - KEY_BITS + 2 + shift)) & mask
            held &= (self.words[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1
        return held

    def with_keys(self, keys: DataFrame) -> "Filter":
        """Adds a column ``key``; what reaches the driver is at most the bitmap."""
        places = F.array(*[F.shiftright("key", 2 + shift).bitwiseAND(F.lit((1 << self.bits) - 1)) for shift in PROBES])
        mask = F.expr("bit_or(shiftleft(1L, cast(place & 63 as int)))")
        found = (
            keys.select(F.explode(places).alias("place"))
            .groupBy(F.shiftright("place", 6).alias("word"))
            .agg(mask.alias("mask"))
            .toArrow()
        )
        words = self.words.copy()
        words[found["word"].to_numpy()] |= found["mask"].to_numpy().view(np.uint64)
        return Filter(words)

    def __eq__(self, other) -> bool:
        return np.array_equal(self.words, other.words)


class Places:
    """Where phrases of each length stand in some texts, and their hashes."""

    def __init__(self, texts: list, langs: list):
        data, edges = byte_words.joined_bytes(texts)
        table = _word_bytes()
        self.hashes, starts, ends = byte_words.word_hashes(data, table)
        self.langs = sorted(set(langs))
        index = {name: i for i, name in enumerate(self.langs)}
        of_text = np.array([index[name] for name in langs], np.int64)
        self.lang = of_text[np.searchsorted(edges, starts, side="right") - 1]
        stop = _breaks()[data]
        stop[edges[1:] - 1] = True
        piece = np.cumsum(stop, dtype=np.int64)[starts]
        self.same = piece[1:] == piece[:-1]
        # the words alone, lower case, one space behind each
        folded = table[data]
        keep = folded != 0
        self.text = np.where(keep, folded - 1, 0x20).astype(np.uint8)
        keep[ends] = True
        self.text = self.text[keep].tobytes()
        kept = np.cumsum(keep, dtype=np.int64)
        self.starts, self.ends = kept[starts] - 1, kept[ends] - 1

    def levels(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(words, where such a phrase may start, its hash there)."""
        seeds = np.array(
            [int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "big") for name in self.langs],
            np.uint64,
        )
        n = len(self.hashes)
        fits, value = np.ones(n, bool), byte_words.mixed(self.hashes ^ seeds[self.lang])
        for words in range(1, longest + 1):
            yield words, fits, value
            if n <= words:
                return
            fits = fits[:-1] & self.same[words - 1 :]
            value = byte_words.mixed(value[:-1] * _STEP + self.hashes[words:])

    def phrases(self, at: np.ndarray, words: int) -> list[bytes]:
        begin, end = self.starts[at].tolist(), self.ends[at + words - 1].tolist()
        return [self.text[b:e] for b, e in zip(begin, end)]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"), text_or_empty().alias("text"))


def _parts(batches) -> Iterator[Places]:
    for batch in batches:
        langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
        for part in byte_words.chunks(texts, TOGETHER):
            yield Places(texts[part], langs[part])


def _keys(value: np.ndarray, words: int) -> np.ndarray:
    """The upper bits of a hash and the number of words."""
    return (value >> np.uint64(64 - KEY_BITS + 2) << np.uint64(2)) | np.uint64(words - 1)


def _added_up(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([k for k, _ in parts])
    order = np.argsort(keys)
    keys, counts = keys[order], np.concatenate([n for _, n in parts])[order]
    first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _narrowed(values: np.ndarray) -> bytes:
    """The width in bytes, then the numbers in that width."""
    width = next(w for w in (1, 4, 8) if w == 8 or not len(values) or int(values.max()) < 1 << (8 * w))
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def _widened(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.uint64)


def _tallies(found: Iterator[np.ndarray], group_bits: int) -> Iterator[pa.RecordBatch]:
    """(group, keys, counts) of a task: per group the steps between its sorted keys, and how often each occurred.

    What repeats is added up as far as TALLIED allows.
    """

    def tally(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        group = keys >> np.uint64(KEY_BITS - group_bits)
        cuts = np.flatnonzero(np.diff(group, prepend=~group[:1], append=~group[-1:]))
        rows = [(int(group[a]), keys[a:b], counts[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        steps = [_narrowed(np.diff(k, prepend=np.uint64(g << (KEY_BITS - group_bits)))) for g, k, _ in rows]
        columns = [pa.array([g for g, _, _ in rows], pa.int32()), steps, [_narrowed(n) for _, _, n in rows]]
        return pa.RecordBatch.from_arrays(
            [columns[0], *(pa.array(c, pa.binary()) for c in columns[1:])], ["group", "keys", "counts"]
        )

    parts, size = [], 0
    for keys in found:
        parts.append(np.unique(keys, return_counts=True))
        size += len(parts[-1][0])
        if size >= TALLIED:
            parts = [_added_up(parts)]
            size = len(parts[0][0])
            if size >= TALLIED // 2:
                yield tally(*parts[0])
                parts, size = [], 0
    if size:
        yield tally(*_added_up(parts))


def _group_bits(texts: DataFrame) -> int:
    """A group has the hashes of one range.

    There are so many groups for the partitions of the documents that a group is about
    as large as the sixteenth part of a partition.
    """
    groups = GROUPS_EACH * texts.rdd.getNumPartitions()
    return min(max(LEAST_GROUP_BITS, groups.bit_length()), MOST_GROUP_BITS)


def _counted(docs: DataFrame, keys, least: int) -> DataFrame:
    """Keys that occur ``least`` times; ``keys`` gives those of some places, once per level."""
    texts = _texts(docs)
    group_bits = _group_bits(texts)

    def run(batches):
        return _tallies((k for places in _parts(batches) for k in keys(places)), group_bits)

    def add_up(group: pa.Table) -> pa.Table:
        first = np.uint64(group["group"][0].as_py() << (KEY_BITS - group_bits))
        parts = [
            (first + np.cumsum(_widened(k.as_py()), dtype=np.uint64), _widened(n.as_py()))
            for k, n in zip(group["keys"], group["counts"])
        ]
        found, counts = _added_up(parts)
        return pa.table({"key": found[counts >= least].astype(np.int64)})

    tallies = texts.mapInArrow(run, "group int, keys binary, counts binary")
    return tallies.groupBy("group").applyInArrow(add_up, "key bigint")


def propose(docs: DataFrame, support: int, one_in: int) -> DataFrame:
    """Keys of the words, pairs and triples that the sample holds often enough."""

    def keys(places: Places):
        for words, fits, value in places.levels(LONGEST - 1):
            yield _keys(value[fits], words)

    sample = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(one_in)) == 0)
    return _counted(sample, keys, lowered(support, one_in))


def _count_pass(docs: DataFrame, proposed: Filter, before: Filter | None, support: int) -> DataFrame:
    """Frequent keys of what ``proposed`` makes countable and ``before`` did not."""
    shared = share(docs.sparkSession, (proposed.words, None if before is None else before.words))
    filters = []

    def countable(fits, inside):
        return fits & inside[:-1] & inside[1:]

    def keys(places: Places):
        if not filters:
            filters.extend(None if words is None else Filter(words) for words in shared())
        now, old = filters
        inside = known = None
        for words, fits, value in places.levels(LONGEST):
            if words > 1:
                chosen = countable(fits, inside)
                if old is not None:
                    chosen &= ~countable(fits, known)
            else:
                chosen = fits if old is None else np.zeros(len(fits), bool)
            yield _keys(value[chosen], words)
            inside = fits & now.holds(value)
            known = None if old is None else fits & old.holds(value)

    return _counted(docs, keys, support)


def _count_phrases(docs: DataFrame, frequent: Filter, support: int) -> DataFrame:
    """lang, words, phrase, n of the phrases whose hashes are in ``frequent`` and that occur ``support`` times.

    A row of no words per language has the number of all its words. As hashes do, the
    phrases of a task travel in groups: those of one language and range of hashes, a line each.
    """
    texts = _texts(docs)
    group_bits, shared = _group_bits(texts), share(docs.sparkSession, frequent.words)

    def run(batches):
        wanted, known, text, totals = Filter(shared()), {}, 0, Counter()
        for places in _parts(batches):
            for words, fits, value in places.levels(LONGEST):
                at = np.flatnonzero(fits & wanted.holds(value))
                found, first, counts = np.unique(value[at], return_index=True, return_counts=True)
                new = np.array([h not in known for h in found.tolist()], bool)
                at = at[first[new]]
                for h, lang, phrase in zip(found[new].tolist(), places.lang[at].tolist(), places.phrases(at, words)):
                    known[h] = [places.langs[lang], phrase, 0]
                    text += len(phrase)
                for h, n in zip(found.tolist(), counts.tolist()):
                    known[h][2] += n
            for lang, n in zip(places.langs, np.bincount(places.lang, minlength=len(places.langs)).tolist()):
                totals[lang] += n
            if len(known) > NAMED or text > NAMED_TEXT:
                yield _lines_of(known, group_bits)
                known, text = {}, 0
        yield _lines_of(known, group_bits)
        yield _as_batch([(lang, -1, b"", _narrowed(np.array([n], np.int64))) for lang, n in totals.items()])

    def add_up(group: pa.Table) -> pa.Table:
        phrases = pa.array([p for lines in group["phrases"] for p in lines.as_py().split(b"\n")], pa.binary())
        counts = pa.array(np.concatenate([_widened(n.as_py()).astype(np.int64) for n in group["counts"]]))
        summed = pa.table({"phrase": phrases, "n": counts}).group_by("phrase").aggregate([("n", "sum")])
        summed = summed.filter(pc.or_(pc.greater_equal(summed["n_sum"], support), pc.equal(summed["phrase"], b"")))
        words = [p.count(b" ") + 1 if p else 0 for p in summed["phrase"].to_pylist()]
        return pa.table(
            {
                "lang": pa.array([group["lang"][0].as_py()] * len(words), pa.string()),
                "words": pa.array(words, pa.int32()),
                "phrase": summed["phrase"].cast(pa.string()),
                "n": summed["n_sum"],
            }
        )

    lines = texts.mapInArrow(run, "lang string, group int, phrases binary, counts binary")
    return lines.groupBy("lang", "group").applyInArrow(add_up, "lang string, words int, phrase string, n bigint")


def _lines_of(known: dict, group_bits: int) -> pa.RecordBatch:
    """One row per language and group: the phrases, one a line (none holds a line's end), and their counts."""
    groups: dict[tuple[str, int], list] = {}
    for h, (lang, phrase, n) in known.items():
        groups.setdefault((lang, h >> (64 - group_bits)), []).append((phrase, n))
    return _as_batch(
        [
            (lang, group, b"\n".join(p for p, _ in found), _narrowed(np.array([n for _, n in found], np.int64)))
            for (lang, group), found in groups.items()
        ]
    )


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    langs, groups, phrases, counts = zip(*rows) if rows else ([], [], [], [])
    columns = [pa.array(langs, pa.string()), pa.array(groups, pa.int32()), pa.array(phrases, pa.binary()), pa.array(counts, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["lang", "group", "phrases", "counts"])


def frequent_phrases(docs: DataFrame, support: int = 30, one_in: int = SAMPLE_ONE_IN) -> DataFrame:
    """lang, words, phrase, n of all phrases of up to four words that occur ``support`` times.

    ``docs`` has doc_id, text and lang; a null text is empty, a null lang is ``und``,
    rows that repeat count each time, other columns are not read. Languages of which
    no word occurs have no rows; each other one has a row of no words with the number
    of its words.
    """
    proposals = propose(docs, support, one_in).checkpoint()
    none = Filter.empty(proposals.count())
    proposed, before, frequent = none.with_keys(proposals), None, None
    while True:
        counted = _count_pass(docs, proposed, before, support).checkpoint()
        frequent = counted if frequent is None else frequent.unionByName(counted)
        wider = proposed.with_keys(counted.where(F.col("key").bitwiseAND(F.lit(3)) < LONGEST - 1))
        if wider == proposed:
            break
        proposed, before = wider, proposed
    named = Filter.empty(frequent.count()).with_keys(frequent)
    return _count_phrases(docs, named, support).where("n > 0").checkpoint()


def _exact(column: str) -> Column:
    return F.col(column).cast("decimal(38,0)")


def without_first(phrase: str = "phrase") -> Column:
    return F.expr(f"substring({phrase}, locate(' ', {phrase}) + 1)")


def without_last(phrase: str = "phrase", words: str = "words") -> Column:
    return F.call_function("substring_index", F.col(phrase), F.lit(" "), F.col(words) - 1)


def scored_phrases(frequent: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, score of the phrases that stand for themselves.

    The score is that of the weakest cut. A phrase goes if one that is longer by a
    word holds it and occurs 80 times for each 100 of its own; looking one word
    further is enough, as a still longer one occurs no more often than what it holds.
    """
    phrases = frequent.where("words > 0")
    candidates = phrases.where("words > 1").withColumnRenamed("n", "a")
    first = F.call_function("substring_index", F.col("phrase"), F.lit(" "), F.col("k"))
    cuts = (
        candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
        .withColumn("first", first)
        .withColumn("rest", F.expr("substring(phrase, length(first) + 2)"))
    )
    part = lambda name, n: phrases.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    score = F.call_function("div", F.lit(2_000_000).cast("decimal(38,0)") * F.col("a"), _exact("l") + _exact("r"))
    weakest = (
        cuts.join(part("first", "l"), ["lang", "first"])
        .join(part("rest", "r"), ["lang", "rest"])
        .select("lang", "phrase", "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut"))
    )
    around = candidates.where("words > 2").select(
        "lang", F.explode(F.array(without_last(), without_first())).alias("phrase"), F.col("a").alias("longer")
    )
    none = F.lit(None)
    together = (
        weakest.withColumn("longer", none.cast("bigint"))
        .unionByName(around.select("lang", "phrase", none.cast("bigint").alias("a"), none.cast(weakest.schema["cut"].dataType).alias("cut"), "longer"))
        .groupBy("lang", "phrase")
        .agg(F.max("a").alias("a"), F.min("cut").alias("cut"), F.max("longer").alias("longer"))
    )
    covered = F.coalesce(100 * _exact("longer") >= 80 * _exact("a"), F.lit(False))
    return together.where(~covered).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def top_of_each(df: DataFrame, by: str, spread: str, order: list[Column], most: int) -> DataFrame:
    """The first ``most`` rows of each group, with ``rank``, as a knock-out.

    Groups are dealt out by ``spread`` into heats of some RANKED_TOGETHER rows, and
    the best of each heat go on, until a group fits one task.
    """
    df = df.checkpoint()

    def best(df, *keys):
        return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= most)

    while True:
        largest = df.groupBy(by).count().agg(F.max("count")).first()[0] or 0
        if largest <= max(RANKED_TOGETHER, 4 * most):
            return best(df, by)
        heats = math.ceil(largest / max(RANKED_TOGETHER, 4 * most)) + 1
        dealt = df.withColumn("_heat", F.pmod(F.xxhash64(spread), F.lit(heats)))
        df = best(dealt, by, "_heat").drop("_heat", "rank").checkpoint()


def collocations(docs: DataFrame, support: int = 30, most: int = 2000, one_in: int = SAMPLE_ONE_IN) -> DataFrame:
    """The ``most`` best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Ties go to the more frequent phrase, then to the first in byte order. For nulls,
    repeated rows and empty tables see ``frequent_phrases``.
    """
    frequent = frequent_phrases(docs, support, one_in)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    top = top_of_each(scored_phrases(frequent), "lang", "phrase", order, most)
    totals = frequent.where("words = 0").select("lang", "n")
    return top.join(totals, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
