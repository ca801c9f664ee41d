"""Near-duplicate classes by BagMinHash.

A text is the multiset of its shingles of five words; two texts are near copies
if their weighted Jaccard similarity (shared over all, with counts) is at least
0.8. Each unit of a shingle's count is discretised weight, covered by
independent Poisson processes over dyadic intervals [0,1), [1,2), [2,4), ...
A point of a process hits one signature place at one time if it lies below the
shingle's count; a place keeps its earliest point. Two texts agree in a place
with a probability equal to their similarity. Points are made in order of time
only until every place has one, so the work hardly grows with the signature.

Bands of the signature bring candidates together, the signatures screen them,
and the overlap of the multisets decides.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from eventledger.llm.byte_words import chunks, joined_bytes, letters_and_digits, mixed, word_hashes
from eventledger.llm.components import compacted, components

WORDS, SIMILARITY = 5, 0.8
PLACES, ROWS = 256, 8  # 32 bands of 8 places: a pair at 0.8 meets with probability 0.997
# Pairs whose signatures agree less than this are not verified: 4 standard
# deviations below 0.8 at 256 places of half a byte.
SCREEN = 0.695
# The first round tries likelier pairs only, as the second looks at the rest.
FIRST_SCREEN = 0.735
# Members of a bucket in one piece; larger buckets are cut into pieces by a hash,
# and no task holds more than two pieces of a bucket at once.
PIECE = 512


def shingles(texts: list, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(hash, text number) of every shingle of all texts, and a digest of each text's words.

    A text of fewer words, but not none, has one shingle of them all; a text
    without words has none and an empty digest.
    """
    data, begins = joined_bytes(texts)
    hashes, starts, _ = word_hashes(data, letters_and_digits())
    first = np.searchsorted(starts, begins)  # first word of each text
    counts = np.diff(first)
    digests = [
        hashlib.md5(hashes[a:b].tobytes()).digest() if b > a else b""
        for a, b in zip(first[:-1], first[1:])
    ]
    owner = np.repeat(np.arange(len(texts)), counts)
    if len(hashes) >= words:
        n = len(hashes) - words + 1
        total = np.zeros(n, np.uint64)
        for i in range(words):
            total = mixed(total + hashes[i : n + i] + np.uint64(i + 1))
        inside = owner[:n] == owner[words - 1 :]
        out, whose = total[inside], owner[:n][inside]
    else:
        out, whose = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    few = np.flatnonzero((counts > 0) & (counts < words))
    if len(few):
        short = []
        for t in few:
            total = np.zeros(1, np.uint64)
            for i, h in enumerate(hashes[first[t] : first[t + 1]]):
                total = mixed(total + h + np.uint64(i + 101))
            short.append(total[0])
        out, whose = np.concatenate([out, np.array(short, np.uint64)]), np.concatenate([whose, few])
    return out, whose, digests


def weighted(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, count) of the different shingles of each text."""
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return hashes[at], owner[at], np.diff(np.append(at, len(hashes)))


def signatures(hashes: np.ndarray, owner: np.ndarray, counts: np.ndarray, texts: int, places: int = PLACES) -> np.ndarray:
    """BagMinHash signatures: per text and place the (hashed) time of its earliest point.

    Two texts share a time only if they share the point. Texts without shingles
    have zeros.
    """
    times = np.full(texts * places, np.inf)
    weight = np.bincount(owner, weights=counts, minlength=texts)
    open_ = weight > 0
    horizon = np.zeros(texts)
    # by this time most texts have a point in every place; those that do not go on
    horizon[open_] = places * (np.log(places) + 1.0) / weight[open_]
    pending = _processes(hashes, owner, counts)
    while open_.any():
        for process in pending:
            process.run(horizon, times, places)
        open_ &= ~np.isfinite(times.reshape(texts, places)).all(axis=1)
        horizon[open_] *= 1.2
        pending = [p.only(open_) for p in pending]
    out = mixed(times.view(np.uint64)).reshape(texts, places)
    out[weight == 0] = 0
    return out


class _Process:
    """Poisson processes of many shingles over one interval of weight [low, low + width)."""

    def __init__(self, low, width, seed, owner, limit, at=None, step=None):
        self.low, self.width = low, width
        self.seed, self.owner, self.limit = seed, owner, limit
        self.step = np.ones(len(seed), np.uint64) if step is None else step
        self.draw = mixed(seed + self.step * _GOLDEN)
        self.at = self._gap(self.draw) if at is None else at

    def _gap(self, draw):
        """The time to the next point; a wider interval is that much faster."""
        return -np.log(((draw >> np.uint64(16)).astype(np.float64) + 1.0) * 2.0**-48) / self.width

    def run(self, horizon, times, places):
        """Enter all points up to the horizon of each text."""
        now = np.flatnonzero(self.at <= horizon[self.owner])
        while len(now):
            draw, at, owner = self.draw[now], self.at[now], self.owner[now]
            slot = owner * places + (draw & np.uint64(0xFFFF)).astype(np.int64) % places
            if self.width == 1:  # wholly below the count of every shingle in it
                np.minimum.at(times, slot, at)
            else:
                height = self.low + (mixed(draw ^ _HEIGHT) >> np.uint64(32)).astype(np.float64) * (self.width * 2.0**-32)
                below = height < self.limit[now]
                np.minimum.at(times, slot[below], at[below])
            self.step[now] += np.uint64(1)
            draw = mixed(self.seed[now] + self.step[now] * _GOLDEN)
            at = at + self._gap(draw)
            self.draw[now], self.at[now] = draw, at
            now = now[at <= horizon[owner]]

    def only(self, texts):
        """The processes of some of the texts, in their present state."""
        keep = texts[self.owner]
        return _Process(
            self.low, self.width, self.seed[keep], self.owner[keep], self.limit[keep], self.at[keep], self.step[keep]
        )


_GOLDEN, _HEIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _processes(hashes, owner, counts) -> list[_Process]:
    """Dyadic intervals [0, 1), [1, 2), [2, 4), ... up to the largest count."""
    found, low, width = [], 0, 1
    while len(hashes):
        found.append(_Process(low, width, mixed(hashes + np.uint64(2 * low + 1)), owner, counts))
        low, width = low + width, max(1, low + width)
        keep = counts > low
        hashes, owner, counts = hashes[keep], owner[keep], counts[keep]
    return found


def _sketch(batches):
    """Per document its text's digest, band keys, and half a byte per signature place."""
    bands = PLACES // ROWS
    for batch in batches:
        texts = batch.column("text").to_pylist()
        ids, hashed = batch.column("doc_id"), batch.column("text_hash")
        for part in chunks(texts):
            h, owner, digests = shingles(texts[part])
            n = len(digests)
            signature = signatures(*weighted(h, owner), n)
            keys = np.zeros((n, bands), np.uint64)
            for i in range(ROWS):
                keys = mixed(keys + signature[:, i::ROWS][:, :bands] + np.arange(bands, dtype=np.uint64))
            low = (signature & np.uint64(0xF)).astype(np.uint8)
            small = low[:, ::2] << 4 | low[:, 1::2]
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(part.start, n),
                    hashed.slice(part.start, n),
                    pa.array([d or None for d in digests], pa.binary()),
                    pa.ListArray.from_arrays(
                        np.arange(0, n * bands + 1, bands, dtype=np.int32), keys.reshape(-1).view(np.int64)
                    ),
                    pa.array([row.tobytes() for row in small], pa.binary()),
                ],
                names=["doc_id", "text_hash", "tid", "keys", "small"],
            )


def _units(batches):
    """Per text its multiset as a set: the k-th copy of a shingle is a unit of its own."""
    for batch in batches:
        texts, tids = batch.column("text").to_pylist(), batch.column("tid")
        for part in chunks(texts):
            h, owner, digests = shingles(texts[part])
            h, owner, counts = weighted(h, owner)
            rank = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            units = mixed(np.repeat(h, counts) + rank.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
            ends = np.cumsum(np.bincount(np.repeat(owner, counts), minlength=len(digests)))
            yield pa.RecordBatch.from_arrays(
                [
                    tids.slice(part.start, len(digests)),
                    pa.ListArray.from_arrays(
                        np.concatenate([[0], ends]).astype(np.int32), units.view(np.int64)
                    ),
                ],
                names=["tid", "units"],
            )


def _groups(batches):
    """Whole groups of rows with equal (key, piece) from rows sorted by them, as Arrow tables."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        key, piece = table.column("key").to_numpy(), table.column("piece").to_numpy()
        cuts = np.flatnonzero((key[1:] != key[:-1]) | (piece[1:] != piece[:-1])) + 1
        if len(cuts):
            yield table.slice(0, int(cuts[-1])), np.concatenate([[0], cuts])
            rest = table.slice(int(cuts[-1]))
        else:
            rest = table
    if rest is not None and rest.num_rows:
        yield rest, np.array([0, rest.num_rows])


def _agreement(small: np.ndarray, others: np.ndarray | None = None) -> np.ndarray:
    """Estimated similarity of all pairs of a piece, or of each of it with each of the others.

    Row by row; half a byte agrees by chance in 1 of 16.
    """
    small = np.concatenate([small >> 4, small & 15], axis=1)
    within = others is None
    others = small if within else np.concatenate([others >> 4, others & 15], axis=1)
    out = np.zeros((len(small), len(others)), np.float32)
    for i in range(len(small)):
        first = i + 1 if within else 0
        out[i, first:] = (others[first:] == small[i]).mean(axis=1)
    return (out - 1 / 16) / (1 - 1 / 16)


class _Forest:
    """Which members are joined already."""

    def __init__(self, names):
        self.above = {name: name for name in names}

    def root(self, name):
        while self.above[name] != name:
            self.above[name] = self.above[self.above[name]]
            name = self.above[name]
        return name

    def join(self, one, two) -> bool:
        one, two = self.root(one), self.root(two)
        self.above[one] = two
        return one != two


def _likely(small: np.ndarray):
    """Pairs of a piece whose signatures agree enough for the first round, the most similar first."""
    likely = _agreement(small)
    one, two = np.nonzero(likely >= FIRST_SCREEN)
    order = np.argsort(-likely[one, two], kind="stable")
    return zip(one[order].tolist(), two[order].tolist())


# What a row of a tile is: of the first piece, whose pairs are looked at here (INNER)
# or in another tile (OUTER), or of the second piece (OTHER).
INNER, OUTER, OTHER = 0, 1, 2


def _likely_in_tile(small: np.ndarray, side: np.ndarray):
    """Pairs of a tile's first piece with its second, and within an inner first piece, the most similar first."""
    first, second = np.flatnonzero(side != OTHER), np.flatnonzero(side == OTHER)
    found = []
    blocks = [(first, second, _agreement(small[first], small[second]))]
    if (side == INNER).any():
        blocks.append((first, first, _agreement(small[first])))
    for left, right, likely in blocks:
        one, two = np.nonzero(likely >= SCREEN)
        found.append((left[one], right[two], likely[one, two]))
    one, two, value = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(-value, kind="stable")
    return zip(one[order].tolist(), two[order].tolist())


def _pairs(left: list, right: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(map(min, left, right), pa.binary()), pa.array(map(max, left, right), pa.binary())], names=["u", "v"]
    )


def _forest_pairs(batches):
    """A spanning forest of the likely pairs of each piece: fewer pairs than members."""
    for table, cuts in _groups(batches):
        tids = table.column("tid").to_pylist()
        small = np.array([np.frombuffer(b, np.uint8) for b in table.column("small").to_pylist()])
        left, right = [], []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if b - a < 2:
                continue
            forest = _Forest(range(a, b))
            for i, j in _likely(small[a:b]):
                if forest.join(a + i, a + j):
                    left.append(tids[a + i])
                    right.append(tids[a + j])
        yield _pairs(left, right)


def _links_between(similarity: float):
    """Verified links of a tile that join two components, found among all its likely pairs.

    The links form a forest over the components: fewer of them than components.
    """

    def run(batches):
        for table, cuts in _groups(batches):
            tids = table.column("tid").to_pylist()
            small = np.array([np.frombuffer(b, np.uint8) for b in table.column("small").to_pylist()])
            side, component = table.column("side").to_numpy(), table.column("component").to_pylist()
            units = table.column("units").combine_chunks()
            ends, values = units.offsets.to_numpy(), units.values.to_numpy()
            left, right = [], []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                forest = _Forest(component[a:b])
                for i, j in _likely_in_tile(small[a:b], side[a:b]):
                    i, j = a + i, a + j
                    if forest.root(component[i]) == forest.root(component[j]):
                        continue
                    one, two = values[ends[i] : ends[i + 1]], values[ends[j] : ends[j + 1]]
                    if min(len(one), len(two)) < similarity * max(len(one), len(two)):
                        continue
                    shared = len(np.intersect1d(one, two, assume_unique=True))
                    if shared >= similarity * (len(one) + len(two) - shared):
                        forest.join(component[i], component[j])
                        left.append(tids[i])
                        right.append(tids[j])
            yield _pairs(left, right)

    return run


def _tiles(members: DataFrame) -> DataFrame:
    """Each member of an open bucket in every tile it takes part in: key, piece (the tile), tid, component, side.

    ``members`` has key, tid, component, inside (of the bucket's main component),
    n_all and n_main. What is inside and what is not are cut into pieces; a tile
    is two pieces outside, or one outside and one inside, so each pair of which
    one is outside lies in one tile. Pairs inside are joined already.
    """
    pieces = lambda n: F.greatest(F.ceil(n / F.lit(PIECE)), F.lit(1)).cast("int")
    outer, inner = pieces(F.col("n_all") - F.col("n_main")), pieces(F.col("n_main"))
    own = F.pmod(F.xxhash64("tid"), F.when(F.col("inside"), inner).otherwise(outer)).cast("int")
    tile = lambda piece, side: F.struct(piece.cast("bigint").alias("piece"), side.cast("int").alias("side"))
    each = lambda n: F.sequence(F.lit(0), n - 1)
    a = F.col("own")
    with_main = F.transform(
        each(F.col("inner")),
        lambda c: tile(a.cast("bigint") * F.col("stride") + F.col("outer") + c, F.when(c == 0, INNER).otherwise(OUTER)),
    )
    with_outer = F.transform(
        F.filter(each(F.col("outer")), lambda o: o != a),
        lambda o: tile(F.least(a, o).cast("bigint") * F.col("stride") + F.greatest(a, o), F.when(a < o, OUTER).otherwise(OTHER)),
    )
    of_main = F.transform(each(F.col("outer")), lambda o: tile(o.cast("bigint") * F.col("stride") + F.col("outer") + a, F.lit(OTHER)))
    return (
        members.select("*", own.alias("own"), outer.alias("outer"), inner.alias("inner"), (outer + inner).alias("stride"))
        .select("key", "tid", "component", F.explode(F.when(F.col("inside"), of_main).otherwise(F.concat(with_main, with_outer))).alias("tile"))
        .select("key", "tile.piece", "tid", "component", "tile.side")
    )


def _by_piece(members: DataFrame) -> DataFrame:
    """Rows of a piece of a bucket together, in the order that ``_groups`` expects."""
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return members.repartition(parts, "key", "piece").sortWithinPartitions("key", "piece", "tid")


def _verified(pairs: DataFrame, units: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose multisets overlap enough."""
    one = units.select(F.col("tid").alias("u"), F.col("units").alias("left"))
    two = units.select(F.col("tid").alias("v"), F.col("units").alias("right"))
    shared = F.size(F.array_intersect("left", "right"))
    every = F.size("left") + F.size("right") - shared
    return pairs.join(one, "u").join(two, "v").where(shared >= F.lit(similarity) * every).select("u", "v")


def near_classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The class of near copies of each document.

    One row per row of ``docs``: doc_id, text_hash, text_id (texts of equal words
    share it), class_id (the smallest doc_id of the class), class_size (rows).
    Classes are the connected components of the links. Texts without words (null,
    empty, only signs) are near nothing: each such row is a class of its own with
    a null text_id. ``class_key`` names the class by a text and tells classes of
    documents without ids apart. Other columns are not read.

    Links are found in two rounds over the buckets of all bands. The first
    verifies a spanning forest of each piece of a bucket. The second verifies, in
    tiles of two pieces of the buckets that still hold several components, every
    likely pair of two components, so what stays unverified cannot join anything. Copies of
    one text are one node throughout.
    """
    sketched = (
        docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("text_hash"), F.coalesce("text", F.lit("")).alias("text"))
        .mapInArrow(_sketch, "doc_id bigint, text_hash bigint, tid binary, keys array<bigint>, small binary")
        .checkpoint()
    )
    texts = sketched.where("tid is not null").groupBy("tid").agg(
        F.any_value(F.struct("doc_id", "text_hash")).alias("row"),
        F.any_value("keys").alias("keys"),
        F.any_value("small").alias("small"),
    ).checkpoint()
    keys = texts.select("tid", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    buckets = keys.join(shared, "key").checkpoint()
    wanted = texts.join(buckets.select("tid").distinct(), "tid", "left_semi").select("tid", "row", "small").checkpoint()
    units = (
        docs.select(F.col("doc_id").cast("bigint").alias("_id"), F.xxhash64("text").alias("_hash"), "text")
        .join(wanted, F.col("_id").eqNullSafe(F.col("row.doc_id")) & (F.col("_hash") == F.col("row.text_hash")))
        .select("tid", "text")
        .mapInArrow(_units, "tid binary, units array<bigint>")
        .dropDuplicates(["tid"])
        .checkpoint()
    )
    pieces = F.ceil(F.col("n") / F.lit(PIECE)).cast("int")
    own = F.pmod(F.xxhash64("tid"), pieces).cast("int")
    small = wanted.select("tid", "small")

    first = buckets.join(small, "tid").select("key", own.alias("piece"), "tid", "small")
    tried = compacted(_by_piece(first).mapInArrow(_forest_pairs, "u binary, v binary").distinct())
    links = compacted(_verified(tried, units, similarity))
    joined = components(links)
    # which component each member of a bucket is in now, and the largest of the bucket
    sizes = joined.groupBy("component").agg(F.count("*").alias("members"))
    named = joined.join(sizes, "component").withColumnRenamed("node", "tid")
    labelled = buckets.join(named, "tid", "left").select(
        "key", "n", "tid", F.coalesce("component", "tid").alias("component"), F.coalesce("members", F.lit(1)).alias("members")
    ).checkpoint()
    open_buckets = (
        labelled.groupBy("key")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max_by("component", "members").alias("main"))
        .where("low != high")
        .select("key", "main")
    )
    members = labelled.join(open_buckets, "key")
    inside = F.col("component") == F.col("main")
    # the multisets travel with the members of open buckets, so that no pair has to be sent to be verified
    second = _tiles(
        members.join(
            members.groupBy("key").agg(F.count("*").alias("n_all"), F.count(F.when(inside, 1)).alias("n_main")), "key"
        ).select("key", "tid", "component", inside.alias("inside"), "n_all", "n_main")
    ).join(small, "tid").join(units, "tid").select("key", "piece", "tid", "small", "units", "side", "component")
    more = compacted(
        _by_piece(second).mapInArrow(_links_between(similarity), "u binary, v binary").distinct()
    )
    final = components(links.union(more)).withColumnRenamed("node", "tid").withColumnRenamed("component", "_class")
    lone = F.concat(F.lit("-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("-"), F.col("text_hash").cast("string"))
    rows = (
        sketched.select("doc_id", "text_hash", "tid")
        .join(final, "tid", "left")
        .select("doc_id", "text_hash", F.lower(F.hex("tid")).alias("text_id"), F.coalesce(F.lower(F.hex(F.coalesce("_class", "tid"))), lone).alias("class_key"))
    )
    classes = rows.groupBy("class_key").agg(
        F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")
    )
    return rows.join(classes, "class_key").select(
        "doc_id",
        "text_hash",
        "text_id",
        "class_key",
        "class_id",
        F.when(F.col("text_id").isNull(), F.lit(1)).otherwise(F.col("class_size")).cast("bigint").alias("class_size"),
    )


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` with one document of each class: the one of smallest id (null first).

    Of rows that repeat in full one stays. Texts without words are near nothing
    and all stay, but for such repeats.
    """
    own = "__near_dedup_row"
    name = lambda i, h: F.concat_ws(":", F.coalesce(i.cast("string"), F.lit("-")), h.cast("string"))
    chosen = (
        near_classes(docs, similarity)
        .groupBy("class_key")
        .agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
        .select(name(F.col("first.doc_id"), F.col("first.text_hash")).alias(own))
    )
    named = docs.withColumn(own, name(docs["doc_id"].cast("bigint"), F.xxhash64(docs["text"])))
    return named.join(chosen, own, "left_semi").dropDuplicates([own]).drop(own)
