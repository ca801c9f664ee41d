"""Language-model scores from a probabilistic suffix tree.

Symbols are the bytes of the text's words in lower case, a space between two
words and an end. Over all training documents the runs of DEPTH + 1 symbols are
counted. A context of 1 to DEPTH symbols becomes a state if what follows it
differs from what follows its own suffix by more than chance: the log-likelihood
gained must exceed a price for each symbol kind of its distribution. Distributions are
smoothed with those of the suffix. Every context that passes is kept; only the
test, whose price rises with the corpus, bounds the tree. A text is scored by the
longest state that ends at each symbol: the different runs of a batch of texts are
followed down the tree together, from the root to longer and longer contexts.

Beside it stands the unigram baseline over whole words, whose counts are kept as
a table and joined; only the most frequent ones, a bounded number, are sent to
the tasks.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from eventledger.llm.byte_words import chunks, joined_bytes, not_space, word_hashes
from eventledger.llm.common import share

DEPTH = 5
# Contexts are tested from this many occurrences on.
LEAST_COUNT = 8
# A context must gain this much log-likelihood per symbol kind and per e-fold of the corpus.
PRICE = 0.1
# Words whose counts are sent to the tasks.
FREQUENT = 1 << 17

# The symbols between words and at the end of a text.
SPACE, END = 0x20, 0x0A


def symbols(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols of all texts, where each text begins, word hashes, first word of each text)."""
    data, begins = joined_bytes(texts)
    table = not_space()
    hashes, starts, ends = word_hashes(data, table)
    folded = np.where(table[data] > 0, table[data] - 1, SPACE).astype(np.uint8)
    keep = table[data] > 0
    keep[ends] = True  # the place behind a word
    first = np.searchsorted(starts, begins)
    has_words = first[1:] > first[:-1]
    last = begins[1:] - 1
    last[has_words] = ends[first[1:][has_words] - 1]
    folded[last] = END
    keep[last] = True
    upto = np.concatenate([[0], np.cumsum(keep)])
    return folded[keep], upto[begins], hashes, first


def packed_runs(stream: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Per symbol the run of DEPTH + 1 symbols that ends there, packed into an integer.

    Before a text stand DEPTH ends.
    """
    n = len(stream)
    into = np.arange(n) - np.repeat(begins[:-1], np.diff(begins))
    packed = np.zeros(n, np.int64)
    for back in range(DEPTH, -1, -1):
        symbol = np.full(n, END, np.int64)
        if back < n:
            symbol[back:] = stream[: n - back]
        symbol[into < back] = END
        packed = packed << 8 | symbol
    return packed


def run_counts(stream: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different runs of DEPTH + 1 symbols with counts."""
    return np.unique(packed_runs(stream, begins), return_counts=True)


def _gathered(batches):
    """Counts of runs (kind 0) and of words (kind 1) of one task's training texts."""
    held: list[dict[int, tuple[np.ndarray, np.ndarray]]] = []
    texts_seen = 0

    def merged(parts):
        keys = np.concatenate([p[0] for p in parts])
        counts = np.concatenate([p[1] for p in parts])
        found, where = np.unique(keys, return_inverse=True)
        return found, np.bincount(where, weights=counts).astype(np.int64)

    stacks: dict[int, list] = {0: [], 1: []}
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for part in chunks(texts):
            stream, begins, words, _ = symbols(texts[part])
            texts_seen += len(begins) - 1
            stacks[0].append(run_counts(stream, begins))
            stacks[1].append(np.unique(words.view(np.int64), return_counts=True))
            for kind, stack in stacks.items():
                # merge equals of like size, so each count is merged a few times only
                while len(stack) > 1 and len(stack[-2][0]) < 2 * len(stack[-1][0]):
                    stack[-2:] = [merged(stack[-2:])]
                if sum(len(s[0]) for s in stack) > 4_000_000:
                    yield _rows(kind, *merged(stack))
                    stack.clear()
    for kind, stack in stacks.items():
        if stack:
            yield _rows(kind, *merged(stack))
    yield _rows(2, np.zeros(1, np.int64), np.array([texts_seen], np.int64))


def _rows(kind: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.astype(np.int64)), pa.array(counts.astype(np.int64))],
        names=["kind", "key", "n"],
    )


def gather(training: DataFrame) -> DataFrame:
    """kind, key, n over all training documents: 0 runs, 1 words (by hash), 2 the number of texts."""
    return (
        training.select(F.coalesce("text", F.lit("")).alias("text"))
        .mapInArrow(_gathered, "kind int, key bigint, n bigint")
        .groupBy("kind", "key")
        .agg(F.sum("n").alias("n"))
    )


def retained(runs: DataFrame, depth: int = DEPTH, least: int = LEAST_COUNT) -> DataFrame:
    """(depth, context, symbol, n) of the root and of all contexts that pass the divergence test.

    ``runs`` has key and n.
    """

    def last(column: str, count: int) -> Column:
        return F.col(column).bitwiseAND(F.lit((1 << (8 * count)) - 1))

    by_depth = {depth: runs.select(F.col("key").alias("run"), "n")}
    for d in range(depth - 1, -1, -1):
        # every depth is read several times below
        by_depth[d] = (
            by_depth[d + 1].select(last("run", d + 1).alias("run"), "n").groupBy("run").agg(F.sum("n").alias("n"))
        ).checkpoint()
    total = by_depth[0].agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    found = None
    for d in range(1, depth + 1):
        own = by_depth[d].select(
            F.shiftright("run", 8).alias("context"), last("run", 1).alias("symbol"), last("run", d).alias("shorter"), "n"
        )
        sums = own.groupBy("context").agg(F.sum("n").alias("own_total"), F.count("*").alias("kinds")).where(F.col("own_total") >= least)
        above = by_depth[d - 1].select(F.col("run").alias("shorter"), F.col("n").alias("above"))
        above_sums = by_depth[d - 1].groupBy(F.shiftright("run", 8).alias("short_context")).agg(F.sum("n").alias("above_total"))
        tested = (
            own.join(sums, "context")
            .join(above, "shorter")
            .withColumn("short_context", last("context", d - 1))
            .join(above_sums, "short_context")
        )
        share = F.col("n") / F.col("own_total")
        gain = F.sum(F.col("n") * F.log(share / (F.col("above") / F.col("above_total"))))
        passed = (
            tested.groupBy("context")
            .agg(gain.alias("gain"), F.max("kinds").alias("kinds"))
            .where(F.col("gain") > PRICE * F.col("kinds") * math.log(max(total, 2)))
            .select(F.lit(d).alias("depth"), "context")
        )
        found = passed if found is None else found.unionByName(passed)
    kept = found.checkpoint()
    out = by_depth[0].select(F.lit(0).alias("depth"), F.lit(0).cast("bigint").alias("context"), F.col("run").alias("symbol"), "n")
    for d in range(1, depth + 1):
        follows = by_depth[d].select(F.shiftright("run", 8).alias("context"), last("run", 1).alias("symbol"), "n")
        chosen = kept.where(F.col("depth") == d).select("context")
        out = out.unionByName(
            follows.join(chosen, "context").select(F.lit(d).alias("depth"), "context", "symbol", "n")
        )
    return out


class SuffixTree:
    """The tree by depth: sorted contexts, and sorted runs of a context and a symbol that followed it.

    Its size is that of the kept counts, whatever the number of symbols.
    """

    def __init__(self, depths, contexts, symbols, counts, depth: int = DEPTH):
        """Four arrays of equal length: per state (its depth and packed context) what follows how often."""
        self.depth, self.retained = depth, 0
        self.runs, self.own, self.contexts, self.left = [], [], [], []
        for d in range(depth + 1):
            here = np.flatnonzero(depths == d)
            runs = contexts[here].astype(np.int64) << 8 | symbols[here]
            order = np.argsort(runs)
            runs, often = runs[order], counts[here][order]
            names, starts = np.unique(runs >> 8, return_index=True)
            kinds = np.diff(np.append(starts, len(runs)))
            every = np.add.reduceat(often, starts) + kinds if len(starts) else kinds
            # what has not followed here is left to the suffix, by the number of kinds seen
            self.runs.append(runs)
            self.own.append((often / np.repeat(every, kinds)).astype(np.float32))
            self.contexts.append(names)
            self.left.append((kinds / every).astype(np.float32))
            self.retained += len(names)
        root = np.flatnonzero(depths == 0)
        kinds, often = symbols[root].astype(np.int64), counts[root]
        self.root = np.full(256, 0.5 / (often.sum() + 128))
        self.root[kinds] = (often + 0.5) / (often.sum() + 128)
        # one column per symbol seen in training, and one for all others
        self.used = sorted({END, SPACE, *np.unique(symbols).tolist()})
        self.column = np.full(256, len(self.used), np.int64)
        self.column[self.used] = np.arange(len(self.used))
        self.width = len(self.used) + 1

    def chances(self, runs: np.ndarray, depth: int) -> np.ndarray:
        """The probability of the last symbol of each of the different ``runs`` after the ``depth`` before it."""
        if depth == 0:
            return self.root[runs]
        shorter, where = np.unique(runs & ((1 << 8 * depth) - 1), return_inverse=True)
        out = self.chances(shorter, depth - 1)[where]
        names, known = self.contexts[depth], self.runs[depth]
        if len(names):
            context = runs >> 8
            at = np.minimum(np.searchsorted(names, context), len(names) - 1)
            hit = np.flatnonzero(names[at] == context)
            out[hit] *= self.left[depth][at[hit]]
            follows = runs[hit]
            at = np.minimum(np.searchsorted(known, follows), len(known) - 1)
            seen = known[at] == follows
            out[hit[seen]] += self.own[depth][at[seen]]
        return out

    @property
    def logs(self) -> np.ndarray:
        """log10 of the probability of each column after each state, row by row; for looking into small trees."""
        ends = [*self.used, *np.flatnonzero(self.column == len(self.used))[:1]]
        rows = [
            self.chances(np.array([context << 8 | end]), d)
            for d in range(self.depth + 1)
            for context in self.contexts[d].tolist()
            for end in ends
        ]
        return np.log10(np.concatenate(rows)) if rows else np.zeros(0)

    def scores(self, stream: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """log10 probability of each text."""
        if len(stream) == 0:
            return np.zeros(len(begins) - 1)
        runs, where = np.unique(packed_runs(stream, begins), return_inverse=True)
        each = np.log10(self.chances(runs, self.depth))[where]
        return np.add.reduceat(each, begins[:-1])


def fit(counts: DataFrame) -> SuffixTree:
    found = retained(counts.where("kind = 0")).select(
        F.col("depth").cast("tinyint"), "context", F.col("symbol").cast("smallint"), "n"
    ).toArrow()
    return SuffixTree(*(found.column(c).to_numpy() for c in ("depth", "context", "symbol", "n")))


def score(docs: DataFrame, counts: DataFrame, tree: SuffixTree, frequent: int = FREQUENT) -> DataFrame:
    """Scores of every text: doc_id, text_hash, n_tokens, n_known, train_tokens, base_score, score.

    ``counts`` is the gathered table of the training documents. Null counts as
    empty; an empty text has one token, the end. Rows that repeat in full get a
    row each.
    """
    spark = docs.sparkSession
    words = counts.where("kind = 1").select(F.col("key").alias("word"), "n")
    sums = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    texts = counts.where("kind = 2").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    tokens, kinds = sums["n"] + texts, sums["v"] + (texts > 0)
    below = tokens + 0.5 * (kinds + 1)
    top = words.orderBy(F.desc("n"), "word").limit(frequent).toArrow()
    known, often = top.column("word").to_numpy(), top.column("n").to_numpy().astype(np.float64)
    by_hash = np.argsort(known)
    shared = share(spark, (tree, known[by_hash], often[by_hash]))
    end_log = math.log10((texts + 0.5) / below)
    parts = "doc_id bigint, text_hash bigint, word bigint, times bigint, tokens bigint, known bigint, base double, score double"

    def rows(batches):
        tree, known, often = shared()
        names = ["doc_id", "text_hash", "word", "times", "tokens", "known", "base", "score"]
        for batch in batches:
            texts_here = batch.column("text").to_pylist()
            for part in chunks(texts_here):
                stream, begins, hashes, first = symbols(texts_here[part])
                count = len(begins) - 1
                owner = np.repeat(np.arange(count), np.diff(first))
                hashes = hashes.view(np.int64)
                at = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
                hit = known[at] == hashes if len(known) else np.zeros(len(hashes), bool)
                logs = np.log10((often[at[hit]] + 0.5) / below)
                base = np.bincount(owner[hit], weights=logs, minlength=count) + end_log
                found = np.bincount(owner[hit], minlength=count) + int(texts > 0)
                ids, hashed = batch.column("doc_id").slice(part.start, count), batch.column("text_hash").slice(part.start, count)
                nothing = pa.nulls(count, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        hashed,
                        nothing,
                        nothing,
                        pa.array(np.diff(first) + 1, pa.int64()),
                        pa.array(found, pa.int64()),
                        pa.array(base, pa.float64()),
                        pa.array(tree.scores(stream, begins), pa.float64()),
                    ],
                    names=names,
                )
                # the other words, counted per text
                order = np.lexsort((hashes[~hit], owner[~hit]))
                word, whose = hashes[~hit][order], owner[~hit][order]
                new = np.ones(len(word), bool)
                new[1:] = (word[1:] != word[:-1]) | (whose[1:] != whose[:-1])
                firsts = np.flatnonzero(new)
                take = pa.array(whose[firsts])
                none, no_value = pa.nulls(len(firsts), pa.int64()), pa.nulls(len(firsts), pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(take),
                        hashed.take(take),
                        pa.array(word[firsts]),
                        pa.array(np.diff(np.append(firsts, len(word))), pa.int64()),
                        none,
                        none,
                        no_value,
                        no_value,
                    ],
                    names=names,
                )

    cut = (
        docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("text_hash"), F.coalesce("text", F.lit("")).alias("text"))
        .mapInArrow(rows, parts)
        .checkpoint()
    )
    rare = cut.where("word is not null").select("doc_id", "text_hash", "word", "times").join(words, "word", "left")
    c = F.coalesce("n", F.lit(0))
    told = rare.select(
        "doc_id",
        "text_hash",
        F.lit(None).cast("bigint").alias("tokens"),
        F.when(c > 0, F.col("times")).otherwise(0).alias("known"),
        (F.col("times") * F.log10((c + 0.5) / F.lit(below))).alias("base"),
        F.lit(None).cast("double").alias("score"),
    )
    heads = cut.where("word is null").select("doc_id", "text_hash", "tokens", "known", "base", "score")
    summed = heads.unionByName(told).groupBy("doc_id", "text_hash").agg(
        F.count("tokens").alias("copies"),
        F.max("tokens").alias("n_tokens"),
        F.sum("known").alias("known"),
        F.sum("base").alias("base"),
        F.max("score").alias("score"),
    )
    return summed.select(
        "doc_id",
        "text_hash",
        "n_tokens",
        (F.col("known") / F.col("copies")).cast("bigint").alias("n_known"),
        F.lit(tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") / F.col("copies")).alias("base_score"),
        "score",
        F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("copy"),
    ).drop("copy")
