"""Benchmark decontamination by a positional inverted index, in DataFrame operations only.

The benchmark's items are cut into windows of consecutive words. How often each
of its words occurs in the corpus is counted over all documents, and every window
is looked up by its rarest word: a posting (document, position) of that word,
shifted by the word's place in the window, is where the window would have to
begin. There the postings of the next rarer words, shifted likewise, must agree,
and at last all words. Only windows that pass leave the scan, so the corpus is
read, but not shuffled.
"""

from pyspark.sql import Column, DataFrame, functions as F

from eventledger.llm.common import text_or_empty

WINDOW = 10

# Postings are matched against at most this many (window, item) pairs at a time,
# which bounds what is broadcast; more of them take further passes.
PAIRS_PER_PASS = 200_000
# Up to so many benchmark words are broadcast for counting; beyond, a shuffle join is used.
WORDS_BROADCAST = 500_000

# Everything but ASCII letters and digits and all that is not ASCII parts words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words in lower case (A-Z only)."""
    # lower() treats ASCII alike and is faster, but folds other letters too
    ascii_only = F.octet_length(text) == F.char_length(text)
    folded = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(folded, SEPARATORS), "")


def windows_of(benchmark: DataFrame, width: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(windows: window, words; pairs: window, item). Short items are one window."""
    items = benchmark.select(
        F.col("item_id").cast("string").alias("item"), words_of(text_or_empty()).alias("all")
    ).where(F.size("all") > 0)
    cut = items.select(
        "item",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.greatest(F.size("all") - width, F.lit(0))),
                lambda at: F.slice("all", at + 1, width),
            )
        ).alias("words"),
    ).withColumn("window", F.md5(F.concat_ws(" ", "words")))
    return (
        cut.groupBy("window").agg(F.any_value("words").alias("words")),
        cut.select("window", "item").distinct(),
    )


def word_counts(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """How often each word of the windows occurs in all documents."""
    wanted = windows.select(F.explode("words").alias("word")).distinct().checkpoint()
    words = docs.select(F.explode_outer(words_of(text_or_empty())).alias("word"))
    if wanted.count() <= WORDS_BROADCAST:
        return words.join(F.broadcast(wanted), "word").groupBy("word").agg(F.count("*").alias("n"))
    return words.groupBy("word").agg(F.count("*").alias("n")).join(wanted, "word")


def anchored(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """Windows all of whose words occur in the corpus, with their words by rarity.

    ``order`` lists (count, place, word), the rarest first.
    """
    placed = windows.select("window", "words", F.posexplode("words").alias("place", "word"))
    return (
        placed.join(counts, "word")
        .groupBy("window")
        .agg(
            F.any_value("words").alias("words"),
            F.array_sort(F.collect_list(F.struct("n", "place", "word"))).alias("order"),
        )
        .where(F.size("order") == F.size("words"))
        .select(
            "window",
            "words",
            F.size("words").alias("width"),
            F.col("order")[0]["word"].alias("anchor"),
            F.col("order")[0]["place"].alias("place"),
            F.get("order", F.lit(1))["word"].alias("second"),
            F.get("order", F.lit(1))["place"].alias("second_place"),
        )
    )


def matches(
    docs: DataFrame,
    benchmark: DataFrame,
    width: int = WINDOW,
    near: float | None = None,
    slack: int = 3,
) -> DataFrame:
    """Where the benchmark occurs.

    Rows: doc_id, text_hash, n_words, window, item, start, width, exact. Besides,
    each row of ``docs`` gives one row with its ``n_words`` and no window, so
    documents without words or matches are there too. ``start`` counts words
    from 0.

    With ``near`` there are rows with ``exact`` false as well: the rarest word is
    in its place, and at least that share of the window's different words is
    found between ``slack`` words before the window's place and ``slack`` after.
    """
    windows, pairs = windows_of(benchmark, width)
    windows, pairs = windows.checkpoint(), pairs.checkpoint()
    lists = anchored(windows, word_counts(docs, windows)).checkpoint()
    passes = max(1, -(-pairs.count() // PAIRS_PER_PASS))
    # a first, empty word stands for the document itself
    terms = docs.select(
        F.col("doc_id").cast("bigint"),
        F.xxhash64("text").alias("text_hash"),
        F.concat(F.array(F.lit("")), words_of(text_or_empty())).alias("terms"),
    )
    found = None
    for number in range(passes):
        own = pairs.where(F.pmod(F.xxhash64("window", "item"), F.lit(passes)) == number)
        wanted = lists.join(own.select("window").distinct(), "window", "left_semi")
        postings = terms.select("*", F.posexplode_outer("terms").alias("at", "term"))
        start = F.col("at") - 1 - F.col("place")
        there = F.slice("terms", start + 2, F.col("width"))
        exact = (start >= 0) & (
            F.col("second").isNull()
            | (F.get("terms", start + 1 + F.col("second_place")) == F.col("second"))
        ) & (there == F.col("words"))
        if near is None:
            hit = exact
        else:
            first = F.greatest(start - slack, F.lit(0))
            around = F.slice("terms", first + 2, F.col("width") + 2 * slack)
            hit = F.size(F.array_intersect("words", around)) >= F.ceil(
                F.lit(near) * F.size(F.array_distinct("words"))
            )
            hit = exact | hit
        is_head = F.lit(number == 0) & (F.col("at") == 0)
        joined = (
            postings.join(F.broadcast(wanted), F.col("term") == F.col("anchor"), "left")
            .where(is_head | (F.col("anchor").isNotNull() & hit))
            .select(
                "doc_id",
                "text_hash",
                F.when(F.col("at") == 0, F.size("terms") - 1).alias("n_words"),
                F.col("window"),
                F.when(F.col("at") > 0, F.greatest(start, F.lit(0))).alias("start"),
                F.col("width"),
                F.when(F.col("at") > 0, exact).alias("exact"),
            )
        )
        with_items = joined.join(F.broadcast(own), "window", "left").select(
            "doc_id", "text_hash", "n_words", "window", "item", "start", "width", "exact"
        )
        found = with_items if found is None else found.unionByName(with_items)
    return found


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """What each document shares with the benchmark.

    One row per row of ``docs``: doc_id, text_hash, n_words, n_hit (words inside any
    occurrence of a window), n_items, items_sha256, contaminated. Null and empty
    texts have no words; an empty benchmark hits nothing; items without an id hit
    words, but are not counted as items. Rows of ``docs`` that repeat in full get
    a row each. Other columns are not read.
    """
    places = F.sort_array(F.collect_set(F.when(F.col("window").isNotNull(), F.struct("start", "width"))))
    per_text = (
        matches(docs, benchmark, width)
        .groupBy("doc_id", "text_hash")
        .agg(
            F.max("n_words").cast("bigint").alias("n_words"),
            F.count("n_words").alias("copies"),
            places.alias("places"),
            F.sort_array(F.collect_set("item")).alias("items"),
        )
    )
    zero = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("bigint").alias("hit"))

    def extend(so_far, place):
        end = place["start"] + place["width"]
        new = F.greatest(end - F.greatest(so_far["upto"], place["start"]), F.lit(0))
        return F.struct(
            F.greatest(so_far["upto"], end).alias("upto"), (so_far["hit"] + new).alias("hit")
        )

    hit = F.aggregate("places", zero, extend, lambda s: s["hit"])
    return per_text.select(
        "doc_id",
        "text_hash",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
        F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("copy"),
    ).drop("copy")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that share no window with the benchmark, with all their columns."""
    own = "__decontaminate_row"
    name = lambda i, h: F.concat_ws(":", F.coalesce(i.cast("string"), F.lit("-")), h.cast("string"))
    hit = contamination(docs, benchmark, width).where("contaminated")
    named = docs.withColumn(own, name(docs["doc_id"].cast("bigint"), F.xxhash64(docs["text"])))
    gone = hit.select(name(F.col("doc_id"), F.col("text_hash")).alias(own)).distinct()
    return named.join(gone, own, "left_anti").drop(own)
