"""Line dedup by a deletion-neighbourhood join, in DataFrame operations only.

A line goes if an earlier line (by document id, then place) equals it, or is one
word away: one word changed, added or left out, in lines of at least LEAST_WORDS
words. Words are what spaces part. Blank lines always stay.

1. Equal lines are found by their digest; the earliest of each is its place.
2. One edit leaves the first or the last half of a line as it was. Lines that
   share neither half with another line have no neighbour and are settled.
3. Each other line emits its deletion neighbourhood as hashed keys: the line
   without word i, with i kept in the key for changed words, and joined with
   whole lines for words added or left out. The hashes are exclusive ors of
   hashed (word, position), so a line of n words costs n log n, whatever its length.
4. Per key the earliest line is the candidate of the others, never all pairs.
   Lines that share a key of changed words are all one edit apart, so the
   earliest decides for them all. Candidates are verified on the words.

Texts are not shuffled: what a step needs of lines or keys is let through a bitmap
of hashes first, a broadcast table of at most BITMAP_WORDS rows that may let through
too much, never too little. From step 3 on a line is a number in the order of places.
"""

from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

from eventledger.operators.scale import number_in_order

LEAST_WORDS = 10

# Rows of a bitmap, each of 64 bits.
BITMAP_WORDS = 1 << 20

# A place is one number: the document id, 10 digits of its text's checksum, 9 of the line.
_PER_LINE, _PER_DOC = 10**9, Decimal(10**19)
PLACE = "decimal(38,0)"
# Ids that are null come before all others.
_NO_ID = -(2**63)


def _doc(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.crc32(F.encode("text", "UTF-8")).alias("crc"),
        *more,
    )


def _place(line: str = "line_no") -> Column:
    number = F.coalesce("doc_id", F.lit(_NO_ID)).cast("decimal(19,0)")
    inside = (F.col("crc") * _PER_LINE).cast("decimal(19,0)") + F.col(line)
    return (number * F.lit(_PER_DOC) + inside).cast(PLACE)


def _place_parts(place: str = "place") -> list[Column]:
    inside = F.pmod(place, F.lit(_PER_DOC))
    number = ((F.col(place) - inside).cast("string").substr(F.lit(1), F.length((F.col(place) - inside).cast("string")) - 19))
    number = F.when(F.col(place) == inside, F.lit("0")).otherwise(number).cast("bigint")
    inside = inside.cast("decimal(19,0)")
    crc = F.floor(inside / _PER_LINE).cast("bigint")
    return [
        F.when(number == _NO_ID, F.lit(None)).otherwise(number).alias("doc_id"),
        crc.alias("crc"),
        (inside - crc * _PER_LINE).cast("int").alias("line_no"),
    ]


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, crc, line_no, line; blank lines are left out."""
    return (
        _doc(docs.where(F.col("text").isNotNull()), F.posexplode_outer(F.split("text", "\n")).alias("line_no", "line"))
        .where(F.trim("line") != "")
    )


def _count(line: str) -> Column:
    """Words, as spaces part them."""
    return F.length(line) - F.length(F.replace(F.col(line), F.lit(" "), F.lit(""))) + 1


def _half(words: Column) -> Column:
    """The largest power of two of which two fit into all but one of the words."""
    return F.pow(F.lit(2), F.floor(F.log2((words - 1) / 2.0))).cast("int")


def distinct_lines(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """The earliest place of each different line, and the hashes of its halves.

    A line of n words may meet lines of n - 1 and n + 1; halves are powers of two,
    and where n and n - 1 have different halves both are hashed.
    """
    lines = _lines(docs).select("*", _count("line").alias("n"))
    large, small = _half(F.col("n")), _half(F.col("n") - 1)
    long = F.col("n") >= least_words

    cut = lines.select(
        _place().alias("place"),
        F.unhex(F.md5("line")).alias("digest"),
        F.when(long, large).alias("large"),
        F.when(long & (large != small), small).alias("small"),
        "line",
    )
    front = lambda half: F.xxhash64(F.lit(0), half, F.call_function("substring_index", F.col("line"), F.lit(" "), half))
    back = lambda half: F.xxhash64(F.lit(1), half, F.call_function("substring_index", F.col("line"), F.lit(" "), -half))
    hashed = cut.select(
        "place",
        "digest",
        *[
            F.when(F.col(half).isNotNull(), side(F.col(half))).alias(name)
            for name, half, side in (
                ("f1", "large", front),
                ("b1", "large", back),
                ("f2", "small", front),
                ("b2", "small", back),
            )
        ],
    )
    return hashed.groupBy("digest", "f1", "b1", "f2", "b2").agg(F.min("place").alias("place"))


def _with_neighbour(distinct: DataFrame) -> DataFrame:
    """Places of the lines that share a half with another line."""
    halves = distinct.select(
        "place", F.explode(F.filter(F.array("f1", "b1", "f2", "b2"), lambda x: x.isNotNull())).alias("half")
    )
    shared = halves.groupBy("half").agg(F.count("*").alias("n")).where("n > 1").select("half")
    return halves.join(shared, "half", "left_semi").select("place").distinct()


def _word_and_bit(hashed: Column) -> tuple[Column, Column]:
    return F.pmod(F.shiftrightunsigned(hashed, 6), F.lit(BITMAP_WORDS)).cast("int"), hashed.bitwiseAND(F.lit(63)).cast("int")


def _bitmap(members: DataFrame, hashed: Column) -> DataFrame:
    """The bits of the members' hashes; a row per word that has any."""
    word, bit = _word_and_bit(hashed)
    return (
        members.select(word.alias("_word"), bit.alias("_bit"))
        .groupBy("_word")
        .agg(F.expr("bit_or(shiftleft(1L, _bit))").alias("_mask"))
    )


def _let_through(rows: DataFrame, hashed: Column, bitmap: DataFrame) -> DataFrame:
    """Rows whose hash may be one of the bitmap's members."""
    word, bit = _word_and_bit(hashed)
    is_set = F.call_function("shiftright", F.col("_mask"), F.col("_bit")).bitwiseAND(F.lit(1).cast("bigint")) == 1
    marked = rows.withColumn("_word", word).withColumn("_bit", bit)
    return marked.join(F.broadcast(bitmap), "_word").where(is_set).select(*rows.columns)


def _scan(values: Column, size: Column) -> Column:
    """Running exclusive or over an array: each round doubles the reach, log2(size) rounds."""
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(size + 1.0)).cast("int"))
    return F.aggregate(
        rounds,
        values,
        lambda so_far, k: F.transform(
            so_far,
            lambda x, i: x.bitwiseXOR(
                F.coalesce(F.get(so_far, i - F.pow(F.lit(2), k).cast("int")), F.lit(0).cast("bigint"))
            ),
        ),
    )


def _neighbourhood(lines: DataFrame) -> DataFrame:
    """key, code for each variant of each line; the code is four times the line's number plus its role.

    Roles: 0 the whole line, 1 the line without one word, 2 the line with one word
    left open in its place.
    """
    zero = F.lit(0).cast("bigint")
    xor = lambda a, b: a.bitwiseXOR(b)
    hashed = lines.select(
        "number",
        F.size("words").alias("n"),
        F.transform("words", lambda w, i: F.xxhash64(w, i)).alias("here"),
        F.transform("words", lambda w, i: F.xxhash64(w, i - 1)).alias("moved"),
    )
    sums = hashed.select(
        "*",
        F.aggregate("here", zero, xor).alias("all_here"),
        F.aggregate("moved", zero, xor).alias("all_moved"),
        _scan(F.zip_with("here", "moved", xor), F.col("n")).alias("upto"),
    )
    # words before i stay, words after it move one place to the front
    without = F.transform(
        "here",
        lambda h, i: F.struct(
            F.xxhash64(
                F.lit(1),
                F.col("n") - 1,
                F.col("all_moved")
                .bitwiseXOR(F.coalesce(F.get("upto", i - 1), zero))
                .bitwiseXOR(F.get("moved", i)),
            ).alias("key"),
            F.lit(1).alias("role"),
        ),
    )
    left_open = F.transform(
        "here",
        lambda h, i: F.struct(
            F.xxhash64(F.lit(2), F.col("n"), i, F.col("all_here").bitwiseXOR(h)).alias("key"),
            F.lit(2).alias("role"),
        ),
    )
    whole = F.array(
        F.struct(F.xxhash64(F.lit(1), F.col("n"), F.col("all_here")).alias("key"), F.lit(0).alias("role"))
    )
    return sums.select("number", F.explode(F.concat(whole, without, left_open)).alias("variant")).select(
        "variant.key", (F.col("number") * 4 + F.col("variant.role")).alias("code")
    )


def one_edit(a: str, b: str) -> Column:
    """Whether two arrays of words are at most one changed, added or missing word apart."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    at = F.coalesce(F.array_position(same, F.lit(False)), F.lit(0)).cast("int")

    def rest(words: str, start: Column) -> Column:
        return F.slice(words, start, F.greatest(F.size(words) - start + 1, F.lit(0)))

    return (
        F.when(at == 0, F.lit(True))
        .when(F.size(a) == F.size(b), rest(a, at + 1) == rest(b, at + 1))
        .when(F.size(a) == F.size(b) + 1, rest(a, at + 1) == rest(b, at))
        .when(F.size(a) + 1 == F.size(b), rest(a, at) == rest(b, at + 1))
        .otherwise(F.lit(False))
    )


def _numbered_lines(docs: DataFrame, numbered: DataFrame) -> DataFrame:
    """number, words of the lines at the places of ``numbered`` (place, number)."""
    hashed = F.xxhash64("place")
    here = _lines(docs).select(_place().alias("place"), "line")
    return (
        _let_through(here, hashed, _bitmap(numbered, hashed))
        .join(numbered, "place")
        .dropDuplicates(["number"])
        .select("number", F.split("line", " ").alias("words"))
    )


def _near_copies(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """Places of different lines that are one edit from an earlier line."""
    numbered = number_in_order(_with_neighbour(distinct).checkpoint(), [F.col("place")], into="number").checkpoint()
    lines = _numbered_lines(docs, numbered).checkpoint()
    variants = _neighbourhood(lines)
    role = F.col("code").bitwiseAND(F.lit(3).cast("bigint"))
    first = lambda of: F.min(F.when(role == of, F.shiftright("code", 2)))
    # one line may give a key several times (equal neighbouring words): the earliest counts
    earliest = (
        variants.groupBy("key")
        .agg(
            first(0).alias("whole"),
            first(1).alias("without"),
            first(2).alias("left_open"),
            F.max(F.when(role == 2, F.shiftright("code", 2))).alias("last_open"),
        )
        .where(F.col("whole").isNotNull() & F.col("without").isNotNull() | (F.col("left_open") < F.col("last_open")))
        .drop("last_open")
        .checkpoint()
    )
    other = F.when(role == 0, F.col("without")).when(role == 1, F.col("whole")).otherwise(F.col("left_open"))
    pairs = (
        _let_through(variants, F.col("key"), _bitmap(earliest, F.col("key")))
        .join(earliest, "key")
        .select(F.shiftright("code", 2).alias("number"), other.alias("earlier"))
        .where(F.col("earlier") < F.col("number"))
        .distinct()
    )
    one = lines.select("number", F.col("words").alias("own"))
    two = lines.select(F.col("number").alias("earlier"), F.col("words").alias("others"))
    near = pairs.join(one, "number").join(two, "earlier").where(one_edit("own", "others")).select("number").distinct()
    return near.join(numbered, "number").select("place")


def line_verdicts(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """Which lines of each document stay.

    One row per row of ``docs``: doc_id, crc, n_lines, kept (line numbers from 0,
    ascending, blank lines included). Null has no lines, an empty text one blank
    line. The document id orders the documents, null first, and among documents of
    one id the checksum of the text; rows that repeat in full are one document
    and get the same verdict. Other columns are not read.
    """
    distinct = distinct_lines(docs, least_words).checkpoint()
    near = _near_copies(docs, distinct)
    kept = (
        distinct.select("place")
        .join(near, "place", "left_anti")
        .select(*_place_parts())
        .groupBy("doc_id", "crc")
        .agg(F.collect_set("line_no").alias("first"))
        .withColumnsRenamed({"doc_id": "_doc", "crc": "_crc"})
    )
    all_lines = F.split("text", "\n")
    numbers = F.sequence(F.lit(0), F.col("n_lines") - 1)
    blank = F.filter(F.transform(all_lines, lambda x, i: F.when(F.trim(x) == "", i)), lambda i: i.isNotNull())
    found = _doc(
        docs,
        F.coalesce(F.size(all_lines), F.lit(0)).alias("n_lines"),
        F.coalesce(blank, F.array().cast("array<int>")).alias("blank"),
    ).select("doc_id", "crc", F.when(F.col("n_lines") < 0, 0).otherwise(F.col("n_lines")).alias("n_lines"), "blank")
    joined = found.join(
        kept, F.col("doc_id").eqNullSafe(F.col("_doc")) & F.col("crc").eqNullSafe(F.col("_crc")), "left"
    )
    stay = F.array_union(F.coalesce("first", F.array().cast("array<int>")), "blank")
    return joined.select("doc_id", "crc", "n_lines", F.array_sort(stay).alias("kept"))


def dedup_lines(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with ``text`` reduced to its lines that stay, other columns as they are.

    Null texts stay null. A document all of whose lines came earlier is left out;
    one that had only blank lines to begin with stays.
    """
    own = "__line_dedup_"
    verdicts = (
        line_verdicts(docs, least_words)
        .groupBy("doc_id", "crc")
        .agg(F.any_value("n_lines").alias(f"{own}lines"), F.any_value("kept").alias(f"{own}kept"))
        .withColumnsRenamed({"doc_id": f"{own}doc", "crc": f"{own}crc"})
    )
    same = docs["doc_id"].cast("bigint").eqNullSafe(F.col(f"{own}doc")) & F.crc32(
        F.encode(docs["text"], "UTF-8")
    ).eqNullSafe(F.col(f"{own}crc"))
    lines = F.split("text", "\n")
    kept = F.transform(f"{own}kept", lambda i: F.get(lines, i))
    some_left = F.exists(kept, lambda x: F.trim(x) != "") | (F.size(f"{own}kept") == F.col(f"{own}lines"))
    left = docs.join(verdicts, same, "left").where(F.col("text").isNull() | some_left)
    return left.select(
        *[
            F.when(F.col("text").isNotNull(), F.array_join(kept, "\n")).alias("text") if c == "text" else F.col(f"`{c}`")
            for c in docs.columns
        ]
    )
