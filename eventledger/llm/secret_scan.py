"""Secret scan: fixed rules, and formats learned by grammar inference.

The fixed rules give the base spans. What they find in all texts are the labelled
credentials. From those of each kind a prefix tree with counts is built, and states
whose continuations do not differ statistically are merged into a probabilistic
automaton; ordinary words of the same alphabet give the automaton of what is not a
secret. Prefixes are counted in Spark. The driver merges those that many strings
share, as others have too few to differ by the test; then all strings are sent
through the automata, which gives the frequencies in each state. Every candidate of
every text is scored by how much likelier the formats are than ordinary text.
"""

import bisect
import hashlib
import math
import re
from collections import Counter, defaultdict

from pyspark.sql import DataFrame, functions as F

from eventledger.llm.common import arrow_map, share, text_or_empty

# The base rules, in the order of their kinds.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_CHARS, ACCESS_CHARS = 12, 18

# Any candidate: the rules for access keys and hex digits only match inside one.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
# What a candidate may consist of besides: names, hosts and paths with a secret behind them.
PART = re.compile(r"[A-Za-z0-9+_-]{12,}")
LEARNED = "learned"

# A kind with fewer strings than LEAST_STRINGS has no format.
LEAST_STRINGS = 20
# Continuations of prefixes that the driver merges, for each kind: those of the prefixes
# that most strings share. Prefixes are no longer than TREE_DEPTH.
TREE_ROWS, TREE_DEPTH = 1 << 13, 64
# Leads of longer strings are not remembered.
LONGEST_STRING = 256
# Two states differ if their frequencies do by this test (the smaller, the more is merged).
ALPHA = 0.05
# Log-likelihood by which a format must beat ordinary text in all, and the share of
# the ordinary words' occurrences whose lead per character a secret must exceed.
MARGIN, ORDINARY_SHARE = 14.0, 0.999
# Leads per character are told apart by this part of one.
LEAD_STEPS = 1024


def base_spans(text: str, candidates=None) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the fixed rules, each kind from the left, not overlapping."""
    spans = []
    if "=" in text or ":" in text:
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= ASSIGN_CHARS:
                spans.append((m.start(), "assign", m.end()))
    for start, word in candidates if candidates is not None else _candidates(text):
        if "AKIA" in word:
            for m in ACCESS.finditer(word):
                if m.end() - m.start() >= ACCESS_CHARS:
                    spans.append((start + m.start(), "access", start + m.end()))
        if len(word) >= 16:
            for m in HEX.finditer(word):
                spans.append((start + m.start(), "hex", start + m.end()))
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[1])))


def _candidates(text: str) -> list[tuple[int, str]]:
    return [(m.start(), m.group()) for m in CANDIDATE.finditer(text)]


def outside(found: list[tuple[int, str]], spans) -> list[tuple[int, str]]:
    """Candidates without what base spans cover: the rest of each run, and the parts of it.

    Both lists are by start. A rest of fewer than 12 characters is none.
    """
    taken, rest = iter([(s, e) for s, _, e in spans]), []
    busy: list[tuple[int, int]] = []
    following = next(taken, None)
    for start, word in found:
        end = start + len(word)
        while following is not None and following[0] < end:
            busy.append(following)
            following = next(taken, None)
        busy = [(s, e) for s, e in busy if e > start]
        at = start
        for s, e in busy:
            if s - at >= 12:
                rest.append((at, word[at - start : s - start]))
            at = max(at, e)
        if end - at >= 12:
            rest.append((at, word[at - start :]))
    every = []
    for start, word in rest:
        every.append((start, word))
        every += [(start + m.start(), m.group()) for m in PART.finditer(word) if m.group() != word]
    return every


def best_apart(scored: list[tuple[float, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of (lead, start, end) that do not overlap, those of greatest lead first."""
    chosen: list[tuple[int, int]] = []
    for _, start, end in sorted(scored, key=lambda x: (-x[0], x[1], x[2])):
        at = bisect.bisect(chosen, (start, end))
        if (at == 0 or chosen[at - 1][1] <= start) and (at == len(chosen) or end <= chosen[at][0]):
            chosen.insert(at, (start, end))
    return chosen


def joined(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


class Automaton:
    """A probabilistic automaton: per state the next states and how often each character followed.

    "" stands for the end of a string.
    """

    def __init__(self, moves: list[dict[str, int]], counts: list[dict[str, int]], alphabet: int = 70):
        self.moves, self.counts = moves, counts
        totals = [sum(found.values()) + 0.5 * (alphabet + 1) for found in counts]
        self.logs = [{c: math.log((n + 0.5) / t) for c, n in found.items()} for found, t in zip(counts, totals)]
        self.other = [math.log(0.5 / t) for t in totals]

    def score(self, word: str) -> float:
        state, total = 0, 0.0
        for c in word:
            known = self.logs[state].get(c)
            total += self.other[state] if known is None else known
            # a character that leads nowhere from this place leaves the state as it is
            state = self.moves[state].get(c, state)
        return total + self.logs[state].get("", self.other[state])

    def steps(self, word: str):
        """The states that a string passes, each with the character that follows."""
        state = 0
        for c in word:
            yield state, c
            state = self.moves[state].get(c, state)
        yield state, ""


def infer(strings: Counter) -> Automaton:
    """The automaton of ``strings`` (with counts), from their whole prefix tree."""
    following: dict[str, Counter] = defaultdict(Counter)
    for string, count in strings.items():
        for at in range(len(string) + 1):
            following[string[:at]][string[at : at + 1]] += count
    return merged(following)


def merged(following: dict[str, dict[str, int]]) -> Automaton:
    """Merge compatible states of a prefix tree: how often each character follows each prefix.

    With a prefix its beginnings are in the tree; a character may follow without
    a prefix of its own. States are visited from the root. Each new one is merged with the first
    settled state from which all continuations have compatible frequencies, or
    becomes settled itself. "" stands for the end of a string.
    """
    number = {prefix: i for i, prefix in enumerate(sorted(following))}
    children: list[dict[str, int]] = [{} for _ in number]
    through = [Counter(following[prefix]) for prefix in number]
    total = [found.total() for found in through]
    for prefix, i in number.items():
        if prefix:
            children[number[prefix[:-1]]][prefix[-1]] = i
    bound = math.sqrt(0.5 * math.log(2 / ALPHA))

    def alike(a: int, b: int) -> bool:
        """Frequencies of the next characters agree within Hoeffding's bound, all the way down."""
        pending = [(a, b)]
        while pending:
            a, b = pending.pop()
            na, nb = total[a], total[b]
            # no frequency differs by more than 1, and what lies below b is rarer still
            if not na or not nb or bound / math.sqrt(nb) >= 1:
                continue
            gap = bound * (1 / math.sqrt(na) + 1 / math.sqrt(nb))
            if gap < 1:
                one, two = through[a], through[b]
                if any(abs(one.get(c, 0) / na - two.get(c, 0) / nb) > gap for c in one.keys() | two.keys()):
                    return False
            # b goes down a tree, so no pair comes twice
            pending += [(children[a][c], children[b][c]) for c in children[a].keys() & children[b].keys() if children[a][c] != children[b][c]]
        return True

    def fold(a: int, b: int) -> None:
        """Add what tree node b has seen to state a."""
        pending = [(a, b)]
        while pending:
            a, b = pending.pop()
            through[a].update(through[b])
            total[a] += total[b]
            for c, child in children[b].items():
                if c in children[a]:
                    if children[a][c] != child:
                        pending.append((children[a][c], child))
                else:
                    children[a][c] = child

    settled, waiting = [0], [(0, c) for c in sorted(children[0])]
    seen = {0}
    while waiting:
        parent, c = waiting.pop(0)
        node = children[parent].get(c)
        if node is None or node in seen:
            continue
        into = next((s for s in settled if alike(s, node)), None)
        if into is None:
            settled.append(node)
            seen.add(node)
        else:
            children[parent][c] = into
            fold(into, node)
        for state in ((node,) if into is None else (into,)):
            waiting += [(state, x) for x in sorted(children[state]) if children[state][x] not in seen]
    index = {s: i for i, s in enumerate(settled)}
    moves = [{c: index[x] for c, x in children[state].items() if x in index} for state in settled]
    return Automaton(moves, [dict(through[state]) for state in settled])


class Formats:
    """The automata of the kinds and of ordinary words, and the lead per character that a secret needs."""

    def __init__(self, formats: dict[str, Automaton], ordinary: Automaton, per_char: float = 1.0):
        self.formats, self.ordinary, self.per_char = formats, ordinary, per_char

    def lead(self, word: str) -> tuple[str, float]:
        kind, best = max(((k, a.score(word)) for k, a in self.formats.items()), key=lambda x: x[1])
        return kind, best - self.ordinary.score(word)

    def likeliest(self, word: str) -> tuple[str, float] | None:
        """The best format of a candidate and its lead over ordinary text, if any leads enough."""
        if not self.formats:
            return None
        kind, lead = self.lead(word)
        return (kind, lead) if lead >= max(MARGIN, self.per_char * len(word)) else None


def _strings(docs: DataFrame) -> DataFrame:
    """kind, value, n of what the fixed rules find in all texts, and of all ordinary words.

    A text that repeats counts once: a secret does not become a usual word by copies.
    """

    def rows():
        def handle(texts, names):
            for text, name in zip(texts, names):
                found = _candidates(text)
                spans = base_spans(text, found)
                strings = Counter(("ordinary", word) for _, word in outside(found, spans))
                for start, kind, end in spans:
                    strings[kind, ASSIGN.match(text, start).group(2) if kind == "assign" else text[start:end]] += 1
                for (kind, value), n in strings.items():
                    yield name, kind, value, n

        return handle

    texts = docs.where(F.length("text") > 0).select("text", F.unhex(F.md5("text")).alias("name"))
    return (
        arrow_map(texts, "name binary, kind string, value string, n bigint", rows)
        .distinct()
        .groupBy("kind", "value")
        .agg(F.sum("n").alias("n"))
    )


def _trees(strings: DataFrame, most: int) -> dict[str, dict[str, dict[str, int]]]:
    """Per kind how often each character follows each prefix, of at most ``most`` continuations.

    Prefixes are counted over all strings; the driver gets those that occur most often,
    down to a number of times, by eighths of powers of two.
    """
    prefixes = (
        strings.withColumn("at", F.explode(F.expr(f"sequence(0, least(length(value), {TREE_DEPTH}))")))
        .groupBy("kind", F.expr("substring(value, 1, at)").alias("prefix"), F.expr("substring(value, at + 1, 1)").alias("c"))
        .agg(F.sum("n").alias("n"))
        .groupBy("kind", "prefix")
        .agg(F.collect_list(F.struct("c", "n")).alias("following"), F.sum("n").alias("n"))
        .checkpoint()
    )
    step = F.floor(8 * F.log2("n"))
    rows = prefixes.groupBy("kind", step.alias("step")).agg(F.min("n").alias("low"), F.sum(F.size("following")).alias("rows"))
    least, total = {}, Counter()
    for kind, _, low, n in sorted(rows.collect(), reverse=True):
        total[kind] += n
        if total[kind] <= most or kind not in least:
            least[kind] = low
    trees: dict[str, dict[str, dict[str, int]]] = {}
    for kind, low in least.items():
        wanted = prefixes.where((F.col("kind") == kind) & (F.col("n") >= low)).select("prefix", "following")
        trees[kind] = {prefix: dict(map(tuple, following)) for prefix, following in wanted.collect()}
    return trees


def _recounted(strings: DataFrame, automata: dict[str, Automaton]) -> dict[str, Automaton]:
    """The automata with the frequencies that all strings give."""
    shared = share(strings.sparkSession, automata)

    def rows():
        automata = shared()

        def handle(kinds, values, times):
            passed = Counter()
            for kind, value, n in zip(kinds, values, times):
                for state, c in automata[kind].steps(value):
                    passed[kind, state, c] += n
            for (kind, state, c), n in passed.items():
                yield kind, state, c, n

        return handle

    counted = (
        arrow_map(strings.select("kind", "value", "n"), "kind string, state int, c string, n bigint", rows)
        .groupBy("kind", "state", "c")
        .agg(F.sum("n").alias("n"))
    )
    counts = {kind: [{} for _ in a.moves] for kind, a in automata.items()}
    for kind, state, c, n in counted.collect():
        counts[kind][state][c] = n
    return {kind: Automaton(a.moves, counts[kind]) for kind, a in automata.items()}


def _least_lead(words: DataFrame, formats: Formats) -> float:
    """The lead per character that a secret needs, from all occurrences of ordinary words.

    A tenth beyond what nearly all of them reach, and at least e-fold per character;
    an unknown secret among them occurs less often than words do.
    """
    shared = share(words.sparkSession, formats)

    def rows():
        formats = shared()

        def handle(values, times):
            leads = Counter()
            for value, n in zip(values, times):
                leads[math.ceil(formats.lead(value)[1] / len(value) * LEAD_STEPS)] += n
            yield from leads.items()

        return handle

    leads = arrow_map(words.select("value", "n"), "lead bigint, n bigint", rows).groupBy("lead").agg(F.sum("n")).collect()
    usual, below = 0, ORDINARY_SHARE * (sum(n for _, n in leads) - 1)
    for usual, n in sorted(leads):
        below -= n
        if below < 0:
            break
    return max(1.0, 1.1 * usual / LEAD_STEPS)


def learn_formats(docs: DataFrame, rows: int = TREE_ROWS) -> Formats:
    """Fit the automata on the strings of all texts.

    The driver merges trees of at most ``rows`` continuations each; all frequencies
    and the least lead are counted over all strings, whatever their length.
    A string counts once in the automaton of its kind, however many texts have it.
    An ordinary word that occurs once may be an unknown secret and gives nothing
    to its automaton, unless all do.
    """
    strings = _strings(docs).checkpoint()
    once = F.count(F.when(F.col("n") == 1, 1))
    found = {kind: (n, n - single) for kind, n, single in strings.groupBy("kind").agg(F.count("*"), once).collect()}
    kinds = [k for k in KINDS if found.get(k, (0, 0))[0] >= LEAST_STRINGS]
    if not kinds:
        return Formats({}, infer(Counter({"": 1})))
    words = strings.where(F.col("kind") == "ordinary")
    fitted = strings.where(F.col("kind").isin(kinds)).withColumn("n", F.lit(1).cast("bigint"))
    fitted = fitted.unionByName(words.where("n > 1") if found.get("ordinary", (0, 0))[1] else words)
    automata = _recounted(fitted, {kind: merged(tree) for kind, tree in _trees(fitted, rows).items()})
    ordinary = automata.pop("ordinary", None) or infer(Counter({"": 1}))
    formats = {kind: automata[kind] for kind in kinds}
    return Formats(formats, ordinary, _least_lead(words, Formats(formats, ordinary)))


def scan(docs: DataFrame, formats: Formats | None = None, fit: bool = True) -> DataFrame:
    """Secrets of every whole text.

    One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256,
    spans, n_learned. Spans are kind:start:end in code points, the end exclusive,
    by start and kind; those of kind ``learned`` lie outside all base spans: of a
    run of candidate characters what base spans leave of it, or a part of that
    between ``=``, ``/`` and ``.``, whichever leads most a character over ordinary
    text. A null text counts as empty; an empty table gives no rows; repeated rows are scanned
    each; runs of any length are scored whole; other columns are not read. With
    fewer than LEAST_STRINGS labelled strings of a kind it has no format.
    """
    if formats is None and fit:
        formats = learn_formats(docs)
    shared = share(docs.sparkSession, formats)

    def rows():
        formats = shared()
        remembered: dict[str, float] = {}

        def lead(word: str) -> float:
            """Lead of a secret over ordinary text; 0 for ordinary text."""
            known = remembered.get(word)
            if known is None:
                likeliest = formats.likeliest(word)
                known = likeliest[1] if likeliest else 0.0
                if len(word) <= LONGEST_STRING:
                    if len(remembered) > 1 << 17:
                        remembered.clear()
                    remembered[word] = known
            return known

        def handle(ids, texts):
            for doc_id, text in zip(ids, texts):
                found = _candidates(text)
                spans = base_spans(text, found)
                base = joined(spans)
                counts = Counter(kind for _, kind, _ in spans)
                extra = []
                if formats is not None and formats.formats:
                    scored = [(lead(word) / len(word), start, start + len(word)) for start, word in outside(found, spans)]
                    extra = [(s, LEARNED, e) for s, e in best_apart([x for x in scored if x[0]])]
                yield (
                    doc_id,
                    counts["assign"],
                    counts["access"],
                    counts["hex"],
                    hashlib.sha256(base.encode()).hexdigest(),
                    joined(sorted(spans + extra, key=lambda x: (x[0], (*KINDS, LEARNED).index(x[1])))),
                    len(extra),
                )

        return handle

    return arrow_map(
        docs.select(F.col("doc_id").cast("bigint"), text_or_empty()),
        "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, "
        "spans string, n_learned bigint",
        rows,
    )
