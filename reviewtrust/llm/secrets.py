"""Secret scans: credential formats inferred as probabilistic automata.

Three patterns find labelled credentials (``base_spans``). The characters of at most ``MAX_EXAMPLES`` of each kind, those
with the smallest hashes in the whole corpus, form a prefix tree; states whose outgoing and final frequencies agree
within Hoeffding bounds are merged into a probabilistic automaton for the kind.

All distinct other tokens of ``CANDIDATE`` give a background model of neighbouring characters, but for those that an
automaton gives as high a likelihood for each character as it gives held-out labelled credentials: credentials without a label
would otherwise make themselves usual. Every token in every text is scored: the best automaton's log
likelihood less the background's, for each character. A token that scores over ``LEAST_MARGIN`` and overlaps no base span is a
further span, of kind ``like_<kind>``. The margin is fixed, whatever the table's size.

Three passes over the texts. Examples, of which each task passes on at most MAX_EXAMPLES a kind, and distinct tokens are
shuffled; the driver gets the examples and one count for each pair of characters. Null and empty texts have no spans; a corpus
without credentials adds none.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewtrust.llm.common import text_of

ASSIGN = re.compile(
    r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII
)
#: Maximal runs: what the pattern without a least length finds and then drops for being short is the same.
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]{14,}"), re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
MAX_EXAMPLES = 2000
#: Confidence of the bound up to which two frequencies count as equal.
ALPHA = 0.05
#: States seen less often carry no evidence against a merge.
LEAST_SEEN = 8
UNSEEN = math.log(1e-4)
LEAST_MARGIN = 0.5
#: The part of held-out credentials that may fit their automaton worse than a token that is kept out of the background.
HELD_OUT_LOW = 0.05
#: Distinct tokens that a task holds before it passes them on.
HELD_TOKENS = 200_000


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, credential), leftmost and not overlapping within a kind, by start and kind."""
    found = [(m.start(), m.end(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), m.end(), "access", m[0]) for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex", m[0]) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def _free_candidates(text: str, spans: list[tuple[int, int, str, str]]) -> Iterator[re.Match]:
    """Candidates that overlap no span."""
    at, reach = 0, 0
    for m in CANDIDATE.finditer(text):
        while at < len(spans) and spans[at][0] < m.end():
            reach = max(reach, spans[at][1])
            at += 1
        if reach <= m.start():
            yield m


# ---------------------------------------------------------------- automata


@dataclass
class _State:
    seen: int = 0
    final: int = 0
    arcs: dict[str, int] = field(default_factory=dict)
    passed: Counter = field(default_factory=Counter)


class Automaton:
    """Prefix tree of strings whose compatible states have been merged."""

    def __init__(self, strings: list[str]):
        self.states = [_State()]
        for s in strings:
            self._add(s)
        self._merge_all()
        self.arcs = {
            k: {c: (math.log(n / st.seen), st.arcs[c]) for c, n in st.passed.items()}
            for k, st in enumerate(self.states)
            if st is not None
        }
        self.final = {k: math.log(st.final / st.seen) if st.final else UNSEEN for k, st in enumerate(self.states) if st is not None}

    def _add(self, string: str) -> None:
        at = 0
        for c in string:
            state = self.states[at]
            state.seen += 1
            state.passed[c] += 1
            if c not in state.arcs:
                state.arcs[c] = len(self.states)
                self.states.append(_State())
            at = state.arcs[c]
        self.states[at].seen += 1
        self.states[at].final += 1

    def _agree(self, a: int, b: int) -> bool:
        """Whether two states, and what follows them, have frequencies that the bound cannot tell apart."""
        pairs = [(a, b)]
        while pairs:
            x, y = (self.states[k] for k in pairs.pop())
            if min(x.seen, y.seen) < LEAST_SEEN:
                continue
            slack = math.sqrt(0.5 * math.log(2 / ALPHA)) * (x.seen**-0.5 + y.seen**-0.5)
            if abs(x.final / x.seen - y.final / y.seen) > slack:
                return False
            for c in x.passed.keys() | y.passed.keys():
                if abs(x.passed[c] / x.seen - y.passed[c] / y.seen) > slack:
                    return False
                if c in x.arcs and c in y.arcs and x.arcs[c] != y.arcs[c]:
                    pairs.append((x.arcs[c], y.arcs[c]))
        return True

    def _fold(self, into: int, other: int) -> None:
        """Add the tree below ``other`` to the state ``into``."""
        pairs = [(into, other)]
        while pairs:
            a, b = pairs.pop()
            x, y = self.states[a], self.states[b]
            x.seen += y.seen
            x.final += y.final
            x.passed.update(y.passed)
            for c, target in y.arcs.items():
                if c in x.arcs:
                    pairs.append((x.arcs[c], target))
                else:
                    x.arcs[c] = target
            self.states[b] = None

    def _merge_all(self) -> None:
        """Red states are settled; each state that follows one merges with the first red one it agrees with, or turns red."""
        red = [0]
        at = 0
        while at < len(red):
            source = red[at]
            for c in sorted(self.states[source].arcs):
                target = self.states[source].arcs[c]
                if target in red:
                    continue
                same = next((r for r in red if self._agree(r, target)), None)
                if same is None:
                    red.append(target)
                else:
                    self.states[source].arcs[c] = same
                    self._fold(same, target)
            # Folding may have given earlier red states new arcs: look at them again.
            fresh = next((i for i, r in enumerate(red[: at + 1]) if any(t not in red for t in self.states[r].arcs.values())), None)
            at = at + 1 if fresh is None else fresh

    def log_likelihood(self, string: str) -> float:
        at, total = 0, 0.0
        for c in string:
            step = self.arcs[at].get(c)
            if step is None:
                total, at = total + UNSEEN, 0
            else:
                total, at = total + step[0], step[1]
        return total + self.final[at]


@dataclass
class Formats:
    """Automata of the kinds, the likelihood for each character from which a token fits one, the background of
    neighbouring characters, and the score to beat."""

    automata: dict[str, Automaton]
    levels: dict[str, float]
    background: dict[str, float] = field(default_factory=dict)
    threshold: float = LEAST_MARGIN

    def fits(self, token: str) -> bool:
        return any(a.log_likelihood(token) >= self.levels[k] * len(token) for k, a in self.automata.items())

    def score(self, token: str) -> tuple[float, str]:
        """Best log likelihood ratio for each character, and its kind."""
        usual = sum(map(self.background.get, map("".join, zip(token, token[1:], strict=False)), [UNSEEN] * len(token)))
        best = max((a.log_likelihood(token), k) for k, a in self.automata.items())
        return (best[0] - usual) / len(token), best[1]

    def pairs(self, tokens: Iterable[str]) -> Counter:
        """Numbers of neighbouring characters in the tokens that fit no automaton."""
        return Counter(a + b for s in tokens if not self.fits(s) for a, b in zip(s, s[1:], strict=False))

    def learn(self, pairs: dict[str, int]) -> None:
        firsts: Counter = Counter()
        for p, n in pairs.items():
            firsts[p[0]] += n
        self.background = {p: math.log(n / firsts[p[0]]) for p, n in pairs.items()}


def _level(credentials: list[str]) -> float:
    """What held-out credentials reach with an automaton of the others, but for the lowest HELD_OUT_LOW of them. Not less
    than half of UNSEEN, which is also the level of kinds with too few credentials to hold some out."""
    if len(credentials) < 2 * LEAST_SEEN:
        return UNSEEN / 2
    dealt = sorted(credentials, key=_order)
    known = Automaton(sorted(dealt[::2]))
    reached = sorted(known.log_likelihood(s) / len(s) for s in dealt[1::2])
    return max(UNSEEN / 2, reached[int(len(reached) * HELD_OUT_LOW)])


def formats_of(labelled: dict[str, list[str]]) -> Formats:
    """Automata of credentials by kind; the background is still to be learnt."""
    given = {k: labelled[k] for k in KINDS if labelled.get(k)}
    return Formats({k: Automaton(sorted(v)) for k, v in given.items()}, {k: _level(v) for k, v in given.items()})


def infer(examples: dict[str, list[str]]) -> Formats:
    """``examples``: credentials by kind, and the distinct tokens without a label under ``other``."""
    formats = formats_of(examples)
    formats.learn(formats.pairs(examples.get("other", [])))
    return formats


# ---------------------------------------------------------------- Spark


def _order(token: str) -> int:
    return xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass"), 5) >> 1


def examples(docs: DataFrame, most: int = MAX_EXAMPLES) -> dict[str, list[str]]:
    """Distinct credentials of each kind with the smallest hashes, at most ``most`` a kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[str, int]] = {k: {} for k in KINDS}
        bound = dict.fromkeys(held, 2**63)

        def add(kind: str, token: str) -> None:
            if (order := _order(token)) < bound[kind]:
                held[kind][token] = order
                if len(held[kind]) > 2 * most:
                    held[kind] = dict(sorted(held[kind].items(), key=lambda x: x[1])[:most])
                    bound[kind] = max(held[kind].values())

        for batch in batches:
            for text in batch.column(0).to_pylist():
                for _, _, kind, token in base_spans(text):
                    add(kind, token)
        rows = [(k, t, o) for k, tokens in held.items() for t, o in sorted(tokens.items(), key=lambda x: x[1])[:most]]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())],
            ["kind", "token", "place"],
        )

    rows = docs.select(text_of(docs).alias("text")).mapInArrow(run, "kind string, token string, place bigint").distinct()
    nth = F.row_number().over(Window.partitionBy("kind").orderBy("place", "token"))
    found: dict[str, list[str]] = {}
    for r in rows.withColumn("nth", nth).where(F.col("nth") <= most).select("kind", "token").collect():
        found.setdefault(r["kind"], []).append(r["token"])
    return {k: sorted(v) for k, v in found.items()}


def background_pairs(docs: DataFrame, formats: Formats) -> dict[str, int]:
    """Numbers of neighbouring characters over all distinct candidates that overlap no base span and fit no automaton."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: set[str] = set()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update(m[0] for m in _free_candidates(text, base_spans(text)))
                if len(held) > HELD_TOKENS:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["token"])
                    held = set()
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["token"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: Counter = Counter()
        for batch in batches:
            pairs.update(formats.pairs(batch.column(0).to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array(list(pairs), pa.string()), pa.array(list(pairs.values()), pa.int64())], ["pair", "n"])

    distinct = docs.select(text_of(docs).alias("text")).mapInArrow(tokens, "token string").distinct()
    counts = distinct.mapInArrow(count, "pair string, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    return {r["pair"]: r["n"] for r in counts.collect()}


SPANS = "array<struct<start:int,end:int,kind:string>>"


def scan(docs: DataFrame, formats: Formats) -> DataFrame:
    """doc_id, ``base`` (base spans) and ``added`` (further ones) of every row, in code points."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, str | None] = {}

        def like(token: str) -> str | None:
            if token not in memo:
                if len(memo) > 200_000:
                    memo.clear()
                score, best = formats.score(token)
                memo[token] = f"like_{best}" if score > formats.threshold else None
            return memo[token]

        for batch in batches:
            base, added = [], []
            for text in batch.column(1).to_pylist():
                spans = base_spans(text)
                base.append([{"start": a, "end": b, "kind": k} for a, b, k, _ in spans])
                tokens = _free_candidates(text, spans) if formats.automata else ()
                added.append([{"start": m.start(), "end": m.end(), "kind": k} for m in tokens if (k := like(m[0]))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, kind), pa.array(added, kind)], ["doc_id", "base", "added"])

    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), text_of(docs).alias("text"))
    return rows.mapInArrow(run, f"doc_id bigint, base {SPANS}, added {SPANS}")


def secret_spans(docs: DataFrame, most: int = MAX_EXAMPLES) -> DataFrame:
    formats = formats_of(examples(docs, most))
    if formats.automata:
        formats.learn(background_pairs(docs, formats))
    return scan(docs, formats)
