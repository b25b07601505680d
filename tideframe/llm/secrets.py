"""Secret scans: patterns, and formats learned by grammar inference from labelled credentials.

The patterns find what is written as a credential (assign, access, hex). Their matches in all documents, the first by hash up
to a bound, are labelled credentials: for each kind a prefix tree of them is folded into a probabilistic automaton. States at the same
place of a credential merge while a Hoeffding bound can't tell their next symbols and endings apart, all the way down; states at different
places merge only where both were met TELLING times, so that the bound had a chance to tell them apart. What is fixed in a
format, its length, its prefix, where a separator stands, thus stays, and what is random becomes a chain of states, or a loop where lengths vary.

Every other run of credential characters in every text that is as long as the shortest label, digits or not, is then scored by the
likelihood of its format: the mean log-likelihood of its characters and its end under the best automaton, less that under the best of two
models of ordinary runs, words and numbers, also joined by punctuation. Runs above a threshold, set on ordinary runs and on
credentials that fitting didn't see, are added as spans of the kind `format`. What else the texts hold sets no threshold: a source full
of bare credentials doesn't make them ordinary.

Null and empty texts have no spans; an empty table gives no rows. Spans count code points, the end is exclusive; repeated rows are scanned each.
Texts are scanned whole; other columns are ignored, whatever their names. Without labelled credentials there are no automata and no
spans beyond the patterns'. Labels of more than LONGEST characters are found, counted and scored like others, but not learned from.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_by_bytes, plain

# Fixed patterns and least lengths of the base kinds, in the order in which ties by start are listed.
KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LEAST, ACCESS_LEAST = 8, 16
#: The alphabet of labelled values; what in it joins words and numbers; a word in small letters or capitalised, or a number.
RUN = re.compile(r"[A-Za-z0-9+/_.=-]+")
JOINTS = re.compile(r"[+/_.=-]+")
PLAIN = re.compile(r"[a-z]+|[A-Z][a-z]*|[0-9]+")
#: What a text must hold for any of these to match, for a quick look at a batch.
_HINT = r"(?i)(password|passwd|secret|token|api_?key)|AKIA|[0-9a-f]{32}"

#: Credentials and ordinary runs of each kind that a fit sees, at most; their longest length; tasks that choose them.
SAMPLE_RUNS, LONGEST, CELLS = 400, 128, 32
#: Symbols that a credential can have; how many sights of a state its kind's own frequencies of symbols stand for.
ALPHABET, PRIOR = 68, 2.0
#: Sights that two states at different places need, each, before they may merge.
TELLING = 30


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the patterns' matches, by start, then kind."""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def other_runs(text: str, spans: Sequence[tuple[str, int, int]], least: int) -> list[tuple[int, int]]:
    """What base spans (by start) leave of the runs of the labelled alphabet, without full stops around it, if it has `least` characters."""
    out, i = [], 0
    for m in RUN.finditer(text):
        a, end = m.span()
        if end - a < least:
            continue
        while a < end:
            while i < len(spans) and spans[i][2] <= a:
                i += 1
            b = min(end, max(a, spans[i][1])) if i < len(spans) else end
            x, y = a, b
            while x < y and text[x] == ".":
                x += 1
            while x < y and text[y - 1] == ".":
                y -= 1
            if y - x >= least:
                out.append((x, y))
            a = spans[i][2] if b < end else end
    return out


def ordinary(run: str) -> bool:
    """Whether a run is words and numbers, also joined by punctuation."""
    return all(not part or PLAIN.fullmatch(part) for part in JOINTS.split(run))


@dataclass
class Automaton:
    """A deterministic probabilistic automaton: for each state, symbol counts with their targets, and how often words end there."""

    moves: list[dict[str, list[int]]] = field(default_factory=lambda: [{}])  # symbol: [target, count]
    ends: list[int] = field(default_factory=lambda: [0])

    def seen(self, q: int) -> int:
        return self.ends[q] + sum(n for _, n in self.moves[q].values())

    def add(self, word: str) -> None:
        q = 0
        for c in word:
            step = self.moves[q].get(c)
            if step is None:
                self.moves.append({})
                self.ends.append(0)
                step = self.moves[q][c] = [len(self.moves) - 1, 0]
            step[1] += 1
            q = step[0]
        self.ends[q] += 1

    def score(self, word: str) -> float:
        """Mean natural log of the probabilities of the symbols and of the end. A state's frequencies are smoothed by those of the
        whole automaton; an unseen symbol goes where most go from that state, so that the place isn't lost."""
        states, symbols, total_symbols, end = self._ready
        q, total = 0, 0.0
        for c in word:
            seen, usual, moves = states[q]
            step = moves.get(c)
            share = (symbols.get(c, 0) + 0.05) / (total_symbols + 0.05 * ALPHABET)
            total += math.log(((step[1] if step else 0) + PRIOR * share) / (seen + PRIOR))
            q = step[0] if step else usual
        total += math.log((self.ends[q] + PRIOR * end) / (states[q][0] + PRIOR))
        return total / (len(word) + 1)

    @property
    def _ready(self):
        """For each state how often it was met, where most go from it, and its moves; counts of symbols, their sum, and the share of ends."""
        if "_known" not in self.__dict__:
            symbols: dict[str, int] = defaultdict(int)
            for moves in self.moves:
                for c, (_, n) in moves.items():
                    symbols[c] += n
            total, ends = sum(symbols.values()), sum(self.ends)
            states = [(self.seen(q), max(m.values(), key=lambda x: x[1])[0] if m else 0, m) for q, m in enumerate(self.moves)]
            self.__dict__["_known"] = (states, dict(symbols), total, (ends + 0.05) / (ends + total + 0.1))
        return self.__dict__["_known"]


def _differ(f1: int, n1: int, f2: int, n2: int, bound: float) -> bool:
    return bool(n1 and n2) and abs(f1 / n1 - f2 / n2) > bound * (n1**-0.5 + n2**-0.5)


def infer(words: Sequence[str], alpha: float = 0.05) -> Automaton:
    """The prefix tree of the words, its states merged from the root on while the bound at level alpha finds no difference.

    A state merges with one at its own place first; with one at another place only where both were met TELLING times.
    """
    a = Automaton()
    for w in words:
        a.add(w)
    bound = math.sqrt(0.5 * math.log(2 / alpha))

    def compatible(p: int, q: int) -> bool:
        todo, met = [(p, q)], set()
        while todo:
            x, y = todo.pop()
            if x == y or (x, y) in met:
                continue
            met.add((x, y))
            n1, n2 = a.seen(x), a.seen(y)
            if _differ(a.ends[x], n1, a.ends[y], n2, bound):
                return False
            for c in a.moves[x].keys() | a.moves[y].keys():
                s, t = a.moves[x].get(c), a.moves[y].get(c)
                if _differ(s[1] if s else 0, n1, t[1] if t else 0, n2, bound):
                    return False
                if s and t:
                    todo.append((s[0], t[0]))
        return True

    def fold(p: int, q: int) -> None:
        """Adds the tree below q to p."""
        todo = [(p, q)]
        while todo:
            x, y = todo.pop()
            a.ends[x] += a.ends[y]
            for c, (target, n) in list(a.moves[y].items()):
                own = a.moves[x].get(c)
                if own is None:
                    a.moves[x][c] = [target, n]
                else:
                    own[1] += n
                    todo.append((own[0], target))

    # Place after place: the states of one place are those that the kept ones of the place before lead to, still trees.
    place, at, kept = {0: 0}, 0, [0]
    layer = [0]
    while layer:
        at += 1
        new: list[int] = []
        for r in layer:
            for c in sorted(a.moves[r], key=lambda c: (-a.moves[r][c][1], c)):
                q = a.moves[r][c][0]
                if q in place:
                    continue
                merged = next((p for p in new if compatible(p, q)), None)
                if merged is None:
                    place[q] = at
                    new.append(q)
                else:
                    a.moves[r][c][0] = merged
                    fold(merged, q)
        kept += new
        layer = new
    # Places are merged from the shallowest on, where much was seen; a merge may make a loop, so counts are added up along it.
    gone: dict[int, int] = {}

    def now(q: int) -> int:
        while q in gone:
            q = gone[q]
        return q

    def joined_(p: int, q: int) -> None:
        """q becomes p, and what then has two targets by one symbol is merged too."""
        todo = [(p, q)]
        while todo:
            x, y = (now(z) for z in todo.pop())
            if x == y:
                continue
            gone[y] = x
            a.ends[x] += a.ends[y]
            for c, (target, n) in a.moves[y].items():
                own = a.moves[x].get(c)
                if own is None:
                    a.moves[x][c] = [target, n]
                else:
                    own[1] += n
                    todo.append((own[0], target))

    for i, q in enumerate(kept):
        if now(q) != q or a.seen(q) < TELLING:
            continue
        for p in kept[:i]:
            if now(p) == p and p != q and a.seen(p) >= TELLING and _alike(a, now, p, q, bound):
                joined_(p, q)
                break
    red = [q for q in kept if now(q) == q]
    number = {q: i for i, q in enumerate(red)}
    return Automaton([{c: [number[now(t)], n] for c, (t, n) in a.moves[q].items()} for q in red], [a.ends[q] for q in red])


def _alike(a: Automaton, now, p: int, q: int, bound: float) -> bool:
    """Whether two states, and what follows them by the same symbols, can't be told apart. States that were met too seldom to tell
    may follow only where they hold a tenth of what began."""
    todo, met, top = [(p, q)], set(), min(a.seen(p), a.seen(q))
    while todo:
        x, y = (now(z) for z in todo.pop())
        if x == y or (x, y) in met:
            continue
        met.add((x, y))
        n1, n2 = a.seen(x), a.seen(y)
        if top / 10 < min(n1, n2) < TELLING or _differ(a.ends[x], n1, a.ends[y], n2, bound):
            return False
        for c in a.moves[x].keys() | a.moves[y].keys():
            s, t = a.moves[x].get(c), a.moves[y].get(c)
            if _differ(s[1] if s else 0, n1, t[1] if t else 0, n2, bound):
                return False
            if s and t:
                todo.append((s[0], t[0]))
    return True


@dataclass(frozen=True)
class Formats:
    """Automata of the labelled kinds, models of ordinary runs, the score from which a run is a credential, and the shortest label's length."""

    kinds: dict[str, Automaton]
    ordinary: tuple[Automaton, ...]
    threshold: float
    least: int

    def score(self, run: str) -> float:
        return max(a.score(run) for a in self.kinds.values()) - max((a.score(run) for a in self.ordinary), default=-math.log(ALPHABET + 1))


def _usual(runs: Sequence[str]) -> Automaton:
    """One state: characters as they come in ordinary runs."""
    out = Automaton()
    for w in runs:
        for c in w:
            out.moves[0].setdefault(c, [0, 0])[1] += 1
        out.ends[0] += 1
    return out


def fit_formats(labelled: Sequence[tuple[str, str]]) -> Formats | None:
    """From (kind, value) pairs, where the kind "ordinary" marks runs that aren't credentials. None without credentials."""
    by = defaultdict(list)
    for kind, value in sorted(set(labelled)):
        by[kind].append(value)
    # Words in capitals are known from the others: runs of capitals in the texts may be credentials.
    others = by.pop("ordinary", [])
    others = sorted({*others, *(w.upper() for w in others)})
    if not by:
        return None
    # Numbers are ordinary at any length, whether the texts' sample holds some or not: each digit as often as the next.
    digits = sum(c.isdigit() for w in others for c in w)
    words = [w for w in others if 2 * sum(c.isdigit() for c in w) < len(w)]
    numbers = [w for w in others if 2 * sum(c.isdigit() for c in w) >= len(w)] + ["0123456789" * 2] * max(10, digits // 1000)
    ordinary = (*([_usual(words)] if words else []), _usual(numbers))
    least = min(len(w) for v in by.values() for w in v)
    # A fifth of the credentials isn't fitted to and sets, with the ordinary runs, the threshold.
    part = lambda v, held: [w for i, w in enumerate(sorted(v, key=_order)) if (i % 5 == 4) == held]
    judged = Formats({k: infer(part(v, False)) for k, v in sorted(by.items())}, ordinary, 0.0, least)
    scores = sorted(judged.score(w) for w in others)
    own = sorted(judged.score(w) for v in by.values() for w in (part(v, True) or v))
    # Above nearly all ordinary runs, and, where that is higher, near the weakest of the unseen credentials.
    top = scores[int(0.99 * (len(scores) - 1))] if scores else 0.0
    return Formats({k: infer(v) for k, v in sorted(by.items())}, ordinary, max(top, own[len(own) // 20] - 0.2, 0.1), least)


def _order(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode(), digest_size=8).digest()) >> 1


def _labels_of(batches):
    """The values of each kind with the lowest hashes, SAMPLE_RUNS at most, of all texts of a task."""
    first: dict[str, dict[str, int]] = defaultdict(dict)
    bar: dict[str, int] = {}
    for big in batches:
        for batch in batches_by_bytes(big, "text"):
            rows = set()
            for text in batch["text"].to_pylist():
                if not text:
                    continue
                spans = base_spans(text)
                for kind, a, b in spans:
                    value = ASSIGN.match(text, a)[2] if kind == "assign" else text[a:b]
                    rows.add((kind, value))
                rows.update(("ordinary", text[a:b]) for a, b in other_runs(text, spans, ASSIGN_LEAST) if ordinary(text[a:b]))
            for kind, value in rows:
                if len(value) > LONGEST:
                    continue
                order = _order(value)
                if order > bar.get(kind, order):
                    continue
                own = first[kind]
                own[value] = order
                if len(own) >= 2 * SAMPLE_RUNS:
                    first[kind] = own = dict(sorted(own.items(), key=lambda x: (x[1], x[0]))[:SAMPLE_RUNS])
                    bar[kind] = max(own.values())
    rows = [(kind, v, o) for kind, own in first.items() for v, o in sorted(own.items(), key=lambda x: (x[1], x[0]))[:SAMPLE_RUNS]]
    yield pa.record_batch(
        [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())],
        names=["kind", "value", "order"],
    )


def _lowest(batches):
    """Of each kind the SAMPLE_RUNS distinct values of a task with the lowest hashes."""
    first: dict[str, dict[str, int]] = defaultdict(dict)
    for batch in batches:
        for kind, value, order in zip(*(batch[c].to_pylist() for c in ("kind", "value", "order"))):
            first[kind][value] = order
            if len(first[kind]) > 4 * SAMPLE_RUNS:
                first[kind] = dict(sorted(first[kind].items(), key=lambda x: (x[1], x[0]))[:SAMPLE_RUNS])
    rows = [(kind, v, o) for kind, own in first.items() for v, o in sorted(own.items(), key=lambda x: (x[1], x[0]))[:SAMPLE_RUNS]]
    yield pa.record_batch([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], names=["kind", "value", "order"])


def labelled_credentials(docs: DataFrame) -> list[tuple[str, str]]:
    """Matches and ordinary runs of all documents: of each kind the SAMPLE_RUNS distinct values with the lowest hashes.

    Tasks, then CELLS tasks by the value's hash, keep SAMPLE_RUNS values of a kind each, so the driver gets CELLS times as many at most.
    """
    schema = "kind string, value string, order bigint"
    found = plain(docs, "text").mapInArrow(_labels_of, schema).repartition(CELLS, F.pmod(F.xxhash64("order"), F.lit(CELLS))).mapInArrow(_lowest, schema)
    by = defaultdict(list)
    for r in sorted(found.select("kind", "order", "value").collect()):
        by[r.kind].append(r.value)
    return [(kind, v) for kind, values in by.items() for v in values[:SAMPLE_RUNS]]


def joined(spans: Sequence[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame, formats: Formats | None) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_format."""
    sent = docs.sparkSession.sparkContext.broadcast(formats)  # automata of at most SAMPLE_RUNS words of LONGEST characters for a kind

    def run(batches):
        known: dict[str, bool] = {}
        own = sent.value
        for big in batches:
            for batch in batches_by_bytes(big, "text"):
                text = pc.fill_null(batch["text"], "")
                hint = pc.match_substring_regex(text, _HINT).to_pylist()
                rows = []
                for look, t in zip(hint, text.to_pylist()):
                    base = base_spans(t) if look else []
                    more = []
                    if own is not None:
                        for a, b in other_runs(t, base, own.least):
                            run_ = t[a:b]
                            if run_ not in known:
                                if len(known) > 200_000:
                                    known.clear()
                                known[run_] = own.score(run_) >= own.threshold
                            if known[run_]:
                                more.append(("format", a, b))
                    rows.append((base, more))
                n = lambda kind: pa.array([sum(s[0] == kind for s in base) for base, _ in rows], pa.int64())
                yield pa.record_batch(
                    [
                        batch["doc_id"],
                        n("assign"),
                        n("access"),
                        n("hex"),
                        pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in rows]),
                        pa.array([joined(sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0])))) for base, more in rows]),
                        pa.array([len(more) for _, more in rows], pa.int64()),
                    ],
                    names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_format"],
                )

    kind = dict(docs.dtypes)["doc_id"]
    return plain(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_format bigint")


def find_secrets(docs: DataFrame) -> DataFrame:
    return scan(docs, fit_formats(labelled_credentials(docs)))
