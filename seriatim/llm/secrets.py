"""Secret scans: fixed rules, and formats learned by grammar inference.

The rules' matches in all documents are labelled credentials.  For each kind a prefix tree of their values is built,
whose branches are a digit, a capital, a small letter or one of the marks, and whose states count their characters and
ends.
States that are statistically compatible (Hoeffding bound, on the characters, the ends and all that follows) are
merged, which gives a probabilistic automaton.  A value's likelihood is that of its characters and of ending where it
ends.  Every other run of credential characters, from the rules' least length on, is scored by how much likelier its
best automaton makes it than a background model of the documents' other runs; those over the cut are spans of kind
``learned``.  What the rules find is scored too (an assigned value without its name), so every span has its score, in
nats a character.  The cut comes from credentials kept back and from the odds that a background run scores as much, never
from the runs to be judged: these may be credentials themselves, so in the background each counts by the probability
that it is none (a mixture, fitted in a few rounds).

Where different credentials and other runs are few, the driver learns from them all.  Where they are more, a kind's
SAMPLE_RUNS credentials give its automaton's states and moves only: likelihoods, the background and the cut then come
from counts of all credentials and all other runs, whole ones, by tasks.

Runs are looked for in the whole text: bytes outside them become blanks, and a task scores each different run once,
many in one step of numpy.

Defined cases: a null text counts as empty; a text without secrets has an empty list of spans; texts and runs are as
long as they are; a run within a rule's span adds none, one that reaches beyond it may; without labelled credentials
only the rules apply; equal texts get equal spans; repeated rows and, in ``redact``, all columns stay, whatever their
names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriatim.llm.common import slices, small, staged, texts

#: The rules' patterns, and the least length of what each has to find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "learned")
_KEYWORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % LEAST["assign"])
_HEX_CLASS = bytes(104 if chr(b) in "0123456789abcdef" else 46 for b in range(256))
_LETTERS = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_.=-"
_RUN_BYTES = bytes(b if b in _LETTERS else 32 for b in range(256))
_NUMBER = np.array([max(0, _LETTERS.find(bytes([b]))) for b in range(256)])
K = len(_LETTERS)
#: A character's class: digits, capitals, small letters, each mark, and the start and end of a run.
_CLASS = np.concatenate([np.repeat([0, 1, 2], [10, 26, 26]), np.arange(3, 3 + K - 62 + 1)])
#: A character's branch in a tree.
_BRANCH = _CLASS[:K]
#: Credentials a kind (those with the smallest checksums), and characters of each, that the driver builds a tree of at
#: most, and other runs that it fits the background to at most.
SAMPLE_RUNS = 400
SAMPLE_OTHERS = 8_000
RUN_LETTERS = 128
#: Different runs that a task holds before it sends them on.
RUNS_AT_ONCE = 100_000
ALPHA = 0.05
#: Weight of the format's characters as a whole in those of a state, and of chance in both.
PRIOR, SMOOTH = 20.0, 0.02
#: Rounds of the mixture, the change of a probability that calls for another one, and the odds that a run of the
#: background is taken for one of the formats at most.
ROUNDS = 10
MOVED = 1e-3
FALSE_ALARM = 1e-6
#: Parts of a run's weight that are counted over tasks, so that a sum doesn't depend on the order.
PARTS = 1 << 20
#: Runs longer than this go through an automaton one by one.
STEPS = 512
KNOWN_RUNS = 300_000
REDACTED = "[secret]"
Span = tuple[str, int, int]


def rule_spans(text: str, raw: bytes | None = None) -> list[Span]:
    raw = text.encode() if raw is None else raw
    out: list[Span] = []
    low = raw.lower()
    if any(k in low for k in _KEYWORDS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if b"AKIA" in raw:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    if b"h" * LEAST["hex"] in raw.translate(_HEX_CLASS):
        out += [("hex", m.start(), m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST["hex"]]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def runs_of(raw: bytes) -> set[bytes]:
    """The different runs of credential characters that are long enough."""
    return {r for r in raw.translate(_RUN_BYTES).split() if len(r) >= LEAST["assign"]}


def coded(runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Character numbers of all runs in a row, and where each starts (with the end)."""
    ends = np.zeros(len(runs) + 1, np.int64)
    np.cumsum([len(r) for r in runs], out=ends[1:])
    return _NUMBER[np.frombuffer(b"".join(runs), np.uint8)], ends


@dataclass
class Automaton:
    """Probabilistic automaton: each state's log likelihoods of characters and of the end, and its moves by branch."""

    chars: np.ndarray  # states x K
    end: np.ndarray
    moves: np.ndarray  # states x branches; a branch without a move stays

    @classmethod
    def counted(cls, chars: np.ndarray, last: np.ndarray, moves: np.ndarray) -> Automaton:
        """From how often each state is left by each character, and how often a run ends there."""
        whole = chars.sum(axis=0) + SMOOTH
        whole /= whole.sum()
        total = np.maximum(1.0, chars.sum(axis=1) + last)
        return cls(np.log((chars + PRIOR * whole) / (total + PRIOR + SMOOTH)[:, None]), np.log((last + SMOOTH) / (total + PRIOR + SMOOTH)), moves)

    def _steps(self, codes: np.ndarray, ends: np.ndarray, state: np.ndarray) -> Iterator[tuple[np.ndarray | int, np.ndarray, np.ndarray]]:
        """Runs, the states they are in and their next characters, until ``state`` has each run's last one; a long run's steps come together."""
        size = np.diff(ends)
        short = np.flatnonzero(size <= STEPS)
        order = short[np.argsort(-size[short], kind="stable")]
        upto = np.searchsorted(-size[order], -np.arange(1, size[short].max(initial=0) + 1), side="right")
        for t, n in enumerate(upto.tolist()):
            at = order[:n]
            c, s = codes[ends[at] + t], state[at]
            yield at, s, c
            state[at] = self.moves[s, _BRANCH[c]]
        moves = self.moves.tolist()
        for i in np.flatnonzero(size > STEPS).tolist():
            path, last, own = [], 0, codes[ends[i] : ends[i + 1]]
            for branch in _BRANCH[own].tolist():
                path.append(last)
                last = moves[last][branch]
            yield i, np.array(path), own
            state[i] = last

    def likelihoods(self, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out, state = np.zeros(len(ends) - 1), np.zeros(len(ends) - 1, np.int64)
        for at, s, c in self._steps(codes, ends, state):
            found = self.chars[s, c]
            out[at] += found if isinstance(at, np.ndarray) else found.sum()
        return out + self.end[state]

    def visits(self, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How often each state is left by each character, and as the last column how often a run ends there."""
        out, state = np.zeros(len(self.end) * (K + 1), np.int64), np.zeros(len(ends) - 1, np.int64)
        for _, s, c in self._steps(codes, ends, state):
            out += np.bincount(s * (K + 1) + c, minlength=len(out))
        return (out + np.bincount(state * (K + 1) + K, minlength=len(out))).reshape(-1, K + 1)


class _Merger:
    """A prefix tree whose states are merged; a merged state stands for those that went into it."""

    def __init__(self, runs: list[bytes]) -> None:
        self.moves: list[dict[int, int]] = [{}]
        self.chars, self.ends, self.into = [np.zeros(K)], [0], [0]
        for run in runs:
            s = 0
            for c in _NUMBER[np.frombuffer(run[:RUN_LETTERS], np.uint8)].tolist():
                self.chars[s][c] += 1
                s = self.moves[s].setdefault(int(_BRANCH[c]), len(self.moves))
                if s == len(self.moves):
                    self.moves.append({})
                    self.chars.append(np.zeros(K))
                    self.ends.append(0)
                    self.into.append(s)
            self.ends[s] += len(run) <= RUN_LETTERS
        self.margin = math.sqrt(0.5 * math.log(2 / ALPHA))

    def now(self, s: int) -> int:
        while self.into[s] != s:
            self.into[s] = s = self.into[self.into[s]]
        return s

    def after(self, s: int) -> list[int]:
        """The states that follow, each once."""
        return list(dict.fromkeys(self.now(self.moves[s][b]) for b in sorted(self.moves[s])))

    def arrived(self, s: int) -> float:
        return max(1.0, float(self.chars[s].sum()) + self.ends[s])

    def compatible(self, a: int, b: int) -> bool:
        todo, seen = [(a, b)], {(a, b)}
        while todo:
            x, y = todo.pop()
            n, m = self.arrived(x), self.arrived(y)
            bound = self.margin * (n**-0.5 + m**-0.5)
            if abs(self.ends[x] / n - self.ends[y] / m) > bound or np.abs(self.chars[x] / n - self.chars[y] / m).max() > bound:
                return False
            for c in self.moves[x].keys() & self.moves[y].keys():
                pair = self.now(self.moves[x][c]), self.now(self.moves[y][c])
                if pair[0] != pair[1] and pair not in seen:
                    seen.add(pair)
                    todo.append(pair)
        return True

    def fold(self, a: int, b: int) -> None:
        """``b`` and what follows it go into ``a`` and what follows that."""
        todo = [(a, b)]
        while todo:
            x, y = map(self.now, todo.pop())
            if x == y:
                continue
            self.into[y] = x
            self.ends[x] += self.ends[y]
            self.chars[x] = self.chars[x] + self.chars[y]
            for c, to in self.moves[y].items():
                if c in self.moves[x]:
                    todo.append((self.moves[x][c], to))
                else:
                    self.moves[x][c] = to

    def by_depth(self) -> None:
        """Merges compatible states of one depth, so that classes that mix freely don't scatter the counts."""
        level = [0]
        while level:
            kept: list[int] = []
            for s in sorted({self.now(t) for s in level for t in self.after(s)}, key=lambda t: (-self.arrived(t), t)):
                t = self.now(s)
                if t in kept:
                    continue
                to = next((k for k in kept if self.compatible(k, t)), None)
                if to is None:
                    kept.append(t)
                else:
                    self.fold(to, t)
            level = list(dict.fromkeys(map(self.now, kept)))

    def across(self) -> list[int]:
        """Merges compatible states of any depth, breadth first; the states that stay."""
        kept, queue = [0], deque(self.after(0))
        while queue:
            t = self.now(queue.popleft())
            if t in kept:
                continue
            to = next((k for k in kept if self.compatible(k, t)), None)
            if to is None:
                kept.append(t)
            else:
                self.fold(to, t)
                kept = list(dict.fromkeys(map(self.now, kept)))
            queue = deque(x for k in kept for x in self.after(k) if x not in kept)
        return kept


def learn(runs: list[bytes]) -> Automaton:
    """Merges compatible states of the prefix tree of ``runs``, first those of one depth."""
    tree = _Merger(runs)
    tree.by_depth()
    kept = tree.across()
    number = {s: i for i, s in enumerate(kept)}
    moves = np.array([[number[tree.now(tree.moves[s].get(b, s))] for b in range(int(_BRANCH.max()) + 1)] for s in kept])
    return Automaton.counted(np.array([tree.chars[s] for s in kept]), np.array([tree.ends[s] for s in kept]), moves)


@dataclass
class Background:
    """Two models of a run in equal shares: by pairs of characters, which fits words, and by pairs of their classes with each class's characters, which fits numbers and the like that are too rare for the first.

    The start and the end of a run are character K and the last class.
    """

    pairs: np.ndarray  # log likelihoods, K + 1 x K + 1
    classes: np.ndarray
    chars: np.ndarray  # of each character within its class

    @staticmethod
    def marked(codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Characters before and after each step of all runs, the first and the last step's from and to K, and where each run's steps start."""
        run = np.insert(codes, ends, K)
        return run[:-1], run[1:], ends[:-1] + np.arange(len(ends) - 1)

    @classmethod
    def of(cls, codes: np.ndarray, ends: np.ndarray, weights: np.ndarray) -> Background:
        return cls.counted(cls.steps(codes, ends, weights))

    @classmethod
    def steps(cls, codes: np.ndarray, ends: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The weights of all steps by the characters before and after."""
        before, after, starts = cls.marked(codes, ends)
        w = np.repeat(weights, np.diff(np.append(starts, len(before))))
        return np.bincount(before * (K + 1) + after, weights=w, minlength=(K + 1) ** 2).reshape(K + 1, K + 1)

    @classmethod
    def counted(cls, pairs: np.ndarray) -> Background:
        """From what ``steps`` gives."""
        conditional = lambda counts: np.log((counts + 1) / (counts.sum(axis=1, keepdims=True) + len(counts)))
        member = (_CLASS[:, None] == np.arange(int(_CLASS[-1]) + 1)).astype(np.float64)
        seen = pairs.sum(axis=0) + 1
        return cls(conditional(pairs), conditional(member.T @ pairs @ member), np.log(seen / (seen @ member)[_CLASS]))

    def likelihoods(self, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        before, after, starts = self.marked(codes, ends)
        if not len(starts):
            return np.zeros(0)
        by_pair = np.add.reduceat(self.pairs[before, after], starts)
        by_class = np.add.reduceat(self.classes[_CLASS[before], _CLASS[after]] + self.chars[after], starts)
        return np.logaddexp(by_pair, by_class) - math.log(2)


@dataclass
class Model:
    automata: dict[str, Automaton]
    background: Background
    cut: float

    def formats(self, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The log likelihood of the best automaton."""
        return np.max([a.likelihoods(codes, ends) for a in self.automata.values()], axis=0, initial=-1e300)

    def scores(self, runs: list[bytes]) -> np.ndarray:
        """By how much, in nats a character, the best automaton makes each run likelier than the background."""
        codes, ends = coded(runs)
        return (self.formats(codes, ends) - self.background.likelihoods(codes, ends)) / np.maximum(1, np.diff(ends))

    def all_found(self, runs: list[bytes], score: np.ndarray | None = None) -> np.ndarray:
        """Over the cut, and with so much evidence in all that a background run has it with odds of FALSE_ALARM at most (a likelihood ratio of x has odds of 1 / x under the background)."""
        score = self.scores(runs) if score is None else score
        return (score > self.cut) & (score * np.array([len(r) for r in runs]) > math.log(max(len(self.automata), 1) / FALSE_ALARM))

    def score(self, run: str) -> float:
        return float(self.scores([run.encode()])[0])

    def found(self, run: str) -> bool:
        return bool(self.all_found([run.encode()])[0])


def train(credentials: dict[str, list[str]], others: list[str]) -> Model:
    """Every fifth credential is kept back to place the cut: half-way from the background's expected score, which is below 0, to the credentials kept back.

    Kinds whose credentials kept back are no likelier than all other runs (they may be plain words) have no format and are left out.
    """
    automata, held = {}, {}
    for kind, runs in sorted(credentials.items()):
        own = [r.encode() for r in sorted(set(runs))[:SAMPLE_RUNS]]
        if len(own) >= 5:
            automata[kind] = learn([r for i, r in enumerate(own) if i % 5])
            held[kind] = own[::5]
    codes, ends = coded([r.encode() for r in others])
    model = Model({}, Background.of(codes, ends, np.ones(len(others))), math.inf)
    for kind, automaton in automata.items():
        if _tenth(Model({kind: automaton}, model.background, 0.0), held[kind]) > 0:
            model.automata[kind] = automaton
    if model.automata:
        _separate(model, codes, ends)
        model.cut = max(0.0, _tenth(model, [r for kind in model.automata for r in held[kind]]) / 2)
    return model


def _tenth(model: Model, runs: list[bytes]) -> float:
    """The score that nine of ten runs reach."""
    return float(np.sort(model.scores(runs))[len(runs) // 10])


def _separate(model: Model, codes: np.ndarray, ends: np.ndarray) -> None:
    """Fits the background to the other runs by the probability of each that it is of no learned format."""
    formats = model.formats(codes, ends)
    weights, share = np.ones(len(formats)), 0.5
    for _ in range(ROUNDS):
        model.background = Background.of(codes, ends, weights)
        before, weights = weights, _no_format(formats, model.background.likelihoods(codes, ends), share)
        if np.abs(before - weights).max(initial=0) < MOVED:
            break
        share = _bounded(1 - float(weights.mean()))
    model.background = Background.of(codes, ends, weights)


def _no_format(formats: np.ndarray, background: np.ndarray, share: float) -> np.ndarray:
    """The probability of each run that it is of no learned format, where ``share`` of all are."""
    return 1 / (1 + np.exp(np.clip(formats - background + math.log(share / (1 - share)), -700, 700)))


def _bounded(share: float) -> float:
    return min(0.99, max(0.01, share))


def value_of(text: str, span: Span) -> bytes:
    """What a rule's span holds: of an assignment what is assigned."""
    kind, a, b = span
    return (ASSIGN.fullmatch(text[a:b])[2] if kind == "assign" else text[a:b]).encode()


@dataclass
class Finder:
    """A task's memory of the runs that it has scored."""

    model: Model | None
    known: dict[bytes, float] = field(default_factory=dict)
    hits: set[bytes] = field(default_factory=set)

    def spans(self, all_texts: Iterable[str]) -> list[list[Span]]:
        """Every text's spans, of the rules and learned."""
        raws = [t.encode() for t in all_texts]
        out = [rule_spans(t, raw) for t, raw in zip(all_texts, raws, strict=True)]
        if not self.model or not self.model.automata:
            return out
        runs = [runs_of(raw) for raw in raws]
        self._learn(set().union(*runs))
        for text, own, spans in zip(all_texts, runs, out, strict=True):
            if not self.hits.isdisjoint(own):
                new = [(m.start(), m.end()) for m in RUN.finditer(text) if m[0].encode() in self.hits]
                spans += [("learned", a, b) for a, b in new if not any(x <= a and b <= y for _, x, y in spans)]
                spans.sort(key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
        return out

    def _learn(self, runs: set[bytes]) -> None:
        if len(self.known) > KNOWN_RUNS:
            self.known, self.hits = {}, set()
        if fresh := sorted(r for r in runs if r not in self.known):
            score = self.model.scores(fresh)
            self.known.update(zip(fresh, score.tolist(), strict=True))
            self.hits.update(fresh[i] for i in np.flatnonzero(self.model.all_found(fresh, score)).tolist())

    def scores(self, all_texts: Iterable[str], found: list[list[Span]]) -> list[list[float | None]]:
        """The format score of what every span holds; null without formats."""
        values = [[value_of(t, s) for s in spans] for t, spans in zip(all_texts, found, strict=True)]
        if not self.model or not self.model.automata:
            return [[None] * len(v) for v in values]
        self._learn({v for own in values for v in own})
        return [[self.known[v] for v in own] for own in values]


def all_spans(text: str, model: Model | None) -> list[Span]:
    return Finder(model).spans([text])[0]


def _different(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind, run of the credentials that the rules find in a task's texts, and of the other runs, as kind ``other``."""
    found: dict[str, set[bytes]] = {kind: set() for kind in (*LEAST, "other")}

    def out() -> Iterator[pa.RecordBatch]:
        for kind, own in found.items():
            runs = pa.array(list(own), pa.binary())
            own.clear()
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(runs), pa.string()), runs], names=["kind", "run"])

    for batch in small(batches):
        for text in texts(batch):
            raw = text.encode()
            own = runs_of(raw)
            if spans := rule_spans(text, raw):  # what a rule has found, or holds, is no other run
                for span in spans:
                    found[span[0]].add(value_of(text, span))
                own -= {m[0].encode() for m in RUN.finditer(text) if any(x < m.end() and m.start() < y for _, x, y in spans)}
            found["other"] |= own
            if sum(map(len, found.values())) > RUNS_AT_ONCE:
                yield from out()
    yield from out()


def _of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """``coded`` of the batch's runs."""
    run = batch.column("run").cast(pa.large_binary())
    ends = np.frombuffer(run.buffers()[1], np.int64)[run.offset : run.offset + len(run) + 1]
    return _NUMBER[np.frombuffer(run.buffers()[2], np.uint8)[ends[0] : ends[-1]]], ends - ends[0]


def _total(rows: DataFrame, cells: int, count: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum of what ``count`` gives for each batch, a whole number a cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.int64)
        for batch in batches:
            if batch.num_rows:
                total += count(batch)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"cell": pa.array(at, pa.int64()), "n": pa.array(total[at], pa.int64())})

    out = np.zeros(cells, np.int64)
    for r in rows.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r["cell"]] = r["n"]
    return out


def _tenth_over(model: Model, runs: DataFrame) -> float:
    """``_tenth`` over any number of runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict({"z": model.scores(batch.column("run").to_pylist())})

    scored = staged(runs.select("run").mapInArrow(run, "z double"), "secrets-scores")
    n = scored.count()
    return scored.agg(F.expr(f"percentile_disc({(n // 10 + 0.5) / n}) WITHIN GROUP (ORDER BY z)")).first()[0]


def _refitted(automata: dict[str, Automaton], credentials: DataFrame) -> dict[str, Automaton]:
    """The same states and moves, with the likelihoods of all ``credentials`` (kind, run)."""
    first = np.concatenate([[0], np.cumsum([len(a.end) * (K + 1) for a in automata.values()])]).astype(np.int64)

    def count(batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros(first[-1], np.int64)
        for lo, hi, (kind, automaton) in zip(first, first[1:], automata.items(), strict=False):
            own = batch.filter(pc.equal(batch.column("kind"), kind))
            if own.num_rows:
                out[lo:hi] = automaton.visits(*_of(own)).ravel()
        return out

    found = _total(credentials, int(first[-1]), count)
    visits = [found[lo:hi].reshape(-1, K + 1).astype(np.float64) for lo, hi in zip(first, first[1:], strict=False)]
    return {kind: Automaton.counted(v[:, :K], v[:, K], a.moves) for (kind, a), v in zip(automata.items(), visits, strict=True)}


def _separate_over(model: Model, others: DataFrame, rows: int) -> None:
    """``_separate`` over any number of other runs."""

    def formats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.append_column("formats", pa.array(model.formats(*_of(batch))))

    scored = staged(others.mapInArrow(formats, "run binary, formats double"), "secrets-formats")

    def step(now: tuple[Background, float], before: tuple[Background, float] | None) -> Callable[[pa.RecordBatch], np.ndarray]:
        def count(batch: pa.RecordBatch) -> np.ndarray:
            (codes, ends), own = _of(batch), batch.column("formats").to_numpy()
            weights = _no_format(own, now[0].likelihoods(codes, ends), now[1])
            last = np.ones(len(own)) if before is None else _no_format(own, before[0].likelihoods(codes, ends), before[1])
            parts = np.rint(weights * PARTS)
            return np.concatenate([Background.steps(codes, ends, parts).ravel(), [parts.sum(), (np.abs(weights - last) >= MOVED).sum()]]).astype(np.int64)

        return count

    share, before = 0.5, None
    for _ in range(ROUNDS):
        now = model.background, share
        *pairs, weight, moved = _total(scored, (K + 1) ** 2 + 2, step(now, before))
        model.background = Background.counted(np.array(pairs, np.float64).reshape(K + 1, K + 1) / PARTS)
        if not moved:
            break
        before, share = now, _bounded(1 - float(weight) / PARTS / max(rows, 1))


def fit(documents: DataFrame) -> Model:
    """From all documents: every different credential that the rules find and every different other run.

    Where they are more than the driver takes, it learns each automaton's states from SAMPLE_RUNS credentials; all
    likelihoods, the background and the cut come from all of them, as ``train`` has it; a fifth is kept back by hash, and
    all of a kind's credentials are learned from and place the cut where the hash leaves one of both without any.
    """
    found = staged(documents.select(F.col("text").cast("string").alias("text")).mapInArrow(_different, "kind string, run binary").distinct(), "secrets-runs")
    sizes = {r["kind"]: (r["n"], r["longest"]) for r in found.groupBy("kind").agg(F.count("*").alias("n"), F.max(F.length("run")).alias("longest")).collect()}
    if all(n <= (SAMPLE_OTHERS if kind == "other" else SAMPLE_RUNS) and longest <= RUN_LETTERS for kind, (n, longest) in sizes.items()):
        by_kind: dict[str, list[str]] = {kind: [] for kind in ("assign", "access", "hex", "other")}
        for r in found.orderBy("kind", "run").collect():
            by_kind[r["kind"]].append(r["run"].decode())
        return train(by_kind, by_kind.pop("other"))
    kept = F.pmod(F.xxhash64(F.lit("secrets-kept"), "kind", "run"), F.lit(5)) == 0
    credentials, others = staged(found.filter("kind <> 'other'").withColumn("kept", kept), "secrets-credentials"), found.filter("kind = 'other'").select("run")
    both = {r["kind"]: r["sides"] for r in credentials.groupBy("kind").agg(F.count_distinct("kept").alias("sides")).collect()}
    whole = F.col("kind").isin([kind for kind, sides in both.items() if sides < 2])
    learned, held = credentials.filter(~F.col("kept") | whole).select("kind", "run"), credentials.filter(F.col("kept") | whole).select("kind", "run")
    automata = {}
    for kind in sorted(both):
        if sizes[kind][0] >= 5:
            sample = learned.filter(F.col("kind") == kind).orderBy(F.crc32("run"), "run").limit(SAMPLE_RUNS)
            automata[kind] = learn([bytes(r[0]) for r in sample.select(F.substring("run", 1, RUN_LETTERS + 1)).collect()])
    pairs = _total(others, (K + 1) ** 2, lambda b: Background.steps(*_of(b), np.ones(b.num_rows)).astype(np.int64).ravel())
    model = Model({}, Background.counted(pairs.reshape(K + 1, K + 1).astype(np.float64)), math.inf)
    for kind, automaton in (_refitted(automata, learned) if automata else {}).items():
        if _tenth_over(Model({kind: automaton}, model.background, 0.0), held.filter(F.col("kind") == kind)) > 0:
            model.automata[kind] = automaton
    if model.automata:
        _separate_over(model, others, sizes.get("other", (0, 0))[0])
        model.cut = max(0.0, _tenth_over(model, held.filter(F.col("kind").isin(list(model.automata)))) / 2)
    return model


def scan(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, counts and digests of the rules' spans, all spans, and their scores, of every document."""
    shared = documents.sparkSession.sparkContext.broadcast(model or fit(documents))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(shared.value)
        for batch in small(batches):
            all_texts, rows = texts(batch), []
            for part in slices(len(all_texts)):
                found = finder.spans(all_texts[part])
                for spans, scores in zip(found, finder.scores(all_texts[part], found), strict=True):
                    base = [s for s in spans if s[0] != "learned"]
                    n = Counter(s[0] for s in base)
                    line = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
                    rows.append((n["assign"], n["access"], n["hex"], hashlib.sha256(line.encode()).hexdigest(), ",".join(f"{k}:{a}:{b}" for k, a, b in spans), scores))
            kinds = {"n_assign": pa.int64(), "n_access": pa.int64(), "n_hex": pa.int64(), "base_sha256": pa.string(), "spans": pa.string(), "scores": pa.list_(pa.float64())}
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds.values()))], names=["doc_id", *kinds])

    d = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, scores array<double>")


def _blank(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if a >= at:
            out += [text[at:a], REDACTED]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """``documents`` with every span replaced by REDACTED (overlapping ones by a single one) and ``n_chars`` counted anew; a null text stays null."""
    shared = documents.sparkSession.sparkContext.broadcast(model or fit(documents))
    columns, schema = documents.columns, documents.schema
    spot = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(shared.value)
        for batch in small(batches):
            arrays, out, changed = list(batch.columns), [], []
            all_texts = batch.column(spot).to_pylist()
            for part in slices(len(all_texts)):
                for text, spans in zip(all_texts[part], finder.spans([t or "" for t in all_texts[part]]), strict=True):
                    out.append(_blank(text, spans) if spans else text)
                    changed.append(bool(spans))
            arrays[spot] = pa.array(out, pa.string())
            if "n_chars" in columns:
                i = columns.index("n_chars")
                own = batch.column(i).to_pylist()
                arrays[i] = pa.array([len(t) if c else n for t, c, n in zip(out, changed, own, strict=True)], batch.column(i).type)
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    return documents.mapInArrow(run, schema)
