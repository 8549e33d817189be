"""Secret scans: fixed formats, and formats inferred as probabilistic automata.

Three base patterns give credentials with certain formats. Their distinct values, all of them and whole, are the labelled
strings of a grammar inference: a prefix tree of character classes with counts, of which states are merged as long as
their outgoing frequencies, and those of all that follows, are compatible within a Hoeffding bound. The result is a
deterministic probabilistic automaton per kind, and one for the ordinary strings that look alike (mail hosts, addresses,
numbers). Values are counted by their classes in tasks; the driver gets one row for each string of classes, and makes only
the nodes of the tree that a decision needs. Every candidate, a run of credential characters with a digit, is scored by how much likelier a credential
automaton makes it than the ordinary one, per character; what lies above the threshold is added to the base spans.

One pass over the texts writes base spans and candidates, which are few; training and scoring read that table.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docassay.session import durable

#: Fixed patterns of the base kinds, in their order, and the least length of what must be long.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "format")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18
#: Words of which an assignment must hold one, in lower case.
KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")
#: A candidate: credential characters with a digit, at least so long.
_DIGIT, _RUN, LEAST = re.compile("[0-9]"), re.compile("[A-Za-z0-9+/_=-]+"), 12
_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")
#: The bound's confidence, and how much likelier per character (natural logarithm) a credential must be.
ALPHA, MARGIN = 0.05, 0.35


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of the base kinds, by start and then kind."""
    spans = []
    lower = text.lower()
    if any(k in lower for k in KEYWORDS):
        spans += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    spans += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return [(a, b, KINDS[k]) for a, b, k in sorted(spans, key=lambda s: (s[0], s[2]))]


def candidates(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Maximal runs of credential characters with a digit, of ``LEAST`` or more, that meet no base span."""
    out, at, k = [], 0, 0
    while m := _DIGIT.search(text, at):
        start = m.start()
        while start > at and text[start - 1] in _CHARS:
            start -= 1
        at = end = _RUN.match(text, m.start()).end()
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        if end - start >= LEAST and not any(a < end and start < b for a, b, _ in taken[k:k + 3]):
            out.append((start, end))
    return out


def classes(value: str) -> str:
    """Character classes: digits, hex letters and other letters by case; other characters are themselves."""
    return value.translate(_CLASS)


_OF = {**{c: "0" for c in "0123456789"}, **{c: "a" for c in "abcdef"}, **{c: "z" for c in "ghijklmnopqrstuvwxyz"},
       **{c: "A" for c in "ABCDEF"}, **{c: "Z" for c in "GHIJKLMNOPQRSTUVWXYZ"}}
_CLASS = str.maketrans(_OF)
#: Characters that a class stands for.
_WIDTH = {"0": 10, "a": 6, "z": 20, "A": 6, "Z": 20}


class Automaton:
    """A deterministic probabilistic automaton inferred from strings of classes, each as often as ``counts`` says.

    The prefix tree is made on demand: a state keeps the strings that have yet to go on from it until a decision looks below
    it, so tails that no other string shares never become nodes.
    """

    def __init__(self, strings: list[str], alpha: float = ALPHA, counts: list[int] | None = None):
        self.alpha = math.sqrt(0.5 * math.log(2 / alpha))
        self._strings, self._times = strings, counts or [1] * len(strings)
        # state: [passes, ends, {class: state}, {class: count}, (string, place) pairs not gone on yet or None, place of the first string]
        self.states: list[list | None] = [[sum(self._times), 0, {}, {}, [(i, 0) for i in range(len(strings))], (0, 0)]]
        self.start = 0
        self._open(0)
        self._merge()
        del self._strings, self._times

    def _open(self, at: int) -> list:
        """The state, its strings taken one step on."""
        state = self.states[at]
        if state[4] is not None:
            waiting, state[4] = state[4], None
            for i, k in waiting:
                s, n = self._strings[i], self._times[i]
                if k == len(s):
                    state[1] += n
                    continue
                c = s[k]
                state[3][c] = state[3].get(c, 0) + n
                if c not in state[2]:
                    state[2][c] = len(self.states)
                    self.states.append([0, 0, {}, {}, [], (i, k + 1)])
                child = self.states[state[2][c]]
                child[0] += n
                child[4].append((i, k + 1))
        return state

    def _differ(self, x: int, n: int, y: int, m: int) -> bool:
        return n > 0 and m > 0 and abs(x / n - y / m) > self.alpha * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if self.states[b][0] <= self.alpha ** 2:
                continue  # so few strings differ from nothing, nor do the fewer below
            p, q = self._open(a), self._open(b)
            if self._differ(p[1], p[0], q[1], q[0]):
                return False
            for c in p[3].keys() | q[3].keys():
                if self._differ(p[3].get(c, 0), p[0], q[3].get(c, 0), q[0]):
                    return False
                if c in p[2] and c in q[2]:
                    todo.append((p[2][c], q[2][c]))
        return True

    def _fold(self, into: int, tree: int) -> None:
        """Add the counts of a tree to the states that read the same strings."""
        todo = [(into, tree)]
        while todo:
            a, b = todo.pop()
            p, q = self.states[a], self.states[b]
            p[0] += q[0]
            if p[4] is not None and q[4] is not None:
                p[4] += q[4]
                self.states[b] = None
                continue
            self._open(a)
            self._open(b)
            self.states[b] = None
            p[1] += q[1]
            for c, n in q[3].items():
                p[3][c] = p[3].get(c, 0) + n
                if c in p[2]:
                    todo.append((p[2][c], q[2][c]))
                else:
                    p[2][c] = q[2][c]

    def _merge(self) -> None:
        kept, known = [0], {0}

        def fringe() -> tuple[int, str] | None:
            """Of what hangs below kept states and is not kept yet, the one that is up for a decision."""
            below = ((r, d) for r in kept for d, s in self.states[r][2].items() if s not in known)
            return min(below, key=lambda x: (self.states[x[0]][5], x[1]), default=None)

        while (up := fringe()) is not None:
            parent, c = up
            child = self.states[parent][2][c]
            for red in kept:
                if self._compatible(red, child):
                    self.states[parent][2][c] = red
                    self._fold(red, child)
                    break
            else:
                self._open(child)
                kept.append(child)
                known.add(child)
        # only kept states are left, and get the numbers of their order
        number = {s: i for i, s in enumerate(kept)}
        self.states = [[*self.states[s][:2], {c: number[x] for c, x in self.states[s][2].items()}, self.states[s][3]] for s in kept]

    def per_character(self, s: str, width: bool = True) -> float:
        """Mean log-likelihood of a string's characters and its end; unseen steps count as half a case of twelve."""
        total, at = 0.0, self.start
        for c in s:
            passes, _, nexts, counts = self.states[at] if at >= 0 else (0, 0, {}, {})
            total += math.log((counts.get(c, 0) + 0.5) / (passes + 6)) - math.log(_WIDTH.get(c, 1))
            at = nexts.get(c, -1)
        passes, ends = self.states[at][:2] if at >= 0 else (0, 0)
        return (total + math.log((ends + 0.5) / (passes + 6))) / (len(s) + 1)


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, base, runs``: base spans as (start, end, kind, value) and candidates as (start, end, value) of each row."""
    schema = "doc_id bigint, base array<struct<start:int,end:int,kind:string,value:string>>, runs array<struct<start:int,end:int,value:string>>"
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("value", pa.string())])
    run_ = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, runs = [], []
            for text in batch.column(1).to_pylist():
                spans = base_spans(text) if text else []
                base.append([{"start": a, "end": b, "kind": k, "value": ASSIGN.match(text, a).group(2) if k == "assign" else text[a:b]} for a, b, k in spans])
                runs.append([{"start": a, "end": b, "value": text[a:b]} for a, b in candidates(text, sorted(spans))] if text else [])
            yield pa.record_batch([batch.column(0), pa.array(base, pa.list_(span)), pa.array(runs, pa.list_(run_))], ["doc_id", "base", "runs"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(find, schema)


def infer(found: DataFrame) -> dict[str, Automaton]:
    """An automaton for each base kind and for ``ordinary`` candidates, each from all of its distinct values."""
    values = found.select(F.explode("base").alias("s")).select("s.kind", "s.value").unionByName(
        found.select(F.explode("runs").alias("s")).select(F.lit("ordinary").alias("kind"), "s.value")).distinct()
    of = F.translate("value", "".join(_OF), "".join(_OF.values()))
    rows = values.groupBy("kind", of.alias("of")).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("first")).toArrow()
    by_kind: dict[str, tuple[list[str], list[int]]] = {}
    for kind, _, s, n in sorted(zip(*(rows[c].to_pylist() for c in ("kind", "first", "of", "n")))):
        strings, counts = by_kind.setdefault(kind, ([], []))
        strings.append(s)
        counts.append(n)
    return {k: Automaton(s, counts=n) for k, (s, n) in by_kind.items()}


def likeness(value: str, automata: dict[str, Automaton]) -> float:
    """How much likelier per character a credential automaton makes a string than the ordinary one; 0 without labels."""
    s = classes(value)
    kinds = [a.per_character(s) for k, a in automata.items() if k != "ordinary"]
    return max(kinds) - automata["ordinary"].per_character(s) if kinds and "ordinary" in automata else 0.0


def secrets(docs: DataFrame, margin: float = MARGIN) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_format`` for every row of ``docs`` (doc_id, text).

    Offsets are in code points, ends exclusive. Defined cases: a null text counts as empty, which has no span and the
    digest of the empty string; rows with one id, or a null one, stay separate rows; without any base span in the whole
    table nothing can be learnt and nothing is added.
    """
    found = durable(scan(docs))
    automata = infer(found)
    schema = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_format bigint"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for base, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                spans = [(s["start"], s["end"], KINDS.index(s["kind"])) for s in base or []]
                added = [(s["start"], s["end"], 3) for s in runs or [] if likeness(s["value"], automata) > margin]
                said = [[f"{KINDS[k]}:{a}:{b}" for a, b, k in sorted(x, key=lambda y: (y[0], y[2]))] for x in (spans, spans + added)]
                n = [sum(k == i for _, _, k in spans) for i in range(3)]
                out.append((*n, hashlib.sha256(",".join(said[0]).encode()).hexdigest(), ",".join(said[1]), len(added)))
            cols = list(zip(*out)) if out else [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.record_batch([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds))],
                                  ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_format"])

    return found.mapInArrow(score, schema)
