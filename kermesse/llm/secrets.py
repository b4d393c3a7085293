"""Secret scans: all rules in one deterministic automaton, one pass over the bytes of a text.

The pass tells which rules match somewhere. Only for those, a rule's own two automata give the spans:
one reads backward and marks every byte where a match can start, the other reads forward from the
first mark not yet passed to the last byte where it accepts. So every text takes time in proportion
to its length, however many starts lead nowhere.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as op
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from kermesse.llm.common import slices


@dataclass(frozen=True)
class Rule:
    """`exact` is the whole rule; its matches are the leftmost longest ones, not overlapping, and one
    counts if `group` has at least `least` characters. `scan` is what the joint automaton looks for,
    part of every match that counts: the rule with its last repeat cut short. Few of them count their
    repeats, since a joint state would have to track each count beside the others'."""

    kind: str
    scan: str
    exact: str
    least: int = 1
    group: int = 0


_NAMES = "(?i:password|passwd|secret|token|api_?key)"
_ASSIGNED = r"""["']?\x20*[:=]\x20*["']?"""
_VALUE = "[A-Za-z0-9+/_.=-]"
_KEY_LINE = "-----BEGIN [A-Z ]*PRIVATE KEY-----"

BASE_KINDS = ("assign", "access", "hex")
RULES = (
    Rule("assign", f"{_NAMES}{_ASSIGNED}{_VALUE}{{12}}", f"({_NAMES}){_ASSIGNED}({_VALUE}+)", 12, 2),
    Rule("access", "AKIA[A-Z0-9]", "AKIA[A-Z0-9]+", 18),
    Rule("hex", "[0-9a-f]{16}", "[0-9a-f]+", 16),
    Rule("private_key", _KEY_LINE, f"{_KEY_LINE}(?:(?:[^-]|-[^-]|--[^-])*-----END [A-Z ]*PRIVATE KEY-----)?"),
    Rule("code_host", "gh[pousr]_[A-Za-z0-9]", "gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]", "xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("cloud_api", "AIza[0-9A-Za-z_-]", "AIza[0-9A-Za-z_-]+", 39),
    Rule("payment", "[sr]k_live_[0-9A-Za-z]", "[sr]k_live_[0-9A-Za-z]+", 24),
    Rule(
        "web_token",
        r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]",
        r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+",
    ),
)

COLUMNS = (
    "n_assign long, n_access long, n_hex long, base_sha256 string, n_spans long, spans string"
)


class Nfa:
    """States with byte edges and empty edges; grown from the parsed form of a rule's pattern."""

    def __init__(self, backward: bool = False):
        self.backward = backward  # whether it reads matches from their end
        self.empty: list[list[int]] = []
        self.edges: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.edges.append([])
        return len(self.empty) - 1

    def add(self, start: int, nodes, folded: bool) -> int:
        """Hang a sequence of parsed nodes on `start`; returns where it ends."""
        for kind, value in reversed(nodes) if self.backward else nodes:
            if kind is op.SUBPATTERN:
                _, on, off, inner = value
                start = self.add(start, inner, (folded or bool(on & re.I)) and not off & re.I)
            elif kind is op.BRANCH:
                end = self.state()
                for branch in value[1]:
                    first = self.state()
                    self.empty[start].append(first)
                    self.empty[self.add(first, branch, folded)].append(end)
                start = end
            elif kind is op.MAX_REPEAT:
                low, high, inner = value
                for _ in range(low):
                    start = self.add(start, inner, folded)
                if high == op.MAXREPEAT:
                    loop, end = self.state(), self.state()
                    self.empty[start] += [loop, end]
                    self.empty[self.add(loop, inner, folded)] += [loop, end]
                    start = end
                else:
                    end = self.state()
                    self.empty[start].append(end)
                    for _ in range(high - low):
                        start = self.add(start, inner, folded)
                        self.empty[start].append(end)
                    start = end
            else:
                end = self.state()
                self.edges[start].append((_byte_set(kind, value, folded), end))
                start = end
        return start

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for nxt in self.empty[todo.pop()]:
                if nxt not in seen:
                    seen.add(nxt)
                    todo.append(nxt)
        return frozenset(seen)


def _byte_set(kind, value, folded: bool) -> frozenset[int]:
    if kind is op.LITERAL:
        found = {value}
    elif kind is op.NOT_LITERAL:
        found = set(range(256)) - {value}
    elif kind is op.IN:
        found, negated = set(), False
        for item, detail in value:
            if item is op.NEGATE:
                negated = True
            elif item is op.LITERAL:
                found.add(detail)
            elif item is op.RANGE:
                found.update(range(detail[0], detail[1] + 1))
            elif detail is op.CATEGORY_SPACE:
                found.update(b" \t\n\r\x0b\x0c")
            else:
                raise ValueError(f"no rule may use {detail}")
        found = set(range(256)) - found if negated else found
    else:
        raise ValueError(f"no rule may use {kind}")
    if folded:
        found |= {ord(chr(b).swapcase()) for b in found if b < 128 and chr(b).isalpha()}
    return frozenset(found)


@dataclass(frozen=True)
class Automaton:
    """Transition array of a minimal automaton. A state's number is the place of its row, of `width`
    entries; states from `accepting` on accept the rules in `rules`. `dead` leads nowhere."""

    classes: bytes
    width: int
    moves: tuple[int, ...]
    accepting: int
    rules: dict[int, frozenset[int]]
    dead: int

    def scan(self, data: bytes) -> set[int]:
        """The rules with a match that ends somewhere in `data`."""
        moves, accepting, state, seen = self.moves, self.accepting, 0, set()
        for symbol in data.translate(self.classes):
            state = moves[state + symbol]
            if state >= accepting:
                seen.add(state)
        return set().union(*(self.rules[s] for s in seen)) if seen else seen

    def marks(self, data: bytes) -> list[int]:
        """Places where a backward automaton accepts, from the last one to the first."""
        moves, accepting, state, found = self.moves, self.accepting, 0, []
        place = len(data)
        for symbol in data.translate(self.classes)[::-1]:
            place -= 1
            state = moves[state + symbol]
            if state >= accepting:
                found.append(place)
        return found

    def reach(self, symbols: memoryview) -> int:
        """The last place where a forward automaton accepts, reading from the start; 0 for none."""
        moves, accepting, dead, state, end = self.moves, self.accepting, self.dead, 0, 0
        for place, symbol in enumerate(symbols, 1):
            state = moves[state + symbol]
            if state >= accepting:
                end = place
            elif state == dead:
                break
        return end


def compile_rules(
    patterns: tuple[str, ...], *, anywhere: bool = True, backward: bool = False
) -> Automaton:
    """Subset construction over the rules' joint automaton, then minimisation. With `anywhere` a
    match may begin at any byte, else only at the first one; with `backward` bytes come last first."""
    nfa = Nfa(backward)
    root = nfa.state()
    ends = {}
    for number, pattern in enumerate(patterns):
        first = nfa.state()
        nfa.empty[root].append(first)
        ends[nfa.add(first, _parser.parse(pattern.encode()), False)] = number

    # Bytes that no rule tells apart share a class.
    sets = list({chars for edges in nfa.edges for chars, _ in edges})
    signature = [tuple(b in chars for chars in sets) for b in range(256)]
    number_of = {s: i for i, s in enumerate(dict.fromkeys(signature))}
    classes = bytes(number_of[s] for s in signature)
    samples = [classes.index(i) for i in range(len(number_of))]

    begin = nfa.closure([root])
    again = begin if anywhere else frozenset()
    by_class = [
        [[to for chars, to in edges if b in chars] for b in samples] for edges in nfa.edges
    ]
    subsets, moves, todo = {begin: 0}, [], deque([begin])
    while todo:
        current = todo.popleft()
        row = []
        for i in range(len(samples)):
            reached = {to for s in current for to in by_class[s][i]}
            target = nfa.closure(reached) | again
            if target not in subsets:
                subsets[target] = len(subsets)
                todo.append(target)
            row.append(subsets[target])
        moves.append(row)
    accepts = [frozenset(ends[s] for s in subset if s in ends) for subset in subsets]
    nowhere = subsets.get(frozenset())
    block, moves = _minimal(moves, accepts)
    accepts = {b: accepts[s] for s, b in enumerate(block)}

    # The start comes first, accepting states last.
    order = sorted(range(len(moves)), key=lambda b: (bool(accepts[b]), b != block[0], b))
    width = len(samples)
    place = {b: i * width for i, b in enumerate(order)}
    flat = tuple(place[to] for b in order for to in moves[b])
    rules = {place[b]: accepts[b] for b in order if accepts[b]}
    dead = -1 if nowhere is None else place[block[nowhere]]
    return Automaton(classes, width, flat, min(rules, default=len(flat)), rules, dead)


class Scanner:
    """The joint automaton of some rules, and each rule's own pair for its spans."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.joint = compile_rules(tuple(rule.scan for rule in rules))
        self.backward = [compile_rules((rule.exact,), backward=True) for rule in rules]
        self.forward = [compile_rules((rule.exact,), anywhere=False) for rule in rules]
        self.exact = [re.compile(rule.exact.encode()) for rule in rules]

    def matches(self, number: int, data: bytes) -> Iterator[tuple[int, int]]:
        """(start, end) in bytes of all matches of a rule, counted or not."""
        forward, passed = self.forward[number], 0
        symbols = memoryview(data.translate(forward.classes))
        for start in reversed(self.backward[number].marks(data)):
            if start >= passed:
                passed = start + forward.reach(symbols[start:])
                yield start, passed

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, rule number, end) in code points of the matches that count, in order."""
        data = text.encode()
        spans = []
        for number in self.joint.scan(data):
            rule, exact = self.rules[number], self.exact[number]
            for start, end in self.matches(number, data):
                if rule.least > 1:
                    found = exact.fullmatch(data, start, end)  # for its group
                    if len(found[rule.group]) < rule.least:
                        continue
                spans.append((start, number, end))
        if spans and len(text) != len(data):
            points = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
            at = lambda byte: int(points[byte - 1]) if byte else 0
            spans = [(at(start), number, at(end)) for start, number, end in spans]
        return sorted(spans)


def _minimal(moves: list[list[int]], accepts: list) -> tuple[list[int], list[list[int]]]:
    """(block of each state, moves between blocks): states are split until blocks agree."""
    names = {a: i for i, a in enumerate(dict.fromkeys(accepts))}
    block = [names[a] for a in accepts]
    count = 0
    while len(set(block)) != count:
        count = len(set(block))
        keys = [(block[s], *[block[t] for t in row]) for s, row in enumerate(moves)]
        names = {k: i for i, k in enumerate(dict.fromkeys(keys))}
        block = [names[k] for k in keys]
    rows = {block[s]: [block[t] for t in row] for s, row in enumerate(moves)}
    return block, [rows[b] for b in range(len(rows))]


def scan_secrets(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`docs` without its text, with COLUMNS; columns of these names are replaced.

    The automata are compiled once, on the driver. The joint one passes over each text once for all
    rules; where it accepts, that rule's own ones give the spans, leftmost longest, not overlapping.
    `spans` lists kind:start:end by start, then by rule; `base_sha256` is of the base kinds' list.
    A null or empty text has no spans. Rows never meet.
    """
    columns = StructType.fromDDL(COLUMNS)
    rest = docs.drop(text, *columns.names)
    names = rest.columns
    scanner = Scanner(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                rows = []
                for value in part.column(text).to_pylist():
                    spans = scanner.spans(value) if value else []
                    kinds = [rules[number].kind for _, number, _ in spans]
                    listed = [f"{k}:{start}:{end}" for k, (start, _, end) in zip(kinds, spans)]
                    base = ",".join(s for k, s in zip(kinds, listed) if k in BASE_KINDS)
                    rows.append(
                        (
                            *[kinds.count(kind) for kind in BASE_KINDS],
                            hashlib.sha256(base.encode()).hexdigest(),
                            len(spans),
                            ",".join(listed),
                        )
                    )
                types = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.string()]
                arrays = [pa.array(v, t) for v, t in zip(zip(*rows), types)]
                kept = part.select(names)
                yield pa.RecordBatch.from_arrays(
                    [*kept.columns, *arrays], names=[*names, *columns.names]
                )

    keep = docs.select(*names, text) if text not in names else docs
    return keep.mapInArrow(run, StructType([*rest.schema.fields, *columns.fields]))
