"""Secret scans: one deterministic automaton for all rules.

Rules are regular expressions over bytes of a small syntax (``parse``). Their Thompson automata are joined behind a
loop over any byte, made deterministic by subset construction and minimised, which gives a transition array
[state, byte] and a bit mask of rules for each state. One pass over the bytes finds which rules occur in which text:
numpy steps many pieces of texts at once, and pieces whose start state was guessed wrongly are run again from the
state that their predecessor ended in, until they meet the path already known.

The automaton looks for a short form of a rule that every secret of it begins with, so every secret sets it off. Marked texts are read once more
from their ends by the automaton of all short forms reversed, which tells where rules start; from there each rule's own automaton goes on to its
last accepting byte. That gives leftmost, non-overlapping matches of each kind, of which those that meet the kind's condition are spans.

Defined cases: a null text counts as empty; texts of any length are scanned whole; repeated rows get equal rows; other
columns are passed over.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, slices, table


@dataclass(frozen=True)
class Rule:
    """``scan`` is what every secret holds from its start on; ``full`` gives its end, and ``least`` characters of it, or of what follows ``head``, make it one."""

    kind: str
    scan: str
    full: str
    least: int = 0
    head: str = ""


def _any_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(map(_any_case, ("password", "passwd", "secret", "token"))) + "|" + _any_case("api") + "_?" + _any_case("key")
_HEAD = rf"({_KEYS})[\"']?\x20*[:=]\x20*[\"']?"
#: The base rules, in the order in which equal starts are listed, then further ones.
RULES = (
    Rule("assign", _HEAD + "[A-Za-z0-9+/_.=-]", _HEAD + "[A-Za-z0-9+/_.=-]+", 6, _HEAD),
    Rule("access", "AKIA[A-Z0-9]{8}", "AKIA[A-Z0-9]+", 20),
    Rule("hex", "[0-9a-f]{16}", "[0-9a-f]+", 24),
    Rule("private_key", "-----BEGIN (RSA |EC |DSA |OPENSSH |ENCRYPTED |)PRIVATE KEY", "-----BEGIN (RSA |EC |DSA |OPENSSH |ENCRYPTED |)PRIVATE KEY-----"),
    Rule("forge_token", "gh[pousr]_[A-Za-z0-9]{4}", "gh[pousr]_[A-Za-z0-9]{36}[A-Za-z0-9]*"),
    Rule("chat_token", "xox[abprs]-", "xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("web_token", "eyJ[A-Za-z0-9_-]{3}", r"eyJ[A-Za-z0-9_-]{8}[A-Za-z0-9_-]*\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
)
BASE = 3


# --- regular expression -> automaton ---------------------------------------------------------------------------------


class _Parser:
    """Literals, escapes, [classes], (groups), |, ?, *, + and {n}, over bytes."""

    def __init__(self, text: str) -> None:
        self.text, self.at = text, 0

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def choice(self):
        options = [self.sequence()]
        while self.peek() == "|":
            self.at += 1
            options.append(self.sequence())
        return ("or", options) if len(options) > 1 else options[0]

    def sequence(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeated())
        return ("seq", parts)

    def repeated(self):
        node = self.atom()
        while (c := self.peek()) and c in "?*+{":
            self.at += 1
            if c == "{":
                end = self.text.index("}", self.at)
                node = ("seq", [node] * int(self.text[self.at : end]))
                self.at = end + 1
            else:
                node = {"?": ("or", [node, ("seq", [])]), "*": ("star", node), "+": ("seq", [node, ("star", node)])}[c]
        return node

    def char(self) -> int:
        c = self.text[self.at]
        self.at += 1
        if c != "\\":
            return ord(c)
        c = self.text[self.at]
        self.at += 1
        if c == "x":
            self.at += 2
            return int(self.text[self.at - 2 : self.at], 16)
        return ord(c)

    def atom(self):
        c = self.peek()
        if c == "(":
            self.at += 1
            node = self.choice()
            self.at += 1
            return node
        if c != "[":
            return ("set", frozenset((self.char(),)))
        self.at += 1
        found: set[int] = set()
        while self.peek() != "]":
            low = self.char()
            if self.peek() == "-" and self.text[self.at + 1] != "]":
                self.at += 1
                found.update(range(low, self.char() + 1))
            else:
                found.add(low)
        self.at += 1
        return ("set", frozenset(found))


def parse(text: str):
    return _Parser(text).choice()


def backward(node):
    """The tree of the strings of ``node`` read from the end."""
    kind, x = node
    if kind == "set":
        return node
    if kind == "star":
        return kind, backward(x)
    parts = [backward(p) for p in x]
    return kind, parts[::-1] if kind == "seq" else parts


@dataclass(frozen=True)
class Automaton:
    #: [state, byte] -> state; 0 is the start.
    step: np.ndarray
    #: Bits of the rules that end in a state.
    ends: np.ndarray


def compile_rules(rules: list[tuple], anywhere: bool = True) -> Automaton:
    """Subset construction over all rules (trees) at once, then minimisation by refining classes of states.

    ``anywhere``: a rule may begin at any byte; otherwise at the first one, and a state of no rule leads nowhere else.
    """
    edges: list[list[tuple[frozenset, int]]] = []
    free: list[list[int]] = []
    new = lambda: (edges.append([]), free.append([]), len(edges) - 1)[2]

    def build(node, start: int) -> int:
        kind, x = node
        if kind == "set":
            end = new()
            edges[start].append((x, end))
            return end
        if kind == "seq":
            for part in x:
                start = build(part, start)
            return start
        end = new()
        if kind == "or":
            for part in x:
                begin = new()
                free[start].append(begin)
                free[build(part, begin)].append(end)
            return end
        hub = new()
        free[start].append(hub)
        free[build(x, hub)].append(hub)
        free[hub].append(end)
        return end

    root, final = new(), {}
    for k, rule in enumerate(rules):
        begin = new()
        free[root].append(begin)
        final[build(rule, begin)] = 1 << k

    @cache
    def reach(state: int) -> frozenset:
        seen, todo = {state}, [state]
        while todo:
            for s in free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(s for s in seen if edges[s] or s in final)

    # Bytes that no rule tells apart share a class.
    signature: dict[tuple, int] = {}
    sets = sorted({s for e in edges for s, _ in e}, key=sorted)
    byte_class = np.array([signature.setdefault(tuple(b in s for s in sets), len(signature)) for b in range(256)])
    sample = [int(np.flatnonzero(byte_class == c)[0]) for c in range(len(signature))]

    start = reach(root)
    number, todo, rows = {start: 0}, [start], []
    for subset in todo:
        row = []
        for b in sample:
            target = set(start) if anywhere else set()
            for s in subset:
                for chars, t in edges[s]:
                    if b in chars:
                        target |= reach(t)
            target = frozenset(target)
            if target not in number:
                number[target] = len(number)
                todo.append(target)
            row.append(number[target])
        rows.append(row)
    step = np.array(rows)
    ends = np.array([sum(final.get(s, 0) for s in subset) for subset in todo])
    # Minimisation: split classes of states by where they lead until nothing changes.
    _, group = np.unique(ends, return_inverse=True)
    while True:
        _, finer = np.unique(np.column_stack([group, group[step]]), axis=0, return_inverse=True)
        finer = finer.ravel()
        if finer.max() == group.max():
            break
        group = finer
    order = np.unique(group, return_index=True)[1]
    # The start state becomes 0.
    order = np.r_[order[group[0]], np.delete(order, group[0])]
    rank = np.empty(len(order), int)
    rank[group[order]] = np.arange(len(order))
    return Automaton(np.ascontiguousarray(rank[group[step[order]]][:, byte_class].astype(np.uint16)), ends[order].astype(np.uint32))


def scan(automaton: Automaton, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, piece: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bit mask of the rules that end in each text data[start:end]; and all places in ``data`` where some end, with their masks."""
    hits = np.zeros(len(starts), np.uint32)
    size = ends - starts
    pieces = -(-size // piece)
    owner = np.repeat(np.arange(len(starts)), pieces)
    if not len(owner):
        return hits, np.zeros(0, np.int64), hits[:0]
    first = np.cumsum(pieces) - pieces
    begin = starts[owner] + (np.arange(len(owner)) - first[owner]) * piece
    length = np.minimum(begin + piece, ends[owner]) - begin
    # Longest first, so that those still running are a prefix.
    order = np.argsort(-length, kind="stable")
    owner_o, begin_o, length_o = owner[order], begin[order], length[order]
    step, marks = automaton.step.ravel(), automaton.ends
    path = np.zeros((piece, len(order)), np.uint16)
    state = np.zeros(len(order), np.int32)
    live = len(order)
    running = np.searchsorted(-length_o, -np.arange(piece), side="left")
    for t in range(int(length_o[0])):
        live = running[t]
        state[:live] = step[state[:live] * 256 + data[begin_o[:live] + t]]
        path[t, :live] = state[:live]
    # Pieces whose predecessor in the same text doesn't end in the start state run again beside the known path.
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    last = state[place]
    todo = np.flatnonzero((np.arange(len(owner)) > first[owner]) & (np.r_[0, last[:-1]] != 0))
    while len(todo):
        lane, now = place[todo], last[todo - 1].copy()
        where, t = todo, 0
        ended = []
        while len(where):
            now = step[now * 256 + data[begin[where] + t]].astype(np.int32)
            apart = now != path[t, lane]
            t += 1
            over = apart & (length[where] == t)
            for w, s in zip(where[over], now[over], strict=True):
                if last[w] != s:
                    last[w] = s
                    ended.append(w + 1)
            keep = apart & ~over
            path[t - 1, lane[apart]] = now[apart]
            where, lane, now = where[keep], lane[keep], now[keep]
        todo = np.array([w for w in ended if w < len(owner) and owner[w] == owner[w - 1]], np.int64)
    t, lane = np.nonzero((marks != 0)[path])
    mask = marks[path[t, lane]]
    np.bitwise_or.at(hits, owner_o[lane], mask)
    return hits, begin_o[lane] + t, mask


# --- operator --------------------------------------------------------------------------------------------------------


class Follower:
    """One expression, followed from a given byte on."""

    def __init__(self, text: str) -> None:
        table = compile_rules([parse(text)], anywhere=False)
        self.step, self.ends = table.step.tolist(), table.ends.tolist()
        self.dead = [not e and all(t == s for t in row) for s, (row, e) in enumerate(zip(self.step, self.ends, strict=True))]

    def longest(self, raw: bytes, at: int) -> int:
        """Where the longest match from ``at`` ends; -1: there is none."""
        state, end = 0, -1
        for k in range(at, len(raw)):
            state = self.step[state][raw[k]]
            if self.ends[state]:
                end = k + 1
            elif self.dead[state]:
                break
        return end


@dataclass(frozen=True)
class Machine:
    #: Which rules occur in a text, and, of a text read from its end, where they start.
    ahead: Automaton
    back: Automaton
    full: tuple[Follower, ...]
    head: tuple[Follower | None, ...]


@cache
def machine() -> Machine:
    scans = [parse(r.scan) for r in RULES]
    return Machine(compile_rules(scans), compile_rules([backward(x) for x in scans]), tuple(Follower(r.full) for r in RULES), tuple(Follower(r.head) if r.head else None for r in RULES))


def spans(raw: bytes, starts: list[int], masks: list[int], table: Machine) -> list[tuple[int, int, int]]:
    """(start, rule, end) of the secrets in ``raw``, sorted; bytes, end exclusive. ``starts``: where rules may start, in order."""
    found, last = [], [0] * len(RULES)
    for at, mask in zip(starts, masks, strict=True):
        for k, rule in enumerate(RULES):
            # Leftmost matches of a rule don't overlap, be they long enough or not.
            if mask >> k & 1 and at >= last[k] and (end := table.full[k].longest(raw, at)) >= 0:
                last[k] = end
                if end - (table.head[k].longest(raw, at) if rule.head else at) >= rule.least:
                    found.append((at, k, end))
    return sorted(found)


def find(texts: list[str | None], table: Machine) -> list[list[tuple[int, int, int]]]:
    """(start, rule, end) of the secrets of each text; code points, end exclusive."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    ends = np.cumsum(size)
    masks, _, _ = scan(table.ahead, np.frombuffer(b"".join(raw), np.uint8), ends - size, ends)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    some = np.flatnonzero(masks)
    if not len(some):
        return out
    # Read from the end, a rule of the marked texts ends where it starts.
    size = size[some]
    ends = np.cumsum(size)
    _, at, mask = scan(table.back, np.frombuffer(b"".join(raw[i][::-1] for i in some), np.uint8), ends - size, ends)
    owner = np.searchsorted(ends, at, side="right")
    start = ends[owner] - 1 - at
    order = np.lexsort((start, owner))
    owner, start, mask = owner[order], start[order], mask[order]
    cut = np.searchsorted(owner, np.arange(len(some) + 1))
    for j, i in enumerate(some.tolist()):
        got = spans(raw[i], start[cut[j] : cut[j + 1]].tolist(), mask[cut[j] : cut[j + 1]].tolist(), table)
        if got and not texts[i].isascii():
            # Code points before each byte.
            before = np.r_[0, np.cumsum((np.frombuffer(raw[i], np.uint8) & 0xC0) != 0x80)]
            got = [(int(before[s]), k, int(before[e])) for s, k, e in got]
        out[i] = got
    return out


def scan_texts(docs: DataFrame) -> DataFrame:
    """doc_id, spans array<struct<kind, first, last>> for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(machine())
    kind = pa.struct([("kind", pa.string()), ("first", pa.int64()), ("last", pa.int64())])

    def run(batches):
        for b in slices(batches, limit=1 << 20):
            got = [[{"kind": RULES[k].kind, "first": s, "last": e} for s, k, e in x] for x in find(b.column(1).to_pylist(), shared.value)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.list_(kind))], names=["doc_id", "found"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, found array<struct<kind: string, first: bigint, last: bigint>>")


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` (columns of documents) with every secret replaced, overlapping ones together; n_chars follows."""
    schema, shared = docs.schema, docs.sparkSession.sparkContext.broadcast(machine())

    def run(batches):
        at = schema.names.index("text")
        for b in slices(batches, column=at, limit=1 << 20):
            texts = b.column(at).to_pylist()
            for i, found in enumerate(find(texts, shared.value)):
                if found:
                    out, end = [], 0
                    for s, _, e in found:
                        if s >= end:
                            out += (texts[i][end:s], mask)
                        end = max(end, e)
                    texts[i] = "".join(out) + texts[i][end:]
            columns = b.columns
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    out = map_arrow(docs, run, schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_texts(table(spark, sf_dir, "documents"))
    base = [r.kind for r in RULES[:BASE]]
    listed = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["first"], x["last"])), ",")
    of_kind = lambda k: F.filter("found", lambda x: x["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in base]
    digest = F.sha2(listed(F.filter("found", lambda x: x["kind"].isin(base))), 256)
    return found.select("doc_id", *counts, digest.alias("base_sha256"), listed("found").alias("spans"))

