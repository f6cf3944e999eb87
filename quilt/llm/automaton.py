"""Byte patterns compiled to one minimal deterministic automaton.

Syntax: literals, ``\\xHH`` and escaped characters, classes ``[a-z_]``, groups,
``|``, ``?``, ``*``, ``+`` and ``{m,}``/``{m,n}``. Patterns become one NFA,
subset construction over classes of bytes that no pattern tells apart makes it
deterministic, partition refinement merges equal states.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class _Nfa:
    eps: list[list[int]] = field(default_factory=list)
    move: list[tuple[frozenset, int] | None] = field(default_factory=list)

    def state(self) -> int:
        self.eps.append([])
        self.move.append(None)
        return len(self.eps) - 1


def _escape(p: str, i: int) -> tuple[int, int]:
    """The byte at p[i], which may be escaped, and the position after it."""
    if p[i] != "\\":
        return ord(p[i]), i + 1
    if p[i + 1] == "x":
        return int(p[i + 2 : i + 4], 16), i + 4
    return ord(p[i + 1]), i + 2


def _parse(p: str):
    """A tree of ("set", bytes), ("cat", [..]), ("alt", [..]) and ("rep", node, least, most or None)."""

    def alt(i):
        options, i = [], i
        node, i = cat(i)
        options.append(node)
        while i < len(p) and p[i] == "|":
            node, i = cat(i + 1)
            options.append(node)
        return (options[0] if len(options) == 1 else ("alt", options)), i

    def cat(i):
        nodes = []
        while i < len(p) and p[i] not in "|)":
            node, i = atom(i)
            while i < len(p) and p[i] in "?*+{":
                if p[i] == "{":
                    end = p.index("}", i)
                    low, comma, high = p[i + 1 : end].partition(",")
                    node, i = ("rep", node, int(low), (int(high) if high else None) if comma else int(low)), end + 1
                else:
                    node, i = ("rep", node, int(p[i] == "+"), 1 if p[i] == "?" else None), i + 1
            nodes.append(node)
        return ("cat", nodes), i

    def atom(i):
        if p[i] == "(":
            node, i = alt(i + 1)
            return node, i + 1
        if p[i] == "[":
            found, i = set(), i + 1
            while p[i] != "]":
                a, i = _escape(p, i)
                b = a
                if p[i] == "-" and p[i + 1] != "]":
                    b, i = _escape(p, i + 1)
                found.update(range(a, b + 1))
            return ("set", frozenset(found)), i + 1
        byte, i = _escape(p, i)
        return ("set", frozenset([byte])), i

    tree, end = alt(0)
    if end != len(p):
        raise ValueError(f"unbalanced pattern: {p}")
    return tree


def _reversed(tree):
    kind = tree[0]
    if kind == "cat":
        return ("cat", [_reversed(x) for x in reversed(tree[1])])
    if kind == "alt":
        return ("alt", [_reversed(x) for x in tree[1]])
    if kind == "rep":
        return ("rep", _reversed(tree[1]), *tree[2:])
    return tree


def _build(nfa: _Nfa, tree, start: int) -> int:
    """Add tree behind state start; returns the state at its end."""
    kind = tree[0]
    if kind == "set":
        end = nfa.state()
        nfa.move[start] = (tree[1], end)
        return end
    if kind == "cat":
        for x in tree[1]:
            fresh = nfa.state()
            nfa.eps[start].append(fresh)
            start = _build(nfa, x, fresh)
        return start
    if kind == "alt":
        end = nfa.state()
        for x in tree[1]:
            fresh = nfa.state()
            nfa.eps[start].append(fresh)
            nfa.eps[_build(nfa, x, fresh)].append(end)
        return end
    _, node, least, most = tree
    for _ in range(least):
        fresh = nfa.state()
        nfa.eps[start].append(fresh)
        start = _build(nfa, node, fresh)
    end = nfa.state()
    if most is None:
        fresh = nfa.state()
        nfa.eps[start] += [fresh, end]
        last = _build(nfa, node, fresh)
        nfa.eps[last] += [fresh, end]
    else:
        nfa.eps[start].append(end)
        for _ in range(most - least):
            fresh = nfa.state()
            nfa.eps[start].append(fresh)
            start = _build(nfa, node, fresh)
            nfa.eps[start].append(end)
    return end


@dataclass
class Automaton:
    """table[state << 8 | byte] is the next state, shifted by 8; states from ``special`` on accept rules accepts[state]."""

    table: list[int]
    special: int
    accepts: list[tuple[int, ...]]
    dead: int


def compile_rules(patterns: list[str], anchored: bool = False, backward: bool = False) -> Automaton:
    """One minimal automaton for all patterns; unless anchored a match may begin at any byte, backward reads from its end."""
    nfa = _Nfa()
    root = nfa.state()
    finals: dict[int, int] = {}
    for k, p in enumerate(patterns):
        tree = _parse(p)
        fresh = nfa.state()
        nfa.eps[root].append(fresh)
        finals[_build(nfa, _reversed(tree) if backward else tree, fresh)] = k
    sets = {m[0] for m in nfa.move if m}
    # Bytes that the same sets hold behave alike.
    groups: dict[tuple, list[int]] = {}
    ordered = list(sets)
    for b in range(256):
        groups.setdefault(tuple(b in s for s in ordered), []).append(b)
    classes = list(groups.values())

    def closure(states) -> frozenset:
        found, todo = set(states), list(states)
        while todo:
            for t in nfa.eps[todo.pop()]:
                if t not in found:
                    found.add(t)
                    todo.append(t)
        return frozenset(found)

    begin = closure([root])
    number, rows, todo = {begin: 0}, [], [begin]
    for now in todo:
        row = []
        for members in classes:
            b = members[0]
            after = closure([nfa.move[s][1] for s in now if nfa.move[s] and b in nfa.move[s][0]])
            if not anchored:
                after |= begin
            if after not in number:
                number[after] = len(number)
                todo.append(after)
            row.append(number[after])
        rows.append(row)
    accepts = [tuple(sorted({finals[s] for s in now if s in finals})) for now in todo]
    # Refine by acceptance, then by successors, until nothing splits.
    names = {a: i for i, a in enumerate(dict.fromkeys(accepts))}
    block = [names[a] for a in accepts]
    while True:
        keys = [(block[s], *(block[t] for t in rows[s])) for s in range(len(rows))]
        names = {key: i for i, key in enumerate(dict.fromkeys(keys))}
        refined = [names[key] for key in keys]
        if len(names) == len(set(block)):
            break
        block = refined
    lead: dict[int, int] = {}
    for s, b in enumerate(block):
        lead.setdefault(b, s)
    # Plain states first, so one comparison finds the accepting ones; the start state is 0.
    merged = sorted(lead, key=lambda b: (bool(accepts[lead[b]]), b != block[0], b))
    place = {b: i for i, b in enumerate(merged)}
    table = [0] * (256 * len(merged))
    for b in merged:
        for c, members in enumerate(classes):
            to = place[block[rows[lead[b]][c]]] << 8
            for byte in members:
                table[place[b] << 8 | byte] = to
    kept = [accepts[lead[b]] for b in merged]
    special = next((i for i, a in enumerate(kept) if a), len(kept))
    dead = next((i for i, a in enumerate(kept) if not a and all(t == i << 8 for t in table[i << 8 : (i + 1) << 8])), -1)
    return Automaton(table, special << 8, kept, dead << 8 if dead >= 0 else -1)
