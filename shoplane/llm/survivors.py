"""Cheapest edit scripts of turn sequences by survivor-coalescence Viterbi.

States are what the repaired roles end with: nothing, a system turn, a user turn
or an assistant turn. A survivor is the best script that reaches a state: the
cheapest, ties the ASCII-least. Survivors are leaves of one tree of back
pointers with reference counts; a leaf that no survivor needs any more is freed
up to the next branch, and once all survivors share an ancestor the edits up to
it are final, emitted and freed. What stays in memory is the unresolved part.

Ties compare the whole unresolved scripts. Two scripts of equal cost that have
read the same rows are never prefixes of one another (a longer one has inserts,
which cost), so they differ first just below their lowest common ancestor. Skip
pointers find it in a logarithmic number of steps, however long the scripts are.
"""

from __future__ import annotations

from array import array

START, SYSTEM, USER, ASSISTANT = range(4)
KEEP = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: The state that a rerolled or inserted turn leads to.
TURN = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 2, 3, 2, 1


def next_state(state: int, edit: str, initial: str) -> int:
    return state if edit == "D" else KEEP[initial][state] if edit == "K" else TURN[state]


class Tree:
    """Back pointers with reference counts. Node 0 is the first root; ``depth`` counts edits."""

    def __init__(self):
        self.parent, self.skip, self.depth = array("q", [-1]), array("q", [-1]), array("q", [0])
        self.edit, self.refs = bytearray(b"."), array("i", [1])
        self.free: list[int] = []
        self.root = 0

    def add(self, parent: int, edit: str) -> int:
        """A node with one reference; it refers to its parent."""
        depth = self.depth[parent] + 1
        # the skip pointer of a depth leads to the depth without its lowest set bit
        to, skip = depth & (depth - 1), parent
        if to < self.depth[self.root]:
            skip = -1
        else:
            while self.depth[skip] > to:
                skip = self._up(skip, to)
        self.refs[parent] += 1
        if self.free:
            v = self.free.pop()
            self.parent[v], self.skip[v], self.depth[v], self.edit[v], self.refs[v] = parent, skip, depth, ord(edit), 1
            return v
        self.parent.append(parent)
        self.skip.append(skip)
        self.depth.append(depth)
        self.edit.append(ord(edit))
        self.refs.append(1)
        return len(self.parent) - 1

    def _up(self, v: int, least: int) -> int:
        """An ancestor of ``v`` at or below depth ``least``."""
        d = self.depth[v]
        return self.skip[v] if self.skip[v] >= 0 and d & (d - 1) >= max(least, self.depth[self.root]) else self.parent[v]

    def ancestor(self, v: int, depth: int) -> int:
        while self.depth[v] > depth:
            v = self._up(v, depth)
        return v

    def common(self, u: int, v: int) -> int:
        depth = min(self.depth[u], self.depth[v])
        u, v = self.ancestor(u, depth), self.ancestor(v, depth)
        root = self.depth[self.root]
        while u != v:
            d = self.depth[u]
            if d & (d - 1) >= root and self.skip[u] >= 0 and self.skip[u] != self.skip[v]:
                u, v = self.skip[u], self.skip[v]
            else:
                u, v = self.parent[u], self.parent[v]
        return u

    def less(self, u: int, last_u: str, v: int, last_v: str) -> bool:
        """Whether the script of ``u`` and then ``last_u`` comes before that of ``v`` and ``last_v``.
        An empty last edit stands for none."""
        at = self.common(u, v)
        depth = self.depth[at] + 1
        first_u = ord(last_u) if at == u else self.edit[self.ancestor(u, depth)]
        first_v = ord(last_v) if at == v else self.edit[self.ancestor(v, depth)]
        return first_u < first_v

    def release(self, v: int) -> None:
        self.refs[v] -= 1
        while self.refs[v] == 0 and v != self.root:
            self.free.append(v)
            v = self.parent[v]
            self.refs[v] -= 1

    def advance(self, to: int) -> str:
        """Make ``to`` the root; the edits on the way from the old root, which is freed."""
        edits, v = bytearray(), to
        while v != self.root:
            edits.append(self.edit[v])
            v = self.parent[v]
            self.free.append(v)
        self.root = to
        edits.reverse()
        return edits.decode()

    @property
    def size(self) -> int:
        return len(self.parent) - len(self.free)


class Repair:
    """Reads one conversation turn by turn; ``read`` and ``end`` return the edits that became final."""

    def __init__(self):
        self.tree = Tree()
        self.best: dict[int, tuple[int, int]] = {START: (0, 0)}  # state -> (cost, node); each holds a reference
        self._insert()

    def _insert(self) -> None:
        """Survivors that end with inserted turns, from cheaper states to dearer ones."""
        done: set[int] = set()
        while len(done) < len(self.best):
            state = min((s for s in self.best if s not in done), key=lambda s: self.best[s][0])
            done.add(state)
            cost, node = self.best[state]
            to = TURN[state]
            old = self.best.get(to)
            if old is None or cost + INSERT_COST < old[0] or (
                    cost + INSERT_COST == old[0] and self.tree.less(node, "I", old[1], "")):
                self.best[to] = (cost + INSERT_COST, self.tree.add(node, "I"))
                if old is not None:
                    self.tree.release(old[1])

    def _drop(self, state: int) -> None:
        self.tree.release(self.best.pop(state)[1])

    def _prune(self) -> None:
        """Drop survivors that another one beats whatever follows: after an assistant turn all can follow that
        can follow nothing (a system turn at the price of deleting it) or a system turn."""
        if ASSISTANT in self.best:
            cost, node = self.best[ASSISTANT]
            if START in self.best and self.best[START][0] > cost + DELETE_COST:
                self._drop(START)
            if SYSTEM in self.best and (cost < self.best[SYSTEM][0] or cost == self.best[SYSTEM][0]
                                        and self.tree.less(node, "", self.best[SYSTEM][1], "")):
                self._drop(SYSTEM)

    def read(self, initial: str, must_go: bool, truncated: bool) -> str:
        tree, found = self.tree, {}
        extra = TRUNCATED_COST if truncated else 0
        keep = KEEP.get(initial, {})

        def offer(to, cost, node, edit):
            old = found.get(to)
            if old is None or cost < old[0] or cost == old[0] and tree.less(node, edit, old[1], old[2]):
                found[to] = (cost, node, edit)

        for state, (cost, node) in self.best.items():
            offer(state, cost + DELETE_COST, node, "D")
            if not must_go:
                offer(TURN[state], cost + REROLE_COST + extra, node, "R")
                if state in keep:
                    offer(keep[state], cost + extra, node, "K")
        old, self.best = self.best, {s: (cost, tree.add(node, edit)) for s, (cost, node, edit) in found.items()}
        for _, node in old.values():
            tree.release(node)
        self._insert()
        self._prune()
        if tree.refs[tree.root] > 1:  # two branches leave the root: nothing new is final
            return ""
        nodes = [node for _, node in self.best.values()]
        at = nodes[0]
        for node in nodes[1:]:
            at = tree.common(at, node)
        return tree.advance(at)

    def end(self) -> tuple[int, str]:
        """(cost, last edits) of the best script that ends with nothing or an assistant turn."""
        ends = [self.best[s] for s in (START, ASSISTANT) if s in self.best]
        if len(ends) == 2:
            (c0, n0), (c1, n1) = ends
            ends = [ends[0] if c0 < c1 or c0 == c1 and self.tree.less(n0, "", n1, "") else ends[1]]
        cost, node = ends[0]
        return cost, self.tree.advance(node)
