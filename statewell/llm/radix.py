"""A radix trie over byte strings: a path without a branch is one edge."""

from __future__ import annotations

from collections.abc import Iterator

#: What a node takes in memory besides its bytes, about.
NODE_BYTES = 300


class Node:
    """``value`` is None where no string ends; ``gone`` says that the subtree was given away."""

    __slots__ = ("edge", "gone", "kids", "value")

    def __init__(self, edge: bytes) -> None:
        self.edge, self.kids, self.value, self.gone = edge, _NO_KIDS, None, False

    def put(self, kid: Node) -> Node:
        if self.kids is _NO_KIDS:
            self.kids = {}
        self.kids[kid.edge[0]] = kid
        return kid


#: What all leaves share, never written to.
_NO_KIDS: dict[int, Node] = {}


def shared(edge: bytes, key: bytes, at: int) -> int:
    """How many bytes of ``edge`` stand in ``key`` from ``at`` on, found by comparing growing slices, then halves."""
    n = min(len(edge), len(key) - at)
    lo, step = 0, 16
    while lo < n:
        hi = min(lo + step, n)
        if edge[lo:hi] == key[at + lo : at + hi]:
            lo, step = hi, step * 4
            continue
        while hi - lo > 1:
            mid = (lo + hi) // 2
            if edge[lo:mid] == key[at + lo : at + mid]:
                lo = mid
            else:
                hi = mid
        return lo
    return n


class Trie:
    def __init__(self) -> None:
        self.root = Node(b"")
        #: Bytes in memory, about, and strings that end here.
        self.size, self.ends = 0, 0

    def end(self, key: bytes) -> Node | None:
        """The node where ``key`` ends, made if it is new; None below a subtree that is gone.

        Who sets the ``value`` of a new end counts it in ``ends``.
        """
        node, at, size = self.root, 0, len(key)
        while at < size and not node.gone:
            kid = node.kids.get(key[at])
            if kid is None:
                self.size += size - at + NODE_BYTES
                return node.put(Node(key[at:]))
            if key.startswith(kid.edge, at):
                node, at = kid, at + len(kid.edge)
                continue
            same = shared(kid.edge, key, at)  # the edge branches here
            fork = node.put(Node(kid.edge[:same]))
            kid.edge = kid.edge[same:]
            fork.put(kid)
            self.size += NODE_BYTES
            node, at = fork, at + same
        return None if node.gone else node

    def walk(self, node: Node | None = None, prefix: bytes = b"") -> Iterator[tuple[bytes, Node]]:
        """Strings that end at or below ``node`` (whose path is ``prefix``), in the order of their bytes."""
        stack = [(node or self.root, prefix)]
        while stack:
            node, prefix = stack.pop()
            if node.value is not None:
                yield prefix, node
            stack.extend((kid, prefix + kid.edge) for _, kid in sorted(node.kids.items(), reverse=True))

    def _weigh(self) -> dict[int, tuple[int, int]]:
        """Bytes and ends of each subtree, by the node's identity."""
        order, out = [self.root], {}
        for node in order:
            order.extend(node.kids.values())
        for node in reversed(order):
            below = [out[id(x)] for x in node.kids.values()]
            out[id(node)] = (len(node.edge) + NODE_BYTES + sum(x[0] for x in below), (node.value is not None) + sum(x[1] for x in below))
        return out

    def spill(self, keep: int) -> Iterator[tuple[bytes, Node]]:
        """Give heavy subtrees away until ``keep`` bytes are left or one string; yields what ended in them.

        A subtree that is heavier than ``keep`` is entered rather than given away whole.
        """
        weights, node, path = self._weigh(), self.root, b""
        while node is not None:
            inside = None
            for kid in sorted(node.kids.values(), key=lambda x: -weights[id(x)][0]):
                size, ends = weights[id(kid)]
                if self.size <= keep:
                    return
                if kid.gone or not ends:
                    continue
                if ends > 1 and (size > keep or ends == self.ends):
                    inside = inside or kid
                    continue
                if ends == self.ends:
                    return
                yield from self.walk(kid, path + kid.edge)
                self.size, self.ends = self.size - size + len(kid.edge) + NODE_BYTES, self.ends - ends
                kid.kids, kid.value, kid.gone = _NO_KIDS, None, True
            if inside is not None:
                path += inside.edge
            node = inside
