"""A Newick parser without recursion, whose output is the rows of an adjacency table."""

from __future__ import annotations

import re
from typing import NamedTuple

_COMMENT = re.compile(r"\{[^}]*\}|\[[^\]]*\]")
_TOKEN = re.compile(r"\s*('(?:[^']|'')*'|[(),;]|:[^(),;]*|[^(),;:]+)")

NODE_SCHEMA = "tree_id string, node_id int, parent_id int, child_idx int, name string, branch_length double, is_leaf boolean, leaf_idx int, depth int, root_dist double"


class Node(NamedTuple):
    """Of constant size whatever the depth. ``root_dist`` leaves out the root's own length."""

    node_id: int
    parent_id: int | None
    child_idx: int
    name: str | None
    branch_length: float | None
    is_leaf: bool
    leaf_idx: int | None
    depth: int
    root_dist: float


def parse_newick(text: str) -> list[Node]:
    """Nodes in preorder. Annotations in brackets are dropped; a missing length is None and counts as 0; a bad one raises ValueError."""
    text = _COMMENT.sub("", text).strip()
    names: list[str | None] = [None]
    lengths: list[float | None] = [None]
    parents: list[int | None] = [None]
    children: list[list[int]] = [[]]
    at = 0

    def child(of: int) -> int:
        names.append(None)
        lengths.append(None)
        parents.append(of)
        children.append([])
        children[of].append(len(names) - 1)
        return len(names) - 1

    for token in _TOKEN.findall(text):
        if token == "(":
            at = child(at)
        elif token == ",":
            if parents[at] is None:
                raise ValueError("a comma outside brackets")
            at = child(parents[at])
        elif token == ")":
            if parents[at] is None:
                raise ValueError("a closing bracket too many")
            at = parents[at]
        elif token == ";":
            continue
        elif token[0] == ":":
            lengths[at] = float(token[1:])
        else:
            names[at] = token.strip().strip("'\"").strip() or None
    if at != 0:
        raise ValueError("a closing bracket is missing")
    out: list[Node] = []
    place: dict[int, int] = {}
    index = {child: i for kids in children for i, child in enumerate(kids)} | {0: 0}
    stack, leaves = [0], 0
    while stack:
        n = stack.pop()
        up = parents[n]
        above = out[place[up]] if up is not None else None
        dist = above.root_dist + (lengths[n] or 0.0) if above else 0.0
        me = len(out)
        place[n] = me
        leaf = not children[n]
        out.append(Node(me, above.node_id if above else None, index[n], names[n], lengths[n], leaf, leaves if leaf else None, above.depth + 1 if above else 0, dist))
        leaves += leaf
        stack.extend(reversed(children[n]))
    return out


def to_newick(nodes: list[Node]) -> str:
    """The tree as text, names and lengths included."""
    kids: dict[int | None, list[Node]] = {}
    for n in nodes:
        kids.setdefault(n.parent_id, []).append(n)
    parts: list[str] = []
    stack: list[tuple[str, Node | None]] = [("open", kids[None][0])] if nodes else []
    while stack:
        what, n = stack.pop()
        if n is None:
            parts.append(what)
        elif what == "open" and n.node_id in kids:
            parts.append("(")
            stack.append(("end", n))
            own = kids[n.node_id]
            for i, k in reversed(list(enumerate(own))):
                stack.append(("open", k))
                if i:
                    stack.append((",", None))
        else:
            parts.append((")" if what == "end" else "") + (n.name or "") + (f":{n.branch_length!r}" if n.branch_length is not None else ""))
    return "".join(parts) + ";"
