"""Schema trees of Parquet files: paths, leaves, levels and nested shapes."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..errors import QueryError


@dataclass
class Node:
    """A field of the file schema and what is below it."""

    name: str
    path: tuple[str, ...]
    repetition: str
    physical: str | None
    annotation: str
    children: list[Node] = field(default_factory=list)

    def child(self, name: str) -> Node | None:
        return next((c for c in self.children if c.name == name), None)


def schema_tree(schema) -> Node:
    """The tree of a JVM message type (a ``Footer.schema``)."""

    def build(f, path: tuple[str, ...]) -> Node:
        note = f.getLogicalTypeAnnotation()
        kids = [] if f.isPrimitive() else [f.asGroupType().getType(i) for i in range(f.asGroupType().getFieldCount())]
        return Node(f.getName(), path, f.getRepetition().toString(), f.getPrimitiveTypeName().toString() if f.isPrimitive() else None, "" if note is None else note.toString(), [build(k, (*path, k.getName())) for k in kids])

    return Node(schema.getName(), (), "REQUIRED", None, "", [build(schema.getType(i), (schema.getType(i).getName(),)) for i in range(schema.getFieldCount())])


def schema_path(tree: Node, path: list[str] | tuple[str, ...]) -> list[Node]:
    """Nodes from the root to a field; an error where a name is missing."""
    out = [tree]
    for name in path:
        found = out[-1].child(name)
        if found is None:
            raise QueryError(f"parquet schema element not found: {'.'.join(path)}")
        out.append(found)
    return out


def physical_columns(tree: Node) -> list[str]:
    """Dotted paths of the leaves, in file order."""
    if tree.physical is not None:
        return [".".join(tree.path)]
    return [p for c in tree.children for p in physical_columns(c)]


def max_repetition_level(nodes: list[Node]) -> int:
    return sum(n.repetition == "REPEATED" for n in nodes[1:])


def max_definition_level(nodes: list[Node]) -> int:
    return sum(n.repetition != "REQUIRED" for n in nodes[1:])


def is_flat(nodes: list[Node]) -> bool:
    """A top-level field that is neither nested nor repeated."""
    return len(nodes) == 2 and nodes[1].repetition != "REPEATED" and nodes[1].physical is not None


def is_list_like(node: Node) -> bool:
    return node.annotation == "LIST" and len(node.children) == 1 and node.children[0].repetition == "REPEATED" and len(node.children[0].children) <= 1


def is_map_like(node: Node) -> bool:
    if node.annotation != "MAP" or len(node.children) != 1 or node.children[0].repetition != "REPEATED":
        return False
    pair = node.children[0].children
    return [c.name for c in pair] == ["key", "value"] and all(c.repetition != "REPEATED" for c in pair)


def schema_rows(tree: Node) -> list[tuple]:
    """(path, depth, repetition, physical type, annotation, definition level, repetition level) of every field."""
    out = []

    def walk(node: Node, above: list[Node]) -> None:
        for c in node.children:
            line = [*above, c]
            out.append((".".join(c.path), len(c.path), c.repetition, c.physical, c.annotation, max_definition_level(line), max_repetition_level(line)))
            walk(c, line)

    walk(tree, [tree])
    return out
