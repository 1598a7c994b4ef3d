"""Fitted decision trees as plain values and as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def nested(node) -> tuple | float:
    """A fitted node as (feature, threshold, low, high), a leaf as its label."""
    if node.subtreeDepth() == 0:
        return float(node.prediction())
    split = node.split()
    low, high = nested(node.leftChild()), nested(node.rightChild())
    if low == high:
        return low
    return (int(split.featureIndex()), float(split.threshold()), low, high)


def votes(forest: list[tuple | float], values: Column) -> Column:
    """Mean of the trees' labels for an array of feature values.

    The nodes of all trees are four arrays, walked down as far as the deepest tree goes; a leaf stays where it is. Unlike
    an expression for every node this does not grow with the forest beyond what can be compiled.
    """
    nodes: list[list] = []

    def add(node: tuple | float) -> int:
        number = len(nodes)
        if not isinstance(node, tuple):
            nodes.append([0, float("inf"), number, number, node])
            return number
        nodes.append([node[0], node[1], 0, 0, 0.0])
        nodes[number][2:4] = add(node[2]), add(node[3])
        return number

    def depth(node: tuple | float) -> int:
        return 1 + max(depth(node[2]), depth(node[3])) if isinstance(node, tuple) else 0

    listed = lambda items, kind: F.split(F.lit(" ".join(map(str, items))), " ").cast(f"array<{kind}>")
    roots = listed([add(tree) for tree in forest], "int")
    feature, threshold, low, high, label = (
        listed(["Infinity" if x == float("inf") else repr(x) for x in column], kind)
        for column, kind in zip(zip(*nodes), ("int", "double", "int", "int", "double"))
    )
    steps = F.sequence(F.lit(1), F.lit(max(1, *map(depth, forest))))
    down = lambda n: F.when(F.get(values, F.get(feature, n)) <= F.get(threshold, n), F.get(low, n)).otherwise(F.get(high, n))
    leaf = lambda root: F.aggregate(steps, root, lambda n, _: down(n))
    return F.aggregate(roots, F.lit(0.0), lambda a, root: a + F.get(label, leaf(root))) / len(forest)
