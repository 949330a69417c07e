"""Exact links between the rows of two blocks of a group, as counts and a spanning forest instead of pairs."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

#: links is the number of rows (with their multiplicity) linked to a; (a, b) is an edge of the forest; one of the two is null.
LINK_ROWS = "a binary, links long, b binary"


def link_rows(rows: list[tuple]) -> pa.RecordBatch:
    a, links, b = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(links, pa.int64()), pa.array(b, pa.binary())], ["a", "links", "b"])


def forest_steps(linked: np.ndarray, same: bool) -> list[tuple[int, int]]:
    """(row, column) links that span every group of linked rows and columns, breadth first; same: rows and columns are the same."""
    seen_rows, seen_columns, out = ~linked.any(1), np.zeros(linked.shape[1], dtype=bool), []
    if same:
        seen_columns = seen_rows
    for k in range(len(linked)):
        if seen_rows[k]:
            continue
        seen_rows[k], front = True, [(0, k)]
        while front:
            side, x = front.pop()
            near, seen = (linked[x], seen_columns) if side == 0 else (linked[:, x], seen_rows)
            for y in np.flatnonzero(near & ~seen).tolist():
                seen[y] = True
                out.append((x, y) if side == 0 else (y, x))
                front.append((0 if same else 1 - side, y))
    return out


def compare_blocks(group: tuple, rows: list, links_of: Callable[[list, list], np.ndarray], tile: int = 512) -> list[tuple]:
    """LINK_ROWS of the links between blocks group[1] and group[2] of a group, or inside a block where they are one.

    rows are (block, key, multiplicity, ...); links_of(left, right) is the matrix of links of two lists of rows.  The blocks are
    compared tile by tile, so memory is bounded whatever a block holds."""
    same = group[1] == group[2]
    left = [r for r in rows if r[0] == group[1]]
    right = left if same else [r for r in rows if r[0] == group[2]]
    all_rows = left if same else left + right
    counts, root = np.zeros(len(all_rows), dtype=np.int64), list(range(len(all_rows)))
    weight, shift = np.array([r[2] for r in all_rows], dtype=np.int64), 0 if same else len(left)
    out: list[tuple] = []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(0, len(left), tile):
        for j in range(i if same else 0, len(right), tile):
            linked = links_of(left[i : i + tile], right[j : j + tile])
            inner = same and i == j
            if inner:
                np.fill_diagonal(linked, False)
            if not linked.any():
                continue
            a, b = slice(i, i + linked.shape[0]), slice(shift + j, shift + j + linked.shape[1])
            counts[a] += linked @ weight[b]
            if not inner:
                counts[b] += weight[a] @ linked
            for x, y in forest_steps(linked, inner):
                x, y = i + x, shift + j + y
                p, q = find(x), find(y)
                if p != q:
                    root[max(p, q)] = min(p, q)
                    out.append((all_rows[x][1], None, all_rows[y][1]))
    return out + [(all_rows[k][1], int(n), None) for k, n in enumerate(counts) if n]
