"""Union-find over (owner, member, key) rows inside a task (pickled into the workers)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Rows that a task holds before it hands out what it has connected so far.
HELD = 500_000


def _root(up: dict, x: tuple) -> tuple:
    top = x
    while up[top] != top:
        top = up[top]
    while up[x] != top:
        up[x], x = top, up[x]
    return top


def _join(up: dict, a: tuple, b: tuple) -> None:
    """The smaller member becomes the root of both groups."""
    a, b = _root(up, a), _root(up, b)
    if a[1] < b[1]:
        up[b] = a
    else:
        up[a] = b


def contract_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(owner, member, key) rows to (owner, member, root, -) for each member and (owner, -, root, key) for each key of a
    group, where root is the smallest member connected so far."""
    up: dict[tuple, tuple] = {}
    first: dict[tuple, tuple] = {}
    seen, schema = 0, None

    def out() -> pa.RecordBatch:
        rows = [(o, m, _root(up, (o, m))[1], None) for o, m in up]
        rows += [(o, None, _root(up, x)[1], key) for (o, key), x in first.items()]
        kinds = [schema.field(0).type, schema.field(1).type, schema.field(1).type, pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["company_id", "pos", "root", "key"])

    for b in batches:
        schema = b.schema
        for owner, member, key in zip(*(c.to_pylist() for c in b.columns)):
            x = (owner, member)
            up.setdefault(x, x)
            known = first.setdefault((owner, key), x)
            if known != x:
                _join(up, known, x)
        seen += b.num_rows
        if seen >= HELD:
            yield out()
            up, first, seen = {}, {}, 0
    if up:
        yield out()


def contract_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(owner, part, u, v) rows sorted by owner and part to (owner, u, v): a star for each group, v its smallest member."""
    now, up, schema = None, {}, None

    def out() -> pa.RecordBatch:
        rows = [(o, m, _root(up, (o, m))[1]) for o, m in up]
        rows = [r for r in rows if r[1] != r[2]]
        kinds = [schema.field(0).type, schema.field(2).type, schema.field(2).type]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 3, kinds)], names=["company_id", "u", "v"])

    for b in batches:
        schema = b.schema
        for owner, part, u, v in zip(*(c.to_pylist() for c in b.columns)):
            if now != (owner, part):
                if len(up) >= HELD // 10:
                    yield out()
                    up = {}
                now = (owner, part)
            a, c = (owner, u), (owner, v)
            up.setdefault(a, a)
            up.setdefault(c, c)
            _join(up, a, c)
    if up:
        yield out()
