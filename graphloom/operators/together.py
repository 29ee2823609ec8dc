"""Counts of all pairs of numbers that stand together in sets, by cells of two ranges of numbers.

A cell holds what the sets have in its two ranges, two bytes or so a number, and
counts a number of the first range against all of the second at once, in an
array.  So a pair costs an addition, and no pair travels before it is counted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

#: Gaps of two bytes; the largest stands for one that goes on.
FAR = (1 << 16) - 1
#: Rows of one Arrow batch of results.
ROWS = 1 << 17
#: Pairs that are sorted at once, of numbers with too few for an array of counts.
SORTED = 1 << 18
#: An array of counts is worth its passes from one pair in so many of its entries.
SPARSE = 8
#: Slices of so many numbers are copied each, shorter ones are gathered number by number.
LONG = 32
#: Numbers of sets that are dealt to the cells at once.
DEALT = 1 << 20


def pack(keys) -> bytes:
    """Ascending ``keys`` as gaps of two bytes."""
    import numpy as np

    gaps = np.diff(keys, prepend=0)
    more = gaps // FAR
    out = np.full(len(keys) + int(more.sum()), FAR, "<u2")
    out[np.cumsum(more + 1) - 1] = gaps - more * FAR
    return out.tobytes()


def unpack(data: bytes):
    import numpy as np

    gaps = np.frombuffer(data, "<u2")
    return np.cumsum(gaps, dtype="i8")[gaps != FAR]


def gathered(batches: Iterator) -> Iterator:
    """(set, number) rows to (set, numbers packed), a row for each set and batch."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        if batch.num_rows:
            named = batch.column(0).dictionary_encode()
            of, ids = named.indices.to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            order = np.lexsort((ids, of))
            of, ids = of[order], ids[order].astype("i8")
            cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            rows = [pack(ids[p:q]) for p, q in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([named.dictionary.take(pa.array(of[cuts[:-1]])), pa.array(rows, pa.binary())], names=["doc_id", "ids"])


def cells(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i, k)]


def width(bounds: list[int]) -> int:
    """Bits of a number in any range."""
    return max([1, *(b - a for a, b in zip(bounds, bounds[1:]))]).bit_length()


def dealt(bounds: list[int]) -> Callable[[Iterator], Iterator]:
    """Packed sets, the rows of one set after each other, to rows (cell, side 0, x, y): numbers in the cell's ranges of the sets that have both.

    Range i starts at ``bounds[i]`` and ends before the next bound.
    """
    k, bits = len(bounds) - 1, width(bounds)

    def rows(parts: list[tuple[int, bytes]]):
        import numpy as np
        import pyarrow as pa

        each = [unpack(data) for _, data in parts]
        ids, of = np.concatenate(each), np.repeat([at for at, _ in parts], [len(x) for x in each]) - parts[0][0]
        order = np.lexsort((ids, of))
        ids, of = ids[order], of[order]
        new = np.concatenate([[True], (np.diff(ids) != 0) | (np.diff(of) != 0)])
        ids, of = ids[new], of[new]
        into = np.searchsorted(bounds, ids, "right") - 1
        keys, has = [], np.zeros((k, int(of[-1]) + 1), bool)
        for i in range(k):
            at = into == i
            keys.append((of[at] << bits) | (ids[at] - bounds[i]))
            has[i, of[at]] = True
        found = []
        for c, (i, j) in enumerate(cells(k)):
            both = has[i] & has[j]
            if both.any():
                x, y = (pack(keys[s][both[keys[s] >> bits]]) if s == i or i != j else b"" for s in (i, j))
                found.append((c, x, y if i != j else b""))
        where, xs, ys = zip(*found)
        return pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array([0] * len(xs), pa.int32()), pa.array(xs, pa.binary()), pa.array(ys, pa.binary())], names=["cell", "side", "x", "y"])

    def run(batches: Iterator) -> Iterator:
        parts, at, last, held = [], -1, object(), 0
        for batch in batches:
            for doc, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if doc != last:
                    if held >= DEALT:
                        yield rows(parts)
                        parts, held = [], 0
                    at, last = at + 1, doc
                parts.append((at, data))
                held += len(data) // 2
        if parts:
            yield rows(parts)

    return run


def taken(numbers, fro, to):
    """``numbers[fro:to]`` of all the slices, one after the other."""
    import numpy as np

    many = int((to - fro).sum())
    if many >= LONG * len(fro):
        return np.concatenate([numbers[s:e] for s, e in zip(fro.tolist(), to.tolist())])
    at = np.repeat(to - np.cumsum(to - fro), to - fro)
    at += np.arange(many)
    return numbers[at]


def counts(x: list[bytes], y: list[bytes], bits: int, least: int) -> Iterator:
    """(a, b, n) arrays: numbers of the first and the second range that ``least`` sets or more have in common; a < b and one range, if ``y`` is empty.

    Empties both lists: what they hold is as large as what is made of it.
    """
    import numpy as np

    mask = (1 << bits) - 1

    def read(blobs: list[bytes], kind: str):
        """Numbers of all blobs, and how many each set has."""
        numbers, sizes, at = np.empty(sum(map(len, blobs)) // 2, kind), [], 0
        for _ in range(len(blobs)):
            keys = unpack(blobs.pop())
            numbers[at : at + len(keys)] = keys & mask
            at += len(keys)
            sizes.append(np.bincount(keys >> bits))
        return numbers[:at], np.concatenate(sizes)

    same = not y
    xi, sizes = read(x, "i4")
    order = np.argsort(xi, kind="stable")
    docs = np.repeat(np.arange(len(sizes), dtype="i4"), sizes)[order]  # both sides have the same sets in one order
    df = np.bincount(xi)
    if same:
        yi = xi.astype("i8")
        del xi
    else:
        del xi, order
        yi, sizes = read(y, "i8")
    ends = np.cumsum(sizes)
    starts = ends - sizes
    slices = lambda at: (order[at] + 1 if same else starts[docs[at]], ends[docs[at]])
    wide, after = int(yi.max()) + 1, np.cumsum(df)
    first = after - df
    seen = np.flatnonzero(df)
    lengths = (ends[docs] - order - 1 if same else sizes[docs]).astype("i4")
    pairs = np.zeros(len(df), "i8")
    pairs[seen] = np.add.reduceat(lengths, first[seen], dtype="i8")
    del lengths
    often = (df >= least) & (pairs >= least)
    dense = pairs * SPARSE >= wide

    for t in np.flatnonzero(often & dense).tolist():
        n = np.bincount(taken(yi, *slices(slice(first[t], after[t]))))
        b = np.flatnonzero(n >= least)
        if len(b):
            yield np.full(len(b), t), b, n[b]

    few = np.flatnonzero(often & ~dense)
    cut = np.flatnonzero(np.diff(np.cumsum(pairs[few]) // SORTED)) + 1
    for some in np.split(few, cut) if len(few) else []:
        at = np.repeat(after[some] - np.cumsum(df[some]), df[some]) + np.arange(df[some].sum())
        kind = "i4" if len(some) * wide < 1 << 31 else "i8"
        keys = taken(yi, *slices(at)).astype(kind)
        keys += np.repeat((np.arange(len(some)) * wide).astype(kind), pairs[some])
        keys.sort()
        met = keys[least - 1 :] == keys[: len(keys) - least + 1]  # at each of a key's entries but the last least - 1
        new = np.flatnonzero(met & np.concatenate([[True], keys[1 : len(met)] != keys[: len(met) - 1]]))
        n = np.diff(np.append(np.cumsum(met)[new] - 1, met.sum())) + least - 1
        key = keys[new].astype("i8")
        yield some[key // wide], key % wide, n


def counted(bounds: list[int], least: int) -> Callable[[Iterator], Iterator]:
    """Rows of ``dealt`` and those of sides 1 and 2, the names in a cell's first and second range, to (a, b, n); all rows of a cell are in one task."""
    of, bits = cells(len(bounds) - 1), width(bounds)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        found: dict[int, tuple[list, list, list]] = {}
        for batch in batches:
            for cell, side, x, y in zip(*(c.to_pylist() for c in batch.columns)):
                xs, ys, names = found.setdefault(cell, ([], [], [None, None]))
                if side:
                    names[side - 1] = x
                else:
                    xs.append(x)
                    if y:
                        ys.append(y)
            del batch
        for cell in sorted(found):
            xs, ys, names = found.pop(cell)
            if not xs:
                continue
            first, second = (pa.array(n.decode().split("\n")) for n in names)

            def rows(held: list):
                a, b, n = (np.concatenate(z) for z in zip(*held))
                for at in range(0, len(n), ROWS):
                    s = slice(at, at + ROWS)
                    yield pa.RecordBatch.from_arrays([first.take(pa.array(a[s])), second.take(pa.array(b[s])), pa.array(n[s], pa.int64())], names=["a", "b", "n"])

            held, many = [], 0
            for part in counts(xs, ys, bits, least):
                held.append(part)
                many += len(part[2])
                if many >= ROWS:
                    yield from rows(held)
                    held, many = [], 0
            if many:
                yield from rows(held)

    return run
