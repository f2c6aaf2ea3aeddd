"""Pairs of laboratories with opposite effects, cell by cell: what `facts.contradictions` runs in its tasks.

A cell holds the points of one block of a group's laboratories, or of two; it alone makes their pairs, so pairs are made distinct where they are found and never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: What a cell's points have, and what is found: a laboratory and those it is paired with.
POINTS = ["cell", "material_key", "property_key", "i", "j", "side", "up", "process", "band", "lab", "lo", "hi"]
FOUND = "material_key string, property_key string, lab string, others array<string>"
#: Candidate pairs held at once, places of a cell's bitmap looked through at once, and pairs in a batch of results.
CANDIDATES, PLACES, PAIRS = 1 << 20, 1 << 22, 1 << 18


def _whole_cells(batches, rows: int) -> Iterator[pa.Table]:
    """Tables of at least `rows` rows, if there are as many, that end where a cell ends. Rows come in order of cell."""
    held, n, enough = [], 0, rows
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < enough:
            continue
        table = pa.Table.from_batches(held)
        cells = table["cell"].to_numpy()
        cut = int(np.searchsorted(cells, cells[-1]))
        if cut:
            yield table.slice(0, cut)
        held, n = table.slice(cut).to_batches(), n - cut
        enough = max(rows, 2 * n)
    if n:
        yield pa.Table.from_batches(held)


def _coded(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """The code of each row's text, and the texts in order of code, which is their own order."""
    column = column.combine_chunks()
    column = (column.chunk(0) if isinstance(column, pa.ChunkedArray) else column).dictionary_encode()
    order = pc.array_sort_indices(column.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[column.indices.to_numpy()], column.dictionary.take(pa.array(order))


def _sorted_once(codes: np.ndarray) -> np.ndarray:
    """The distinct codes in order; np.unique would hash them, which takes some ten times as long."""
    codes = np.sort(codes)
    return codes[np.concatenate([[True], codes[1:] != codes[:-1]])] if len(codes) else codes


def _dense(*keys: np.ndarray) -> np.ndarray:
    """One number for each row's keys, from 0 without gaps, in their order."""
    out = np.zeros(len(keys[0]), np.int64)
    for key in keys:
        out = np.unique(out * (int(key.max()) + 1) + key, return_inverse=True)[1].astype(np.int64)
    return out


def _bands(band: np.ndarray) -> np.ndarray:
    """Small numbers from 1 for bands: they differ by one where the bands do, by more where these do."""
    one, at = np.unique(band, return_inverse=True)
    return np.cumsum(np.concatenate([[1], np.where(one[1:] == one[:-1] + 1, 1, 3)]))[at]


def _spans(down: np.ndarray, keys: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The downs in order of their keys, and from where to where in these the keys lie from `start` to before `end`."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    return down[order], np.searchsorted(keys, start), np.searchsorted(keys, end)


def _reached(values: np.ndarray, ends: np.ndarray, holds) -> np.ndarray:
    """For each of `ends` how many of the values, which ascend, come before the first at which `holds` (value, end) is false; by the comparison itself, whatever rounding does."""
    last = len(values) - 1
    at = np.searchsorted(values, ends, "right")
    while True:
        more = (at <= last) & holds(values[np.minimum(at, last)])
        less = ~more & (at > 0) & ~holds(values[np.maximum(at - 1, 0)])
        if not (more | less).any():
            return at
        at = at + more - less


def _near_spans(up, down, up_class, down_class, number, low, high, tolerance: float) -> Iterator[tuple]:
    """Spans of the downs within the tolerance: of the same band, where all are near but for rounding (then the last item is true: to be compared), of the next and of the one before, from their near ends on."""
    wide = int(number.max()) + 3
    up_band, down_band = up_class[up] * wide + number[up], down_class[down] * wide + number[down]
    lowest, highest = np.full(wide, np.inf), np.full(wide, -np.inf)
    for rows in (up, down):
        np.minimum.at(lowest, number[rows], low[rows])
        np.maximum.at(highest, number[rows], high[rows])
    used = np.unique(number[up])
    yield up, *_spans(down, down_band, up_band, up_band + 1), not bool((highest[used] - lowest[used] <= tolerance).all())
    values = np.unique(np.concatenate([low[down], high[down]]))
    many = len(values) + 1
    from_, to = high[up], low[up]
    yield up, *_spans(down, down_band * many + np.searchsorted(values, low[down]), (up_band + 1) * many, (up_band + 1) * many + _reached(values, from_ + tolerance, lambda v: v - from_ <= tolerance)), False
    yield up, *_spans(down, down_band * many + np.searchsorted(values, high[down]), (up_band - 1) * many + _reached(values, to - tolerance, lambda v: to - v > tolerance), up_band * many), False


def _expanded(start: np.ndarray, n: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Spans of n from start on, about CANDIDATES at a time: which they are, how often each is repeated, and the positions in them."""
    total = np.cumsum(n)
    at = 0
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + CANDIDATES, "right")))
        part = n[at:to]
        first = np.cumsum(part) - part
        yield slice(at, to), part, np.arange(int(part.sum()), dtype=np.int32) + np.repeat((start[at:to] - first).astype(np.int32), part)
        at = to


def _pairs_of(table: pa.Table, tolerance: float) -> Iterator[pa.RecordBatch]:
    (material, materials), (property_, properties), (process, processes), (lab, names) = (_coded(table[c]) for c in ("material_key", "property_key", "process", "lab"))
    plain = lambda c: table[c].to_numpy()
    i, j, side, is_up = plain("i"), plain("j"), plain("side").astype(np.int64), plain("up").astype(bool)
    low, high = plain("lo").astype(float), plain("hi").astype(float)  # nan where unknown
    known = pc.is_valid(table["band"]).to_numpy().astype(bool)
    band = plain("band").astype(float)
    compared = known & ~np.isnan(band)
    number = np.zeros(len(band), np.int64)
    if compared.any():
        number[compared] = _bands(band[compared])

    # A row's place is its laboratory's in its cell, those of side 0 first; a pair's place is in a rectangle of the two sides, or of side 0 with itself.
    cell = _dense(material, property_, i, j)
    row_of_cell = np.unique(cell, return_index=True)[1]
    distinct, at = np.unique((cell * 2 + side) * len(names) + lab, return_inverse=True)
    lab_at = (distinct % len(names)).astype(np.int32)
    of_side = np.bincount(distinct // len(names), minlength=2 * len(row_of_cell)).reshape(-1, 2)
    first = np.cumsum(of_side.sum(1)) - of_side.sum(1)
    crossed = (i != j)[row_of_cell]
    skipped = np.where(crossed, of_side[:, 0], 0)
    stride = np.where(crossed, of_side[:, 1], of_side[:, 0])
    size = of_side[:, 0] * stride
    base, places = np.cumsum(size) - size, int(size.sum())
    number_type = np.int32 if places < 2**31 else np.int64
    place, shift, steps = ((x).astype(number_type) for x in (at - first[cell], (base - skipped)[cell], stride[cell]))

    named = np.asarray(pc.not_equal(processes, ""))[process]
    meets = np.where(crossed[cell], 1 - side, side)
    up_side, down_side = cell * 2 + side, cell * 2 + meets
    up_class, down_class = np.unique(np.stack([up_side, down_side]) * len(processes) + process, return_inverse=True)[1].reshape(2, -1)
    spans = []
    # An empty process goes with any, and so does an unknown temperature.
    for of_up, of_down, up_key, down_key in ((named, named, up_class, down_class), (~named, True, up_side, down_side), (named, ~named, up_side, down_side)):
        for up_known, down_known in ((compared, compared), (~known, True), (known, ~known)):
            up, down = np.flatnonzero(is_up & of_up & up_known), np.flatnonzero(~is_up & of_down & down_known)
            if not len(up) or not len(down):
                continue
            if up_known is compared:
                spans.extend(_near_spans(up, down, up_key, down_key, number, low, high, tolerance))
            else:
                spans.append((up, *_spans(down, down_key[down], up_key[up], up_key[up] + 1), False))
    candidates = sum(int((end - start).sum()) for _, _, start, end, _ in spans)
    met = np.zeros(places, bool) if candidates * 8 >= places else None
    few = []
    for up, down, start, end, unsure in spans:
        some = end > start
        up, start, n = up[some], start[some], (end - start)[some]
        place_up, shift_up, steps_up, place_down = place[up], shift[up], steps[up], place[down]
        for these, often, at in _expanded(start, n):
            a, b = np.repeat(place_up[these], often), place_down[at]
            codes = np.minimum(a, b)
            codes *= np.repeat(steps_up[these], often)
            codes += np.maximum(a, b)
            codes += np.repeat(shift_up[these], often)
            if unsure:
                u, d = np.repeat(up[these], often), down[at]
                codes = codes[np.maximum(low[d] - high[u], low[u] - high[d]) <= tolerance]
            if met is None:
                few.append(_sorted_once(codes))
            else:
                met[codes] = True
    if met is None:
        found = iter([_sorted_once(np.concatenate(few))] if few else [])
    else:
        found = ((np.flatnonzero(met[s : s + PLACES]) + s).astype(number_type) for s in range(0, places, PLACES))
    # The rows of all rectangles one after the other: where each begins, its cell, its laboratory and the first of the others.
    of_row = np.repeat(np.arange(len(size)), of_side[:, 0])
    in_cell = np.arange(len(of_row)) - np.repeat(np.cumsum(of_side[:, 0]) - of_side[:, 0], of_side[:, 0])
    begin, one, other = base[of_row] + in_cell * stride[of_row], lab_at[first[of_row] + in_cell], (first + skipped)[of_row]
    for all_ in found:
        for s in range(0, len(all_), PAIRS):
            codes = all_[s : s + PAIRS]
            to = np.searchsorted(codes, begin)
            often = np.append(to[1:], len(codes)) - to
            rows = np.flatnonzero(often)
            often = often[rows]
            paired = lab_at[codes + np.repeat((other - begin)[rows], often)]
            others = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(often)), pa.int32()), names.take(pa.array(paired)))
            at = row_of_cell[of_row[rows]]
            yield pa.RecordBatch.from_arrays([materials.take(pa.array(material[at])), properties.take(pa.array(property_[at])), names.take(pa.array(one[rows])), others], ["material_key", "property_key", "lab", "others"])


def pairs(tolerance: float, rows: int):
    """For mapInArrow: rows of POINTS, in order of cell -> FOUND, each pair of laboratories once for its cell."""

    def run(batches):
        for table in _whole_cells(batches, rows):
            yield from _pairs_of(table, tolerance)

    return run
