"""Any number of character ranges per paragraph, restyled or replaced in one sweep.

A paragraph's ranges are gathered once and joined to it, so its runs are never repeated per range. An Arrow batch of
paragraphs is swept as a whole: all runs stand on one line of characters, every range end cuts the line, each range
paints the pieces between its ends in the order of ``seq``, and neighbours that look alike become one run again. The work
is a sort of runs and range ends, and one stroke for each range. Paragraphs without ranges pass through as they are.

Defined cases: offsets count code points of the paragraph as it was, a break is one of them; an end beyond the text is
the text's end and a negative start is 0; ranges with a null offset, an end before the start or a start beyond the text
do nothing, nor do those of unknown paragraphs; ranges without ``seq`` are ordered by start, end and what they do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.runs import FLAGS, NAMES
from leafmill.model import RUNS, STYLE

KEY = ("doc_id", "para_idx")
PROPS = (*FLAGS, *NAMES)
_STYLE = pa.struct([*((n, pa.bool_()) for n in FLAGS), *((n, pa.string()) for n in NAMES)])
_RUN = pa.struct([("is_break", pa.bool_()), ("text", pa.string()), ("style", _STYLE)])


def _lists(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All items and the row of each."""
    n = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
    return column.flatten(), np.repeat(np.arange(len(column)), n)


def _field(items: pa.Array, *path: int) -> pa.Array:
    return pc.struct_field(items, list(path))


def _picked(pool: list[pa.Array], at: np.ndarray) -> pa.Array:
    return pa.concat_arrays(pool).take(pa.array(at))


def swept(runs: pa.Array, ranges: pa.Array, replace: bool) -> pa.Array:
    """The runs of each row after its ranges (start, end, what), sorted by their order."""
    items, row = _lists(runs)
    brk = pc.fill_null(_field(items, 0), False).to_numpy(zero_copy_only=False)
    text = pc.fill_null(_field(items, 1), "")
    props = [_field(items, 2, i) for i in range(len(PROPS))]
    size = np.where(brk, 1, pc.utf8_length(text).to_numpy())
    base = np.concatenate([[0], np.cumsum(np.bincount(row, size, len(runs)).astype(np.int64))])  # of each row on the line
    first = np.searchsorted(row, np.arange(len(runs)))  # a row's first run, also an empty one
    held = np.flatnonzero(size)
    at = np.concatenate([[0], np.cumsum(size[held])])
    asked, where = _lists(ranges)
    total = np.diff(base)[where]
    lo, hi = (pc.fill_null(_field(asked, i), -1).to_numpy().astype(np.int64) for i in (0, 1))
    good = pc.and_(pc.is_valid(_field(asked, 0)), pc.is_valid(_field(asked, 1))).to_numpy(zero_copy_only=False)
    lo, hi = np.maximum(lo, 0), np.minimum(hi, total)
    good = np.flatnonzero(good & (lo <= total) & (lo <= hi))
    lo, hi, where = base[where[good]] + lo[good], base[where[good]] + hi[good], where[good]
    what = _field(asked, 2).take(pa.array(good))
    # pieces between all run starts and range ends
    cut = np.unique(np.concatenate([at[:-1], lo, hi]))
    cut = cut[cut < at[-1]]
    run = held[np.searchsorted(at[:-1], cut, side="right") - 1] if len(cut) else np.zeros(0, np.int64)
    begin = cut - at[np.searchsorted(at[:-1], cut, side="right") - 1]
    n = np.diff(np.append(cut, at[-1]))
    a, b = np.searchsorted(cut, lo), np.searchsorted(cut, hi)
    whole = n == size[run]
    some = np.flatnonzero(~whole)
    parts = [t[i : i + k] for t, i, k in zip(text.take(pa.array(run[some])).to_pylist(), begin[some].tolist(), n[some].tolist())]
    said = run.copy()
    said[some] = len(text) + np.arange(len(some))
    texts, looks = [text, pa.array(parts, pa.string())], [run] * len(PROPS)
    line_row, broken = row[run], brk[run]
    if replace:
        gone = np.zeros(len(cut) + 1, np.int64)
        np.add.at(gone, a, 1)
        np.add.at(gone, b, -1)
        stays = np.flatnonzero(np.cumsum(gone)[:-1] == 0)
        new = np.flatnonzero(pc.utf8_length(pc.fill_null(what, "")).to_numpy())
        inside = lo[new] > base[where[new]]
        before = np.where(inside, run[np.maximum(a[new] - 1, 0)] if len(run) else 0, np.where(np.bincount(row, minlength=len(runs))[where[new]] > 0, first[where[new]], -1))
        # what stays and what is new, by row and place; new texts come before the piece at their place
        order = np.lexsort((np.concatenate([np.zeros(len(stays), np.int64), new]), np.concatenate([np.ones(len(stays)), np.zeros(len(new))]), np.concatenate([stays, a[new]]), np.concatenate([line_row[stays], where[new]])))
        line_row = np.concatenate([line_row[stays], where[new]])[order]
        broken = np.concatenate([broken[stays], np.zeros(len(new), bool)])[order]
        said = np.concatenate([said[stays], len(text) + len(some) + new])[order]
        texts.append(what)
        looks = [np.concatenate([run[stays], before])[order]] * len(PROPS)
        props = [pa.concat_arrays([p, pa.nulls(1, p.type)]) for p in props]
        looks = [np.where(x < 0, len(items), x) for x in looks]
    else:
        looks = [run.copy() for _ in PROPS]
        over = [_field(what, i) for i in range(len(PROPS))]
        for k, o in enumerate(over):
            says = (pc.fill_null(o, False) if k < len(FLAGS) else pc.not_equal(pc.fill_null(o, ""), "")).to_numpy(zero_copy_only=False)
            for j in np.flatnonzero(says).tolist():
                looks[k][a[j] : b[j]] = len(items) + j
            looks[k][broken] = run[broken]
        props = [pa.concat_arrays([p, o]) for p, o in zip(props, over)]
    # neighbours that look alike
    shown = [p.take(pa.array(x)) for p, x in zip(props, looks)]
    fresh = np.ones(len(line_row), bool)
    fresh[1:] = (line_row[1:] != line_row[:-1]) | broken[1:] | broken[:-1]
    for k, p in enumerate(shown):
        code = pc.fill_null(p, False if k < len(FLAGS) else "").dictionary_encode().indices.to_numpy()
        fresh[1:] |= code[1:] != code[:-1]
    starts = np.flatnonzero(fresh)
    joined = pa.ListArray.from_arrays(pa.array(np.append(starts, len(line_row)), pa.int32()), _picked(texts, said))
    joined = pc.if_else(pa.array(broken[starts]), pa.scalar(None, pa.string()), pc.binary_join(joined, ""))
    style = pa.StructArray.from_arrays([p.take(pa.array(starts)) for p in shown], fields=list(_STYLE))
    out = pa.StructArray.from_arrays([pa.array(broken[starts]), joined, style], fields=list(_RUN))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(line_row[starts], np.arange(len(runs) + 1)), pa.int32()), out)


_ROWS = 512  # paragraphs that are swept at once; it bounds what a task holds


def _sweep(replace: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(at, _ROWS)
                asked = pc.and_(pc.is_valid(batch.column("runs")), pc.is_valid(batch.column("ranges")))
                for change, part in ((True, batch.filter(asked)), (False, batch.filter(pc.invert(asked)))):
                    if part.num_rows:
                        runs = swept(part.column("runs"), part.column("ranges"), replace) if change else part.column("runs").cast(pa.list_(_RUN))
                        yield pa.RecordBatch.from_arrays([*(part.column(c) for c in KEY), runs], [*KEY, "runs"])

    return run


def _changed(paragraphs: DataFrame, ranges: DataFrame, what: Column, replace: bool) -> DataFrame:
    kinds = dict(paragraphs.dtypes)
    seq = F.col("seq") if "seq" in ranges.columns else F.lit(None).cast("int")
    by = F.struct(seq.alias("seq"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), what.alias("what"))
    listed = ranges.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(by)), lambda x: F.struct(x["start"], x["end"], x["what"])).alias("ranges"))
    both = paragraphs.select(*KEY, F.col("runs").cast(RUNS).alias("runs")).join(listed, list(KEY), "left")
    return both.mapInArrow(_sweep(replace), f"doc_id {kinds['doc_id']}, para_idx {kinds['para_idx']}, runs {RUNS}")


def restyled(paragraphs: DataFrame, ranges: DataFrame) -> DataFrame:
    """``paragraphs`` (doc_id, para_idx, runs) with the styles of ``ranges`` (doc_id, para_idx, start, end, new_style, and
    seq where their order matters) laid over; where several say the same property, the last wins."""
    return _changed(paragraphs, ranges, F.col("new_style").cast(STYLE), False)


def respliced(paragraphs: DataFrame, ranges: DataFrame) -> DataFrame:
    """``paragraphs`` with the characters of all ``ranges`` (doc_id, para_idx, start, end, insert, seq) gone and their
    inserts in their starts' places, in the order of seq; an insert takes the style of the character before it, or of the
    first run at the paragraph's start."""
    return _changed(paragraphs, ranges, F.col("insert").cast("string"), True)
