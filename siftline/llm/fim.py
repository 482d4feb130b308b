"""Fill-in-the-middle: documents cut at two token ranks, their parts reordered behind marks.

The units of a text are runs of ASCII letters and single other code points. Both cuts are ranks among the units, and the
text has to be cut at code points, so every slice of texts gets an indexable skip list: the ground lane holds all units, every
express lane above keeps about one node in eight of the lane below (and the first of each text). A node carries how many units
and how many code points lie between it and the next node of its lane. A rank is reached from the top lane down,
by taking every step whose units still fit and adding up its code points.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.tokens import mix, slices, text_bytes

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
RESULT = ("n", "form", "prefix_chars", "middle_chars", "output")

_LETTER = np.zeros(256, bool)
_LETTER[ord("A") : ord("Z") + 1] = _LETTER[ord("a") : ord("z") + 1] = True


@dataclass(frozen=True)
class Fim:
    """``rate`` and ``spm_rate`` are percentages: of documents that are cut, and of those, in suffix-first order."""

    seed: str = "1"
    rate: int = 90
    spm_rate: int = 20


def units(buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of every unit, and where each text's units begin (with one end entry)."""
    letter = _LETTER[buffer]
    point = (buffer & 0xC0) != 0x80
    joined = np.zeros(len(buffer), bool)
    joined[1:] = letter[1:] & letter[:-1]
    joined[offsets[:-1][np.diff(offsets) > 0]] = False  # a text begins
    starts = np.flatnonzero(point & ~joined)
    points = np.add.reduceat(point.astype(np.int64), starts) if len(starts) else np.zeros(0, np.int64)
    return points, np.searchsorted(starts, offsets)


@dataclass
class _Lane:
    units: np.ndarray  # from each node to the next one of its text
    points: np.ndarray
    below: np.ndarray  # each node's place in the lane below
    first: np.ndarray  # each text's first node


class SkipList:
    """Lanes over the units of several texts; a text without units has no node."""

    def __init__(self, points: np.ndarray, first: np.ndarray):
        self.n = np.diff(first)
        self.lanes = [_Lane(np.ones(len(points), np.int64), points, np.arange(len(points)), first[:-1])]
        while len(points):
            lane, level = self.lanes[-1], len(self.lanes)
            tall = mix(np.arange(len(lane.units), dtype=np.uint64) + np.uint64(level << 40)) & np.uint64(7) == 0
            heads = lane.first[self.n > 0]
            tall[heads] = True
            nodes = np.flatnonzero(tall)
            self.lanes.append(
                _Lane(
                    np.add.reduceat(lane.units, nodes),
                    np.add.reduceat(lane.points, nodes),
                    nodes,
                    np.searchsorted(nodes, lane.first),
                )
            )
            if len(nodes) == len(heads):
                break

    def points_before(self, texts: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        """Code points of the first ``ranks[i]`` units of text ``texts[i]``; a rank is at most the text's units."""
        passed, left = np.zeros(len(ranks), np.int64), ranks.astype(np.int64)
        at = self.lanes[-1].first[texts]
        for lane in reversed(self.lanes):
            going = np.flatnonzero(left > 0)  # where units are left, there is a node
            while len(going):
                going = going[lane.units[at[going]] <= left[going]]
                here = at[going]
                passed[going] += lane.points[here]
                left[going] -= lane.units[here]
                at[going] = here + 1
                going = going[left[going] > 0]
            down = np.flatnonzero(left > 0)
            at[down] = lane.below[at[down]]
        return passed


def _transform(params: Fim):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            points, first = units(*text_bytes(batch.column("text")))
            lanes = SkipList(points, first)
            h1, h2, h3, h4 = (batch.column(f"h{i}").to_numpy() for i in range(1, 5))
            one, two = h1 % (lanes.n + 1), h2 % (lanes.n + 1)
            cut = (lanes.n > 0) & (h3 % 100 < params.rate)
            cut &= np.fromiter((not any(m in t for m in (PREFIX, SUFFIX, MIDDLE)) for t in texts), bool, len(texts))
            rows = np.flatnonzero(cut)
            begin = np.zeros(len(texts), np.int64)
            end = begin.copy()
            begin[rows] = lanes.points_before(rows, np.minimum(one, two)[rows])
            end[rows] = lanes.points_before(rows, np.maximum(one, two)[rows])
            form = np.where(cut, np.where(h4 % 100 < params.spm_rate, SPM, PSM), PLAIN)
            output = list(texts)
            for i in rows.tolist():
                text, a, b = texts[i], begin[i], end[i]
                if form[i] == PSM:
                    output[i] = f"{PREFIX}{text[:a]}{SUFFIX}{text[b:]}{MIDDLE}{text[a:b]}"
                else:
                    output[i] = f"{SUFFIX}{text[b:]}{PREFIX}{text[:a]}{MIDDLE}{text[a:b]}"
            kept = [x for x in batch.schema.names if x[0] == "c"]
            yield pa.RecordBatch.from_arrays(
                [
                    *map(batch.column, kept),
                    pa.array(lanes.n, pa.int64()),
                    pa.array(form.tolist(), pa.string()),
                    pa.array(begin, pa.int64(), mask=~cut),
                    pa.array(end - begin, pa.int64(), mask=~cut),
                    pa.array(output, pa.string()),
                ],
                [*kept, *RESULT],
            )

    return run


def transform(docs: DataFrame, params: Fim = Fim(), keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of ``docs(doc_id, text)``, and ``n, form, prefix_chars, middle_chars, output``.

    One stage without a shuffle; cuts and forms depend on ``doc_id`` and the text's number of units alone, so repeated rows
    give equal rows. A null text is empty, and empty texts are plain. A null doc_id counts as empty text in the hash. Bytes that
    are not UTF-8 are replaced first. A column of ``keep`` that is named like a result column is left out; other
    columns may have any name. A text is held whole, with some 60 bytes for each of its units.
    """
    keep = [c for c in keep if c not in RESULT]
    text = F.make_valid_utf8(F.coalesce(F.col("text").cast("string"), F.lit("")))
    digest = F.sha2(F.concat(F.lit(f"{params.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    hashes = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    rows = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(keep)), text.alias("text"), *hashes)
    kept = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name[0] == "c"]
    schema = ", ".join([*kept, "n long, form string, prefix_chars long, middle_chars long, output string"])
    done = rows.mapInArrow(_transform(params), schema)
    return done.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(keep)), *RESULT)


def restore(output: Column, form: Column) -> Column:
    """The text that ``transform`` was given, from its output and form.

    No mark occurs in a text that was cut, and a mark can't begin inside a part and end in another mark, so the first
    place where a mark is found is where it was put.
    """

    def parts(second: str):
        a = F.call_function("locate", F.lit(second), output, F.lit(4))
        m = F.call_function("locate", F.lit(MIDDLE), output, a + 3)
        return F.substr(output, F.lit(4), a - 4), F.substr(output, a + 3, m - a - 3), F.substr(output, m + 3)

    before, after, middle = parts(SUFFIX)
    late, early, inner = parts(PREFIX)
    return (
        F.when(form == PSM, F.concat(before, middle, after)).when(form == SPM, F.concat(early, inner, late)).otherwise(output)
    )
