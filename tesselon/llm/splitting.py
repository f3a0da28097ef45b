"""Long texts into pieces of limited size at natural boundaries (problem 8)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tesselon.functions.keys import distinct_names
from tesselon.llm.tokens import SINGLE, code_points, slices, token_classes, token_starts

LIMIT, OVERLAP = 512, 64
#: The cost of a cut at the end of a paragraph, line, sentence or word, and of one anywhere else.
PENALTY = np.array([0.0, 0.15, 0.4, 1.5, 6.0])
PARAGRAPH, LINE, SENTENCE, WORD, INSIDE = range(5)
#: The cost of a piece, and the weight of its squared distance from the even size, in limits.
PIECE, UNEVEN = 0.5, 1.0
#: Texts that need no more pieces than this get the least number or one more; of longer ones every number is considered.
FEW = 5
#: Positions decided at once; two pieces in a row that advance less than this together would always be better as one.
BLOCK = 64
#: Marks that end a sentence (the second row without a space after them), and closing marks that may follow.
ENDS, ENDS_CLOSED = ".!?…؟।", "。！？｡"
CLOSING = "\"'”’»)]}」』）】"


def boundary_kinds(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each token, what kind of boundary lies before it (that before the first one has no meaning)."""
    n = len(starts)
    kinds = np.full(n, INSIDE, dtype=np.int8)
    if n < 2:
        return kinds
    newline = (points == 10) | (points == 0x2028) | (points == 0x2029) | (points == 0x0B) | (points == 0x0C)
    lone = points == 13
    lone[:-1] &= points[1:] != 10
    upto = np.concatenate(([0], np.cumsum(newline | lone)))
    lines = upto[starts[1:]] - upto[ends[:-1]]
    spaced = starts[1:] > ends[:-1]
    single = token_classes()[points[starts]] == SINGLE
    last = points[ends - 1]
    mark = np.isin(last, [ord(c) for c in ENDS]) & (ends - starts == 1)
    closed_mark = np.isin(last, [ord(c) for c in ENDS_CLOSED])
    closing = np.isin(last, [ord(c) for c in CLOSING]) & (ends - starts == 1)
    # a closing mark right after the end of a sentence ends it too
    for _ in range(2):
        touching = np.concatenate(([False], ~spaced)) & closing
        mark |= touching & np.concatenate(([False], mark[:-1]))
        closed_mark |= touching & np.concatenate(([False], closed_mark[:-1]))
    chinese = single & (points[starts] >= 0x3400) & ~closed_mark
    kinds[1:][spaced | (chinese[:-1] & chinese[1:]) | closed_mark[:-1]] = WORD
    kinds[1:][closed_mark[:-1] & ~(closing[1:] & ~spaced) | mark[:-1] & spaced] = SENTENCE
    kinds[1:][lines >= 1] = LINE
    kinds[1:][lines >= 2] = PARAGRAPH
    return kinds


def one_pass(at: np.ndarray, step: int, piece: float, weight: float) -> tuple[float, list[int]]:
    """The least sum of ``piece + weight * advance**2`` over the pieces and of ``at`` over the cuts, and these cuts.

    Advances are 1 to ``step``, from 0 to the last position, which is the last cut.
    """
    n, block = len(at) - 1, min(BLOCK, step)
    way = piece + weight * np.arange(step, 0, -1.0) ** 2
    ahead = np.arange(block)[:, None] - np.arange(block)
    near = np.where(ahead > 0, piece + weight * ahead**2.0, np.inf)
    best, back = np.full(step + n + 1, np.inf), np.zeros(n + 1, np.int64)
    best[step] = 0.0
    for start in range(1, n + 1, block):
        end = min(start + block, n + 1)
        row = np.arange(end - start)
        sums = np.lib.stride_tricks.sliding_window_view(best[start : end - 1 + step], step) + way  # from before the block
        pick = sums.argmin(axis=1)
        far = sums[row, pick] + at[start:end]
        inner = far + near[: end - start, : end - start]
        pick_in = inner.argmin(axis=1)
        short = inner[row, pick_in] + at[start:end]
        best[step + start : step + end] = np.minimum(far, short)
        back[start:end] = start + np.where(short < far, pick_in, row - step + pick)
    cuts = [n]
    while back[cuts[-1]] > 0:
        cuts.append(int(back[cuts[-1]]))
    return float(best[-1]), cuts[::-1]


def free_cuts(at: np.ndarray, step: int, limit: int, least: int) -> list[int]:
    """The cuts of the least cost over every number of pieces, as positions from the first overlap's end.

    With advances that add up to n the cost is ``sum(PIECE + w * advance**2) + penalties - w * n**2 / pieces``. The last
    term is concave in the number: a line through its ends in a range of numbers lies below it and bounds the range by one
    pass; where a range is a single number, its tangent lies above it and the pass finds no worse cuts than that number's.
    """
    n, weight = len(at) - 1, UNEVEN / limit**2
    spread = weight * n**2
    least_cost, best_found = np.inf, [n]

    def tried(slope: float) -> float:
        nonlocal least_cost, best_found
        value, cuts = one_pass(at, step, PIECE + slope, weight)
        cost = value - slope * len(cuts) - spread / len(cuts)
        if cost < least_cost:
            least_cost, best_found = cost, cuts
        return value

    lowest = tried(0.0)
    tried(spread / len(best_found) ** 2)
    room = lowest - least_cost  # more pieces than spread / room cost more than the best ones so far
    ranges = [(least, min(n, int(spread / room) + 1) if room > 0 else n)]
    while ranges:
        low, high = ranges.pop()
        if low > high or lowest - spread / low >= least_cost:
            continue
        slope = spread / (low * high)
        bound = tried(slope) - spread / low - slope * low
        if low < high and bound < least_cost - 1e-9:
            middle = (low + high) // 2
            ranges += [(middle + 1, high), (low, middle)]
    return best_found


def best_cuts(kinds: np.ndarray, limit: int = LIMIT, overlap: int = OVERLAP) -> list[int]:
    """The token numbers at which pieces end, the last being the number of tokens.

    Piece 1 is tokens 0 to c1, each next one starts ``overlap`` tokens before the cut. Dynamic programming over all cut
    positions minimises the cuts' penalties, the number of pieces and their unevenness, over every number of pieces, or up
    to ``FEW`` pieces for the least possible number and one more; a position within reach of the limits is never left out.
    """
    n, step = len(kinds), limit - overlap
    if n <= limit:
        return [n]
    least = -(-(n - overlap) // step)
    cost = PENALTY[kinds]
    if least > FEW:
        return [z + overlap for z in free_cuts(np.append(cost[overlap:], 0.0), step, limit, least)]
    choices = []
    for pieces in (least, least + 1):
        even = (n - overlap) / pieces + overlap
        lengths = np.arange(1, step + 1) + overlap
        way = PIECE + UNEVEN * ((lengths - even) / limit) ** 2  # by the advance, 1 to step
        # ends of piece k lie between those from which the rest can still be reached and those that can be reached
        low, high = max(1, n - step * (pieces - 1)), min(limit, n - (pieces - 1))
        at = np.arange(low, high + 1)
        best = PIECE + UNEVEN * ((at - even) / limit) ** 2 + cost[at]
        back: list[tuple[int, np.ndarray]] = []
        for k in range(2, pieces + 1):
            new_low, new_high = max(low + 1, n - step * (pieces - k)), min(high + step, n - (pieces - k))
            # window of the step positions before each end, nearest last
            padded = np.full(new_high - new_low + step, np.inf)
            first = new_low - step
            i, j = max(low, first), min(high, new_high - 1)
            padded[i - first : j - first + 1] = best[i - low : j - low + 1]
            sums = np.lib.stride_tricks.sliding_window_view(padded, step) + way[::-1]
            pick = sums.argmin(axis=1)
            at = np.arange(new_low, new_high + 1)
            best = sums[np.arange(len(at)), pick] + (cost[np.minimum(at, n - 1)] if k < pieces else 0.0)
            back.append((new_low, at - step + pick))
            low, high = new_low, new_high
        cuts = [n]
        for base, came in reversed(back):
            cuts.append(int(came[cuts[-1] - base]))
        choices.append((float(best[n - low]), cuts[::-1]))
    return min(choices)[1]


def split_texts(df: DataFrame, id_col: str, text_col: str, limit: int = LIMIT, overlap: int = OVERLAP, *, only_long: bool = False, with_text: bool = True) -> DataFrame:
    """``(id_col, piece, pieces, first_token, last_token, start, fresh, end[, text])``, a row per piece.

    Pieces 0, 1, ... of a text have at most ``limit`` tokens and each repeats the last ``overlap`` tokens of the one
    before. ``start`` and ``end`` are character offsets, ``fresh`` the offset at which what the piece before didn't hold
    begins: joined from ``fresh`` to ``end``, the pieces give the text back exactly. A text within the limit, an empty
    one and a null one are a single piece (null as an empty text), or are left out with ``only_long``. Rows with the same
    id are texts of their own. Whole texts are read, however long.
    """
    distinct_names(id_col, "piece", "pieces", "first_token", "last_token", "start", "fresh", "end", *["text"] * with_text)
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below the limit")
    id_type = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if only_long:
        rows = rows.where(F.length("text") > limit)  # no token is shorter than a character

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            points, bounds = code_points(batch.column(1))
            starts, ends = token_starts(points, bounds)
            kinds = boundary_kinds(points, starts, ends)
            own = np.searchsorted(starts, bounds)
            texts = batch.column(1) if with_text else None
            out: list[tuple] = []
            for r in range(len(batch)):
                i, j = int(own[r]), int(own[r + 1])
                if only_long and j - i <= limit:
                    continue
                base, size = int(bounds[r]), int(bounds[r + 1] - bounds[r])
                cuts = best_cuts(kinds[i:j], limit, overlap)
                places = [0, *(int(starts[i + c]) - base for c in cuts[:-1]), size]
                text = (texts[r].as_py() or "") if with_text else ""
                for k, c in enumerate(cuts):
                    first = 0 if k == 0 else cuts[k - 1] - overlap
                    start = 0 if k == 0 else int(starts[i + first]) - base if overlap else places[k]
                    out.append((r, k, len(cuts), first, c, start, places[k], places[k + 1], *([text[start : places[k + 1]]] if with_text else [])))
            if out:
                r, *columns = zip(*out, strict=True)
                kinds_of = [pa.int64()] * 7 + [pa.string()] * with_text
                names = ["piece", "pieces", "first_token", "last_token", "start", "fresh", "end", *["text"] * with_text]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(r, pa.int64())), *(pa.array(x, t) for x, t in zip(columns, kinds_of, strict=True))], ["id", *names])

    schema = f"id {id_type}, piece bigint, pieces bigint, first_token bigint, last_token bigint, start bigint, fresh bigint, `end` bigint" + ", text string" * with_text
    return rows.mapInArrow(split, schema).withColumnRenamed("id", id_col)
