"""Problem 5: oversized items split at natural boundaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.letters import letters, window_hashes
from strandline.runtime import bound_arrow_batches

_PIECES = "idx long, piece_no int, piece_start long, piece_end long, cut_by string, piece string"
_GAPS = "array<struct<gap_start: bigint, gap_end: bigint>>"
_N = ord("N")


def gap_runs(codes: np.ndarray, min_gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of at least ``min_gap`` letters N."""
    edge = np.diff(np.concatenate(([0], (codes == _N).view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = ends - starts >= min_gap
    return starts[long], ends[long]


def cut_points(
    codes: np.ndarray, gaps: np.ndarray, max_len: int, overlap: int, min_len: int, window: int
) -> list[tuple[int, int, str]]:
    """(start, end, what the end was cut by) of each piece.

    A piece that starts at s may end in [s + min_len, s + max_len]. The landmark there is the place after the window
    with the smallest rolling hash, which depends on the letters around it and not on their position; the piece ends at
    the gap start nearest to the landmark if there is one in reach, else at the landmark. After an edit the landmarks
    are found again, so the pieces fall into step with the old ones.
    """
    n, out, start = len(codes), [], 0
    hashes = window_hashes(codes, window, 5)
    while n - start > max_len:
        low, high = start + min_len, start + max_len
        mark = low + int(np.argmin(hashes[low - window : high - window + 1]))
        near = gaps[np.searchsorted(gaps, low) : np.searchsorted(gaps, high, "right")]
        by = "gap" if len(near) else "landmark"
        end = int(near[np.argmin(np.abs(near - mark))]) if len(near) else mark
        out.append((start, end, by))
        start = end - overlap
    out.append((start, n, "end"))
    return out


def _oversized(df: DataFrame, id_col: str, sequence: str, max_len: int) -> DataFrame:
    """(idx, s): the letters of the records over the limit; all others are dropped before they reach Python."""
    one = df.select(F.col(id_col).cast("long").alias("idx"), F.col(sequence).alias("raw")).filter(
        F.length("raw") > max_len
    )
    return one.select("idx", letters(F.col("raw")).alias("s")).filter(F.length("s") > max_len)


def _chunks(
    df: DataFrame,
    id_col: str,
    sequence: str,
    max_len: int,
    overlap: int,
    min_len: int,
    min_gap: int,
    window: int,
) -> DataFrame:
    """The chunking pass: each piece of each oversized record, and with it the gaps that start before the next piece does,
    so that each gap comes out once; the first piece of a record without gaps has one of -1."""
    if not 0 <= overlap < min_len <= max_len or not 0 < window <= min_len:
        raise ValueError("0 <= overlap < min_len <= max_len and 0 < window <= min_len must hold")
    bound_arrow_batches(df.sparkSession)
    gap = pa.struct([("gap_start", pa.int64()), ("gap_end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["idx", "piece_no", "piece_start", "piece_end", "cut_by", "piece", "gaps"]
        for batch in batches:
            for idx, text in zip(batch["idx"].to_pylist(), batch["s"].to_pylist()):
                codes = np.frombuffer(text.encode(), np.uint8)
                gaps, ends = gap_runs(codes, min_gap)
                cuts = cut_points(codes, gaps, max_len, overlap, min_len, window)
                starts = [a for a, _, _ in cuts]
                if not len(gaps):
                    gaps = ends = np.array([-1])
                at = np.concatenate(([0], np.searchsorted(gaps, starts[1:]), [len(gaps)]))
                runs = pa.StructArray.from_arrays([pa.array(gaps, pa.int64()), pa.array(ends, pa.int64())], fields=list(gap))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([idx] * len(cuts), pa.int64()),
                        pa.array(range(len(cuts)), pa.int32()),
                        pa.array(starts, pa.int64()),
                        pa.array([b for _, b, _ in cuts], pa.int64()),
                        pa.array([by for _, _, by in cuts], pa.string()),
                        pa.array([text[a:b] for a, b, _ in cuts], pa.string()),
                        pa.ListArray.from_arrays(pa.array(at, pa.int32()), runs),
                    ],
                    names,
                )

    return _oversized(df, id_col, sequence, max_len).mapInArrow(run, f"{_PIECES}, gaps {_GAPS}")


def natural_boundaries(
    df: DataFrame,
    id_col: str = "idx",
    sequence: str = "sequence",
    max_len: int = 5000,
    min_gap: int = 10,
    overlap: int = 200,
    min_len: int = 1000,
    window: int = 32,
) -> DataFrame:
    """The places where ``split_oversized`` may cut naturally: (idx, gap_start, gap_end) for each maximal run of at least
    ``min_gap`` letters N of each record with more than ``max_len`` letters; one row with -1 where it has none.

    The gaps come out of the chunking pass with the pieces. Null, empty and short sequences give no rows. Repeated rows
    give repeated rows.
    """
    chunks = _chunks(df, id_col, sequence, max_len, overlap, min_len, min_gap, window)
    return chunks.select("idx", F.inline("gaps"))


def split_oversized(
    df: DataFrame,
    id_col: str = "idx",
    sequence: str = "sequence",
    max_len: int = 5000,
    overlap: int = 200,
    min_len: int = 1000,
    min_gap: int = 10,
    window: int = 32,
) -> DataFrame:
    """Pieces of at most ``max_len`` letters of the records with more: (idx, piece_no, piece_start, piece_end, cut_by,
    piece). Consecutive pieces share exactly ``overlap`` letters; cut_by is gap, landmark, or end for the last piece.

    Content-defined chunking, see ``cut_points``. One record is one unit of work (a record must fit in a task's
    memory); records are independent, so there is no shuffle. Null, empty and short sequences give no rows, repeated
    rows give repeated pieces, other columns of the input are not read.
    """
    chunks = _chunks(df, id_col, sequence, max_len, overlap, min_len, min_gap, window)
    return chunks.drop("gaps")
