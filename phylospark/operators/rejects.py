"""Typed rows out of raw lines, and the lines that cannot be read with the reason for it.

Each Arrow batch of lines is handed to pyarrow's CSV reader, whose invalid-row callback gets the lines with a wrong number
of fields. All fields are read as strings; then whole columns are checked and cast, and the failing cells are labelled.
No shuffle, no state across batches: the input is read once and both results are filters on one column.

Defined results: a null line fails ('missing line'), as does an empty one; a kind other than csv, tsv and bed fails
('unknown kind'). A null line_no is not 1, so the line is a record. Repeated rows are judged each on its own. Positions
beyond 64 bits are valid by the format, their typed column is null. Optional BED numbers that cannot be read are null.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BED_FIELDS = ["chrom", "chrom_start", "chrom_end", "name", "score", "strand", "thick_start", "thick_end", "item_rgb", "block_count", "block_sizes", "block_starts"]
BED_NUMBERS = {"chrom_start", "chrom_end", "score", "thick_start", "thick_end", "block_count"}
MAX_ID = 120
MAX_SCORE = 65535
#: Words that stand for a missing value, in lower case.
MISSING_WORDS = ["na", "n/a", "null", "none"]
STRANDS = ["+", "-", "."]
#: Beginnings of BED lines that are not records.
BED_NOT_RECORDS = ["#", "track", "browser"]

#: A csv line in which each field is free of quotes or enclosed in them, with only doubled ones inside.
_QUOTED = r'^[ \t]*("([^"]|"")*"|[^",]*)[ \t]*(,[ \t]*("([^"]|"")*"|[^",]*)[ \t]*)*$'
_OUT = pa.schema(
    [("status", pa.string()), ("reason", pa.string()), ("origin", pa.string()), ("destination", pa.string())]
    + [(f, pa.int64() if f in BED_NUMBERS else pa.string()) for f in BED_FIELDS]
)
_DDL = "status string, reason string, origin string, destination string, " + ", ".join(f"{f} {'bigint' if f in BED_NUMBERS else 'string'}" for f in BED_FIELDS)


def _has(values: pa.Array, regex: str) -> np.ndarray:
    return pc.match_substring_regex(values, regex).to_numpy(zero_copy_only=False).astype(bool)


def _read(at: np.ndarray, lines: pa.Array, fields: int, delimiter: str, quote: bool) -> tuple[np.ndarray, list[pa.Array], dict[int, int]]:
    """Positions and columns of the lines with so many fields, and the number of fields of each other line.

    Each line goes through with its position as a first field, by which the callback knows it again.
    """
    wrong: dict[int, int] = {}

    def invalid(row: pacsv.InvalidRow) -> str:
        wrong[int(row.text.split(delimiter, 1)[0])] = row.actual_columns - 1
        return "skip"

    if not len(at):
        return at, [pa.array([], pa.string())] * fields, wrong
    numbered = pc.binary_join_element_wise(pa.array(at).cast(pa.string()), lines, delimiter)
    buffer = ("\n".join(numbered.to_pylist()) + "\n").encode()
    names = ["at", *map(str, range(fields))]
    table = pacsv.read_csv(
        io.BytesIO(buffer),
        read_options=pacsv.ReadOptions(column_names=names, use_threads=False, block_size=max(1 << 20, len(buffer) + 1)),
        parse_options=pacsv.ParseOptions(delimiter=delimiter, quote_char='"' if quote else False, double_quote=quote, ignore_empty_lines=False, invalid_row_handler=invalid),
        convert_options=pacsv.ConvertOptions(column_types=dict.fromkeys(names, pa.string()), strings_can_be_null=False, check_utf8=False),
    )
    cols = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in table.columns]
    cols = [pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c for c in cols]
    return cols[0].cast(pa.int64()).to_numpy(zero_copy_only=False), cols[1:], wrong


def _label(reason: np.ndarray, at: np.ndarray, bad: np.ndarray, what: str) -> None:
    """Give the lines that fail and have no reason yet this one."""
    hit = at[bad]
    reason[hit[np.equal(reason[hit], None)]] = what


def _ids(reason: np.ndarray, at: np.ndarray, cells: pa.Array, name: str) -> pa.Array:
    """Trim blanks, label the cells that are no ids."""
    cells = pc.utf8_trim(cells, characters=" ")
    lower = pc.utf8_lower(cells)
    _label(reason, at, pc.equal(pc.binary_length(cells), 0).to_numpy(zero_copy_only=False), f"{name}: empty")
    _label(reason, at, pc.is_in(lower, pa.array(MISSING_WORDS)).to_numpy(zero_copy_only=False), f"{name}: word for a missing value")
    _label(reason, at, ~_has(cells, r"^[\x20-\x7e]*$"), f"{name}: character outside printable ASCII")
    _label(reason, at, pc.greater(pc.utf8_length(cells), MAX_ID).to_numpy(zero_copy_only=False), f"{name}: longer than {MAX_ID} characters")
    _label(reason, at, ~_has(cells, "[A-Za-z0-9]"), f"{name}: no letter or digit")
    return cells


def _digits(cells: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Which cells are digits only; these without leading zeros; and their number of digits."""
    ok = _has(cells, "^[0-9]+$")
    bare = pc.utf8_ltrim(cells, characters="0")
    return ok, bare, pc.binary_length(bare).to_numpy(zero_copy_only=False)


def _whole(ok: np.ndarray, bare: pa.Array, size: np.ndarray) -> pa.Array:
    """Cast to 64 bits, null where it is no number or too large."""
    fits = ok & (size <= 18)
    text = pc.if_else(pc.equal(pc.binary_length(bare), 0), "0", bare)
    return pc.if_else(pa.array(fits), text, None).cast(pa.int64())


def _bed(reason: np.ndarray, at: np.ndarray, cols: list[pa.Array], n_fields: np.ndarray) -> list[pa.Array]:
    """Label the failing cells of BED lines and cast the good ones. n_fields: number of fields of each of these lines."""
    chrom, start, end, name, score, strand = cols[:6]
    _label(reason, at, ~_has(chrom, r"^[A-Za-z0-9][A-Za-z0-9_.\-]*$"), "chrom: no sequence name")
    _label(reason, at, pc.is_in(pc.utf8_lower(chrom), pa.array(MISSING_WORDS)).to_numpy(zero_copy_only=False), "chrom: word for a missing value")
    ok_s, bare_s, size_s = _digits(start)
    ok_e, bare_e, size_e = _digits(end)
    _label(reason, at, ~ok_s, "chrom_start: no number")
    _label(reason, at, ~ok_e, "chrom_end: no number")
    less = (size_s < size_e) | ((size_s == size_e) & pc.less(bare_s, bare_e).to_numpy(zero_copy_only=False))
    _label(reason, at, ok_s & ok_e & ~less, "chrom_end: not beyond chrom_start")
    ok, bare, size = _digits(score)
    score_n = _whole(ok, bare, size)
    high = pc.fill_null(pc.greater(score_n, MAX_SCORE), True).to_numpy(zero_copy_only=False)
    _label(reason, at, (n_fields >= 5) & ~ok, "score: no number")
    _label(reason, at, (n_fields >= 5) & high, f"score: above {MAX_SCORE}")
    _label(reason, at, (n_fields >= 6) & ~pc.is_in(strand, pa.array(STRANDS)).to_numpy(zero_copy_only=False), "strand: none of + - .")
    out: list[pa.Array] = []
    for k, (field, cells) in enumerate(zip(BED_FIELDS, cols, strict=True)):
        if field in BED_NUMBERS:
            out.append(_whole(*_digits(cells)))
        else:
            out.append(pc.if_else(pa.array(n_fields > k), cells, None))
    return out


def check_batch(line: pa.Array, kind: pa.Array, line_no: pa.Array) -> list[pa.Array]:
    """The columns of _OUT for these lines. status is 'row', 'reject' or 'skip' (headers and comments)."""
    n = len(line)
    reason = np.full(n, None, dtype=object)
    null = pc.is_null(line).to_numpy(zero_copy_only=False)
    text = pc.fill_null(pc.replace_substring_regex(line, r"\r\z", ""), "")
    control = bool(pc.any(pc.match_substring_regex(text, r"[\n\r\x1b]")).as_py())
    if control:  # line ends inside of a record would end it for the reader
        for char, code in (("\x1b", "\x1be"), ("\n", "\x1bn"), ("\r", "\x1br")):
            text = pc.replace_substring(text, char, code)
    kinds = pc.fill_null(kind, "").to_numpy(zero_copy_only=False)
    first = pc.fill_null(pc.equal(line_no, 1), False).to_numpy(zero_copy_only=False)
    known = np.isin(kinds, ["csv", "tsv", "bed"])
    comment = np.zeros(n, dtype=bool)
    for word in BED_NOT_RECORDS:
        comment |= pc.starts_with(text, word).to_numpy(zero_copy_only=False)
    skip = known & ~null & np.where(kinds == "bed", comment, first)
    reason[null] = "missing line"
    reason[~known] = "unknown kind"
    left = known & ~null & ~skip
    found: list[tuple[np.ndarray, list[str], list[pa.Array]]] = []

    # csv
    at = np.flatnonzero(left & (kinds == "csv"))
    sub = text.take(pa.array(at))
    fine = _has(sub, _QUOTED)
    reason[at[~fine]] = "broken quoting"
    at, sub = at[fine], sub.filter(pa.array(fine))
    sub = pc.utf8_trim(pc.replace_substring_regex(sub, r'[ \t]*("(?:[^"]|"")*"|,)[ \t]*', r"\1"), characters=" \t")
    at, cols, wrong = _read(at, sub, 2, ",", True)
    for k, count in wrong.items():
        reason[k] = f"{count} fields instead of 2"
    found.append((at, ["origin", "destination"], [_ids(reason, at, c, f) for c, f in zip(cols, ["origin", "destination"], strict=True)]))

    # tsv
    at = np.flatnonzero(left & (kinds == "tsv"))
    sub = text.take(pa.array(at))
    quote = _has(sub, '"')
    reason[at[quote]] = "quote in tsv"
    at, sub = at[~quote], sub.filter(pa.array(~quote))
    sub = pc.replace_substring_regex(pc.utf8_trim(sub, characters=" \t"), r"[ \t]+", "\t")
    at, cols, wrong = _read(at, sub, 2, "\t", False)
    for k, count in wrong.items():
        reason[k] = f"{count} fields instead of 2"
    found.append((at, ["origin", "destination"], [_ids(reason, at, c, f) for c, f in zip(cols, ["origin", "destination"], strict=True)]))

    # bed: lines with 3 to 12 fields are filled up to 12; the others go as they are and come back by the callback
    at = np.flatnonzero(left & (kinds == "bed"))
    sub = text.take(pa.array(at))
    quote = _has(sub, '"')
    reason[at[quote]] = "quote in bed"
    at, sub = at[~quote], sub.filter(pa.array(~quote))
    tabs = pc.count_substring(sub, "\t").to_numpy(zero_copy_only=False)
    fields = np.zeros(n, dtype=np.int64)
    fields[at] = tabs + 1
    fill = np.where((tabs >= 2) & (tabs < 11), 11 - tabs, 0)
    sub = pc.binary_join_element_wise(sub, pc.binary_repeat(pa.array(["\t"] * len(at), pa.string()), pa.array(fill)), "") if len(at) else sub
    at, cols, wrong = _read(at, sub, 12, "\t", False)
    for k, count in wrong.items():
        reason[k] = f"{count} fields instead of 3 to 12"
    found.append((at, BED_FIELDS, _bed(reason, at, cols, fields[at])))

    failed = ~np.equal(reason, None)
    status = np.where(failed, "reject", np.where(skip, "skip", "row"))
    columns = {"status": pa.array(status, pa.string()), "reason": pa.array(reason, pa.string())}
    slots = {f: np.full(n, None, dtype=object) for f in _OUT.names[2:]}
    for at, names, cols in found:
        good = ~failed[at]
        for f, c in zip(names, cols, strict=True):
            slots[f][at[good]] = np.array(c.filter(pa.array(good)).to_pylist(), dtype=object)
    for f in _OUT.names[2:]:
        col = pa.array(slots[f], _OUT.field(f).type)
        if control and _OUT.field(f).type == pa.string():
            for char, code in (("\r", "\x1br"), ("\n", "\x1bn"), ("\x1b", "\x1be")):
                col = pc.replace_substring(col, code, char)
        columns[f] = col
    return [columns[f] for f in _OUT.names]


def parse_lines(df: DataFrame, line: str = "line", kind: str = "kind", line_no: str = "line_no", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` of df, then status, reason and the typed fields of each line (see the module's docstring).

    Columns of df not in `keep` are not read. A kept column may not be called as one of the result's own columns: it would raise here.
    """
    keep = keep or []
    clash = set(keep) & set(_OUT.names)
    if clash:
        raise ValueError(f"columns that the result has itself: {sorted(clash)}")
    source = df.select(*keep, F.col(line).cast("string").alias("_line"), F.col(kind).cast("string").alias("_kind"), F.col(line_no).cast("bigint").alias("_line_no"))
    kept = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = check_batch(b.column(kept), b.column(kept + 1), b.column(kept + 2))
            yield pa.RecordBatch.from_arrays([*b.columns[:kept], *made], names=[*b.schema.names[:kept], *_OUT.names])

    ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema.fields[:kept])
    return source.mapInArrow(run, ddl + _DDL)


def rejects(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("status") == "reject")


def rename_rows(parsed: DataFrame) -> DataFrame:
    return parsed.filter((F.col("status") == "row") & F.col("origin").isNotNull()).drop("status", "reason", *BED_FIELDS)


def bed_rows(parsed: DataFrame) -> DataFrame:
    return parsed.filter((F.col("status") == "row") & F.col("chrom").isNotNull()).drop("status", "reason", "origin", "destination")
