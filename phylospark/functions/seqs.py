"""Column builders for sequences: built-in expressions, so that they stay in the JVM, but for translation, which looks up whole Arrow batches in a table."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from phylospark.functions.batches import byte_texts, text_bytes
from phylospark.functions.codes import code

#: Symbols that a DNA or protein sequence may have, and those that are reported on.
DNA_VALID = "?-ACGTRYSWKMBDHVNacgtryswkmbdhvn."
AA_VALID = "?-ARNDCQEGHILKMFPSTWYVXBZJU*.~"
DNA_SYMBOLS = "?-ACGTNRYSWKMBDHV."
AA_SYMBOLS = "?-ARNDCQEGHILKMFPSTWYVXBZJU*.~"
#: States of a DNA site; symbols of a protein site that are no states; symbols of missing data.
DNA_STATES = "ACGTacgt"
AA_AMBIGUOUS = "XBZJU?-.~*"
MISSING = "-?"


def char_class(symbols: str) -> str:
    """A regular expression's class of these symbols."""
    return "[" + "".join(re.escape(c) for c in sorted(set(symbols))) + "]"


def only(col: Column, symbols: str) -> Column:
    """Whether a text consists of these symbols; the empty one does."""
    return col.rlike("^" + char_class(symbols) + "*$")


def valid(col: Column, datatype: str) -> Column:
    """Whether a sequence has only symbols of its type: 'dna' in both cases, 'aa' in upper case, 'ignore' any."""
    if datatype == "ignore":
        return F.lit(True)
    return only(col, {"dna": DNA_VALID, "aa": AA_VALID}[datatype])


def count_of(col: Column, symbols: str) -> Column:
    """How many of a text's characters are among these: what is lost when they are removed."""
    return (F.length(col) - F.length(F.translate(col, symbols, ""))).cast("bigint")


def missing(col: Column) -> Column:
    return count_of(col, MISSING)


def ungapped(col: Column) -> Column:
    return F.translate(col, MISSING, "")


def natural_key(col: Column, width: int = 20) -> Column:
    """Sorts texts with their digit runs as numbers: L2 before L10. Runs longer than the width keep their order among each other only."""
    runs = F.regexp_extract_all(col, F.lit(r"\d+|\D+"), 0)
    return F.array_join(F.transform(runs, lambda c: F.when(c.rlike(r"^\d"), F.lpad(c, F.greatest(F.length(c), F.lit(width)), F.lit("0"))).otherwise(c)), "")


def file_stem(path: Column) -> Column:
    """The file's name without its last extension."""
    return F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)


def chunks(col: Column, width: int) -> Column:
    return F.regexp_extract_all(col, F.lit("(?s).{1,%d}" % width), 0)


#: What a codon may be made of; anything else, and what is beyond the sequence's end, is the class behind these.
_LETTERS = "TCAGN-?"
_CLASS = np.full(256, len(_LETTERS), dtype=np.int64)
for _k, _c in enumerate(_LETTERS):
    _CLASS[[ord(_c), ord(_c.lower())]] = _k


def codon_table(table: int) -> np.ndarray:
    """Amino acids by the classes of a codon's three characters; X where the code has none."""
    n = len(_LETTERS) + 1
    out = np.full((n, n, n), ord("X"), dtype=np.uint8)
    for codon, amino in code(table).items():
        out[tuple(_LETTERS.index(c) for c in codon)] = ord(amino)
    return out


def translate_batch(seq: pa.Array, frame: np.ndarray, amino: np.ndarray) -> pa.Array:
    """Amino acids of sequences, each read from its frame on (1, 2 or 3). Null for null."""
    seq = seq.cast(pa.string())
    data, sizes = text_bytes(seq)
    if data.size and data.max() > 127:  # one character each
        seq = pc.replace_substring_regex(seq, "[^\\x00-\\x7f]", "!")
        data, sizes = text_bytes(seq)
    first = np.cumsum(sizes) - sizes + frame - 1
    end = np.repeat(np.cumsum(sizes), n := np.maximum(-(-(sizes - frame + 1) // 3), 0))
    at = np.repeat(first, n) + 3 * (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))
    padded = np.append(_CLASS[data], len(_LETTERS))
    found = byte_texts(amino[tuple(padded[np.where(at + j < end, at + j, len(data))] for j in range(3))], n)
    return pc.if_else(pc.is_valid(seq), found, None)


def translated(col: Column, table: int = 1, frame: int | Column = 1) -> Column:
    """Amino acids of a DNA sequence read in frame 1, 2 or 3, which may be a column: unknown or incomplete codons are X. Null for a null sequence or frame."""
    if isinstance(frame, int) and frame not in (1, 2, 3):
        raise ValueError("the reading frame is 1, 2 or 3")
    amino = codon_table(table)

    @F.arrow_udf("string")
    def run(seq: pa.Array, frames: pa.Array) -> pa.Array:
        known = pc.is_valid(frames)
        found = translate_batch(seq, pc.fill_null(frames, 1).to_numpy(zero_copy_only=False).astype(np.int64), amino)
        return pc.if_else(known, found, None)

    return run(col, F.lit(frame) if isinstance(frame, int) else frame.cast("int"))


def _java_replacement(replacement: str, shift: int) -> str:
    """A replacement with $1, ${1}, $name or $$ as Java's, with its groups counted from shift on."""
    def one(m: re.Match) -> str:
        if m[0] == "$$":
            return r"\$"
        name = m[1] or m[2]
        return "${%d}" % (int(name) + shift) if name.isdigit() else "${" + name + "}"

    escaped = replacement.replace("\\", "\\\\")
    out = re.sub(r"\$\$|\$\{(\w+)\}|\$(\w+)", one, escaped)
    return re.sub(r"\$\{(\d+)\}", r"$\1", out)


def replace_regex(col: Column, pattern: str, replacement: str, every: bool = False) -> Column:
    """Replace a regular expression's first match, or every match. Groups in the replacement are $1, ${1} or ${name}; $$ is a dollar sign."""
    if every:
        return F.regexp_replace(col, pattern, _java_replacement(replacement, 0))
    return F.regexp_replace(col, r"\A([\s\S]*?)(?:" + pattern + ")", "$1" + _java_replacement(replacement, 1))
