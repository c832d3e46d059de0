"""Readers of whole small files whose lines depend on each other: text in, rows out. Run by executors, one file at a time."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain


class FormatError(ValueError):
    """A file that breaks the rules of its format."""


def _pairs(words: list[str], where: str) -> dict[str, str]:
    out = {}
    for w in words:
        key, eq, value = w.lower().partition("=")
        if eq and (not key or not value):
            raise FormatError(f"{where}: expected key=value, found {w!r}")
        out[key] = value
    return out


def _check(rows: dict[str, str], ntax: int | None, nchar: int | None) -> None:
    if ntax is not None and len(rows) != ntax:
        raise FormatError(f"{len(rows)} sequences where the header says {ntax}")
    longest = max(map(len, rows.values()), default=0)
    if nchar is not None and longest != nchar:
        raise FormatError(f"{longest} characters where the header says {nchar}")


def nexus(text: str, checked: bool = True) -> tuple[dict[str, str], dict[str, str]]:
    """Sequences by id in their order, and the header (ntax, nchar, datatype, missing, gap, interleave)."""
    first, _, rest = text.lstrip("﻿").partition("\n")
    if not first.strip().lower().startswith("#nexus"):
        raise FormatError("the first line is not #NEXUS")
    header: dict[str, str] = {}
    rows: dict[str, str] = {}
    for statement in rest.split(";"):
        words = statement.split(None, 1)
        if not words:
            continue
        command, body = words[0].lower(), words[1] if len(words) > 1 else ""
        if command in ("dimensions", "format"):
            found = _pairs(body.split(), command)
            header |= {k: v or "yes" for k, v in found.items()}
        elif command == "matrix":
            interleaved = header.get("interleave", "no") == "yes"
            for line in body.splitlines():
                parts = line.split()
                if len(parts) != 2:  # blank lines, and ids with blanks, which the check of ntax finds
                    continue
                name, seq = parts
                if name in rows and not interleaved:
                    raise FormatError(f"the id {name} occurs twice")
                rows[name] = rows.get(name, "") + seq
    if checked:
        _check(rows, *(int(header[k]) if k in header else None for k in ("ntax", "nchar")))
    return rows, header


def nexus_segments(chunks: Iterator[bytes]) -> Iterator[tuple[int, str, int, bytes]]:
    """(seq_idx, id, position, piece) of an interleaved NEXUS file given as bytes, as it is read: pieces without anything but '?' are left out, save
    each id's first. Raises where `nexus` does: after the last piece if a number differs from the header's. Holds the ids and their lengths. One statement a line up to the matrix."""
    head, left, header, inside, over, blank = b"", b"", {}, False, False, b""
    at: dict[bytes, list[int]] = {}
    for chunk in chain(chunks, [b"\n"]):
        *lines, left = (left + chunk).split(b"\n")
        for line in lines:
            if not inside:
                head += line + b"\n"
                if line.strip().lower() == b"matrix":
                    header = nexus(head.decode().rpartition("\n")[0].rsplit("\n", 1)[0], checked=False)[1]
                    inside = True
                continue
            name, _, seq = line.partition(b" ")
            if not over and seq and (known := at.get(name)) is not None and seq.lstrip() == blank:  # most lines of a large file
                known[1] += len(blank)
                continue
            words = line.split()
            if words and words[0].startswith(b";"):
                over = True
            if over or len(words) != 2:
                continue
            name, seq = words
            known = at.get(name)
            if known is None:
                known = at[name] = [len(at), 0]
                yield known[0], name.decode(), 0, seq
            elif seq.strip(b"?"):
                yield known[0], name.decode(), known[1], seq
            known[1] += len(seq)
            if len(blank) != len(seq):
                blank = b"?" * len(seq)
    if not over:
        raise FormatError("the matrix has no end")
    longest = max((n for _, n in at.values()), default=0)
    if any(n != longest for _, n in at.values()):
        raise FormatError("sequences of different lengths")
    for key, n in (("ntax", len(at)), ("nchar", longest)):
        if key in header and int(header[key]) != n:
            raise FormatError(f"{n} where the header says {key}={header[key]}")


def nexus_ids(text: str) -> list[str]:
    """The ids in their order, without a check of the matrix."""
    out: dict[str, None] = {}
    m = re.search(r"(?i)\bmatrix\b([^;]*)", text)
    for line in (m[1] if m else "").splitlines():
        parts = line.split()
        if len(parts) == 2:
            if parts[0] in out:
                break
            out[parts[0]] = None
    return list(out)


def _phylip_header(lines: list[str]) -> tuple[int, int]:
    words = lines[0].split() if lines else []
    if len(words) != 2 or not all(w.isdigit() for w in words):
        raise FormatError("the first line is not the numbers of sequences and characters")
    return int(words[0]), int(words[1])


def phylip(text: str) -> tuple[dict[str, str], dict[str, str]]:
    """Sequences by id in their order: `id seq` for as many lines as there are sequences, then further pieces in the same order."""
    lines = text.splitlines()
    ntax, nchar = _phylip_header(lines)
    rows: dict[str, str] = {}
    body = [line.strip() for line in lines[1:] if line.strip()]
    for line in body[:ntax]:
        parts = line.split()
        if len(parts) != 2:
            raise FormatError(f"expected an id and a sequence, found {line[:60]!r}")
        if parts[0] in rows:
            raise FormatError(f"the id {parts[0]} occurs twice")
        rows[parts[0]] = parts[1]
    names = list(rows)
    for k, line in enumerate(body[ntax:]):
        rows[names[k % ntax]] += "".join(line.split())
    _check(rows, ntax, nchar)
    return rows, {"ntax": str(ntax), "nchar": str(nchar)}


def phylip_ids(text: str) -> list[str]:
    lines = text.splitlines()
    ntax, _ = _phylip_header(lines)
    return [line.split()[0] for line in [x for x in lines[1:] if x.strip()][:ntax]]


# --- MAF


def _maf_s(words: list[str]) -> dict:
    if len(words) != 7:
        raise FormatError(f"an s line with {len(words)} fields instead of 7")
    return {"source": words[1], "start": int(words[2]), "size": int(words[3]), "strand": words[4], "src_size": int(words[5]), "text": words[6]}


def maf(lines: Iterator[str]) -> Iterator[dict]:
    """Paragraphs of a MAF file, tagged by `kind`: header, track, comment, or block with what its lines say.

    A block begins at each `a` line and ends at the next one, at a blank line or at the file's end. Of q, i and e lines the last of each counts.
    """
    block: dict | None = None
    index = 0
    for line in lines:
        words = line.split()
        tag = words[0] if words else ""
        if not words or line[:1] in ("#",) or tag in ("a", "track"):
            if block is not None:
                yield block
                block = None
        if line.startswith("##maf"):
            yield {"kind": "header", "fields": dict(w.split("=", 1) for w in words[1:] if "=" in w)}
        elif line.startswith("#"):
            yield {"kind": "comment", "text": line[1:].strip()}
        elif tag == "track":
            found = re.findall(r"(\w+)=(\"[^\"]*\"|'[^']*'|\S+)", line)
            yield {"kind": "track", "fields": {k: v.strip("\"'") for k, v in found}}
        elif tag == "a":
            m = re.search(r"\bscore=([0-9.]+)", line)
            block = {"kind": "block", "block_idx": index, "score": float(m[1]) if m else None, "sequences": [], "quality": None, "information": None, "empty": None}
            index += 1
        elif block is not None and tag == "s":
            block["sequences"].append(_maf_s(words))
        elif block is not None and tag == "q" and len(words) >= 3:
            block["quality"] = {"source": words[1], "values": list(words[2])}
        elif block is not None and tag == "i" and len(words) >= 6:
            block["information"] = {"source": words[1], "left_status": words[2], "left_count": int(words[3]), "right_status": words[4], "right_count": int(words[5])}
        elif block is not None and tag == "e" and len(words) >= 6:
            block["empty"] = {"source": words[1], "start": int(words[2]), "size": int(words[3]), "strand": words[4], "src_size": int(words[5])}
    if block is not None:
        yield block


# --- partitions

#: Characters that a part's name loses, and what becomes of a dot.
DROPPED = "()/\\,\"';:?!"
_NAME = str.maketrans({c: None for c in DROPPED} | {".": "_"})
#: What tells the codon positions of a gene apart: the number of a subset, or the ordinal of a position.
_CODON_PART = re.compile(r"_(?:subset_?[0-9]|[0-9](?:st|nd|rd|th)pos)", re.IGNORECASE)
_RANGE = re.compile(r"\s*(\d+)\s*-\s*(\d+)\s*(\\3)?\s*;?\s*")


def _gene(name: str, codon: bool) -> str:
    name = name.strip().translate(_NAME)
    if re.search(r"\s", name):
        raise FormatError(f"a name with blanks: {name!r}")
    return _CODON_PART.sub("", name, count=1) if codon else name


def partition(text: str, fmt: str) -> list[tuple[str, int, int]]:
    """(gene, start, end) of a RAxML ('raxml') or NEXUS ('nexus', 'charset') partition table.

    A range in steps of three is a codon position of a gene: its name loses what tells it apart, and the positions of a gene, which are those
    in a row with the same end, count once, from the first. Other names stay whole and other ranges are parts each. No part at all is an error.
    """
    found: list[tuple[str, int, int]] = []
    for line in text.splitlines():
        x = line.strip()
        if fmt != "raxml":
            if not x.lower().startswith("charset"):
                continue
            x = x[len("charset") :]
        if not x or "=" not in x:  # blank lines say nothing
            continue
        name, _, where = x.partition("=")
        if fmt == "raxml" and "," in name:
            name = name.partition(",")[2]
        m = _RANGE.fullmatch(where)
        if not m:
            raise FormatError(f"no range of positions: {line!r}")
        codon, start, end = m[3] is not None, int(m[1]), int(m[2])
        if codon and found and found[-1][2] == end:
            continue
        found.append((_gene(name, codon), start, end))
    if not found:
        raise FormatError("no part in the partition table")
    return found


def check_contiguous(parts: list[tuple[str, int, int]]) -> None:
    expected = 1
    for gene, start, end in parts:
        if start != expected or end < start:
            raise FormatError(f"{gene} begins at {start} instead of {expected}")
        expected = end + 1
