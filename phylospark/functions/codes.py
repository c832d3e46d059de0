"""Genetic codes: one base table and what the others differ in."""

from __future__ import annotations

#: The amino acids of the standard code, with the codons in the order TTT, TTC, TTA, TTG, TCT, ... GGG.
BASES = "TCAG"
STANDARD = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
#: By NCBI table number, the codons that differ from the standard code.
DELTAS: dict[int, dict[str, str]] = {
    1: {},
    2: {"AGA": "*", "AGG": "*", "ATA": "M", "TGA": "W"},
    3: {"ATA": "M", "CTT": "T", "CTC": "T", "CTA": "T", "CTG": "T", "TGA": "W"},
    4: {"TGA": "W"},
    5: {"AGA": "S", "AGG": "S", "ATA": "M", "TGA": "W"},
    6: {"TAA": "Q", "TAG": "Q"},
    9: {"AAA": "N", "AGA": "S", "AGG": "S", "TGA": "W"},
    10: {"TGA": "C"},
    11: {},
    12: {"CTG": "S"},
    13: {"AGA": "G", "AGG": "G", "ATA": "M", "TGA": "W"},
    14: {"AAA": "N", "AGA": "S", "AGG": "S", "TAA": "Y", "TGA": "W"},
    16: {"TAG": "L"},
    21: {"TGA": "W", "ATA": "M", "AGA": "S", "AGG": "S", "AAA": "N"},
    22: {"TCA": "*", "TAG": "L"},
    23: {"TTA": "*"},
    24: {"AGA": "S", "AGG": "K", "TGA": "W"},
    25: {"TGA": "G"},
    26: {"CTG": "A"},
    29: {"TAA": "Y", "TAG": "Y"},
    30: {"TAA": "E", "TAG": "E"},
    33: {"TAA": "Y", "TGA": "W", "AGA": "S", "AGG": "K"},
}
#: Codons of no bases.
SPECIAL = {"NNN": "X", "---": "-", "???": "?"}


def code(table: int) -> dict[str, str]:
    """Codon to amino acid for an NCBI table number."""
    if table not in DELTAS:
        raise ValueError(f"unknown genetic code {table}; known: {', '.join(map(str, DELTAS))}")
    codons = (a + b + c for a in BASES for b in BASES for c in BASES)
    return dict(zip(codons, STANDARD, strict=True)) | DELTAS[table] | SPECIAL
