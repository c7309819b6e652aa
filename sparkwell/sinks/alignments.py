"""Alignments as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_fasta(aligned: DataFrame, label: str = "seq_id", sequence: str = "gapped") -> DataFrame:
    """One ``line`` for each row, header and sequence; writing them in order of ``label`` gives the file."""
    return aligned.select(label, F.format_string(">%s\n%s", F.col(label), F.col(sequence)).alias("line"))


def as_blocks(rows: list[tuple[str, str]], width: int = 60, label_width: int = 16) -> str:
    """Blocks of ``width`` columns; the first row is the reference, in whose columns the others show a dot where they agree."""
    if not rows:
        return ""
    ref = rows[0][1]
    blocks = []
    for start in range(0, len(ref), width):
        lines = []
        for i, (name, seq) in enumerate(rows):
            part = seq[start : start + width]
            shown = part if i == 0 else "".join("." if a == b != "-" else a for a, b in zip(part, ref[start:], strict=False))
            short = name if len(name) <= label_width else name[: label_width - 1] + "…"
            lines.append(f"{short:<{label_width}} {shown}")
        blocks.append("\n".join(lines))
    return "\n\n".join(blocks) + "\n"
