"""Limits of what one request may ask; checked before a plan is made."""

from __future__ import annotations

#: Genes of an alignment, neighbourhoods and sequences of a view, sequences and columns of a rate, characters of a view, ids of a list, members of a large cluster. Fixed values.
ALIGNED, TRACKS, RATED, RATED_COLUMNS, TRACK_COLUMNS, TRACK_CHARACTERS, IDS, LARGE = 600, 150, 200, 30_000, 15_000, 800_000, 2_000, 500


def listed_ids(ids: list[str]) -> list[str]:
    """The first IDS ids that are not blank, trimmed."""
    return [i.strip() for i in map(str, ids) if i.strip()][:IDS]


def aligned(ids: list[str]) -> list[str]:
    """Distinct ids in their order: from 2 to ALIGNED."""
    out = list(dict.fromkeys(i.strip() for i in ids if i.strip()))
    if not 2 <= len(out) <= ALIGNED:
        raise ValueError(f"2 to {ALIGNED} genes can be aligned, not {len(out)}")
    return out


def tracks(n: int, least: int = 1) -> None:
    if not least <= n <= TRACKS:
        raise ValueError(f"{least} to {TRACKS} tracks, not {n}")


def ordered(sequences: dict[str, str]) -> None:
    tracks(len(sequences), 2)
    if len(next(iter(sequences.values()))) > TRACK_COLUMNS or sum(map(len, sequences.values())) > TRACK_CHARACTERS:
        raise ValueError("the sequences are too long to be ordered")


def rated(alignment: dict[str, str], reference: str) -> None:
    if reference not in alignment:
        raise ValueError("the reference is not in the alignment")
    if len(alignment) > RATED or max(map(len, alignment.values())) > RATED_COLUMNS:
        raise ValueError(f"up to {RATED} sequences of up to {RATED_COLUMNS} columns")


def is_large(members: int) -> bool:
    """Whether a cluster's views need to be confirmed first."""
    return members > LARGE
