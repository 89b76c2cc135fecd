"""Named parameters with presets, as immutable values that are passed to operators."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Params:
    """Defaults of the aligner and of the breakpoint caller."""

    seeding: str = "max span"
    min_seed: int = 16
    min_ambiguity: int = 0
    max_ambiguity: int = 100
    max_strips: int = 30
    min_strips: int = 1
    strip_width: int = 0
    report_best: int = 0
    min_score: int = 75
    max_supplementary_overlap: float = 0.1
    supplementary_per_primary: int = 1
    match: int = 2
    mismatch: int = 4
    gap: int = 4
    extend: int = 2
    gap2: int = 24
    extend2: int = 1
    padding: int = 1000
    bandwidth: int = 512
    z_drop: int = 200
    inversion_z_drop: int = 100
    mate_mean: float = 400.0
    mate_std: float = 150.0
    mate_factor: float = 1.25
    minimizer_k: int = 15
    minimizer_w: int = 10
    min_dummy: int = 50
    max_dummy: int = 60
    min_reads: int = 2
    max_fuzziness: int = 50
    coverage_bin: int = 100

    def with_(self, **changes) -> Params:
        return replace(self, **changes)

    @classmethod
    def names(cls) -> list[str]:
        return [f.name for f in fields(cls)]


#: Presets by the kind of reads.
PRESETS: dict[str, Params] = {
    "default": Params(),
    "illumina": Params(seeding="smems", max_ambiguity=500, max_strips=20, min_strips=10),
    "pacbio": Params(supplementary_per_primary=100, min_strips=5),
    "nanopore": Params(seeding="smems", supplementary_per_primary=100, min_strips=5),
    "sv-illumina": Params(max_ambiguity=1, min_reads=10),
    "sv-pacbio": Params(max_ambiguity=1, strip_width=3000),
}


def preset(name: str) -> Params:
    if name not in PRESETS:
        raise KeyError(f"no preset {name!r}; there are {sorted(PRESETS)}")
    return PRESETS[name]
