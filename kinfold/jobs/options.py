"""Parameters of the calling jobs and of what they write."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Options:
    """Parameters of a run. compat: reproduce a known quirk of earlier tools where the output differs."""

    cutoff: float = 0.5
    theta: float = 0.001
    indel_theta: float = 0.0001
    poly_tstv: float = 2.0
    prec: float = 1e-4
    denovo: bool = False
    rate_denovo: float = 1.5e-8
    tstv_denovo: float = 2.0
    min_llr_denovo: float = 0.01
    chromosomes: tuple[str, ...] = ()
    min_depth: int = 0
    max_depth: int = 0
    min_map_quality: float = 0
    min_percent_with_data: float = 0
    all_sites: bool = False
    quick_call: bool = False
    gl_off: bool = False
    chrom_x: str = "X"
    chrom_y: str = "Y"
    chrom_mt: str = "MT"
    batch: int = 2_000
    compat: bool = False
