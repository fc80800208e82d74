"""Parameters of clustering, with derived thresholds."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Params:
    """One run's settings.  ``measure``: "score" (higher is closer) or "dist".

    None stands for a value derived from others, see ``resolved``.
    """

    measure: str = "score"
    cutoff: float | None = None
    miss_ratio: float = 0.95
    miss_score: float | None = None
    miss_dist: float | None = None
    split_cutoff: float | None = None
    split_dist: float | None = None
    split_ratio: float | None = None
    split_per_length: float | None = None
    coverage: float = 0.0
    cov_filter: float = 0.0
    min_species: float = 2
    min_members: int = 2
    cut_ratio: float = 0.5
    weak_ratio: float = 0.0
    weak_dist_ratio: float | None = None
    balance: float | None = None
    absorb_ratio: float = 1.0
    overlap_merge: float = 0.0
    min_overlap: int = 50
    overlap_ratio: float = 0.6
    overlap_ratio2: float = 0.3
    min_len: int = 40
    min_len2: int = 400
    min_alignment: int = 250
    dist_scale: int = 40
    min_cut_count: int = 1
    no_break: bool = False
    no_extend: bool = False
    ignore_truncation: bool = False
    skip_unknown: bool = False
    #: Species of the outgroup; clusters of only these are dropped, and ties across its border are corrected.
    outgroup: tuple[str, ...] = ()
    homology: bool = False
    #: The reference copies the split cutoff before the default cutoff is set, so that
    #: without an explicit cutoff nothing is held against it; False uses the cutoff.
    late_cutoff: bool = True

    @property
    def by_score(self) -> bool:
        return self.measure == "score"

    def resolved(self) -> Params:
        """All derived values filled in."""
        if self.by_score:
            cutoff = 60.0 if self.cutoff is None else self.cutoff
            miss_score = cutoff * self.miss_ratio if self.miss_score is None else self.miss_score
            miss_dist = 270.0 / self.miss_ratio if self.miss_dist is None else self.miss_dist
        else:
            cutoff = 270.0 if self.cutoff is None else self.cutoff
            miss_dist = cutoff / self.miss_ratio if self.miss_dist is None else self.miss_dist
            miss_score = 60.0 * self.miss_ratio if self.miss_score is None else self.miss_score
        split = self.split_cutoff
        if split is None:
            split = 0.0 if self.late_cutoff and (self.cutoff is None or not self.by_score) else cutoff
            split *= 1.0 if self.split_ratio is None else self.split_ratio
        return replace(self, cutoff=cutoff, miss_score=miss_score, miss_dist=miss_dist, split_cutoff=split,
                       dist_scale=max(100, self.dist_scale) if cutoff <= 1 else self.dist_scale,
                       cut_ratio=2.0 if self.homology else self.cut_ratio, no_extend=self.no_extend or self.no_break)

    @property
    def decimals(self) -> int:
        return 2 if self.resolved().cutoff <= 1 else 1
