"""Parameters of a run, with their defaults and cross-checks."""

from __future__ import annotations

from dataclasses import dataclass

METHODS = {0: "iram", 1: "ssvd", 2: "winsvd", 3: "full"}


@dataclass(frozen=True)
class PcaParams:
    """Options of PCA and the EM models; `method` is a name or one of the numbers 0 to 3 (others mean winsvd)."""

    k: int = 10
    method: str | int = "winsvd"
    scale: int | None = None
    max_power: int = 20
    windows: int = 8
    shuffle: bool = True
    seed: int = 101
    em: str | None = None
    oversamples: int = 0
    omega: str = "gaussian"
    max_iter: int = 100
    tol_rsvd: float = 1e-4
    tol_em: float = 1e-5
    tol_maf: float = 1e-6
    lanczos_iter: int = 1000
    lanczos_tol: float = 1e-6
    ncv: int = 0
    maf: float = 0.0
    ploidy: int = 2
    scale_factor: float = 1.0

    def __post_init__(self):
        if isinstance(self.method, int):
            object.__setattr__(self, "method", METHODS.get(self.method, "winsvd"))
        if self.method not in METHODS.values():
            raise ValueError(f"unknown method {self.method!r}")
        if self.k < 1:
            raise ValueError("k must be at least 1")
        if self.method == "winsvd" and (self.windows < 4 or self.windows & (self.windows - 1)):
            raise ValueError("windows must be a power of two, 4 at least")
        if self.em not in (None, "emu", "pcangsd"):
            raise ValueError(f"unknown EM model {self.em!r}")
        if self.em and self.method == "full":
            raise ValueError("EM models need a truncated decomposition")
        if self.ploidy not in (1, 2):
            raise ValueError("ploidy must be 1 or 2")
        if self.maf > 0.5:
            object.__setattr__(self, "maf", 1 - self.maf)
        if not self.oversamples:
            object.__setattr__(self, "oversamples", max(10, self.k))
        if not self.ncv:
            object.__setattr__(self, "ncv", max(20, 2 * self.k + 1))
