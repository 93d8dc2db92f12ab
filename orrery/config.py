"""Parameters of an index, a search and an evaluation; all of them are stored with what they made."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, field


def padded(dim: int) -> int:
    """The next multiple of 64."""
    return -(-dim // 64) * 64


@dataclass(frozen=True)
class IndexConfig:
    dim: int
    metric: str = "l2"
    bits: int = 9
    memdim: int | None = None
    store: str = "exbits"
    faster: bool = False
    num_clusters: int | None = None
    inner_size: int = 1000
    seed: int = 0
    certain: bool = False  # raw vectors in double precision, and bounds that always hold: a search is exact

    def __post_init__(self) -> None:
        if self.metric not in ("l2", "ip"):
            raise ValueError("metric is l2 or ip")
        if not 1 <= self.bits <= 9:
            raise ValueError("bits are 1 to 9")
        if self.store not in ("exbits", "raw"):
            raise ValueError("store is exbits or raw")
        if not 64 <= self.dim < 4096:
            raise ValueError("the rotation takes 64 to 4095 dimensions")
        m = self.prefix
        if m % 64 or not 64 <= m <= self.width:
            raise ValueError("memdim is a multiple of 64 up to the padded width")
        if self.certain and (self.store != "raw" or m < self.width):
            raise ValueError("certain bounds take raw vectors and no prefix")
        if self.bits == 1 and m < self.width and self.store == "exbits":
            raise ValueError("one bit and a shorter prefix leave nothing to re-rank by")

    @property
    def width(self) -> int:
        return padded(self.dim)

    @property
    def prefix(self) -> int:
        return self.width if self.memdim is None else self.memdim

    @property
    def ex_bits(self) -> int:
        return 0 if self.store == "raw" else self.bits - 1

    def clusters(self, rows: int) -> int:
        return self.num_clusters or max(1, math.ceil(rows / 1024))

    def record_bytes(self, element: int = 4) -> int:
        """Bytes of a vector's payload record."""
        if self.store == "raw":
            return self.dim * element
        rest = (self.width - self.prefix) // 8
        return rest + (self.width * self.ex_bits // 8 + 8 if self.ex_bits else 0)

    def meta(self) -> dict:
        return asdict(self) | {"width": self.width, "prefix": self.prefix}


@dataclass(frozen=True)
class SearchConfig:
    k: int = 100
    nprobe: int = 8
    drain_alpha: float = 1.0
    coarse: str = "auto"
    irq_mode: str = "kfixedmult"
    irq_mult: float = 0.5
    use_hacc: bool = True  # accepted; dots are always full precision here

    def __post_init__(self) -> None:
        if self.k < 1 or self.nprobe < 1:
            raise ValueError("k and nprobe are at least 1")
        if not 0 <= self.drain_alpha <= 1:
            raise ValueError("drain_alpha is between 0 and 1")
        if self.coarse not in ("auto", "flat", "irq", "hnsw"):
            raise ValueError("coarse is auto, flat, irq or hnsw")

    def coarse_kind(self, clusters: int) -> str:
        """Flat below 20,000 clusters; two-level probing (also what hnsw stands for) above."""
        return ("flat" if clusters < 20_000 else "irq") if self.coarse == "auto" else self.coarse


@dataclass(frozen=True)
class EvalConfig:
    low: float = 0.80
    high: float = 0.98
    step: float = 0.01
    plateau: float = 0.99
    high_keep: int = 2
    low_keep: int = 4
    marks: tuple[float, ...] = field(default=(0.90, 0.95))


PAGE = 4096


def page_layout(record: int) -> tuple[int, int]:
    """Records a read and pages a read of payload records; without payload, groups of 8."""
    return (max(1, PAGE // record), -(-record // PAGE)) if record else (8, 0)
