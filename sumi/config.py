"""Settings with the defaults of the batch pipeline, their checks, and their precedence: given > file > default."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import os
import tomllib
from dataclasses import dataclass, field
from pathlib import Path


@dataclass(frozen=True)
class Heal:
    enabled: bool = False
    kernel: int = 3
    iterations: int = 1
    directions: tuple[str, ...] = ("iso", "h", "v")
    bilateral: bool = False


@dataclass(frozen=True)
class Ink:
    enabled: bool = True
    blackhat_kernel: int = 9
    strength: float = 0.6
    unsharp: float = 0.2


@dataclass(frozen=True)
class Contrast:
    alpha: float = 1.5
    beta: float = 10
    clahe_clip: float = 2.0
    clahe_tiles: int = 8


@dataclass(frozen=True)
class Refine:
    mode: str = "ccprojection"
    expand: tuple[int, int, int, int] = (2, 2, 4, 2)  # left, right, top, bottom
    final_pad: int = 0


@dataclass(frozen=True)
class Trim:
    binarize: str = "otsu"
    adaptive_block: int = 31
    adaptive_c: int = 3
    run_ratio: float = 0.01
    run_least: float = 0.005
    tighten: float = 0.01
    detect: tuple[float, float, float, float] = (0.25, 0.25, 0.3, 0.5)  # left, right, top, bottom
    cut: tuple[float, float, float, float] = (0.2, 0.2, 0.2, 0.4)


@dataclass(frozen=True)
class ComponentFilter:
    touch_margin: int = 1
    zone_margin: int = 2
    touch_ratio: float = 0.02
    zone_ratio: float = 0.01
    interior_ratio: float = 0.004
    max_aspect: float = 6.0
    min_dim: int = 4


@dataclass(frozen=True)
class Border:
    enabled: bool = True
    iterations: int = 5
    width_ratio: float = 0.2
    threshold: float = 0.35
    spike_least: float = 0.02
    spike_most: float = 0.08
    gradient: float = 0.4
    prominence: float = 0.5
    tolerance: int = 4
    detect: tuple[float, float] = (0.3, 0.3)  # top, bottom
    cut: tuple[float, float] = (0.5, 0.5)
    #: "outermost": a right spike is cut from its outermost column on; "symmetric": it is cut whole, like a left one.
    right_cut: str = "outermost"


@dataclass(frozen=True)
class Noise:
    enabled: bool = True
    dark: int = 60
    light: int = 230
    least_area: int = 3
    most_area: int = 100_000
    large_area: int = 50
    max_aspect: float = 15.0
    slender_area: int = 20


@dataclass(frozen=True)
class Judge:
    enabled: bool = True
    temperature: float = 0.0
    max_tokens: int = 256
    timeout: float = 60.0
    workers: int = 16
    retries: int = 3


@dataclass(frozen=True)
class Settings:
    heal: Heal = field(default_factory=Heal)
    ink: Ink = field(default_factory=Ink)
    contrast: Contrast = field(default_factory=Contrast)
    refine: Refine = field(default_factory=Refine)
    trim: Trim = field(default_factory=Trim)
    components: ComponentFilter = field(default_factory=ComponentFilter)
    border: Border = field(default_factory=Border)
    noise: Noise = field(default_factory=Noise)
    judge: Judge = field(default_factory=Judge)

    def digest(self) -> str:
        """Results are cached under it, so a change of settings makes them stale."""
        return hashlib.sha256(json.dumps(dataclasses.asdict(self), sort_keys=True).encode()).hexdigest()[:16]

    def check(self) -> None:
        for name, x in (("trim.detect", self.trim.detect), ("trim.cut", self.trim.cut), ("border.detect", self.border.detect), ("border.cut", self.border.cut)):
            if any(not 0 <= v <= 1 for v in x):
                raise ValueError(f"{name}: ratios lie in 0..1, got {x}")
        if any(v < 0 for v in self.refine.expand):
            raise ValueError(f"refine.expand: at least 0, got {self.refine.expand}")

    def summary(self) -> str:
        return "\n".join(f"{group}: " + ", ".join(f"{k}={v}" for k, v in values.items()) for group, values in dataclasses.asdict(self).items())


@dataclass(frozen=True)
class ContourJob:
    enhance: bool = True
    clahe_clip: float = 4.0
    clahe_tile: int = 8
    sat_factor: float = 1.2
    gamma: float = 1.0
    use_enhanced_for_mask: bool = True
    method: str = "auto"
    invert: str = "auto"
    min_area: float = 0.005
    bilateral: bool = True
    morph: bool = True
    close_k: int = 7
    open_k: int = 5
    close_iter: int = 2
    open_iter: int = 1
    external: bool = True
    keep_biggest: bool = True
    chain: str = "none"
    simplify: float = 0.0
    thickness: int = 2
    texture: bool = True
    texture_method: str = "canny"
    texture_sigma: float = 0.33
    texture_thresh: str | float = "auto"
    texture_close_k: int = 3
    texture_blur_ksize: int = 3
    use_enhanced_for_texture: bool = True


@dataclass(frozen=True)
class TextureJob:
    enhance: bool = True
    clahe_clip: float = 4.0
    clahe_tile: int = 8
    sat_factor: float = 1.2
    gamma: float = 1.0
    use_enhanced: bool = True
    texture_method: str = "fusion"
    texture_sigma: float = 0.33
    texture_thresh: str | float = "auto"
    texture_close_k: int = 3
    texture_blur_ksize: int = 3


def load(kind: type, path: str | None = None, auto: tuple[str, ...] = (), given: dict | None = None):
    """A job's settings: what is given, else the TOML file (the path, or the first automatic place that exists)."""
    place = path or next((p for p in auto if Path(p).is_file()), None)
    if path and not Path(path).is_file():
        raise FileNotFoundError(path)
    values = tomllib.loads(Path(place).read_text(encoding="utf-8")) if place else {}
    values |= {k: v for k, v in (given or {}).items() if v is not None}
    names = {f.name for f in dataclasses.fields(kind)}
    return kind(**{k: v for k, v in values.items() if k in names})


def env(name: str, default: str | None = None) -> str | None:
    return os.environ.get(name, default)


def env_int(name: str, default: int) -> int:
    """The default where the variable is unset or no integer."""
    try:
        return int(os.environ.get(name, ""))
    except ValueError:
        return default
