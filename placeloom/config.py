"""Recipes: a flat mapping with defaults in code; unknown keys are errors."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

from .operators.history import descriptor_width, token_grid
from .operators.sets import TEST_CITIES


@dataclass(frozen=True)
class Backbone:
    width: int
    heads: int
    registers: int


#: Encoder sizes.
BACKBONES = {"small": Backbone(384, 6, 0), "base": Backbone(768, 12, 4)}


@dataclass(frozen=True)
class Recipe:
    representation: str = "accumulate"
    window_ms: float = 50.0
    width: int = 346
    height: int = 260
    image_height: int = 224
    image_width: int = 224
    patch: int = 14
    clusters: int = 64
    cluster_dim: int = 256
    token_dim: int = 256
    projection: int | None = None
    places_per_batch: int = 64
    images_per_place: int = 4
    lr: float = 5e-5
    min_lr: float = 1e-6
    warmup_steps: int = 500
    decay_steps: int = 10_000
    top_k: int = 10
    radius_m: float = 25.0
    seed: int = 0
    streams: tuple[str, ...] = ()
    validation_cities: tuple[str, ...] = ("cph", "sf")
    exclude_cities: tuple[str, ...] = ()
    mean: tuple[float, float, float] = (0.9, 0.9, 0.9)
    std: tuple[float, float, float] = (0.2, 0.2, 0.2)
    extra: dict = field(default_factory=dict)

    def __post_init__(self):
        token_grid(self.image_height, self.image_width, self.patch)
        if self.representation not in ("accumulate", "countmask", "polmask", "tencode"):
            raise ValueError(f"unknown representation {self.representation!r}")
        low = {c.lower() for c in self.exclude_cities}
        if missing := [c for c in self.validation_cities if c.lower() not in low]:  # they never train
            object.__setattr__(self, "exclude_cities", (*self.exclude_cities, *missing))

    @property
    def tokens(self) -> int:
        """Patch tokens of an image."""
        rows, columns = token_grid(self.image_height, self.image_width, self.patch)
        return rows * columns

    def at_size(self, side: int) -> Recipe:
        """The recipe for square images of another size, a multiple of the patch."""
        return replace(self, image_height=side, image_width=side)

    @property
    def descriptor_width(self) -> int:
        return self.projection or descriptor_width(self.clusters, self.cluster_dim, self.token_dim)


def recipe(values: dict) -> Recipe:
    known = {f.name for f in fields(Recipe)}
    if unknown := sorted(set(values) - known):
        raise ValueError(f"unknown recipe keys {unknown}")
    return Recipe(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})


def read_recipe(path: str) -> Recipe:
    """A JSON file, or YAML where a YAML library is installed."""
    text = Path(path).read_text()
    if path.endswith((".yaml", ".yml")):
        import yaml

        values = yaml.safe_load(text)
    else:
        values = json.loads(text)
    if not isinstance(values, dict):
        raise ValueError("a recipe is a mapping")
    return recipe(values)


__all__ = ["TEST_CITIES", "Recipe", "read_recipe", "recipe"]
