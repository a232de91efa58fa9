"""Training configuration, checked when it is made; ``embedding.run`` reads it."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

# Other names that configuration files have for a field.
ALIASES = {"K": "k", "num_epochs": "epochs"}


@dataclass(frozen=True)
class Config:
    files: tuple[str, ...] = ()
    directories: tuple[str, ...] = ()
    skip: tuple[str, ...] = ()
    parser: str = "text"
    k: int | None = None
    stride: int = 1
    canonical: bool = False
    min_frequency: int = 0
    load_dictionary_dir: str | None = None
    kernel: tuple[int, ...] = (1, 2, 3, 4, 5, 5, 4, 3, 2, 1)
    t: float = 1e-5
    noise_ratio: int = 15
    batch_size: int = 1000
    dims: int = 100
    epochs: int = 10
    rate: float = 0.001
    blocks: int = 8
    #: Share of the sentences that are trained on; the others give the validation loss.
    split: float = 0.75
    seed: int = 42
    save_dir: str | None = None
    log_path: str | None = None
    extra: dict = field(default_factory=dict)

    def __post_init__(self):
        if len(self.kernel) % 2 or not self.kernel:
            raise ValueError("a kernel has a weight for each of 2K offsets")
        if not 0 < self.split < 1:
            raise ValueError("split must lie between 0 and 1")
        if self.stride < 1 or (self.k is not None and self.k < 1):
            raise ValueError("k and stride must be at least 1")
        if min(self.noise_ratio, self.batch_size, self.dims, self.blocks) < 1:
            raise ValueError("noise_ratio, batch_size, dims and blocks must be at least 1")

    @classmethod
    def from_mapping(cls, values: dict) -> Config:
        """From a mapping such as a YAML file's; unknown keys are kept in extra."""
        known = {f.name for f in fields(cls)}
        own, extra = {}, {}
        for key, value in values.items():
            key = ALIASES.get(key, key)
            value = tuple(value) if isinstance(value, list) else value
            (own if key in known else extra)[key] = value
        return cls(**own, extra=extra)

    @classmethod
    def from_yaml(cls, path: str) -> Config:
        import yaml

        with open(path) as f:
            return cls.from_mapping(yaml.safe_load(f) or {})
