"""Tuning options: typed values, names as dotted strings, and the grammar of substructure lists."""

from __future__ import annotations

import dataclasses
import os
import re

from gridloom.errors import OptionError

LINEAR = ("h", "v", "d", "ad")
BLOCK_ROWS = tuple(f"br{k}" for k in range(1, 9))
BLOCK_COLS = tuple(f"bc{k}" for k in range(1, 9))
TYPES = (*LINEAR, *BLOCK_ROWS, *BLOCK_COLS)
#: Order in which ties between types are settled, and the number a pattern id starts with.
TYPE_ORDER = {"none": 0} | {t: k for k, t in enumerate(TYPES, 1)}
_GROUPS = {"br": BLOCK_ROWS, "bc": BLOCK_COLS, "all": TYPES}


def alignment(kind: str) -> int:
    """Rows (``br``) or columns (``bc``) of a block type, 0 for other types."""
    return int(kind[2:]) if kind[:2] in ("br", "bc") else 0


def parse_types(text: str) -> dict[str, tuple[int, ...]]:
    """``"h,br3{2,4},d{1}"`` -> type: strides or widths to encode, empty for all; groups expand; ``none`` is nothing."""
    out: dict[str, tuple[int, ...]] = {}
    rest = text.strip()
    while rest:
        m = re.match(r"([a-z]+\d*)\s*(?:\{\s*([\d\s,]*)\})?\s*(?:,|$)\s*", rest)
        if not m:
            raise OptionError(f"can't read {rest!r} in {text!r}")
        name, given = m[1], tuple(int(x) for x in (m[2] or "").replace(",", " ").split())
        for t in _GROUPS.get(name, (name,)):
            if t != "none" and t not in TYPES:
                raise OptionError(f"no substructure type {t!r}")
            if t != "none":
                out[t] = given
        rest = rest[m.end() :]
    return out


def format_types(types: dict[str, tuple[int, ...]]) -> str:
    return ",".join(t + ("{" + ",".join(map(str, d)) + "}" if d else "") for t, d in types.items()) or "none"


def _flag(x) -> bool:
    if str(x).lower() in ("true", "1"):
        return True
    if str(x).lower() in ("false", "0"):
        return False
    raise OptionError(f"{x!r} is neither true nor false")


@dataclasses.dataclass
class Options:
    parts: int = 1
    heuristic: str = "ratio"
    types: str = "all"
    sampling: str = "portion"
    samples: int = 48
    portion: float = 0.01
    window: int = 0
    symmetric: bool = False
    split_blocks: bool = True
    one_dim_blocks: bool = False
    min_unit: int = 4
    max_unit: int = 255
    min_coverage: float = 0.1

    def __post_init__(self):
        self.check()

    def check(self) -> None:
        parse_types(self.types)
        for bad, why in (
            (self.heuristic not in ("ratio", "cost"), "heuristic is ratio or cost"),
            (self.sampling not in ("none", "window", "portion"), "sampling is none, window or portion"),
            (self.parts < 1, "parts must be positive"),
            (self.samples <= 0, "samples must be positive"),
            (not 0 < self.portion <= 1, "portion must lie in (0, 1]"),
            (self.sampling == "window" and self.window <= 0, "window must be positive"),
            (not 1 < self.min_unit <= self.max_unit <= 255, "units need 1 < min <= max <= 255"),
        ):
            if bad:
                raise OptionError(why)


#: Dotted name -> field.
NAMES = {
    "rt.nr_threads": "parts",
    "preproc.heuristic": "heuristic",
    "preproc.xform": "types",
    "preproc.sampling": "sampling",
    "preproc.sampling.nr_samples": "samples",
    "preproc.sampling.portion": "portion",
    "preproc.sampling.window_size": "window",
    "matrix.symmetric": "symmetric",
    "matrix.split_blocks": "split_blocks",
    "matrix.onedim_blocks": "one_dim_blocks",
    "matrix.min_unit_size": "min_unit",
    "matrix.max_unit_size": "max_unit",
    "matrix.min_coverage": "min_coverage",
}
#: Accepted, without effect on Spark: placement of threads and width of stored column numbers.
IGNORED = {"rt.cpu_affinity", "matrix.full_colind"}
ENVIRONMENT = {
    "NUM_THREADS": ("rt.nr_threads", None),
    "XFORM_CONF": ("preproc.xform", None),
    "SAMPLING": ("preproc.sampling", None),
    "SAMPLES": ("preproc.sampling.nr_samples", None),
    "SAMPLING_PORTION": ("preproc.sampling.portion", "portion"),
    "WINDOW_SIZE": ("preproc.sampling.window_size", "window"),
    "SYMMETRIC": ("matrix.symmetric", None),
}


def set_option(options: Options, name: str, value) -> Options:
    """New options with one set by its dotted name; unknown names and values raise."""
    if name in IGNORED:
        return options
    if name not in NAMES:
        raise OptionError(f"no option {name!r}")
    field = NAMES[name]
    kind = type(getattr(options, field))
    try:
        parsed = _flag(value) if kind is bool else kind(value)
    except ValueError as e:
        raise OptionError(f"{name}: {e}") from e
    return dataclasses.replace(options, **{field: parsed})


def from_environment(options: Options | None = None, env=os.environ) -> Options:
    options = options or Options()
    for var, (name, mode) in ENVIRONMENT.items():
        if var in env:
            options = set_option(options, name, env[var])
            if mode:
                options = dataclasses.replace(options, sampling=mode)
    return options
