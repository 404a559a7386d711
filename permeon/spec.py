"""What an analysis is: validated settings with a JSON form that is keyed by name."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field, fields, replace

import numpy as np

ARRAYS = ("design", "contrast", "f_contrast", "exchangeability", "variance_groups")


@dataclass
class AnalysisSpec:
    """design: samples x regressors. contrast: rows. f_contrast: which rows form the F-contrast, as a boolean mask or a list of
    indices. stat and f_stat: 'auto', 'pearson' or f(Y, M, C, groups) -> (statistic, df1, df2). orders: given row orders
    (permutations x samples, or a sequence such as exchange.HashOrders) instead of drawn ones, the same for every contrast."""

    design: np.ndarray
    contrast: np.ndarray
    f_contrast: np.ndarray | None = None
    f_only: bool = False
    two_tailed: bool = True
    exchangeability: np.ndarray | None = None
    variance_groups: np.ndarray | None = None
    vg_auto: bool = False
    within: bool | None = None
    whole: bool | None = None
    flip_signs: bool = False
    stat: str | Callable = "auto"
    f_stat: str | Callable = "auto"
    permutations: int = 1000
    seed: int | None = 42
    demean: bool = False
    zstat: bool = False
    accel_tail: bool = False
    accel_method: str = "MOM"
    across_contrasts: bool = False
    one_minus_p: bool = False
    neg_log10_p: bool = False
    tfce: bool = False
    return_permutations: bool = False
    orders: Sequence | np.ndarray | None = field(default=None, repr=False)

    def __post_init__(self) -> None:
        from .design import contrast_rows

        self.design = np.asarray(self.design, np.float64)
        self.design = self.design[:, None] if self.design.ndim == 1 else self.design
        if np.ndim(self.contrast) > 2:
            raise ValueError("a contrast has one or two dimensions")
        self.contrast = contrast_rows(self.contrast)
        if self.contrast.shape[1] != self.design.shape[1]:
            raise ValueError(f"the contrast has {self.contrast.shape[1]} entries a row, the design {self.design.shape[1]} columns")
        if self.permutations <= 0:
            raise ValueError("the number of permutations must be positive")
        for name in ("exchangeability", "variance_groups"):
            value = getattr(self, name)
            if value is not None and len(value) != len(self.design):
                raise ValueError(f"{name} has {len(value)} rows, the design {len(self.design)}")
        if self.one_minus_p and self.neg_log10_p:
            raise ValueError("choose one of 1 - p and -log10 p")
        if self.f_contrast is not None:
            mask = np.ravel(self.f_contrast)
            if mask.dtype != bool and not (len(mask) == len(self.contrast) and set(mask.tolist()) <= {0, 1}):
                mask = np.isin(np.arange(len(self.contrast)), mask)
            self.f_contrast = mask.astype(bool)
            if len(self.f_contrast) != len(self.contrast):
                raise ValueError("the F mask has an entry for each contrast row")
        if self.f_only and self.f_contrast is None:
            raise ValueError("f_only needs an F-contrast")

    def labels(self) -> dict[str, np.ndarray]:
        """c1, c2, .. and f, with their contrast rows."""
        out = {} if self.f_only else {f"c{i + 1}": row[None, :] for i, row in enumerate(self.contrast)}
        if self.f_contrast is not None:
            out["f"] = self.contrast[self.f_contrast]
        return out

    def groups(self) -> np.ndarray | None:
        """Variance groups; None if all samples share one."""
        from .exchange import variance_groups

        found = self.variance_groups
        if found is None and self.vg_auto and self.exchangeability is not None:
            found = variance_groups(self.exchangeability, self.within, self.whole)
        return None if found is None or len(np.unique(found)) < 2 else np.asarray(found)

    def to_json(self) -> str:
        given = None if self.orders is None else [np.asarray(o).tolist() for o in self.orders]
        out = {k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in asdict(replace(self, orders=None)).items()} | {"orders": given}
        named = [k for k in ("stat", "f_stat") if callable(out[k])]
        if named:
            raise ValueError(f"functions have no JSON form: {named}")
        return json.dumps(out, indent=1)

    @classmethod
    def from_json(cls, text: str) -> AnalysisSpec:
        given = json.loads(text)
        unknown = set(given) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return cls(**{k: np.asarray(v) if k in (*ARRAYS, "orders") and v is not None else v for k, v in given.items()})
