"""Variables, bandwidths and formulas: what a model is, apart from the data."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.kernels import UserKernel

CONTINUOUS, UNORDERED, ORDERED = "continuous", "unordered", "ordered"
MAX_LEVELS = 10_000


@dataclass(frozen=True)
class Variable:
    """A column and its kind. levels: of the training data, in order, for categories."""

    name: str
    kind: str = CONTINUOUS
    levels: tuple = ()

    @property
    def numeric_levels(self) -> bool:
        return self.kind == ORDERED and all(isinstance(v, (int, float)) or re.fullmatch(r"-?\d+(\.0*)?", str(v)) for v in self.levels)

    def codes(self) -> np.ndarray:
        """The numbers that stand for the levels: their values if they are numbers, else 1, 2, ..."""
        return np.array([float(v) for v in self.levels]) if self.numeric_levels else np.arange(1.0, len(self.levels) + 1)

    def encode(self) -> Column:
        """The variable as a double. A level that training did not have is -1 for unordered ones and an error else, unless levels are numbers."""
        c = F.col(f"`{self.name}`")
        if self.kind == CONTINUOUS or self.numeric_levels:
            return c.cast("double")
        at = F.array_position(F.array(*(F.lit(str(v)) for v in self.levels)), c.cast("string")).cast("double")
        if self.kind == UNORDERED:
            return F.when(c.isNull(), F.lit(None)).when(at == 0, -1.0).otherwise(at)
        return F.when(at == 0, F.raise_error(F.concat(F.lit(f"{self.name} has a level that the training data lack: "), c.cast("string"))).cast("double")).otherwise(at)


def unordered(name: str) -> Variable:
    return Variable(name, UNORDERED)


def ordered(name: str, levels: tuple | list = ()) -> Variable:
    return Variable(name, ORDERED, tuple(levels))


def variables(df: DataFrame, names: list[str | Variable]) -> list[Variable]:
    """Variables with their kinds, strings as unordered, and the levels that df has. Other types are refused."""
    out = []
    for v in names:
        v = v if isinstance(v, Variable) else Variable(v, "")
        kind = df.schema[v.name].dataType
        if not v.kind:
            if isinstance(kind, T.NumericType):
                v = replace(v, kind=CONTINUOUS)
            elif isinstance(kind, T.StringType):
                v = replace(v, kind=UNORDERED)
            else:
                raise TypeError(f"column {v.name} of type {kind.simpleString()} is neither numeric nor a category")
        if v.kind == CONTINUOUS and not isinstance(kind, T.NumericType):
            raise TypeError(f"column {v.name} is not numeric")
        if v.kind != CONTINUOUS and not v.levels:
            found = [r[0] for r in df.select(f"`{v.name}`").where(F.col(f"`{v.name}`").isNotNull()).distinct().limit(MAX_LEVELS + 1).collect()]
            if len(found) > MAX_LEVELS:
                raise ValueError(f"column {v.name} has over {MAX_LEVELS} levels")
            v = replace(v, levels=tuple(sorted(found)))
        if v.numeric_levels and any(float(x) != int(float(x)) for x in v.levels):
            raise ValueError(f"levels of {v.name} are not whole numbers")
        out.append(v)
    return out


@dataclass(frozen=True)
class Kernel:
    """Types and orders of the kernels; continuous may be a UserKernel. bounds: of continuous variables, by name, finite or not."""

    continuous: str | UserKernel = "gaussian"
    order: int = 2
    unordered: str = "aitchisonaitken"
    ordered: str = "geometric"
    bounds: dict[str, tuple[float, float]] = field(default_factory=dict, hash=False)


@dataclass(frozen=True)
class Bandwidth:
    """Bandwidths of variables: lengths, or weights of categories, or numbers of neighbours. kind: fixed, generalized_nn or adaptive_nn."""

    variables: tuple[Variable, ...]
    h: tuple[float, ...]
    kernel: Kernel = Kernel()
    kind: str = "fixed"
    value: float | None = None
    method: str = "manual"
    evaluations: int = 0

    def __post_init__(self):
        if len(self.h) != len(self.variables):
            raise ValueError("as many bandwidths as variables are needed")
        if self.kind not in ("fixed", "generalized_nn", "adaptive_nn"):
            raise ValueError(f"no bandwidth type {self.kind}")
        for v, h in zip(self.variables, self.h, strict=True):
            if not valid(v, h, self.kernel, self.kind):
                raise ValueError(f"{h} is no bandwidth for {v.name}")

    @property
    def names(self) -> list[str]:
        return [v.name for v in self.variables]

    @property
    def continuous(self) -> list[int]:
        return [i for i, v in enumerate(self.variables) if v.kind == CONTINUOUS]

    def of(self, names: list[str]) -> Bandwidth:
        at = [self.names.index(n) for n in names]
        return replace(self, variables=tuple(self.variables[i] for i in at), h=tuple(self.h[i] for i in at))

    def scale_factors(self, spread: dict[str, float], n: int) -> dict[str, float]:
        """Bandwidths of continuous variables in units of spread times the optimal rate."""
        rate = n ** (-1 / (2 * self.kernel.order + len(self.continuous)))
        return {self.variables[i].name: self.h[i] / (spread[self.variables[i].name] * rate) for i in self.continuous}


def greatest(v: Variable, kernel: Kernel) -> float:
    """The greatest bandwidth of a category."""
    if v.kind == UNORDERED and kernel.unordered == "aitchisonaitken":
        return (len(v.levels) - 1) / len(v.levels) if len(v.levels) > 1 else 0.0
    return 1.0


def valid(v: Variable, h: float, kernel: Kernel, kind: str = "fixed") -> bool:
    if not math.isfinite(h):
        return False
    if v.kind == CONTINUOUS:
        return h > 0 if kind == "fixed" else h >= 1 and h == int(h)
    return 0 <= h <= greatest(v, kernel) + 1e-12


@dataclass(frozen=True)
class Formula:
    left: tuple[str | Variable, ...]
    right: tuple[str | Variable, ...]
    smooth: tuple[str | Variable, ...] = ()


def formula(text: str) -> Formula:
    """y ~ x1 + x2, ~ x, y1 + y2 ~ x, or y ~ x | z; names may stand in factor() or ordered(). A plus only separates."""

    def side(part: str) -> tuple:
        out = []
        for item in filter(None, (x.strip() for x in part.split("+"))):
            m = re.fullmatch(r"(factor|ordered)\(\s*([^()]+?)\s*\)", item)
            out.append(item if not m else unordered(m[2]) if m[1] == "factor" else ordered(m[2]))
        return tuple(out)

    if text.count("~") != 1 or text.count("|") > 1:
        raise ValueError(f"no formula: {text}")
    left, right = text.split("~")
    x, _, z = right.partition("|")
    found = Formula(side(left), side(x), side(z))
    if not found.right:
        raise ValueError(f"no variables on the right: {text}")
    return found
