"""Transforms and compositions by name, and room for more of them.

What is registered on the driver travels to the executors inside the function
that uses it, so a worker needs no registry of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import numpy as np

from . import blocks


@dataclass(frozen=True)
class Transform:
    """``apply`` takes and returns a stack (n, height, width); ``attributes`` stand in the printed form.

    Two transforms are equal if their names are.
    """

    name: str
    complexity: int
    apply: Callable[[np.ndarray], np.ndarray] = field(compare=False)
    attributes: tuple[tuple[str, object], ...] = field(default=(), compare=False)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Transform) and self.name == other.name

    def __hash__(self) -> int:
        return hash(self.name)

    def __str__(self) -> str:
        return f"{self.name}({', '.join(f'{k}={v}' for k, v in self.attributes)})"


def translation(tx: int, ty: int, constant: int = 1) -> Transform:
    """Shift right by tx and down by ty; the border that opens is ``constant``."""
    return Transform("Translation", 3, lambda x: blocks.translate(x, tx, ty, constant), (("tx", tx), ("ty", ty)))


def _own(ti: int) -> Transform:
    return Transform(blocks.TRANSFORM_NAMES[ti], blocks.COMPLEXITIES[ti], lambda x: blocks.transform(x, ti))


TRANSFORMS: dict[str, Transform] = {name: _own(ti) for ti, name in enumerate(blocks.TRANSFORM_NAMES)}
#: Name to (number or None, function of two stacks).
COMPOSITIONS: dict[str, tuple[int | None, Callable]] = {name: (x, lambda a, b, x=x: blocks.compose(a, b, x)) for x, name in blocks.COMPOSITIONS.items()}
COMPOSITIONS["ImageCompIdentityRight"] = (None, lambda a, b: b)


def register_transform(t: Transform) -> Transform:
    """Make ``t`` known by its name; ValueError if the name is taken."""
    if t.name in TRANSFORMS:
        raise ValueError(f"{t.name} is registered already")
    TRANSFORMS[t.name] = t
    return t


def register_composition(name: str, f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> None:
    """Make a function of two stacks known by its name; ValueError if the name is taken.

    It is for direct use; the search of an encoding keeps to its numbered six.
    """
    if name in COMPOSITIONS:
        raise ValueError(f"{name} is registered already")
    COMPOSITIONS[name] = (None, f)


def forget(name: str) -> None:
    """Drop what was registered; KeyError for a name that isn't, ValueError for one that always is."""
    if name in blocks.TRANSFORM_NAMES or name in blocks.COMPOSITIONS.values() or name == "ImageCompIdentityRight":
        raise ValueError(f"{name} cannot be dropped")
    (TRANSFORMS if name in TRANSFORMS else COMPOSITIONS).pop(name)


def resolve(which: Iterable[str | Transform]) -> list[Transform]:
    """Transforms by name or as they are; KeyError for an unknown name."""
    return [t if isinstance(t, Transform) else TRANSFORMS[t] for t in which]


def text(which: Iterable[str | Transform]) -> str:
    """Printed form of a chain."""
    return f"Compose({''.join(map(str, resolve(which)))})"


def complexity(which: Iterable[str | Transform]) -> int:
    return sum(t.complexity for t in resolve(which))
