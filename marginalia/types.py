"""Value objects: the discrete domain and the column specifications of a table."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from dataclasses import asdict, dataclass, field
from math import prod

Clique = tuple[str, ...]


class Domain:
    """Ordered attributes with their numbers of cells."""

    def __init__(self, attrs: Iterable[str], shape: Iterable[int]):
        self.attrs, self.shape = tuple(attrs), tuple(int(n) for n in shape)
        if len(self.attrs) != len(self.shape) or len(set(self.attrs)) != len(self.attrs):
            raise ValueError("attributes and sizes must match and names must differ")
        self.sizes = dict(zip(self.attrs, self.shape, strict=True))

    @classmethod
    def of(cls, sizes: Mapping[str, int]) -> Domain:
        return cls(sizes.keys(), sizes.values())

    def project(self, attrs: Iterable[str] | str) -> Domain:
        attrs = (attrs,) if isinstance(attrs, str) else tuple(attrs)
        return Domain(attrs, (self.sizes[a] for a in attrs))

    def marginalize(self, attrs: Iterable[str]) -> Domain:
        gone = set(attrs)
        return self.project(a for a in self.attrs if a not in gone)

    def invert(self, attrs: Iterable[str]) -> Clique:
        gone = set(attrs)
        return tuple(a for a in self.attrs if a not in gone)

    def canonical(self, attrs: Iterable[str]) -> Clique:
        wanted = set(attrs)
        return tuple(a for a in self.attrs if a in wanted)

    def merge(self, other: Domain) -> Domain:
        return Domain.of(self.sizes | {a: n for a, n in other.sizes.items() if a not in self.sizes})

    def contains(self, other: Domain) -> bool:
        return set(other.attrs) <= set(self.attrs)

    def axes(self, attrs: Iterable[str]) -> tuple[int, ...]:
        return tuple(self.attrs.index(a) for a in attrs)

    def transpose(self, attrs: Iterable[str]) -> Domain:
        return self.project(attrs)

    def size(self, attrs: Iterable[str] | None = None) -> int:
        return prod(self.shape if attrs is None else (self.sizes[a] for a in attrs))

    def sort(self, how: str = "size") -> Domain:
        return self.project(sorted(self.attrs, key=(lambda a: (self.sizes[a], a)) if how == "size" else (lambda a: a)))

    def __getitem__(self, attr: str) -> int:
        return self.sizes[attr]

    def __contains__(self, attr: str) -> bool:
        return attr in self.sizes

    def __iter__(self) -> Iterator[str]:
        return iter(self.attrs)

    def __len__(self) -> int:
        return len(self.attrs)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Domain) and self.attrs == other.attrs and self.shape == other.shape

    def __hash__(self) -> int:
        return hash((self.attrs, self.shape))

    def __repr__(self) -> str:
        return f"Domain({self.sizes})"


@dataclass(frozen=True)
class ColumnSpec:
    """What the user knows about a column: bounds of a numeric one or the categories of another."""

    lower: float | None = None
    upper: float | None = None
    categories: tuple | None = None

    @classmethod
    def of(cls, given: Mapping | ColumnSpec | None) -> ColumnSpec:
        if given is None or isinstance(given, cls):
            return given or cls()
        cats = given.get("categories")
        return cls(given.get("lower"), given.get("upper"), None if cats is None else tuple(cats))


@dataclass
class Binning:
    """A fitted numeric column: edges in the unit of its long or double form, and impossible intervals."""

    column: str
    kind: str  # double, long, timestamp, timestamp_ntz, date, interval
    edges: list[float]
    method: str = "uniform"
    zeros: list[tuple[float, float]] = field(default_factory=list)
    spent: float = 0.0

    @property
    def n_bins(self) -> int:
        return len(self.edges) - 1

    @property
    def bounds(self) -> tuple[float, float]:
        """Least and greatest value that has a bin of its own."""
        return self.edges[0], self.edges[-1]

    def bin_bounds(self, k: int) -> tuple[float, float]:
        return self.edges[k], self.edges[k + 1]

    def to_json(self) -> dict:
        return asdict(self)


@dataclass
class Encoding:
    """A fitted categorical column: its values in order of code."""

    column: str
    values: list
    impossible: list = field(default_factory=list)

    @property
    def n_bins(self) -> int:
        return max(1, len(self.values))

    def to_json(self) -> dict:
        return asdict(self)
