"""What two parties agree on: scheme, sizes, seeds and fields of an encoding; blocking groups and their parameters."""

from __future__ import annotations

import json
import math
import re
from dataclasses import asdict, dataclass, replace

from pyspark.sql import types as T

from .javarand import draws, permutation

SCHEMES = ("CLK", "FBF", "RBF")
ENCODABLE = ("int", "bigint", "float", "double", "boolean", "string")


def dynamic_size(grams: float, k: int) -> int:
    """Bits at which a filter of so many q-grams and k hashes is half full on average."""
    return math.ceil(1 / (1 - 0.5 ** (1 / (grams * k))))


def weighted_size(sizes: list[int], weights: list[float]) -> int:
    """The least row filter of which each field's weighted share is as long as its own filter."""
    return max(int(n / w) for n, w in zip(sizes, weights, strict=True))


@dataclass(frozen=True)
class EncodingSpec:
    """scheme, fields to encode, size of each field's filter, bits in all, hashes, q; for RBF the bits drawn from each
    field, the seed of each draw and the seed of the permutation."""

    scheme: str
    fields: tuple[str, ...]
    sizes: tuple[int, ...]
    bits: int
    k: int
    q: int
    drawn: tuple[int, ...] = ()
    seeds: tuple[int, ...] = ()
    permutation_seed: int = 0

    @staticmethod
    def make(
        scheme: str,
        fields: list[str],
        k: int = 15,
        q: int = 2,
        bits: int = 0,
        field_bits: int = 0,
        grams: list[float] | None = None,
        weights: list[float] | None = None,
        seeds: list[int] | None = None,
        permutation_seed: int = 0,
    ) -> EncodingSpec:
        """CLK: ``bits``.  FBF: ``field_bits`` a field, or sizes from the mean q-gram counts ``grams``.  RBF: either, and
        ``bits`` in all, drawn evenly, or drawn by ``weights``."""
        if scheme not in SCHEMES:
            raise ValueError(f"{scheme!r} is none of {SCHEMES}")
        if not fields or len(set(fields)) != len(fields):
            raise ValueError("fields must be named once each")
        if k < 1 or not 2 <= q <= 4:
            raise ValueError("k must be positive and q 2, 3 or 4")
        n = len(fields)
        if scheme == "CLK":
            if bits <= 0:
                raise ValueError("CLK needs its size in bits")
            return EncodingSpec(scheme, tuple(fields), (bits,), bits, k, q)
        if field_bits > 0:
            sizes = [field_bits] * n
        else:
            if grams is None or len(grams) != n or any(not math.isfinite(g) or g <= 0 for g in grams):
                raise ValueError("a positive mean q-gram count is needed for each field")
            sizes = [dynamic_size(g, k) for g in grams]
        if scheme == "FBF":
            return EncodingSpec(scheme, tuple(fields), tuple(sizes), sum(sizes), k, q)
        if n < 2:
            raise ValueError("RBF needs at least two fields")
        if bits > 0:
            drawn = [math.ceil(bits / n), *[bits // n] * (n - 1)]
        else:
            if weights is None or len(weights) != n or any(math.isnan(w) for w in weights) or abs(1 - sum(weights)) > 1e-4:
                raise ValueError("weights that add up to 1 are needed, one for each field")
            bits = weighted_size(sizes, weights)
            drawn = [int(bits * w) for w in weights]
        seeds = list(range(1, n + 1)) if seeds is None else seeds
        if len(seeds) != n:
            raise ValueError("a seed is needed for each field")
        return EncodingSpec(scheme, tuple(fields), tuple(sizes), bits, k, q, tuple(drawn), tuple(seeds), permutation_seed)

    def with_fields(self, names: dict[str, str]) -> EncodingSpec:
        """The same encoding for the other party's field names."""
        return replace(self, fields=tuple(names.get(f, f) for f in self.fields))

    def field_size(self, j: int) -> int:
        return self.sizes[0] if self.scheme == "CLK" else self.sizes[j]

    def targets(self, j: int) -> list[list[int]]:
        """For each position of field j's filter, the bits of the result that it sets."""
        size = self.field_size(j)
        if self.scheme == "CLK":
            return [[p] for p in range(size)]
        if self.scheme == "FBF":
            start = sum(self.sizes[:j])
            return [[start + p] for p in range(size)]
        out: list[list[int]] = [[] for _ in range(size)]
        place = permutation(self.bits, self.permutation_seed)
        start = sum(self.drawn[:j])
        for i, p in enumerate(draws(self.drawn[j], size, self.seeds[j])):
            out[p].append(place[start + i])
        return out

    @property
    def column(self) -> str:
        """encoding_field_{bits}_{k}_{q}_src_{field}..., the published naming scheme."""
        return f"encoding_field_{self.bits}_{self.k}_{self.q}_" + "_".join(f"src_{f}" for f in self.fields)

    @staticmethod
    def from_column(name: str) -> EncodingSpec:
        """The CLK spec that a published column name stands for (the inverse of ``column``)."""
        found = re.fullmatch(r"encoding_field_(\d+)_(\d+)_(\d+)_src_(.+)", name)
        if not found:
            raise ValueError(f"{name!r} is no name of an encoded column")
        bits, k, q = (int(found[i]) for i in (1, 2, 3))
        return EncodingSpec.make("CLK", found[4].split("_src_"), k, q, bits=bits)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def from_json(text: str) -> EncodingSpec:
        return EncodingSpec(**{k: tuple(v) if isinstance(v, list) else v for k, v in json.loads(text).items()})

    @staticmethod
    def of(schema: T.StructType) -> EncodingSpec:
        """The spec that an encoded column carries in its metadata."""
        for field in schema:
            if "encoding" in field.metadata:
                return EncodingSpec.from_json(field.metadata["encoding"])
        raise ValueError("no encoded column")

    def check(self, schema: T.StructType) -> None:
        """The fields exist and are of types that can be encoded."""
        kinds = {f.name: f.dataType.simpleString() for f in schema}
        for f in self.fields:
            if kinds.get(f) not in ENCODABLE:
                raise ValueError(f"field {f!r} of type {kinds.get(f)} can't be encoded")


def plan_sizes(fields: list[str], grams: list[float], weights: list[float], bits: int, k: int) -> list[dict]:
    """For each field: its dynamic size, and the row filter lengths that dynamic and static sizes ask for, with shares."""
    dynamic = [dynamic_size(g, k) for g in grams]
    rows = [math.ceil(n / w) for n, w in zip(dynamic, weights, strict=True)]
    fixed = [math.ceil(bits / w) for w in weights]
    return [
        {"field": f, "dynamic_size": n, "candidate_dynamic": r, "drawn_dynamic": math.ceil(max(rows) * w), "candidate_static": s, "drawn_static": math.ceil(max(fixed) * w), "weight": w}
        for f, n, r, s, w in zip(fields, dynamic, rows, fixed, weights, strict=True)
    ]


def blocking_groups(bits: int, k: int, count: int, seed: int) -> list[list[int]]:
    """``count`` groups of k distinct positions: the first of a permutation seeded with 1, 2, ... times the seed."""
    if not 1 <= k <= bits or count < 1:
        raise ValueError("1 <= k <= bits and at least one group")
    return [permutation(bits, (i + 1) * seed)[:k] for i in range(count)]


def groups_to_text(groups: list[list[int]]) -> list[str]:
    return [f"Block#{i} " + " ".join(map(str, g)) for i, g in enumerate(groups)]


def groups_from_text(lines: list[str]) -> list[list[int]]:
    out = {}
    for line in lines:
        head, *bits = line.split()
        out[int(head.removeprefix("Block#"))] = [int(b) for b in bits]
    return [out[i] for i in range(len(out))]


@dataclass(frozen=True)
class Blocking:
    """collisions: common keys that make a pair frequent; groups: how many there are; and the bounds of the search."""

    collisions: int
    groups: int
    least_groups: int
    most_groups: int


def _binomial_cdf(n: int, p: float, c: int) -> float:
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(min(c, n) + 1))


def optimal_blocking(theta: int, bits: int, delta: float, k: int) -> Blocking:
    """Groups and collisions such that a pair within distance theta is missed with probability under delta."""
    if not 0 < theta < bits or not 0 < delta < 1:
        raise ValueError("0 < theta < bits and 0 < delta < 1")
    hit = (1 - theta / bits) ** k
    least = math.ceil(math.log(delta) / math.log(1 - hit))
    mean = least * hit
    c = math.floor(mean - math.sqrt(mean * (1 - hit)) + 0.5)
    log = math.log(delta)
    inside = log * log - 2 * (c - 1) * log
    most = math.floor(((c - 1) - log + math.sqrt(inside)) / hit + 0.5) if inside >= 0 else 0
    groups = next((n for n in range(least, most) if _binomial_cdf(n, hit, c) < delta), max(least, most))
    return Blocking(c, groups, least, most)
