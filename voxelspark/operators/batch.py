"""Batches: boxes of volumes taken through a list of nodes.

What is wanted at the end is asked of the last node, which asks the one before for what it needs itself: a node that looks around a
voxel grows the box. The volumes are read once, in the boxes that reach them, as range predicates on their positions; then each
node's ``process`` adds or replaces volumes, cut to what was asked of it. Nodes build lazy frames; nothing runs until a result is used.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelspark.functions.roi import Roi
from voxelspark.operators.labels import grow_boundary
from voxelspark.operators.samples import affinities_from_labels
from voxelspark.operators.shape import context, shape_descriptors
from voxelspark.operators.voxels import crop

Request = dict[str, Roi]


def asked_too(request: Request, name: str, box: Roi) -> Request:
    """``request`` with ``box`` of the volume ``name`` as well."""
    return request | {name: request[name].union(box) if name in request else box}


class Node:
    """A step of a batch. Subclasses say what they need of the step before and what they make of it."""

    def prepare(self, request: Request) -> Request:
        """The boxes that this node needs, given those asked of it (``request`` may be changed)."""
        return request

    def process(self, batch: dict[str, DataFrame], request: Request) -> dict[str, DataFrame]:
        """Volumes by name, from those that ``prepare`` asked for."""
        return batch


@dataclass(frozen=True)
class Each(Node):
    """``into`` by a function of the volume ``of``; the function sees ``reach`` voxels around the box."""

    fn: Callable[[DataFrame], DataFrame]
    of: str
    into: str
    reach: tuple[int, int, int] = (0, 0, 0)

    def prepare(self, request: Request) -> Request:
        if self.into not in request:
            return request
        box = request[self.into].grow(self.reach, self.reach)
        return asked_too({k: v for k, v in request.items() if k != self.into or k == self.of}, self.of, box)

    def process(self, batch: dict[str, DataFrame], request: Request) -> dict[str, DataFrame]:
        return batch | {self.into: self.fn(batch[self.of])} if self.into in request else batch


@dataclass(frozen=True)
class AddDescriptors(Node):
    """``into``: shape descriptors of the labels ``of``, whose box grows by the kernel's context."""

    of: str
    into: str
    sigma: Sequence[float]
    voxel_size: Sequence[float] = (1, 1, 1)
    mode: str = "gaussian"
    dims: int = 3
    components: str | None = None

    def prepare(self, request: Request) -> Request:
        if self.into not in request:
            return request
        far = context(self.sigma, self.mode)
        reach = tuple(0 if self.dims == 2 and k == 0 else ceil(f / s) for k, (f, s) in enumerate(zip(far, self.voxel_size, strict=True)))
        return asked_too({k: v for k, v in request.items() if k != self.into}, self.of, request[self.into].grow(reach, reach))

    def process(self, batch: dict[str, DataFrame], request: Request) -> dict[str, DataFrame]:
        if self.into not in request:
            return batch
        found = shape_descriptors(batch[self.of], self.sigma, self.voxel_size, self.mode, self.dims, self.components, roi=request[self.into])
        return batch | {self.into: found}


def grown_boundary(name: str, steps: int = 1, only_xy: bool = False) -> Each:
    """Labels ``name`` with grown boundaries: a step looks one voxel far."""
    return Each(lambda df: grow_boundary(df, steps=steps, only_xy=only_xy), name, name, (0 if only_xy else steps, steps, steps))


def added_affinities(of: str, into: str) -> Each:
    """``into``: affinities of the labels ``of`` to the voxel before along each axis."""
    return Each(affinities_from_labels, of, into, (1, 1, 1))


def requests(nodes: Sequence[Node], request: Request) -> list[Request]:
    """What is asked of the source and of each node, in their order."""
    asked = [dict(request)]
    for node in reversed(nodes):
        asked.append(dict(node.prepare(dict(asked[-1]))))
    return asked[::-1]


def batch(volumes: Mapping[str, DataFrame], nodes: Sequence[Node], request: Request) -> dict[str, DataFrame]:
    """The volumes of ``request``, each in its box, after all nodes. KeyError where a volume is asked for that nothing gives."""
    asked = requests(nodes, request)
    if missing := set(asked[0]) - set(volumes):
        raise KeyError(f"no volume {sorted(missing)}")
    now = {name: crop(volumes[name], box) for name, box in asked[0].items()}
    for node, wanted in zip(nodes, asked[1:], strict=True):
        made = node.process(dict(now), wanted)
        if missing := set(wanted) - set(made):
            raise KeyError(f"{type(node).__name__} gave no volume {sorted(missing)}")
        now = {name: crop(made[name], box) for name, box in wanted.items()}
    return now
