"""A bounded collection of subspaces, as an immutable value over two tables.

Every change returns a new collection, so a kept one is a real snapshot. The
slots are the ``space_id`` values 0 .. count-1.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kernspan.functions.kernels import Kernel, linear
from kernspan.operators import score as S
from kernspan.operators.fit import fit
from kernspan.operators.landmarks import SPACE_COLUMNS, space_sizes
from kernspan.session import materialize


@dataclass(frozen=True)
class SubspaceCollection:
    """``spaces`` (landmarks) and ``models`` (their fits) of up to ``capacity`` slots."""

    spaces: DataFrame
    models: DataFrame
    lam: float
    kernel: Kernel
    capacity: int
    count: int
    oldest: int = 0
    form: str = "dual"

    @classmethod
    def create(
        cls,
        sample: DataFrame,
        lam: float,
        kernel: Kernel | None = None,
        capacity: int = 5,
        form: str = "dual",
        durable: bool = False,
    ) -> SubspaceCollection:
        """A collection whose slot 0 is ``sample`` (``ord, id, x, reg``).

        A sample is materialised unless it is ``durable``, i.e. already is.
        """
        if capacity < 1:
            raise ValueError("capacity must be at least 1")
        kernel = kernel or linear()
        spaces = _in_slot(sample, 0, durable)
        models = fit(spaces, lam, kernel, form)
        return cls(spaces, models, lam, kernel, capacity, 1, 0, form)

    def append(self, sample: DataFrame, durable: bool = False) -> SubspaceCollection:
        """Add a subspace; an error when all slots are taken."""
        if self.count >= self.capacity:
            raise ValueError(f"all {self.capacity} slots are taken")
        return replace(self._with_slot(sample, self.count, durable), count=self.count + 1)

    def append_circular(self, sample: DataFrame, durable: bool = False) -> SubspaceCollection:
        """Add a subspace, in place of the oldest one when all slots are taken."""
        if self.count < self.capacity:
            return self.append(sample, durable)
        kept = self._without_slot(self.oldest)
        return replace(
            kept._with_slot(sample, self.oldest, durable),
            oldest=(self.oldest + 1) % self.capacity,
        )

    def remove(self, slot: int) -> SubspaceCollection:
        """Drop a slot; the last one moves into it."""
        if not 0 <= slot < self.count:
            raise IndexError(f"slot {slot} is not in [0, {self.count})")
        last = self.count - 1
        kept = self._without_slot(slot)
        # one reference to the old slot: a CASE has two, and doubles with every removal
        slots = F.array(*[F.lit(slot if k == last else k) for k in range(self.count)])
        moved = F.get(slots, F.col("space_id"))
        return replace(
            kept,
            spaces=kept.spaces.withColumn("space_id", moved),
            models=kept.models.withColumn("space_id", moved),
            count=last,
        )

    def update_lambda(self, lam: float) -> SubspaceCollection:
        """Every subspace for another lambda; only the plain dual form needs a refit."""
        if self.form in ("primal", "eigen"):
            models = self.models.withColumn("lambda", F.lit(float(lam)))
        else:
            models = fit(self.spaces, lam, self.kernel, self.form)
        return replace(self, models=models, lam=lam)

    def describe(self) -> DataFrame:
        """One row per slot: landmark count, lambda, ids and weights in order."""
        ordered = F.array_sort(F.collect_list(F.struct("ord", "id", "reg")))
        return self.spaces.groupBy("space_id").agg(ordered.alias("rows")).select(
            "space_id",
            F.size("rows").cast("long").alias("m"),
            F.lit(float(self.lam)).alias("lambda"),
            F.col("rows.id").alias("ids"),
            F.col("rows.reg").alias("reg"),
        )

    def sizes(self) -> DataFrame:
        return space_sizes(self.spaces)

    def project(self, df: DataFrame) -> DataFrame:
        return S.kernel_proj(df, self.models, self.kernel)

    def leverage_min(self, df: DataFrame, out: str = "leverage") -> DataFrame:
        return S.leverage_min(df, self.models, self.kernel, out=out)

    def leverage_pseudo(self, df: DataFrame, out: str = "leverage") -> DataFrame:
        return S.leverage_pseudo(df, self.models, self.kernel, out=out)

    def cross_leverage_matrix(self) -> DataFrame:
        return S.cross_leverage_matrix(self.spaces, self.models, self.kernel)

    def _with_slot(self, sample: DataFrame, slot: int, durable: bool) -> SubspaceCollection:
        added = _in_slot(sample, slot, durable)
        models = fit(added, self.lam, self.kernel, self.form)
        return replace(
            self,
            spaces=self.spaces.unionByName(added),
            models=self.models.unionByName(models),
        )

    def _without_slot(self, slot: int) -> SubspaceCollection:
        other = F.col("space_id") != slot
        return replace(self, spaces=self.spaces.filter(other), models=self.models.filter(other))


def _in_slot(sample: DataFrame, slot: int, durable: bool) -> DataFrame:
    rows = sample.select(F.lit(slot).alias("space_id"), *SPACE_COLUMNS[1:])
    return rows if durable else materialize(rows)
