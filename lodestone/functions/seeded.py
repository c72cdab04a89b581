"""Seeded order and draws that do not depend on partitioning.

Every seeded operator orders by ``sha2(seed:purpose:id)``; any SQL engine with SHA-256 reproduces it.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def order_key(seed: int, purpose: str, *ids: Column) -> Column:
    """Hex digest that puts rows into a seeded order; null ids count as the empty string."""
    parts = [F.lit(str(seed)), F.lit(purpose), *[F.coalesce(c.cast("string"), F.lit("")) for c in ids]]
    return F.sha2(F.concat_ws(":", *parts), 256)


def uniform(seed: int, purpose: str, *ids: Column) -> Column:
    """A uniform draw in (0, 1) from the first 48 bits of the seeded digest."""
    bits = F.conv(F.substring(order_key(seed, purpose, *ids), 1, 12), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 48))


def normal(seed: int, purpose: str, *ids: Column) -> Column:
    """A standard normal draw by Box and Muller's transform of two seeded uniforms."""
    u, v = uniform(seed, purpose + ":u", *ids), uniform(seed, purpose + ":v", *ids)
    return F.sqrt(F.lit(-2.0) * F.ln(u)) * F.cos(F.lit(6.283185307179586) * v)


def epoch_offset(epoch: int, seed: int, stride: int) -> int:
    """The rotating chunk offset of an epoch: 0 at epoch 0, else a seeded number below the stride."""
    if epoch == 0:
        return 0
    return int(hashlib.sha256(f"{seed}:epoch:{epoch}".encode()).hexdigest()[:12], 16) % stride
