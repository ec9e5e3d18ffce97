"""Edges as a data frame that a traversal joins with."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import EdgeTable
from ..plans.frame import BindFault, Context, RelVar


@dataclass(frozen=True)
class Edges:
    """Edges seen from one end: columns of the key and label there (near) and at the other end (far), and of the edge."""

    df: DataFrame
    near: str
    near_label: str
    far: str
    far_label: str
    rel: RelVar
    near_labels: tuple[str, ...]
    far_labels: tuple[str, ...]
    near_kind: str = "long"
    far_kind: str = "long"

    def columns(self) -> list[str]:
        return [self.near, self.near_label, self.far, self.far_label, *self.rel.columns()]


def edges(ctx: Context, name: str, tables: list[EdgeTable], direction: str, near_labels: tuple[str, ...] | None = None, far_labels: tuple[str, ...] | None = None, key_kind: str | None = None) -> Edges:
    """The tables' edges out of, into, or both ways from their near end. Both ways an edge comes twice, under one id.

    key_kind: the kind of the keys of both ends, where it is not that of their labels.
    """
    kinds: dict[str, T.DataType] = {}
    for t in tables:
        for p, kind in t.properties.items():
            if kinds.setdefault(p, kind) != kind:
                raise BindFault(f"property {p} has different types in {', '.join(x.type for x in tables)}")
    fresh = ctx.fresh
    near, near_label, far, far_label = (fresh(f"{name}_{x}") for x in ("near", "near_label", "far", "far_label"))
    props = {p: fresh(f"{name}_{p}") for p in kinds}
    rel = RelVar(*(fresh(f"{name}_{x}") for x in ("src", "src_label", "dst", "dst_label", "type", "eid")), props)

    chosen: list[tuple[EdgeTable, bool, str, str]] = []
    for t in tables:
        for out in (True, False):
            if direction != "both" and out != (direction == "out"):
                continue
            a, b = (t.source, t.target) if out else (t.target, t.source)
            if (near_labels is None or a in near_labels) and (far_labels is None or b in far_labels):
                chosen.append((t, out, a, b))
    none = not chosen
    chosen = chosen or [(tables[0], True, tables[0].source, tables[0].target)]
    labels = tuple(dict.fromkeys(a for _, _, a, _ in chosen)), tuple(dict.fromkeys(b for _, _, _, b in chosen))
    ends = tuple(dict.fromkeys(t.source for t in tables)), tuple(dict.fromkeys(t.target for t in tables))
    near_kind, far_kind, src_kind, dst_kind = (key_kind or ctx.kind(x) for x in (*labels, *ends))

    def one(t: EdgeTable, out: bool) -> DataFrame:
        src, dst = F.col(f"`{t.src}`"), F.col(f"`{t.dst}`")
        # edges have no key: the hash of all that an edge holds tells it from others between the same ends
        eid = F.xxhash64(F.lit(t.type), F.lit(t.source), F.lit(t.target), *[F.col(f"`{c}`") for c in t.df.columns])
        (x, x_label), (y, y_label) = ((src, t.source), (dst, t.target)) if out else ((dst, t.target), (src, t.source))
        return t.df.select(
            x.cast(near_kind).alias(near), F.lit(x_label).alias(near_label), y.cast(far_kind).alias(far), F.lit(y_label).alias(far_label),
            src.cast(src_kind).alias(rel.src), F.lit(t.source).alias(rel.src_label), dst.cast(dst_kind).alias(rel.dst), F.lit(t.target).alias(rel.dst_label), F.lit(t.type).alias(rel.type), eid.alias(rel.eid),
            *[(F.col(f"`{p}`") if p in t.properties else F.lit(None).cast(kinds[p])).alias(c) for p, c in props.items()],
        )

    df = one(*chosen[0][:2])
    for t, out, _, _ in chosen[1:]:
        df = df.unionAll(one(t, out))
    df = df.limit(0) if none else df
    full = RelVar(rel.src, rel.src_label, rel.dst, rel.dst_label, rel.type, rel.eid, props, ends, (src_kind, dst_kind))
    return Edges(df, near, near_label, far, far_label, full, *labels, near_kind, far_kind)
