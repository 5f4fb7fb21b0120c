"""Easing curves and keyframe interpolation, for scalar columns and for arrays of keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import col, js_round

#: Fixed value: the easing names.
EASINGS = ("linear", "hold", "easeIn", "easeOut", "easeInOut")
#: Fixed value: the animated fields of a framing.
FRAMING = ("scale", "x", "y", "rotation")


def ease(kind, x, once: bool = False) -> Column:
    """``once`` evaluates ``x`` a single time, for use inside lambdas; plain columns stay in codegen."""
    kind = col(kind)

    def curve(x: Column) -> Column:
        back = x * -2.0 + 2.0
        return (
            F.when(kind == "linear", x)
            .when(kind == "hold", F.lit(0.0))
            .when(kind == "easeIn", x * x)
            .when(kind == "easeOut", F.lit(1.0) - (F.lit(1.0) - x) * (F.lit(1.0) - x))
            .when(x < 0.5, x * 2.0 * x)
            .otherwise(F.lit(1.0) - back * back / 2.0)
        )

    x = F.least(F.lit(1.0), F.greatest(F.lit(0.0), col(x).cast("double")))
    return bind(x, curve) if once else curve(x)


def lerp(a, b, t) -> Column:
    return col(a) + (col(b) - col(a)) * col(t)


def between_keys(at, left_t, left_value, left_easing, right_t, right_value) -> Column:
    """Value at ``at`` from the bracketing keys; a missing side holds the other one."""
    at, left_t, right_t = col(at), col(left_t), col(right_t)
    left_value, right_value = col(left_value), col(right_value)
    amount = ease(left_easing, (at - left_t) / (right_t - left_t))
    return (
        F.when(left_t.isNull(), right_value)
        .when(right_t.isNull() | (right_t <= left_t), left_value)
        .otherwise(lerp(left_value, right_value, amount))
    )


def bind(value: Column, use) -> Column:
    """Evaluate ``value`` once and hand it to ``use``; keeps lambda bodies from growing."""
    return F.transform(F.array(value), use)[0]


def sample_keys(keys: Column, at: Column, fields: tuple[str, ...] = FRAMING) -> Column:
    """Framing at ``at`` from a time-ordered array of ``{t, scale, x, y, rotation, easing}``."""

    def pick(pair: Column) -> Column:
        left, right = pair["left"], pair["right"]
        amount = ease(left["easing"], (at - left["t"]) / (right["t"] - left["t"]), once=True)
        inside = lambda m: F.struct(*[(left[f] + (right[f] - left[f]) * m).alias(f) for f in fields])
        whole = lambda k: F.struct(*[k[f].alias(f) for f in fields])
        held = right.isNull() | (right["t"] <= left["t"]) | (left["t"] == at)
        return F.when(left.isNull(), whole(right)).when(held, whole(left)).otherwise(bind(amount, inside))

    before = F.filter(keys, lambda k: k["t"] <= at)
    after = F.filter(keys, lambda k: k["t"] > at)
    # The first key answers for its own instant even when later keys share it.
    first = F.get(keys, F.lit(0))
    left = F.when(first["t"] == at, first).otherwise(F.try_element_at(before, F.lit(-1)))
    return bind(F.struct(left.alias("left"), F.try_element_at(after, F.lit(1)).alias("right")), pick)


def by_time(keys: Column) -> Column:
    """Keys in time order; keys of one instant keep the order they came in."""
    placed = F.array_sort(F.transform(keys, lambda k, i: F.struct(k["t"].alias("t"), i.alias("i"), k.alias("k"))))
    return F.transform(placed, lambda x: x["k"])


def retime_keys(keys: Column, shift: Column, length: Column, factor: Column | None = None) -> Column:
    """Move keys with their footage and pin the sampled framing at an edge they crossed."""
    t = (lambda k: k["t"]) if factor is None else (lambda k: js_round(k["t"] * factor))
    moved = by_time(F.transform(keys, lambda k: k.withField("t", js_round(t(k) + shift))))

    def pinned(ks: Column, at: Column, cut: Column, before: Column, after: Column) -> Column:
        """``ks`` outside ``before``/``after`` replaced by one key at ``at``, where ``cut`` holds."""
        easing = F.try_element_at(F.filter(ks, lambda k: k["t"] <= at), F.lit(-1))["easing"]
        edge = edge_key(sample_keys(ks, at), at, easing)
        return F.when(cut, F.concat(F.filter(ks, before), F.array(edge), F.filter(ks, after))).otherwise(ks)

    none, zero = F.lit(False), F.lit(0).cast("bigint")
    head = lambda ks: pinned(ks, zero, F.get(ks, F.lit(0))["t"] < 0, lambda k: none, lambda k: k["t"] > 0)
    tail = lambda ks: pinned(ks, length, F.try_element_at(ks, F.lit(-1))["t"] > length, lambda k: k["t"] < length, lambda k: none)
    return bind(bind(moved, head), tail)


def edge_key(framing: Column, t: Column, easing: Column) -> Column:
    return F.struct(
        t.cast("bigint").alias("t"), *[framing[f].alias(f) for f in FRAMING], F.coalesce(easing, F.lit("linear")).alias("easing")
    )


def split_keys(keys: Column, offset: Column) -> Column:
    """The two halves of an animated effect as ``left`` and ``right``, joined by a key at the cut."""
    before, after = F.filter(keys, lambda k: k["t"] < offset), F.filter(keys, lambda k: k["t"] > offset)
    last = lambda part: F.try_element_at(part, F.lit(-1))["easing"]

    def halves(framing: Column) -> Column:
        left = F.concat(before, F.array(edge_key(framing, offset, last(before))))
        upto = F.filter(keys, lambda k: k["t"] <= offset)
        right = F.concat(
            F.array(edge_key(framing, F.lit(0), last(upto))), F.transform(after, lambda k: k.withField("t", k["t"] - offset))
        )
        return F.struct(left.alias("left"), right.alias("right"))

    return bind(sample_keys(keys, offset), halves)
