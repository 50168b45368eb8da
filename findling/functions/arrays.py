"""Array expressions that keep per-document work inside the row, without a shuffle.

They are composed as SQL text: a nested expression then costs the driver one call
to parse, where the same built lambda by lambda costs hundreds.
"""

from __future__ import annotations

NO_LONGS = "cast(array() AS array<bigint>)"


def let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is evaluated once.

    An expression used inside a lambda is otherwise evaluated for every element.
    """
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _prefix(values: str, start: str) -> str:
    return f"""aggregate({values}, struct({NO_LONGS} AS out, {start} AS total),
        (acc, x) -> struct(concat(acc.out, array(acc.total)) AS out, acc.total + x AS total),
        acc -> acc.out)"""


def running_before(values: str, block: int = 128) -> str:
    """For each element the sum of the elements before it.

    Works in blocks, as a fold that appends to one long array copies that array
    at every step.
    """
    blocks = f"""transform(sequence(0, greatest((size(longs) - 1) div {block}, 0)),
        b -> slice(longs, cast(b * {block} + 1 AS int), {block}))"""
    sums = "transform(blocks, b -> aggregate(b, 0L, (a, x) -> a + x))"
    joined = f"""flatten(zip_with(blocks, {_prefix(sums, '0L')},
        (part, base) -> {_prefix('part', 'base')}))"""
    return let(f"cast({values} AS array<bigint>)", "longs", let(blocks, "blocks", joined))


def run_starts(values: str, part: str) -> str:
    """Zero-based positions at which a run of neighbours with equal ``part`` begins.

    ``values`` names an array; ``part`` is what to compare of an element ``{0}``.
    """
    same = f"{part.format('x')} = {part.format(f'get({values}, i - 1)')}"
    return f"""filter(transform({values}, (x, i) -> CASE WHEN i = 0 OR NOT ({same}) THEN i END),
        i -> i IS NOT NULL)"""
