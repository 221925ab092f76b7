"""Reading fields of a frame's bytes with built-in SQL functions.

Each helper gives an SQL expression over the binary column ``raw``; offsets count from 0 and are numbers
or SQL.  Expressions as text are parsed in one call, so wide projections stay cheap to build.  Callers
read a field only where its whole header lies inside the frame.
"""

from __future__ import annotations

U32 = 4294967296


def cut(offset: int | str, size: int) -> str:
    """``size`` bytes at ``offset``."""
    at = offset + 1 if isinstance(offset, int) else f"{offset} + 1"
    return f"substring(raw, {at}, {size})"


def be(offset: int | str, size: int) -> str:
    """A big-endian unsigned number of up to 7 bytes."""
    return f"cast(conv(hex({cut(offset, size)}), 16, 10) as bigint)"


def le(offset: int | str, size: int) -> str:
    """A little-endian unsigned number: what a little-endian host prints for an unconverted field."""
    parts = ", ".join(f"hex({cut(plus(offset, k), 1)})" for k in reversed(range(size)))
    return f"cast(conv(concat({parts}), 16, 10) as bigint)"


def plus(offset: int | str, k: int) -> int | str:
    return offset + k if isinstance(offset, int) else f"{offset} + {k}"


def ipv4(offset: int | str) -> str:
    """Dotted quad."""
    return "concat(" + ", '.', ".join(f"conv(hex({cut(plus(offset, k), 1)}), 16, 10)" for k in range(4)) + ")"


def six_groups(offset: int | str) -> str:
    """Sixteen bytes as eight groups of four lower-case digits with colons."""
    return f"substring(regexp_replace(lower(hex({cut(offset, 16)})), '(....)', ':$1'), 2)"


def ipv6(groups: str) -> str:
    """The text of an address from its ``six_groups``, as the C library prints it.

    The longest run of two zero groups or more, the first of equals, becomes ``::``; leading zeros go; an
    address whose first six groups are zero, or five zero and the sixth ffff, ends in a dotted quad.
    """
    slim = lambda x: f"regexp_replace({x}, '(^|:)0{{1,3}}', '$1')"
    zeros = lambda n: ":".join(["0000"] * n)
    quad = "concat_ws('.', " + ", ".join(f"conv(substring({groups}, {k}, 2), 16, 10)" for k in (31, 33, 36, 38)) + ")"
    # A run starts at a group's first digit: four zeros and a colon, or four zeros at the end, are a whole group.
    run = lambda n: f"when instr({groups}, '{zeros(n)}') > 0 then concat({slim(f"substring({groups}, 1, greatest(instr({groups}, '{zeros(n)}') - 2, 0))")}, '::', {slim(f"substring({groups}, instr({groups}, '{zeros(n)}') + {5 * n})")})"
    whole = f"when {groups} = '{zeros(8)}' then '::' when startswith({groups}, '{zeros(7)}:') then concat('::', {slim(f'substring({groups}, 36)')})"
    mapped = f"when startswith({groups}, '{zeros(6)}:') then concat('::', {quad}) when startswith({groups}, '{zeros(5)}:ffff:') then concat('::ffff:', {quad})"
    return f"case {whole} {mapped} {' '.join(run(n) for n in range(7, 1, -1))} else {slim(groups)} end"


def mac(offset: int | str) -> str:
    """Lower-case pairs with colons."""
    return f"lower(rtrim(':', regexp_replace(hex({cut(offset, 6)}), '(..)', '$1:')))"


def hex_number(x: str) -> str:
    """Lower-case hexadecimal without leading zeros."""
    return f"lower(hex({x}))"


def minus_u32(a: str, b: str) -> str:
    return f"pmod({a} - {b}, {U32})"
