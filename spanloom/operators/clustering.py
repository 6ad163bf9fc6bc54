"""A curve through several columns, so that files are narrow in each of them.

The place of a value among a bounded sample of its column is a number of a few bits. The
bits of all columns, taken in turn, are the place on the curve (Z-order): rows close
on it are close in every column. Where the cuts lie does not matter to results, only
to how well readers can skip.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits for each column, and rows of the sample.
BITS, SAMPLE_ROWS = 4, 20_000


def cuts_of(rows: DataFrame, columns: list[str], total: int, bits: int = BITS) -> dict[str, list]:
    """2**bits - 1 values, ascending, that part a sample of each column evenly; fewer where values repeat."""
    fraction = min(1.0, SAMPLE_ROWS / max(total, 1))
    sample = rows.select(*columns).sample(fraction, seed=1).limit(2 * SAMPLE_ROWS).toArrow()
    cuts = {}
    for name in columns:
        values = sorted(v for v in sample.column(name).to_pylist() if v is not None)
        steps = 1 << bits
        cuts[name] = sorted({values[len(values) * i // steps] for i in range(1, steps)}) if values else []
    return cuts


def z_place(cuts: dict[str, list], bits: int = BITS) -> Column:
    """Place of a row on the curve through the columns, the first one's bits leading; nulls come before all values."""
    place = F.lit(0)
    ranks = [_rank(name, values, bits) for name, values in cuts.items()]
    for bit in reversed(range(bits)):
        for rank in ranks:
            place = place * 2 + F.shiftright(rank, bit).bitwiseAND(F.lit(1))
    return place


def _rank(name: str, cuts: list, bits: int) -> Column:
    """How many cuts a value has passed, none for a null, spread over all numbers of these bits."""
    if not cuts:
        return F.lit(0)
    passed = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda cut: cut <= F.col(name)))
    return F.call_function("div", passed * (1 << bits), F.lit(len(cuts) + 1)).cast("int")
