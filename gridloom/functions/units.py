"""Unit conversion and type conversion as column expressions."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of units as (powers of base units, scale, offset): base = x * scale + offset.
NAMES: dict[str, tuple[str, float, float]] = {
    "1": ("", 1.0, 0.0), "%": ("", 0.01, 0.0), "percent": ("", 0.01, 0.0), "ppm": ("", 1e-6, 0.0), "ppb": ("", 1e-9, 0.0), "ppt": ("", 1e-12, 0.0), "unitless": ("", 1.0, 0.0), "count": ("", 1.0, 0.0), "octa": ("", 0.125, 0.0),
    "m": ("m", 1.0, 0.0), "meter": ("m", 1.0, 0.0), "metre": ("m", 1.0, 0.0), "ft": ("m", 0.3048, 0.0), "foot": ("m", 0.3048, 0.0), "feet": ("m", 0.3048, 0.0), "in": ("m", 0.0254, 0.0), "inch": ("m", 0.0254, 0.0),
    "yd": ("m", 0.9144, 0.0), "mi": ("m", 1609.344, 0.0), "mile": ("m", 1609.344, 0.0), "nmi": ("m", 1852.0, 0.0), "micron": ("m", 1e-6, 0.0), "angstrom": ("m", 1e-10, 0.0), "DU": ("m-2 mol", 4.4615e-4, 0.0),
    "g": ("kg", 1e-3, 0.0), "gram": ("kg", 1e-3, 0.0), "lb": ("kg", 0.45359237, 0.0), "oz": ("kg", 0.028349523125, 0.0), "t": ("kg", 1000.0, 0.0), "tonne": ("kg", 1000.0, 0.0),
    "s": ("s", 1.0, 0.0), "sec": ("s", 1.0, 0.0), "second": ("s", 1.0, 0.0), "min": ("s", 60.0, 0.0), "minute": ("s", 60.0, 0.0), "h": ("s", 3600.0, 0.0), "hr": ("s", 3600.0, 0.0), "hour": ("s", 3600.0, 0.0),
    "d": ("s", 86400.0, 0.0), "day": ("s", 86400.0, 0.0), "week": ("s", 604800.0, 0.0), "K": ("K", 1.0, 0.0), "kelvin": ("K", 1.0, 0.0), "degK": ("K", 1.0, 0.0), "degC": ("K", 1.0, 273.15), "celsius": ("K", 1.0, 273.15),
    "degF": ("K", 5 / 9, 459.67 * 5 / 9), "fahrenheit": ("K", 5 / 9, 459.67 * 5 / 9), "A": ("A", 1.0, 0.0), "ampere": ("A", 1.0, 0.0), "mol": ("mol", 1.0, 0.0), "mole": ("mol", 1.0, 0.0), "cd": ("cd", 1.0, 0.0), "candela": ("cd", 1.0, 0.0),
    "rad": ("rad", 1.0, 0.0), "radian": ("rad", 1.0, 0.0), "degree": ("rad", 0.017453292519943295, 0.0), "deg": ("rad", 0.017453292519943295, 0.0), "sr": ("rad2", 1.0, 0.0), "steradian": ("rad2", 1.0, 0.0),
    "degree_north": ("rad", 0.017453292519943295, 0.0), "degree_east": ("rad", 0.017453292519943295, 0.0), "degree_N": ("rad", 0.017453292519943295, 0.0), "degree_E": ("rad", 0.017453292519943295, 0.0),
    "Hz": ("s-1", 1.0, 0.0), "hertz": ("s-1", 1.0, 0.0), "N": ("kg m s-2", 1.0, 0.0), "newton": ("kg m s-2", 1.0, 0.0), "Pa": ("kg m-1 s-2", 1.0, 0.0), "pascal": ("kg m-1 s-2", 1.0, 0.0), "bar": ("kg m-1 s-2", 1e5, 0.0),
    "atm": ("kg m-1 s-2", 101325.0, 0.0), "mmHg": ("kg m-1 s-2", 133.322387415, 0.0), "inHg": ("kg m-1 s-2", 3386.388640341, 0.0), "psi": ("kg m-1 s-2", 6894.757293168, 0.0), "J": ("kg m2 s-2", 1.0, 0.0), "joule": ("kg m2 s-2", 1.0, 0.0),
    "cal": ("kg m2 s-2", 4.1868, 0.0), "W": ("kg m2 s-3", 1.0, 0.0), "watt": ("kg m2 s-3", 1.0, 0.0), "V": ("kg m2 s-3 A-1", 1.0, 0.0), "volt": ("kg m2 s-3 A-1", 1.0, 0.0), "C": ("s A", 1.0, 0.0), "coulomb": ("s A", 1.0, 0.0),
    "F": ("kg-1 m-2 s4 A2", 1.0, 0.0), "Ohm": ("kg m2 s-3 A-2", 1.0, 0.0), "ohm": ("kg m2 s-3 A-2", 1.0, 0.0), "T": ("kg s-2 A-1", 1.0, 0.0), "lm": ("cd rad2", 1.0, 0.0), "lx": ("m-2 cd rad2", 1.0, 0.0), "L": ("m3", 1e-3, 0.0), "l": ("m3", 1e-3, 0.0),
    "liter": ("m3", 1e-3, 0.0), "litre": ("m3", 1e-3, 0.0), "ha": ("m2", 1e4, 0.0), "knot": ("m s-1", 1852 / 3600, 0.0), "kt": ("m s-1", 1852 / 3600, 0.0), "kts": ("m s-1", 1852 / 3600, 0.0), "mph": ("m s-1", 0.44704, 0.0),
}
#: Texts that the grammar doesn't read as they are meant.
ALIASES = {"deg C": "degC", "degrees C": "degC", "degree C": "degC", "deg F": "degF", "degrees F": "degF", "deg K": "K", "degrees K": "K", "": "1", "none": "1", "#": "1"}
PREFIXES = {
    "Y": 1e24, "Z": 1e21, "E": 1e18, "P": 1e15, "T": 1e12, "G": 1e9, "M": 1e6, "k": 1e3, "h": 1e2, "da": 1e1, "d": 1e-1, "c": 1e-2, "m": 1e-3, "u": 1e-6, "µ": 1e-6, "μ": 1e-6, "n": 1e-9, "p": 1e-12, "f": 1e-15,
    "giga": 1e9, "mega": 1e6, "kilo": 1e3, "hecto": 1e2, "deci": 1e-1, "centi": 1e-2, "milli": 1e-3, "micro": 1e-6, "nano": 1e-9,
}

_TOKEN = re.compile(r"\s*(?:(?P<number>\d+(?:\.\d*)?(?:[eE][+-]?\d+)?)|(?P<name>[A-Za-zµμ%_]+)|(?P<power>\^|\*\*)|(?P<times>[.*·])|(?P<over>/)|(?P<open>\()|(?P<close>\))|(?P<sign>[+-]))")
_BASE = re.compile(r"([A-Za-z]+)(-?\d+)?")

Powers = dict[str, int]


def _named(name: str) -> tuple[Powers, float, float]:
    """A name, its plural, or a prefix and a name without offset."""
    for said in (name, name[:-1] if name.endswith("s") and len(name) > 2 else name):
        if said in NAMES:
            powers, scale, offset = NAMES[said]
            return {b: int(p or 1) for b, p in _BASE.findall(powers)}, scale, offset
    for said in (name, name[:-1] if name.endswith("s") and len(name) > 3 else name):
        for prefix in sorted(PREFIXES, key=len, reverse=True):
            rest = said[len(prefix) :]
            if said.startswith(prefix) and rest in NAMES and not NAMES[rest][2]:
                powers, scale, _ = NAMES[rest]
                return {b: int(p or 1) for b, p in _BASE.findall(powers)}, scale * PREFIXES[prefix], 0.0
    raise ValueError(f"unknown unit {name!r}")


class _Reader:
    """Reads products, quotients, powers and parentheses: a unit is factors beside each other or joined by . * / and 'per'."""

    def __init__(self, text: str):
        self.text, self.tokens, at = text, [], 0
        while text[at:].strip():
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"unknown unit {text!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup], text[at : at + 1].isspace()))
            at = m.end()
        self.at = 0

    def peek(self, ahead: int = 0) -> tuple[str, str, bool]:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ("end", "", False)

    def take(self) -> tuple[str, str, bool]:
        self.at += 1
        return self.tokens[self.at - 1]

    def product(self) -> tuple[Powers, float, float]:
        out = self.factor()
        while self.peek()[0] not in ("end", "close"):
            kind, said, _ = self.peek()
            over = kind == "over" or (kind == "name" and said == "per")
            if over or kind == "times":
                self.take()
            powers, scale, _ = self.factor()
            sign = -1 if over else 1
            # an offset has a meaning for the unit alone only
            out = ({k: v for k in {*out[0], *powers} if (v := out[0].get(k, 0) + sign * powers.get(k, 0))}, out[1] * scale**sign, 0.0)
        return out

    def factor(self) -> tuple[Powers, float, float]:
        if self.peek()[0] == "end":
            raise ValueError(f"unknown unit {self.text!r}")
        kind, said, _ = self.take()
        if kind == "open":
            out = self.product()
            if self.peek()[0] != "close":
                raise ValueError(f"unknown unit {self.text!r}")
            self.take()
        elif kind == "number":
            out = ({}, float(said), 0.0)
        elif kind == "name":
            out = _named(said)
        else:
            raise ValueError(f"unknown unit {self.text!r}")
        power = self.power(kind)
        return out if power == 1 else ({k: v * power for k, v in out[0].items() if power}, out[1] ** power, 0.0)

    def power(self, kind: str) -> int:
        """The power after a factor: ^2, **-1, or for names and parentheses a whole number that follows without a space."""
        marked = self.peek()[0] == "power"
        if marked:
            self.take()
        sign = 1
        if self.peek()[0] == "sign" and self.peek(1)[0] == "number" and not self.peek(1)[2] and (marked or (kind != "number" and not self.peek()[2])):
            sign = -1 if self.take()[1] == "-" else 1
            marked = True
        if self.peek()[0] == "number" and (marked or (kind != "number" and not self.peek()[2])):
            said = self.take()[1]
            if not said.isdigit():
                raise ValueError(f"unknown unit {self.text!r}")
            return sign * int(said)
        if marked:
            raise ValueError(f"unknown unit {self.text!r}")
        return 1


def parse(unit: str) -> tuple[str, float, float]:
    """(dimension, scale, offset) of a unit: names, plurals and prefixes, in products, quotients and powers; unknown ones raise ValueError.

    The dimension is written in powers of m kg s K A mol cd rad, in alphabetical order.
    """
    unit = unit.strip()
    reader = _Reader(ALIASES.get(unit, unit))
    powers, scale, offset = reader.product()
    if reader.peek()[0] != "end":
        raise ValueError(f"unknown unit {unit!r}")
    return " ".join(f"{k}{v}" if v != 1 else k for k, v in sorted(powers.items()) if v), scale, offset


def compare(a: str, b: str) -> str:
    """equal, convertible or different."""
    x, y = parse(a), parse(b)
    same = x[0] == y[0]
    return "equal" if same and math.isclose(x[1], y[1], rel_tol=1e-12) and x[2] == y[2] else "convertible" if same else "different"


def factors(source: str, target: str) -> tuple[float, float]:
    """(scale, offset) from source to target."""
    (d1, s1, o1), (d2, s2, o2) = parse(source), parse(target)
    if d1 != d2:
        raise ValueError(f"{source!r} can't be converted to {target!r}")
    return s1 / s2, (o1 - o2) / s2


def convert(value: Column, source: str, target: str, missing: Sequence[float] = ()) -> Column:
    """The value in another unit; missing values stay as they are."""
    scale, offset = factors(source, target)
    out = value * F.lit(scale) + F.lit(offset)
    return F.when(value.isin(*missing), value.cast("double")).otherwise(out) if missing else out


def convert_delta(value: Column, source: str, target: str) -> Column:
    """A difference in another unit: scaled, not shifted."""
    return value * F.lit(factors(source, target)[0])


# Default fill and range of each type.
FILLS = {"byte": -127, "short": -32767, "int": -2147483647, "float": 9.96921e36, "double": 9.96921e36, "long": -9223372036854775806, "string": ""}
RANGES = {"byte": (-128, 127), "short": (-32768, 32767), "int": (-2147483648, 2147483647), "long": (-(2**63), 2**63 - 1)}


def cast_rounded(value: Column, to: str, *, missing: dict[float, float] | None = None, outside: float | None = None) -> Column:
    """Cast to a whole-number type, halves away from zero.

    missing: input values and what stands for them; outside: what stands for values out of the type's range (default: its fill).
    """
    low, high = RANGES[to]
    away = F.when(value < 0, -F.floor(F.abs(value) + 0.5)).otherwise(F.floor(F.abs(value) + 0.5))
    replaced = F.lit(FILLS[to] if outside is None else outside)
    fits = (away >= low) & (away <= high)
    out = F.when(fits, away.try_cast(to)).when(value.isNotNull(), replaced.cast(to))
    for source, target in (missing or {}).items():
        out = F.when(value == source, F.lit(target).cast(to)).otherwise(out)
    return out


def missing_map(missing: Sequence[float], to: str) -> dict[float, float]:
    """Missing values in another type: themselves if they fit, else the first that does, else the type's fill."""
    low, high = RANGES.get(to, (float("-inf"), float("inf")))
    fits = [m for m in missing if low <= m <= high and (to not in RANGES or float(m).is_integer())]
    return {m: m if m in fits else (fits[0] if fits else FILLS[to]) for m in missing}
