"""Column catalogs: canonical names, aliases with fallbacks, and reverse Polish expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import names

# Operators of the track catalog's expressions.
OPERATORS = {"ADD": lambda a, b: a + b, "SUB": lambda a, b: a - b, "MUL": lambda a, b: a * b}


def compile_rpn(expression: str, columns: dict[str, Column] | None = None) -> Column:
    """A column from a reverse Polish expression: names, numbers, ADD, SUB, MUL, SQRT; `:name` is a file attribute."""
    stack: list[Column] = []
    for token in expression.split():
        if token in OPERATORS:
            if len(stack) < 2:
                raise ValueError(f"{token} lacks operands in {expression!r}")
            b, a = stack.pop(), stack.pop()
            stack.append(OPERATORS[token](a, b))
        elif token == "SQRT":
            if not stack:
                raise ValueError(f"SQRT lacks an operand in {expression!r}")
            x = stack.pop()
            stack.append(F.when(x >= 0, F.sqrt(x)))
        else:
            try:
                stack.append(F.lit(float(token)))
            except ValueError:
                stack.append((columns or {}).get(token, F.col(token.removeprefix(":"))))
    if len(stack) != 1:
        raise ValueError(f"{expression!r} leaves {len(stack)} values")
    return stack[0]


@dataclass
class Variable:
    """A catalog entry: an expression or the first alias that exists, limits, default, gating flags, by satellite if need be."""

    name: str
    expression: str | None = None
    aliases: tuple[str, ...] = ()
    limits: tuple[float, float] | None = None
    default: float | None = None
    flags: tuple[str, ...] = ()
    by_satellite: dict[str, str] = field(default_factory=dict)
    #: Names of which the first that has a value counts, each list for the satellites of a selector ("": all).
    fallbacks: list[tuple[str, tuple[str, ...]]] = field(default_factory=list)

    def column(self, available: list[str], satellite: str = "") -> Column:
        expression = next((e for sel, e in self.by_satellite.items() if selected(sel, satellite)), self.expression)
        if expression is not None:
            out = compile_rpn(expression)
        else:
            names = [a for a in (self.name, *self.aliases) if a in available]
            out = F.coalesce(*[F.col(a).cast("double") for a in names]) if names else F.lit(None).cast("double")
        if self.limits is not None:
            out = F.when(out.between(*self.limits), out)
        for f in self.flags:
            out = F.when(F.col(f) == 0, out)
        if self.default is not None:
            out = F.coalesce(out, F.lit(self.default))
        return out.alias(self.name)


def selected(selector: str, satellite: str) -> bool:
    """Whether a satellite selector ("j1 j2", "!c2 g1" for all but) takes a satellite."""
    names = selector.replace("!", " ").split()
    return (satellite not in names) if selector.strip().startswith("!") else satellite in names


def read_catalog(text: str) -> list[Variable]:
    """Variables of a track catalog in XML: <var name sat> with <data sat>, <limits>, <default> and <quality_flag>, and <alias name sat>.

    Data with operators is an expression; single names are aliases. Names of variables that occur again for other
    satellites are one variable with an expression by satellite.
    """
    out: dict[str, Variable] = {}
    for e in ElementTree.fromstring(f"<catalog>{re.sub(r'^<[?]xml[^>]*>', '', text.strip())}</catalog>").iter():
        name = e.get("name")
        if e.tag == "alias":
            out.setdefault(name, Variable(name)).fallbacks.append((e.get("sat") or "", tuple((e.text or "").split())))
        if e.tag != "var":
            continue
        one = lambda tag, e=e: next((x.text.split() for x in e.iter(tag) if x.text and x.text.strip()), [])
        data = [(x.get("sat") or e.get("sat"), " ".join((x.text or "").split())) for x in e.iter("data")]
        v = out.setdefault(name, Variable(name))
        for satellites, expression in data:
            if satellites:
                v.by_satellite[satellites] = expression
            elif " " in expression:
                v.expression = expression
            else:
                v.aliases = (*v.aliases, expression.removeprefix(":"))
        limits, default = one("limits"), one("default")
        v.limits = tuple(map(float, limits)) if len(limits) == 2 else v.limits
        v.default = float(default[0]) if default else v.default
        v.flags = tuple(dict.fromkeys((*v.flags, *one("quality_flag"))))
    return list(out.values())


def _names(expression: str) -> list[str]:
    """The names that an expression reads."""
    return [t.removeprefix(":") for t in expression.split() if t not in OPERATORS and t != "SQRT" and not re.fullmatch(r"[-+]?[0-9.]+(e[-+]?[0-9]+)?", t, re.IGNORECASE)]


def _source(v: Variable, satellite: str) -> tuple[str | None, list[str]]:
    """A variable's expression for a satellite, or the names that it falls back on, best first."""
    expression = next((e for sel, e in v.by_satellite.items() if selected(sel, satellite)), v.expression)
    listed = [n for sel, found in v.fallbacks if not sel or selected(sel, satellite) for n in found]
    return expression, [*v.aliases, *listed] or [v.name]


def ordered(catalog: list[Variable], satellite: str = "") -> list[Variable]:
    """The variables, each after those that it reads or is gated by; a circle is an error. A variable's own name is a column's."""
    by, done, out = {v.name: v for v in catalog}, {}, []

    def visit(v: Variable, path: tuple[str, ...]) -> None:
        if done.get(v.name):
            return
        if v.name in path:
            raise ValueError(f"variables read each other: {' '.join([*path, v.name])}")
        expression, listed = _source(v, satellite)
        for n in (*(_names(expression) if expression is not None else listed), *v.flags):
            if n in by and n != v.name:
                visit(by[n], (*path, v.name))
        done[v.name] = True
        out.append(v)

    for v in catalog:
        visit(v, ())
    return out


def select_catalog(df: DataFrame, catalog: list[Variable], satellite: str = "") -> DataFrame:
    """The catalog's variables of each row of df, whatever the order in which they are given.

    A name is another variable of the catalog, or else a column of df, or else nothing (NULL).  A variable is valid where it
    has a value within its limits and all names in its quality list are valid; elsewhere it is its default, if it has one,
    and still not valid to others.  In a quality list a column that is no variable is valid if it has a value, a flag (of
    whole numbers) if it is 0.
    """
    kinds = dict(df.dtypes)
    by = {v.name for v in catalog}
    work = df.select(*[F.col(f"`{c}`").alias(f"c_{c}") for c in df.columns])

    def read(name: str, of: str) -> Column:
        if name in by and name != of:
            return F.col(f"`v_{name}`")
        return F.col(f"`c_{name}`").cast("double") if name in kinds else F.lit(None).cast("double")

    def valid(name: str, of: str) -> Column:
        if name in by and name != of:
            return F.col(f"`ok_{name}`")
        whole = kinds.get(name) in ("tinyint", "smallint", "int", "bigint")
        return F.coalesce(read(name, of) == 0, F.lit(False)) if whole else read(name, of).isNotNull()

    for v in ordered(catalog, satellite):
        expression, listed = _source(v, satellite)
        if expression is not None:
            value = compile_rpn(expression, {token: read(token.removeprefix(":"), v.name) for token in expression.split()})
        else:
            value = F.coalesce(*[read(n, v.name) for n in listed])
        ok = value.isNotNull() if v.limits is None else F.coalesce(value.between(*v.limits), F.lit(False))
        for n in v.flags:
            ok &= valid(n, v.name)
        work = work.withColumn(f"v_{v.name}", value).withColumn(f"ok_{v.name}", ok)
        work = work.withColumn(f"v_{v.name}", F.when(F.col(f"`ok_{v.name}`"), F.col(f"`v_{v.name}`")).otherwise(F.lit(v.default).cast("double")))
    return work.select(*[F.col(f"`v_{v.name}`").alias(v.name) for v in catalog])


HEIGHT = "alt range_ku SUB dry_tropo_ecmwf SUB wet_tropo_rad SUB iono_alt SUB inv_bar_mog2d SUB tide_solid SUB tide_ocean_fes14 SUB tide_load_fes14 SUB tide_pole SUB ssb_cls SUB mss_dtu21 SUB"
#: Track catalog: names as in track files, sea level anomaly as an expression.
TRACKS = [
    Variable("off_nadir_angle_wf_ku", "off_nadir_angle2_wf_ku SQRT"),
    Variable("rad_distance_to_land", "dist_coast 1000 MUL"),
    Variable("ssha", HEIGHT),
]

def resolve(name: str, version: int, mission: str = "j3", retracker: str = "ocean") -> str:
    """The product's path of a canonical column: "ku.range_ocean" in nested files (version 3), a flat name otherwise.

    Columns that a product names as they are canonically keep their name; unknown versions, missions and retrackers are errors.
    """
    leaf = names.names(version, mission, retracker).get(name, name)
    if version != 3:
        return leaf
    group = names.group(name, leaf, mission)
    return f"{group}.{leaf}" if group else leaf


def canonical(df: DataFrame, columns: list[str], version: int, mission: str = "j3", retracker: str = "ocean") -> DataFrame:
    """Product records under canonical names; only the leaves asked for are read.

    The adaptive retracker has no C-band range, so records of it are refused.
    """
    if retracker == "adaptive":
        raise ValueError("records of the adaptive retracker lack a C-band range")
    return df.select(*[F.col(resolve(n, version, mission, retracker)).alias(n) for n in columns])


def adaptive_anomaly(row: str = "ku") -> Column:
    """Height anomaly of the adaptive retracker: the ocean one with the changes of range, ionosphere and bias."""
    change = lambda c, d: F.col(f"{row}.{c}") - F.col(f"{row}.{d}")
    return F.col(f"{row}.ssha") + change("range_ocean", "range_adaptive") + change("iono_cor_alt_filtered", "iono_cor_alt_filtered_adaptive") + change("sea_state_bias", "sea_state_bias_adaptive")


def bands(columns: list[str], version: int = 3, mission: str = "j3") -> dict[str, list[str]]:
    """Canonical names by band: Ku, C, and neither; in version 3 by the group that the product keeps them in."""
    out: dict[str, list[str]] = {"ku": [], "c": [], "": []}
    table = names.names(version, mission)
    for n in columns:
        if version == 3:
            found = names.group(n, table.get(n, n), mission) or ""
        else:
            parts = n.split("_")
            found = "ku" if "ku" in parts else "c" if "c" in parts else ""
        out[found].append(n)
    return out


# Perturbations whose products share another one's files.
ERR_FILES = {"rms_rws": "rms_ws", "rms_rw": "rms_w", "rms_wx": "rms_w", "rms_Ewr": "rms_Ew", "rms_rs": "rms_s", "rms_r": None, "rng_corr": None}


def partition_keys(mission: str, method: str, variable: str, *, err: str | None = None, band: str = "ku", second: str = "u10", cycles: tuple[int, int] | None = None) -> dict[str, object]:
    """A product's place in the catalog: partition columns, not parsed names."""
    out: dict[str, object] = {"mission": mission, "method": method, "variable": variable, "err": ERR_FILES.get(err, err) if err else None, "band": band, "second": second}
    if cycles:
        out |= {"first_cycle": cycles[0], "last_cycle": cycles[1]}
    return out
