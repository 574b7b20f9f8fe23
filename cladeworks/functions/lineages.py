"""SQL fragments over lineages.

A lineage is an array of seven names, kingdom first, null where a rank is
absent; ranks are the indices 0 to 6.  ``E`` is what the input expects.  All
but ``extract`` and ``cut`` are written out by rank, without lambda functions, so that Spark compiles them.
"""

from __future__ import annotations

from ..constants import INVALID, KINGDOMS, RANKS, WHITE_SPACE

_BLANK = "'" + "".join(f"\\u{ord(x):04x}" for x in WHITE_SPACE) + "'"
_EVERY = range(len(RANKS))


def strip(x: str) -> str:
    return f"btrim({x}, {_BLANK})"


def rank_index(x: str) -> str:
    return f"(case {x} " + " ".join(f"when '{r}' then {i}" for i, r in enumerate(RANKS)) + " end)"


def rank_name(x: str) -> str:
    return f"(case {x} " + " ".join(f"when {i} then '{r}'" for i, r in enumerate(RANKS)) + " end)"


def kingdom(x: str) -> str:
    """Canonical kingdom, null if invalid."""
    words = ", ".join(f"'{w}'" for w in INVALID)
    cases = " ".join(f"when '{k}' then '{v}'" for k, v in KINGDOMS.items())
    return f"(case when {x} is null or lower({strip(x)}) in ({words}) then null else case lower({strip(x)}) {cases} else {strip(x)} end end)"


def extract(path: str, ranks: str) -> str:
    """The lineage in a ``|``-separated path; of a repeated rank the last one counts, names beyond either list are ignored."""
    pairs = f"zip_with(split(coalesce({ranks}, ''), '[|]', -1), split(coalesce({path}, ''), '[|]', -1), (r, t) -> struct(r, t))"
    at = [f"try_element_at(filter({pairs}, x -> x.r = '{r}' and x.t is not null), -1).t" for r in RANKS]
    return f"(case when {path} <> '' and {ranks} <> '' then array({', '.join(at)}) else cast(array({', '.join(['null'] * 7)}) as array<string>) end)"


def some(c: str) -> str:
    return "(coalesce(" + ", ".join(f"{c}[{i}]" for i in _EVERY) + ") is not null)"


def conflict(e: str, c: str) -> str:
    """The coarsest rank whose expected name is not the one in ``c``; 7 without any."""
    return "(case " + " ".join(f"when {e}[{i}] is not null and not ({e}[{i}] <=> {c}[{i}]) then {i}" for i in _EVERY) + " else 7 end)"


def agrees(e: str, c: str, upto: str) -> str:
    """Whether the expected lineage has a name and all its names up to a rank are in ``c``; false without a rank."""
    return f"coalesce({some(e)} and {conflict(e, c)} > ({upto}), false)"


def rank_of(term: str, c: str) -> str:
    """Index of the most specific rank whose stripped name is ``term``; null if none."""
    return "(case " + " ".join(f"when {strip(f'{c}[{i}]')} = {term} then {i}" for i in reversed(_EVERY)) + " end)"


def deepest(c: str) -> str:
    return "(case " + " ".join(f"when {c}[{i}] is not null then {i}" for i in reversed(_EVERY)) + " end)"


def cut(c: str, upto: str) -> str:
    """A lineage down to a rank; uncut without one."""
    return f"transform({c}, (x, i) -> if(i <= coalesce({upto}, 6), x, null))"


def score(e: str, c: str, e_kingdom: str, c_kingdom: str) -> str:
    """Number of ranks on which two lineages agree: kingdoms by their canonical names, others without case."""
    same = [f"{e}[0] <> '' and {c}[0] <> '' and {e_kingdom} = {c_kingdom}", *[f"{e}[{i}] <> '' and lower({e}[{i}]) = lower({c}[{i}])" for i in _EVERY[1:]]]
    return "(" + " + ".join(f"if({x}, 1, 0)" for x in same) + ")"
