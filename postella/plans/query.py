"""Boolean queries: plain terms are required, `*` marks alternatives, `-` exclusions, both a set of excluded alternatives."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field
from itertools import combinations


@dataclass
class Query:
    """Genes by role, after names are resolved. Empty roles don't restrict."""

    required: list[str] = field(default_factory=list)
    any_of: list[str] = field(default_factory=list)
    excluded: list[str] = field(default_factory=list)
    excluded_any: list[str] = field(default_factory=list)

    @property
    def genes(self) -> list[str]:
        return list(dict.fromkeys(self.required + self.any_of + self.excluded + self.excluded_any))

    @property
    def only_excludes(self) -> bool:
        return not self.required and not self.any_of


def role_of(term: str) -> tuple[str, str]:
    """The role and bare name of a term."""
    head = term[: len(term) - len(term.lstrip("*-"))][:2]
    name = term[len(head) :]
    if "*" in head and "-" in head:
        return "excluded_any", name
    return {"*": "any_of", "-": "excluded"}.get(head[:1], "required"), term[1:] if head else term


def parse(terms: list[str], resolve) -> Query:
    """The query of the terms; resolve maps bare names to the index's names and drops unknown ones."""
    if not isinstance(terms, (list, tuple)) or not all(isinstance(t, str) for t in terms):
        return Query()
    by: dict[str, list[str]] = {}
    for t in terms:
        role, name = role_of(t)
        by.setdefault(role, []).append(name)
    known = resolve([n for names in by.values() for n in names])
    out = Query(**{role: list(dict.fromkeys(known[n] for n in names if n in known)) for role, names in by.items()})
    roles = {role: set(getattr(out, role)) for role in by}
    if clash := sorted({g for a, b in combinations(roles, 2) for g in roles[a] & roles[b]}):
        warnings.warn(f"genes with more than one operator: {', '.join(clash)}; first those required count, then the alternatives, then both kinds of exclusions", stacklevel=3)
    return out
