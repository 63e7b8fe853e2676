"""Query strings: grammar, printing, rewrites, the catalogue of shapes, and query graphs.

    formula := unit | unit ('&' | '|') formula       right-associative, equal precedence
    unit    := '(' formula ')' | '!' atom | atom     the atom behind '!' may stand in brackets
    atom    := NAME '(' TERM ',' TERM ')'            a term's first letter tells its kind

No blanks are trimmed. All errors are ValueErrors.
"""
import re
from dataclasses import dataclass
from functools import cached_property
from itertools import product

CONSTANT, EXISTENTIAL, FREE = 0, 1, 2
KINDS = {"s": CONSTANT, "e": EXISTENTIAL, "f": FREE}


def kind_of(term: str) -> int:
    if not term or term[0] not in KINDS:
        raise ValueError(f"unknown kind of term {term!r}")
    return KINDS[term[0]]


@dataclass(frozen=True)
class Atom:
    relation: str
    head: str
    tail: str

    def text(self) -> str:
        return f"{self.relation}({self.head},{self.tail})"


@dataclass(frozen=True)
class Not:
    part: "Formula"

    def text(self) -> str:
        return f"!({self.part.text()})"


@dataclass(frozen=True)
class And:
    parts: tuple

    def text(self) -> str:
        return "&".join(f"({p.text()})" for p in self.parts)


@dataclass(frozen=True)
class Or:
    parts: tuple

    def text(self) -> str:
        return "|".join(f"({p.text()})" for p in self.parts)


Formula = Atom | Not | And | Or
_ATOM = re.compile(r"([^()&|!,]+)\(([^()&|!,]+),([^()&|!,]+)\)")


def parse(text: str) -> Formula:
    if not text:
        raise ValueError("an empty query")
    out, at = _formula(text, 0)
    if at != len(text):
        raise ValueError(f"{text[at:]!r} is left over")
    return out


def _formula(text: str, at: int) -> tuple[Formula, int]:
    left, at = _unit(text, at)
    if at < len(text) and text[at] in "&|":
        right, end = _formula(text, at + 1)
        return (And if text[at] == "&" else Or)((left, right)), end
    return left, at


def _unit(text: str, at: int) -> tuple[Formula, int]:
    if text.startswith("(", at):
        out, at = _formula(text, at + 1)
        if not text.startswith(")", at):
            raise ValueError("a bracket isn't closed")
        return out, at + 1
    if text.startswith("!", at):
        out, at = _unit(text, at + 1)
        if not isinstance(out, Atom):
            raise ValueError("only atoms can be negated")
        return Not(out), at
    m = _ATOM.match(text, at)
    if not m:
        raise ValueError(f"no atom at {text[at:]!r}")
    kind_of(m[2]), kind_of(m[3])
    return Atom(*m.groups()), m.end()


def canonical(text: str) -> str:
    return parse(text).text()


def atoms(f: Formula) -> list[Atom]:
    """Distinct atoms in the order of their first visit."""
    if isinstance(f, Atom):
        return [f]
    parts = (f.part,) if isinstance(f, Not) else f.parts
    return list(dict.fromkeys(a for p in parts for a in atoms(p)))


def negation_normal(f: Formula, negate: bool = False) -> Formula:
    """De Morgan: negations on atoms only, double ones gone."""
    if isinstance(f, Atom):
        return Not(f) if negate else f
    if isinstance(f, Not):
        return negation_normal(f.part, not negate)
    return (And if isinstance(f, And) != negate else Or)(tuple(negation_normal(p, negate) for p in f.parts))


def clauses(f: Formula) -> list[list[Formula]]:
    """The disjuncts of the normal form, each a list of literals; left disjuncts come first. Nothing is
    dropped: equal and contradictory clauses stay."""
    f = negation_normal(f)
    if isinstance(f, Or):
        return [c for p in f.parts for c in clauses(p)]
    if isinstance(f, And):
        return [[x for c in some for x in c] for some in product(*(clauses(p) for p in f.parts))]
    return [[f]]


def normal_form(f: Formula) -> Or:
    return Or(tuple(And(tuple(c)) for c in clauses(f)))


@dataclass(frozen=True)
class Clause:
    """A conjunction. An atom that occurs both ways contradicts itself."""

    positive: tuple[Atom, ...]
    negative: tuple[Atom, ...]

    @cached_property
    def contradicts(self) -> bool:
        return bool(set(self.positive) & set(self.negative))

    @cached_property
    def variables(self) -> list[str]:
        return list(dict.fromkeys(t for a in self.positive + self.negative for t in (a.head, a.tail) if kind_of(t) != CONSTANT))

    def levels(self, root: str = "f") -> dict[str, int]:
        """Breadth-first distance from the root over all atoms; constants don't connect."""
        out, edge = {root: 0}, [root]
        while edge:
            near = [t for v in edge for a in self.positive + self.negative if v in (a.head, a.tail) for t in (a.head, a.tail) if kind_of(t) != CONSTANT and t not in out]
            edge = list(dict.fromkeys(near))
            out |= {t: out[v] + 1 for t in edge for v in [min((v for v in out if any({t, v} == {a.head, a.tail} for a in self.positive + self.negative)), key=out.get)]}
        return out


@dataclass(frozen=True)
class Query:
    """One shape: formula, its terms and clauses."""

    formula: Formula

    @classmethod
    def read(cls, text: str, shared_relations: bool = False) -> "Query":
        q = cls(parse(text))
        names = [a.relation for a in q.atoms]
        if not shared_relations and len(set(names)) < len(names):
            raise ValueError("two atoms share a relation name")
        return q

    @cached_property
    def atoms(self) -> list[Atom]:
        return atoms(self.formula)

    @cached_property
    def terms(self) -> dict[str, int]:
        return {t: kind_of(t) for a in self.atoms for t in (a.head, a.tail)}

    def of_kind(self, kind: int) -> list[str]:
        return [t for t, k in self.terms.items() if k == kind]

    @property
    def is_sentence(self) -> bool:
        return not self.of_kind(FREE)

    @property
    def names(self) -> list[str]:
        """What an instance binds: relations and constants."""
        return list(dict.fromkeys([*(a.relation for a in self.atoms), *self.of_kind(CONSTANT)]))

    @property
    def num_variables(self) -> int:
        return len(self.terms) - len(self.of_kind(CONSTANT))

    @cached_property
    def clauses(self) -> list[Clause]:
        return [Clause(tuple(dict.fromkeys(x for x in c if isinstance(x, Atom))), tuple(dict.fromkeys(x.part for x in c if isinstance(x, Not)))) for c in clauses(self.formula)]

    def text(self) -> str:
        return self.formula.text()


#: The evaluation catalogue, name to query string.
CATALOGUE = {
    "1p": "r1(s1,f)",
    "2p": "r1(s1,e1)&r2(e1,f)",
    "3p": "r1(s1,e1)&r2(e1,e2)&r3(e2,f)",
    "2i": "r1(s1,f)&r2(s2,f)",
    "3i": "r1(s1,f)&r2(s2,f)&r3(s3,f)",
    "ip": "r1(s1,e1)&r2(s2,e1)&r3(e1,f)",
    "pi": "r1(s1,e1)&r2(e1,f)&r3(s2,f)",
    "2in": "r1(s1,f)&!r2(s2,f)",
    "3in": "r1(s1,f)&r2(s2,f)&!r3(s3,f)",
    "inp": "r1(s1,e1)&!r2(s2,e1)&r3(e1,f)",
    "pin": "r1(s1,e1)&r2(e1,f)&!r3(s2,f)",
    "pni_beta": "r1(s1,e1)&!r2(e1,f)&r3(s2,f)",
    "2u": "r1(s1,f)|r2(s2,f)",
    "up": "(r1(s1,e1)|r2(s2,e1))&r3(e1,f)",
    "up-dnf": "(r1(s1,e1)&r3(e1,f))|(r2(s2,e1)&r3(e1,f))",
    "2m": "((r1(s1,e1))&(r2(e1,f)))&(r3(e1,f))",
    "2nm": "((r1(s1,e1))&(r2(e1,f)))&(!(r3(e1,f)))",
    "3mp": "(((r1(s1,e1))&(r2(e1,e2)))&(r3(e2,f)))&(r4(e1,e2))",
    "3pm": "(((r1(s1,e1))&(r2(e1,e2)))&(r3(e2,f)))&(r4(e2,f))",
    "im": "(((r1(s1,e1))&(r2(s2,e1)))&(r3(e1,f)))&(r4(e1,f))",
    "2il": "(r1(s1,f))&(r2(e1,f))",
    "3il": "((r1(s1,f))&(r2(s2,f)))&(r3(e1,f))",
    "3c": "((((r1(s1,e1))&(r2(e1,f)))&(r3(s2,e2)))&(r4(e2,f)))&(r5(e1,e2))",
    "3cm": "(((((r1(s1,e1))&(r2(e1,f)))&(r3(s2,e2)))&(r4(e2,f)))&(r5(e1,e2)))&(r6(e1,f))",
    "3pcp": "(((((r1(s1,e1))&(r2(e1,e3)))&(r3(s2,e2)))&(r4(e2,e3)))&(r5(e1,e2)))&(r6(e3,f))",
    "pni": "((r1(s1,e1))&(!(r2(e1,f))))&(r3(s2,f))",
}
#: Canonical string to name; "pni" has two strings.
NAMES = {canonical(s): n.removesuffix("_beta") for n, s in CATALOGUE.items()}
