"""Three-part model formulas: response ~ slopes | fixed effects | clusters."""

from __future__ import annotations

import re
from dataclasses import dataclass

Term = tuple[str, ...]  # columns multiplied with each other
NAME = re.compile(r"\s*(`[^`]+`|[A-Za-z_.][A-Za-z0-9_.]*|%in%|[0-9]+|[-+*:^/()])")


class FormulaError(ValueError):
    pass


@dataclass(frozen=True)
class ModelSpec:
    response: str
    terms: tuple[Term, ...]
    fe: tuple[str, ...] = ()
    clusters: tuple[str, ...] = ()
    intercept: bool = True

    @property
    def columns(self) -> list[str]:
        return list(dict.fromkeys([self.response, *(c for t in self.terms for c in t), *self.fe, *self.clusters]))

    def __str__(self) -> str:
        rhs = " + ".join([":".join(t) for t in self.terms] + ([] if self.intercept or self.fe else ["0"])) or ("1" if self.intercept else "0")
        parts = [rhs, " + ".join(self.fe), " + ".join(self.clusters)]
        while len(parts) > 1 and not parts[-1]:
            parts.pop()
        return f"{self.response} ~ " + " | ".join(p or "0" for p in parts)

    def update(self, text: str) -> ModelSpec:
        """`.` keeps a side or part, an empty part drops it, a missing part keeps it."""
        lhs, _, rhs = text.partition("~")
        parts = [p.strip() for p in rhs.split("|")]
        own = str(self).partition("~")[2].split("|")
        own = [p.strip() for p in own] + ["0"] * (3 - len(own))
        new = [own[i] if i >= len(parts) else re.sub(r"(?<![\w.`])\.(?![\w.`])", f"({own[i]})" if i == 0 else own[i], parts[i]) or "0" for i in range(3)]
        return parse(f"{self.response if lhs.strip() in ('', '.') else lhs.strip()} ~ {' | '.join(new)}")


def _split(text: str, at: str) -> list[str]:
    """Parts of text at a character that stands neither in parentheses nor between backticks."""
    parts, depth, quoted = [""], 0, False
    for c in text:
        quoted ^= c == "`"
        depth += 0 if quoted else (c == "(") - (c == ")")
        if c == at and not depth and not quoted:
            parts.append("")
        else:
            parts[-1] += c
    return parts


def _no_functions(text: str) -> None:
    found = re.search(r"([A-Za-z_.][A-Za-z0-9_.]*)\s*\(", re.sub(r"`[^`]*`", "1", text))
    if found:
        raise FormulaError(f"this model does not support functions in formulas (found '{found[1]}'); create the column before fitting")


def _terms(text: str, others: list[str]) -> tuple[list[Term], bool]:
    """Terms of one part in the order of a model formula (main effects, then by degree), and whether an intercept is left."""
    tokens, pos = [], 0
    while text[pos:].strip():
        m = NAME.match(text, pos)
        if not m:
            raise FormulaError(f"cannot read formula at '{text[pos:].strip()}'")
        tokens.append(m[1])
        pos = m.end()
    at = 0

    def peek():
        return tokens[at] if at < len(tokens) else None

    def take():
        nonlocal at
        at += 1
        return tokens[at - 1]

    def merge(a: Term, b: Term) -> Term:
        return tuple(dict.fromkeys(a + b))

    def union(a, b):
        return list({frozenset(t): t for t in [*b[::-1], *a[::-1]]}.values())[::-1]

    def primary():
        if peek() is None:
            raise FormulaError("formula ends too early")
        t = take()
        if t == "(":
            out = sums()
            if peek() != ")":
                raise FormulaError("')' is missing")
            take()
            return out
        if t == "-":
            return [("-", *x) for x in primary()]
        if t == ".":
            return [(c,) for c in others]
        if t.isdigit():
            if t not in "01":
                raise FormulaError(f"'{t}' is no term")
            return [("#" + t,)]
        if t in "+*:^/)" or t == "%in%":
            raise FormulaError(f"'{t}' is out of place")
        return [(t.strip("`"),)]

    def power():
        out = primary()
        while peek() == "^":
            take()
            n = take()
            if not n.isdigit() or n == "0":
                raise FormulaError("'^' needs a whole number")
            base = out
            for _ in range(int(n) - 1):
                out = union(out, [merge(a, b) for a in out for b in base])
        return out

    def inside():
        out = power()
        while peek() == "%in%":
            take()
            out = [merge(a, b) for a in out for b in power()]
        return out

    def slash():
        out = crossing()
        while peek() == "/":
            take()
            right = crossing()
            whole: Term = ()
            for a in out:
                whole = merge(whole, a)
            out = union(out, [merge(whole, b) for b in right])
        return out

    def crossing():
        out = colon()
        while peek() == "*":
            take()
            right = colon()
            out = union(union(out, right), [merge(a, b) for a in out for b in right])
        return out

    def colon():
        out = inside()
        while peek() == ":":
            take()
            out = [merge(a, b) for a in out for b in inside()]
        return out

    def sums():
        out = [] if peek() in ("+", "-") else slash()
        while peek() in ("+", "-"):
            sign = take()
            right = slash()
            if sign == "+":
                out = union(out, right)
            else:
                gone = {frozenset(t) for t in right}
                out = [t for t in out if frozenset(t) not in gone] + ([("#0",)] if frozenset(("#1",)) in gone else [("#1",)] if frozenset(("#0",)) in gone else [])
        return out

    found = sums() if tokens else []
    if at < len(tokens):
        raise FormulaError(f"'{tokens[at]}' is out of place")
    marks = [t[0] for t in found if t[0] in ("#0", "#1") and len(t) == 1]
    terms = [t for t in found if not t[0].startswith("#")]
    return sorted(terms, key=len), not (marks and marks[-1] == "#0")


def parse(formula: str, columns: list[str] | None = None) -> ModelSpec:
    """Read a formula. columns: those of the table, for `.` (all that stand nowhere else)."""
    if formula is None:
        raise FormulaError("'formula' has to be specified.")
    if not isinstance(formula, str) or "~" not in formula:
        raise FormulaError("'formula' has to be of class 'formula'.")
    lhs, _, rhs = formula.partition("~")
    if not lhs.strip():
        raise FormulaError("'formula' must have a response variable.")
    _no_functions(lhs)
    parts = _split(rhs, "|")
    if len(parts) > 3:
        raise FormulaError("'formula' has more than three parts.")
    for p in parts:
        _no_functions(p)
    response = lhs.strip().strip("`")
    names = [[x.strip() for x in _split(p, "+") if x.strip() and x.strip() != "0"] for p in parts[1:]]
    used = {response, *(x.strip("`") for n in names for x in n)}
    terms, intercept = _terms(parts[0], [c for c in columns or [] if c not in used])
    terms = [t for t in terms if t != (response,)]
    keys = [tuple(dict.fromkeys(x.strip("`") for x in n)) for n in names] + [(), ()]
    return ModelSpec(response, tuple(terms), keys[0], keys[1], intercept and not keys[0])

