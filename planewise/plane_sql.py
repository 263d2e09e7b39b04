"""DuckDB SQL of fitted planes, for oracles: eigenvectors by repeated squaring, inverses by Newton's iteration.

A matrix is a list of rows.  The powers of a matrix with a largest eigenvalue, divided by
their trace, converge to the projector on its eigenvector; ``SQUARINGS`` squarings are
enough for any gap that a double can tell.  Taking the projector's part away leaves the
next eigenvector the largest.
"""

from __future__ import annotations

from collections.abc import Sequence

SQUARINGS = 44
NEWTON_STEPS = 60


def transposed(m: str, k: int) -> str:
    return f"list_transform(range(1, {k + 1}), lambda tc: list_transform({m}, lambda tr: tr[tc]))"


def product(a: str, b: str, k: int) -> str:
    """Of two K x K matrices that are plain names."""
    return f"list_transform({a}, lambda pr: list_transform({transposed(b, k)}, lambda pc: list_dot_product(pr, pc)))"


def combined(a: str, b: str, k: int, form: str) -> str:
    """Entry by entry: ``form`` of {a} and {b}."""
    return f"list_transform(range(1, {k + 1}), lambda ci: list_transform(range(1, {k + 1}), lambda cj: {form.format(a=f'{a}[ci][cj]', b=f'{b}[ci][cj]')}))"


def trace(m: str, k: int) -> str:
    return "(" + " + ".join(f"{m}[{i}][{i}]" for i in range(1, k + 1)) + ")"


def scatter(name: str, source: str, vec: str, k: int, centre: str | None = None) -> str:
    """CTE ``name(m)``: sum of outer products of ``vec`` in ``source`` about their mean, or about the number ``centre``."""
    at = lambda i: f"avg({vec}[{i}])" if centre is None else centre
    entry = lambda i, j: f"sum({vec}[{i}] * {vec}[{j}]) - count(*) * ({at(i)} * avg({vec}[{j}]) + avg({vec}[{i}]) * {at(j)} - {at(i)} * {at(j)})"
    rows = ", ".join("[" + ", ".join(entry(i, j) for j in range(1, k + 1)) + "]" for i in range(1, k + 1))
    return f"{name} AS (SELECT [{rows}] AS m FROM {source})"


def axes(name: str, matrix: str, k: int, count: int) -> str:
    """CTEs ``name1(v) .. nameN(v)``: unit eigenvectors of the matrix in CTE ``matrix(m)``, from the largest eigenvalue; it may be unsymmetric."""
    out, held = [], matrix
    for n in range(1, count + 1):
        out.append(f"{name}p{n}(t, m) AS (SELECT 0, list_transform(m, lambda r: list_transform(r, lambda x: x / {trace('m', k)})) FROM {held} UNION ALL SELECT t + 1, (SELECT list_transform(q, lambda r: list_transform(r, lambda x: x / {trace('q', k)})) FROM (SELECT {product('m', 'm', k)} AS q)) FROM {name}p{n} WHERE t < {SQUARINGS})")
        out.append(f"{name}q{n} AS (SELECT m AS q FROM {name}p{n} WHERE t = {SQUARINGS})")
        # A column of the projector, the one of the largest diagonal entry.
        column = f"list_transform(q, lambda r: r[list_position(list_transform(range(1, {k + 1}), lambda i: abs(q[i][i])), list_max(list_transform(range(1, {k + 1}), lambda i: abs(q[i][i]))))])"
        out.append(f"{name}{n} AS (SELECT list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) AS v FROM (SELECT {column} AS c FROM {name}q{n}))")
        if n < count:
            value = f"list_sum(list_transform(range(1, {k + 1}), lambda i: list_dot_product(m[i], list_transform(q, lambda r: r[i]))))"
            out.append(f"{name}d{n} AS (SELECT {combined('m', 'q', k, '{a} - l * {b}')} AS m FROM (SELECT h.m, p.q, {value} AS l FROM {held} h, {name}q{n} p))")
            held = f"{name}d{n}"
    return ", ".join(out)


def inverse(name: str, matrix: str, k: int) -> str:
    """CTE ``name(m)``: the inverse of the matrix in CTE ``matrix(m)``."""
    eye = "[" + ", ".join("[" + ", ".join(str(float(i == j)) for j in range(k)) + "]" for i in range(k)) + "]"
    norm = lambda m: f"list_max(list_transform({m}, lambda r: list_sum(list_transform(r, lambda x: abs(x)))))"
    first = f"SELECT 0, list_transform({transposed('m', k)}, lambda r: list_transform(r, lambda x: x / (n1 * n2))), m FROM (SELECT m, {norm('m')} AS n1, {norm(transposed('m', k))} AS n2 FROM {matrix})"
    step = f"SELECT t + 1, (SELECT {product('x', 'r', k)} FROM (SELECT x, {combined('e', 'p', k, '2 * {a} - {b}')} AS r FROM (SELECT x, {eye} AS e, {product('w', 'x', k)} AS p))), w FROM {name}n WHERE t < {NEWTON_STEPS}"
    return f"{name}n(t, x, w) AS ({first} UNION ALL {step}), {name} AS (SELECT x AS m FROM {name}n WHERE t = {NEWTON_STEPS})"


def canonical(v: str) -> str:
    """A vector with its largest entry positive."""
    return f"list_transform({v}, lambda x: x * (CASE WHEN list_max({v}) >= -list_min({v}) THEN 1 ELSE -1 END))"


def plane(name: str, first: str, second: str, orthonormal: bool = False) -> str:
    """CTE ``name(a, b)``: the canonical plane of the vectors in two CTEs, made orthonormal first if asked."""
    rest = "list_transform(range(1, len(u) + 1), lambda i: w[i] - list_dot_product(u, w) * u[i])" if orthonormal else "w"
    return f"{name} AS (SELECT {canonical('u')} AS a, {canonical('z')} AS b FROM (SELECT u, list_transform(r, lambda x: x / sqrt(list_dot_product(r, r))) AS z FROM (SELECT u, {rest} AS r FROM (SELECT f.v AS u, s.v AS w FROM {first} f, {second} s))))"


def literal(vector: Sequence[float]) -> str:
    return "[" + ", ".join(repr(float(x)) for x in vector) + "]::DOUBLE[]"
