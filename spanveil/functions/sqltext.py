"""Column expressions as SQL text, so that a function of the SQL surface is the very expression of the DataFrame API.

A session's SQL function can hold lambdas if they are part of its text. The tree of a column is walked here once, when the function is registered.
"""

from __future__ import annotations

from pyspark.sql import Column

# Functions that SQL writes as operators.
BINARY = {"+", "-", "*", "/", "%", "=", "==", "<=>", "<", ">", "<=", ">=", "and", "or", "&", "|", "^"}
UNARY = {"not": "NOT ", "!": "NOT ", "negative": "-", "~": "~"}


def quoted(text: str) -> str:
    signs = {"\\": "\\\\", "'": "\\'", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\0": "\\0"}
    return "'" + "".join(signs.get(c, c) for c in text) + "'"


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _literal(node) -> str:
    value, kind = node.value(), node.dataType()
    name = kind.get().sql() if kind.isDefined() else None
    if value is None:
        return f"CAST(NULL AS {name})" if name and name != "VOID" else "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, str):
        return quoted(value)
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, int):
        return f"{value}L" if name == "BIGINT" else str(value)
    raise TypeError(f"no SQL text for a literal of {type(value).__name__}")


def _function(node) -> str:
    name, given = node.functionName(), [_text(x) for x in _items(node.arguments())]
    if name.lower() in BINARY and len(given) == 2:
        return f"({given[0]} {name.upper()} {given[1]})"
    if name.lower() in UNARY and len(given) == 1:
        return f"({UNARY[name.lower()]}{given[0]})"
    if name.lower() == "in":
        return f"({given[0]} IN ({', '.join(given[1:])}))"
    return f"{name if name == 'struct' else f'`{name}`'}({', '.join(given)})"


def _text(node) -> str:
    kind = node.getClass().getSimpleName()
    if kind == "Literal":
        return _literal(node)
    if kind == "UnresolvedFunction":
        return _function(node)
    if kind == "UnresolvedAttribute":
        return ".".join(f"`{x}`" for x in _items(node.nameParts()))
    if kind == "UnresolvedNamedLambdaVariable":
        return f"`{node.name()}`"
    if kind == "UnresolvedExtractValue":
        return f"{_text(node.child())}[{_text(node.extraction())}]"
    if kind == "LambdaFunction":
        names = [_text(x) for x in _items(node.arguments())]
        return f"{names[0] if len(names) == 1 else f'({", ".join(names)})'} -> {_text(node.function())}"
    if kind == "Alias":
        return f"{_text(node.child())} AS `{node.name().apply(0)}`"
    if kind == "Cast":
        mode = node.evalMode()
        word = "TRY_CAST" if mode.isDefined() and "Try" in mode.get().toString() else "CAST"
        return f"{word}({_text(node.child())} AS {node.dataType().sql()})"
    if kind == "CaseWhenOtherwise":
        whens = " ".join(f"WHEN {_text(x._1())} THEN {_text(x._2())}" for x in _items(node.branches()))
        last = node.otherwise()
        return f"(CASE {whens}{f' ELSE {_text(last.get())}' if last.isDefined() else ''} END)"
    raise TypeError(f"no SQL text for {kind}")


def sql_text(column: Column) -> str:
    return _text(column._jc.node())
