"""Arithmetic expressions as columns."""

from __future__ import annotations

import ast
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

OPERATORS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Mod: operator.mod, ast.Pow: F.pow}
FUNCTIONS = {name: getattr(F, name) for name in ("abs", "ceil", "floor", "sqrt", "exp", "sin", "cos", "tan", "cbrt", "log10", "log2")} | {"log": F.ln, "signum": F.signum}


def arithmetic(expression: str, columns: dict[str, Column]) -> Column:
    """A double from numbers, + - * / % ^, brackets, the named columns and FUNCTIONS. A division
    by zero gives null."""

    def read(node: ast.AST) -> Column:
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)):
            return F.lit(float(node.value))
        if isinstance(node, ast.Name) and node.id in columns:
            return columns[node.id].cast("double")
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            return -read(node.operand)
        if isinstance(node, ast.BinOp) and type(node.op) in OPERATORS:
            right = read(node.right)
            return OPERATORS[type(node.op)](read(node.left), F.nullif(right, F.lit(0.0)) if isinstance(node.op, (ast.Div, ast.Mod)) else right)
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in FUNCTIONS and len(node.args) == 1:
            return FUNCTIONS[node.func.id](read(node.args[0]))
        raise ValueError(f"not arithmetic: {expression}")

    return read(ast.parse(expression.replace("^", "**"), mode="eval").body)
