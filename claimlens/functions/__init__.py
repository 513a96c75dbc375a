"""Column expressions shared by the operators (all JVM-side, codegen-friendly)."""

from claimlens.functions.exprs import *  # noqa: F401,F403
