"""Every query of the core, by name, with its SQL where SQL can express it."""

from __future__ import annotations

from gridloom.plans import problems, reference

QUERIES = {**problems.QUERIES, **reference.QUERIES}
ORACLE = {**problems.ORACLE, **reference.ORACLE}
