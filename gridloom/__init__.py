"""Gridloom: tables hidden in page-oriented documents, as Spark DataFrames.

Words, ruled lines, grids, cells and form records are ordinary DataFrames; every
operator is ``DataFrame -> DataFrame`` or ``Column -> Column`` and stays lazy.
"""

__version__ = "0.1.0"
