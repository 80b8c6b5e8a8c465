"""Operators for language-model training corpora, with their queries and SQL.

Nothing else in the package imports this subpackage.
"""

from __future__ import annotations
