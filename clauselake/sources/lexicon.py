"""The risk lexicon: a small configuration table of domains and their keywords.

Keyword lists belong to whoever runs the review, so they are a parameter. Load
them from any table with ``domain, keyword`` (optionally ``name, always``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauselake import constants as K


@dataclass(frozen=True)
class Domain:
    key: str
    keywords: tuple[str, ...]
    name: str = ""
    always: bool = False

    @property
    def label(self) -> str:
        return self.name or self.key


def lexicon_from_rows(rows: list[tuple[str, str]]) -> list[Domain]:
    """(domain, keyword) pairs to domains, in the fixed order, unknown domains last."""
    words: dict[str, list[str]] = {}
    for domain, keyword in rows:
        words.setdefault(domain, []).append(keyword.lower())
    order = [d for d in K.DOMAINS if d in words] + sorted(set(words) - set(K.DOMAINS))
    return [Domain(d, tuple(sorted(set(words[d]))), always=d in K.ALWAYS_EVALUATED) for d in order]


def load_lexicon(table: DataFrame, max_rows: int = 10_000) -> list[Domain]:
    """Read a lexicon table; refuses anything larger than a configuration."""
    rows = table.select("domain", "keyword").where(F.col("keyword").isNotNull()).take(max_rows + 1)
    if len(rows) > max_rows:
        raise ValueError(f"a lexicon of more than {max_rows} keywords is not a configuration table")
    return lexicon_from_rows([tuple(r) for r in rows])
