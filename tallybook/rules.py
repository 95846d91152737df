"""User-tunable cleaning and matching rules.

A ``Rules`` value is immutable and ends up as literals inside Catalyst
expressions, so Spark can fold them; nothing is looked up per row.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, fields, replace
from decimal import Decimal

# The default rule set.
DEFAULT_PLACES = 2
DEFAULT_ROUNDING = "half_up"
DEFAULT_TOLERANCE = Decimal("0.01")
DEFAULT_UID_PREFIXES = ("UID:", "UID", "用户", "账号")
DEFAULT_REVIEW_KEYWORDS = ("异常", "退款", "冻结", "暂停", "退单", "作废", "冲红")

# DECIMAL(38,18) is the parse type: beyond 16 places a half-way test could see
# the sticky digit that stands for a cut-off tail (see functions.money).
MAX_PLACES = 16


@dataclass(frozen=True)
class Rules:
    amount_places: int = DEFAULT_PLACES
    rounding: str = DEFAULT_ROUNDING
    amount_tolerance: Decimal = DEFAULT_TOLERANCE
    uid_prefixes: Sequence[str] = DEFAULT_UID_PREFIXES
    uid_regex: str | None = None
    anomaly_status_keywords: Sequence[str] = DEFAULT_REVIEW_KEYWORDS
    mapping: Mapping | None = None

    def __post_init__(self):
        put = lambda name, value: object.__setattr__(self, name, value)
        put("amount_places", int(self.amount_places))
        put("rounding", str(self.rounding))
        put("amount_tolerance", Decimal(str(self.amount_tolerance)))
        put("uid_prefixes", tuple(str(p) for p in (self.uid_prefixes or ())))
        put("anomaly_status_keywords", tuple(str(k) for k in (self.anomaly_status_keywords or ())))
        if not 0 <= self.amount_places <= MAX_PLACES:
            raise ValueError(f"amount_places must be between 0 and {MAX_PLACES}")
        if not self.amount_tolerance.is_finite():
            raise ValueError("amount_tolerance must be a finite number")

    @classmethod
    def from_dict(cls, overrides: Mapping | None) -> "Rules":
        """Defaults overlaid by ``overrides`` (shallow; unknown keys ignored)."""
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in (overrides or {}).items() if k in known})

    def with_(self, **changes) -> "Rules":
        return replace(self, **changes)

    @property
    def prefixes_upper(self) -> list[str]:
        """Prefixes as compared: upper-cased, trimmed, blanks dropped, order kept."""
        return [p for p in (str(p).upper().strip() for p in self.uid_prefixes) if p]

    @property
    def review_keywords(self) -> list[str]:
        """Keywords that can hit; a blank keyword ends the list."""
        words: list[str] = []
        for word in self.anomaly_status_keywords:
            if not word:
                break
            words.append(word)
        return words

    @property
    def uid_full_match(self) -> str | None:
        """``uid_regex`` (Java dialect) anchored at both ends."""
        return rf"\A(?:{self.uid_regex})\z" if self.uid_regex else None


def regex_any(words: Sequence[str]) -> str:
    """Java/RE2/Python-safe alternation that finds any of ``words`` literally."""
    return "|".join(re.escape(w) for w in words)
