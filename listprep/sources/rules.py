"""Rule tables. They come from YAML files of a few kilobytes that people edit by hand."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VIN_RULE_SCHEMA = (
    "ord int, vin13 string, vin48 string, vin10 string, modelid string, "
    "cell string, brand string, desc string"
)
DEFAULT_CELL = "DEFAULT"

# Business terms matched as literal text; every other term is a pattern.
LITERAL_TERMS = ("CLUB", "UCC", "DIVISION", "COLLEGE")


def load_yaml(spark: SparkSession, path: str):
    """One rule file, from any file system Spark reaches."""
    import yaml

    text = spark.read.text(path, wholetext=True).first()
    return yaml.safe_load(text[0]) if text else {}


def manufacturer_of(path: str) -> str:
    return PurePosixPath(path.rstrip("/")).stem.lower().strip()


def manufacturers(paths: Iterable[str]) -> list[str]:
    return sorted({manufacturer_of(path) for path in paths})


def rule_file(paths: Iterable[str], manufacturer: str) -> str:
    """The file whose name is the manufacturer."""
    wanted = manufacturer.lower().strip()
    for path in paths:
        if manufacturer_of(path) == wanted:
            return path
    raise FileNotFoundError(f"no rule file for {wanted!r}; there are {manufacturers(paths)}")


def vin_rules(spark: SparkSession, config: Mapping) -> tuple[DataFrame, str]:
    """VIN rules with their file order, and the default cell."""

    def text(rule: Mapping, name: str) -> str | None:
        return None if rule.get(name) is None else str(rule[name])

    names = ("vin13", "vin48", "vin10", "modelid", "cell", "brand", "desc")
    rows = [
        (place, *(text(rule, name) for name in names))
        for place, rule in enumerate(config.get("vin_mappings", []))
    ]
    return spark.createDataFrame(rows, VIN_RULE_SCHEMA), str(config.get("default_cell_code", DEFAULT_CELL))


@dataclass(frozen=True)
class EmailRules:
    """Address parts that disqualify an e-mail. Entries are patterns; a domain may be a prefix."""

    domains: Sequence[str] = ()
    words: Sequence[str] = ()

    @classmethod
    def from_config(cls, config: Mapping) -> EmailRules:
        return cls(config.get("full_domain_rejects", ()), config.get("partial_matches", ()))

    def patterns(self) -> list[str]:
        patterns = []
        if self.domains:
            patterns.append(f"@(?:{'|'.join(self.domains)})")
        if self.words:
            patterns.append(rf"\b(?:{'|'.join(self.words)})\b")
        return patterns


@dataclass(frozen=True)
class StateZipRules:
    """Two-digit ZIP prefixes of each state: at most a hundred per state."""

    prefixes: Mapping[str, Sequence[str]] = field(default_factory=dict)

    @classmethod
    def from_config(cls, config: Mapping) -> StateZipRules:
        return cls(config["valid_combinations"])

    def states(self) -> list[str]:
        return list(self.prefixes)

    def pairs(self) -> list[str]:
        return [f"{state}|{zip2}" for state, zips in self.prefixes.items() for zip2 in zips]


@dataclass(frozen=True)
class BusinessRules:
    indicators: Sequence[str] = ()
    manufacturers: Sequence[str] = ()
    allowed: Sequence[Mapping[str, str]] = ()

    @classmethod
    def from_config(cls, config: Mapping) -> BusinessRules:
        return cls(
            config["business_indicators"],
            config["oem_manufacturers"],
            config.get("hardcoded_exclusions", ()),
        )

    def indicator_pattern(self) -> str | None:
        terms = [
            re.escape(term) if term.strip().upper() in LITERAL_TERMS else f"(?:{term})"
            for term in self.indicators
        ]
        return f"(?iu)(?:{'|'.join(terms)})" if terms else None

    def manufacturer_pattern(self) -> str | None:
        names = [f"(?:{name.lower()})" for name in self.manufacturers]
        return rf"(?u)\b(?:{'|'.join(names)})\b" if names else None

    def allowed_names(self) -> list[str]:
        return [entry["name"].strip().lower() for entry in self.allowed if not entry.get("city")]

    def allowed_name_cities(self) -> list[str]:
        return [
            f"{entry['name'].strip().lower()}\n{entry['city'].strip().lower()}"
            for entry in self.allowed
            if entry.get("city")
        ]


def check_patterns(spark: SparkSession, patterns: Iterable[str | None]) -> None:
    """Fail at load time on a rule that is not a valid pattern."""
    for pattern in patterns:
        if pattern is None:
            continue
        try:
            spark.range(1).select(F.lit("").rlike(pattern)).collect()
        except Exception as error:
            raise ValueError(f"rule pattern {pattern!r} is not valid") from error
