"""Settings of a run from an INI file."""

from __future__ import annotations

import configparser
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    """``data`` is the folder of the tables, ``pivots`` the currencies a rate may pass through, ``max_age`` and ``max_age_fy`` the days a
    fact stays fresh, ``token_ranks`` the file of byte-pair ranks."""

    data: str = "."
    pivots: tuple[str, ...] = ("USD", "EUR", "GBP")
    max_age: int = 400
    max_age_fy: int = 480
    token_ranks: str | None = None


def load_settings(path: str, section: str = "factloom") -> Settings:
    """Settings of a section; what is missing keeps its default, and an unknown name is an error."""
    parser = configparser.ConfigParser()
    with open(path) as f:
        parser.read_file(f)
    given = dict(parser[section]) if parser.has_section(section) else {}
    kinds = {f.name: f.default for f in fields(Settings)}
    if unknown := sorted(set(given) - set(kinds)):
        raise ValueError(f"unknown settings: {unknown}")
    out = {}
    for name, text in given.items():
        default = kinds[name]
        out[name] = int(text) if isinstance(default, int) else tuple(x.strip().upper() for x in text.split(",") if x.strip()) if isinstance(default, tuple) else text
    return Settings(**out)
