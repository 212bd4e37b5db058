"""Keyword rules as data.

The shipped lists, rules and steps are JSON files in ``lorewell/rules``; a folder with files of the same names takes
their place (``load_rules``). A rule set is an ordered list of ``(category, keywords)``. ``{name}`` in a keyword stands
for the short name of the institution; such keywords are left out when no name is given.
"""

from __future__ import annotations

import json
import os
import pkgutil
from dataclasses import dataclass

RuleSet = list[tuple[str, list[str]]]


@dataclass(frozen=True)
class Rules:
    """``keywords``: lists and rule sets by name; ``page`` and ``upload``: the steps that classify pages and files."""

    keywords: dict
    page: dict
    upload: dict

    def words(self, names: str | list[str], institution: str | None = None) -> list[str]:
        """The keywords of one list, or of several one after the other."""
        names = [names] if isinstance(names, str) else names
        return named_words([w for n in names for w in self.keywords[n]], institution)

    def rules(self, name: str, institution: str | None = None) -> RuleSet:
        return [(r["category"], named_words(r["any"], institution)) for r in self.keywords[name]]


def load_rules(folder: str | None = None) -> Rules:
    """The rules in a folder; files that it lacks, and all without a folder, are the shipped ones."""
    def read(name: str) -> dict:
        path = folder and os.path.join(folder, f"{name}.json")
        if path and os.path.exists(path):
            with open(path, encoding="utf-8") as file:
                return json.load(file)
        return json.loads(pkgutil.get_data("lorewell", f"rules/{name}.json"))

    return Rules(read("keywords"), read("page"), read("upload"))


def named_words(words: list[str], name: str | None) -> list[str]:
    """Fill in the institution's short name, or drop the keywords that need it."""
    return [w.replace("{name}", name or "") for w in words if name or "{name}" not in w]


SHIPPED = load_rules()
CATEGORIES = tuple(SHIPPED.keywords["categories"])
CATEGORY_LABELS = SHIPPED.keywords["category_labels"]
STATIC_CATEGORIES = tuple(SHIPPED.keywords["static_categories"])
