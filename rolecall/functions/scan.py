"""Which of many keywords occur in a text.

Two ways give the same array of keyword positions, both native:

* ``trie``: one regular expression for all keywords that have a letter which texts seldom
  have. It stops at such letters only, so a place without one costs a look at one letter.
  From there keywords that go on alike share what they share, and a look back tells what
  stands before. The keywords that lie within a found one come from a table. The few
  without such a letter, or that could hide another at its letter, are tested one by one;
  if they are not few, a second expression finds the longest that starts at each place.
* ``contains``: one test per keyword, a pass over the text for each.

A scan takes the first unless asked otherwise; neither the number of keywords nor what
is installed changes that.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, SparkSession, functions as F


#: Letters by how seldom texts have them; others are taken to be rarer still.
SELDOM = "zqxjkvbpgwyfmc"
#: Letters, and white space, that an expression doesn't stop at: most places have one of them.
COMMON = "uldhrsnioate"

#: Keywords that are tested one by one; each costs a pass, but a short one.
FEW = 48


def sql_text(value: str) -> str:
    """A text literal for :func:`pyspark.sql.functions.expr`."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def constant(values, ddl: str) -> Column:
    """A nested constant. As JSON it is a single node of the plan, which the
    optimizer folds into a literal; hundreds of small literals would slow down
    every planning step."""
    return F.from_json(F.lit(json.dumps(values)), ddl)


def trie_pattern(keywords) -> str:
    """A regular expression for the longest of the keywords that starts at a place."""
    root: dict = {}
    for keyword in keywords:
        node = root
        for letter in keyword:
            node = node.setdefault(letter, {})
        node[""] = {}

    def one_of(ways: list[tuple[str, str]]) -> str:
        """Alternatives that differ in their first letter, halved by it again and again, so
        that a letter is looked at a few times and not once per alternative."""
        if len(ways) <= 2:
            return "|".join(way for _, way in ways)
        half = len(ways) // 2
        return "|".join(f"(?=[{''.join(letter for letter, _ in part)}])(?:{one_of(part)})"
                        for part in (ways[:half], ways[half:]))

    def branches(node: dict) -> str:
        ways = [(quoted(letter), quoted(letter) + branches(below)) for letter, below in sorted(node.items()) if letter]
        if not ways:
            return ""
        one = ways[0][1] if len(ways) == 1 and "" not in node else f"(?:{one_of(ways)})"
        # Greedy: a keyword that goes on is preferred to one that ends here.
        return one + "?" if "" in node else one

    return branches(root)


def _hidden(one: tuple[str, str], other: tuple[str, str]) -> bool:
    """Whether two keywords, each parted before its rare letter, can lie at the same letter
    so that what is found there doesn't tell of both."""
    (before, after), (before2, after2) = sorted((one, other), key=lambda k: -len(k[1]))
    return after == after2 or after.startswith(after2) and before != before2 and before2.endswith(before)


def parted(keywords) -> dict[str, tuple[str, str]]:
    """Keywords parted before their rarest letter that lets none hide another; those that
    have no such letter are left out."""
    at: dict[str, list[tuple[str, str]]] = {}
    found = {}
    for keyword in sorted(keywords, key=lambda k: (len(k), k)):
        places = [i for i, letter in enumerate(keyword) if letter not in COMMON and not letter.isspace()]
        if any(ord(letter) > 0xD7FF for letter in keyword):  # of these a look back isn't one letter
            continue
        for i in sorted(places, key=lambda i: (SELDOM.find(keyword[i]), i)):
            parts = keyword[:i], keyword[i:]
            if not any(_hidden(parts, other) for other in at.setdefault(keyword[i], [])):
                at[keyword[i]].append(parts)
                found[keyword] = parts
                break
    return found


def rare_letter_pattern(parts) -> str:
    """A regular expression that stops at rare letters; its group is the second part of the
    keyword there, the longest whose first part stands before it."""
    root: dict = {}
    for before, after in parts:
        node = root
        for letter in after:
            node = node.setdefault(letter, {})
        node[""] = before + after if before else ""

    def branches(node: dict) -> str:
        ways = [quoted(letter) + branches(below) for letter, below in sorted(node.items()) if letter]
        if "" in node:
            ways.append("(?<=" + "".join(map(quoted, node[""])) + ")" if node[""] else "")
        return ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})"

    # The letter itself is taken first, as that is what Java looks for fastest.
    return f"[{''.join(map(quoted, sorted(root)))}](?<=(?=({branches(root)}))[\\s\\S])"


def quoted(letter: str) -> str:
    return letter if letter.isalnum() and letter.isascii() else "\\" + letter if letter.isascii() else letter


class KeywordScan:
    """Finds the positions of ``keywords`` (distinct, not empty) in text columns."""

    def __init__(self, keywords, engine: str | None = None):
        engine = engine or "trie"
        self.keywords = tuple(keywords)
        if len(set(self.keywords)) < len(self.keywords) or "" in self.keywords:
            raise ValueError("keywords to scan for must be distinct and not empty")
        if engine not in ("contains", "trie"):
            raise ValueError(f"unknown engine {engine!r}")
        self.engine = engine

    def found(self, text: str) -> Column:
        """Sorted positions of the keywords that occur in the text column of that
        name; empty for a null text."""
        if not self.keywords:
            return F.expr("cast(array() as array<int>)")
        return F.expr(self._contains(text) if self.engine == "contains" else self._trie(text))

    def _contains(self, text: str, keywords=None) -> str:
        """One expression to parse; array_except drops the nulls and, unlike a
        lambda, is generated code."""
        hits = ", ".join(f"CASE WHEN contains({text}, {sql_text(k)}) THEN {i} END"
                         for i, k in enumerate(self.keywords) if keywords is None or k in keywords)
        return f"array_except(array({hits}), array(cast(null as int)))"

    def _trie(self, text: str) -> str:
        """The keywords found at rare letters and those that lie in them; then the others."""
        parts = parted(self.keywords)
        rest = [k for k in self.keywords if k not in parts]
        found = []
        if parts:
            within = {after: self._within(before + after) for before, after in parts.values()}
            found.append(self._looked_up(text, rare_letter_pattern(parts.values()), within))
        if len(rest) > FEW:
            begins = {k: [i for i in self._within(k) if k.startswith(self.keywords[i])] for k in rest}
            found.append(self._looked_up(text, f"(?=({trie_pattern(rest)}))", begins))
        elif rest:
            found.append(self._contains(text, set(rest)))
        return f"coalesce(array_sort(array_distinct(concat({', '.join(found)}))), cast(array() as array<int>))"

    def _within(self, keyword: str) -> list[int]:
        return [i for i, k in enumerate(self.keywords) if k in keyword]

    def _looked_up(self, text: str, pattern: str, table: dict[str, list[int]]) -> str:
        """The positions that the table has for what the pattern's group finds."""
        listed = f"from_json({sql_text(json.dumps(table))}, 'map<string,array<int>>')"
        distinct = f"array_distinct(regexp_extract_all({text}, {sql_text(pattern)}, 1))"
        return f"flatten(transform({distinct}, k -> try_element_at({listed}, k)))"

    def register(self, spark: SparkSession, name: str) -> None:
        """Makes :meth:`found` known to SQL under a name."""
        body = self._contains("text") if self.engine == "contains" else self._trie("text")
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(text STRING) RETURNS ARRAY<INT> RETURN {body}")

    def positions(self, keywords) -> list[int]:
        index = {keyword: i for i, keyword in enumerate(self.keywords)}
        return [index[k] for k in keywords]


def longest_length(keywords) -> int:
    return max(map(len, keywords), default=0)
