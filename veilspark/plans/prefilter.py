"""One look at a text that tells which rules may match it.

Of each rule's pattern come texts of which every match holds one, and the digits that every match has at least; where neither
tells much, a plain run of letter classes that is in every match, which costs less to find than the pattern. All rules'
texts make one pattern, a trie that looks ahead at every place and takes the longest text that begins there; the shorter ones
that begin it are known from the trie. So a text is read once for all of them, and rules that can't match it aren't run.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

from veilspark.plans.patterns import PatternError, digits, parsed, required, window


@dataclass(frozen=True)
class Gate:
    """What a text must hold for a rule to match: one of the texts, if any are known, so many digits, and the window."""

    texts: tuple[str, ...]
    digits: int
    window: str | None = None


#: Letters that Java takes for ASCII letters where case doesn't count.
LIKE = ("ſKıİ", "skii")
#: So many digits are in few texts.
MANY_DIGITS = 4


@lru_cache(maxsize=4096)
def gate(pattern: str) -> Gate:
    try:
        tree = parsed(pattern)
    except PatternError:
        return Gate((), 0)  # the matcher's business
    texts = required(tree) or ()
    # a letter or digit alone is in almost every text
    if any(len(x) == 1 and x.isascii() and (x.isalnum() or x in " .-,") for x in texts):
        texts = ()
    n = digits(tree)
    return Gate(texts, n, None if texts or n >= MANY_DIGITS else window(tree))


def _chosen(by: list[tuple[str, str]]) -> str:
    """A pattern for one of some heads and what follows it; a range of letters stands before each half, so few heads are tried."""
    if len(by) <= 3:
        return "|".join(re.escape(c) + rest for c, rest in by)
    half = len(by) // 2
    low, high = (f"\\x{{{ord(by[i][0]):x}}}" for i in (0, half - 1))
    return f"(?=[{low}-{high}])(?:{_chosen(by[:half])})|{_chosen(by[half:])}"


def _longest(words: list[str]) -> str:
    """A pattern that takes the longest of some words that begins at a place; '' among them: nothing need follow."""
    by: dict[str, list[str]] = {}
    for w in words:
        if w:
            by.setdefault(w[0], []).append(w[1:])
    if not by:
        return ""
    inside = _chosen([(c, _longest(rest)) for c, rest in sorted(by.items())])
    return f"(?:{inside})?+" if "" in words else f"(?:{inside})" if len(by) > 1 else inside


#: ASCII letters by how rarely texts have them, the most frequent first.
FREQUENT = " etaoinsrhldcumfpgwybvkxjqz"


def rare_part(word: str) -> str:
    """The part of a word from its rarest letter on, five letters long at least where the word is; few places of a text begin it."""
    rank = lambda c: FREQUENT.find(c) if c in FREQUENT else len(FREQUENT)
    return word[max(range(max(1, len(word) - 4)), key=lambda i: (rank(word[i]), -i)) :]


def trie(words: list[str]) -> str:
    """A pattern whose matches, one for each place where a word begins, have the longest such word as group 1."""
    plain = sorted({w for w in words if w[0].isascii()})
    other = sorted({w for w in words if not w[0].isascii()})
    parts = [f"(?=[{''.join(re.escape(c) for c in sorted({w[0] for w in plain}))}]){_longest(plain)}"] if plain else []
    parts += [f"(?=[^\\x00-\\x7f]){_longest(other)}"] if other else []
    return f"(?=({'|'.join(parts)}))"


@dataclass(frozen=True)
class Prefilter:
    """pattern: finds words in lower case (None if no rule has any); holders: the rules that a word found speaks for; letters: words of one letter and their rules; windows: the same."""

    gates: tuple[Gate, ...]
    pattern: str | None
    holders: dict[str, list[int]]
    letters: dict[str, list[int]]
    windows: dict[str, list[int]]


@lru_cache(maxsize=64)
def prefilter(patterns: tuple[str, ...]) -> Prefilter:
    gates = tuple(map(gate, patterns))
    own: dict[str, set[int]] = {}
    for i, g in enumerate(gates):
        for x in g.texts:
            own.setdefault(rare_part(x), set()).add(i)
    words = [x for x in own if len(x) > 1]
    holders = {w: sorted(set().union(*(own.get(w[:n], ()) for n in range(2, len(w) + 1)))) for w in words}
    windows: dict[str, list[int]] = {}
    for i, g in enumerate(gates):
        if g.window:
            windows.setdefault(g.window, []).append(i)
    return Prefilter(gates, trie(words) if words else None, holders, {x: sorted(own[x]) for x in own if len(x) == 1}, windows)
