"""Phonetic reduction, weighted distance and alignment. Classes and weights are those of the method;
distances run Arrow-batched, over the vocabulary."""

from __future__ import annotations

import unicodedata
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulae.functions.greek import romanize_greek

VOWELS = frozenset("aeiouāēīōūâêîôûáéíóúḗṓ")
GROUPS = ("pb", "tdṭ", "kgqḱǵḫ", "szšṣ", "mnṇ", "lr", "jw")
NOTATION = "-*₁₂₃ʰʷ̥"


class Scheme(NamedTuple):
    """Where letters outside the base classes belong, or ``off``."""

    interdentals: str = "dental"
    pharyngeal: str = "velar"
    postalveolar: str = "sibilant"
    strip_notation: bool = True

    def __str__(self) -> str:
        return f"interdentals={self.interdentals}, ḥ={self.pharyngeal}, ž={self.postalveolar}, strip-notation={'on' if self.strip_notation else 'off'}"


CONSERVATIVE = Scheme("off", "off", "off")


def phonetic_classes(scheme: Scheme = Scheme()) -> dict[str, int]:
    """The class of each consonant that has one."""
    groups = [list(g) for g in GROUPS]
    for letters, place in (("ṯḏ", {"dental": 1, "sibilant": 3}.get(scheme.interdentals)), ("ḥ", 2 if scheme.pharyngeal == "velar" else None), ("ž", 3 if scheme.postalveolar == "sibilant" else None)):
        if place is not None:
            groups[place] += letters
    return {c: k for k, g in enumerate(groups) for c in g}


def reference_key(word: Column, strip_notation: bool = True) -> Column:
    """A reference form in lower case without hyphens, and without notation signs."""
    return F.lower(F.translate(word, NOTATION if strip_notation else "-", ""))


def substitution(a: str, b: str, classes: dict[str, int], vowel: float = 0.3, same: float = 0.5, far: float = 1.0) -> tuple[float, str]:
    """The cost of a substitution and its kind."""
    if a == b:
        return 0.0, "match"
    if a in VOWELS and b in VOWELS:
        return vowel, "sub-vowel"
    return (same, "sub-class") if a in classes and classes[a] == classes.get(b) else (far, "sub-far")


def distance_table(a: str, b: str, classes: dict[str, int], indel: float = 1.0) -> list[list[float]]:
    rows = [[j * indel for j in range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        above, row = rows[-1], [i * indel]
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + indel, row[-1] + indel, above[j - 1] + substitution(x, y, classes)[0]))
        rows.append(row)
    return rows


CLASSES = phonetic_classes()


def distance(a: str, b: str) -> float:
    """Weighted edits over the longer length."""
    return distance_table(a, b, CLASSES)[-1][-1] / max(len(a), len(b), 1)


def align_phonetic(a: str, b: str, indel: float = 1.0) -> list[dict]:
    """The cheapest edits as (a, b, op); substitutions before deletions before insertions."""
    table = distance_table(a, b, CLASSES, indel)
    out, i, j = [], len(a), len(b)
    while i or j:
        if i and j:
            cost, op = substitution(a[i - 1], b[j - 1], CLASSES)
            if table[i][j] == table[i - 1][j - 1] + cost:
                i, j = i - 1, j - 1
                out.append({"a": a[i], "b": b[j], "op": op})
                continue
        if i and table[i][j] == table[i - 1][j] + indel:
            i -= 1
            out.append({"a": a[i], "b": "", "op": "del"})
        else:
            j -= 1
            out.append({"a": "", "b": b[j], "op": "ins"})
    return out[::-1]


def word_to_phonetic(word: str, values: dict[str, str]) -> str:
    """Each sign of a hyphenated word by its value: without its star and underdot, in capitals; a
    sign without a value stays, in lower case."""

    def key(sign: str) -> str:
        dotless = unicodedata.normalize("NFD", sign).replace("̣", "")
        return unicodedata.normalize("NFC", dotless).replace("*", "").upper()

    return "".join(values.get(key(s), s.lower()) for s in word.split("-"))


def extract_root(word: str, values: dict[str, str]) -> str:
    """The consonants of the phonetic form."""
    return "".join(c for c in word_to_phonetic(word, values) if c not in VOWELS)


def to_phonemes(word: str, script: str, values: dict[str, str] | None = None, fold_aspiration: bool = False) -> str:
    if script == "greek":
        return romanize_greek(word, fold_aspiration)
    if script not in ("lineara", "linearb", "cypriot"):
        raise ValueError(f"no phonetic reduction for script {script!r}")
    out = word_to_phonetic(word, values or {})
    return out.replace("th", "t").replace("ph", "p").replace("kh", "k") if fold_aspiration else out


def sequence_distance(a: list, b: list) -> int:
    """Edits between two sequences, each of cost one."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def add_sequence(positions: list[list], words: list, before: int) -> list[list]:
    """One more word sequence aligned to positions of ``before`` earlier ones: match 2, mismatch 0,
    gap -1; a position stands for its first word. Ties go to the diagonal, then to a gap here."""
    first = [next((w for w in p if w), None) for p in positions]
    n, m = len(positions), len(words)
    score = [[-(i + j) if not i or not j else 0 for j in range(m + 1)] for i in range(n + 1)]
    step = [[1 if i else 2 for _ in range(m + 1)] for i in range(n + 1)]
    for j in range(1, m + 1):
        step[0][j] = 2
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            options = (score[i - 1][j - 1] + 2 * (first[i - 1] is not None and first[i - 1] == words[j - 1]), score[i - 1][j] - 1, score[i][j - 1] - 1)
            score[i][j] = max(options)
            step[i][j] = options.index(score[i][j])
    out, i, j = [], n, m
    while i or j:
        way = step[i][j] if i and j else 1 if i else 2
        i, j = i - (way != 2), j - (way != 1)
        out.append([*(positions[i] if way != 2 else [None] * before), words[j] if way != 1 else None])
    return out[::-1]


def align_sequences(sequences: list[list]) -> list[list]:
    """Progressive alignment in the given order: a row a position, a column a sequence."""
    out: list[list] = []
    for k, words in enumerate(sequences):
        out = add_sequence(out, words, k) if k else [[w] for w in words]
    return out


def distance_column(a: Column | str, b: Column | str) -> Column:
    def batch(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else distance(p, q) for p, q in zip(x, y)])

    return F.pandas_udf(batch, "double")(a, b)


def sequence_similarity(a: Column | str, b: Column | str) -> Column:
    """1 less the edits over the longer length, of two arrays."""

    def batch(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else 1 - sequence_distance(list(p), list(q)) / max(len(p), len(q), 1) for p, q in zip(x, y)])

    return F.pandas_udf(batch, "double")(a, b)
