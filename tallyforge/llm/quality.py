"""Quality rules, lines first.

Each line of a text is held against rules on punctuation, navigation,
boilerplate, symbols, repetition and duplication; lines that fail are removed,
and a document that loses too much of its text this way is rejected. The base
statistics of the whole text are computed beside it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import slices

SPACES = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"
WINDOW = 8


@dataclass(frozen=True)
class Rules:
    """Thresholds. Shares are of a line's words, or of a text's characters without white space."""

    ends: str = ".!?…:;。！？\"'”’»)"
    #: A line without closing punctuation passes if it is as long as this; prose that breaks inside a sentence is no heading.
    unpunctuated_words: int = 12
    #: Menu separators standing alone or between words, as a share of the words.
    separators: str = "|>»›•·"
    separator_share: float = 0.2
    symbol_share: float = 0.2
    #: Short lines that hold one of these phrases are boilerplate.
    boilerplate: tuple[str, ...] = (
        "cookie", "privacy policy", "terms of use", "terms of service", "all rights reserved", "javascript", "subscribe to", "sign up", "log in", "share this", "read more", "click here", "powered by",
        "datenschutzerklärung", "nutzungsbedingungen", "impressum", "alle rechte vorbehalten", "newsletter abonnieren", "jetzt anmelden", "weiterlesen", "hier klicken",
        "politique de confidentialité", "conditions d'utilisation", "mentions légales", "tous droits réservés", "lire la suite", "cliquez ici", "abonnez-vous",
        "política de privacidad", "condiciones de uso", "aviso legal", "todos los derechos reservados", "leer más", "haga clic", "suscríbete",
    )
    boilerplate_words: int = 25
    #: The commonest word of a line of ten words or more makes up less than this.
    same_word_share: float = 0.5
    #: Nor do words that repeat the one before them.
    stutter_share: float = 0.3
    #: Share of the text's characters that may go before the document is rejected.
    lost_share: float = 0.4
    min_words: int = 20
    repeat_share: float = 0.3


REASONS = ("punctuation", "navigation", "boilerplate", "symbols", "repetition", "duplicate")


def fault(line: str, rules: Rules) -> str | None:
    """The first rule that a line with words breaks, or None."""
    words = line.split()
    n = len(words)
    if sum(map(line.count, rules.separators)) >= max(2, rules.separator_share * n):
        return "navigation"
    if sum(map(line.count, SYMBOLS)) >= max(3, rules.symbol_share * n):
        return "symbols"
    if n >= 10 and (max(Counter(words).values()) >= rules.same_word_share * n or sum(map(str.__eq__, words, words[1:])) >= rules.stutter_share * n):
        return "repetition"
    if n <= rules.boilerplate_words:
        low = line.lower()
        if any(p in low for p in rules.boilerplate):
            return "boilerplate"
    if n < rules.unpunctuated_words and not line.rstrip().endswith(tuple(rules.ends)):
        return "punctuation"
    return None


def repeated_words(words: list[bytes]) -> int:
    """Words inside a window of 8 that occurs twice or more in the text, first occurrence included."""
    n = len(words)
    if n <= WINDOW:
        return 0
    h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    m = n - WINDOW + 1
    roll = np.zeros(m, np.uint64)
    for k in range(WINDOW):
        roll = roll * np.uint64(0x9E3779B97F4A7C15) + (h[k : k + m] ^ (h[k : k + m] >> np.uint64(29)))
    ordered = np.sort(roll)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    hit = np.isin(roll, twice)
    edge = np.zeros(n + 1, np.int64)
    edge[:m] += hit
    edge[WINDOW:] -= hit
    return int((np.cumsum(edge[:n]) > 0).sum())


def clean(text: str, rules: Rules) -> tuple:
    """Base statistics of a text, what its lines lose, and the cleaned text."""
    words = text.encode().split()
    n_words = len(words)
    white = sum(map(text.count, SPACES))
    n_symbols = sum(map(text.count, SYMBOLS))
    n_repeat = repeated_words(words)
    seen: set[str] = set()
    kept, lost_chars, n_dup, n_lines = [], 0, 0, 0
    reasons = dict.fromkeys(REASONS, 0)
    for line in text.split("\n"):
        if not line.strip(SPACES):
            kept.append(line)
            continue
        n_lines += 1
        if line in seen:
            n_dup += 1
            why = "duplicate"
        else:
            seen.add(line)
            why = fault(line, rules)
        if why:
            reasons[why] += 1
            lost_chars += len(line) - sum(map(line.count, SPACES))
        else:
            kept.append(line)
    chars = len(text) - white
    base_failed = n_words < rules.min_words or 100 * n_repeat > round(100 * rules.repeat_share) * n_words
    return n_words, chars, n_symbols, n_dup, n_repeat, base_failed, not base_failed and lost_chars <= rules.lost_share * chars, n_lines, sum(reasons.values()), lost_chars, [r for r in REASONS if reasons[r]], "\n".join(kept)


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines long, n_lines_removed long, chars_removed long, rules_broken array<string>, clean_text string"
_TYPES = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "array<string>": pa.list_(pa.string())}


def clean_lines(docs: DataFrame, rules: Rules | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Judge every whole text: the id column and COLUMNS, a row for each row given.

    A null text is the empty text; texts with fewer than 20 words, empty ones
    included, fail the base rule. Lines are parted by a line feed alone; lines
    without a word are kept and not counted. Repeated rows get equal verdicts.
    No rows are exchanged, so neither hot sources nor groups of copies matter.
    """
    rules = rules or Rules()
    fields = [c.split() for c in COLUMNS.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = [clean(t or "", rules) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(list(c), _TYPES[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True))], names=[id_col, *(n for n, _ in fields)])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, {COLUMNS}")
