"""Line-first quality rules.

Lines are judged first: each line of a text is tested by punctuation, navigation and
boilerplate rules, and lines that fail are removed. A document is then rejected if its base
measures fail or if it has lost too much of its text with its lines.

Defined cases: a null text has no words and fails the base; an empty line is kept as a break
and weighs nothing; rows are judged one by one, so repeated rows get equal verdicts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import SPACE, chunks, kind, span_hashes, text_batches, window_hashes, word_spans


@dataclass(frozen=True)
class LineRules:
    """Thresholds of the rules; percentages are of a line's words unless said otherwise."""

    min_words: int = 20
    max_repeat_percent: int = 30
    repeat_window: int = 8
    #: Punctuation: a line fails if so many of its words carry a symbol, or so many end with '!'.
    max_symbol_percent: int = 30
    max_shout_percent: int = 50
    #: Navigation: so many of its words are bare separators.
    max_separator_percent: int = 25
    #: A document that keeps a smaller part of its words than this is rejected.
    min_kept_percent: int = 50


#: Fixed patterns of boilerplate lines, from a line's first word on.
BOILERPLATE = rb"licensed under|released under|copyright\b|all rights reserved|\(c\)[ \t\n\f\r]|terms of (use|service)|privacy policy|cookie policy|lorem ipsum|please enable javascript"
#: Without regard to case as in SQL, where a long s is an s and the Kelvin sign a k.
_NOTICE = re.compile(b"(?i)(" + BOILERPLATE.replace(b"s", "(?:s|\u017f)".encode()).replace(b"k", "(?:k|\u212a)".encode()) + b")")
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
SEPARATORS = np.zeros(256, bool)
SEPARATORS[list(b"|>/")] = True


def measure(texts: list[str | None], rules: LineRules) -> Iterator[dict]:
    """Base measures, removed lines and the verdict of each text."""
    for a, b in chunks(texts):
        parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts[a:b]]
        raw = b"\n".join(parts) + b"\n"
        data = np.frombuffer(raw, np.uint8)
        starts, ends = word_spans(data)
        words = span_hashes(data, starts, ends)
        # Running counts, so that any range of bytes or words is a difference.
        letters = np.r_[0, np.cumsum(((data & 0xC0) != 0x80) & ~SPACE[data])]
        symbols = np.r_[0, np.cumsum(SYMBOLS[data])]
        separators = np.r_[0, np.cumsum(SEPARATORS[data])]
        length = ends - starts
        n_sym = symbols[ends] - symbols[starts]
        marked = np.r_[0, np.cumsum((n_sym > 0) & (n_sym < length))]
        bare = np.r_[0, np.cumsum((length == 1) & (separators[ends] > separators[starts]))]
        shout = np.r_[0, np.cumsum(data[ends - 1] == ord("!"))]
        line_ends = np.flatnonzero(data == 10)
        line_starts = np.r_[0, line_ends[:-1] + 1]
        first, last = np.searchsorted(starts, line_starts), np.searchsorted(starts, line_ends)
        n = last - first
        fails = n > 0
        fails &= (100 * (marked[last] - marked[first]) > rules.max_symbol_percent * n) | (100 * (shout[last] - shout[first]) > rules.max_shout_percent * n) | (100 * (bare[last] - bare[first]) > rules.max_separator_percent * n)
        windows = window_hashes(words, rules.repeat_window)
        at, line = 0, 0
        for p in parts:
            n_lines = p.count(b"\n") + 1
            own = slice(line, line + n_lines)
            w0, w1 = int(first[own][0]), int(last[own][-1])
            n_words = w1 - w0
            # A line is its bytes, white space included.
            with_words = np.flatnonzero(n[own]) + line
            lines = {raw[line_starts[i] : line_ends[i]] for i in with_words}
            gone = fails[own].copy()
            for i in range(line, line + n_lines):
                # SQL's white space before a notice has no vertical tab.
                if not gone[i - line] and n[i] and _NOTICE.match(raw, int(starts[first[i]]), int(line_ends[i])) and b"\v" not in raw[line_starts[i] : starts[first[i]]]:
                    gone[i - line] = True
            repeated = 0
            if n_words >= rules.repeat_window:
                own_windows = windows[w0 : w1 - rules.repeat_window + 1]
                _, back, counts = np.unique(own_windows, return_inverse=True, return_counts=True)
                twice = np.flatnonzero(counts[back] > 1)
                if len(twice):
                    # Equal hashes: the words themselves decide.
                    known: dict[bytes, int] = {}
                    ids = np.array([known.setdefault(raw[i:j], len(known)) for i, j in zip(starts[w0:w1].tolist(), ends[w0:w1].tolist(), strict=True)])
                    _, back, counts = np.unique(np.lib.stride_tricks.sliding_window_view(ids, rules.repeat_window)[twice], axis=0, return_inverse=True, return_counts=True)
                    twice = twice[counts[back.reshape(-1)] > 1]
                    edge = np.bincount(twice, minlength=n_words + 1) - np.bincount(twice + rules.repeat_window, minlength=n_words + 1)
                    repeated = int((np.cumsum(edge) > 0).sum())
            base_failed = n_words < rules.min_words or 100 * repeated > rules.max_repeat_percent * n_words
            lost = int(n[own][gone].sum())
            yield {
                "n_words": n_words,
                "word_chars": int(letters[at + len(p)] - letters[at]),
                "n_symbols": int(symbols[at + len(p)] - symbols[at]),
                "n_dup_lines": len(with_words) - len(lines),
                "n_repeat_words": repeated,
                "base_failed": base_failed,
                "n_lines_removed": int(gone.sum()),
                "n_words_removed": lost,
                "kept": not base_failed and 100 * (n_words - lost) >= rules.min_kept_percent * n_words,
                "gone": gone,
            }
            at += len(p) + 1
            line += n_lines


FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines_removed long, n_words_removed long"


def quality_rules(docs: DataFrame, rules: LineRules = LineRules(), with_text: bool = False) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id and FIELDS; with_text adds clean_text, the lines that stay."""
    names = [f.split()[0] for f in FIELDS.split(", ")]
    kinds = {"long": pa.int64(), "boolean": pa.bool_()}
    types = [kinds[f.split()[1]] for f in FIELDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = list(measure(texts, rules))
            cols = [batch.column("doc_id"), *(pa.array([m[k] for m in found], t) for k, t in zip(names, types, strict=True))]
            if with_text:
                lines = ((t or "").split("\n") for t in texts)
                cols.append(pa.array(["\n".join(x for x, g in zip(own, m["gone"], strict=True) if not g) for own, m in zip(lines, found, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", *names, *["clean_text"] * with_text])

    text_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind(docs, 'doc_id')}, " + FIELDS + ", clean_text string" * with_text)
