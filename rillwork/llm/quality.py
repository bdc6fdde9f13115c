"""Quality rules as a short-circuit cascade.

Every rule's cost and rejection rate are measured on a bounded sample; rules then run in the order of rejections
per cost, each only over the rows that no earlier rule rejected. The verdict is the conjunction of all rules, so
the measured order changes the time taken, never the result.

Null texts count as empty: no words, so the minimum length rejects them. Rows are independent: repeated rows get equal results,
an empty table gives an empty table, texts of any length are read whole, and extra columns are not read (keep_good carries them along).
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
#: Words of a window that is looked for twice, and bytes of a text that costs are measured on.
WINDOW, LONGEST_SAMPLED = 8, 1 << 16


class Texts:
    """A chunk of texts; features are computed when first asked for, and part of a chunk takes over what the whole has."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, whole: Texts | None = None, rows: np.ndarray | None = None):
        self.buf, self.offsets, self.n, self._had, self._whole, self._rows = buf, offsets, len(offsets) - 1, {}, whole, rows

    def _get(self, name: str, make: Callable):
        if name not in self._had:
            whole = self._whole
            if whole is not None and name not in ("words", "ids") and (name in whole._had or ("ids" in whole._had and name in ("n_words", "n_echoes", "n_repeat_words"))):
                got = getattr(whole, name)
                self._had[name] = tuple(x[self._rows] for x in got) if isinstance(got, tuple) else got[self._rows]
            else:
                self._had[name] = make()
        return self._had[name]

    def per_row(self, flags: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    @property
    def words(self):
        return self._get("words", lambda: tv.words(self.buf, self.offsets))

    @property
    def n_words(self):
        return self._get("n_words", lambda: np.bincount(self.words[2], minlength=self.n))

    @property
    def word_chars(self):
        return self._get("word_chars", lambda: self.per_row(~tv.WS[self.buf] & ((self.buf & 0xC0) != 0x80)))

    @property
    def n_symbols(self):
        return self._get("n_symbols", lambda: self.per_row(SYMBOL[self.buf]))

    @property
    def n_letters(self):
        return self._get("n_letters", lambda: self.per_row(tv.LETTER[self.buf] & ((self.buf & 0xC0) != 0x80)))

    @property
    def n_upper(self):
        return self._get("n_upper", lambda: self.per_row(_UPPER[self.buf]))

    @property
    def ids(self):
        """A number for each word, the same for equal words only."""
        return self._get("ids", lambda: tv.classes(self.buf, self.words[0], self.words[1]))

    @property
    def n_echoes(self):
        """Words equal to the word before them."""

        def make():
            ids, row = self.ids, self.words[2]
            return np.bincount(row[1:][(ids[1:] == ids[:-1]) & (row[1:] == row[:-1])], minlength=self.n)

        return self._get("n_echoes", make)

    @property
    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """(lines with a word, those of them equal to an earlier line) for each row."""

        def make():
            starts, ends, row = tv.runs(self.buf != 10, self.offsets)
            filled = np.concatenate(([0], np.cumsum(~tv.WS[self.buf], dtype=np.int64)))
            has = filled[ends] > filled[starts]
            starts, ends, row = starts[has], ends[has], row[has]
            line = tv.classes(self.buf, starts, ends)
            order = np.lexsort((line, row))
            again = np.zeros(len(line), bool)
            again[1:] = (line[order][1:] == line[order][:-1]) & (row[order][1:] == row[order][:-1])
            return np.bincount(row, minlength=self.n), np.bincount(row[order][again], minlength=self.n)

        return self._get("lines", make)

    @property
    def n_repeat_words(self) -> np.ndarray:
        def make():
            starts, row, ids = self.words[0], self.words[2], self.ids
            h, first = tv.window_hashes(ids.astype(np.uint64), row, WINDOW)
            order = np.lexsort((h, row[first]))
            same = (h[order][1:] == h[order][:-1]) & (row[first][order][1:] == row[first][order][:-1])
            # equal hashes are compared word by word
            one, two = first[order[:-1][same]], first[order[1:][same]]
            if any((ids[one + k] != ids[two + k]).any() for k in range(WINDOW)):
                h = np.unique(np.stack([ids[first + k] for k in range(WINDOW)], 1), axis=0, return_inverse=True)[1].reshape(-1)
                order = np.lexsort((h, row[first]))
                same = (h[order][1:] == h[order][:-1]) & (row[first][order][1:] == row[first][order][:-1])
            twice = np.zeros(len(h), bool)
            twice[1:] |= same
            twice[:-1] |= same
            at = first[order][twice]
            cover = np.zeros(len(starts) + WINDOW + 1, np.int64)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + WINDOW, -1)
            return np.bincount(row[np.cumsum(cover)[: len(starts)] > 0], minlength=self.n)

        return self._get("n_repeat_words", make)

    def take(self, rows: np.ndarray) -> Texts:
        starts, ends = self.offsets[rows], self.offsets[rows + 1]
        keep = np.zeros(len(self.buf) + 1, np.int64)
        np.add.at(keep, starts, 1)
        np.add.at(keep, ends, -1)
        whole, at = (self, rows) if self._whole is None else (self._whole, self._rows[rows])
        return Texts(self.buf[np.cumsum(keep)[:-1] > 0], np.concatenate(([0], np.cumsum(ends - starts))), whole, at)


@dataclass(frozen=True)
class Rule:
    """rejects(texts): a flag for each row. base: one of the two rules of base_failed."""

    name: str
    rejects: Callable[[Texts], np.ndarray]
    base: bool = False


MIN_WORDS, REPEAT_PCT, SYMBOL_PCT, UPPER_PCT, LETTER_PCT, DUP_LINE_PCT, ECHO_PCT, MAX_WORD_CHARS = 20, 30, 30, 60, 50, 50, 30, 20

RULES: tuple[Rule, ...] = (
    Rule("min_words", lambda t: t.n_words < MIN_WORDS, True),
    Rule("repeated_windows", lambda t: 100 * t.n_repeat_words > REPEAT_PCT * t.n_words, True),
    Rule("symbols_per_word", lambda t: 100 * t.n_symbols > SYMBOL_PCT * t.n_words),
    Rule("upper_case", lambda t: 100 * t.n_upper > UPPER_PCT * t.n_letters),
    Rule("letters_per_char", lambda t: 100 * t.n_letters < LETTER_PCT * t.word_chars),
    Rule("duplicate_lines", lambda t: 100 * t.lines[1] > DUP_LINE_PCT * t.lines[0]),
    Rule("echoed_words", lambda t: 100 * t.n_echoes > ECHO_PCT * t.n_words),
    Rule("word_length", lambda t: t.word_chars > MAX_WORD_CHARS * t.n_words),
)


def cascade(texts: Texts, rules: Iterable[Rule]) -> np.ndarray:
    """A flag for each row that no rule rejects; each rule sees only what the earlier ones left."""
    alive, part = np.arange(texts.n), texts
    for rule in rules:
        if not len(alive):
            break
        ok = ~rule.rejects(part)
        if not ok.all():
            alive = alive[ok]
            part = part.take(np.flatnonzero(ok))
    kept = np.zeros(texts.n, bool)
    kept[alive] = True
    return kept


def measured_order(sample: list[str], rules: tuple[Rule, ...] = RULES) -> tuple[Rule, ...]:
    """The rules by rejected rows per second, highest first, as measured on the sample."""
    chunks = [Texts(b, o) for _, b, o in tv.text_chunks(pa.array(sample, pa.large_string()))]
    rate = {}
    for k, rule in enumerate(rules):
        began, rejected = time.perf_counter(), 0
        for t in chunks:
            rejected += int(rule.rejects(Texts(t.buf, t.offsets)).sum())
        rate[rule.name] = (-(rejected + 0.5) / max(time.perf_counter() - began, 1e-6), k)
    return tuple(sorted(rules, key=lambda r: rate[r.name]))


def order_for(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = 1000) -> tuple[Rule, ...]:
    """Measures on at most sample_rows rows of a thin sample of texts of at most LONGEST_SAMPLED bytes; it reads only as many partitions as these take."""
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("t")).where(F.octet_length("t") <= LONGEST_SAMPLED).sample(0.05, seed=7).limit(sample_rows).collect()
    return measured_order([r.t for r in rows], rules)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = 1000, stats: bool = True) -> DataFrame:
    """One row per input row: doc_id, kept and, if stats, the base statistics (which are then computed for every row)."""
    order = order_for(docs, text_col, rules, sample_rows)
    names = [r.name for r in order]
    pool = {r.name: r for r in rules}
    standard = all(RULES_BY_NAME.get(n) is pool[n] for n in names)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordered = [RULES_BY_NAME[n] for n in names] if standard else order
        for b in batches:
            cols: dict[str, list[np.ndarray]] = {}
            for _, buf, off in tv.text_chunks(b.column(1)):
                t = Texts(buf, off)
                out = {}
                if stats:  # made for every row, so that the cascade finds them there
                    out = {"n_words": t.n_words, "word_chars": t.word_chars, "n_symbols": t.n_symbols, "n_dup_lines": t.lines[1], "n_repeat_words": t.n_repeat_words}
                    out["base_failed"] = (t.n_words < MIN_WORDS) | (100 * t.n_repeat_words > REPEAT_PCT * t.n_words)
                out["kept"] = cascade(t, ordered)
                if stats:
                    out["kept"] &= ~out["base_failed"]
                for k, v in out.items():
                    cols.setdefault(k, []).append(v)
            if cols:
                arrays = {k: np.concatenate(v) for k, v in cols.items()}
                yield pa.RecordBatch.from_arrays([b.column(0)] + [pa.array(arrays[k], pa.bool_() if k in ("kept", "base_failed") else pa.int64()) for k in fields], ["doc_id", *fields])
        tv.give_back()

    fields = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"] if stats else ["kept"]
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(apply, f"doc_id {kind}, " + ", ".join(f"{f} {'boolean' if f in ('kept', 'base_failed') else 'long'}" for f in fields))


RULES_BY_NAME = {r.name: r for r in RULES}


def keep_good(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = 1000) -> DataFrame:
    """The rows that no rule rejects, with all their columns and without a shuffle: the flag is a filter on the text itself."""
    order = order_for(docs, text_col, rules, sample_rows)
    names = [r.name for r in order]

    @F.arrow_udf("boolean")
    def passes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            got = [cascade(Texts(buf, off), [RULES_BY_NAME[n] for n in names]) for _, buf, off in tv.text_chunks(texts)]
            yield pa.array(np.concatenate(got) if got else np.zeros(0, bool), pa.bool_())
        tv.give_back()

    return docs.where(passes(F.col(text_col)))
