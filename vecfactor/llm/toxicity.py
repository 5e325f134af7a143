"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

* Folding: lower case, then look-alike letters of other scripts and digits or
  signs that stand for letters become the plain letter. A run with more digits and
  signs than letters (a code, mostly) stays as it is and is looked up a second time in
  its folded form: it counts if that is an entry as a whole; numbers never do.
* Lexicon: on a bounded, hashed sample of the labelled documents, words and word
  stems (the first 4 to 7 letters) are weighted by the log-odds of the label;
  entries are kept if they are frequent and one-sided enough and stand among
  differing neighbours (copies of one text prove nothing); a stem gives way to its longest extension of nearly
  the same support.
* Exceptions: two-word phrases with a lexicon word that occur in documents of
  label 0 but hardly in those of label 1; inside them a word does not count.
* Score: matched weight, normalised by the logarithm of the text's length, through
  a logistic function fitted on the sample.

The automaton is built per task from the lexicon (bounded by ``max_entries``) and
run over whole texts: one pass over the folded text finds all entries; a
match counts where a word starts (an entry that is a stem) or fills a word.

Null texts count as empty; texts without matches get the score of no evidence;
rows with a null label or id are no training rows; without labels of both kinds
every score is the share of label 1 (0.5 without any).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecfactor.llm.common import crc32_text
from vecfactor.llm.rule_ensemble import training_rows

# fixed values: look-alikes and the plain letters they stand for
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d",
    "һ": "h", "ӏ": "l", "ո": "n", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "α": "a", "ε": "e", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "τ": "t", "υ": "u", "χ": "x", "ϲ": "c",
}
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}

_WORD = re.compile(r"\w+")
_FULLWIDTH = {0xFF01 + i: 0x21 + i for i in range(94)}
_ZERO_WIDTH = {c: None for c in (0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0x00AD)}
_GLYPHS = str.maketrans(HOMOGLYPHS) | _FULLWIDTH | _ZERO_WIDTH
# a digit or sign stands for a letter only inside or at the start of a run with a letter
_LEET_RUN = re.compile(r"[\w@$]*[0-9@$][\w@$]*")
_LEET_SIGN = re.compile(r"[0-9@$]")
_LEET_MAP = str.maketrans(LEET)


def _unleet(m: re.Match) -> str:
    run = m.group()
    letters = sum(c.isalpha() for c in run)
    if letters < len(run) - letters:  # mostly digits: a number or code, not a disguised word
        return run
    return run.translate(_LEET_MAP)


def fold(text: str) -> str:
    t = text.lower()
    if not t.isascii():
        t = t.translate(_GLYPHS)
    return _LEET_RUN.sub(_unleet, t) if _LEET_SIGN.search(t) else t


def _word_before(t: str, start: int) -> str:
    end = start
    while end and not (t[end - 1].isalnum() or t[end - 1] == "_"):
        end -= 1
    first = end
    while first and (t[first - 1].isalnum() or t[first - 1] == "_"):
        first -= 1
    return t[first:end]


@dataclass
class ToxicModel:
    """``entries``: folded entry -> (weight, is_stem)."""
    entries: dict[str, tuple[float, bool]] = field(default_factory=dict)
    exceptions: frozenset[tuple[str, str]] = frozenset()
    intercept: float = 0.0
    slope: float = 0.0

    def automaton(self):
        import ahocorasick
        a = ahocorasick.Automaton()
        for word, (weight, stem) in self.entries.items():
            a.add_word(word, (word, weight, stem))
        if self.entries:
            a.make_automaton()
        return a

    def evidence(self, text: str, automaton) -> tuple[float, int]:
        """(sum of weights over the matched words, matched words)."""
        if not self.entries or not text:
            return 0.0, 0
        t = fold(text)
        best: dict[int, tuple[float, int]] = {}
        for end, (word, weight, stem) in automaton.iter(t):
            start = end - len(word) + 1
            if start and (t[start - 1].isalnum() or t[start - 1] == "_"):
                continue
            stop = end + 1
            if stop < len(t) and (t[stop].isalnum() or t[stop] == "_"):
                if not stem:
                    continue
            if start not in best or abs(weight) > abs(best[start][0]):
                best[start] = (weight, stop)
        if _LEET_SIGN.search(t):  # only mostly-digit runs still have such signs beside letters
            for m in _LEET_RUN.finditer(t):
                entry = self.entries.get(m.group().translate(_LEET_MAP))
                if entry and m.start() not in best and any(c.isalpha() for c in m.group()):
                    best[m.start()] = (entry[0], m.end())
        total, n = 0.0, 0
        for start in sorted(best):
            weight, stop = best[start]
            if self.exceptions and self._excepted(t, start):
                continue
            total, n = total + weight, n + 1
        return total, n

    def _excepted(self, t: str, start: int) -> bool:
        word, run = _WORD.match(t, start), _LEET_RUN.match(t, start)
        own = [word.group()] if word else []
        own += [run.group().translate(_LEET_MAP)] if run else []  # a mostly-digit run in its folded form
        after = _WORD.search(t, max(m.end() for m in (word, run) if m))
        before = _word_before(t, start)
        return any((before, o) in self.exceptions or bool(after) and (o, after.group()) in self.exceptions for o in own)

    def feature(self, total: float, n_chars: int) -> float:
        """Evidence normalised by length: 1,000 characters weigh as 1."""
        return total / (1.0 + math.log1p(n_chars / 1000.0))

    def score(self, total: float, n_chars: int) -> float:
        z = self.intercept + self.slope * self.feature(total, n_chars)
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, z))))


STEMS = (4, 5, 6, 7)


def _tokens(folded: str) -> list[str]:
    return _WORD.findall(folded)


def _entries_of(words: set[str]) -> set[tuple[str, bool]]:
    out = {(w, False) for w in words if len(w) >= 3}
    for w in words:
        out.update((w[:k], True) for k in STEMS if len(w) >= k)
    return out


def fit_lexicon(sample: list[tuple[str, int]], max_entries: int = 5_000, min_docs: int = 5,
                min_odds: float = 12.0) -> ToxicModel:
    """Fit on (text, label) pairs, equal pairs once; bounded by the caller."""
    sample = list(dict.fromkeys(sample))
    pos, neg, np_, nn = Counter(), Counter(), 0, 0
    folded = [(_tokens(fold(t)), y) for t, y in sample]
    for toks, y in folded:
        e = _entries_of(set(toks))
        if y:
            pos.update(e)
            np_ += 1
        else:
            neg.update(e)
            nn += 1
    if not np_ or not nn:
        p = min(max(np_ / (np_ + nn), 1e-6), 1 - 1e-6) if np_ + nn else 0.5
        return ToxicModel({}, frozenset(), math.log(p / (1 - p)), 0.0)

    def odds(e) -> float:
        p, q = (pos[e] + 0.5) / (np_ + 1.0), (neg[e] + 0.5) / (nn + 1.0)
        return math.log(p / (1 - p)) - math.log(q / (1 - q))
    # a stem gives way to its longest extension that has nearly the same support
    stems: dict[str, float] = {}
    words_: dict[str, float] = {}
    for e, c in pos.items():
        if c >= min_docs and (o := odds(e)) >= math.log(min_odds):
            (stems if e[1] else words_)[e[0]] = o
    longer = Counter()
    for w in stems:
        for k in STEMS:
            if k < len(w):
                longer[w[:k]] = max(longer[w[:k]], pos[(w, True)])
    cand = {w: (o, True) for w, o in stems.items() if longer[w] < 0.9 * pos[(w, True)]}
    cand |= {w: (o, False) for w, o in words_.items()
             if not any(w[:k] in stems for k in STEMS if k <= len(w))}
    # words of texts that were copied stand in the same place again and again: an entry
    # needs neighbours that differ from text to text
    around: dict[str, set] = {}
    docs = Counter()
    for toks, y in folded:
        if not y:
            continue
        seen = set()
        for i, t in enumerate(toks):
            for w, stem in _entries_of({t}):
                if w in cand and cand[w][1] == stem:
                    seen.add(w)
                    around.setdefault(w, set()).add((toks[i - 1] if i else "", toks[i + 1] if i + 1 < len(toks) else ""))
        docs.update(seen)
    real = [w for w in around if len(around[w]) >= max(min_docs, 0.5 * docs[w])]
    real.sort(key=lambda w: (-cand[w][0] * math.sqrt(docs[w]), w))
    final = {w: cand[w] for w in real[:max_entries]}
    model = ToxicModel(final)
    model.exceptions = _fit_exceptions(folded, final)
    _fit_curve(model, sample)
    return model


def _fit_exceptions(folded: list[tuple[list[str], int]], entries: dict[str, tuple[float, bool]],
                    min_docs: int = 3) -> frozenset[tuple[str, str]]:
    good, bad = Counter(), Counter()
    for toks, y in folded:
        hit = [w in entries and not entries[w][1]
               or any(w[:k] in entries and entries[w[:k]][1] for k in STEMS) for w in toks]
        pairs = {(a, b) for a, b, h, g in zip(toks, toks[1:], hit, hit[1:]) if h or g}
        (bad if y else good).update(pairs)
    return frozenset(p for p, c in good.items() if c >= min_docs and bad[p] * 20 <= c)


def _fit_curve(model: ToxicModel, sample: list[tuple[str, int]], steps: int = 200, ridge: float = 1e-3) -> None:
    """Logistic curve over the normalised evidence (two parameters, Newton)."""
    a = model.automaton()
    xs = [model.feature(model.evidence(t, a)[0], len(t)) for t, _ in sample]
    ys = [y for _, y in sample]
    b0 = b1 = 0.0
    n = len(xs)
    for _ in range(steps):
        g0 = g1 = 0.0
        h00, h01, h11 = 1e-9, 0.0, ridge * n
        for x, y in zip(xs, ys):
            p = 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, b0 + b1 * x))))
            d, w = p - y, p * (1 - p)
            g0, g1 = g0 + d, g1 + d * x
            h00, h01, h11 = h00 + w, h01 + w * x, h11 + w * x * x
        g1 += ridge * n * b1
        det = h00 * h11 - h01 * h01
        if det <= 1e-12:
            break
        s0, s1 = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        b0, b1 = b0 - max(-2.0, min(2.0, s0)), b1 - max(-2.0, min(2.0, s1))
        if abs(s0) + abs(s1) < 1e-8:
            break
    model.intercept, model.slope = b0, max(b1, 0.0)


def score_texts(df: DataFrame, model: ToxicModel, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` plus ``score``, ``n_matches`` and ``evidence``."""
    fields = [f for f in df.select(*keep).schema.fields]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields]
                       + ["score double", "n_matches long", "evidence double"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = model.automaton()
        for pdf in batches:
            score, hits, ev = [], [], []
            for t in pdf["_text"]:
                t = t or ""
                total, n = model.evidence(t, a)
                score.append(model.score(total, len(t)))
                hits.append(n)
                ev.append(total)
            yield pdf[keep].assign(score=score, n_matches=hits, evidence=ev)
    return df.select(*keep, F.col(text_col).alias("_text")).mapInPandas(run, schema)


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_train_rows: int = 6_000) -> ToxicModel:
    allowed = F.pmod(crc32_text("doc_id"), F.lit(3)) != 1
    rows = training_rows(docs, labels, "toxic", allowed, max_train_rows).select("doc_id", "text", "label")
    # texts of the bounded sample, one at a time through the driver's iterator
    sample = sorted((r["doc_id"], r["text"], int(r["label"])) for r in rows.toLocalIterator())
    return fit_lexicon([(t, y) for _, t, y in sample])


def toxicity_scores(docs: DataFrame, labels: DataFrame, max_train_rows: int = 6_000) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, n_matches."""
    model = fit_toxicity(docs, labels, max_train_rows)
    held = F.coalesce(F.pmod(crc32_text("doc_id"), F.lit(3)) == 1, F.lit(False))
    s = score_texts(docs.select("doc_id", "text"), model, ["doc_id"])
    return s.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"),
                    "n_matches")
