"""Toxicity by a weighted finite-state pattern grammar.

A clause is a run of words between sentence or line ends. Each word maps to a symbol (insult, threat, target, negation,
reported speech, other), and a cascade of transducers rewrites the symbols of a clause from left to right:

* negation marks the attacks that stand in its reach,
* reported speech marks the attacks that follow a word of saying,
* target decides whether an attack is aimed: at a target shortly before it, or shortly behind it, for which the
  transducer holds the attack back until the target, or the end of the reach, comes,
* insult and threat, side by side, turn their attacks into patterns: (kind, aimed, negated, reported).

The transducers are composed into one, built once, whose arcs put out sets of patterns; a clause's set is the union
along its path, and its weight is the sum of its patterns' weights. A document is scored by the logistic of the sum
over its clauses, in which equal patterns count with falling returns.

The weights, and insult words and stems beside the seeds below, are learned from a bounded sample of labelled rows.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter, deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmatch.llm.common import is_held_out, portions

#: Labelled rows used for fitting, at most so many of each class.
SAMPLE = {0: 5000, 1: 2000}

# Seed words of each class, in English, German, French and Spanish.
INSULTS = "idiot idiots moron morons stupid loser losers pathetic scum worthless trash clown disgusting imbecile dumb vermin idiotisch dummkopf abschaum arschloch wertlos crétin débile ordure minable estúpido imbécil basura inútil"
THREATS = "kill murder destroy hurt attack beat burn stab töten umbringen zerstören tuer détruire frapper matar destruir golpear"
TARGETS = "you your yours he she they them u du dich dir ihr euch sie tu toi vous eux ustedes tú vosotros ellos"
NEGATIONS = "no not never isn't aren't wasn't don't doesn't neither nor nicht kein keine niemals jamais aucun nunca jamás"
REPORTS = "said says called calls claimed wrote quoted alleged reported allegedly sagte nannte behauptete angeblich disait appelé prétend dijo llamó afirmó"

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
#: Words that stand between clauses.
TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)?|[.!?;:\n]")
ENDS = frozenset(".!?;:\n")
#: How far, in words, a negation governs what follows it, and a target lies from an attack on either side.
NEGATION_REACH, TARGET_REACH = 3, 3

#: Pattern: (attack kind, aimed at a target, negated, reported). One weight each, with a prior of these values.
PATTERNS = [(kind, *rest) for kind in (INSULT, THREAT) for rest in itertools.product((False, True), repeat=3)]
PATTERN_ID = {p: i for i, p in enumerate(PATTERNS)}


def _prior(pattern: tuple[int, bool, bool, bool]) -> float:
    kind, aimed, negated, reported = pattern
    weight = (3.0 if kind == INSULT else 0.3) + (0.7 if kind == INSULT else 2.7) * aimed
    return weight * (0.4 if negated else 1.0) * (0.6 if reported else 1.0)


class Negation:
    """State: words that a negation still reaches. An attack comes out as (kind, negated), other symbols as they are."""

    start = 0

    def step(self, left: int, symbol: int) -> tuple[int, list]:
        if symbol == NEGATION:
            return NEGATION_REACH, [OTHER]
        return max(0, left - 1), [(symbol, left > 0) if symbol in (INSULT, THREAT) else symbol]

    def end(self, left: int) -> list:
        return []


class Report:
    """State: whether a word of saying came. An attack comes out as (kind, negated, reported)."""

    start = False

    def step(self, said: bool, symbol) -> tuple[bool, list]:
        if symbol == REPORT:
            return True, [OTHER]
        return said, [(*symbol, said) if isinstance(symbol, tuple) else symbol]

    def end(self, said: bool) -> list:
        return []


class Target:
    """State: words that the last target, or an attack aimed at it, still reaches, and for each kind an attack that waits
    for a target behind it: (attack, words left). Attacks come out as (kind, negated, reported, aimed); all else is dropped."""

    start = (0, None, None)

    def step(self, state: tuple, symbol) -> tuple[tuple, list]:
        near, *waiting = state
        out = []
        if symbol == TARGET:
            out += [(*w[0], True) for w in waiting if w]
            return (TARGET_REACH, None, None), out
        for k, w in enumerate(waiting):
            if w and w[1] == 1:
                out.append((*w[0], False))
            waiting[k] = (w[0], w[1] - 1) if w and w[1] > 1 else None
        if not isinstance(symbol, tuple):
            return (max(0, near - 1), *waiting), out
        if near:
            return (TARGET_REACH, *waiting), [*out, (*symbol, True)]
        k = 0 if symbol[0] == INSULT else 1
        if waiting[k]:
            out.append((*waiting[k][0], False))
        waiting[k] = (symbol, TARGET_REACH)
        return (0, *waiting), out

    def end(self, state: tuple) -> list:
        return [(*w[0], False) for w in state[1:] if w]


class Attack:
    """One state: turns attacks of its kind into patterns, and lets the other kind pass to the other transducer."""

    start = 0

    def __init__(self, kind: int):
        self.kind = kind

    def step(self, state: int, symbol) -> tuple[int, list]:
        if isinstance(symbol, tuple) and symbol[0] == self.kind:
            kind, negated, reported, aimed = symbol
            return state, [PATTERN_ID[kind, aimed, negated, reported]]
        return state, [symbol]

    def end(self, state: int) -> list:
        return []


CASCADE = (Negation(), Report(), Target(), Attack(INSULT), Attack(THREAT))


def cascade_step(states: tuple, symbol: int) -> tuple[tuple, int]:
    """One symbol through all transducers: their next states, and the patterns put out, as a bit set."""
    flow, after = [symbol], []
    for machine, state in zip(CASCADE, states):
        out = []
        for x in flow:
            state, some = machine.step(state, x)
            out += some
        flow = out
        after.append(state)
    return tuple(after), sum(1 << p for p in set(flow))


def cascade_end(states: tuple) -> int:
    """What is put out at a clause's end."""
    flow: list = []
    for machine, state in zip(CASCADE, states):
        out = []
        for x in flow:
            state, some = machine.step(state, x)
            out += some
        flow = out + machine.end(state)
    return sum(1 << p for p in set(flow))


def compose() -> tuple[list[list[int]], list[list[int]], list[int]]:
    """The composed transducer: next state and output by state and symbol, and each state's output at a clause's end."""
    start = tuple(m.start for m in CASCADE)
    number, todo, table, output = {start: 0}, deque([start]), [], []
    while todo:
        states = todo.popleft()
        row, puts = [], []
        for symbol in range(6):
            to, patterns = cascade_step(states, symbol)
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            row.append(number[to])
            puts.append(patterns)
        table.append(row)
        output.append(puts)
    return table, output, [cascade_end(s) for s in number]


NEXT, OUTPUT, FINAL = compose()


@dataclass(frozen=True)
class Grammar:
    """words: class by word; stems: beginnings of insults; weights: by pattern, then the intercept."""

    words: dict[str, int]
    stems: frozenset[str]
    weights: tuple[float, ...]

    def classify(self, word: str) -> int:
        known = self.words.get(word)
        if known is not None:
            return known
        return INSULT if any(word[:n] in self.stems for n in range(4, min(len(word), 8) + 1)) else OTHER


def seeds() -> dict[str, int]:
    out: dict[str, int] = {}
    for kind, text in ((REPORT, REPORTS), (NEGATION, NEGATIONS), (TARGET, TARGETS), (THREAT, THREATS), (INSULT, INSULTS)):
        out |= dict.fromkeys(text.split(), kind)
    return out


def clauses(classes: list[int]) -> Iterator[int]:
    """The patterns, as a bit set, of each clause that holds an attack. classes: of each token, -1 for a clause's end."""
    if INSULT not in classes and THREAT not in classes:
        return
    at, whole = 0, len(classes)
    while at < whole:
        try:
            to = classes.index(-1, at)
        except ValueError:
            to = whole
        clause = classes[at:to]
        if INSULT in clause or THREAT in clause:
            state = found = 0
            for symbol in clause:
                found |= OUTPUT[state][symbol]
                state = NEXT[state][symbol]
            yield found | FINAL[state]
        at = to + 1


class Scorer:
    """Runs a grammar over texts; keeps the class of each word it has met, within a bound."""

    def __init__(self, grammar: Grammar):
        self.grammar, self.memo = grammar, dict.fromkeys(ENDS, -1)
        self.ends = dict(self.memo)

    def patterns(self, text: str) -> list[int]:
        tokens = TOKEN.findall(text.lower())
        memo, classify = self.memo, self.grammar.classify
        classes = list(map(memo.get, tokens))
        if None in classes:
            for at, symbol in enumerate(classes):
                if symbol is None:
                    word = tokens[at]
                    classes[at] = symbol = classify(word)
                    if len(memo) > 300_000:
                        memo.clear()
                        memo.update(self.ends)
                    if len(word) < 40:
                        memo[word] = symbol
        return list(clauses(classes))

    def score(self, text: str) -> tuple[float, int]:
        found = self.patterns(text)
        z = float(features(found) @ np.asarray(self.grammar.weights))
        return 1.0 / (1.0 + math.exp(-max(-35.0, min(35.0, z)))), len(found)


def features(found: Iterable[int]) -> np.ndarray:
    """log2(1 + clauses with it) of each pattern, and 1 for the intercept."""
    x = np.zeros(len(PATTERNS) + 1)
    for patterns, n in Counter(found).items():
        for p in range(len(PATTERNS)):
            if patterns >> p & 1:
                x[p] += n
    x = np.log2(1 + x)
    x[-1] = 1.0
    return x


def _keys(text: str) -> set[str]:
    """Words of three letters and more, and their beginnings of 4 to 8 characters, marked by a star."""
    words = {w for w in TOKEN.findall(text.lower()) if len(w) > 2}
    return words | {w[:k] + "*" for w in words for k in range(4, min(len(w), 8) + 1)}


def learn_insults(rows: list[tuple[int, str, int]], purity: float = 0.995, chance: float = 0.05) -> tuple[set[str], set[str]]:
    """Words and stems that mark toxic rows.

    A key counts if its share of toxic rows is at least purity (classes weigh alike), and if it is in so many that with
    a probability of at most `chance` any key without meaning would be in as many, and in no clean row. The shortest
    such stems that begin three words or more are taken, and the words that none of them begins. Keys that mostly stand
    between the same two words come from copies of one text and do not count.
    """
    toxic_texts = [text for _, text, y in rows if y]
    clean_texts = [text for _, text, y in rows if not y]
    toxic, clean = Counter(), Counter()
    for text in toxic_texts:
        toxic.update(_keys(text))
    begun = Counter(w[:k] + "*" for w in toxic if not w.endswith("*") for k in range(4, min(len(w), 8) + 1))
    toxic = Counter({k: n for k, n in toxic.items() if n >= 3})
    for text in clean_texts:
        clean.update(k for k in _keys(text) if k in toxic)
    n_toxic, n_clean = max(1, len(toxic_texts)), max(1, len(clean_texts))
    least = max(3, math.ceil(math.log(max(1, len(toxic)) / chance) / math.log((n_toxic + n_clean) / n_toxic)))
    pure = [k for k, a in toxic.items() if a >= least and a / n_toxic >= purity * (a / n_toxic + clean[k] / n_clean)]
    # Copies of one text are no independent evidence: a key must stand between different neighbours.
    between: dict[str, set[tuple[str, str]]] = {k: set() for k in pure}
    for text in toxic_texts:
        tokens = TOKEN.findall(text.lower())
        for before, word, after in zip(["", *tokens], tokens, [*tokens[1:], ""]):
            for k in (word, *(word[:n] + "*" for n in range(4, min(len(word), 8) + 1))):
                if k in between:
                    between[k].add((before, after))
    pure = [k for k in pure if len(between[k]) >= max(least, toxic[k] / 2)]
    stems: set[str] = set()
    for k in sorted((k[:-1] for k in pure if k.endswith("*") and begun[k] >= 3), key=lambda k: (len(k), k)):
        if not any(k[:n] in stems for n in range(4, len(k))):
            stems.add(k)
    words = {k for k in pure if not k.endswith("*") and not any(k[:n] in stems for n in range(4, min(len(k), 8) + 1))}
    return words, stems


def fit(rows: list[tuple[int, str, int]], strength: float = 1.0) -> Grammar:
    """Learns the insult lexicon, then the pattern weights: logistic regression whose penalty pulls to the prior.

    Without rows of both classes the prior is the model.
    """
    rows = [r for r in rows if not is_held_out(r[0])]
    prior = np.array([*map(_prior, PATTERNS), -2.5])
    if len({y for _, _, y in rows}) < 2:
        return Grammar(seeds(), frozenset(), tuple(prior))
    words, stems = learn_insults(rows)
    start = Grammar(seeds() | dict.fromkeys(words, INSULT), frozenset(stems), tuple(prior))
    scorer = Scorer(start)
    x = np.array([features(scorer.patterns(text)) for _, text, _ in rows])
    y = np.array([y for _, _, y in rows], float)
    # Both classes weigh as if the toxic ones were a tenth, about their share in labelled corpora.
    n1 = y.sum()
    row_weight = np.where(y == 1, 0.1 * len(y) / n1, 0.9 * len(y) / (len(y) - n1))
    w = prior.copy()
    pull = np.full(len(w), strength)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        slope = x.T @ (row_weight * (p - y)) + pull * (w - prior)
        curve = (x * (row_weight * p * (1 - p))[:, None]).T @ x + np.diag(pull)
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return Grammar(start.words, start.stems, tuple(float(v) for v in w))


def score_documents(docs: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """id_col, score (0 to 1), predicted (score >= threshold) and n_clauses (clauses with an attack) of every whole text.

    Only the text is an input of the score. A null or empty text has no clause and gets the intercept's low score;
    repeated rows each give a row; null ids pass through; an empty table gives no rows; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(grammar)
        for batch in portions(batches, 1):
            found = [own.score(text or "") for text in batch.column(1).to_pylist()]
            scores = [s for s, _ in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array([n for _, n in found], pa.int32())],
                names=[id_col, "score", "predicted", "n_clauses"],
            )

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(score, f"`{id_col}` {kind}, score double, predicted int, n_clauses int")
