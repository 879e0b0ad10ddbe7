"""Toxicity by a weighted finite-state pattern grammar.

A lexicon turns words and signs into symbols: insults and threats, each with a weight, targets, negations,
reporting words, words that mention a word, quotation marks and breaks. Small transducers, given below as
tables of arcs, read these symbols: a negation's scope, reported speech with its quotations, mentions, and
the patterns that a clause must match: an insult at a target or by itself, a threat against a target.
They are composed into one machine. An arc's factor says what of a word's weight counts there; a
clause's weight is that of its best accepted path, since whether a target is still to come is guessed.
A logistic fit turns the weights of the matched clauses into a probability. Beside its fixed entries
the lexicon has words and stems learned from labelled documents.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, map_columns, ship

#: At most so many labelled rows are fitted.
TRAINING_ROWS = 12_000
#: Letters of the stems that are learned, the longest first.
STEMS = (9, 8, 7, 6, 5, 4)
#: The chance of any learned entry to arise by itself; the least log odds of an entry.
CHANCE, LEAST_ODDS = 0.01, 1.5
#: Words that a negation reaches; what is left of a weight in its scope, and in reported speech; the
#: factor of an insult at a target.
REACH, NEGATED, REPORTED, TARGETED = 3, 0.4, 0.7, 1.25
MEMORY = 300_000

#: Fixed entries of the lexicon.
INSULTS = {w: 4.0 for w in "idiot idiots moron morons imbecile loser losers scum trash worthless pathetic disgusting stupid clown dumbass bastard bitch asshole retard vermin subhuman arschloch idioten dummkopf abschaum connard connasse abruti salope imbécile idiota estúpido estúpida cabrón pendejo gilipollas".split()}
THREATS = {w: 2.0 for w in "kill hurt destroy murder strangle shoot stab beat töten umbringen verletzen tuer frapper détruire matar golpear destruir".split()}
TARGETS = frozenset("you your yours yourself u ur they them he she him her these those du dich dir dein ihr euch sie tu te toi ton vous votre usted ustedes ti tus ellos".split())
NEGATIONS = frozenset("not no never neither nor without isn't aren't wasn't don't doesn't nicht kein keine keinen nie ne pas jamais sans nunca jamás sin".split())
REPORTS = frozenset("said says say saying called calls told tells wrote writes quoted quote claimed reported sagte sagt schrieb nannte dit disait écrit appelé dijo dice escribió llamó".split())

MENTIONS = frozenset("word words term terms expression insult wort wörter begriff ausdruck mot mots terme palabra palabras término".split())

_TOKEN = re.compile(r"\w+(?:['’]\w+)?|[.!?;:,\n\"“”«»()|]")

OTHER, TARGET, NOT, SAID, MENTION, QUOTE, PAUSE, STOP, LINE, INSULT, THREAT = SYMBOLS = range(11)
SIGNS = {**dict.fromkeys(".!?;|", STOP), "\n": LINE, **dict.fromkeys('"“”«»', QUOTE), **dict.fromkeys(",:()", PAUSE)}
#: The clause ends at these.
ENDS = (STOP, LINE)


@dataclass(frozen=True)
class Machine:
    """A transducer: arcs[state][symbol] is a tuple of (next state, symbol put out, factor)."""

    start: object
    arcs: dict
    final: frozenset

    @classmethod
    def of(cls, start, table: dict, final, factor: float) -> Machine:
        """From a table (state, symbol) -> (next state, symbol put out, factor), ... . A symbol that a state has no arc for
        leads back to it, unchanged, with this factor."""
        states = {state for state, _ in table} | {arc[0] for arcs in table.values() for arc in arcs}
        return cls(start, {q: {x: table.get((q, x), ((q, x, factor),)) for x in SYMBOLS} for q in states}, frozenset(final))

    def _joined(self, other: Machine, step) -> Machine:
        start = (self.start, other.start)
        arcs, todo = {}, [start]
        while todo:
            here = todo.pop()
            if here not in arcs:
                arcs[here] = {x: tuple(step(here, x)) for x in SYMBOLS}
                todo += [arc[0] for out in arcs[here].values() for arc in out]
        return Machine(start, arcs, frozenset(q for q in arcs if q[0] in self.final and q[1] in other.final))

    def then(self, other: Machine) -> Machine:
        """The composition: other reads what this one puts out; factors multiply."""
        return self._joined(other, lambda here, x: [((p, q), z, f * g) for p, y, f in self.arcs[here[0]][x] for q, z, g in other.arcs[here[1]][y]])

    def beside(self, other: Machine) -> Machine:
        """Both read the same symbols; factors add up."""
        return self._joined(other, lambda here, x: [((p, q), x, f + g) for p, _, f in self.arcs[here[0]][x] for q, _, g in other.arcs[here[1]][x]])


def _negation() -> Machine:
    """States count the words that a negation still reaches."""
    table = {}
    for left in range(REACH + 1):
        table |= {(left, x): ((max(0, left - 1), x, NEGATED if left and x in (INSULT, THREAT) else 1.0),) for x in SYMBOLS}
        table |= {(left, x): ((0, x, 1.0),) for x in (PAUSE, *ENDS)}
        table |= {(left, NOT): ((REACH, NOT, 1.0),), (left, QUOTE): ((left, QUOTE, 1.0),)}
    return Machine.of(0, table, range(REACH + 1), 1.0)


def _reported() -> Machine:
    """Reported speech lasts to the end of its clause, a quotation to its closing mark or the end of the line."""
    table = {
        ("plain", SAID): (("said", SAID, 1.0),), ("plain", QUOTE): (("cited", QUOTE, 1.0),),
        ("said", QUOTE): (("quoting", QUOTE, 1.0),), ("said", STOP): (("plain", STOP, 1.0),),
        ("cited", QUOTE): (("plain", QUOTE, 1.0),), ("quoting", QUOTE): (("said", QUOTE, 1.0),),
    }
    for state in ("said", "cited", "quoting"):
        table |= {(state, LINE): (("plain", LINE, 1.0),), **{(state, x): ((state, x, REPORTED),) for x in (INSULT, THREAT)}}
    return Machine.of("plain", table, ("plain", "said", "cited", "quoting"), 1.0)


def _mention() -> Machine:
    """An insult right after a word for words is only named: it is put out as any other word."""
    table = {("use", MENTION): (("mention", MENTION, 1.0),), **{("mention", x): (("use", x, 1.0),) for x in SYMBOLS}}
    table |= {("mention", x): (("mention", x, 1.0),) for x in (MENTION, QUOTE)}
    table |= {("mention", x): (("use", OTHER, 0.0),) for x in (INSULT, THREAT)}
    return Machine.of("use", table, ("use", "mention"), 1.0)


#: Accepts a clause with insults by themselves, or at a target before or after them.
INSULTING = Machine.of("none", {
    ("none", INSULT): (("bare", INSULT, 1.0), ("await", INSULT, TARGETED)), ("none", TARGET): (("target", TARGET, 0.0),),
    ("target", INSULT): (("aimed", INSULT, TARGETED),), ("bare", INSULT): (("bare", INSULT, 1.0),),
    ("await", INSULT): (("await", INSULT, TARGETED),), ("await", TARGET): (("aimed", TARGET, 0.0),), ("aimed", INSULT): (("aimed", INSULT, TARGETED),),
}, ("none", "target", "bare", "aimed"), 0.0)
#: Accepts a clause with threats that have a target; other threats may be passed over.
THREATENING = Machine.of("none", {
    ("none", THREAT): (("none", THREAT, 0.0), ("await", THREAT, 1.0)), ("none", TARGET): (("target", TARGET, 0.0),), ("target", THREAT): (("target", THREAT, 1.0),),
    ("await", THREAT): (("await", THREAT, 1.0),), ("await", TARGET): (("target", TARGET, 0.0),),
}, ("none", "target"), 0.0)
#: What comes before the patterns goes on from clause to clause; the patterns begin anew in each.
SCOPES = _negation().then(_reported()).then(_mention())
PATTERNS = INSULTING.beside(THREATENING)
GRAMMAR = SCOPES.then(PATTERNS)


def clause_weight(clause: list[tuple[int, float]], scope) -> tuple[float, object]:
    """The weight of the best accepted path through a clause of (symbol, weight), from this state of SCOPES
    on, and the state of SCOPES at its end."""
    best = {(scope, PATTERNS.start): 0.0}
    for symbol, weight in clause:
        after: dict = {}
        for state, total in best.items():
            for to, _, factor in GRAMMAR.arcs[state][symbol]:
                after[to] = max(after.get(to, 0.0), total + weight * factor)
        best = after
    return max(total for state, total in best.items() if state in GRAMMAR.final), next(iter(best))[0]


@dataclass
class Grammar:
    """words and stems: learned insult weights; slope, length and offset: coefficients of the log odds, for
    the logarithms of the matched weight and of the number of tokens, and the constant."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    slope: float = 3.0
    length: float = 0.0
    offset: float = -4.0

    def __post_init__(self):
        self.weights: list[tuple[int, float]] = [(x, 0.0) for x in SYMBOLS]
        self.memory: dict[str, int] = {}

    def symbol(self, token: str) -> int:
        """The number of the token's symbol; from the number of symbols on, of its symbol and weight."""
        word = token.lower().replace("’", "'")
        weight, kind = max(INSULTS.get(word, 0.0), self.words.get(word, 0.0)), INSULT
        if not weight:
            weight = next((self.stems[word[:n]] for n in STEMS if len(word) >= n and word[:n] in self.stems), 0.0)
        if not weight and word in THREATS:
            weight, kind = THREATS[word], THREAT
        if weight:
            self.weights.append((kind, weight))
            return len(self.weights) - 1
        if token in SIGNS:
            return SIGNS[token]
        return TARGET if word in TARGETS else NOT if word in NEGATIONS else SAID if word in REPORTS else MENTION if word in MENTIONS else OTHER

    def symbols(self, text: str) -> list[int]:
        tokens, memory = _TOKEN.findall(text), self.memory
        for token in set(tokens).difference(memory):
            if len(memory) >= MEMORY:
                memory.clear()
                self.weights[len(SYMBOLS):] = []
                return self.symbols(text) if len(set(tokens)) < MEMORY else [self.symbol(t) for t in tokens]
            memory[token] = self.symbol(token)
        return [memory[t] for t in tokens]

    def clauses(self, text: str) -> tuple[list[float], int]:
        """The weights of the matched clauses of text, in order, and the number of its tokens."""
        row = self.symbols(text)
        if not row or max(row) < len(SYMBOLS):
            return [], len(row)
        out: list[float] = []
        scope, start = SCOPES.start, 0
        for end in [i for i, x in enumerate(row) if x in ENDS] + [len(row)]:
            clause = row[start:end]
            if max(clause, default=0) >= len(SYMBOLS):
                weight, scope = clause_weight([self.weights[x] for x in clause], scope)
                if weight:
                    out.append(weight)
            else:
                for x in clause:
                    scope = SCOPES.arcs[scope][x][0][0]
            if end < len(row):
                scope = SCOPES.arcs[scope][row[end]][0][0]
            start = end + 1
        return out, len(row)

    def chance(self, clauses: list[float], tokens: int) -> float:
        """The probability that a text of so many tokens with these matched clauses is toxic."""
        odds = self.slope * math.log1p(sum(clauses)) + self.length * math.log1p(tokens) + self.offset
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))


def _entries(word: str) -> list[str]:
    """The entries that cover a word: itself, marked by '=', and its stems."""
    return ["=" + word, *(word[:n] for n in STEMS if len(word) >= n)] if len(word) >= 3 else []


def learn_entries(texts: list[str], toxic: np.ndarray) -> tuple[dict[str, float], dict[str, float]]:
    """(words, stems) with their log odds: those in more toxic documents than chance allows, by the Chernoff
    bound on the binomial tail. Support is at most the number of distinct preceding words, so that copies
    of one document count about once."""
    cut = [re.findall(r"[^\W\d_]+", t.lower()) for t in texts]
    n1, n0 = int(toxic.sum()), int((1 - toxic).sum())
    if not n1 or not n0:
        return {}, {}
    bad: Counter = Counter()
    for words, y in zip(cut, toxic):
        if y:
            bad.update({e for w in set(words) for e in _entries(w)})
    share, needed = n1 / (n1 + n0), math.log(max(1, len(bad)) / CHANCE)
    bad = Counter({e: n for e, n in bad.items() if -n * math.log(share) > needed})
    clean: Counter = Counter()
    for words, y in zip(cut, toxic):
        if not y:
            clean.update({e for w in set(words) for e in _entries(w) if e in bad})

    def telling(n: int, e: str) -> bool:
        p = n / (n + clean[e])
        spare = (1 - p) * math.log((1 - p) / (1 - share)) if p < 1 else 0.0
        return p > share and (n + clean[e]) * (p * math.log(p / share) + spare) > needed

    odds = lambda e: math.log((bad[e] + 0.5) / (n1 + 1)) - math.log((clean[e] + 0.5) / (n0 + 1))
    found = {e for e, n in bad.items() if telling(n, e) and odds(e) >= LEAST_ODDS}
    before = defaultdict(set)
    for words, y in zip(cut, toxic):
        if y:
            for last, word in zip(["", *words], words):
                for e in _entries(word):
                    if e in found:
                        before[e].add(last)
    found = {e: min(6.0, odds(e)) for e in found if telling(min(bad[e], len(before[e])), e)}
    return {e[1:]: w for e, w in found.items() if e[0] == "="}, {e: w for e, w in found.items() if e[0] != "="}


def fit(texts: list[str], toxic) -> Grammar:
    """The grammar of at most TRAINING_ROWS labelled texts; with one class or none, only the fixed entries
    and default odds."""
    toxic = np.asarray(toxic, int)
    grammar = Grammar(*learn_entries(texts, toxic))
    if 0 < toxic.sum() < len(toxic):
        x = np.array([(math.log1p(sum(c)), math.log1p(n), 1.0) for c, n in map(grammar.clauses, texts)])
        prior = beta = np.array([grammar.slope, grammar.length, grammar.offset])
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(3)
            beta = beta - np.clip(np.linalg.solve(hessian, x.T @ (p - toxic) + 0.05 * (beta - prior)), -2, 2)
        grammar.slope, grammar.length, grammar.offset = map(float, beta)
    return grammar


def train(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1, bound: int = TRAINING_ROWS) -> Grammar:
    """Learns from at most bound labelled rows outside the held fold, in one task. Labels count as labelled_sample says; null and
    empty texts match nothing, long ones count whole; without rows of both labels the fixed entries and odds stand."""
    def learn(batches):
        rows = sorted((t, y) for batch in batches for t, y in zip(batch["text"], batch["label"]))
        g = fit([t for t, _ in rows], [y for _, y in rows])
        yield pd.DataFrame({"grammar": [pickle.dumps((g.words, g.stems, g.slope, g.length, g.offset))]})

    ship(docs.sparkSession)
    sample = labelled_sample(docs, labels, "toxic", modulus, held, bound)
    row = sample.repartition(1).mapInPandas(learn, "grammar binary").first()
    return Grammar(*pickle.loads(bytes(row["grammar"]))) if row else Grammar()


def score_toxicity(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """(doc_id, text_score, clauses array<double>) for each row of docs (doc_id, text). Null and empty texts
    match nothing and get the score of a text without matches; long texts are read whole; equal texts get
    equal scores, repeated rows each their own; an empty table gives no rows; other columns are not read."""
    parts = (grammar.words, grammar.stems, grammar.slope, grammar.length, grammar.offset)

    def make():
        g = Grammar(*parts)

        def run(ids: list, texts: list) -> tuple:
            found = [g.clauses(t) for t in texts]
            return ids, [g.chance(*f) for f in found], [clauses for clauses, _ in found]

        return run

    return map_columns(docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")), "doc_id long, text_score double, clauses array<double>", make)
