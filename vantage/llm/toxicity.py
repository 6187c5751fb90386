"""Toxicity by a weighted finite-state pattern grammar over clauses (operator 4).

A clause is read as a sequence of symbols (insult, threat, target, negation, reporting verb, quote,
other word).  Three weighted transducers are composed over it into one machine: negation marks insults and
threats in its scope, reported speech marks what stands in quotes or after a reporting verb, and the pattern
acceptor picks one insult or threat on each of its paths and weighs it by its marks and by the targets of the
clause.  A clause's weight is the sum over all accepting paths.  Quotes may span clauses; they end with
their line.  The lexicon holds stems of insults and threats, since they inflect; their weights are log-odds
learnt from labelled documents, and a logistic model over the clause weights of a document gives its score.
Text alone enters a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import query
from .store import crc_fold, materialise, table

#: Labelled rows the lexicon and the logistic model are fitted on; all rows are scored.
MAX_TRAINING_ROWS = 8_000
#: Letters of a stem.
STEM_LENGTHS = range(3, 11)
#: A learnt stem stands in at least this share of the toxic training documents, and in five.
MIN_SHARE, MIN_DOCS = 0.02, 5
#: Its log-odds are over this by two standard errors.
MIN_LOG_ODDS = 1.5
MAX_LEXICON = 400

#: Stems of threats; one that too few training documents hold has the weight THREAT_WEIGHT.
THREATS = ("kill", "hurt", "destroy", "burn", "beat", "punish", "murder", "töte", "umbring", "umgebracht", "schlag", "tuer", "frapp", "matar",
           "golpe")
THREAT_WEIGHT = 1.0
TARGETS = ("you", "your", "he", "she", "they", "them", "him", "her", "people", "du", "dich", "ihr", "sie", "euch", "tu", "te", "toi",
           "vous", "eux", "tú", "usted", "ustedes", "ellos", "él", "ella")
NEGATIONS = ("not", "never", "no", "nobody", "isn", "aren", "don", "nicht", "kein", "keine", "nie", "pas", "jamais", "aucun", "nunca",
             "ningún")
REPORTS = ("said", "says", "called", "calls", "wrote", "claimed", "quoted", "reported", "sagte", "nannte", "schrieb", "dit", "écrit",
           "appelé", "dijo", "escribió", "llamó")
QUOTES = frozenset("\"“”„«»")
#: Words a negation reaches.
NEGATION_REACH = 3
#: Shares of a weight that stay in negated and in reported speech, and the factors of a target.
NEGATED, REPORTED, TARGETED = 0.3, 0.5, 1.3

#: The logistic weights where nothing can be learnt: low scores that rise with the weights of clauses.
UNLEARNT = np.array([-3.0, 1.0, 1.0, 0.0])

_CLAUSE = re.compile(r"[^.!?;\n]+")
_TOKEN = re.compile(r"[^\W\d_]+|[\"“”„«»]")


HITS = ("insult", "threat")
PLAIN = ("target", "negation", "report", "quote", "other")


@dataclass
class Transducer:
    """A weighted finite-state transducer: arcs (state, symbol) -> [(output, weight, next state)], and final weights."""

    start: tuple
    arcs: dict = field(default_factory=lambda: defaultdict(list))
    finals: dict = field(default_factory=dict)

    def add(self, state, symbol, output, to, weight: float = 1.0) -> None:
        self.arcs[state, symbol].append((output, weight, to))

    def compose(self, other: Transducer, symbols, starts) -> Transducer:
        """The machine that feeds this one's output to ``other``, as far as ``starts`` (pairs of states) reach by ``symbols``."""
        out, todo, seen = Transducer(starts[0]), list(starts), set(starts)
        while todo:
            state = todo.pop()
            mine, theirs = state
            if mine in self.finals and theirs in other.finals:
                out.finals[state] = self.finals[mine] * other.finals[theirs]
            for symbol in symbols:
                for middle, w, to in self.arcs.get((mine, symbol), ()):
                    for output, v, end in other.arcs.get((theirs, middle), ()):
                        out.add(state, symbol, output, (to, end), w * v)
                        if (to, end) not in seen:
                            seen.add((to, end))
                            todo.append((to, end))
        return out

    def total(self, read, start=None) -> float:
        """The summed weight of all accepting paths over ``read`` (symbol, weight of a pick)."""
        mass = {self.start if start is None else start: 1.0}
        for symbol, weight in read:
            after: dict = {}
            for state, m in mass.items():
                for output, w, to in self.arcs.get((state, symbol), ()):
                    after[to] = after.get(to, 0.0) + m * w * (weight if output == "pick" else 1.0)
            mass = after
        return sum(m * self.finals.get(state, 0.0) for state, m in mass.items())


def negation_transducer() -> Transducer:
    """States: words that the last negation still reaches.  Hits within reach get the mark n; quotes take up no reach."""
    t = Transducer(0)
    for left in range(NEGATION_REACH + 1):
        t.finals[left] = 1.0
        for symbol in (*HITS, *PLAIN):
            to = NEGATION_REACH if symbol == "negation" else left if symbol == "quote" else max(left - 1, 0)
            t.add(left, symbol, symbol + "-n" if left and symbol in HITS else symbol, to)
    return t


def speech_transducer() -> Transducer:
    """States: (in quotes, behind a reporting verb).  Hits in either get the mark r."""
    t = Transducer((False, False))
    for quoted in (False, True):
        for reported in (False, True):
            state = quoted, reported
            t.finals[state] = 1.0
            for symbol in PLAIN:
                t.add(state, symbol, symbol, (quoted != (symbol == "quote"), reported or symbol == "report"))
            for hit in HITS:
                for mark in ("", "-n"):
                    t.add(state, hit + mark, hit + mark + ("-r" if quoted or reported else ""), state)
    return t


def pattern_acceptor() -> Transducer:
    """States: (kind picked, target seen, insult seen).  Accepts a picked insult, and a picked threat with a target or an insult."""
    t = Transducer((None, False, False))
    for picked in (None, *HITS):
        for target in (False, True):
            for insult in (False, True):
                state = picked, target, insult
                if picked == "insult" or (picked == "threat" and (target or insult)):
                    t.finals[state] = TARGETED if target else 1.0
                for symbol in PLAIN:
                    t.add(state, symbol, "pass", (picked, target or symbol == "target", insult))
                for hit in HITS:
                    for marks in ("", "-n", "-r", "-n-r"):
                        seen = insult or hit == "insult"
                        t.add(state, hit + marks, "pass", (picked, target, seen))
                        if picked is None:
                            t.add(state, hit + marks, "pick", (hit, target, seen),
                                  (NEGATED if "-n" in marks else 1.0) * (REPORTED if "-r" in marks else 1.0))
    return t


@lru_cache(maxsize=1)
def clause_machine() -> tuple[Transducer, dict[bool, tuple]]:
    """The composition of the three, and its start states outside and inside quotes."""
    symbols = (*HITS, *PLAIN)
    negation, speech, pattern = negation_transducer(), speech_transducer(), pattern_acceptor()
    inner = speech.compose(pattern, (*symbols, *(h + "-n" for h in HITS)), [((q, False), pattern.start) for q in (False, True)])
    starts = {q: (negation.start, ((q, False), pattern.start)) for q in (False, True)}
    return negation.compose(inner, symbols, list(starts.values())), starts


@dataclass
class Grammar:
    """The lexicon transducer; ``clause_machine`` reads its output."""

    insults: dict[str, float]
    threats: dict[str, float] = field(default_factory=lambda: dict.fromkeys(THREATS, THREAT_WEIGHT))
    symbols: dict[str, str] = field(init=False)

    def __post_init__(self):
        self.symbols = {w: s for s, words in (("target", TARGETS), ("negation", NEGATIONS), ("report", REPORTS)) for w in words}

    @cached_property
    def automaton(self):
        a = ahocorasick.Automaton()
        for w in (*self.threats, *self.insults):
            a.add_word(w, len(w))
        a.make_automaton()
        return a

    def read(self, word: str) -> tuple[str, float]:
        """The lexicon transducer: a word's symbol and weight, those of hits by their heaviest stem."""
        if word in QUOTES:
            return "quote", 0.0
        for symbol, stems in (("insult", self.insults), ("threat", self.threats)):
            weight = max((stems.get(word[:k], 0.0) for k in STEM_LENGTHS if k <= len(word)), default=0.0)
            if weight:
                return symbol, weight
        return self.symbols.get(word, "other"), 0.0

    def clause_weight(self, clause: str, quoted: bool = False) -> float:
        """The weight of a clause in lower case that begins in quotes or not."""
        machine, starts = clause_machine()
        return machine.total(map(self.read, _TOKEN.findall(clause)), starts[quoted])

    def features(self, text: str) -> tuple[float, float, int, int]:
        """(largest clause weight, sum of them, matched clauses, characters); clauses without a hit weigh nothing."""
        low = text.lower()
        hits = [end for end, size in self.automaton.iter(low) if end < size or not low[end - size].isalpha()]
        if not hits:
            return 0.0, 0.0, 0, len(text)
        top, total, n, k = 0.0, 0.0, 0, 0
        at, quoted = 0, False
        for m in _CLAUSE.finditer(low):
            if k >= len(hits):
                break
            if hits[k] < m.end():
                while k < len(hits) and hits[k] < m.end():
                    k += 1
                # Quotes opened in the clauses since the last one with a hit; a line break ends them.
                line = low.rfind("\n", at, m.start())
                if line >= 0:
                    at, quoted = line, False
                quoted ^= sum(low.count(q, at, m.start()) for q in QUOTES) % 2 == 1
                at = m.start()
                w = self.clause_weight(m[0], quoted)
                if w:
                    top, total, n = max(top, w), total + w, n + 1
        return top, total, n, len(text)


def _inputs(top, total, n, chars) -> np.ndarray:
    """Inputs of the logistic model; the last is the weight per thousand characters, as chance hits come with length."""
    top, total, chars = (np.asarray(x, float) for x in (top, total, chars))
    return np.column_stack((np.ones(len(top)), np.log1p(top), np.log1p(total), np.log1p(1000 * total / (chars + 200))))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 50) -> np.ndarray:
    """Newton's method with a small ridge, which keeps separable data finite."""
    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(keep)
        step = np.linalg.solve(h, x.T @ (y - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class Model:
    grammar: Grammar
    weights: np.ndarray

    def scores(self, texts: list[str]) -> tuple[np.ndarray, list]:
        f = [self.grammar.features(t) for t in texts]
        return 1 / (1 + np.exp(-np.clip(_inputs(*zip(*f, strict=True)) @ self.weights, -30, 30))), f


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """(text, toxic): at most ``max_rows`` labelled documents outside the held-out fold, by hash order.

    The chosen ids, at most ``max_rows`` of them, are broadcast; equal texts count once.
    """
    known = (labels.where("doc_id is not null and toxic in (0, 1)").where(crc_fold() != 0)
             .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic")))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    return (docs.join(F.broadcast(chosen), "doc_id").where("text is not null")
            .groupBy(F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).drop("h"))


def _stem_counts(batches):
    """Rows (stem, a, c): toxic and all documents of a partition that have a word with the stem."""
    a, c = Counter(), Counter()
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = {w[:k] for w in set(_TOKEN.findall(text.lower())) for k in STEM_LENGTHS if k <= len(w)}
            c.update(own)
            if toxic:
                a.update(own)
    stems = list(c)
    for at in range(0, len(stems), 50_000):
        some = stems[at:at + 50_000]
        yield pa.record_batch([pa.array(some, pa.string()), pa.array([a[s] for s in some], pa.int64()), pa.array([c[s] for s in some], pa.int64())],
                              names=["stem", "a", "c"])


def learn_lexicon(rows: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """(insults, threats): word stems with their log-odds for toxic documents.

    Insults are the stems whose log-odds are surely high.  Threats are THREATS with the lower bound of their log-odds, none
    below 0, and with THREAT_WEIGHT where fewer than MIN_DOCS documents hold the stem.
    """
    threats = dict.fromkeys(THREATS, THREAT_WEIGHT)
    totals = rows.agg(F.sum("toxic").alias("p"), F.count("*").alias("n")).first()
    pos, neg = int(totals.p or 0), int(totals.n) - int(totals.p or 0)
    if not pos or not neg:
        return {}, threats
    is_threat = F.col("stem").isin(*THREATS)
    counts = rows.select("text", "toxic").mapInArrow(_stem_counts, "stem string, a long, c long").groupBy("stem").agg(
        F.sum("a").alias("a"), F.sum("c").alias("c")).where(is_threat | (F.col("a") >= max(MIN_DOCS, math.ceil(MIN_SHARE * pos))))
    a, b = F.col("a") + 0.5, F.col("c") - F.col("a") + 0.5
    odds = F.log(a / (pos - F.col("a") + 0.5)) - F.log(b / (neg - F.col("c") + F.col("a") + 0.5))
    rated = counts.select("stem", "a", "c", odds.alias("w"), (odds - 2 * F.sqrt(1 / a + 1 / b)).alias("low"))
    for r in rated.where(is_threat & (F.col("c") >= MIN_DOCS)).collect():
        threats[r.stem] = max(0.0, float(r.low))
    sure = rated.where(~is_threat & (F.col("low") > MIN_LOG_ODDS))
    found = {r.stem: r for r in sure.orderBy(F.desc("low"), "stem").limit(10 * MAX_LEXICON).collect()}
    best: list[str] = []
    # The surest of a chain of stems stands for it; of equally sure ones the longest.
    for s in sorted(found, key=lambda s: (-round(found[s].low, 2), -len(s), s)):
        if len(best) < MAX_LEXICON and not any(s.startswith(t) or t.startswith(s) for t in best):
            best.append(s)
    return {s: float(found[s].w) for s in best}, threats


def _feature_rows(grammar):
    schema = pa.schema([("top", pa.float64()), ("total", pa.float64()), ("n", pa.int64()), ("chars", pa.int64()), ("toxic", pa.int32())])

    def run(batches):
        for batch in batches:
            f = [grammar.value.features(t) for t in batch.column(0).to_pylist()]
            yield pa.record_batch([*(pa.array([x[i] for x in f], schema.field(i).type) for i in range(4)), batch.column(1)], schema=schema)

    return run


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> Model:
    """The grammar and the logistic weights; without labels of both kinds the threats of the grammar alone raise a score."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = materialise(training_rows(docs, labels, max_rows))
    grammar = Grammar(*learn_lexicon(rows))
    if not grammar.insults:
        return Model(grammar, UNLEARNT)
    held = rows.sparkSession.sparkContext.broadcast(grammar)
    got = rows.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(
        _feature_rows(held), "top double, total double, n long, chars long, toxic int").toPandas()
    x, y = _inputs(got["top"], got["total"], got["n"], got["chars"]), got["toxic"].to_numpy(float)
    return Model(grammar, fit_logistic(x, y))


def _score(model):
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("clauses", pa.int64()), ("top_clause", pa.float64())])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                scores, f = model.value.scores([t or "" for t in some.column(1).to_pylist()])
                yield pa.record_batch([some.column(0), pa.array(scores), pa.array([x[2] for x in f], pa.int64()),
                                       pa.array([x[0] for x in f], pa.float64())], schema=schema)

    return run


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted, clauses, top_clause) per row of ``docs`` (doc_id long, text string).

    ``score`` in [0, 1] rises with the chance of label 1; ``predicted`` is 1 from 0.5 on.  Null and empty
    texts have no matched clause and the model's lowest score; whole texts are read whatever their length;
    a null doc_id is carried along; repeated rows give repeated rows; other columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(
        _score(held), "doc_id long, score double, clauses long, top_clause double")
    return scored.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "clauses", "top_clause")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` (all columns) whose text scores under 0.5."""
    held, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                some = batch.slice(lo, 1024)
                scores, _ = held.value.scores([t or "" for t in some.column(at).to_pylist()])
                yield some.filter(pa.array(scores < 0.5))

    return docs.mapInArrow(run, docs.schema)


@query("op4_toxicity_grammar")
def op4_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return score_toxicity(docs, model).select("doc_id", (crc_fold() == 0).alias("held_out"), "score", "predicted", "clauses", "top_clause")
