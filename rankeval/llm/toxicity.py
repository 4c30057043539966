"""Toxicity by a lexicon trie under Levenshtein automata, with scores of the words' surroundings (operator 13).

The lexicon is learnt: words and word beginnings that labelled toxic documents hold far more often than clean ones, beside a small
list of common insults.  Its trie is intersected with the terms' Levenshtein automata; the product is made deterministic state by
state as texts ask for it, so a word costs one look-up a letter and most words end after a few.  A hit weighs what labelled documents
say about its term, about this misspelling and about its surroundings: quoted and reported words speak for quotation, an addressed
reader for abuse.  A logistic model turns a document's hits into its score.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rankeval.sources.staging import stage

# --- fixed values: common insults, words that report speech, words that address someone ---
INSULTS = (
    "idiot moron stupid loser scum trash pathetic worthless disgusting clown imbecile dumbass bastard filth vermin "
    "dummkopf abschaum wichser schlampe vollidiot connard salaud ordure crétin débile gilipollas cabrón basura imbécil estúpido"
)
REPORTING = "said says wrote writes called calls quote quoted quotes term word words means meaning reported sagte schrieb nannte wort zitat dit écrit appelé mot dijo escribió llamó palabra"
ADDRESSING = "you your youre yourself u ur du dich dir ihr euch tu toi te vous ton tú te eres usted ustedes"
# --- end of fixed values ---

SIGNS = re.compile(r"[@$*!|]")
TOKEN = re.compile(r"[^\W_]+(?:[@$*!|][^\W_]+)*")
OPENING, CLOSING = "“«„", "”»"
AROUND = 6  # words on each side that score a hit
QUOTE_REACH = 300  # characters on each side, in the same line, where a quotation must begin and end
EXACT, LOOKALIKE, ONE_EDIT, TWO_EDITS = range(4)
#: Log-odds that stand for a class of misspelling, and for the parts of a hit's surroundings, before any label is seen.
CLASS_PRIOR = (3.0, 2.5, 1.0, 0.5)
QUOTED, REPORTED, ADDRESSED = 1, 2, 4
AROUND_PRIOR = {QUOTED: -1.5, REPORTED: -1.0, ADDRESSED: 0.5}
PRIOR_STRENGTH = 4.0  # documents that a prior counts for
SHORTEST, LONGEST = 3, 12  # letters of a word's beginning that may become a term


def lower(text: str) -> str:
    """In small letters, of the same length."""
    return text.replace("İ", "i").lower()


# --- the lexicon trie and its product with the Levenshtein automata ---


@dataclass(frozen=True)
class Term:
    """A whole word, or with ``stem`` the beginning of words."""

    text: str
    stem: bool = False

    @property
    def edits(self) -> int:
        """The edits that a misspelling may take: short terms none, as too much lies near them."""
        return int(len(self.text) >= (6 if self.stem else 5)) + int(len(self.text) >= 9 and not self.stem)


LOOKS = 2  # letters that may be repeated or given by a digit or sign, beside the edits


class Lexicon:
    """Finds the term next to a word.  ``find`` gives its place and its class of misspelling, None without one."""

    def __init__(self, terms: Iterable[Term], kept_words: int = 300_000, kept_steps: int = 200_000):
        self.terms, self.kept_words, self.kept_steps = list(terms), kept_words, kept_steps
        self.children: list[dict[str, int]] = [{}]
        self.letter, self.ends, self.reach = [""], [[]], [0]
        for i, term in enumerate(self.terms):
            node = 0
            self.reach[0] = max(self.reach[0], term.edits)
            for c in term.text:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.letter.append(c)
                    self.ends.append([])
                    self.reach.append(0)
                node = self.children[node][c]
                self.reach[node] = max(self.reach[node], term.edits)
            self.ends[node].append(i)
        self._restart()

    def __reduce__(self):
        return Lexicon, (self.terms, self.kept_words, self.kept_steps)

    def _restart(self) -> None:
        """Forget the states made so far; they come again as texts ask for them."""
        self.words: dict[str, tuple[int, int] | None] = {}
        self.states: dict[tuple, int] = {}
        self.members: list[tuple] = []
        self.steps: list[dict[str, int]] = []
        self.best: list[tuple] = []
        self.n_steps, self.start = 0, self._state({(0, 0, 0)})

    def _state(self, members: set[tuple[int, int, int]]) -> int:
        """The state of these (node, edits, looks), with all that skipping letters of a term adds; -1 for none."""
        found, todo = set(), list(members)
        while todo:
            m = todo.pop()
            if m in found:
                continue
            found.add(m)
            node, e, looks = m
            todo += [(c, e + 1, looks) for c in self.children[node].values() if e < self.reach[c]]
        by_node = defaultdict(list)
        for node, e, looks in found:
            by_node[node].append((e, looks))
        # what needs more edits and more looks than another way to the same node is of no use
        kept = tuple(sorted((n, e, k) for n, ways in by_node.items() for e, k in ways if not any((a, b) != (e, k) and a <= e and b <= k for a, b in ways)))
        if not kept:
            return -1
        if kept not in self.states:
            whole, stems = [], []
            for node, e, looks in kept:
                for i in self.ends[node]:
                    if e <= self.terms[i].edits:
                        (stems if self.terms[i].stem else whole).append((e, looks, -len(self.terms[i].text), i))
            self.states[kept] = len(self.members)
            self.members.append(kept)
            self.steps.append({})
            self.best.append((min(stems, default=None), min(whole, default=None)))
        return self.states[kept]

    def _step(self, state: int, char: str) -> int:
        out = set()
        sign = not char.isalpha()
        for node, e, looks in self.members[state]:
            for c, child in self.children[node].items():
                if c == char:
                    out.add((child, e, looks))
                    continue
                if sign and looks < LOOKS:
                    out.add((child, e, looks + 1))
                if e < self.reach[child]:
                    out.add((child, e + 1, looks))
            if node and char == self.letter[node] and looks < LOOKS:
                out.add((node, e, looks + 1))
            if e < self.reach[node]:
                out.add((node, e + 1, looks))
        after = self._state(out)
        self.steps[state][char] = after
        self.n_steps += 1
        return after

    def _search(self, word: str) -> tuple[int, int] | None:
        state, best = self.start, None
        for char in word:
            after = self.steps[state].get(char)
            state = self._step(state, char) if after is None else after
            if state < 0:
                break
            stem = self.best[state][0]
            if stem is not None and (best is None or stem < best):
                best = stem
        else:
            whole = self.best[state][1]
            if whole is not None and (best is None or whole < best):
                best = whole
        if best is None:
            return None
        edits, looks, _, term = best
        return term, EXACT if not edits and not looks else LOOKALIKE if not edits else ONE_EDIT if edits == 1 else TWO_EDITS

    def find(self, word: str) -> tuple[int, int] | None:
        if word in self.words:
            return self.words[word]
        if self.n_steps > self.kept_steps:
            self._restart()
        found = self._search(word)
        if found is None and len(parts := SIGNS.split(word)) > 1:  # words that a sign joins may be two
            found = min((f for part in parts if (f := self.find(part))), key=lambda f: f[1], default=None)
        if len(self.words) < self.kept_words:
            self.words[word] = found
        return found


# --- hits and their surroundings ---


@dataclass(frozen=True)
class Hit:
    start: int
    end: int
    term: int
    kind: int
    form: str
    around: int


_REPORTING, _ADDRESSING = frozenset(REPORTING.split()), frozenset(ADDRESSING.split())


def quoted(text: str, start: int, end: int) -> bool:
    """Whether a quotation in the same line opens before and closes after."""
    before = text[max(0, start - QUOTE_REACH) : start].rpartition("\n")[2]
    after = text[end : end + QUOTE_REACH].partition("\n")[0]
    if before.count('"') % 2 and '"' in after:
        return True
    opened, closed = max(map(before.rfind, OPENING)), max(map(before.rfind, CLOSING))
    return opened > closed and any(c in after for c in CLOSING + "“")


def hits(lexicon: Lexicon, text: str | None) -> tuple[list[Hit], int]:
    """All hits of a whole text, and its number of words; null counts as empty."""
    low = lower(text or "")
    words = TOKEN.findall(low)
    known = {w: f for w in set(words) if (f := lexicon.find(w)) is not None}
    if not known:
        return [], len(words)
    spans = [m.span() for m in TOKEN.finditer(low)]
    marks = [(REPORTED if w in _REPORTING else 0) | (ADDRESSED if w in _ADDRESSING else 0) for w in words]
    marked = [i for i, m in enumerate(marks) if m]
    out = []
    for i, w in enumerate(words):
        if w in known:
            (start, end), around = spans[i], 0
            for j in marked[bisect_left(marked, i - AROUND) : bisect_left(marked, i + AROUND + 1)]:
                around |= marks[j] if j != i else 0
            out.append(Hit(start, end, *known[w], w, around | (QUOTED if quoted(low, start, end) else 0)))
    return out, len(words)


# --- learning ---


def log_odds(toxic: float, clean: float, n_toxic: float, n_clean: float, prior: float = 0.0, strength: float = 1.0) -> float:
    """How much likelier toxic documents show something than clean ones do, drawn towards ``prior``."""
    base = n_toxic / max(1.0, n_toxic + n_clean)
    odds = math.exp(prior) * max(base, 1e-3) / max(1 - base, 1e-3)
    a, b = toxic + strength * odds / (1 + odds), clean + strength / (1 + odds)
    return math.log(a / b) - math.log(max(base, 1e-3) / max(1 - base, 1e-3))


def evidence(toxic: Column, clean: Column, n_toxic: int, n_clean: int) -> Column:
    """The likelihood ratio statistic (G squared) of a document count in toxic against clean documents."""
    n = float(n_toxic + n_clean)
    seen = toxic + clean
    part = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    return 2 * (
        part(toxic, seen * (n_toxic / n)) + part(clean, seen * (n_clean / n))
        + part(n_toxic - toxic, (n - seen) * (n_toxic / n)) + part(n_clean - clean, (n - seen) * (n_clean / n)))


def choose(rows: Iterable[tuple[str, bool, float]], max_terms: int) -> list[Term]:
    """Of (text, stem, evidence) the strongest that do not lie in one another: none whose beginning is taken as a stem, none that begins
    a taken term.  Of beginnings with equal evidence the longest is the term."""
    taken: list[Term] = []
    stems, begun = set(), set()
    for text, stem, _ in sorted(rows, key=lambda r: (-r[2], -len(r[0]), not r[1], r[0])):
        if len(taken) == max_terms:
            break
        if any(text[:n] in stems for n in range(1, len(text) + 1)) or text in begun:
            continue
        taken.append(Term(text, stem))
        begun.update(text[:n] for n in range(1, len(text) + 1))
        if stem:
            stems.add(text)
    return taken


def counted_forms(text: str | None) -> set[tuple[str, bool]]:
    """The words of a text and their beginnings, each once."""
    words = set(TOKEN.findall(lower(text or "")))
    out = {(w, False) for w in words if SHORTEST <= len(w) <= 4 * LONGEST}
    out.update((w[:n], True) for w in words for n in range(SHORTEST, min(len(w), LONGEST) + 1))
    return out


@dataclass
class Weights:
    """What labelled documents say about hits: document counts of (term), (form, kind) and (kind, surroundings)."""

    n: np.ndarray
    terms: dict = field(default_factory=dict)
    forms: dict = field(default_factory=dict)
    kinds: dict = field(default_factory=dict)
    around: dict = field(default_factory=dict)
    cached: dict = field(default_factory=dict, repr=False)

    def of(self, term: int, kind: int, form: str, around: int) -> float:
        """The weight of a hit; 0 is as good as no hit."""
        key = (term, kind, form, around)
        if key not in self.cached:
            self.cached[key] = self._of(*key)
        return self.cached[key]

    def _of(self, term: int, kind: int, form: str, around: int) -> float:
        n1, n0 = self.n[1], self.n[0]
        base = log_odds(*self.terms.get(term, (0, 0)), n1, n0, CLASS_PRIOR[EXACT], PRIOR_STRENGTH)
        if kind != EXACT:  # a misspelling counts by what is known of its kind, then by what is known of itself
            prior = log_odds(*self.kinds.get(kind, (0, 0)), n1, n0, CLASS_PRIOR[kind], PRIOR_STRENGTH)
            base = min(base, log_odds(*self.forms.get(form, (0, 0)), n1, n0, prior, PRIOR_STRENGTH))
        if around:
            prior = sum(v for k, v in AROUND_PRIOR.items() if around & k)
            plain = log_odds(*self.around.get(0, (0, 0)), n1, n0, 0.0, PRIOR_STRENGTH)
            base += log_odds(*self.around.get(around, (0, 0)), n1, n0, plain + prior, PRIOR_STRENGTH) - plain
        return base


FEATURES = 5


def features(weights: Weights, found: Iterable[tuple[int, int, str, int, int]], n_words: int) -> list[float]:
    """Of a document's hits as (term, kind, form, around, times): the strongest, their sum, their density, the terms hit."""
    each = [(max(0.0, weights.of(*h[:4])), h[0], h[4]) for h in found]
    total = sum(w * n for w, _, n in each)
    strong = [w for w, _, _ in each if w > 1]
    return [1.0, max((w for w, _, _ in each), default=0.0), math.log1p(total), min(10.0, 100 * total / max(20, n_words)), math.log1p(len({t for w, t, _ in each if w > 1})) if strong else 0.0]


#: The score's coefficients where labels are missing.
DEFAULT = np.array([-3.0, 1.0, 0.5, 0.1, 0.5])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> np.ndarray:
    """Coefficients by Newton steps, drawn towards those of ``DEFAULT``."""
    beta = DEFAULT.copy()
    if len(np.unique(y)) < 2:
        return beta
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (y - p) - ridge * (beta - DEFAULT)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta)), gradient)
        beta = beta + step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return beta


@dataclass
class Model:
    lexicon: Lexicon
    weights: Weights
    beta: np.ndarray

    def find(self, text: str | None) -> tuple[list[tuple[Hit, float]], float]:
        """The hits of a whole text with their weights, and its score."""
        found, n_words = hits(self.lexicon, text)
        times = Counter((h.term, h.kind, h.form, h.around) for h in found)
        x = np.array(features(self.weights, ((*k, n) for k, n in times.items()), n_words))
        if len(self.weights.cached) > 200_000:
            self.weights.cached.clear()
        weighed = [(h, self.weights.of(h.term, h.kind, h.form, h.around)) for h in found]
        return weighed, float(1 / (1 + np.exp(-np.clip(x @ self.beta, -30, 30))))


def held_out(id_col: Column) -> Column:
    """Rows never learnt from: CRC-32 of the id as text is divisible by 5 (a null id as empty text)."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _sample(docs: DataFrame, labels: DataFrame, max_rows: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """``t``, ``y``, ``fold`` of at most ``max_rows`` labels that may be learnt from, those with the smallest hash of their id, staged."""
    doc = F.col(id_col).cast("long").alias("labelled")
    known = labels.select(doc, F.col(label_col).cast("int").alias("y")).where(F.col("y").isNotNull() & ~held_out(F.col("labelled")))
    known = known.join(docs.select(doc), "labelled", "left_semi")
    sample = known.orderBy(F.xxhash64("labelled"), "labelled", "y").limit(max_rows).toArrow()  # pairs of numbers, at most max_rows
    texts = docs.select(doc, F.col(text_col).alias("t")).join(F.broadcast(docs.sparkSession.createDataFrame(sample)), "labelled")
    return stage(texts.select("t", (F.col("y") == 1).cast("int").alias("y"), F.pmod(F.xxhash64("labelled", F.lit("fold")), F.lit(2)).cast("int").alias("fold")))


def _term_counts(sample: DataFrame) -> DataFrame:
    """Documents of each fold and label that hold a word or beginning."""
    schema = "form string, stem boolean, fold int, y int, n long"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(counts: Counter) -> pa.RecordBatch:
            form, stem, fold, y = zip(*counts) if counts else ((), (), (), ())
            kinds = (pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.int64())
            columns = [pa.array(c, k) for c, k in zip((form, stem, fold, y, list(counts.values())), kinds)]
            return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

        counts: Counter = Counter()
        for batch in batches:
            for i, (y, fold) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                counts.update((*f, fold, y) for f in counted_forms(batch.column(0)[i].as_py()))
                if len(counts) > 300_000:
                    yield out(counts)
                    counts = Counter()
        yield out(counts)

    # few partitions, so that most of the counting is done before the shuffle
    found = sample.mapInArrow(task, schema)
    one = lambda fold, y: F.sum(F.when((F.col("fold") == fold) & (F.col("y") == y), F.col("n")).otherwise(0))
    return found.groupBy("form", "stem").agg(*(one(f, y).alias(f"n{f}{y}") for f in (0, 1) for y in (0, 1)))


def _lexicons(sample: DataFrame, sizes: dict, max_terms: int, least: float, support: int) -> list[Lexicon]:
    """Lexicons from fold 0, fold 1 and both."""
    counts = stage(_term_counts(sample).where(F.col("n01") + F.col("n11") >= support))
    given = [Term(w) for w in INSULTS.split()]
    out = []
    for folds in ((0,), (1,), (0, 1)):
        n = [sum(sizes.get((f, y), 0) for f in folds) for y in (0, 1)]
        found = []
        if all(n):
            clean, toxic = (sum((F.col(f"n{f}{y}") for f in folds[1:]), F.col(f"n{folds[0]}{y}")).cast("double") for y in (0, 1))
            scored = counts.select("form", "stem", toxic.alias("a"), clean.alias("b")).withColumn("g", evidence(F.col("a"), F.col("b"), n[1], n[0]))
            # at least ten times likelier in toxic documents
            scored = scored.where((F.col("a") >= support) & (F.col("g") >= least) & (F.col("a") * n[0] >= 10 * F.col("b") * n[1]))
            best = scored.orderBy(F.desc("g"), F.desc(F.length("form")), "form", "stem").limit(16 * max_terms).collect()
            found = choose([(r["form"], r["stem"], r["g"]) for r in best], max_terms)
        stems = {t.text for t in found if t.stem}
        own = {t.text for t in found}
        out.append(Lexicon(found + [t for t in given if t.text not in own and not any(t.text[:i] in stems for i in range(len(t.text)))]))
    return out


def _count(weights: Weights, y: int, found: list[dict]) -> None:
    """Add a document to the counts, each thing once."""
    def add(table: dict, key) -> None:
        table.setdefault(key, np.zeros(2))[1 - y] += 1  # (toxic, clean)

    for term in {h["term"] for h in found if h["kind"] == EXACT}:
        add(weights.terms, term)
    for form, kind in {(h["form"], h["kind"]) for h in found if h["kind"] != EXACT}:
        add(weights.forms, form)
        add(weights.kinds, kind)
    for around in {h["around"] for h in found if h["kind"] == EXACT}:
        add(weights.around, around)


def learn(
    docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, max_terms: int = 512, least: float = 24.0, support: int = 3,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
) -> Model:
    """Fit on at most ``max_rows`` labels of documents that are not held out.

    Terms need ``support`` toxic documents and a G squared of ``least``.  The coefficients are fitted on what lexicons and weights from one
    half of the documents find in the other, the lexicon and weights that are returned on all.  Null labels and labels of other
    documents are left out; without labels the fixed insults and the priors remain.
    """
    sample = _sample(docs, labels, max_rows, id_col, text_col, label_col)
    sizes = {(r["fold"], r["y"]): r["count"] for r in sample.groupBy("fold", "y").count().collect()}
    lexicons = _lexicons(sample, sizes, max_terms, least, support)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.list_(pa.struct([("term", pa.int32()), ("kind", pa.int32()), ("form", pa.string()), ("around", pa.int32()), ("times", pa.int32())]))
        names = ["term", "kind", "form", "around", "times"]

        def grouped(found: list[Hit]) -> list[dict]:
            times = Counter((h.term, h.kind, h.form, h.around) for h in found)
            return [dict(zip(names, (*k, n))) for k, n in times.items()]

        for batch in batches:
            own, other, words = [], [], []
            for i, fold in enumerate(batch.column(2).to_pylist()):
                text = batch.column(0)[i].as_py()
                found, n = hits(lexicons[2], text)
                own.append(grouped(found))
                other.append([grouped(hits(lexicons[f], text)[0]) for f in (0, 1)])
                words.append(n)
            columns = [batch.column(1), batch.column(2), pa.array(words, pa.int64()), pa.array(own, kinds)]
            columns += [pa.array([o[f] for o in other], kinds) for f in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, names=["y", "fold", "n_words", "whole", "by0", "by1"])

    struct = "array<struct<term:int,kind:int,form:string,around:int,times:int>>"
    seen = sample.mapInArrow(task, f"y int, fold int, n_words long, whole {struct}, by0 {struct}, by1 {struct}")
    rows = seen.collect()  # the distinct hits of at most max_rows documents
    weights = [Weights(np.array([sum(sizes.get((f, y), 0) for f in folds) for y in (0, 1)], float)) for folds in ((0,), (1,), (0, 1))]
    for r in rows:
        _count(weights[2], r["y"], r["whole"])
        _count(weights[r["fold"]], r["y"], r[f"by{r['fold']}"])
    # each document as the other half sees it
    x = np.array([features(weights[1 - r["fold"]], [tuple(h) for h in r[f"by{1 - r['fold']}"]], r["n_words"]) for r in rows]).reshape(-1, FEATURES)
    return Model(lexicons[2], weights[2], logistic(x, np.array([r["y"] for r in rows], float)))


SCORED = "doc_id long, score double, n_hits int, spans string"


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``score``, ``n_hits`` and ``spans`` (``term:start:end`` of the hits of weight above 1, comma-joined, code points, end
    exclusive) of every whole text."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, counts, spans = [], [], []
            for text in batch.column(1):
                weighed, s = model.find(text.as_py())
                strong = [h for h, w in weighed if w > 1]
                scores.append(s)
                counts.append(len(strong))
                spans.append(",".join(f"{model.lexicon.terms[h.term].text}:{h.start}:{h.end}" for h in strong))
            columns = [batch.column(0), pa.array(scores, pa.float64()), pa.array(counts, pa.int32()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SCORED.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(task, SCORED)


def classify(
    docs: DataFrame, labels: DataFrame, least_score: float = 0.5, max_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted``, ``n_hits`` and ``spans`` of every row of ``docs``, from its text alone.

    Null and empty texts have no hits and are scored like any text without; repeated rows are scored alike; an empty table gives no row.
    """
    scored = score(docs, learn(docs, labels, max_rows, id_col=id_col, text_col=text_col), id_col, text_col)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= least_score).cast("int").alias("predicted"), "n_hits", "spans")
