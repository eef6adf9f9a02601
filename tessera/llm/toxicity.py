"""Toxicity: Levenshtein automata run against a lexicon trie, hits scored in context windows.

The lexicon joins a fixed seed list with terms that labelled documents teach: whole words and stems that mark toxic
documents. A word is matched by running the automata of all terms at once over the trie of their letters, as a lazily
built deterministic automaton, so that misspelled terms are caught within one edit (two for long terms). A hit between an
opening quotation mark and its closing one, or after a verb of reporting, counts as quoted; other hits add up in windows of
words. Trees with monotonic constraints turn the sums into a score. Words, never labels, lang, source or doc_id, are inputs
of a score. At most `TERMS` terms are learned from at most `TERM_SAMPLE` labelled rows, the trees from at most `SAMPLE`
(the former rows among them), those with the smallest hashes of doc_id, fold 2 left out.
Contract of `score_documents`: one row per input row; null and empty texts get the score of a text without hits; ties
and repeated rows repeat; very long texts and words are read whole; without labels the seed list alone is known and the
prior is the score; an empty table gives no rows; other columns are dropped. A null doc_id is scored like any other and is
not held out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WORD, chunks, fold_of, span_hash, two, utf8, words_of
from tessera.llm.gbt import Forest, fit

SAMPLE, TERM_SAMPLE, TERMS, THRESHOLD, WINDOW = 20000, 8000, 2000, 0.3, 25
# The seed list of abusive words, verbs of reporting and words of address.
SEED = ("idiot", "stupid", "moron", "scum", "trash", "loser", "worthless", "pathetic", "disgusting", "clown", "imbecile", "bastard", "dumbass", "retard", "freak", "vermin", "filth", "coward")
REPORTING = frozenset(("said", "says", "quoted", "called", "wrote", "writes", "reported", "claimed", "sagte", "schrieb", "dit", "dijo"))
ADDRESS = frozenset(("you", "your", "you're", "youre", "u", "du", "dich", "tu", "vous", "usted"))
LEET = str.maketrans("013457@$", "oleastas")
EDGE = re.compile(r"^[^\w@$]+|[^\w@$]+$")
# Opening quotation marks with those that close them.
QUOTES = {'"': '"', "'": "'", "“": "”", "„": "“”", "‘": "’", "‚": "‘’", "«": "»", "»": "«"}
QUOTE_BYTES = np.zeros(256, np.int64)
QUOTE_BYTES[[0x22, 0x27, 0xC2, 0xE2]] = 1  # a quotation mark begins with one of these
FEATURES = ("log_exact", "exact_rate", "log_fuzzy", "fuzzy_rate", "log_stem", "stem_rate", "distinct", "window", "weight", "quoted_share", "addressed")
MONOTONE = [1, 1, 1, 1, 1, 1, 1, 1, 1, -1, 1]
EXACT, FUZZY, STEM = 1, 2, 3
KNOWN_WORDS = 500_000


def edits(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Lexicon:
    """Whole words (with edits) and stems (exact, as beginnings of words) in one trie; terms carry weights."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.words, self.stems, self._known = words, stems, {}
        self._child: list[dict[str, int]] = [{}]
        self._end: list[str | None] = [None]
        self._most = [0]
        for w in sorted(words):
            node = 0
            self._most[0] = max(self._most[0], edits(w))
            for ch in w:
                if ch not in self._child[node]:
                    self._child[node][ch] = len(self._child)
                    self._child.append({})
                    self._end.append(None)
                    self._most.append(0)
                node = self._child[node][ch]
                self._most[node] = max(self._most[node], edits(w))
            self._end[node] = w
        self._lengths = sorted({len(s) for s in stems}, reverse=True)
        self._longest = max((len(w) + edits(w) for w in words), default=0)
        self._reset()

    def _reset(self) -> None:
        self._states: dict[frozenset, int] = {}
        self._step: list[dict[str, int]] = []
        self._items: list[frozenset] = []
        self._accept: list[str | None] = []
        self._dead = self._state({})
        self._start = self._state({0: 0})

    def _state(self, items: dict[int, int]) -> int:
        """The number of a set of (trie node, edits spent); missing letters are spent at once."""
        todo = list(items)
        while todo:
            node = todo.pop()
            e = items[node] + 1
            for child in self._child[node].values():
                if e <= self._most[child] and e < items.get(child, 99):
                    items[child] = e
                    todo.append(child)
        key = frozenset(items.items())
        if key not in self._states:
            self._states[key] = len(self._items)
            self._items.append(key)
            self._step.append({})
            ends = sorted((e, self._end[n]) for n, e in key if self._end[n] and e <= edits(self._end[n]))
            self._accept.append(ends[0][1] if ends else None)
        return self._states[key]

    def _next(self, state: int, ch: str) -> int:
        out: dict[int, int] = {}
        for node, e in self._items[state]:
            moves = [(child, e + (c != ch)) for c, child in self._child[node].items()]
            moves.append((node, e + 1))
            for n, cost in moves:
                if cost <= self._most[n] and cost < out.get(n, 99):
                    out[n] = cost
        self._step[state][ch] = to = self._state(out)
        return to

    def fuzzy(self, word: str) -> str | None:
        """The nearest term within its edits."""
        state = self._start
        for ch in word:
            to = self._step[state].get(ch)
            state = self._next(state, ch) if to is None else to
            if state == self._dead:
                return None
        return self._accept[state]

    def match(self, raw: str) -> tuple[int, str] | None:
        """Kind and term of a word of a text."""
        word = EDGE.sub("", raw).lower()
        plain = word.translate(LEET)
        if word in self.words:
            return EXACT, word
        if plain in self.words:
            return EXACT, plain
        for n in self._lengths:
            if word[:n] in self.stems and len(word) >= n:
                return STEM, word[:n]
        if 3 < len(word) <= self._longest:  # longer ones are further from every term
            if len(self._items) > 50_000:
                self._reset()
            if term := self.fuzzy(plain) or (plain != word and self.fuzzy(word)):
                return FUZZY, term
        return None

    def known(self, words: list[bytes]) -> list[tuple[int, str] | None]:
        """Kind and term of each word; answers are kept."""
        known = self._known
        if len(known) > KNOWN_WORDS:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = self.match(w.decode())
        return [known[w] for w in words]


def quoted(marked: list[tuple[int, str]]) -> list[tuple[int, int]]:
    """First and last place of each quotation: words with marks and their places, in order. What is never closed is none."""
    found, close, start = [], "", 0
    for place, word in marked:
        core = EDGE.sub("", word)
        lead, tail = word.split(core, 1) if core else (word, word)
        for ch in lead:
            if ch in QUOTES and not (not core and ch in close):  # a mark by itself closes what is open
                close, start = QUOTES[ch], place
                if not core:
                    tail = ""
        if close and any(ch in close for ch in tail):
            found.append((start, place))
            close = ""
    return found


def features(texts: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """A row of FEATURES for each text."""
    raw, at = utf8(texts)
    out = np.zeros((len(at) - 1, len(FEATURES)))
    b, e, doc = words_of(raw, at)
    if not len(b):
        return out
    _, first, which = np.unique(span_hash(raw, b, e), return_index=True, return_inverse=True)
    data = raw.tobytes()
    found = lexicon.known([data[x:y] for x, y in zip(b[first].tolist(), e[first].tolist())])
    hits = np.flatnonzero(np.array([f is not None for f in found])[which])
    quotes = np.concatenate([[0], np.cumsum(QUOTE_BYTES[raw])])
    begins = np.searchsorted(doc, np.arange(len(at)))
    word = lambda i: data[b[i] : e[i]].decode()
    cuts = np.flatnonzero(np.diff(doc[hits], prepend=-1)).tolist()
    for low, high in zip(cuts, [*cuts[1:], len(hits)]):
        own = hits[low:high].tolist()
        i = int(doc[own[0]])
        start, n = int(begins[i]), int(begins[i + 1] - begins[i])
        marked = start + np.flatnonzero(quotes[e[start : start + n]] > quotes[b[start : start + n]])
        spans = quoted([(k, word(k)) for k in marked.tolist()])
        out[i] = _row([(k - start, *found[which[k]], [EDGE.sub("", word(j)).lower() for j in range(max(start, k - 4), k)], k) for k in own], n, spans, lexicon)
    return out


def _row(hits: list[tuple[int, int, str, list[str], int]], n: int, spans: list[tuple[int, int]], lexicon: Lexicon) -> list[float]:
    """hits: place, kind, term, the words before, place in the batch; spans: of quotations in the batch."""
    count, weight, said_, addressed, terms, places, at = [0, 0, 0, 0], 0.0, 0, 0, set(), [], 0
    for i, kind, term, near, place in hits:
        while at < len(spans) and spans[at][1] < place:
            at += 1
        said = at < len(spans) and spans[at][0] <= place or any(w in REPORTING for w in near)
        told = any(w in ADDRESS for w in near)
        said_, addressed = said_ + said, addressed + told
        count[kind] += 1
        terms.add(term)
        w = (lexicon.stems if kind == STEM else lexicon.words)[term] * (0.5 if kind == FUZZY else 1) * (0.3 if said else 1) * (1.5 if told else 1)
        weight += w
        places.append((i, w))
    best, total, first = 0.0, 0.0, 0
    for i, w in places:
        total += w
        while places[first][0] <= i - WINDOW:
            total -= places[first][1]
            first += 1
        best = max(best, total)
    e, f, s = count[EXACT], count[FUZZY], count[STEM]
    return [np.log1p(e), e / n, np.log1p(f), f / n, np.log1p(s), s / n, len(terms), best, weight, said_ / len(hits), addressed / len(hits)]


def _sampled(batches: Iterator[pa.RecordBatch], lexicon: Lexicon) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        x = features(batch.column("text"), lexicon)
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(list(x), pa.list_(pa.float64()))], ["toxic", "x"])


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        seen: dict[str, list[int]] = {}
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            own = {w for raw in set(WORD.findall(text or "")) if (w := EDGE.sub("", raw).lower()) and w.isalpha()}
            for term in {"w" + w for w in own} | {f"s{w[:n]}" for w in own for n in (4, 5, 6, 7) if len(w) >= n}:
                seen.setdefault(term, [0, 0])[toxic > 0] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen)), *(pa.array([v[k] for v in seen.values()], pa.int64()) for k in (0, 1))], ["term", "clean", "toxic"])


def _labelled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    one = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("double").alias("toxic")).where(fold_of(F.col("doc_id")) != 2)
    one = one.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return two(docs).join(F.broadcast(one), "doc_id").select("toxic", "text")


def learn_lexicon(docs: DataFrame, labels: DataFrame, sample: int = TERM_SAMPLE, most: int = TERMS) -> Lexicon:
    """Terms found in at least 4 toxic documents and far more often there than elsewhere, with log-odds as weights."""
    rows = _labelled(docs, labels, sample)
    size = rows.groupBy().agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("toxic")), F.lit(0.0)).alias("toxic")).first()
    p, n = size["toxic"], size["n"] - size["toxic"]
    odds = F.log((F.col("toxic") + 0.5) / (p + 1)) - F.log((F.col("clean") + 0.5) / (n + 1))
    found = rows.mapInArrow(_terms, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    found = found.where("toxic >= 4").withColumn("odds", F.round(odds, 6)).where("odds >= 3").orderBy(F.desc(F.col("odds") * F.sqrt("toxic")), "term").limit(most).collect()
    words = {w: 3.0 for w in SEED}
    stems: dict[str, float] = {}
    for r in sorted(found, key=lambda r: len(r["term"])):
        term = r["term"][1:]
        if r["term"][0] == "s":
            if not any(term[:k] in stems for k in range(4, len(term))):
                stems[term] = r["odds"]
    for r in found:
        if r["term"][0] == "w" and not any(r["term"][1 : 1 + k] in stems for k in range(4, 8)):
            words[r["term"][1:]] = r["odds"]
    # A stem that a seed word begins with adds nothing to it but would hide its misspellings' kind.
    return Lexicon(words, {s: w for s, w in stems.items() if not any(x.startswith(s) for x in words)})


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, term_sample: int = TERM_SAMPLE) -> tuple[Lexicon, Forest]:
    lexicon = learn_lexicon(docs, labels, term_sample)
    rows = _labelled(docs, labels, sample).mapInArrow(partial(_sampled, lexicon=lexicon), "toxic double, x array<double>").toPandas()
    x = np.array(rows["x"].tolist(), float).reshape(len(rows), len(FEATURES))
    y = (rows["toxic"].to_numpy(float) > 0).astype(float)
    order = np.lexsort((*x.T, y))
    return lexicon, fit(x[order], y[order], MONOTONE, trees=40, depth=3, leaf=5.0)


def _scored(batches: Iterator[pa.RecordBatch], lexicon: Lexicon, forest: Forest) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        p = np.round(forest.probability(features(batch.column("text"), lexicon)), 6)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, term_sample: int = TERM_SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted."""
    lexicon, forest = learn(docs, labels, sample, term_sample)
    d = two(docs).select("doc_id", F.coalesce(fold_of(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "text")
    return d.mapInArrow(partial(_scored, lexicon=lexicon, forest=forest), "doc_id long, held_out boolean, score double, predicted int")


def _filtered(batches: Iterator[pa.RecordBatch], lexicon: Lexicon, forest: Forest) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        yield batch.filter(pa.array(np.round(forest.probability(features(batch.column("text"), lexicon)), 6) < THRESHOLD))


def clean_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, term_sample: int = TERM_SAMPLE) -> DataFrame:
    """The rows of docs, all columns, whose text is not predicted toxic."""
    lexicon, forest = learn(docs, labels, sample, term_sample)
    return docs.mapInArrow(partial(_filtered, lexicon=lexicon, forest=forest), docs.schema)
