"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols: insult (with a weight), threat, target, negation, reported
speech, clause end, or nothing of note. Four small transducers read the symbols of
a clause and each multiplies the weight of an insult or threat that it emits:

* target: more beside a person or a pointing word, and a threat counts little without one;
* negation: less shortly after a negation;
* reported speech: less after a verb of saying, to the end of the clause;
* insult / threat: the emitting machine.

``compose`` builds their product once; a document's score comes from the weights of
its matched clauses, put on a 0-1 scale by a logistic fit. The insult lexicon is
learned from labelled documents as whole words and word beginnings.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .learning import fit_logistic, sigmoid
from .storage import saved
from .tokens import mix, shingles, word_chunks, word_hash

#: Word beginnings that may enter the lexicon, in bytes.
BEGINNINGS = (4, 5, 6, 8)
INSULT, THREAT, TARGET, NEGATION, REPORT, END = range(1, 7)
SEEDS = {
    THREAT: "kill kills killed killing hurt hurts destroy destroys destroyed shoot shoots shot stab stabs stabbed strangle strangles strangled "
    "töten tötet tötete umbringen umbringt verprügeln verprügelt tuer tue tué frapper frappe frappé matar mata mató golpear golpea golpeó",
    TARGET: "you your yours he she they them this these that those du dich ihr euch sie dieser diese tu te toi vous cette ces ce tú usted ustedes este esta estos",
    NEGATION: "not no never none nobody neither nicht kein keine nie pas jamais aucun nunca jamás ninguno",
    REPORT: "said says wrote writes called quoted claimed sagte schrieb nannte dit écrit appelé dijo escribió llamó",
}
_APART = np.ones(256, dtype=bool)
_APART[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_CLAUSE = np.zeros(256, dtype=bool)
_CLAUSE[list(b".!?;:\n")] = True


def _near(symbol: int, reach: int, after: float) -> list[dict]:
    """A transducer that multiplies by ``after`` within ``reach`` words behind ``symbol``."""
    states = [{"then": {symbol: reach}, "other": max(0, s - 1), "factor": after if s else 1.0} for s in range(reach + 1)]
    return states


def compose() -> tuple[np.ndarray, np.ndarray]:
    """(next state, factor) by state and symbol of the product of the transducers;
    state 0 is the start. Symbol 0 is any other word."""
    machines = {"target": _near(TARGET, 4, 1.5), "negation": _near(NEGATION, 3, 0.6)}
    said = [{"then": {REPORT: 1}, "other": 0, "factor": 1.0}, {"then": {}, "other": 1, "factor": 0.7}]
    parts = [machines["target"], machines["negation"], said]
    states = list(product(*(range(len(m)) for m in parts)))
    number = {s: i for i, s in enumerate(states)}
    move, factor = np.zeros((len(states), 7), np.int64), np.zeros((len(states), 7))
    for s in states:
        for symbol in range(7):
            to = (0, 0, 0) if symbol == END else tuple(m[q]["then"].get(symbol, m[q]["other"]) for m, q in zip(parts, s, strict=True))
            move[number[s], symbol] = number[to]
            if symbol in (INSULT, THREAT):
                alone = 0.3 if symbol == THREAT and s[0] == 0 else 1.0
                factor[number[s], symbol] = alone * np.prod([m[q]["factor"] for m, q in zip(parts, s, strict=True)])
    return move, factor


@dataclass
class Grammar:
    """The learned lexicon (sorted hashes and weights), the composed machine and the
    logistic weights of (largest clause, all clauses, intercept)."""

    entries: np.ndarray
    weights: np.ndarray
    move: np.ndarray
    factor: np.ndarray
    scale: np.ndarray

    def __post_init__(self):
        found = {word_hash(w, _APART): symbol for symbol, words in SEEDS.items() for w in words.split()}
        self.seeds = np.array(sorted(found), np.uint64)
        self.symbols = np.array([found[int(h)] for h in self.seeds], np.int64)

    def clauses(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By row: the weight of its heaviest matched clause, of all, and their number."""
        best, total, matched = np.zeros(len(column)), np.zeros(len(column)), np.zeros(len(column), np.int64)
        for lo, _, data, offsets, words in word_chunks(column, prefixes=BEGINNINGS, between=_APART):
            if not len(words.hashes):
                continue
            weight = np.zeros(len(words.hashes))
            for hashes in (words.hashes, *words.prefix_hashes):
                at = np.minimum(np.searchsorted(self.entries, hashes), len(self.entries) - 1)
                weight = np.maximum(weight, np.where(self.entries[at] == hashes, self.weights[at], 0.0)) if len(self.entries) else weight
            at = np.minimum(np.searchsorted(self.seeds, words.hashes), len(self.seeds) - 1)
            symbol = np.where(self.seeds[at] == words.hashes, self.symbols[at], 0)
            symbol[weight > 0] = INSULT
            weight[symbol == THREAT] = 0.5
            stops = np.union1d(np.flatnonzero(_CLAUSE[data]), offsets[:-1])
            clause = np.searchsorted(stops, words.starts, "right")
            live = np.unique(clause[(symbol == INSULT) | (symbol == THREAT)])
            first, end = np.searchsorted(clause, live), np.searchsorted(clause, live, "right")
            for a, b in zip(first, end, strict=True):
                state = emitted = 0
                for s, w in zip(symbol[a:b].tolist(), weight[a:b].tolist(), strict=True):
                    emitted += self.factor[state, s] * w
                    state = self.move[state, s]
                row = lo + words.doc[a]
                best[row], total[row], matched[row] = max(best[row], emitted), total[row] + emitted, matched[row] + (emitted > 0)
        return best, total, matched

    def score(self, best: np.ndarray, total: np.ndarray) -> np.ndarray:
        return sigmoid(np.column_stack([np.minimum(best, 3.0), np.log1p(total)]) @ self.scale[:-1] + self.scale[-1])


def _families(batches):
    """mapInArrow over (text, label): two keys of each text that has words, its smallest
    shingle under two orders. Copies share both, and near copies mostly do."""
    for batch in batches:
        keys = np.zeros((2, batch.num_rows), np.int64)
        some = np.zeros(batch.num_rows, bool)
        for lo, hi, _, _, words in word_chunks(batch.column("text"), between=_APART):
            for r in range(hi - lo):
                own = shingles(words.hashes[words.first[r] : words.first[r + 1]], 3)
                if len(own):
                    some[lo + r] = True
                    keys[:, lo + r] = own.min().view(np.int64), mix(own, 21).min().view(np.int64)
        out = pa.RecordBatch.from_arrays([batch.column("text"), batch.column("label"), pa.array(keys[0]), pa.array(keys[1])], names=["text", "label", "one", "other"])
        yield out.filter(pa.array(some))


def _evidence(batches):
    """mapInArrow over (text, label): documents of each label that hold each lexicon
    candidate; entry 0 counts the documents."""
    schema = pa.schema([("entry", pa.int64()), ("n0", pa.int64()), ("n1", pa.int64())])
    found, rows = [[], []], [0, 0]
    for batch in batches:
        labels = batch.column("label").to_pylist()
        for lo, hi, _, _, words in word_chunks(batch.column("text"), prefixes=BEGINNINGS, between=_APART):
            for r in range(hi - lo):
                part, y = slice(words.first[r], words.first[r + 1]), int(labels[lo + r] > 0)
                rows[y] += 1
                found[y].append(np.unique(np.concatenate([words.hashes[part], *(p[part] for p in words.prefix_hashes)])))
    out = [np.unique(np.concatenate(x), return_counts=True) if x else (np.zeros(0, np.uint64), np.zeros(0, np.int64)) for x in found]
    every = np.union1d(out[0][0], out[1][0])
    counts = []
    for value, n in out:
        c = np.zeros(len(every), np.int64)
        c[np.searchsorted(every, value)] = n
        counts.append(c)
    keep = every != 0
    yield pa.RecordBatch.from_arrays([pa.array(np.append(every[keep].view(np.int64), 0)), *(pa.array(np.append(c[keep], n)) for c, n in zip(counts, rows, strict=True))], schema=schema)


def least_toxic(n: int, share: float, level: float) -> int:
    """The fewest toxic ones among ``n`` documents that chance exceeds with a probability of at
    most ``level``, if ``share`` of all documents are toxic; n + 1 if there is no such number."""
    tail, least = 0.0, n + 1
    for k in range(n, -1, -1):
        tail += math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(share) + (n - k) * math.log1p(-share))
        if tail > level:
            break
        least = k
    return least


def fit_grammar(sample: DataFrame, errors: float = 2.0, least_ratio: float = 3.0, most_entries: int = 20_000) -> Grammar:
    """Learn the lexicon and the scale from (text, label) rows, which the caller bounds.

    Copies and near copies count once: of texts of one label that share their smallest
    shingles under two orders one is kept, by a shuffle on these, so that the lexicon
    is the same however the sample is partitioned.

    A word or beginning enters if the log ratio of its document shares is ``least_ratio`` or
    more and a binomial test finds its toxic documents too many for chance: among all
    candidates that as many documents hold, ``errors`` or fewer are expected to pass
    without being toxic words. So what a word needs depends on its own documents and on
    how many others are tried, not on its share of all toxic ones. Of more than
    ``most_entries`` the heaviest stay. Without rows of both labels the lexicon is empty
    and every score is the smoothed share of toxic rows."""
    sample = sample.select("text", F.col("label").cast("int").alias("label"))
    distinct = sample.mapInArrow(_families, "text string, label int, one long, other long").groupBy("label", "one", "other").agg(F.min("text").alias("text")).select("text", "label")
    evidence = distinct.mapInArrow(_evidence, "entry long, n0 long, n1 long").groupBy("entry").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    evidence = saved(evidence.withColumn("n", F.col("n0") + F.col("n1")), "evidence")
    rows = evidence.where("entry = 0").first()
    n0, n1 = (rows["n0"], rows["n1"]) if rows else (0, 0)
    kept = []
    if n0 and n1:
        # one row for each number of documents, of which the sample bounds how many there are
        tried = evidence.where("entry <> 0 AND n1 > 0").groupBy("n").agg(F.count("*").alias("tried")).collect()
        needs = [(r["n"], least_toxic(r["n"], n1 / (n0 + n1), min(0.05, errors / r["tried"]))) for r in tried]
        need = evidence.sparkSession.createDataFrame(needs, "n long, need int")
        ratio = F.log((F.col("n1") + 0.5) / (n1 + 1.0)) - F.log((F.col("n0") + 0.5) / (n0 + 1.0))
        passed = evidence.where("entry <> 0 AND n1 > 0").join(need, "n").where("n1 >= need").withColumn("ratio", ratio).where(F.col("ratio") >= least_ratio)
        kept = passed.orderBy(F.desc("ratio"), "entry").limit(most_entries).select("entry", "ratio").collect()
    entries = np.array([r["entry"] for r in kept], np.int64).view(np.uint64)
    order = np.argsort(entries)
    weights = np.minimum(np.array([r["ratio"] for r in kept], float), 6.0)[order] / 6.0
    grammar = Grammar(entries[order], weights, *compose(), np.zeros(3))

    def features(batches):
        for batch in batches:
            best, total, _ = grammar.clauses(batch.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array(best), pa.array(total), batch.column("label")], names=["best", "total", "label"])

    x = sample.mapInArrow(features, "best double, total double, label int").groupBy("best", "total", "label").count().collect()
    if x:
        best, total, y, n = (np.array([r[c] for r in x], float) for c in ("best", "total", "label", "count"))
        n = n.astype(int)
        grammar.scale = fit_logistic(np.repeat(np.column_stack([np.minimum(best, 3.0), np.log1p(total)]), n, axis=0), np.repeat(y > 0, n).astype(float), ridge=0.05)
    return grammar


def score_toxicity(docs: DataFrame, grammar: Grammar, text_col: str = "text") -> DataFrame:
    """``docs`` with ``toxicity`` (0 to 1) and ``toxic_clauses`` (matched clauses).
    Null and empty texts match nothing and get the score of a text without matches.
    Columns of these names that ``docs`` has already are replaced."""
    docs = docs.drop("toxicity", "toxic_clauses")
    held = docs.sparkSession.sparkContext.broadcast(grammar)

    def run(batches):
        for batch in batches:
            best, total, matched = held.value.clauses(batch.column(batch.schema.get_field_index(text_col)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(held.value.score(best, total)), pa.array(matched)], names=[*batch.schema.names, "toxicity", "toxic_clauses"])

    schema = StructType([*docs.schema.fields, StructField("toxicity", DoubleType()), StructField("toxic_clauses", LongType())])
    return docs.mapInArrow(run, schema)
