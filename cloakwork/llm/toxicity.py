"""Toxicity by weak supervision.

Many lexicon and pattern voters look at each text.  Their lexicons are a fixed list of common abuse
and words or word beginnings that the labelled rows to learn from tie to the label.  A generative
label model over the votes (a log-linear model per class with the voters' accuracies, and couplings
for pairs of voters that agree more than their accuracies explain) is fitted by expectation
maximization to the counts of vote patterns of all documents that may be learned from; known labels
enter as one more noisy voter.  A linear classifier is then trained on the posterior labels and
scores every document.

With ``len(VOTERS)`` yes/no voters there are at most 2 ** 13 vote patterns, whatever the corpus: only
their counts reach the driver.  Lexicon and classifier are fitted on at most ``SAMPLE`` labelled rows
(in hash order of their ids), the lexicon has at most ``LEARNED`` terms; everything else covers all rows.

Cases: null and empty texts get no votes and the score of a text without any; a document without a
label, or with several, is allowed (a null label counts as none, of several the largest counts); a
null id is the empty string to the folds and has no label; repeated rows are scored alike; without
labels the class balance is ``BALANCE`` and voters keep the label model's weights; empty tables
give empty results; only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.llm.common import written
from cloakwork.llm.grams import NONE, Words, contains

SAMPLE = 50_000
LEARNED, LIFT = 300, 50
BALANCE = 0.1
# Lexicon: common insults and abuse, by kind; words that are harmless in another language of the corpus are left out.
LEXICON = {
    "insults": "idiot idiots moron morons imbecile fool fools clown clowns loser losers jerk jerks cretin buffoon dimwit halfwit dunce simpleton nitwit",
    "contempt": "stupid dumb brainless moronic idiotic braindead ignorant clueless worthless pathetic useless contemptible laughable incompetent spineless",
    "disgust": "disgusting revolting vile repulsive nauseating sickening hideous trash scum garbage filth vermin parasite parasites swine maggot lowlife scumbag dirtbag",
    "abuse": "shit shitty crap bullshit fuck fucking fucker asshole bastard bastards bitch bitches whore slut hateful despicable loathe loathsome detest exterminate subhuman",
    "other_languages": "idiota idiotas imbécil estúpido estúpida basura asqueroso tonto mierda idiote imbécile stupide ordure dégoûtant connard merde salaud crétin dumm dummkopf abschaum ekelhaft arschloch scheiße trottel schwachkopf depp",
}
ADDRESS = "you your youre this these those that such total complete utter absolute is are"
BEGINNINGS = (4, 5, 6)  # bytes of a word that a learned term may stand for
TERMS = [t for words in LEXICON.values() for t in words.split()]
_KINDS = np.array([k for k, words in enumerate(LEXICON.values()) for _ in words.split()])
VOTERS = [*LEXICON, "learned_words", *[f"learned_{n}_bytes" for n in BEGINNINGS], "twice", "many_terms", "dense", "addressed"]
_SALTS = np.array([0, *[(n * 0x9E3779B97F4A7C15) & (1 << 64) - 1 for n in BEGINNINGS]], np.uint64)


def _hashes(terms: list[str]) -> np.ndarray:
    return Words(pa.array([" ".join(terms)]), plain=True).hashes(lower=True)


def _units(w: Words) -> list[np.ndarray]:
    """Hashes of the words and of their beginnings."""
    whole = w.hashes(lower=True)
    return [whole, *[w.hashes(lower=True, first=n) ^ s for n, s in zip(BEGINNINGS, _SALTS[1:], strict=True)]]


def _votes(batch: pa.RecordBatch, terms: np.ndarray, kinds: np.ndarray, address: np.ndarray) -> pa.RecordBatch:
    """``terms`` are sorted hashes; ``kinds`` the voter of each."""
    w = Words(batch.column("text"), plain=True)
    n, hits, found = w.n, [], []
    units = _units(w)
    for h in units:
        at = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
        hit = np.flatnonzero(terms[at] == h)
        hits.append(hit)
        found.append(at[hit])
    hit, term = np.concatenate(hits), np.concatenate(found)
    of = w.of[hit]
    previous = np.maximum(hit - 1, 0)
    addressed = contains(address, units[0][previous]) & (w.of[previous] == of) & (previous < hit) if len(hit) else np.zeros(0, bool)
    pair, count = np.unique(of * len(terms) + term, return_counts=True)
    doc, term_of = pair // len(terms), pair % len(terms)
    mask = np.zeros(n, np.int64)
    np.bitwise_or.at(mask, doc, 1 << kinds[term_of])
    abusive = np.unique(hit)
    n_hits, n_terms = np.bincount(w.of[abusive], minlength=n), np.bincount(doc, minlength=n)
    k = len(VOTERS) - 4
    mask |= ((n_hits >= 2).astype(np.int64) << k) | ((n_terms >= 3).astype(np.int64) << k + 1) | (
        (n_hits * 200 >= np.maximum(w.counts, 1)) & (n_hits > 0)).astype(np.int64) << k + 2
    np.bitwise_or.at(mask, of[addressed], 1 << k + 3)
    cuts = pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32))
    return pa.record_batch(
        [batch.column("doc_id"), batch.column("part"), pa.array(mask), pa.ListArray.from_arrays(cuts, pa.array(term_of.astype(np.int32))),
         pa.ListArray.from_arrays(cuts, pa.array(count.astype(np.int32)))], ["doc_id", "part", "mask", "terms", "counts"])


def _steps(batches, most: int = 2 << 20):
    for whole in batches:
        step = int(max(1, whole.num_rows * most // max(1, whole.nbytes)))
        for start in range(0, whole.num_rows, step):
            yield whole.slice(start, step)


def fold(id_col: Column, folds: int) -> Column:
    return (F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds).cast("int")


def learned_terms(docs: DataFrame, labelled: DataFrame, id_col: str, text_col: str, most: int = LEARNED) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and kinds of words and word beginnings tied to label 1 in the labelled rows (doc_id, label; a bounded sample).

    A term must stand in 1.5 % of the toxic texts (four at least) and in ``LIFT`` times as many toxic as other
    texts per row of each; the ``most`` with the largest support are taken.  Equal texts count once.
    """
    def run(batches):
        for batch in _steps(batches):
            w, label = Words(batch.column("text"), plain=True), batch.column("label").to_numpy()
            rows = []
            for kind, h in enumerate(_units(w)):
                order = np.lexsort((w.of, h))
                a, of = h[order], w.of[order]
                new = np.append(True, (a[1:] != a[:-1]) | (of[1:] != of[:-1]))[:len(a)]
                a, y = a[new], label[of[new]]
                values, at = np.unique(a, return_inverse=True)
                rows.append((values, np.full(len(values), kind), np.bincount(at, y, len(values)), np.bincount(at, 1 - y, len(values))))
            h, kind, bad, good = (np.concatenate(x) for x in zip(*rows, strict=True))
            yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(kind.astype(np.int32)), pa.array(bad.astype(np.int64)), pa.array(good.astype(np.int64))],
                                  ["h", "kind", "bad", "good"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(labelled), "doc_id")
    once = texts.groupBy(F.xxhash64("text").alias("same")).agg(F.max_by(F.struct("text", "label"), "doc_id").alias("x")).select("x.*")
    size = once.agg(F.count_if(F.col("label") == 1).alias("bad"), F.count_if(F.col("label") == 0).alias("good")).first()
    least = max(4, 0.015 * size["bad"])
    stats = once.mapInArrow(run, "h long, kind int, bad long, good long").groupBy("h", "kind").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    tied = stats.filter((F.col("bad") >= least) & (F.col("bad") * max(1, size["good"]) > (F.col("good") + 0.5) * LIFT * max(1, size["bad"])))
    best = tied.orderBy(F.desc("bad"), "good", "h").limit(most).toPandas()
    return best["h"].to_numpy().astype(np.int64).view(np.uint64), best["kind"].to_numpy().astype(int)


def votes(docs: DataFrame, terms: np.ndarray, kinds: np.ndarray, id_col: str = "doc_id", text_col: str = "text", folds: int = 3) -> DataFrame:
    """doc_id, part (crc32 of the id mod ``folds``), mask (bit per voter), terms and counts of lexicon hits."""
    address = np.sort(_hashes(ADDRESS.split()))

    def run(batches):
        for batch in _steps(batches):
            yield _votes(batch, terms, kinds, address)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), fold(F.col(id_col), folds).alias("part"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, part int, mask long, terms array<int>, counts array<int>")


class LabelModel:
    """P(votes, label | class) with accuracies and couplings; class balance is kept fixed."""

    def __init__(self, m: int, balance: float) -> None:
        self.m, self.balance = m, min(max(balance, 0.005), 0.5)
        states = np.arange(1 << m)
        self.x = (states[:, None] >> np.arange(m) & 1).astype(float)
        self.pairs: list[tuple[int, int]] = []
        self.label = np.array([[0.98, 0.02], [0.2, 0.8]])  # P(label | class)
        self.prior = np.full(m, -3.0)
        self.theta = np.array([np.full(m, -5.0), np.full(m, -1.0)])

    def _features(self) -> np.ndarray:
        return np.hstack([self.x, *[self.x[:, [j]] * self.x[:, [k]] for j, k in self.pairs]])

    def _log_p(self, f: np.ndarray) -> np.ndarray:
        e = f @ self.theta.T
        top = e.max(axis=0)
        return e - top - np.log(np.exp(e - top).sum(axis=0))

    def posterior(self, masks: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """P(toxic) of vote patterns with a label of 0, 1 or none (-1)."""
        log_p = self._log_p(self._features())[masks] + np.log([1 - self.balance, self.balance])
        seen = labels >= 0
        log_p[seen] += np.log(self.label[:, labels[seen]].T)
        d = np.clip(log_p[:, 0] - log_p[:, 1], -60, 60)
        return 1 / (1 + np.exp(d))

    def _fit(self, masks: np.ndarray, labels: np.ndarray, counts: np.ndarray, rounds: int) -> None:
        f = self._features()
        for _ in range(rounds):
            q = self.posterior(masks, labels)
            weights = np.stack([counts * (1 - q), counts * q])
            for y in (0, 1):
                for v in (0, 1):
                    self.label[y, v] = 1 + weights[y, labels == v].sum()
                self.label[y] /= self.label[y].sum()
            # labels may be noisy, but not so that a class turns into another
            self.label[0, 1], self.label[1, 1] = min(self.label[0, 1], 0.1), max(self.label[1, 1], 0.6)
            self.label[:, 0] = 1 - self.label[:, 1]
            total = weights.sum(axis=1) + 1e-9
            seen = np.stack([np.bincount(masks, w, len(f)) for w in weights]) / total[:, None]
            for _ in range(4):  # Newton steps to the expected features of each class, slightly shrunk
                for y in (0, 1):
                    p = np.exp(self._log_p(f)[:, y])
                    mean = p @ f
                    cov = (f * p[:, None]).T @ f - np.outer(mean, mean)
                    pull = np.clip(self.prior - self.theta[y], -5, 5) * 5 / total[y]
                    step = np.linalg.solve(cov + (1e-4 + 5 / total[y]) * np.eye(len(mean)), seen[y] @ f - mean + pull)
                    self.theta[y] += np.clip(step, -1, 1)

    def fit(self, masks: np.ndarray, labels: np.ndarray, counts: np.ndarray, most_pairs: int = 12) -> LabelModel:
        """Independent voters first; then couplings for the pairs that depend most on each other within classes."""
        self._fit(masks, labels, counts, 15)
        q = self.posterior(masks, labels)
        x, w = self.x[masks], counts * q
        mean = w @ x / (w.sum() + 1e-9)
        cov = (x * w[:, None]).T @ x / (w.sum() + 1e-9) - np.outer(mean, mean)
        sd = np.sqrt(np.clip(np.diag(cov), 1e-9, None))
        corr = np.triu(cov / np.outer(sd, sd), 1)
        best = np.argsort(-np.abs(corr), axis=None)[:most_pairs]
        self.pairs = [(int(i) // self.m, int(i) % self.m) for i in best if abs(corr.flat[i]) > 0.1]
        self.prior = np.append(self.prior, np.zeros(len(self.pairs)))
        self.theta = np.hstack([self.theta, np.zeros((2, len(self.pairs)))])
        self._fit(masks, labels, counts, 15)
        return self


def _features(masks: np.ndarray, terms: list, counts: list, n_terms: int) -> np.ndarray:
    out = np.zeros((len(masks), len(VOTERS) + n_terms + 1))
    out[:, :len(VOTERS)] = masks[:, None] >> np.arange(len(VOTERS)) & 1
    for i, (t, c) in enumerate(zip(terms, counts, strict=True)):
        out[i, len(VOTERS) + np.asarray(t, int)] = np.log1p(np.asarray(c, float))
    out[:, -1] = 1
    return out


def linear(x: np.ndarray, y: np.ndarray, n: np.ndarray, penalty: float = 0.3, rounds: int = 20) -> np.ndarray:
    """Logistic regression on soft labels of rows with multiplicities; the last column is the constant."""
    w = np.zeros(x.shape[1])
    w[-1] = -4
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-3
    loss = lambda v: n @ (np.logaddexp(0, x @ v) - y * (x @ v)) + ridge @ v**2 / 2
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        grad = x.T @ (n * (p - y)) + ridge * w
        h = (x * (n * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step, now = np.linalg.solve(h, grad), loss(w)
        while np.abs(step).max() > 1e-6 and loss(w - step) > now:
            step /= 2
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          folds: int = 3, held_out: int = 1, threshold: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted.  Only rows outside the held-out fold are learned from."""
    known = labels.filter((fold(F.col(id_col), folds) != held_out) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(
        F.col(id_col).cast("long").alias("doc_id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    chosen = written(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "labelled")
    learned, of = learned_terms(docs, chosen, id_col, text_col)
    fixed = _hashes(TERMS)
    new = ~np.isin(learned, fixed)
    terms, kinds = np.concatenate((fixed, learned[new])), np.concatenate((_KINDS, len(LEXICON) + of[new]))
    terms, first = np.unique(terms, return_index=True)
    voted = written(votes(docs, terms, kinds[first], id_col, text_col, folds), "votes")
    both = voted.filter(F.col("part") != held_out).join(known, "doc_id", "left").withColumn("label", F.coalesce("label", F.lit(-1)))
    table = both.groupBy("mask", "label").agg(F.count("*").alias("n")).toPandas()
    masks, given, n = table["mask"].to_numpy(), table["label"].to_numpy(), table["n"].to_numpy().astype(float)
    labelled = n[given >= 0].sum()
    balance = n[given == 1].sum() / labelled if labelled else BALANCE
    model = LabelModel(len(VOTERS), balance).fit(masks, given, n) if len(table) else LabelModel(len(VOTERS), balance)
    rows = voted.join(F.broadcast(chosen), "doc_id").groupBy("mask", "label", "terms", "counts").agg(F.count("*").alias("n")).toPandas()
    if len(rows):
        x = _features(rows["mask"].to_numpy(), rows["terms"].tolist(), rows["counts"].tolist(), len(terms))
        y = model.posterior(rows["mask"].to_numpy(), rows["label"].to_numpy())
        weights = linear(x, y, rows["n"].to_numpy().astype(float))
    else:  # nothing labelled: the label model's own evidence per voter
        weights = np.concatenate((model.theta[1, :len(VOTERS)] - model.theta[0, :len(VOTERS)], np.zeros(len(terms)), [np.log(balance / (1 - balance))]))
    by_voter = [F.when(F.col("mask").bitwiseAND(F.lit(1 << j)) != 0, float(weights[j])).otherwise(0.0) for j in range(len(VOTERS))]
    by_term = F.array(*[F.lit(float(v)) for v in weights[len(VOTERS):-1]])
    hits = F.aggregate(F.arrays_zip("terms", "counts"), F.lit(0.0), lambda a, z: a + F.element_at(by_term, z["terms"] + 1) * F.log1p(z["counts"]))
    total = sum(by_voter, F.lit(float(weights[-1]))) + F.when(F.size("terms") > 0, hits).otherwise(0.0)
    scored = voted.withColumn("score", 1 / (1 + F.exp(-total)))
    return scored.select("doc_id", (F.col("part") == held_out).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
