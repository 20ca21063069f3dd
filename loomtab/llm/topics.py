"""Subject areas of documents by latent Dirichlet topic models.

1. *Fit*: variational Bayes over documents with ratings (at most ``fit_docs`` of them, by hash of the number; this
   bound is a parameter of the classifier only). Words are Latin words and pairs of Han characters. Each round is
   one distributed pass: every partition sends its expected topic-word counts, a matrix of fixed size. Topics start
   from the ratings (one per subject) and from noise (background topics), so that wrong ratings are washed out.
2. *Map*: a topic gets the subject whose rated documents hold its top terms most above chance; topics without such a
   subject are background. :func:`topic_table` shows topics, subjects and top terms for inspection.
3. *Assign*: every document is read once. For each sentence the topic proportions are inferred with the fitted topics; a
   sentence is about its largest subject if that has at least ``least_share_of_sentence`` of its proportions and ``least_mass``
   of its words. A document's proportion of a subject is the share of the sentences about it: a subject is assigned from
   ``least_share`` on, if at least ``least_sentences`` sentences are about it.

Bounds: the broadcast model has at most ``max_terms`` words times the number of topics, whatever the size of the corpus.

Defined cases: null and blank texts get no subject; ratings in other spelling are matched without case and white space,
ratings of unknown subjects or documents are ignored; without any rating, or on empty tables, nothing is assigned;
equal texts under several ids get the same subjects.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtab.functions.script import simplify_map
from loomtab.llm.tokens import Tokens, char_table
from loomtab.session import cut, partitions

BACKGROUND = 6
FIT_DOCS = 3000
MAX_TERMS = 30_000
#: A sentence's subject must have so many of its words, as a sum of their topic proportions, and so much of the sentence's proportions.
LEAST_MASS, LEAST_OF_SENTENCE = 1.0, 0.05
#: Prior weight of a subject's topic and of a background topic in a sentence, and rounds of inference.
PRIOR_SUBJECT, PRIOR_BACKGROUND, ROUNDS = 0.05, 0.3, 4


@dataclass
class Model:
    subjects: list[str]
    terms: np.ndarray  # sorted hashes of the vocabulary
    words: list[str]  # their spelling
    topics: np.ndarray  # K × V, rows sum to one
    weight: np.ndarray  # K, share of the topics in the corpus
    subject_of: np.ndarray  # K, index of the subject or -1

    def term_ids(self, f: np.ndarray) -> np.ndarray:
        """Index of each feature in the vocabulary, -1 if it isn't there."""
        i = np.searchsorted(self.terms, f)
        i[i == len(self.terms)] = 0
        return np.where(self.terms[i] == f, i, -1)

    def likelihood(self) -> np.ndarray:
        """V × K: probability of each term in the topics, up to a factor per term that inference doesn't see."""
        return np.ascontiguousarray((self.topics / np.maximum(self.topics.sum(axis=0), 1e-300)).T.astype(np.float32))

    def to_subjects(self) -> np.ndarray:
        """K × S: which subject a topic has."""
        out = np.zeros((len(self.topics), len(self.subjects)), np.float32)
        for k, s in enumerate(self.subject_of):
            if s >= 0:
                out[k, s] = 1.0
        return out


def ratings(labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """(doc_id, subject) with subjects as the list of subjects spells them."""
    key = lambda c: F.lower(F.regexp_replace(c, r"(?U)[\s\p{Z}]+", ""))
    known = subjects.select("subject", key(F.col("subject")).alias("_k"))
    return labels.select("doc_id", key(F.col("subject")).alias("_k")).join(F.broadcast(known), "_k").select("doc_id", "subject").distinct()


def _digamma(x: np.ndarray) -> np.ndarray:
    out = np.zeros_like(x)
    y = x.copy()
    for _ in range(6):
        small = y < 6
        out[small] -= 1.0 / y[small]
        y[small] += 1.0
    z = 1.0 / (y * y)
    return out + np.log(y) - 0.5 / y - z * (1 / 12 - z * (1 / 120 - z / 252))


def _expect(counts: np.ndarray, e_beta: np.ndarray, alpha: np.ndarray, rounds: int = 9) -> np.ndarray:
    """Variational topic weights (gamma) of documents given as a dense document × term matrix."""
    e_beta = e_beta.astype(np.float32)
    gamma = np.ones((len(counts), len(alpha))) * (alpha + counts.sum(axis=1, keepdims=True) / len(alpha))
    for _ in range(rounds):
        e_theta = np.exp(_digamma(gamma) - _digamma(gamma.sum(axis=1, keepdims=True))).astype(np.float32)
        gamma = alpha + e_theta * ((counts / (e_theta @ e_beta + 1e-30)) @ e_beta.T)
    return gamma


def _texts_to_rows(df: DataFrame, table: np.ndarray) -> DataFrame:
    """(doc_id, terms, spellings, counts) of each document."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = part.column(1).to_pylist()
                t = Tokens(texts, table)
                f, first = t.features()
                doc = t.text[first]
                terms, counts, words = [], [], []
                for d in range(part.num_rows):
                    lo, hi = np.searchsorted(doc, d), np.searchsorted(doc, d, "right")
                    u, where, n = np.unique(f[lo:hi], return_index=True, return_counts=True)
                    tok = first[lo:hi][where]
                    end = np.where(t.han[tok], tok + 1, tok)
                    words.append([texts[d][a:z].lower() for a, z in zip(t.start[tok].tolist(), t.end[np.minimum(end, len(t.end) - 1)].tolist())])
                    terms.append(u.view(np.int64).tolist())
                    counts.append(n.tolist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(terms, pa.list_(pa.int64())), pa.array(words, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int64()))], ["doc_id", "terms", "words", "counts"])

    return df.mapInArrow(run, "doc_id long, terms array<long>, words array<string>, counts array<long>")


def fit(docs: DataFrame, labels: DataFrame, subjects: DataFrame, rounds: int = 8, fit_docs: int = FIT_DOCS, max_terms: int = MAX_TERMS, least_docs: int = 3, least_share: float = 0.005, most_share: float = 0.4, most_a_word: int = 5) -> Model | None:
    """Topics of the rated documents (columns doc_id, text) and the subjects of the topics; None without ratings.

    The classifier is fitted on at most ``fit_docs`` rated documents. Its words are those that ``least_share`` to
    ``most_share`` of them hold, the ``max_terms`` most frequent ones if there are more (about 6,300 on 3,000 documents of the test
    tables, so that the bound isn't reached); a word counts ``most_a_word`` times a document at most, in fitting only.
    """
    spark = docs.sparkSession
    rated = ratings(labels, subjects)
    chosen = rated.select("doc_id").distinct().orderBy(F.xxhash64("doc_id")).limit(fit_docs)
    names = sorted(r[0] for r in subjects.select("subject").where("subject is not null").distinct().collect())
    sample = docs.join(F.broadcast(chosen), "doc_id").where("text is not null and trim(text) <> ''").select("doc_id", "text")
    rows = _texts_to_rows(sample, char_table(simplify_map(spark)))
    mine = rated.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.collect_set("subject").alias("subjects"))
    rows = cut(rows.join(F.broadcast(mine), "doc_id").repartition(min(32, partitions(spark)), "doc_id"))
    n = rows.count()
    if not n:
        return None
    vocabulary = (
        rows.select(F.explode(F.arrays_zip("terms", "words")).alias("x"))
        .groupBy(F.col("x.terms").alias("term")).agg(F.count(F.lit(1)).alias("df"), F.min("x.words").alias("word"))
        .where((F.col("df") >= max(least_docs, int(n * least_share))) & (F.col("df") <= max(n * most_share, least_docs)))
        .orderBy(F.desc("df"), "term").limit(max_terms).toPandas()
    )
    if not len(vocabulary):
        return None
    terms = vocabulary["term"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(terms)
    terms, words = terms[order], [vocabulary["word"].iloc[i] for i in order]
    s, v = len(names), len(terms)
    k = s + BACKGROUND
    alpha = np.concatenate((np.full(s, 0.1), np.full(BACKGROUND, 0.5)))

    def pass_over(topics: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        held = spark.sparkContext.broadcast((terms, topics))

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            terms, topics = held.value
            stats, theta = np.zeros((k, v)), np.zeros(k)
            for b in it:
                for at in range(0, b.num_rows, 128):
                    part = b.slice(at, 128)
                    x = np.zeros((part.num_rows, v), np.float32)
                    for d, (ts, cs) in enumerate(zip(part.column(1), part.column(3))):
                        t = np.asarray(ts.values.to_numpy()).view(np.uint64)
                        i = np.searchsorted(terms, t)
                        i[i == v] = 0
                        ok = terms[i] == t
                        x[d, i[ok]] = np.minimum(cs.values.to_numpy()[ok], most_a_word)
                    if topics is None:
                        for d, own in enumerate(part.column(4).to_pylist()):
                            for name in own:
                                stats[names.index(name)] += x[d] / len(own)
                        stats[s:] += x.sum(axis=0) / BACKGROUND
                    else:
                        gamma = _expect(x, topics, alpha)
                        e = np.exp(_digamma(gamma) - _digamma(gamma.sum(axis=1, keepdims=True)))
                        stats += topics * (e.T @ (x / (e @ topics + 1e-100)))
                        theta += (gamma / gamma.sum(axis=1, keepdims=True) * x.sum(axis=1, keepdims=True)).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array([stats.astype(np.float32).tobytes()]), pa.array([theta.tobytes()])], ["stats", "theta"])

        stats, theta = np.zeros((k, v)), np.zeros(k)
        for r in rows.mapInArrow(run, "stats binary, theta binary").collect():  # at most 32 matrices of fixed size
            stats += np.frombuffer(r["stats"], np.float32).reshape(k, v)
            theta += np.frombuffer(r["theta"])
        return stats, theta

    stats, theta = pass_over(None)
    whole = stats[s:].sum(axis=0)
    for j in range(s):  # a subject starts with what its documents have above the average
        stats[j] = np.maximum(stats[j] - 1.5 * stats[j].sum() * whole / max(whole.sum(), 1.0), 0.0)
    stats[s:] = whole / BACKGROUND * np.random.default_rng(7).gamma(1.0, 1.0, (BACKGROUND, v))
    for _ in range(rounds):
        lam = stats + 0.02
        stats, theta = pass_over(np.exp(_digamma(lam) - _digamma(lam.sum(axis=1, keepdims=True))))
    topics = (stats + 0.01) / (stats + 0.01).sum(axis=1, keepdims=True)
    subject_of = _subjects_of_topics(topics, rows, names, terms)
    return Model(names, terms, words, topics, theta / theta.sum(), subject_of)


def _subjects_of_topics(topics: np.ndarray, rows: DataFrame, names: list[str], terms: np.ndarray, top: int = 40) -> np.ndarray:
    """The subject whose rated documents hold a topic's top terms most above chance, or -1."""
    lift = topics / np.maximum(topics.mean(axis=0), 1e-300)
    best = np.argsort(-topics * np.log(np.maximum(lift, 1e-9)), axis=1)[:, :top]
    wanted = {int(terms[i].view(np.int64)) for row in best for i in row}
    seen = (
        rows.select("subjects", F.explode("terms").alias("term"))
        .where(F.col("term").isin(list(wanted)))
        .select("term", F.explode("subjects").alias("subject")).groupBy("term", "subject").count().collect()
    )
    base = {r["subject"]: r["count"] for r in rows.select(F.explode("subjects").alias("subject")).groupBy("subject").count().collect()}
    share = np.zeros((len(terms), len(names)))
    at = {int(t): i for i, t in enumerate(terms.view(np.int64))}
    for r in seen:
        share[at[r["term"]], names.index(r["subject"])] = r["count"]
    share /= np.maximum(share.sum(axis=1, keepdims=True), 1)
    prior = np.array([base.get(x, 0) for x in names], float)
    prior /= max(prior.sum(), 1)
    out = np.full(len(topics), -1)
    for k, row in enumerate(best):
        mean = share[row].mean(axis=0)
        j = int(mean.argmax())
        if mean[j] >= prior[j] + 0.25 * (1.0 - prior[j]):
            out[k] = j
    return out


def topic_table(model: Model, top: int = 12) -> list[tuple[int, str | None, float, str]]:
    """(topic, subject, share of the corpus, top terms) for inspection."""
    lift = model.topics / np.maximum(model.topics.mean(axis=0), 1e-300)
    best = np.argsort(-model.topics * np.log(np.maximum(lift, 1e-9)), axis=1)[:, :top]
    return [(k, model.subjects[j] if j >= 0 else None, float(model.weight[k]), " ".join(model.words[i] for i in best[k])) for k, j in enumerate(model.subject_of)]


def infer(words: np.ndarray, of: np.ndarray, first: np.ndarray, model: Model, likelihood: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(expected words of each topic, topic proportions) of texts by variational inference.

    ``words`` are term numbers sorted by text, ``of`` the text of each and ``first`` the first word of each text.
    """
    prior = np.where(model.subject_of >= 0, PRIOR_SUBJECT, PRIOR_BACKGROUND).astype(np.float32)
    near = likelihood[words]
    theta = np.broadcast_to(model.weight.astype(np.float32), (len(first), len(prior)))
    expected = np.zeros((len(first), len(prior)), np.float32)
    for _ in range(rounds if len(first) else 0):
        phi = near * theta[of]
        phi /= phi.sum(axis=1, keepdims=True) + 1e-30
        expected = np.add.reduceat(phi, first, axis=0)
        theta = expected + prior
        theta /= theta.sum(axis=1, keepdims=True)
    return expected, theta


def sentence_counts(texts: list[str | None], model: Model, likelihood: np.ndarray, table: np.ndarray, least_mass: float = LEAST_MASS, least_of: float = LEAST_OF_SENTENCE) -> tuple[np.ndarray, np.ndarray]:
    """(documents × subjects) numbers of sentences about each subject, and each document's number of sentences."""
    t = Tokens(texts, table)
    f, at = t.features()
    n, s = len(texts), len(model.subjects)
    counts = np.zeros((n, s))
    if not len(t.hash):
        return counts, np.zeros(n)
    new = np.concatenate(([True], t.sentence[1:] != t.sentence[:-1]))
    number = np.cumsum(new) - 1
    doc = t.text[new]
    ids = model.term_ids(f)
    use = ids >= 0
    sentence, first, of = np.unique(number[at[use]], return_index=True, return_inverse=True)
    expected, theta = infer(ids[use], of, first, model, likelihood)
    words, share = expected @ model.to_subjects(), theta @ model.to_subjects()
    if s and len(sentence):
        top = words.argmax(axis=1)
        row = np.arange(len(top))
        about = (words[row, top] >= least_mass) & (share[row, top] >= least_of)
        np.add.at(counts, (doc[sentence[about]], top[about]), 1)
    return counts, np.bincount(doc[np.bincount(number) >= 3], minlength=n)


def assign(docs: DataFrame, model: Model | None, least_share: float = 0.08, least_sentences: int = 2, least_mass: float = LEAST_MASS, least_share_of_sentence: float = LEAST_OF_SENTENCE) -> DataFrame:
    """(doc_id, subject, sentences, share) for every document."""
    schema = "doc_id long, subject string, sentences long, share double"
    spark = docs.sparkSession
    if model is None:
        return spark.createDataFrame([], schema)
    held = spark.sparkContext.broadcast((model, model.likelihood(), char_table(simplify_map(spark))))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, likelihood, table = held.value
        for b in it:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                counts, n = sentence_counts(part.column(1).to_pylist(), model, likelihood, table, least_mass, least_share_of_sentence)
                share = counts / np.maximum(n, 1)[:, None]
                d, j = np.nonzero((share >= least_share) & (counts >= np.minimum(least_sentences, np.maximum(n, 1))[:, None]))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(d)), pa.array([model.subjects[x] for x in j], pa.string()), pa.array(counts[d, j].astype(np.int64)), pa.array(share[d, j])], ["doc_id", "subject", "sentences", "share"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null").mapInArrow(run, schema)
