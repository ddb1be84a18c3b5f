"""Problem 10: the subjects of each document.

Method: labelling functions vote on every pair of document and subject: a lexicon of words and word pairs, the section a
text opens with, the address and the source. Their accuracies are learned by expectation-maximization from their agreements
(counted as vote patterns over all pairs, a bounded table), and the posterior decides. The lexicon is fitted on a bounded
sample (FIT_DOCS labelled documents, and FIT_PLAIN unlabelled ones of each language), for each language by itself: sentences have a latent subject or none, hand labels, which may
be wrong or missing, are only the prior of their document, and word counts are re-estimated in rounds.

Defined results: null ids, null and empty texts have no subject; a repeated doc_id counts once; labels of unknown documents
and null labels are ignored; without labels and subjects there are no subjects.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.words import CACHE_WORDS, mix
from corpusloom.operators.keys import measured_broadcast
from corpusloom.session import cut

SLOTS = 1 << 17
FIT_DOCS, FIT_PLAIN, ROUNDS = 8000, 1500, 9
FIT_CHARS = 50_000  #: longer texts do not serve to fit, so that what the driver reads is bounded
SHARE, UNSURE = 0.30, 0.20  #: share of a document's sentences from which a function votes yes; below the second it votes no
_PATH = re.compile(r"[^\W\d_]+")


# Function words that tell the language of a text; texts without any go with the first.
LANGUAGES = (
    frozenset("the of and to in a is that for it as was with be by on not at are this have from or an which will who over after then".split()),
    frozenset("le la les de des du un une et est dans pour que qui sur avec par au aux ne pas ce cette sans avant plus se son sa ses il".split()),
    frozenset("yang dan di ke dari untuk dengan ini itu tidak pada adalah oleh akan telah sebelum tanpa atau juga bersama sejak sila".split()),
    frozenset("der die das und ist nicht mit von zu den dem ein eine für auf im sich des als auch werden wird bei nach".split()),
)


_TOKEN = re.compile(r"[^\W\d_]+|[.?!](?=\s)|\n")
_END = {".": 0, "?": 0, "!": 0, "\n": 0}


class _Codes(dict):
    """Word to hash, end of sentence to 0."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = _END[word] if word in _END else (xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) | 1)
        return h


_codes = _Codes()
_known = np.array(sorted((xxhash.xxh64_intdigest(w.encode()) | 1, k) for k, l in enumerate(LANGUAGES) for w in l if sum(w in o for o in LANGUAGES) == 1), dtype=np.uint64)


class Texts:
    """Words and sentences of many texts: feature slots of each word and of the pair it begins, its sentence, each sentence's text."""

    def __init__(self, texts: list[str | None]) -> None:
        parts, n = [], []
        for t in texts:
            w = _TOKEN.findall(t.lower()) if t else []
            n.append(len(w) + 1)
            parts.append(np.fromiter(map(_codes.__getitem__, w), np.uint64, len(w)))
            parts.append(np.zeros(1, np.uint64))  # a text ends its sentence
        code = np.concatenate(parts) if parts else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(texts)), n)
        word = code != 0
        self.code = code[word]
        self.owner = owner[word]
        sentence = np.cumsum(~word)[word]
        new = np.r_[True, sentence[1:] != sentence[:-1]] if len(sentence) else np.empty(0, bool)
        self.sentence = np.cumsum(new) - 1
        self.starts = np.flatnonzero(new)
        self.text_of = self.owner[self.starts]
        self.single = (self.code % np.uint64(SLOTS)).astype(np.int64)
        pair = np.full(len(self.code), SLOTS, np.int64)  # SLOTS is the empty feature
        if len(self.code) > 1:
            p = (mix(self.code[:-1] * np.uint64(3) + self.code[1:]) % np.uint64(SLOTS)).astype(np.int64)
            pair[:-1] = np.where(new[1:], SLOTS, p)
        self.pair = pair
        at = np.searchsorted(_known[:, 0], self.code) % len(_known)
        hit = _known[at, 0] == self.code
        votes = np.bincount(self.owner[hit] * len(LANGUAGES) + _known[at[hit], 1].astype(np.int64), minlength=len(texts) * len(LANGUAGES))
        #: the number of the language whose function words a text has most of; 0 without any
        self.language = votes.reshape(len(texts), len(LANGUAGES)).argmax(axis=1) if len(texts) else np.empty(0, np.int64)


def fit(docs: list[tuple[str, list[int]]], k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Log-odds (k + 1, SLOTS + 1) of each subject and of none (row 0), from (text, label numbers 1..k; [] unlabelled, [0] none)."""
    t = Texts([x for x, _ in docs])
    out = np.zeros((k + 1, SLOTS + 1), np.float32)
    if not len(t.starts):
        return out
    slot = np.concatenate([t.single, t.pair])
    sent = np.concatenate([t.sentence, t.sentence])
    ok = slot < SLOTS
    slot, sent = slot[ok], sent[ok]
    freq = np.bincount(slot, minlength=SLOTS)
    used = np.flatnonzero(freq > 1)
    place = np.full(SLOTS, -1)
    place[used] = np.arange(len(used))
    ok = place[slot] >= 0
    slot, sent = place[slot[ok]], sent[ok]
    lines = len(t.starts)
    owner_ = t.text_of
    labelled = np.array([bool(l) for _, l in docs])
    prior = np.full((len(docs), k + 1), 1.0 / (k + 1))
    for d, (_, l) in enumerate(docs):
        if l:
            prior[d] = 0.02
            prior[d, 0] = 0.25
            for x in l:
                prior[d, x] += 1.0 / len(l)
            prior[d] /= prior[d].sum()
    post = prior[owner_].copy()
    weight = np.where(labelled[owner_], 1.0, 0.0)  # unlabelled documents join once the labelled ones have shaped the words
    base = np.bincount(slot, minlength=len(used)) + 0.5
    base /= base.sum()
    logp = np.zeros((k + 1, len(used)))
    for r in range(rounds):
        for c in range(k + 1):
            n = np.bincount(slot, (post[:, c] * weight)[sent], minlength=len(used))
            strength = 20.0 + 0.02 * n.sum()
            logp[c] = np.log((n + strength * base) / (n.sum() + strength))
        score = np.stack([np.bincount(sent, (logp[c] - logp[0])[slot], minlength=lines) for c in range(k + 1)], axis=1)
        score += np.log(prior[owner_] + 1e-4)
        post = np.exp(score - score.max(axis=1, keepdims=True))
        post /= post.sum(axis=1, keepdims=True)
        if r >= 2:
            weight = np.ones(lines)
            mean = np.stack([np.bincount(owner_, post[:, c], minlength=len(docs)) for c in range(k + 1)], axis=1)
            free = mean + 0.3
            free /= free.sum(axis=1, keepdims=True)
            prior[~labelled] = free[~labelled]
            mixed = 0.5 * prior + 0.5 * free
            prior[labelled] = mixed[labelled]
    out[:, used] = logp - logp[0]
    return out


def fit_all(docs: list[tuple[str, list[int]]], k: int) -> np.ndarray:
    """(languages, k + 1, SLOTS + 1): the log-odds of `fit` for each language."""
    lang = Texts([x for x, _ in docs]).language
    return np.stack([fit([d for d, l in zip(docs, lang) if l == i], k) for i in range(len(LANGUAGES))])


def judge_texts(texts: list[str | None], tables: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(share of sentences by subject, share by summed evidence, subject of the opening sentence) of each text; column 0 is none."""
    k = tables.shape[1]
    t = Texts(texts)
    shares, soft, first = np.zeros((len(texts), k)), np.zeros((len(texts), k)), np.zeros(len(texts), np.int64)
    if not len(t.starts):
        return shares, soft, first
    shift = t.language[t.owner] * (SLOTS + 1)
    one, two = t.single + shift, t.pair + shift
    score = np.zeros((len(t.starts), k))
    for c in range(1, k):
        row = np.ascontiguousarray(tables[:, c]).ravel()
        score[:, c] = np.add.reduceat(row[one] + row[two], t.starts)
    best = score.argmax(axis=1)
    best[score.max(axis=1) <= 0.5] = 0
    own = t.text_of
    n = np.maximum(np.bincount(own, minlength=len(texts)), 1)
    shares = np.bincount(own * k + best, minlength=len(texts) * k).reshape(-1, k) / n[:, None]
    p = np.exp(np.clip(score - score.max(axis=1, keepdims=True), -50, 0))
    p /= p.sum(axis=1, keepdims=True)
    for c in range(k):
        soft[:, c] = np.bincount(own, p[:, c], minlength=len(texts))
    begin = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    first[own[begin]] = best[begin]
    return shares, soft / n[:, None], first


#: the functions, in the order of their letters in a pattern
FUNCTIONS = ("lexicon", "lexicon_soft", "section", "address", "source")
_START = np.array([[0.95, 0.97], [0.93, 0.97], [0.6, 0.92], [0.5, 0.95], [0.3, 0.9]])  # P(yes | subject), P(no | not) to begin with
_FIRM = np.array([200.0, 200.0, 5.0, 5.0, 5.0])  # pseudo-counts that hold the lexicon to its meaning


def learn(counts: dict[str, int], rounds: int = 30) -> dict[str, float]:
    """The posterior of each vote pattern (y, n or - for each function), with accuracies learned from the agreements."""
    patterns = sorted(counts)
    if not patterns:
        return {}
    n = np.array([counts[p] for p in patterns], float)
    v = np.array([[{"y": 1, "n": 0, "-": -1}[x] for x in p] for p in patterns])
    acc, share = _START.copy(), 0.1
    for _ in range(rounds):
        yes, no = np.full(len(v), np.log(share)), np.full(len(v), np.log(1 - share))
        for j in range(v.shape[1]):
            a, b = np.clip(acc[j], 0.02, 0.995)
            yes += np.where(v[:, j] == 1, np.log(a), np.where(v[:, j] == 0, np.log(1 - a), 0))
            no += np.where(v[:, j] == 1, np.log(1 - b), np.where(v[:, j] == 0, np.log(b), 0))
        q = 1 / (1 + np.exp(np.clip(no - yes, -60, 60)))
        share = float(np.clip((n * q).sum() / n.sum(), 1e-3, 0.5))
        for j in range(v.shape[1]):
            said = v[:, j] >= 0
            w = _FIRM[j] + 0.01 * n.sum()
            acc[j, 0] = ((n * q * (v[:, j] == 1)).sum() + w * _START[j, 0]) / ((n * q * said).sum() + w)
            acc[j, 1] = ((n * (1 - q) * (v[:, j] == 0)).sum() + w * _START[j, 1]) / ((n * (1 - q) * said).sum() + w)
    return dict(zip(patterns, map(float, q)))


class Subjects:
    def __init__(self, documents: DataFrame, subjects: DataFrame, labels: DataFrame) -> None:
        spark = documents.sparkSession
        names = subjects.filter("subject is not null").groupBy("subject").agg(F.max("description").alias("description")).orderBy("subject")
        rows = [(r.subject, r.description or "") for r in names.toLocalIterator()]  # the list of subjects
        self.names = [n for n, _ in rows]
        k = len(rows)
        number = {n: i + 1 for i, n in enumerate(self.names)} | {"none": 0}
        docs = documents.filter("doc_id is not null and text is not null and trim(text) <> ''").select("doc_id", "text", F.lower(F.trim("source")).alias("source"), "url")
        ids = docs.select("doc_id").groupBy("doc_id").count()
        twice = cut(ids.filter("count > 1").select("doc_id"))
        if twice.count():
            hint = measured_broadcast(twice)
            docs = docs.join(hint, "doc_id", "left_anti").unionByName(docs.join(hint, "doc_id", "left_semi").groupBy("doc_id").agg(F.max(F.struct("text", "source", "url")).alias("m")).select("doc_id", "m.*"))
        said = labels.filter("doc_id is not null and subject is not null").groupBy("doc_id").agg(F.collect_set("subject").alias("said"))
        n = said.count()
        # bounded samples by hash: they fit the lexicon, every document is judged
        some = said.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < min(1.0, FIT_DOCS / max(1, n)) * 1_000_003).limit(2 * FIT_DOCS)
        some = cut(some)
        known = docs.join(F.broadcast(some), "doc_id").filter(F.length("text") <= FIT_CHARS).select("text", "said", "source")
        # the column only helps to sample every language; the text tells which it is
        tag = F.when(F.lower("lang").isin("en", "fr", "ms", "de"), F.lower("lang")).otherwise("other")
        per = documents.filter("text is not null").groupBy(tag.alias("tag")).agg((F.lit(FIT_PLAIN) / F.count(F.lit(1))).alias("share"))
        others = documents.filter("doc_id is not null and trim(text) <> ''").filter(F.length("text") <= FIT_CHARS).select("doc_id", "text", tag.alias("tag")).join(F.broadcast(per), "tag")
        others = others.filter(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1_000_003)) < F.col("share") * 1_000_003).select("text").limit(10 * FIT_PLAIN)
        fitting = []
        by_source: dict[str, dict[int, float]] = {}
        for r in known.toLocalIterator():
            l = sorted({number[x] for x in r.said if x in number})
            if len(l) > 1:
                l = [x for x in l if x]
            fitting.append((r.text, l))
            for x in l:
                by_source.setdefault(r.source or "", {}).setdefault(x, 0.0)
                by_source[r.source or ""][x] += 1 / len(l)
        fitting += [(r.text, []) for r in others.toLocalIterator()]
        fitting += [(d + ".", [i + 1]) for i, (_, d) in enumerate(rows) if d]
        self.table = fit_all(fitting, k)
        #: how much of a source's labelled documents have each subject; only sources with enough labels speak
        self.by_source = {s: np.array([(c.get(x, 0.0)) / sum(c.values()) for x in range(k + 1)]) for s, c in by_source.items() if sum(c.values()) >= 20}
        self.docs = docs
        self.spark = spark
        self.k = k

    def votes(self) -> DataFrame:
        """(doc_id, subject, votes, share) of the pairs on which at least one function votes yes, and the pattern of all others as counts."""
        shared = self.spark.sparkContext.broadcast((self.table, self.by_source, self.names))
        k = self.k

        def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table, by_source, names = shared.value
            for whole in batches:
                for lo in range(0, whole.num_rows, 1000):
                    b = whole.slice(lo, 1000)
                    ids = b.column(0).to_pylist()
                    shares, soft, first = judge_texts(b.column(1).to_pylist(), table)
                    _, address, _ = judge_texts([" ".join(_PATH.findall(u.split("//", 1)[-1].partition("/")[2])) if u else None for u in b.column(3).to_pylist()], table)
                    lex = np.where(shares >= SHARE, "y", np.where(shares < UNSURE, "n", "-"))
                    lex2 = np.where(soft >= SHARE, "y", np.where(soft < UNSURE, "n", "-"))
                    sec = np.where(first[:, None] == np.arange(k + 1), "y", np.where(first[:, None] == 0, "-", "n"))
                    adr = np.where(address >= 0.9, "y", "-")
                    none = np.full(k + 1, 0.1)
                    prior = np.stack([by_source.get(x or "", none) for x in b.column(2).to_pylist()]) if len(ids) else np.empty((0, k + 1))
                    src = np.where(prior >= 0.4, "y", np.where(prior < 0.01, "n", "-"))
                    f = np.char.add(np.char.add(np.char.add(lex, lex2), np.char.add(sec, adr)), src)[:, 1:]
                    speaks = ((lex == "y") | (lex2 == "y") | (sec == "y") | (adr == "y") | (src == "y") | (lex == "-") | (lex2 == "-"))[:, 1:]
                    i, c = np.nonzero(speaks)
                    quiet, often = np.unique(f[~speaks], return_counts=True)  # nobody speaks for these: they only enter the counts
                    names_ = ["doc_id", "subject", "votes", "share", "n"]
                    yield pa.RecordBatch.from_arrays([pa.array([ids[x] for x in i], pa.int64()), pa.array([names[x] for x in c], pa.string()), pa.array(f[i, c].tolist(), pa.string()), pa.array(shares[i, c + 1]), pa.array(np.ones(len(i), np.int64))], names_)
                    m = len(quiet)
                    yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.nulls(m, pa.string()), pa.array(quiet.tolist(), pa.string()), pa.array(np.zeros(m)), pa.array(often.astype(np.int64))], names_)

        return self.docs.mapInArrow(vote, "doc_id bigint, subject string, votes string, share double, n bigint")

    def assigned(self) -> DataFrame:
        """(doc_id, subject, share, p) of every pair with a posterior of at least one half."""
        schema = "votes string, p double"
        if not self.k:
            return self.docs.limit(0).select("doc_id", F.lit("").alias("subject"), F.lit(0.0).alias("share"), F.lit(0.0).alias("p"))
        votes = cut(self.votes())
        # at most 3 ** len(FUNCTIONS) patterns
        counts = {r.votes: r.n for r in votes.groupBy("votes").agg(F.sum("n").alias("n")).toLocalIterator()}
        post = self.spark.createDataFrame(list(learn(counts).items()) or [("", 0.0)], schema)
        return votes.filter("doc_id is not null").join(F.broadcast(post), "votes").filter("p >= 0.5").select("doc_id", "subject", "share", "p")


def found(documents: DataFrame, subjects: DataFrame, labels: DataFrame) -> DataFrame:
    return Subjects(documents, subjects, labels).assigned().select("doc_id", "subject")


def composition(documents: DataFrame, subjects: DataFrame, labels: DataFrame) -> DataFrame:
    """(subject, documents, share): the make-up of the corpus by subject; a document counts for each of its subjects."""
    s = Subjects(documents, subjects, labels)
    by = s.assigned().groupBy("subject").agg(F.count(F.lit(1)).alias("documents"))
    total = s.docs.count()
    names = subjects.filter("subject is not null").select("subject").distinct()
    out = names.join(by, "subject", "left")
    n = F.coalesce("documents", F.lit(0))
    return out.select("subject", n.alias("documents"), F.coalesce(F.try_divide(n, F.lit(total)), F.lit(0.0)).alias("share"))
